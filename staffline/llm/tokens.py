"""Token ids of whole texts by a public tokenizer, piece by piece.

The tokenizer cuts a text at white space before anything else, so a text's ids are those
of its words in turn. A word that is a run of plain Latin letters and then a run of plain
punctuation is cut between the two, as the tokenizer itself does; any other word stays
whole. Pieces come back often: each Python worker keeps the ids of up to ``KEPT_PIECES``
pieces in sorted arrays, found by the hash of the piece in lower case, and gives only new
pieces to the tokenizers library. The tokenizer looks for its added tokens before it lower-
cases, so pieces that spell one, in whatever case, are known by a hash of their own bytes.
Ids hence do not depend on what a worker has seen before. Runs of letters are given many to a call, separated by spaces;
the ids that end a word tell where each one stops.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from hashlib import blake2b

import numpy as np

from staffline.llm.words import Words, buffers

#: Pieces kept; beyond, the table is emptied. About 40 bytes each.
KEPT_PIECES = 2_000_000
BUFFER = 2 << 20
LETTER_RUNS = 1000

_SPACE, _LETTER, _MARK, _OTHER = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, np.int8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = _LETTER
#: Neither composes with a combining mark nor begins a contraction.
_KIND[list(b"!#$%&*+,-./:;?@|~")] = _MARK


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed tokenizer files have this one, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _kinds(buffer: np.ndarray) -> np.ndarray:
    kinds = _KIND[buffer]
    lead = np.flatnonzero(buffer[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for two signs
    lead = lead[(buffer[lead + 1] != 0x97) & (buffer[lead + 1] != 0xB7)]
    kinds[lead] = kinds[lead + 1] = _LETTER
    return kinds


def pieces(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each piece, and whether it is letters only."""
    start, end = words.start, words.end
    if not len(start):
        return start, end, words.doc, np.zeros(0, bool)
    kinds = _kinds(words.buffer)
    others = np.zeros(len(kinds) + 1, np.int32)
    np.cumsum(kinds == _OTHER, out=others[1:])
    turns = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    turn = np.searchsorted(turns, start, "right")
    inner = np.searchsorted(turns, end, "left") - turn
    plain = others[end] == others[start]
    letters = plain & (inner == 0) & (kinds[start] == _LETTER)
    cut = plain & (inner == 1) & (kinds[start] == _LETTER)
    at = turns[turn[cut]]
    begin = np.concatenate([start, at])
    order = np.argsort(begin, kind="stable")
    stop = end.copy()
    stop[cut] = at
    stop = np.concatenate([stop, end[cut]])[order]
    doc = np.concatenate([words.doc, words.doc[cut]])[order]
    alone = np.concatenate([letters | cut, np.zeros(len(at), bool)])[order]
    return begin[order], stop, doc, alone


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        added = {t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.key, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of letters only."""
        out = []
        for at in range(0, len(words), LETTER_RUNS):
            run = words[at : at + LETTER_RUNS]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            out += np.split(ids, ends[:-1]) if len(ends) == len(run) and ends[-1] == len(ids) else self._alone(run)
        return out

    def _learn(self, key: np.ndarray, found: list[bytes], letters: np.ndarray) -> None:
        texts = [x.decode() for x in found]
        new: list[np.ndarray] = [self.ids[:0]] * len(texts)
        for kind, encode in ((True, self._runs), (False, self._alone)):
            which = np.flatnonzero(letters == kind)
            for at, ids in zip(which, encode([texts[i] for i in which]), strict=True):
                new[at] = ids
        size = np.fromiter(map(len, new), np.int32, len(new))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *new])
        keys = np.concatenate([self.key, key])
        order = np.argsort(keys, kind="stable")
        self.key = keys[order]
        self.at, self.size = np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def _mark_added(self, whole: bytes, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> None:
        """Pieces that spell an added token get keys by their bytes as they are."""
        if self.added is None or not len(start):
            return
        places = np.array([m.start() for m in self.added.finditer(whole.lower())], np.int64)
        for i in np.unique(np.searchsorted(start, places, "right") - 1):
            if i >= 0:
                digest = blake2b(whole[start[i] : end[i]], digest_size=8, person=b"as spelled").digest()
                keys[i] = int.from_bytes(digest, "little")

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, given as UTF-8."""
        out: list[np.ndarray] = []
        for part, words in buffers(texts, lower=True, most=BUFFER):
            start, end, doc, letters = pieces(words)
            keys = words.hash_spans(start, end)
            whole = words.buffer.tobytes()
            self._mark_added(whole, start, end, keys)
            unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
            if len(self.key) + len(unique) > KEPT_PIECES:
                self._forget()
            at = np.searchsorted(self.key, unique)
            new = (at == len(self.key)) | (self.key[np.minimum(at, len(self.key) - 1)] != unique) if len(self.key) else np.ones(len(unique), bool)
            if new.any():
                found = [whole[start[i] : end[i]] for i in first[new]]
                self._learn(unique[new], found, letters[first[new]])
                at = np.searchsorted(self.key, unique)
            place = at[which]
            size = self.size[place].astype(np.int64) if len(place) else np.zeros(0, np.int64)
            until = np.cumsum(size)
            total = int(until[-1]) if len(until) else 0
            flat = self.ids[np.repeat(self.at[place] - until + size, size) + np.arange(total)] if total else self.ids[:0]
            counts = np.bincount(doc, size, words.n_docs).astype(np.int64)
            out += np.split(flat, np.cumsum(counts)[:-1])
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
