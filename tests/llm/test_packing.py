import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import no_documents, odd_documents, some_documents
from tokenizers import Tokenizer

from staffline.llm import packing
from staffline.llm.queries import op4_packing
from staffline.llm.tokens import encoder, tokenizer_path


def layout(steps):
    """Sequence -> (offset, length) of its pieces; also every piece's number once."""
    out, numbers = defaultdict(list), defaultdict(list)
    for s in steps:
        for i in range(s.n):
            out[s.sequence + i // s.each].append((s.offset + i % s.each * s.length, s.length))
            numbers[s.length].append(s.first + i)
    return out, numbers


def check_plan(counts, capacity, steps):
    out, numbers = layout(steps)
    for length, n in enumerate(counts):
        assert sorted(numbers[length]) == list(range(n))
    assert sorted(out) == list(range(len(out)))
    for pieces in out.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return len(out)


@pytest.mark.parametrize("seed", range(12))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 40, 300, 4096])
    draw = rng.choice([lambda: rng.randint(1, capacity), lambda: min(capacity, int(rng.lognormvariate(np.log(capacity / 6), 1)) + 1), lambda: capacity // 3 + 1])
    counts = np.bincount([draw() for _ in range(rng.choice([1, 50, 3000]))], minlength=capacity + 1)
    n = check_plan(counts, capacity, packing.plan(counts, capacity))
    assert n >= -(-int(counts @ np.arange(capacity + 1)) // capacity)


def test_plans_are_close_to_the_least_possible():
    rng = np.random.default_rng(2)
    lengths = np.minimum(4096, rng.lognormal(6.4, 1, 20_000).astype(int) + 1)
    counts = np.bincount(lengths, minlength=4097)
    n = check_plan(counts, 4096, packing.plan(counts))
    assert n <= 1.003 * lengths.sum() / 4096 + 1
    assert packing.plan(np.zeros(4097, int)) == []


def test_steps_do_not_grow_with_the_documents():
    rng = np.random.default_rng(4)
    counts = np.bincount(np.minimum(4096, rng.lognormal(6.4, 1, 20_000).astype(int) + 1), minlength=4097)
    assert len(packing.plan(counts * 1000)) < 2 * len(packing.plan(counts))


def check_rows(rows, texts, tokenizer):
    """Against the library's ids of each whole text."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    expected = Counter()
    for key, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for number, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            expected[key, number, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096


def test_query_against_the_library(spark, sf_dir):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = [(r.doc_id, r.text) for r in some_documents(spark).collect()]
    rows = op4_packing(spark, sf_dir).collect()
    check_rows(rows, texts, tokenizer)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 4096) + 1


def test_odd_cases(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = odd_documents(spark).repartition(3)
    check_rows(packing.packed(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert packing.packed(no_documents(spark)).count() == 0


def test_pieces_of_words_give_the_library_ids():
    library, own = Tokenizer.from_file(tokenizer_path()), encoder(tokenizer_path())
    rng = random.Random(3)
    signs = "aAbéÉßñ'.,-<=>|~ \n\t1²½̸́Σςİ—…\xa0_#*\"()日ไ\x1c\x85"
    texts = ["", "I'm don't 'S <|endoftext|> x<|endoftext|>y ΣΣ ẞ ≮ ≠> a,' b.'s", "ΌΔΟΣ ὈΔΥΣΣΕΎΣ. xͅ ﬁ ǅ", "word's WORD'S can't,. don't!! it's."]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_full_table_of_pieces_starts_anew(monkeypatch):
    monkeypatch.setattr("staffline.llm.tokens.KEPT_PIECES", 50)
    monkeypatch.setattr("staffline.llm.tokens.BUFFER", 300)
    library, own = Tokenizer.from_file(tokenizer_path()), encoder.__wrapped__(tokenizer_path())
    texts = [f"some words {i} and more words {i * 7} Ünd, mehr." for i in range(60)]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
