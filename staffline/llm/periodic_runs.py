"""Stretches of words that repeat with a period, and texts with the repeats taken out.

A run is a stretch of consecutive words in which words ``q`` apart are equal, ``q`` the
smallest such number, that no neighbouring word extends and that is ``MIN_PERIODS`` times
``q`` and ``MIN_WORDS`` words long at least.

Runs come from suffix trees. Of the words and of their reversal a tree is built by
Ukkonen's method. How far two suffixes agree is the depth of the lowest common ancestor of
their leaves, which is the least depth on the Euler tour between them; the tour is kept as
the least depth between neighbouring leaves, with a sparse table on top, so that any number
of pairs is answered by two look-ups each. For both orders of the alphabet, the longest
Lyndon word at each place ends where the next smaller suffix begins. Every run has such a
word as a root in one of the two orders, so all runs are found by extending each root to
both sides, forwards in one tree, backwards in the other. A Lyndon word has no shorter
period, so the root's length is the run's smallest period.

Most words of a text cannot be in a run, and trees are built only where they can be. In a
run every four neighbouring words come again within one period, and a period is at most a
quarter of the run. So a place stays in question only if its four words come again no
farther away than a quarter of the stretch of such places around it; this is repeated
until nothing changes. No run is lost or cut: its own places always pass.

A text is worked on by itself, whole; texts are not shuffled. A stretch in question takes
about 500 bytes a word while it is worked on.

Nulls: a null text has no words, like an empty one; its collapsed text is empty. Repeated
rows each get their runs. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffline.llm.words import Words, as_bytes, buffers, mix

MIN_WORDS = 6
MIN_PERIODS = 4
#: Neighbouring words that come again; every run of ``MIN_WORDS`` words has some.
GRAM = 4


class SuffixTree:
    """Of a list of numbers from 1 on; an end mark, 0, is added. Order 0 is that of the
    numbers, order 1 the reverse, the end mark being smallest in both."""

    def __init__(self, symbols: list[int]) -> None:
        self.size = len(symbols) + 1
        self._build([*symbols, 0], max(symbols, default=0) + 1)
        self._tour()

    def _build(self, s: list[int], width: int) -> None:
        """Ukkonen's method: all suffixes of a prefix grow by one symbol at a time."""
        n = len(s)
        go: dict[int, int] = {}
        start, end, link = [0] * (2 * n), [0] * (2 * n), [0] * (2 * n)
        leaves: list[int] = []
        nodes, node, edge, length, rest = 1, 0, 0, 0, 0
        for i, symbol in enumerate(s):
            rest += 1
            unlinked = 0
            while rest:
                if not length:
                    edge = i
                key = node * width + s[edge]
                child = go.get(key)
                if child is None:
                    go[key] = nodes
                    start[nodes], end[nodes] = i, n
                    leaves.append(nodes)
                    nodes += 1
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    at = start[child]
                    span = end[child] - at
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if s[at + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    if unlinked:
                        link[unlinked] = nodes
                    unlinked = go[key] = nodes
                    key = nodes * width
                    start[nodes], end[nodes] = at, at + length
                    start[child] = at = at + length
                    go[key + s[at]] = child
                    nodes += 1
                    go[key + symbol] = nodes
                    start[nodes], end[nodes] = i, n
                    leaves.append(nodes)
                    nodes += 1
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        keys = np.fromiter(go.keys(), np.int64, len(go))
        child = np.fromiter(go.values(), np.int64, len(go))
        order = np.argsort(keys)
        self._child, self._parent, self._symbol = child[order], keys[order] // width, keys[order] % width
        self._length = (np.array(end) - np.array(start))[:nodes].tolist()
        suffix = np.full(nodes, -1)  # leaves come in the order of suffixes
        suffix[leaves] = np.arange(n)
        self._suffix = suffix.tolist()

    def _children(self, order: np.ndarray) -> tuple[list[int], list[int]]:
        """Children of all nodes, last first, and where those of each node begin."""
        last_first = order[::-1]
        bounds = len(order) - np.searchsorted(self._parent, np.arange(len(self._suffix) + 1))
        return self._child[last_first].tolist(), bounds.tolist()

    def _tour(self) -> None:
        """Leaves as met on the tour, and the least depth between each and the one before."""
        child, bounds = self._children(np.arange(len(self._child)))
        length, suffix = self._length, self._suffix
        above = [0] * len(suffix)
        met, least = [], []
        turn = 0
        stack = [0]
        while stack:
            node = stack.pop()
            depth = above[node]
            if depth < turn:
                turn = depth
            own = suffix[node]
            if own >= 0:
                met.append(own)
                least.append(turn)
                turn = self.size
                continue
            below = child[bounds[node + 1] : bounds[node]]
            depth += length[node]
            for c in below:
                above[c] = depth
            stack += below
        self.rank = np.empty(self.size, np.int64)
        self.rank[met] = np.arange(self.size)
        table = [np.array(least, np.int32)]
        step = 1
        while 2 * step <= self.size:
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
            step *= 2
        self._least = table

    def reverse_rank(self) -> np.ndarray:
        """Places of the suffixes in order 1."""
        key = np.where(self._symbol == 0, 0, self._symbol.max(initial=0) + 1 - self._symbol)
        child, bounds = self._children(np.lexsort((key, self._parent)))
        suffix, met, stack = self._suffix, [], [0]
        while stack:
            node = stack.pop()
            own = suffix[node]
            if own >= 0:
                met.append(own)
            else:
                stack += child[bounds[node + 1] : bounds[node]]
        rank = np.empty(self.size, np.int64)
        rank[met] = np.arange(self.size)
        return rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and j have in common; i and j differ."""
        a, b = self.rank[i], self.rank[j]
        first, last = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((last - first).astype(float))[1] - 1
        out = np.empty(len(first), np.int64)
        for k, row in enumerate(self._least):
            own = np.flatnonzero(level == k)
            if len(own):
                out[own] = np.minimum(row[first[own]], row[last[own] - (1 << k)])
        return out


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Of the longest Lyndon word at each place but the end mark's: up to the next smaller
    suffix."""
    ranks = rank.tolist()
    until = [0] * len(ranks)
    stack: list[int] = []
    for i, own in enumerate(ranks):
        while stack and ranks[stack[-1]] > own:
            until[stack.pop()] = i
        stack.append(i)
    n = len(ranks) - 1
    return np.array(until[:n], np.int64) - np.arange(n)


def runs_by_trees(symbols: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows of start, length and period, ordered. ``symbols``: numbers from 1 on."""
    n = len(symbols)
    if n < min_words:
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree(symbols.tolist())
    place = np.arange(n)
    period = np.concatenate([lyndon_lengths(tree.rank), lyndon_lengths(tree.reverse_rank())])
    place = np.concatenate([place, place])
    until = place + period + tree.common(place, place + period)
    del tree
    tree = SuffixTree(symbols[::-1].tolist())
    start = place - tree.common(n - place, n - place - period)
    long = until - start >= np.maximum(min_words, min_periods * period)
    return np.unique(np.column_stack([start, until - start, period])[long], axis=0).reshape(-1, 3)


def _numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def stretches(words: Words, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Where runs may be, as rows of first word and the one after the last, among all words
    of a buffer. Every run is whole in one row, and a row is in one text.

    Words are compared by hash here: what agrees by chance is a place in question more."""
    keys, first = words.windows(GRAM)
    keys = keys ^ mix(words.doc[first].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    place = first[order]
    apart = place[again + 1] - place[again]
    # A place between two others is nearest to one of them; those of one key are in order.
    near = np.full(len(words.start) + 1, len(words.start) + 1)
    near[place[again + 1]] = apart
    near[place[again]] = np.minimum(near[place[again]], apart)
    valid = near <= len(words.start)
    while True:
        edge = np.diff(np.concatenate([[0], valid.view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n_words = end - begin + GRAM - 1
        reach = np.repeat(np.where(n_words >= min_words, n_words // min_periods, 0), end - begin)
        inside = np.flatnonzero(valid)
        gone = inside[near[inside] > reach]
        if not len(gone):
            return np.column_stack([begin, end + GRAM - 1])
        valid[gone] = False


def runs(words: list[bytes], where: list[tuple[int, int]]) -> np.ndarray:
    """Rows of start, length and period of the runs of a text's words, ordered."""
    found = []
    for first, last in where:
        rows = runs_by_trees(_numbered(words[first:last]) + 1)
        rows[:, 0] += first
        found.append(rows)
    out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(texts: list[bytes]):
    """For each text, in order, its words and their runs."""
    for part, words in buffers(texts):
        where = stretches(words)
        of = words.doc[where[:, 0]] if len(where) else where[:, 0]
        before = np.searchsorted(words.doc, np.arange(words.n_docs))
        bounds = np.searchsorted(of, np.arange(words.n_docs + 1))
        for i, raw in enumerate(texts[part]):
            own = raw.split()  # at the six ASCII white space characters
            yield own, runs(own, (where[bounds[i] : bounds[i + 1]] - before[i]).tolist())


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words joined by spaces, without those that any run has after its first period."""
    if not len(found):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k)


#: Texts given back at a time.
BATCH_TEXTS = 500


def with_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key as ``doc_id``, ``n_words``, ``runs`` (start, length and period in
    words, by start and period) and ``collapsed``, the text without the repeats."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), iter(as_bytes(batch.column(1)))
            at = 0
            while part := list(islice(texts, BATCH_TEXTS)):
                n_words, offsets, rows, short = [], [0], [], []
                for words, found in runs_of(part):
                    n_words.append(len(words))
                    rows.append(found)
                    offsets.append(offsets[-1] + len(found))
                    short.append(collapsed(words, found))
                flat = np.concatenate(rows)
                fields = [pa.array(flat[:, i].copy()) for i in range(3)]
                spans = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array(n_words, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), pa.array(short, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])
                at += len(part)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(
        run, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
