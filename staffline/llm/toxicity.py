"""Toxicity from a lexicon, its misspellings, and their context.

The lexicon is learnt: words of labelled texts that occur in toxic ones far more often than
chance allows, given the number of words looked at, besides a few fixed ones. A beginning
of words that tells as much is a term, too, a stem (written with ``*``), and stands for all
words that begin with it. Words of a text are matched with whole terms up to a number of
edits that depends on the term's length, from the first letter on, and once more with marks
read as the letters they stand for (``LEET``); a word that clean texts of the sample hold
more than once is no misspelling. For this the lexicon is a trie, and a Levenshtein automaton
runs over it: a state is the set of trie nodes that the letters read so far can reach, each
with the edits used. States are made when first needed and kept, so that a word costs a
look-up for each letter, and a word unlike all terms is left as soon as no node is in reach.

Each match is seen in a window of ``WINDOW`` words to both sides. Quotation marks and words
that report speech or speak about words make it a quotation; words of address and other
matches nearby make it abuse. Counts of matches by number of edits and by context are the
features of a logistic model.

Lexicon and model are learnt from a sample of at most ``SAMPLE`` labelled documents, those
with the smallest hashes of their ids, without copies of one another (documents that agree in all
of three minimum hashes of their word windows count once), because words of a text that
is there many times would all seem telling. Word counts of the sample are made by Spark, and
only the lexicon (words of the sample that pass a test) and the sample's features
reach the driver. Scoring
runs over all documents in one pass without a shuffle and uses the text alone.

Nulls: null, empty and blank texts have all features zero and get the score of a text
without matches. Labels that are null, of unknown documents or null ids are ignored.
Repeated rows are scored each. Without labels of both kinds the model is a fixed one. Empty
tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.llm.words import Words, as_bytes, buffers, mix
from staffline.session import staged

SAMPLE = 20_000
WINDOW = 8
#: Edits allowed from this length of a term on.
EDITS = ((9, 2), (5, 1), (0, 0))
LEAST_LETTERS = 4
#: Letters of a stem, and the share of toxic texts among those that hold it.
STEMS, STEM_SHARE, TERM_SHARE = (4, 5, 6), 0.9, 0.5
#: A word is taken if fewer than this many would be expected by chance among all.
CHANCE = 0.05
#: Words of the windows that tell copies of a document.
COPY_WINDOW = 4
#: Texts whose words are counted at once, and tasks for the sample.
AT_ONCE, TASKS = 100, 24
#: States of the automaton and words with their edits kept; beyond, they are made anew.
STATES = 200_000
KEPT_WORDS = 2_000_000
BUFFER = 2 << 20
RIDGE = 1e-3
NEWTON_STEPS = 30

#: Fixed values.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "imbecile", "bastard", "worthless", "pathetic", "disgusting")
QUOTES = "\"“”„«»‹›‘’`"
REPORTING = frozenset("said says say called calls wrote writes quoted quote quotes word words term terms meaning means spelled slur slurs insult insults sagte schrieb wort dit mot dijo palabra".split())
ADDRESS = frozenset("you your youre yours u ur du dich dir dein ihr tu te toi vous tes tú ti usted eres".split())
_EDGE = " \t\n\r\x0b\x0c.,;:!?#%&$*|+=~^/\\()[]{}<>@_-'…–—¡¿" + QUOTES


#: Marks in place of letters; a one may be an i or an l.
LEET = tuple(str.maketrans("$@103", f"sa{one}oe") for one in "il")
_MARKS, _LETTER = frozenset("$@103"), re.compile(r"[^\W\d_]")


def edits_for(term: str) -> int:
    return next(k for least, k in EDITS if len(term) >= least)


class FuzzyLexicon:
    """Terms of a trie within their numbers of edits of a word. Without ``from_root`` the
    first letter must be right."""

    def __init__(self, terms: Iterable[str], exceptions: Iterable[str] = (), from_root: bool = False) -> None:
        self.exceptions, self.from_root = frozenset(exceptions), from_root
        self.known, self.known_edits = np.zeros(0, np.uint64), np.zeros(0, np.int8)
        self.children: list[dict[str, int]] = [{}]
        self.stems: set[int] = set()
        self.allowed = [-1]  # of the term that ends here
        self.below = [-1]  # the most that any term from here on allows
        for term in terms:
            stem = term.endswith("*")
            k, node = 0 if stem else edits_for(term), 0
            self.below[0] = max(self.below[0], k)
            for letter in term.removesuffix("*"):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.allowed.append(-1)
                    self.below.append(-1)
                node = self.children[node][letter]
                self.below[node] = max(self.below[node], k)
            if stem:
                self.stems.add(node)
            else:
                self.allowed[node] = k
        self._begin()

    def edits_of(self, words: Words) -> np.ndarray:
        """The edits of each word. Words met before are looked up by their hashes."""
        unique, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > KEPT_WORDS:
            self.known, self.known_edits = np.zeros(0, np.uint64), np.zeros(0, np.int8)
        at = np.searchsorted(self.known, unique)
        there = np.zeros(len(unique), bool)
        inside = at < len(self.known)
        there[inside] = self.known[at[inside]] == unique[inside]
        found = np.full(len(unique), -1, np.int8)
        found[there] = self.known_edits[at[there]]
        new = np.flatnonzero(~there)
        if len(new):
            whole = words.buffer.tobytes()
            start, end = words.start[first[new]].tolist(), words.end[first[new]].tolist()
            found[new] = [self.spelled(whole[a:b].decode().lower()) for a, b in zip(start, end, strict=True)]
            # Two sorted runs: a stable sort merges them.
            keys = np.concatenate([self.known, unique[new]])
            order = np.argsort(keys, kind="stable")
            self.known, self.known_edits = keys[order], np.concatenate([self.known_edits, found[new]])[order]
        return found[which]

    def _begin(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.stem_here: list[bool] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The state of these nodes and edits, and of what skipping letters of a term adds."""
        whole, todo = {}, [(n, e) for n, e in reached.items() if e <= self.below[n]]
        while todo:
            node, e = todo.pop()
            if whole.get(node, 99) <= e:
                continue
            whole[node] = e
            if not node and not self.from_root:
                continue
            todo += [(child, e + 1) for child in self.children[node].values() if e + 1 <= self.below[child]]
        key = tuple(sorted(whole.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.stem_here.append(any(e == 0 and n in self.stems for n, e in key))
            self.accepts.append(min((e for n, e in key if e <= self.allowed[n]), default=-1))
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.below[node] and e < reached.get(node, 99):
                reached[node] = e

        for node, e in self.sets[state]:
            if node or self.from_root:
                reach(node, e + 1)  # the letter is one too many
            for own, child in self.children[node].items():
                if node or self.from_root or own == letter:
                    reach(child, e if own == letter else e + 1)
        after = self._state(reached)
        self.steps[state][letter] = after
        return after

    def edits(self, word: str) -> int:
        """The fewest edits to a term that allows them; -1 if there is none. A word that
        begins with a stem needs none."""
        found = self._edits(word)
        return -1 if found >= 0 and word in self.exceptions else found

    def spelled(self, word: str) -> int:
        """The fewest edits of a word as it stands in a text; marks for letters count as one."""
        plain = bare(word)
        found = self.edits(plain)
        if found == 0 or plain in self.exceptions or _MARKS.isdisjoint(word) or not _LETTER.search(word):
            return found
        read = [max(e, 1) for table in LEET if (e := self.edits(bare(word.translate(table)))) >= 0]
        return min(read + [found] * (found >= 0), default=-1)

    def _edits(self, word: str) -> int:
        if len(self.sets) > STATES:
            self._begin()
        state, dead, steps, stem_here = self.start, self.dead, self.steps, self.stem_here
        for letter in word:
            after = steps[state].get(letter)
            state = self._step(state, letter) if after is None else after
            if state == dead:
                return -1
            if stem_here[state]:
                return 0
        return self.accepts[state]


def bare(word: str) -> str:
    return word.strip(_EDGE)


FEATURES = ("exact", "one_edit", "two_edits", "quoted", "addressed", "together", "share")
#: Without labels to learn from, and where the sample has no such match: fitting shrinks
#: towards these.
FIXED_WEIGHTS, FIXED_BIAS = np.array([3.0, 2.5, 1.5, -0.5, 0.5, 0.5, 1.0]), -3.0


def features(words: Words, lexicon: FuzzyLexicon) -> np.ndarray:
    out = np.zeros((words.n_docs, len(FEATURES)))
    if not len(words.start):
        return out
    edits = lexicon.edits_of(words)
    hits = np.flatnonzero(edits >= 0)
    bounds = np.searchsorted(words.doc, np.arange(words.n_docs + 1))
    whole = words.buffer.tobytes() if len(hits) else b""
    text_of = lambda i: whole[words.start[i] : words.end[i]].decode().lower()
    for hit in hits:
        doc = words.doc[hit]
        low, high = max(bounds[doc], hit - WINDOW), min(bounds[doc + 1], hit + WINDOW + 1)
        near = [text_of(i) for i in range(low, high)]
        at = hit - low
        quoted = any(c in QUOTES for c in near[at]) or (
            any(c in QUOTES for w in near[:at] for c in w[:1]) and any(c in QUOTES for w in near[at + 1 :] for c in w[-2:]))
        quoted = quoted or any(bare(w) in REPORTING for w in near)
        row = out[doc]
        row[3 if quoted else int(edits[hit])] += 1
        row[4] += any(bare(w) in ADDRESS for w in near)
        row[5] += ((edits[low:high] >= 0).sum() > 1)
    n = np.maximum(np.diff(bounds), 1)
    out[:, 6] = out[:, :4].sum(axis=1) / n * 100
    return np.minimum(np.log1p(out), 3)


@dataclass(frozen=True)
class Model:
    terms: tuple[str, ...]
    exceptions: tuple[str, ...] = ()
    weights: np.ndarray = field(default_factory=lambda: FIXED_WEIGHTS)
    bias: float = FIXED_BIAS

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights + self.bias, -60, 60)))


_lexicons: dict[tuple, FuzzyLexicon] = {}


def lexicon_of(terms: tuple[str, ...], exceptions: tuple[str, ...] = ()) -> FuzzyLexicon:
    """Kept by each Python worker between tasks, one at a time."""
    if (terms, exceptions) not in _lexicons:
        _lexicons.clear()
        _lexicons[terms, exceptions] = FuzzyLexicon(terms, exceptions, from_root=True)
    return _lexicons[terms, exceptions]


def fit(terms: tuple[str, ...], exceptions: tuple[str, ...], rows: np.ndarray, toxic: np.ndarray) -> Model:
    if not len(rows) or toxic.min() == toxic.max():
        return Model(terms, exceptions)
    x = np.column_stack([rows, np.ones(len(rows))])
    ridge = np.append(np.full(rows.shape[1], RIDGE), 0)
    prior = np.append(FIXED_WEIGHTS, FIXED_BIAS)
    w = prior.copy()
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, x.T @ (toxic - p) / len(x) - ridge * (w - prior))
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return Model(terms, exceptions, w[:-1], float(w[-1]))


def _sample_words(sample: DataFrame) -> DataFrame:
    """Per word or beginning of words how many texts hold it, and how many toxic ones, from
    partial counts of ``AT_ONCE`` texts."""

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                seen: dict[str, list[int]] = {}
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = {bare(w) for w in (text or "").lower().split()}
                    own = {w for w in own if len(w) >= LEAST_LETTERS and "*" not in w}
                    for w in own | {f"{w[:n]}*" for w in own for n in STEMS if len(w) > n}:
                        n = seen.setdefault(w, [0, 0])
                        n[0] += 1
                        n[1] += label
                n, bad = zip(*seen.values(), strict=True) if seen else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen), pa.string()), pa.array(n, pa.int64()), pa.array(bad, pa.int64())], names=["word", "n", "bad"])

    counts = sample.select("text", "toxic").mapInArrow(count, "word string, n bigint, bad bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def without_copies(sample: DataFrame) -> DataFrame:
    """``sample``: doc_id, text, toxic. One of the documents that agree in all minimum hashes."""

    def least(batches):
        for batch in batches:
            hashes = np.zeros((3, batch.num_rows), np.int64)
            for part, words in buffers(as_bytes(batch.column(1)), lower=True):
                keys, first = words.windows(COPY_WINDOW)
                doc = words.doc[first]
                # Texts without a window are told apart by their id and text.
                own = batch.column(3).to_numpy()[part].view(np.uint64)
                for n in range(3):
                    np.minimum.at(low := np.full(words.n_docs, 2**64 - 1, np.uint64), doc, mix(keys + np.uint64(n)))
                    hashes[n, part] = np.where(low == 2**64 - 1, mix(own + np.uint64(n)), low).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, hashes)], names=["doc_id", "text", "toxic", "h0", "h1", "h2"])

    out = sample.select("doc_id", "text", "toxic", F.xxhash64("doc_id", "text").alias("own")).mapInArrow(least, "doc_id bigint, text string, toxic int, h0 bigint, h1 bigint, h2 bigint")
    whole = F.min_by(F.struct("text", "toxic"), F.struct("doc_id", F.xxhash64("text")))
    return out.groupBy("h0", "h1", "h2").agg(whole.alias("d")).select("d.*")


def learn_terms(sample: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Words for which the toxic share among the texts that hold them cannot be chance:
    texts * divergence(share, overall share) bounds the logarithm of its probability. Also
    words that these terms would match though clean texts hold them."""
    facts = sample.agg(F.avg("toxic").alias("rate")).first()
    rate = facts.rate
    if not rate or rate >= 1:
        return tuple(sorted(SEEDS)), ()
    counts = staged(_sample_words(sample))
    needed = log(max(counts.count(), 1) / CHANCE)
    share = F.col("bad") / F.col("n")
    good = 1 - share
    divergence = share * F.log(share / rate) + F.when(good > 0, good * F.log(good / (1 - rate))).otherwise(0.0)
    least = F.when(F.col("word").endswith("*"), STEM_SHARE).otherwise(TERM_SHARE)
    strong = counts.where("bad > 0").withColumn("weight", F.col("n") * divergence).where(
        (share > rate) & (share >= least) & (F.col("weight") > needed))
    # Words of the bounded sample, and of these the few that cannot be chance.
    terms = tuple(sorted({*SEEDS, *(r.word for r in strong.select("word").collect())}))

    def matched(batches):
        lexicon = lexicon_of(terms)
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield batch.filter(pa.array([lexicon.spelled(w) >= 0 for w in words], pa.bool_()))

    clean = counts.where((F.col("n") - F.col("bad") > 1) & (share < TERM_SHARE) & ~F.col("word").endswith("*"))
    clean = clean.select("word", "n").mapInArrow(matched, "word string, n bigint")
    return terms, tuple(sorted(r.word for r in clean.select("word").collect()))


def train(docs: DataFrame, labels: DataFrame, label: str, allowed: Column) -> Model:
    """``allowed``: which labels may be learnt from, a condition on doc_id."""
    known = labels.where(allowed & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("toxic"))
    known = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # SAMPLE rows at most.
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    # Of rows that repeat an id, the text with the smallest hash.
    sample = sample.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic")
    sample = staged(without_copies(sample).repartition(TASKS))
    terms, exceptions = learn_terms(sample)

    def measure(batches):
        lexicon = lexicon_of(terms, exceptions)
        for batch in batches:
            x = np.zeros((batch.num_rows, len(FEATURES)))
            for part, words in buffers(as_bytes(batch.column(0)), lower=True, most=BUFFER):
                x[part] = features(words, lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.select("text", "toxic").mapInArrow(measure, "toxic int, x array<double>").toPandas()
    return fit(terms, exceptions, np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES)), rows["toxic"].to_numpy(float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id and score."""

    def run(batches):
        lexicon = lexicon_of(model.terms, model.exceptions)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for part, words in buffers(as_bytes(batch.column(1)), lower=True, most=BUFFER):
                score[part] = model.scores(features(words, lexicon))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
