import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import no_documents, odd_documents, some_documents

from staffline.llm import near_copies as near
from staffline.llm.components import components


def shingles(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    inverted, root = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j, n in Counter(j for x in sets[i] for j in inverted[x] if j < i).items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_documents_against_all_pairs(spark):
    docs = some_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(near.near_copies(docs)) == brute(rows)


@pytest.mark.parametrize("changed", [4, 9])
def test_a_large_group_around_an_absent_centre(spark, changed):
    """Copies of one text with other words in places: most are linked only by way of others."""
    rng = random.Random(changed)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randint(1, changed)):
            words[at] = f"x{rng.randint(0, 5)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(f"u{i}_{k}" for k in range(50))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near.near_copies(docs)) == brute(rows)


def test_blocks_smaller_than_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 7)
    test_a_large_group_around_an_absent_centre(spark, 9)


def test_odd_cases(spark):
    docs = odd_documents(spark)
    got = near.near_copies(docs).collect()
    assert len(got) == docs.count()
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by_id[1] == {(4, 1, True)} and by_id[2] == {(4, 1, False)}
    assert by_id[3] == {(0, 3, True)} and by_id[4] == {(0, 4, True)} and by_id[5] == {(0, 5, True)}
    assert {x[1:] for x in by_id[None]} == {(None, True)}
    kept = near.deduplicated(docs)
    assert kept.schema == docs.schema
    assert kept.count() == docs.count() - 2
    assert near.near_copies(no_documents(spark)).count() == 0


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(3)
    for overlap in (0.3, 0.6, 0.8, 0.95):
        values = rng.integers(0, 2**63, 3000).astype(np.uint64)
        n = int(2000 * overlap)
        a, b = values[:2000], np.concatenate([values[:n], values[2000 : 4000 - n]])
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (near.packed(near.minima(v)) for v in (a, b))
        differs = np.zeros(near.WORDS, np.int64)
        for bit in range(near.FIELD_BITS):
            differs |= x[bit * near.WORDS : (bit + 1) * near.WORDS] ^ y[bit * near.WORDS : (bit + 1) * near.WORDS]
        unequal = int(np.bitwise_count(differs.view(np.uint64)).sum())
        assert abs(near.similarity_of(1 - unequal / near.MINIMA) - exact) < 0.15


def test_few_pairs_are_missed_by_bands_and_estimate_together():
    bands = (1 - 0.8**near.ROWS) ** near.BANDS
    n, p = near.MINIMA, 0.15  # unequal fields at similarity 0.8
    estimate = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(near.most_unequal(80) + 1, n + 1))
    assert bands + estimate < 4e-7


def test_components_of_a_chain_a_star_and_loops(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (5, 4), (4, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


def test_repeated_rows_of_two_near_copies_do_not_multiply(spark):
    words = [f"w{i}" for i in range(200)]
    other = [*words[:100], "other", *words[101:]]
    rows = [(1, " ".join(words))] * 60 + [(2, " ".join(other))] * 60
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = near.near_copies(docs).collect()
    assert len(found) == 120 and {r.component_id for r in found} == {1}
    pairs = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    assert near._confirmed(pairs, docs, 4, 80).count() == 1


def test_blocks_are_dealt_by_block(spark):
    """With sort-merge joins, too, the blocks of one key go to many tasks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.range(3000).selectExpr("bigint(1) AS key", "id AS doc_id", "id % 30 AS root", *[f"bigint(id) AS {p}" for p in near.PLANES])
        blocks = near._between_components(rows, 80, exact=False)
        plan = blocks._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [key" in plan and ", i#" in plan and ", j#" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
