import hashlib
import random
import re
import zlib

import numpy as np
from cases import no_documents, odd_documents, some_documents

from staffline.llm import periodic_runs
from staffline.llm.queries import op12_periodic_runs


def plain_runs(words, min_words=6, min_periods=4):
    """Every period, every stretch of words that equal those a period on."""
    out, known = [], {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], int)
    for q in range(1, len(ids) // min_periods + 1):
        edge = np.diff(np.concatenate([[0], (ids[:-q] == ids[q:]).astype(int), [0]]))
        for start, last in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            length = int(last - start + q)
            if length >= max(min_words, min_periods * q):
                own = ids[start : start + length]
                if not any((own[p:] == own[:-p]).all() for p in range(1, q)):
                    out.append((int(start), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    """The contract, step by step."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def random_words(rng):
    n = rng.randint(0, 70)
    words = [b"w%d" % rng.randint(1, rng.choice([1, 2, 2, 3, 5, 30])) for _ in range(n)]
    for _ in range(rng.randint(0, 2) if n > 6 else 0):
        a, p, k = rng.randrange(n), rng.randint(1, 6), rng.randint(4, 40)
        words[a : a + k] = [words[min(n - 1, a + i % p)] for i in range(len(words[a : a + k]))]
    return words


def test_trees_find_all_runs():
    """Every run of two periods, too, which the places in question are not made for."""
    rng = random.Random(2)
    for _ in range(1500):
        words = random_words(rng)
        found = periodic_runs.runs_by_trees(periodic_runs._numbered(words) + 1, 2, 2)
        assert [tuple(r) for r in found.tolist()] == sorted(plain_runs(words, 2, 2))


def test_common_prefixes():
    rng = random.Random(4)
    for _ in range(50):
        s = [rng.randint(1, 3) for _ in range(rng.randint(2, 40))]
        tree = periodic_runs.SuffixTree(s)
        pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
        found = tree.common(*(np.array(x) for x in zip(*pairs)))
        for (i, j), k in zip(pairs, found):
            assert s[i : i + k] == s[j : j + k] and (max(i, j) + k == len(s) or s[i + k] != s[j + k])
        order = sorted(range(len(s)), key=lambda i: s[i:])
        assert np.argsort(tree.rank)[1:].tolist() == order
        assert np.argsort(tree.reverse_rank())[1:].tolist() == sorted(range(len(s)), key=lambda i: [-x for x in s[i:]])


def test_runs_of_many_texts():
    rng = random.Random(6)
    texts = [random_words(rng) for _ in range(2000)]
    for words, (own, found) in zip(texts, periodic_runs.runs_of([b"\t ".join(w) for w in texts]), strict=True):
        assert own == words
        assert [tuple(r) for r in found.tolist()] == plain_runs(words)


def test_long_runs_and_long_texts():
    plain = [b"u%d" % i for i in range(20_000)]
    words = plain + [b"p%d" % (i % 701) for i in range(5000)] + plain[:50]
    ((_, found),) = periodic_runs.runs_of([b" ".join(words)])
    assert found.tolist() == [[20_000, 5000, 701]]
    ((_, found),) = periodic_runs.runs_of([b"a " * 30_000])
    assert found.tolist() == [[0, 30_000, 1]]
    # A passage that comes again far away is no run and is not in question.
    (_, w), = periodic_runs.buffers([b" ".join(plain + plain)])
    assert not len(periodic_runs.stretches(w))


def test_query_is_the_contract(spark, sf_dir):
    found = sorted(map(tuple, op12_periodic_runs(spark, sf_dir).collect()))
    docs = [d for d in some_documents(spark).collect()]
    short = {d.doc_id for d in docs if len((d.text or "").split()) < 2500}
    assert len(found) == len(docs) and len(short) > 0.9 * len(docs)
    assert [r for r in found if r[0] in short] == sorted(plain_row(d.doc_id, d.text) for d in docs if d.doc_id in short)


def test_odd_documents(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in odd_documents(spark).select("doc_id", "text").collect()]
    rows += [(i, t) for i in range(20, 60) for t in ("a b " * 9, "one", "", None, "x " * 5 + "y", "q r " * 8)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = op12_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1], r[-2])
    short = [r for r in rows if r[0] != 6]
    assert sorted((tuple(r) for r in found if r.doc_id != 6), key=key) == sorted((plain_row(*r) for r in short), key=key)
    assert sum(r.doc_id == 6 for r in found) == 1


def test_empty_table_and_clashing_columns(spark):
    assert periodic_runs.with_runs(no_documents(spark)).collect() == []
    docs = odd_documents(spark).withColumnsRenamed({"tokens": "runs", "component_id": "collapsed"})
    assert periodic_runs.with_runs(docs).columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert periodic_runs.with_runs(docs).count() == docs.count()
