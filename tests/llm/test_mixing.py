import hashlib
import re

from cases import no_documents, odd_documents, some_documents
from pyspark.sql import functions as F

from staffline.llm import mixing
from staffline.llm.queries import MIX, domain_of, op8_mixing


def tokens(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) + 1


def place(key, epoch, seed):
    return 0 if key is None else int(hashlib.md5(f"{seed}:{epoch}:{key}".encode()).hexdigest()[:15], 16)


def shared_out(grant, nodes):
    """nodes: name -> (capacity, weight). Fill step by step until nobody can take more."""
    out = dict.fromkeys(nodes, 0.0)
    while grant > 1e-9:
        open_ = {k: w or 1e-12 for k, (c, w) in nodes.items() if out[k] < c - 1e-9}
        if not open_:
            break
        total = sum(open_.values())
        step = min(min((nodes[k][0] - out[k]) * total / w for k, w in open_.items()), grant)
        for k, w in open_.items():
            out[k] += step * w / total
        grant -= step
    return out


def brute(rows, share, weights, epochs, seed):
    """(doc, epoch) of every copy taken."""
    leaves = {}
    for key, text, *leaf in rows:
        leaves.setdefault(tuple(leaf), []).append((key, tokens(text)))
    size = {k: sum(t for _, t in v) for k, v in leaves.items()}
    grants = {(): min(share * sum(size.values()), epochs * sum(size.values()))}
    for depth, level in enumerate(("domain", "lang", "source")):
        below = {}
        for parent, grant in grants.items():
            names = sorted({k[: depth + 1] for k in leaves if k[:depth] == parent}, key=repr)
            nodes = {n: (epochs * sum(s for k, s in size.items() if k[: depth + 1] == n), weights.get(level, {}).get(n[-1], 1.0)) for n in names}
            below |= shared_out(grant, nodes)
        grants = below
    out = []
    for leaf, docs in leaves.items():
        budget = min(-int(-round(grants[leaf], 6) // 1), epochs * size[leaf])
        whole, left = divmod(budget, size[leaf])
        out += [(key, e) for key, _ in docs for e in range(whole)]
        taken, last = 0, None
        for at, key, n in sorted((place(k, whole, seed), repr(k), n) for k, n in docs) if left else ():
            if taken >= left and at != last:
                break
            out.append((int(key), whole))
            taken, last = taken + n, at
    return sorted(out)


def test_query_against_step_by_step_filling(spark, sf_dir):
    docs = some_documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text", domain_of(), "lang", "source").collect()]
    got = sorted((r.doc_id, r.epoch) for r in op8_mixing(spark, sf_dir).collect())
    assert got == brute(rows, 0.5, MIX, 2, 17)


def test_shortages_go_to_siblings_before_ancestors(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICES", 4)
    rows = []
    for source, n in {"a0": 2, "a1": 40, "b0": 60, "b1": 60}.items():
        rows += [(len(rows) + i, "x " * 9, "en", source) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    domain = F.substring("source", 1, 1)
    for share, epochs in ((0.3, 1), (0.9, 1), (1.0, 1), (1.7, 3), (0.0, 2)):
        got = sorted((r.doc_id, r.epoch) for r in mixing.mixed(docs, domain, share, {}, epochs, epoch_column="epoch").collect())
        assert got == brute([(i, t, s[0], g, s) for i, t, g, s in rows], share, {}, epochs, 17)
    # 0.3 of 1620 tokens, half for each domain: a0 has 20, so a1 gives the other 223.
    cuts = {r.of_source: r.budget for r in mixing.cut_points(docs, domain, 0.3, {}, 1, 17).collect()}
    assert cuts == {"a0": 20, "a1": 223, "b0": 122, "b1": 122}


def test_sources_of_any_name(spark):
    want = {
        "src4": "domain0", "src5": "domain1", "web": "web", "": "", "hot ": "hot ", None: None, "s3000000004": "domain600000000",
        "src" + "9" * 30: "src", "9" * 30: "", "src\u0663": "src\u0663", "a1b": "a1b",
    }
    rows = [(i, "some words", "en", s) for i, s in enumerate(want)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.source: r.domain for r in docs.select("source", domain_of().alias("domain")).collect()} == want
    got = mixing.mixed(docs, domain_of(), 0.5, MIX, max_epochs=2, epoch_column="epoch")
    by_hand = brute([(i, t, want[s], g, s) for i, t, g, s in rows], 0.5, MIX, 2, 17)
    assert sorted((r.doc_id, r.epoch) for r in got.collect()) == by_hand


def test_odd_cases(spark):
    docs = odd_documents(spark)
    everything = mixing.mixed(docs, domain_of(), 1.0)
    assert everything.schema == docs.schema and everything.count() == docs.count()
    assert mixing.mixed(docs, domain_of(), 0.5).count() <= docs.count()
    assert mixing.mixed(no_documents(spark), domain_of(), 0.5).count() == 0
    counted = docs.select("text", mixing.n_tokens(F.col("text")).alias("n")).collect()
    assert [r.n for r in counted] == [tokens(r.text) for r in counted]


def test_repeated_and_null_ids_keep_the_budget(spark, monkeypatch):
    """A thousand rows of one id, of none, and equal in all columns: each row has a place."""
    monkeypatch.setattr(mixing, "SLICES", 8)
    rows = [(7, f"w{i} x y", "en", "a", i) for i in range(1000)] + [(None, f"w{i} x y", "en", "b", i) for i in range(1000)]
    rows += [(9, "same text here", "en", "c", 1)] * 1000 + [(None, None, "en", "d", None)] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int").repartition(5)
    for share, epochs in ((0.1, 1), (0.37, 1), (1.25, 2)):
        cuts = {r.of_source: r for r in mixing.cut_points(docs, F.lit("one"), share, {}, epochs, 17).collect()}
        got = mixing.mixed(docs, F.lit("one"), share, {}, epochs, epoch_column="epoch").collect()
        for source, each in {"a": 4, "b": 4, "c": 4, "d": 1}.items():
            own = [r for r in got if r.source == source]
            assert 0 <= each * len(own) - cuts[source].budget < each
            if source in "ab":
                assert len({(r.n, r.epoch) for r in own}) == len(own)


def test_a_hot_id_is_one_value(spark):
    """What is put in order of a leaf is values, not rows."""
    docs = spark.createDataFrame([(7, "w x y", "en", "a")] * 5000 + [(i, "w x y", "en", "a") for i in range(50)], "doc_id long, text string, lang string, source string")
    for share in (0.05, 0.5, 0.95):
        assert 0 <= 4 * mixing.mixed(docs, F.lit("one"), share).count() - share * 4 * 5050 < 5
