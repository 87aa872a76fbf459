import random
import re
from itertools import permutations

from cases import no_documents, odd_documents, some_documents

from staffline.llm import filter_audit

LABELS = "doc_id bigint, quality int, toxic int, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """Every order of every part, filter by filter, document by document."""
    rows = []
    for d in docs:
        t = d["text"] or ""
        words = WORD.findall(t)
        copy = d["doc_id"] is not None and any(
            (o["text"] or "") == t and o["doc_id"] is not None and o["doc_id"] < d["doc_id"] for o in docs)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy,
        }
        own = [x for x in labels if x[0] is not None and x[0] == d["doc_id"]]
        rows.append((d["lang"] or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for at, f in enumerate(order, 1):
                lost = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(lost)
                steps.append((
                    "".join(order), at, f, len(left), len(lost), sum(r[1][f] for r in own) - len(lost),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in lost), sum(r[3] for r in lost)))
        out += [(part, o, at, *x, shapley[f]) for o, at, f, *x in steps]
    return sorted(out)


def found(docs, labels):
    return sorted(map(tuple, filter_audit.audit(docs, labels).collect()))


def test_random_documents(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choices(["the", "a", "B", "x1", "LONG", "#tag", "50%", "é"] + [f"w{i}" for i in range(300)], k=rng.choice([0, 5, 150, 210, 260]))) for _ in range(40)]
    pool += ["word " * 250, "UPPER " + "lower " * 230, None, ""]
    rows = [(rng.choice([None, *range(120)]), rng.choice(pool), rng.choice(["en", "de", "", None])) for _ in range(300)]
    labels = [(rng.choice([None, *range(130)]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for _ in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    expected = brute([r.asDict() for r in docs.collect()], labels)
    assert len(expected) == 3 * 600
    assert found(docs, spark.createDataFrame(labels, LABELS)) == expected


def test_odd_documents(spark):
    labels = [(1, 1, 0, "a"), (1, 0, 1, "b"), (2, 1, None, None), (None, 1, 1, None), (999, 1, 1, "z")]
    docs = odd_documents(spark).drop("kept").withColumnsRenamed({"n_words": "mask", "tokens": "digest", "component_id": "part"})
    expected = brute([r.asDict() for r in docs.collect()], labels)
    assert found(docs, spark.createDataFrame(labels, LABELS)) == expected


def test_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert found(no_documents(spark), labels) == []
    assert len(found(some_documents(spark), labels)) == 600 * some_documents(spark).select("lang").distinct().count()


def test_many_copies_and_null_ids(spark):
    """A third of all rows share a text, another third have no id."""
    rows = [(i, "one text of all", "en") for i in range(500)] + [(None, f"no id {i % 7}", "de") for i in range(500)]
    rows += [(1000 + i, f"own {i}", None) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(7)
    cells = {(r.part, r["mask"]): r.n for r in filter_audit.cells(docs, spark.createDataFrame([(3, 1, 1, "x")], LABELS)).where("n > 0").collect()}
    assert cells == {("en", 1): 1, ("en", 17): 499, ("de", 1): 500, ("", 1): 500}
