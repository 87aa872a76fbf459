import hashlib
import random
import re
import uuid

from cases import no_documents, odd_documents, some_documents

from staffline.llm import secret_scan as scan
from staffline.llm.queries import op7_secrets
from staffline.session import shared_dir


def base_spans(text):
    """The base kinds, spelled out."""
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_query_against_plain_expressions(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in some_documents(spark).collect()}
    got = op7_secrets(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = base_spans(texts[r.doc_id])
        kinds = [s[2] for s in spans]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, ("assign", "access", "hex")))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest()


def test_matches_that_are_too_short_still_take_their_place():
    pieces = ["token", "secret", "=", ": ", "'", '"', "AKIA", "ABCDEF0123456789", "deadbeef" * 5, "abc", " ", "é", "API_KEY", "Passwd", "KEY", "ſecret"]
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        found = sorted((s, rank, r.kind, e) for rank, r in enumerate(scan.BASE_RULES) for s, e in scan.find(r, text))
        assert found == base_spans(text)


def test_the_ledger_is_scanned_once(spark, monkeypatch):
    ledger = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = make([(1, "token=aaaaaaaaaa"), (2, "token=aaaaaaaaaa"), (3, "nothing")])
    assert [len(r.found) for r in scan.findings(first, ledger, scan.BASE_RULES).orderBy("doc_id").collect()] == [1, 1, 0]
    n = spark.read.parquet(ledger).count()
    assert n == 2 * len(scan.BASE_RULES)
    # Two versions of document 1, one of them known; only the new text is scanned.
    later = make([(1, "token=aaaaaaaaaa"), (1, "secret=bbbbbbbbbb token=cccccccccc")])
    assert sorted(len(r.found) for r in scan.findings(later, ledger, scan.BASE_RULES).collect()) == [1, 2]
    assert spark.read.parquet(ledger).count() == n + len(scan.BASE_RULES)
    # A changed rule is applied to all texts asked for, the others to none.
    hexadecimal = scan.Rule("hex", 2, "[0-9a-f]{40,}", 0, 40)
    scan.findings(later, ledger, (*scan.BASE_RULES[:2], hexadecimal)).count()
    added = spark.read.parquet(ledger).where("kind = 'hex' and version = 2")
    assert added.count() == 2 and spark.read.parquet(ledger).count() == n + len(scan.BASE_RULES) + 2


def test_redaction_and_odd_cases(spark):
    docs = odd_documents(spark)
    out = scan.redacted(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[10] == "[SECRET] twice [SECRET]" and texts[3] is None and texts[4] == ""
    assert texts[1] == "The same little text. " * 20
    nested = spark.createDataFrame([(1, "é x password=deadbeefdeadbeefdeadbeefdeadbeef y")], "doc_id long, text string")
    assert scan.redacted(nested).first().text == "é x [SECRET] y"
    assert scan.redacted(no_documents(spark)).count() == 0
    assert scan.findings(no_documents(spark)).count() == 0


def test_repeated_and_null_ids_are_scanned_once(spark):
    """A thousand rows of one id, and of none, with two texts."""
    ledger = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    rows = [(i, f"token=aaaaaaaaa{n % 2}") for i in (1, None) for n in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = scan.findings(docs, ledger, scan.BASE_RULES)
    assert found.count() == 2000 and found.where("size(found) = 1").count() == 2000
    assert spark.read.parquet(ledger).count() == 2 * len(scan.BASE_RULES)


def test_touching_spans_are_one(spark):
    both = "AKIA" + "A" * 16 + "0123456789abcdef" * 2
    texts = {f"x {both} y {both}": "x [SECRET] y [SECRET]", both: "[SECRET]", "0" * 32 + " é": "[SECRET] é"}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.text for r in scan.redacted(docs).orderBy("doc_id").collect()] == list(texts.values())
