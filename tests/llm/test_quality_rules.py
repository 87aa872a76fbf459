import re
from collections import Counter

from cases import no_documents, odd_documents, some_documents

from staffline.llm import quality_rules as rules


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated), lines


def cell(value):
    low = max(len(bin(value)) - 2 - rules.SKETCH_BITS, 0)
    return value - value % 2**low


def brute(rows):
    """doc -> (counts, base_failed, kept), with the cut-offs of each language and source."""
    groups, out = {}, []
    for _, text, lang, source in rows:
        c = counted(text)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        shares = [10_000 * c[2] // max(c[1], 1), 10_000 * c[3] // max(c[5], 1), 10_000 * c[4] // max(c[0], 1)]
        out.append((c, failed, shares, (lang, source)))
        if not failed:
            groups.setdefault((lang, source), []).append(shares)
    limits = {}
    for key, members in groups.items():
        for i, name in enumerate(rules.SHARES):
            cells = sorted(cell(m[i]) for m in members)
            middle, high = (next(c for k, c in enumerate(cells) if 100 * (k + 1) >= q * len(cells)) for q in (50, rules.UPPER[name]))
            limits[key, i] = middle + rules.FENCE * max(high - middle, rules.LEAST[name])
    return [(c, failed, not failed and all(s[i] <= limits[key, i] for i in range(3))) for c, failed, s, key in out]


def test_counts_cutoffs_and_verdicts(spark):
    docs = some_documents(spark).unionByName(odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    with_counts = rules.with_counts(docs)
    judged = rules.judged(with_counts, rules.cutoffs(with_counts))
    got = [((*(r[c] for c in rules.COUNTS),), r.base_failed, r.kept) for r in judged.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_a_noisy_source_widens_its_own_limits_only(spark):
    import random

    rng = random.Random(1)
    text = lambda noise: " ".join(f"w{rng.random()}" + "#" * 8 * (rng.random() < noise) for _ in range(80))
    rows = [(i, text(0.5 * (i % 2)), "en", f"s{i % 2}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counts = rules.with_counts(docs)
    limits = {r.source: r.max_symbol_share for r in rules.cutoffs(counts).collect()}
    assert limits["s0"] == rules.FENCE * rules.LEAST["symbol_share"] < limits["s1"]


def test_accepted_keeps_columns_and_takes_odd_cases(spark):
    docs = odd_documents(spark)
    out = rules.accepted(docs)
    assert out.schema == docs.schema
    assert [r.doc_id for r in out.collect()] == [6]
    assert rules.accepted(no_documents(spark)).count() == 0
