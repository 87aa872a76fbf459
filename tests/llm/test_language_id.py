import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import no_documents, odd_documents, some_documents
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from staffline.llm import language_id


def plain_grams(text, buckets):
    """Buckets of the n-grams of a text, word by word."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    out = []
    marked = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    for word in marked.split():
        edged = f" {word} "
        for size in language_id.SIZES:
            for at in range(len(edged) - size + 1):
                gram = edged[at : at + size]
                if gram.strip():
                    key = 0
                    for c in gram:
                        key = (key * 0x9E3779B97F4A7C15 + ord(c)) & mask
                    out.append(mix((key + size) & mask) & (buckets - 1))
    return out


def plain_model(rows, buckets):
    counts, documents = {}, Counter()
    for lang, text in rows:
        documents[lang] += 1
        counts.setdefault(lang, Counter()).update(plain_grams(text or "", buckets))
    return counts, documents


def plain_prediction(model, text, buckets):
    counts, documents = model
    own = Counter(plain_grams(text or "", buckets))
    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return "und", 0.0
    values = {}
    for lang, n in counts.items():
        total = sum(n.values()) + language_id.SMOOTHING * buckets
        values[lang] = math.log(documents[lang] / sum(documents.values())) + sum(
            k * math.log((n[g] + language_id.SMOOTHING) / total) for g, k in own.items())
    top = max(values.values())
    best = min(k for k, v in values.items() if v == top)
    return best, 1 / sum(math.exp(v - top) for v in values.values())


def random_texts(n, seed):
    rng = random.Random(seed)
    sounds = {"en": ["th", "ing", "wh", "e"], "de": ["sch", "ü", "ung", "e"], "": ["ñ", "ción", "a", "İ"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(sounds))
        words = ["".join(rng.choices(sounds[rng.choice([lang, "en"])], k=rng.randint(1, 4))) for _ in range(rng.randint(0, 12))]
        text = "".join(w.capitalize() + rng.choice([" ", "-", "'", ", ", "\n", " 12 ", "́ ", "\U0001f600"]) for w in words)
        rows.append((i, rng.choice([text] * 9 + [None]), rng.choice([lang] * 5 + [None])))
    return rows


def test_same_as_plain_bayes(spark):
    rows = random_texts(400, 5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)
    model = language_id.train(docs, F.col("doc_id") % 3 != 1)
    buckets = model.matrix.shape[1]
    plain = plain_model([(lang, t) for i, t, lang in rows if i % 3 != 1 and lang is not None], buckets)
    assert set(model.languages) == set(plain[0])
    got = {r.doc_id: r for r in language_id.predicted(docs, model).collect()}
    for i, text, _ in rows:
        lang, score = plain_prediction(plain, text, buckets)
        assert got[i].lang_pred == lang
        assert got[i].score == pytest.approx(score, rel=1e-3, abs=1e-9)


def test_rows_dealt_otherwise_give_the_same(spark):
    docs = spark.createDataFrame(random_texts(200, 8), "doc_id bigint, text string, lang string")
    one, many = (language_id.train(docs.repartition(n), F.lit(True)) for n in (1, 9))
    assert one.languages == many.languages and np.array_equal(one.matrix, many.matrix) and np.array_equal(one.prior, many.prior)
    texts = [r.text or "" for r in docs.collect()]
    whole = one.predict(texts)[1].tolist()
    assert whole == [one.predict([t])[1][0] for t in texts]


def test_query_on_held_out_documents(spark, sf_dir):
    found = {r.doc_id: r for r in entry_point.queries()["op11_language"](spark, sf_dir).collect()}
    docs = some_documents(spark).collect()
    assert len(found) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 == 1]
    assert {d.doc_id for d in held} == {i for i, r in found.items() if r.held_out}
    with_letters = [d for d in held if re.search(r"[^\W\d_]", d.text or "")]
    assert sum(found[d.doc_id].lang_pred == d.lang for d in with_letters) >= 0.97 * len(with_letters)


def test_odd_and_empty_tables(spark):
    model = language_id.train(odd_documents(spark), F.col("doc_id") > 0)
    found = language_id.predicted(odd_documents(spark), model).collect()
    assert len(found) == odd_documents(spark).count()
    assert {(r.lang_pred, r.score) for r in found if r.doc_id in (3, 4, 5)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in found)
    nothing = language_id.train(no_documents(spark), F.lit(True))
    assert {r.lang_pred for r in language_id.predicted(odd_documents(spark), nothing).collect()} == {"und"}
    assert language_id.predicted(no_documents(spark), model).collect() == []


def test_buckets_follow_the_number_of_languages():
    assert language_id.buckets_for(4) == language_id.MAX_BUCKETS
    for n in (1000, 20_000):
        assert 8 * n * language_id.buckets_for(n) <= language_id.MODEL_BYTES
    with pytest.raises(ValueError):
        language_id.buckets_for(10_000_000)
