import random
import zlib

import numpy as np
import pytest
from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from staffline.llm import toxicity as t
from staffline.llm.queries import in_fold, op10_toxicity
from staffline.llm.words import buffers


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("states", [200_000, 50])
def test_the_automaton_is_the_edit_distance(monkeypatch, states):
    monkeypatch.setattr(t, "STATES", states)
    rng = random.Random(2)
    terms = ["abba", "abbac", "abcabca", "bacabacab", "cabbagebaba", "ccccc", "abcabcabcabc"]
    lexicon = t.FuzzyLexicon(terms)
    for _ in range(6000):
        word = "".join(rng.choice("abcg") for _ in range(rng.randint(0, 13)))
        if rng.random() < 0.5:
            word = list(rng.choice(terms))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(word) + 1)
                word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "g"])
            word = "".join(word)
        want = [d for term in terms if word[:1] == term[0] and (d := distance(word[1:], term[1:])) <= t.edits_for(term)]
        assert lexicon.edits(word) == min(want, default=-1), word


def test_edits_from_the_first_letter_on_and_marks_for_letters():
    lexicon = t.lexicon_of(("asshole", "idiot", "scum", "stupid", "worthless"), ("tupi", "closer"))
    words = "1diot diot xstupid tsupid $tupid @sshole ($tup1d) idi0t, $cum worthle$$ aworthles orthles stupid! 100 $5 tupi scam".split()
    got = [lexicon.spelled(w) for w in words]
    assert got == [1, 1, 1, -1, 1, 1, 1, 1, 1, 1, 2, 2, 0, -1, -1, -1, -1]
    rng, terms = random.Random(4), ("abbac", "abcabca", "cabbagebaba", "abba")
    lexicon = t.lexicon_of(terms)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.choice((0, rng.randrange(len(word) + 1)))
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "g"])
        want = [d for term in terms if (d := distance("".join(word), term)) <= t.edits_for(term)]
        assert lexicon.edits("".join(word)) == min(want, default=-1), word


def test_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = op10_toxicity(spark, sf_dir).toPandas()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.toxic).mean() > 0.93
    assert both[both.toxic == 1].predicted.mean() > 0.6
    assert both[both.toxic == 0].predicted.mean() < 0.02


def test_held_out_labels_change_nothing(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(in_fold(4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (t.train(docs, x, "toxic", ~in_fold(4, 2)) for x in (labels, flipped))
    assert a.terms == b.terms and np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_context_and_misspellings():
    lexicon = t.FuzzyLexicon(["stupid", "worthless"])
    texts = ["You are stupid!", "stupidd person", "a worhtless thing", 'he said the word "stupid" was used', "fine words only", ""]
    rows = np.concatenate([t.features(w, lexicon) for _, w in buffers([x.encode() for x in texts], lower=True)])
    named = [dict(zip(t.FEATURES, r > 0)) for r in rows]
    assert named[0]["exact"] and named[0]["addressed"] and not named[0]["quoted"]
    assert named[1]["one_edit"] and named[2]["two_edits"]
    assert named[3]["quoted"] and not named[3]["exact"]
    assert not rows[4].any() and not rows[5].any()
    scores = t.Model(("stupid",)).scores(rows)
    assert scores[0] > 0.5 > scores[3] and scores[4] == scores[5] < 0.2


def test_words_that_only_toxic_texts_hold_are_learnt(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = [f"w{rng.randint(0, 400):04d}" for _ in range(40)]
        if i % 8 == 0:
            words.insert(5, "Grumfeld,")
        rows.append((" ".join(words), int(i % 8 == 0)))
    rows += [("grumfend is a word of clean texts", 0)] * 2
    terms, exceptions = t.learn_terms(spark.createDataFrame(rows, "text string, toxic int"))
    assert exceptions == ("grumfend",)
    assert set(terms) - set(t.SEEDS) == {"grumfeld", "grum*", "grumf*", "grumfe*"}
    copies = spark.createDataFrame([(i, rows[i % 5][0] + f" end{i // 5 % 2}", 0) for i in range(50)] + [(60, "", 0), (61, None, 0)], "doc_id long, text string, toxic int")
    assert 5 <= t.without_copies(copies).count() <= 9
    lexicon = t.FuzzyLexicon(["grumf*", "worthless"])
    assert [lexicon.edits(w) for w in ("grumfling", "grumf", "grunfling", "worthles", "grum")] == [0, 0, -1, 1, -1]


def test_only_copies_are_taken_for_copies(spark):
    """Whatever the batches; a shared passage makes no copy, nor does a text too short for a window."""
    passage = " ".join(f"p{k}" for k in range(24))
    rows = [(i, passage + "".join(f" w{i}x{k}" for k in range(100)), 0) for i in range(60)]
    rows += [(100 + i, f"two words{i}", 0) for i in range(60)] + [(200 + i, rows[0][1], 0) for i in range(9)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert t.without_copies(sample.repartition(30)).count() == t.without_copies(sample.coalesce(1)).count() == 120


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1), (6, 0), (None, 1), (5, None), (99, 0)]])
def test_odd_cases(spark, labels):
    docs = odd_documents(spark)
    model = t.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", F.lit(True))
    got = t.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert t.scored(no_documents(spark), model).count() == 0
