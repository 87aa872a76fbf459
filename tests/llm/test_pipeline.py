from collections import defaultdict

import corpus_pipeline
from cases import no_documents, odd_documents, some_documents
from test_mixing import brute as mixed_by_hand
from test_near_copies import brute as groups_by_hand
from test_quality_rules import brute as judged_by_hand
from test_secrets import base_spans

from staffline.llm.packing import END_ID
from staffline.llm.queries import MIX
from staffline.llm.tokens import encoder, tokenizer_path


def redacted(text):
    spans = sorted((s, e) for s, _, _, e in base_spans(text))
    out, at = "", 0
    for start, end in spans:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def by_hand(rows):
    """doc_id -> text of what reaches the packing, from (doc_id, text, lang, source)."""
    rows = [r for r, (_, _, kept) in zip(rows, judged_by_hand(rows), strict=True) if kept]
    groups = groups_by_hand([r[:2] for r in rows])
    rows = [(r[0], redacted(r[1]), *r[2:]) for r in rows if groups[r[0]][2]]
    leaves = [(i, t, f"domain{int(source.removeprefix('src')) // 5}", lang, source) for i, t, lang, source in rows]
    chosen = {i for i, _ in mixed_by_hand(leaves, corpus_pipeline.MIX_SHARE, MIX, 1, 17)}
    return {r[0]: r[1] for r in rows if r[0] in chosen}


def test_rows_against_each_stage_by_hand(spark, sf_dir):
    rows = [tuple(r) for r in some_documents(spark).select("doc_id", "text", "lang", "source").collect()]
    texts = by_hand(rows)
    tokens = defaultdict(int)
    ends = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        tokens[r.doc_id] += r.length
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
    own = encoder(tokenizer_path())
    assert dict(tokens) == {i: len(own.encode([t.encode()])[0]) + 1 for i, t in texts.items()}
    assert END_ID == 1 and len(corpus_pipeline.STAGES) == 5
    for places in ends.values():
        places.sort()
        assert places[0][0] == 0 and places[-1][1] <= 4096
        assert all(a[1] == b[0] for a, b in zip(places, places[1:]))


def test_stages_keep_the_columns_and_take_odd_cases(spark, sf_dir):
    for docs in (odd_documents(spark), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()
