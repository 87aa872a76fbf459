import uuid
import zlib

import numpy as np
import pytest
from cases import no_documents, odd_documents, some_documents
from tokenizers import Tokenizer

from staffline.llm import token_files as files
from staffline.llm.queries import op3_token_files
from staffline.llm.tokens import Encoder, tokenizer_path
from staffline.session import shared_dir


def expected(texts):
    """In ascending order of the key, nulls first, equal keys by text."""
    library, at, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for key, text in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("kind", ["small", "wide", "outliers", "same"])
def test_blocks_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {
        "small": lambda: rng.integers(0, 50, n), "wide": lambda: rng.integers(0, 2**32, n), "same": lambda: np.full(n, 7),
        "outliers": lambda: np.where(rng.random(n) < 0.03, 2**32 - 1, rng.integers(100, 110, n)),
    }[kind]().astype(np.uint32)
    blocks = files.encode_blocks(ids)
    sizes = np.array([len(b) for b in blocks], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = b"".join(blocks)
    assert files.decode_blocks(data, starts).tolist() == ids.tolist()
    for i, start in enumerate(starts):
        assert files.decode_block(data, int(start)).tolist() == ids[i * files.BLOCK : (i + 1) * files.BLOCK].tolist()
    if kind == "outliers" and n == 5000:
        assert len(data) < n * 1.2


def test_query_against_the_library(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in some_documents(spark).collect()]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op3_token_files(spark, sf_dir).collect())
    assert got == [(k, s, n, zlib.crc32(raw)) for k, s, n, raw in expected(texts)]


def test_odd_cases_and_many_segments(spark, monkeypatch):
    docs = odd_documents(spark)
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    files.write_token_files(docs, path)
    rows = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in files.read_token_files(spark, path).collect()]
    assert sorted(rows, key=lambda r: r[1]) == expected([(r.doc_id, r.text) for r in docs.collect()])
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    files.write_token_files(no_documents(spark), path)
    assert files.read_token_files(spark, path).count() == 0


def test_damage_is_noticed():
    data = files.encode_segment([1], [np.arange(10, dtype=np.uint32)])
    assert files.decode_segment(data)[2].tolist() == list(range(10))
    with pytest.raises(ValueError):
        files.decode_segment(b"XXXX" + data[4:])


def test_ids_do_not_depend_on_what_came_before():
    """Added tokens are found before lower-casing; words that a weak hash would confuse."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    words = ["<|ENDOFTEXT|>", "<|endoftext|>", "x<|endoftext|>y", "X<|EndOfText|>Y", "x<|ENDOFTEXT|>y<|startoftext|>", "<|startoftext|>", "<|StartOfText|>", a, b, a.upper()]
    library = Tokenizer.from_file(tokenizer_path())
    for order in (words, words[::-1]):
        own = Encoder(tokenizer_path())
        for text in [*order, " ".join(order), " ".join(order[::-1])]:
            assert own.encode([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids
