import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from compare import compare, duck

import __spark_entry__ as entry_point

QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()
REFERENCE = list(entry_point.QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_a_counterpart():
    assert set(REFERENCE) <= set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", REFERENCE)
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) is None


def test_clean_strings_matches_sql_on_odd_cells(spark, tmp_path):
    """Texts that clean to null, languages that need cleaning, negative and null ids."""
    texts = ["", " \t\n", "\u3000", "nan", " nan ", "None", "NULL", " a ", "\x00 a\x00", "\u200b a", None]
    langs = ["en", " en", "", "nan", " None ", "\u00a0", None]
    ids = [*range(-12, 12), None]
    rows = [{"doc_id": k, "text": text, "lang": lang} for k in ids for text in texts for lang in langs]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())])
    pq.write_table(pa.Table.from_pylist(rows, schema), tmp_path / "documents.parquet")
    query, sql = QUERIES["clean_strings"], ORACLES["clean_strings"]
    assert compare(spark, duck(tmp_path), str(tmp_path), query, sql) is None


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
