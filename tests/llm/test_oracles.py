import pytest
from compare import compare, duck

from staffline.llm.oracles import ORACLES
from staffline.llm.queries import QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(spark, duck(sf_dir), sf_dir, QUERIES[name], ORACLES[name]) is None
