import os

import pytest

from foliora.llm.queries import QUERIES
from foliora.llm.sql import SQL
from tests import compare

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.DATA), reason="no test tables")

COLUMNS = {
    "p1_found": ["doc_id", "markup"], "p2_found": ["page_doc_id", "line_no", "noise"], "p3_found": ["doc_id", "end_char"], "p4_found": ["answer_id", "defect"], "p5_found": ["query_id", "id"],
    "p6_found": ["kind", "key_a", "key_b"], "p7_found": ["item_table", "item_key"], "p8_ids": ["doc_id", "ids"], "p9_found": ["recipe_id", "source"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    compare.same(spark, compare.connection(), QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_queries_run_with_the_stated_columns(spark, name):
    df = QUERIES[name](spark, compare.DATA)
    assert df.columns == COLUMNS.get(name, df.columns) and df.distinct().count() == df.count() > 0
