import pytest
from sqlcheck import DATA, same

from turnmill.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, llm.queries()[name], llm.oracle_sql()[name])


COLUMNS = {
    "p1_found": ["row_id", "defect"], "p2_found": ["row_id", "turn_no", "speaker"], "p3_found": ["field", "row_id", "item_pos", "start_pos", "entity"],
    "p4_found": ["conversation_id", "defect"], "p5_found": ["row_a", "row_b"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_query_runs(spark, name):
    df = llm.queries()[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() == df.distinct().count() or name not in COLUMNS
