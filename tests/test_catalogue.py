"""Every query with SQL gives the SQL's rows; the others give rows."""

import os

import pytest

from loomwell.plans.catalogue import ORACLE_SQL, QUERIES
from tests.harness import same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        same(df, ORACLE_SQL[name], SF)
    else:
        assert df.count() > 0


def test_conversations_go_whole_through_the_assembly(spark):
    turns = sorted(spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect())
    for r in QUERIES["tool_call_assembly_whole"](spark, SF).collect():
        assert r.arguments == "".join(t.text for t in turns if t.conv_id == r.call_id and t.text is not None)
    for r in QUERIES["faq_document_whole"](spark, SF).collect():
        assert r.document == "\n".join("Q: " + t.text for t in turns if (t.conv_id, t.role) == (r.conv_id, "user") and t.text is not None)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() == 1
