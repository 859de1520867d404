"""The join-based Q/A pairs equal the window (lead) definition of FIXTURES.md."""

from conftest import SF_MID
from ragtab.plans.oracle import VIEWS
from ragtab.plans.views import Tables


def test_qa_pairs_join_equals_lead_definition(spark):
    t = Tables(spark, SF_MID, materialize=False)
    t.table("conversations").createOrReplaceTempView("conversations")
    lead = spark.sql(VIEWS["qa_pairs"].replace("FROM conversations) t", "FROM conversations) t0"))
    ours = t.qa_pairs()
    assert sorted(map(tuple, lead.collect())) == sorted(map(tuple, ours.select("id", "question", "response").collect()))
