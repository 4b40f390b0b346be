"""Lines of documents made as JSON are dealt by document as they are, before they are gathered."""

import re

from tallyforge.plans import document_queries as dq

SF = "/root/testdata/sf0.001"


def gathered(df):
    """What the lines are gathered from, in the plan as it is run."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"Aggregate \[document_id.*?\n[ :+-]*(\w+) ", plan)[-1], plan


def test_documents_deal_lines_first(spark):
    below, plan = gathered(dq.canonical_documents(spark, SF))
    assert below == "RepartitionByExpression" and plan.count("RepartitionByExpression") == 1


def test_references_deal_lines_first(spark):
    below, plan = gathered(dq.canonical_references(spark, SF))
    assert below == "RepartitionByExpression" and plan.count("RepartitionByExpression") == 1
