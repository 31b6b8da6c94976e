from __future__ import annotations

from changerisk.operators import order
from changerisk.workload import adapters


def test_scans_do_not_carry_the_attributes(spark):
    """Only the chain mark of them is read; the whole map made the sorted rows several times wider."""
    statements = adapters.statements(spark, "/root/testdata/sf0.001")
    summary = order.transaction_summary(order.transaction_groups(statements))
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert "__chained" in plan and "attrs" not in plan.split("Join", 1)[0]
