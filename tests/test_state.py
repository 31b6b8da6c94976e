"""Statement order: file state, renames and transactions on literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from changerisk.operators import order
from changerisk.schemas import STATEMENTS


def script(spark, rows, file_id="f"):
    """Statements from ``(kind, targets, extra)``; extra sets further columns."""
    out = []
    for idx, (kind, targets, extra) in enumerate(rows):
        out.append({"file_id": file_id, "idx": idx, "inner_pos": 0, "kind": kind,
                    "targets": targets, "attrs": {}, **extra})
    return spark.createDataFrame(out, STATEMENTS)


FROM_QUERY, FROM_VALUES = {"attrs": {"source": "select"}}, {"attrs": {"source": "values"}}
FILES = {
    "load": [("create_table", ["app.a"], {}), ("insert", ["a"], FROM_VALUES),
             ("insert", ["a"], FROM_QUERY), ("drop_table", ["a"], {}),
             ("insert", ["a"], FROM_QUERY), ("select", [], {})],
    "chain": [("create_table", ["a"], {}), ("rename_table", ["a"], {"new_name": "b"}),
              ("copy_from", ["b"], {}), ("rename_table", ["b"], {"new_name": "c"}),
              ("rename_table", ["c"], {"new_name": "a"}), ("select", [], {})],
    "foreign": [("create_table", ["b"], {}), ("rename_table", ["x"], {"new_name": "b"}),
                ("select", [], {})],
}


def test_created_state_through_loads_drops_and_renames(spark):
    statements = None
    for file_id, rows in FILES.items():
        part = script(spark, rows, file_id)
        statements = part if statements is None else statements.unionByName(part)
    asked = statements.select("file_id", "idx", "inner_pos", F.explode(
        F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("name"))
    found: dict = {}
    for r in order.created_state(statements, asked).orderBy("idx").collect():
        found.setdefault((r["file_id"], r["name"]), []).append(r["state"])
    assert found["load", "a"] == [None, "clean", "clean", "loaded", None, None]
    assert found["chain", "a"] == [None, "clean", None, None, None, "loaded"]
    assert found["chain", "b"] == [None, None, "clean", "loaded", None, None]
    assert found["chain", "c"] == [None, None, None, None, "loaded", None]
    # renaming something the file did not create leaves the new name as it was
    assert found["foreign", "b"] == [None, "clean", "clean"]


def test_chain_reopens_only_from_inside(spark):
    yes = {"attrs": {"chain": "true"}}
    s = script(spark, [
        ("commit", [], yes), ("select", [], {}), ("begin", [], {}), ("select", [], {}),
        ("begin", [], {}), ("commit", [], yes), ("select", [], {}), ("rollback", [], {}),
        ("select", [], {})])
    grouped = order.transaction_groups(s)
    warnings = {r["idx"]: r["warning"] for r in grouped.filter("warning IS NOT NULL").collect()}
    assert warnings == {0: "no block to close", 4: "begin inside an open block"}
    explicit = [r["idx"] for r in grouped.filter("explicit").orderBy("idx").collect()]
    assert explicit == [3, 6]
    summary = {r["group_no"]: r for r in order.transaction_summary(grouped).collect()}
    assert summary[1]["opened_by"] == 2 and summary[1]["closed_by"] == 5
    assert summary[2]["opened_by"] == 5 and summary[2]["rolled_back"]
    state = order.transaction_state(s)
    assert [r["idx"] for r in state.filter("explicit").orderBy("idx").collect()] == [3, 6]


def test_large_self_contained_file_is_a_baseline(spark):
    rows = [("create_table", [f"t{i}"], {}) for i in range(30)]
    rows += [("create_index", [f"t{i % 30}"], {"index_name": f"i{i}"}) for i in range(30)]
    rows += [("drop_index", ["i3"], {"missing_ok": False})]
    assert order.baseline_files(script(spark, rows)).first()["baseline"]
    assert not order.baseline_files(script(spark, rows[:49])).first()["baseline"]
    foreign = [*rows, ("update", ["elsewhere"], {})]
    assert not order.baseline_files(script(spark, foreign)).first()["baseline"]
