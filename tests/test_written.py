from __future__ import annotations

from changerisk.workload import verdicts


def test_only_the_table_that_is_read_is_written(spark, monkeypatch):
    """Parts and statements are two long jobs; a query that reads one waits for that one."""
    cuts = []
    cut = verdicts.cut_lineage
    monkeypatch.setattr(verdicts, "cut_lineage", lambda df: cuts.append(df.columns) or cut(df))
    monkeypatch.setattr(verdicts, "_WRITTEN", {})
    assessed = verdicts.written(spark, "/root/testdata/sf0.001", False)
    assert cuts == []
    parts = assessed.parts
    assert len(cuts) == 1 and parts.columns == verdicts._PART_COLUMNS
    assert assessed.parts is parts and len(cuts) == 1
    assert assessed.statements.count() > 0 and len(cuts) == 2


def test_parts_carry_only_the_size_of_the_facts(spark):
    """All the columns, indexes and constraints of a relation were copied into every part."""
    parts = verdicts.online(spark, "/root/testdata/sf0.001").parts
    assert parts.schema["facts"].dataType.fieldNames() == ["size_bytes"]
