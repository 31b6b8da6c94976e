from __future__ import annotations

from conftest import SF_DIR
from pyspark.sql import functions as F

from changerisk.streaming import jobs
from changerisk.workload import QUERIES


def test_a_table_may_be_a_folder_of_part_files(spark, tmp_path):
    """At larger sizes tables are folders, and their part files have names of their own."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["continuous_assessment"](spark, str(tmp_path)).collect()
    want = QUERIES["continuous_assessment"](spark, SF_DIR).collect()
    assert sorted(got) == sorted(want)
    assert {r["statements"] for r in got} == {docs.count()}


def test_lock_samples_of_a_folder(spark, tmp_path):
    spark.read.parquet(f"{SF_DIR}/events.parquet").repartition(2).write.parquet(
        f"{tmp_path}/events.parquet")
    got = QUERIES["stall_stream"](spark, str(tmp_path)).collect()
    assert sorted(got) == sorted(QUERIES["stall_stream"](spark, SF_DIR).collect())


def test_no_batch_gives_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    scripts = spark.readStream.schema("file_id string, source string").parquet(f"{tmp_path}/in")
    got = jobs.assess_stream(scripts, f"{tmp_path}/out", pg_version=17)
    assert got.where(F.col("file_id").isNotNull()).count() == got.count() == 0
