from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from changerisk.llm import hilbert


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2), (2, 1)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = hilbert.curve_places(list(cells.T), bits)
    assert sorted(place) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def shard(docs, n=24):
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return hilbert.shard(docs, {"lang": hilbert.category(F.col("lang"), 5),
                                "size": hilbert.octave(size)}, n, bits=5,
                         tie=[F.col("doc_id")], carry=[F.col("doc_id"), F.col("lang"),
                                                       size.alias("size")])


@pytest.mark.parametrize("rows", [1, 23, 24, 25, 1000])
def test_equal_counts(spark, rows):
    docs = spark.range(rows).select(
        F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id * id % 700 as int))").alias("text"),
        F.when(F.col("id") % 3 > 0, "en").otherwise((F.col("id") % 5).cast("string")).alias("lang"))
    got = shard(docs).collect()
    counts = {}
    for r in got:
        counts.setdefault(r["shard"], []).append(r["slot"])
    full = [len(counts.get(s, [])) for s in range(24)]
    assert sum(full) == rows and max(full) - min(full) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    order = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    assert sorted(got) == sorted(shard(docs.repartition(5)).collect())


def test_odd_rows(odd_docs, no_docs):
    assert shard(odd_docs.withColumn("curve", F.lit(1))).count() == odd_docs.count()
    assert shard(no_docs).count() == 0


def test_files(spark, tmp_path, odd_docs):
    out = shard(odd_docs, 3)
    hilbert.write_shards(out, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == odd_docs.count()
    ranges = hilbert.manifest(out, ["size"]).collect()
    assert sum(r["rows"] for r in ranges) == odd_docs.count()


def test_names_the_input_has(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6)], "doc_id long, curve long")
    got = hilbert.shard(rows, {"a": F.col("doc_id")}, 2, tie=[F.col("doc_id")],
                        carry=[F.col("doc_id"), F.col("curve")])
    assert got.columns == ["doc_id", "curve", "curve_1", "shard", "slot"]
    assert {r["curve"] for r in got.collect()} == {5, 6}
