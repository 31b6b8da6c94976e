from __future__ import annotations

import zlib

import duckdb
import pytest
from conftest import SF_DIR
from oracle import rows_of

import __spark_entry__
from changerisk.llm import ORACLES, QUERIES


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    relation = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(relation.columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_document(spark, name):
    got = QUERIES[name](spark, SF_DIR)
    ids = duckdb.sql(f"SELECT doc_id FROM '{SF_DIR}/documents.parquet'").fetchall()
    assert sorted({r["doc_id"] for r in got.collect()}) == sorted(i for i, in ids)


def test_contract_columns(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall())
    rows = QUERIES["op8_hilbert_shards"](spark, SF_DIR).collect()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "rows")
    assert all(r["round_trip"] for r in QUERIES["op10_sampled_segmentations"](
        spark, SF_DIR).collect())
    for name in ("op2_language_id", "op5_toxicity"):
        for r in QUERIES[name](spark, SF_DIR).collect():
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert 0 <= r["score"] <= 1
