"""The native operators' plans hold no Python, and no operator crosses tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from furrow.llm import mixing, quality_rules, secrets, simhash
from furrow.llm.queries import QUERIES
from tests.conftest import SF
from tests.test_plans import plan


@pytest.mark.parametrize("name", ["op1_quality_rules", "op4_secrets", "op8_mixing"])
def test_native_queries_hold_no_python(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(QUERIES[name](spark, SF)))


def test_native_parts_before_their_checkpoints_hold_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = secrets.train(secrets.labelled_findings(spark, 400), trees=3)
    for df in (quality_rules.features(docs), mixing.training_rows(docs), secrets.redact(docs, trees), secrets.labelled_findings(spark)):
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan(df))


def test_scans_of_narrow_queries_leave_out_what_they_need_not(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(docs.select("doc_id", simhash.fingerprint("text").alias("f")).where(F.col("f") != 0))
    assert "lang" not in re.search(r"ReadSchema: (\S+)", text)[1]
