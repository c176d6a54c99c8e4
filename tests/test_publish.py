import datetime as dt
import os
import shutil

import pytest
from fathomite.sources import files
from pyspark.sql import functions as F


def facts(spark, *rows):
    made = [(f"{d}-{i}", "c", "a", d, "s", "x", "t", None, float(v), None, None, dt.date(2024, 1, 1), 0.9) for d, i, v in rows]
    return spark.createDataFrame(made, files.FACT_SCHEMA)


def values(spark, path):
    return sorted((r.source_document or "", r.fact_id, r.value) for r in files.published_facts(spark, path).collect())


def test_whole_documents_or_nothing(spark, tmp_path):
    path = str(tmp_path / "facts")
    files.publish_facts(facts(spark, ("a", 1, 1), ("a", 2, 2), ("b", 1, 5), (None, 1, 7)), path)
    first = values(spark, path)
    assert first == [("", "None-1", 7.0), ("a", "a-1", 1.0), ("a", "a-2", 2.0), ("b", "b-1", 5.0)]
    # A writer that dies between two files: "a" is staged, "c" is not.
    both = facts(spark, ("a", 1, 9)).unionByName(facts(spark, ("c", 1, 9)).withColumn("claim", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception):
        files.publish_facts(both, path)
    # One that dies after its files and before the manifest.
    good = files.publish_facts(facts(spark, ("z", 1, 1)), str(tmp_path / "other"))
    shutil.copytree(tmp_path / "other" / "data" / f"version={good}", tmp_path / "facts" / "data" / f"version={good}")
    assert values(spark, path) == first
    assert {r.document for r in files.published_documents(spark, path).collect()} == {None, "a", "b"}


def test_a_document_that_comes_again_is_replaced(spark, tmp_path):
    path = str(tmp_path / "facts")
    files.publish_facts(facts(spark, ("a", 1, 1), ("a", 2, 2), ("b", 1, 5)), path)
    files.publish_facts(facts(spark, ("a", 3, 3), ("c", 1, 4)), path)
    assert values(spark, path) == [("a", "a-3", 3.0), ("b", "b-1", 5.0), ("c", "c-1", 4.0)]
    wanted = spark.createDataFrame([("a",), ("d",)], "document string")
    assert [r.document for r in files.pending(wanted, files.published_documents(spark, path), "document").collect()] == ["d"]


def test_lost_rows_are_noticed(spark, tmp_path):
    path = str(tmp_path / "facts")
    version = files.publish_facts(facts(spark, ("a", 1, 1), ("b", 1, 5)), path)
    assert files.incomplete_documents(spark, path).count() == 0
    folder = tmp_path / "facts" / "data" / f"version={version}" / "document=b"
    for name in os.listdir(folder):
        os.remove(folder / name)
    assert [tuple(r) for r in files.incomplete_documents(spark, path).collect()] == [("b", 1, 0)]
