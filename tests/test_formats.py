import pytest
from fathomite.sources import formats
from pyspark.sql import functions as F


@pytest.fixture
def landed(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "deep").mkdir()
    for name, data in {"b.txt": b"two \xc3\xa9", "deep/a.txt": b"one", "bad.txt": b"\xff\xfe", "empty.txt": b"", "_SUCCESS": b"", "x.pdf": b"%"}.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_texts_and_a_file_that_is_none(spark, landed):
    rows = {r.stem: r for r in spark.read.format("landed_texts").option("pattern", "*.txt").load(landed).collect()}
    assert set(rows) == {"a", "b", "bad", "empty"}
    assert (rows["a"].text, rows["b"].text, rows["empty"].text) == ("one", "two é", "") and rows["b"].error is None
    assert rows["bad"].text is None and rows["bad"].error.startswith("UnicodeDecodeError") and rows["bad"].length == 2
    uri = spark.read.format("landed_texts").load(f"file://{landed}/b.txt")
    assert uri.select("text").first().text == "two é" and rows["b"].modified is not None


def test_only_the_columns_asked_for_are_read(spark, landed):
    few = spark.read.schema("stem string, length bigint").format("landed_texts").load(landed)
    assert few.columns == ["stem", "length"] and few.filter("stem = 'b'").first().length == 6
    opened = []

    class Told(formats.TextReader):
        def parsed(self, data):
            opened.append(data)
            return super().parsed(data)

    for names, n in (("stem string, length bigint", 0), ("stem string, text string", 1)):
        reader = Told({"path": f"{landed}/deep"}, spark.createDataFrame([], names).schema, ["text", "error"])
        assert len([r for p in reader.partitions() for r in reader.read(p)]) == 1 and len(opened) == n


def test_partitions_by_bytes_and_filters(spark, landed):
    sizes = [formats.Found(str(i), str(i), n, None) for i, n in enumerate((4, 4, 9, 1, 1, 1))]
    assert [[f.length for f in p.files] for p in formats.packed(sizes, 8)] == [[4, 4], [9], [1, 1, 1]]
    schema = formats.LandedTexts({}).schema()
    reader = formats.LandedTexts({"path": landed}).reader(spark.createDataFrame([], schema).schema)
    left = list(reader.pushFilters([formats.EqualTo(("stem",), "b"), formats.EqualTo(("text",), "x")]))
    assert [f.attribute for f in left] == [("text",)] and [f.stem for p in reader.partitions() for f in p.files] == ["b"]
    assert [r.text for r in spark.read.format("landed_texts").load(landed).filter("stem IN ('a', 'zz')").collect()] == ["one"]
    assert spark.read.format("landed_texts").load(landed).filter("stem = 'zz'").count() == 0
    with pytest.raises(Exception, match="missing"):
        spark.read.format("landed_texts").load().collect()


def test_traces_bare_wrapped_and_malformed(spark, tmp_path):
    formats.register(spark)
    for name, text in {"a.json": '{"run_id": 7, "level": "NORMAL"}', "b.json": '{"canonical": {"run_id": "r", "level": "é"}}', "c.json": '{"run_id": ', "d.json": "[1]"}.items():
        (tmp_path / name).write_text(text)
    rows = spark.read.format("run_traces").load(str(tmp_path))
    got = {r.stem: r for r in rows.withColumn("level", F.get_json_object("document", "$.level")).collect()}
    assert [(got[s].run_id, got[s].level) for s in "ab"] == [("7", "NORMAL"), ("r", "é")]
    assert all(got[s].document is None and got[s].error for s in "cd")
