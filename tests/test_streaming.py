from fathomite.streaming import ledger


def test_ingest_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"source_document": "d", "v": 1}\n')
    for n in (1, 2):
        stream = ledger.stream_facts(spark, str(tmp_path / "in"), "source_document string, v int")
        ledger.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (tmp_path / "in" / "b.json").write_text('{"source_document": "e", "v": 2}\n')


def test_files_of_one_document_in_several_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "source_document string, fact_id string, v int"
    for i, line in enumerate(('{"source_document": "d", "fact_id": "1", "v": 1}', '{"source_document": "d", "fact_id": "2", "v": 2}', '{"source_document": "d", "fact_id": "1", "v": 3}')):
        (tmp_path / "in" / f"{i}.json").write_text(line + "\n")
        ledger.ingest(ledger.stream_facts(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(tuple(r) for r in ledger.ingested(spark, str(tmp_path / "out")).select("source_document", "fact_id", "v").collect())
    assert got == [("d", "1", 3), ("d", "2", 2)]
