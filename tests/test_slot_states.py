import datetime as dt

from fathomite.operators import decisions as D
from fathomite.plans import views
from fathomite.streaming import slots
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "slot_id bigint, iteration bigint, coverage double, verdict string, n_supported bigint, ts timestamp"


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_stopped_stream_ends_with_the_rows_of_the_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = views.verdicts(spark, SF).select("slot_id", F.col("event_id").alias("iteration"), (F.col("coverage") / 1000).alias("coverage"), "verdict", "n_supported", "ts")
    thirds = [rows.filter(F.pmod(F.xxhash64("iteration"), F.lit(3)) == i) for i in range(3)]  # so that order is mixed
    thirds[0].coalesce(1).write.parquet(source)
    slots.write_states(slots.slot_states(stream(spark, source)), out, state).awaitTermination()
    part = {r.slot_id: r.n for r in slots.last_states(spark, out).collect()}
    assert part == {r.slot_id: r["count"] for r in thirds[0].groupBy("slot_id").count().collect()}
    for t in thirds[1:]:
        t.coalesce(1).write.mode("append").parquet(source)
    slots.write_states(slots.slot_states(stream(spark, source)), out, state).awaitTermination()
    got = {r.slot_id: (r.n, r.stalled, r.verdict, r.n_supported) for r in slots.last_states(spark, out).collect()}
    last = D.last_of_slot(rows.withColumn("_v", F.struct("verdict", "n_supported")), ["slot_id"], "_v", "iteration").select("slot_id", "_v.*")
    want = D.stalled(rows).join(last, "slot_id")
    assert got == {r.slot_id: (r.n, r.stalled, r.verdict, r.n_supported) for r in want.collect()}
    assert any(v[1] for v in got.values()) and not all(v[1] for v in got.values())


def test_idle_slots_are_closed_by_a_timer(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    batches = [[(1, 1, 0.5, "gap", 0, at(0)), (2, 1, 0.9, "covered", 2, at(1))], [(2, 2, None, "gap", None, at(300))], [(3, 1, 0.1, "gap", 0, at(301))]]
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        slots.write_states(slots.slot_states(stream(spark, source), idle=600, delay="1 minute"), out, state).awaitTermination()
    got = {r.slot_id: (r.n, r.verdict, r.closed) for r in slots.last_states(spark, out).collect()}
    assert got[1] == (1, "exhausted", True) and got[3] == (1, "gap", False)
    assert got[2][1] == "gap" and not got[2][2]
