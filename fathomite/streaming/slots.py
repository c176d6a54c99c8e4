"""The loop's ledger as a stream: what is known of each slot is kept as state, and each event changes it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import values as V

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Entries that the rule against stalls looks at.
STEPS = 3


class SlotLedger(StatefulProcessor):
    """State of one slot: how many verdicts it has had, and the last STEPS of them in the order of their iteration.

    That is enough for the rule against stalls and for the last verdict, whatever the order in which verdicts arrive, and
    it does not grow. With ``idle`` a slot that has had nothing for so many seconds of event time is closed by a timer: a gap
    becomes exhausted, and its state goes. A later verdict of a closed slot opens it anew.
    """

    def __init__(self, kind: str, idle: int | None = None):
        self.kind, self.idle = kind, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n bigint, at bigint")
        self.last = handle.getListState("last", "iteration bigint, coverage double, verdict string, n_supported bigint")

    def row(self, key, n: int, last: list[tuple], closed: bool) -> pd.DataFrame:
        scores = [r[1] for r in last]
        steps = [abs(b - a) if a is not None and b is not None else None for a, b in zip(scores, scores[1:])]
        stalled = n >= STEPS and all(s is not None and s < V.STALL_DELTA for s in steps)
        verdict = "exhausted" if closed and last[-1][2] == "gap" else last[-1][2]
        return pd.DataFrame({"slot_id": [key[0]], "n": [n], "stalled": [stalled], "iteration": [last[-1][0]], "verdict": [verdict], "n_supported": pd.array([last[-1][3]], "Int64"), "closed": [closed]}).astype({"slot_id": self.kind})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, at = self.count.get() if self.count.exists() else (0, 0)
        last = [tuple(r) for r in self.last.get()] if self.last.exists() else []
        for part in rows:
            n += len(part)
            if self.idle is not None:
                at = max(at, int(part["ts"].max().timestamp() * 1000))
            own = part.nlargest(STEPS, "iteration")[["iteration", "coverage", "verdict", "n_supported"]].astype(object)
            own = own.where(own.notna(), None)
            last = sorted([*last, *((int(i), None if c is None else float(c), v, None if s is None else int(s)) for i, c, v, s in own.itertuples(index=False))], key=lambda r: r[0])[-STEPS:]
        self.count.update((n, at))
        self.last.put(last)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at + self.idle * 1000)
        yield self.row(key, n, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, _ = self.count.get()
        last = [tuple(r) for r in self.last.get()]
        self.count.clear()
        self.last.clear()
        yield self.row(key, n, last, True)

    def close(self) -> None:
        pass


def slot_states(verdicts: DataFrame, idle: int | None = None, delay: str = "1 hour") -> DataFrame:
    """A stream of (slot_id, n, stalled, iteration, verdict, n_supported, closed), a row for each slot that changed.

    ``verdicts`` is a stream of (slot_id, iteration, coverage, verdict, n_supported[, ts]); an iteration of a slot is
    expected once. A null slot_id is a slot; null coverages never make a stall. ``idle``, in seconds of ``ts``, needs
    that column, whose watermark is ``delay`` behind; verdicts behind the watermark are left out.
    """
    kind = verdicts.schema["slot_id"].dataType.simpleString()
    columns = [F.col("slot_id"), F.col("iteration").cast("bigint"), F.col("coverage").cast("double"), F.col("verdict").cast("string"), F.col("n_supported").cast("bigint")]
    timed = idle is not None
    rows = (verdicts.withWatermark("ts", delay) if timed else verdicts).select(*columns, *(["ts"] if timed else []))
    made = rows.groupBy("slot_id").transformWithStateInPandas(
        statefulProcessor=SlotLedger({"bigint": "Int64", "int": "Int32"}.get(kind, "object"), idle),
        outputStructType=f"slot_id {kind}, n bigint, stalled boolean, iteration bigint, verdict string, n_supported bigint, closed boolean",
        outputMode="Update", timeMode="EventTime" if timed else "None",
    )
    return made


@contextmanager
def _state_store(spark: SparkSession):
    """State of any form needs the store on disk; a query takes the setting that is there when it starts."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def write_states(states: DataFrame, path: str, checkpoint: str):
    """Start writing ``states`` under ``path``, a folder for each batch. A batch that runs again after a stop replaces its
    own folder, so nothing is counted twice. Both folders must be seen by all executors."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with _state_store(states.sparkSession):
        return states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_states(spark: SparkSession, path: str) -> DataFrame:
    """The last written state of each slot: of the last batch, and in it the one that closed the slot."""
    rows = spark.read.parquet(path)
    own = [c for c in rows.columns if c not in ("slot_id", "batch")]
    return rows.groupBy("slot_id").agg(F.max_by(F.struct(*own), F.struct("batch", "closed", "n")).alias("_r")).select("slot_id", "_r.*")
