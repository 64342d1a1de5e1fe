"""Keep-first on a stream, exact by order where rows come late and out of order.

``dropDuplicatesWithinWatermark`` keeps the first row to arrive; here each key holds the row that is first by event time (and by
``order`` among equal times) and a timer at that time.  Once the watermark has passed it no earlier row can come, so the row is
given out, once, and what comes later for the key is a copy.  The result is that of ``tabular.keep_first`` over the same rows but those that
came later than the watermark allows; keys whose first row the watermark has not passed are given out by a later batch.

State is a row and a mark for each key, in the RocksDB state store (see :func:`rocks`); with ``forget`` a key's mark ends so long after its row was
given out, and a copy that comes after that counts as new.

Defined cases: null is a key value; rows with a null event time are no rows of the order and go; equal rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows are held as JSON, times to the microsecond.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started within have the state store that timers need."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


class _First(StatefulProcessor):
    def __init__(self, forget: int | None) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "at timestamp, place string, row string")
        self.told = handle.getValueState("told", "told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        if self.told.exists():
            return
        first = self.best.get() if self.best.exists() else None
        kept = first
        for part in rows:
            if part.empty:
                continue
            at = part.set_axis(["_key", "_at", "_place", "_row"], axis=1).sort_values(["_at", "_place", "_row"], kind="stable").iloc[0]
            mine = (at["_at"].to_pydatetime(), at["_place"], at["_row"])
            if kept is None or mine < tuple(kept):
                kept = mine
        if kept is not None and kept is not first:
            if first is not None:
                self.handle.deleteTimer(_millis(first[0]))
            self.best.update(kept)
            self.handle.registerTimer(_millis(kept[0]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.told.exists():
            self.told.clear()
            return
        row = self.best.get()[2]
        self.best.clear()
        self.told.update((True,))
        if self.forget is not None:
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.forget)
        yield pd.DataFrame({"_row": [row]})

    def close(self) -> None:
        pass


def _millis(at) -> int:
    return int(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp() * 1000)


def first_rows(stream: DataFrame, keys: list[str], time_col: str, order: list[str], delay: str = "1 hour", forget_ms: int | None = None) -> DataFrame:
    """The row of each key that is first by ``time_col`` and ``order``; rows may come ``delay`` late.

    ``order`` columns are compared as texts, numbers filled with zeros to 20 digits."""
    place = F.concat_ws(chr(1), *(F.lpad(F.col(f"`{c}`").cast("string"), 20, "0") if isinstance(stream.schema[c].dataType, T.IntegralType) else F.col(f"`{c}`").cast("string") for c in order))
    key = F.to_json(F.struct(*(F.col(f"`{c}`") for c in keys)), {"ignoreNullFields": "false"}).alias("_key")
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in stream.columns)), EXACT).alias("_row")
    ready = stream.select(key, F.col(f"`{time_col}`").cast("timestamp").alias("_at"), place.alias("_place"), row).where("_at is not null").withWatermark("_at", delay)
    out = ready.groupBy("_key").transformWithStateInPandas(_First(forget_ms), "_row string", "Append", "EventTime")
    return out.select(F.from_json("_row", stream.schema, EXACT).alias("r")).select("r.*")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a streaming result gives out for all rows that are there now, as a table; ``folder`` holds the rows and the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
