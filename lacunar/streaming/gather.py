"""Bins that arrive in pieces. The cells of a bin are kept as the state of its key until event time has passed its latest
cell by a given wait; then the bin comes out whole, in one micro-batch, as the batch operators need it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lacunar.operators.tensor import CELL, KEYS

#: The state store that keyed state of this kind needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Gather(StatefulProcessor):
    """Keeps a bin's cells and the time at which it is whole; a later piece puts that time off."""

    def __init__(self, wait_ms: int, keys: list[str]):
        self.wait, self.keys = wait_ms, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getListState("cells", "row_id int, col_id int, value double")
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.due.get()[0] if self.due.exists() else None
        due = before
        for part in rows:
            self.cells.appendList(list(zip(part["row_id"].astype(int).tolist(), part["col_id"].astype(int).tolist(), part["value"].tolist(), strict=True)))
            due = max(due or 0, int(part["gather_ms"].max()) + self.wait)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.due.update((due,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cells = pd.DataFrame([tuple(c) for c in self.cells.get()], columns=["row_id", "col_id", "value"])
        self.cells.clear()
        self.due.clear()
        for k, name in reversed(list(enumerate(self.keys))):
            cells.insert(0, name, key[k])
        yield cells

    def close(self) -> None:
        pass


def whole_bins(cells: DataFrame, time_col: str, wait: str, late: str, keys: list[str] = KEYS) -> DataFrame:
    """(keys, row_id, col_id, value): the cells of a stream, held back until their bin is whole.

    cells: keys, row_id, col_id, value and an event time. A bin is whole when the watermark, `late` behind the latest event
    time seen, has passed the bin's latest cell by `wait`; all its cells then come out in one micro-batch, in any order
    and as often as they came. Cells behind the watermark of the batch before are dropped, as are those without an event
    time or a key. A cell
    that comes after its bin went out, and isn't late, begins the bin anew. A state is a bin's cells, which the plane
    bounds. The session must use the state store in STORE."""
    kinds = dict(cells.dtypes)
    wait_ms = F.unix_millis(F.lit("1970-01-01 00:00:00 UTC").cast("timestamp") + F.expr(f"INTERVAL {wait}"))
    spark = cells.sparkSession
    ms = spark.range(1).select(wait_ms.alias("ms")).first()["ms"]
    timed = cells.where(F.col(time_col).isNotNull()).dropna(subset=keys).withColumn("gather_t", F.col(time_col).cast("timestamp")).withWatermark("gather_t", late)
    # names that begin with an underscore would not reach the processor
    rows = timed.select(*keys, *(F.col(c).cast("int").alias(c) for c in CELL), F.col("value").cast("double").alias("value"), F.unix_millis("gather_t").alias("gather_ms"), "gather_t")
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row_id int, col_id int, value double"
    return rows.groupBy(*keys).transformWithStateInPandas(Gather(ms, keys), schema, "Append", "EventTime")
