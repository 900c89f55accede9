"""Change detection that starts from a snapshot, and snapshots taken from a stream. Needs the RocksDB state store."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronolith.streaming.changes import CHANGE

#: Setting that the session of a seeded stream needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Changes(StatefulProcessor):
    """One hash for each cell; emits entries that differ from it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hash = handle.getValueState("hash", "hash long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.hash.update((int(initialState.asset_hash.iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["t", "event_id"])
        first = self.hash.get()[0] if self.hash.exists() else None
        keep = pdf.asset_hash != pdf.asset_hash.shift(1, fill_value=0)
        keep.iloc[0] = first is None or first != int(pdf.asset_hash.iloc[0])
        self.hash.update((int(pdf.asset_hash.iloc[-1]),))
        yield pdf[keep]

    def close(self) -> None:
        pass


def changed_since(stream: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Tile entries that differ from the cell's last one, or, for its first, from the snapshot (cell, asset_hash).

    State is one hash for each cell, spread by cell; entries of a micro-batch are put in order, batches come in order.
    """
    cells = stream.filter("op <= 2").selectExpr(*(f"cast({c} as long) as {c}" for c in ("event_id", "t", "monitor_id", "tile_x", "tile_y", "asset_hash")))
    key = ("monitor_id", "tile_x", "tile_y")
    seed = snapshot.selectExpr(*(f"cast({c} as long) as {c}" for c in (*key, "asset_hash"))).groupBy(*key)
    return cells.groupBy(*key).transformWithStateInPandas(statefulProcessor=_Changes(), outputStructType=CHANGE, outputMode="append", timeMode="none", initialState=seed)


def snapshots(stream: DataFrame, step: str = "180 seconds", late: str = "30 seconds") -> DataFrame:
    """(step_end, cell, op, asset_hash): last tile operation of each cell in each step, once the watermark has passed it.

    The stream has ``at`` (timestamp). State is one row for each cell and open step; see state.deltas for the batch form.
    """
    rows = stream.filter("op <= 2").withWatermark("at", late)
    last = rows.groupBy(F.window("at", step).alias("w"), "monitor_id", "tile_x", "tile_y").agg(F.max_by(F.struct("op", "asset_hash"), F.struct("t", "event_id")).alias("last"))
    return last.select(F.col("w.end").alias("step_end"), "monitor_id", "tile_x", "tile_y", "last.op", "last.asset_hash")
