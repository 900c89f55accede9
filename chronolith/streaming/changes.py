"""Streaming forms: change detection by cell, exactly-once sinks."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "event_id long, t long, monitor_id long, tile_x long, tile_y long, asset_hash long"


def changed(stream: DataFrame) -> DataFrame:
    """Tile entries whose content differs from the cell's last one; state is one hash for each cell.

    Entries of a micro-batch are put in time order in their cell; batches must come in time order, as from one writer.
    """

    def run(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        for pdf in [pd.concat(list(frames)).sort_values(["t", "event_id"])]:
            before = pdf.asset_hash.shift(1)
            if last is not None:
                before.iloc[0] = last
            keep = before.isna() | (before != pdf.asset_hash)
            state.update((int(pdf.asset_hash.iloc[-1]),))
            yield pdf[keep]

    cells = stream.filter("op <= 2").selectExpr(*(f"cast({c} as long) as {c}" for c in ("event_id", "t", "monitor_id", "tile_x", "tile_y", "asset_hash")))
    return cells.groupBy("monitor_id", "tile_x", "tile_y").applyInPandasWithState(run, CHANGE, "hash long", "append", GroupStateTimeout.NoTimeout)


def sink(stream: DataFrame, assets_path: str, log_path: str, checkpoint: str):
    """Writes each batch's new assets first, then its entries, under a folder of the batch: a repeated batch replaces it."""

    def write(batch: DataFrame, n: int):
        batch.persist()
        batch.select("asset_hash").distinct().write.mode("overwrite").parquet(f"{assets_path}/batch={n}")
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={n}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
