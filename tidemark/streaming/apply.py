"""Streams of log entries: exactly-once application and the latest version of each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session long, idx long, seq long, applied boolean"


def _apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the session's highest seq. Rows of a micro-batch come unordered, so they are sorted by idx."""
    last = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values("idx", kind="stable")
    seq = rows["seq"].to_numpy()
    before = pd.Series(seq).cummax().shift(fill_value=last).clip(lower=last)
    state.update((int(max(last, seq.max())),))
    yield pd.DataFrame({"session": key[0], "idx": rows["idx"].to_numpy(), "seq": seq, "applied": seq > before.to_numpy()})


def deduplicated(entries: DataFrame) -> DataFrame:
    """A stream of entries (session, idx, seq) with applied, over all that each session has sent so far."""
    return entries.select("session", "idx", "seq").groupBy("session").applyInPandasWithState(_apply, OUT, "last long", "append", GroupStateTimeout.NoTimeout)


def latest_versions(versions: DataFrame) -> DataFrame:
    """A stream's newest version of each key (update or complete mode)."""
    from pyspark.sql import functions as F

    rest = [c for c in versions.columns if c not in ("key", "ts")]
    return versions.groupBy("key").agg(F.max("ts").alias("ts"), *[F.max_by(c, "ts").alias(c) for c in rest])


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there, then read the result. Complete mode writes each micro-batch's table under its own
    number, so that a reader has a whole one, and the newest is read."""
    spark = stream.sparkSession
    newest = [out]
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out)
    else:

        def write(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{out}/{batch:08d}")
            newest[0] = f"{out}/{batch:08d}"

        writer = stream.writeStream.foreachBatch(write)
    writer.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(newest[0])
