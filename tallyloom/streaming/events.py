"""Event streams: windowed deny counts and first-seen rows, on Structured Streaming.

Queries run over what is there and stop (``availableNow``); results go to the shared checkpoint folder.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tallyloom.plans import shared


def _folder(spark: SparkSession) -> str:
    return f"{shared.folder(spark)}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Files of a table as a stream, one file a micro-batch."""
    schema = spark.read.parquet(f"{path}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{path}/{table}.parquet*")


def finished(stream: DataFrame) -> DataFrame:
    """Runs an append-mode stream over all input and reads what it wrote."""
    spark, out = stream.sparkSession, _folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def completed(stream: DataFrame) -> DataFrame:
    """Runs an aggregation to its end: every batch replaces the folder's rows of that batch number, and
    the last one is read."""
    spark, out = stream.sparkSession, _folder(stream.sparkSession)
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/{number}")
        last.append(number)

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows/{last[-1]}") if last else spark.createDataFrame([], stream.schema)


def deny_windows(events: DataFrame, width: str = "2 hours") -> DataFrame:
    """Denials by shop in fixed windows of event time."""
    denied = events.where(F.col("event_type").isin("signup", "purchase")).withColumn("shop", F.concat(F.lit("S"), (F.col("user_id") % 12).cast("string")))
    w = denied.withColumn("at", F.col("ts").cast("timestamp")).groupBy(F.window("at", width), "shop").agg(F.count(F.lit(1)).alias("denies"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("starts"), "shop", "denies")


def first_seen(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """One row for each user and day. A day's rows lie within a day of each other, so what was seen is kept for a day and the
    lateness, then let go; rows later than the lateness may be left out."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", f"1 day {lateness}")
    return rows.select("user_id", F.col("ts").cast("date").alias("date"), "at").dropDuplicatesWithinWatermark(["user_id", "date"]).select("user_id", "date")


ROUND_DENIES = "id long, round_id long, shop string, in_window long, in_round long, sets_off boolean"


def round_denies(events: DataFrame, width_ms: int = 7_200_000, lateness: str = "1 hour", ends_ms: int | None = 86_400_000) -> DataFrame:
    """For each denial of a round, how many its shop had in the time up to it, how many the round had, and whether it is the round's
    first, which alone sets off a pause. events: id, round_id, shop, at (its event time), ms (that in whole milliseconds), denied.

    Denials may come in any order within the lateness (of the latest denial so far): a denial is held back until the watermark has passed it, so
    what goes out counts every one before it, in the order of (ms, id), in whatever batches they came. A later row is left out. A
    round's state is what is held back, the denials inside the window, and whether the pause was set off; it goes ends_ms and
    a window after the round's last row. None: whether the pause was set off is kept for good."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ms, ids, shops, old_ms, old_shops, fired, done = state.get if state.exists else ([], [], [], [], [], False, 0)
        held = list(zip(ms, ids, shops, strict=True))
        for b in batches:
            held += (r for r in zip(b["ms"].tolist(), b["id"].tolist(), b["shop"].tolist(), strict=True) if r[0] >= done)
        held.sort()
        passed = state.getCurrentWatermarkMs()
        ready = bisect.bisect_left(held, (passed,))
        window, out = list(zip(old_ms, old_shops, strict=True)), []
        for at, id_, shop in held[:ready]:
            out.append((id_, key[0], shop, None, None, not fired))
            fired = True
            window.append((at, shop))
        # denials of the same instant count for each other
        times = [t for t, _ in window]
        by_shop: dict[str, list[int]] = {}
        for t, shop in window:
            by_shop.setdefault(shop, []).append(t)
        count = lambda some, t: bisect.bisect_right(some, t) - bisect.bisect_left(some, t - width_ms)
        out = [(i, r, shop, count(by_shop[shop], at), count(times, at), first) for (i, r, shop, _, _, first), (at, _, _) in zip(out, held[:ready], strict=True)]
        left, kept = held[ready:], [(t, shop) for t, shop in window if t >= passed - width_ms]
        last = max([passed, *(t for t, _, _ in left)])
        if state.hasTimedOut and not left and not kept and ends_ms is not None:
            state.remove()
        else:
            state.update(([x[0] for x in left], [x[1] for x in left], [x[2] for x in left], [t for t, _ in kept], [shop for _, shop in kept], fired, passed))
            if left or ends_ms is not None:
                state.setTimeoutTimestamp(left[0][0] + 1 if left else last + ends_ms + width_ms)
        yield pd.DataFrame(out, columns=["id", "round_id", "shop", "in_window", "in_round", "sets_off"])

    rows = events.where("denied").withWatermark("at", lateness).select("id", "round_id", "shop", "ms", "at")
    held = "ms array<long>, ids array<long>, shops array<string>, window_ms array<long>, window_shops array<string>, fired boolean, done long"
    return rows.groupBy("round_id").applyInPandasWithState(step, ROUND_DENIES, held, "append", GroupStateTimeout.EventTimeTimeout)


def chunked(spark: SparkSession, rows: DataFrame, root: str, number: Column, first: int, last: int) -> None:
    """Writes rows as the files of a stream, one for each number, in that order."""
    for n in range(first, last + 1):
        rows.where(number == n).coalesce(1).write.mode("append").parquet(root)


def resumed(spark: SparkSession, root: str, schema: StructType, work: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """Runs a stream over the files that are there, a file a micro-batch, from where an earlier run with this folder ended."""
    stream = work(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root))
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
