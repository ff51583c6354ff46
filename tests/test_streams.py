"""Streams over several files, late rows, a restart: what comes out equals the batch's, up to the stated lateness."""

import random

from pyspark.sql import functions as F

from tallyloom.streaming import events

SCHEMA = "id long, round_id long, shop string, at timestamp, ms long, denied boolean"
MINUTE = 60_000


def batch(rows, until):
    """Of every denial before that time: its shop's and its round's in the two hours up to it, and whether it is the first."""
    denied, out = [r for r in rows if r[4]], []
    for i, r, shop, ms, _ in denied:
        if ms < until:
            near = [x for x in denied if x[1] == r and ms - 120 * MINUTE <= x[3] <= ms]
            out.append((i, r, shop, sum(x[2] == shop for x in near), len(near), (ms, i) == min((x[3], x[0]) for x in denied if x[1] == r)))
    return sorted(out)


def test_late_files_and_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, 1 + (i % 3 == 0), f"S{rng.randrange(3)}", 3_000_000 * MINUTE + rng.randrange(0, 900) * MINUTE, rng.random() < 0.7) for i in range(260)]
    rows.append((999, 1, "S0", 3_000_000 * MINUTE + 1000 * MINUTE, False))
    arrival = sorted(rows, key=lambda r: r[3] + rng.randrange(0, 55) * MINUTE)  # never an hour late
    files = [arrival[i : i + 53] for i in range(0, len(arrival), 53)]
    lost = (5000, 1, "S0", 3_000_000 * MINUTE + 5 * MINUTE, True)  # hours late: left out
    files[4].append(lost)

    def put(n):
        df = spark.createDataFrame([(i, r, s, None, ms, d) for i, r, s, ms, d in files[n]], SCHEMA).withColumn("at", F.timestamp_millis("ms"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        schema = spark.read.parquet(f"{tmp_path}/in").schema
        return sorted(map(tuple, events.resumed(spark, f"{tmp_path}/in", schema, events.round_denies, f"{tmp_path}/out").collect()))

    for n in (0, 1):
        put(n)
    seen = [r for f in files[:2] for r in f]
    early = max(r[3] for r in seen if r[4]) - 60 * MINUTE
    assert run() == batch([r for r in rows if r[3] < early], early)
    for n in (2, 3, 4):
        put(n)
    until = max(r[3] for r in rows if r[4]) - 60 * MINUTE
    got, want = run(), batch(rows, until)
    place = {r[0]: (r[3] // MINUTE - 3_000_000, n) for n, f in enumerate(files) for r in f}
    assert sorted(place[r[0]] for r in set(want) ^ set(got)) == []
    assert run() == batch(rows, until)  # nothing new: nothing more


def test_first_seen_lets_go(spark, tmp_path):
    day = lambda d, h: f"2024-01-{d:02d} {h:02d}:00:00"
    for some in ([(1, day(1, 3)), (1, day(1, 2)), (2, day(1, 9))], [(1, day(1, 23)), (1, day(2, 1))], [(3, day(9, 1))], [(3, day(9, 0))]):
        spark.createDataFrame(some, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    got = events.resumed(spark, f"{tmp_path}/in", schema, events.first_seen, f"{tmp_path}/out").collect()
    assert sorted((r["user_id"], r["date"].day) for r in got) == [(1, 1), (1, 2), (2, 1), (3, 9)]
