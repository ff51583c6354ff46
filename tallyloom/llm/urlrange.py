"""URL filters: a sort-merge range join of page URLs with host/path rules.

Canonical key of a host: its labels reversed, each followed by ``.``; so a rule's host is a key
prefix of its subdomains and stands for one interval of keys, ``[key, key + U+10FFFF]``. Pages and
rules are dealt into ranges of keys; a rule goes to every range that its interval meets, clipped to
it. Each range is sorted once and swept once: a rule is pushed when its key comes, popped when a key
no longer starts with it, so the stack holds just the nested rules active at this key. Of their
paths, those the URL's path starts with are compared and the longest rule wins.

A range may hold a share of one key only: bounds are taken from a bounded, deterministic sample of
pages, and a key that fills several ranges is dealt over them by page id and path. Memory of a task is the
stack (at most one entry per host label, with that host's paths).

Defined results: null URL, or one without ``://``: empty host and path, no rule, the default
verdict. Equal rules: one of them counts; block wins over allow. Extra columns of the pages are
ignored. Empty tables give empty results; no rules: everything gets the default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pages whose keys are collected to choose the bounds between ranges.
BOUND_SAMPLE = 20_000
#: Ranges for each shuffle partition, so that hashing ranges to tasks deals them out evenly.
RANGES_PER_TASK = 4


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    low = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """a.example.com -> com.example.a. ; an empty host has an empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _utf8(s: str) -> bytes:
    return s.encode("utf-8", "surrogatepass")


def _bounds(keys: list[str], n: int) -> list[str]:
    """At most n - 1 bounds, equal ones kept: a key that holds several quantiles owns several ranges."""
    keys = sorted(keys, key=_utf8)
    return [keys[len(keys) * i // n] for i in range(1, n)] if len(keys) >= n else []


def _place(bounds: list[str], before: Callable[[Column], Column]) -> Column:
    """How many of the sorted bounds come before, by binary search."""
    if not bounds:
        return F.lit(0)
    edges, steps = F.lit(bounds), [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(before(F.get(edges, at + step - 1)), at + step).otherwise(at))


def _sweep(default: str):
    """Streams the sorted rows of each range; nothing but the stack is kept between rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []  # (key, {path: (rule, verdict)}, lengths of the paths)
        for b in batches:
            out: list[tuple] = []
            for p, key, kind, pid, host, path, rule, verdict in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6, 7, 8)), strict=True):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, set()))
                    stack[-1][1][path] = (rule, verdict)  # block comes after allow
                    stack[-1][2].add(len(path))
                    continue
                best = (-1, None, default)
                for own, paths, lengths in stack:
                    for n in lengths:
                        if (said := paths.get(path[:n])) and len(own) + n >= best[0] and len(path) >= n:
                            best = (len(own) + n, *said)
                out.append((pid, host, path, best[1], best[2]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(x, pa.string()) for x in columns[1:])], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """pages (id, url) against rules (verdict, host, path); one row per page: page_id, host, path,
    rule (host and path of the rule that decided, else null), verdict."""
    spark = pages.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("_key", key_of(F.col("host")))
    share = common.below(BOUND_SAMPLE / max(pages.count(), 1))
    picked = rows.where(F.xxhash64("page_id", "host", "path") <= share)
    bounds = _bounds([r[0] for r in picked.select("_key").limit(2 * BOUND_SAMPLE).collect()], RANGES_PER_TASK * n)
    below = lambda key: _place(bounds, lambda b: b < key)
    equal = _place(bounds, lambda b: b <= F.col("_key")) - below(F.col("_key"))
    rows = rows.withColumn("_part", below(F.col("_key")) + F.pmod(F.xxhash64("page_id", "path"), equal + 1).cast("int"))
    rows = rows.select("_part", "_key", F.lit(1).alias("_kind"), F.lit(0).alias("_order"), "page_id", "host", "path", F.lit(None).cast("string").alias("_rule"), F.lit(None).cast("string").alias("_verdict"))

    host = F.lower(rules["host"])
    rule = rules.select(key_of(host).alias("_key"), rules["path"].alias("path"), rules["verdict"].alias("_verdict"), F.concat(host, rules["path"]).alias("_rule")).where("_rule IS NOT NULL")
    rule = rule.withColumn("_part", F.explode(F.sequence(below(F.col("_key")), below(F.concat("_key", F.lit("\U0010ffff"))))))
    rule = rule.select(
        "_part", "_key", F.lit(0).alias("_kind"), F.when(F.col("_verdict") == "block", 1).otherwise(0).alias("_order"),
        F.lit(None).cast("long").alias("page_id"), F.lit("").alias("host"), "path", "_rule", "_verdict",
    )
    dealt = rows.unionByName(rule).repartition(n, "_part").sortWithinPartitions("_part", "_key", "_kind", "_order")
    return dealt.mapInArrow(_sweep(default), "page_id long, host string, path string, rule string, verdict string")


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(common.read(spark, sf_dir, "pages"), rules)


OP6_SQL = r"""
WITH parsed AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), hit AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN hit USING (page_id)
"""
