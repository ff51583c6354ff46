"""Folders of packages, versioned drafts, lists in several encodings, plan documents: what lies in shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.sources import commits, package_source


def scan(spark: SparkSession, root: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of all sound packages below a folder (.parquet or .parquet.gz), and one row for each file that is none, or is damaged
    anywhere: path, reason. Each file is in one of both; none ends the job."""
    spark.dataSource.register(package_source.PackageSource)
    every = spark.read.format("tallyloom_package").schema(package_source.declared(schema)).load(root)
    return every.where("_reason IS NULL").drop("_path", "_reason"), every.where("_reason IS NOT NULL").select(F.col("_path").alias("path"), F.col("_reason").alias("reason"))


_DRAFT = "draft"


def commit_version(df: DataFrame, root: str) -> int:
    """A new version of a draft. Readers see the old one or the new one, also if this ends halfway. Returns its number."""
    return commits.Store(df.sparkSession, root).commit(uuid.uuid4().hex, {_DRAFT: df}, replaced=(_DRAFT,))


def current(spark: SparkSession, root: str, schema: StructType | None = None, version: int | None = None) -> DataFrame:
    """The last version, or that of a number."""
    return commits.Store(spark, root).read(_DRAFT, schema, version).drop("_commit", "_nth")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A CSV list with a header: UTF-8, with or without its mark, if the files are valid, else GBK, which Spark's own
    reader doesn't know: lines are then decoded in tasks."""
    raw = spark.read.format("binaryFile").load(path).where(~F.col("path").rlike("/[_.][^/]*$"))
    if not raw.where(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count():
        rows = spark.read.option("header", True).csv(path)
        return rows.toDF(*(c.lstrip("\ufeff") for c in rows.columns))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"].to_pylist():
                lines = content.decode("gbk", "replace").splitlines()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["nth", "line"])

    lines = raw.select("content").mapInArrow(decode, "nth long, line string").where("line <> ''")
    names = lines.where("nth = 0").first()["line"].split(",")
    schema = ", ".join(f"`{n}` string" for n in names)
    return lines.where("nth > 0").select(F.from_csv("line", schema).alias("r")).select("r.*")


#: What a plan's document must have.
PLAN = "week string, machines array<string>, shops array<struct<shop:bigint,pages:bigint,machine:string>>"


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document and shop: week, shop, pages, machine, problem: none if the document is a plan (a week,
    known machines, each shop once), else what is wrong with it."""
    docs = spark.read.schema(PLAN + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    named = F.transform("shops", lambda s: s["machine"])
    problem = (
        F.when(F.col("_broken").isNotNull(), "unreadable").when(~F.coalesce(F.col("week").rlike("^[0-9]{4}-W[0-9]{2}$"), F.lit(False)), "no week").when(F.size(F.array_except(named, "machines")) > 0, "unknown machine")
        .when(F.size(F.array_distinct(F.transform("shops", lambda s: s["shop"]))) < F.size("shops"), "repeated shop")
    )
    # once for each document: beside the generator it would be worked out, and the whole document copied, for each shop
    checked = docs.select("week", problem.alias("problem"), "shops")
    return checked.select("week", "problem", F.explode_outer("shops").alias("s")).select("week", "s.shop", "s.pages", "s.machine", "problem")
