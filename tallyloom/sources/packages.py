"""Packages: a machine's week of tables as Parquet folders, and declared-projection reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def projected(df: DataFrame, schema: StructType) -> DataFrame:
    """Declared columns only: missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def table_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A package's optional table; a missing folder is an empty table."""
    path_ = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not path_.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path_):
        return spark.createDataFrame([], schema)
    return projected(spark.read.parquet(path), schema)


def write_package(tables: dict[str, DataFrame], path: str) -> None:
    """One folder a table, split by machine and week where present."""
    for name, df in tables.items():
        keys = [c for c in ("machine", "week") if c in df.columns]
        df.write.partitionBy(*keys).parquet(f"{path}/{name}") if keys else df.write.parquet(f"{path}/{name}")


def digest(df: DataFrame) -> DataFrame:
    """rows, digest: the same for the same multiset of rows, in any order and partitioning. Rows are
    hashed; hashes add up in two whole numbers, so nothing is collected."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring("_h", i, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.select(row.alias("_h")).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", part(1), part(13), part(25)), 256).alias("digest"))
