"""A folder as it was at one moment: all reads of an analysis see the files that were there when it was pinned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Pinned:
    """Tables below a folder, pinned together. What is written later is not seen; what is removed later fails the read instead of
    going missing."""

    def __init__(self, spark: SparkSession, root: str, tables: list[str]) -> None:
        self.spark = spark
        self.parts = {t: spark.read.parquet(f"{root}/{t}") for t in tables}
        self.files = {t: sorted(df.inputFiles()) for t, df in self.parts.items()}

    def read(self, table: str) -> DataFrame:
        files, schema = self.files[table], self.parts[table].schema
        return self.spark.read.schema(schema).option("ignoreMissingFiles", "false").parquet(*files) if files else self.spark.createDataFrame([], schema)
