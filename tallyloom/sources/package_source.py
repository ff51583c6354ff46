"""Packages as a data source: one partition a file, rows or one failure row of each.

A file's footer and every page (with its checksum, where it has one) are read once before any of its rows goes out, a row group at a time,
so a package that breaks off in its middle gives its failure and no rows. Declared columns only; missing ones are null.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

ROWS = 8_192


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A store that Arrow knows (file, hdfs, s3, gs, abfs), and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class PackageReader(DataSourceReader):
    def __init__(self, root: str, schema: StructType) -> None:
        self.root, self.schema = root, schema
        self.declared = StructType([f for f in schema if f.name not in ("_path", "_reason")])

    def partitions(self) -> list[_File]:
        fs, root = opened(self.root)
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x[:1] in "_." for x in p[len(root) :].strip("/").split("/"))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and not hidden(f.path)] or [_File("")]

    def _open(self, path: str) -> pa.parquet.ParquetFile:
        fs, _ = opened(self.root)
        if not path.endswith(".gz"):
            return pa.parquet.ParquetFile(fs.open_input_file(path), page_checksum_verification=True)
        with fs.open_input_stream(path, compression=None) as stream:  # gzip can't be read from its end
            return pa.parquet.ParquetFile(io.BytesIO(gzip.decompress(stream.read())), page_checksum_verification=True)

    def _batches(self, file: pa.parquet.ParquetFile) -> Iterator[pa.RecordBatch]:
        want = to_arrow_schema(self.declared)
        have = [n for n in want.names if n in file.schema_arrow.names]
        for b in file.iter_batches(ROWS, columns=have):
            yield pa.RecordBatch.from_arrays([b[f.name].cast(f.type) if f.name in have else pa.nulls(b.num_rows, f.type) for f in want], names=want.names)

    def _with(self, b: pa.RecordBatch, path: str, reason: str | None) -> pa.RecordBatch:
        extra = {"_path": pa.array([path] * b.num_rows, pa.string()), "_reason": pa.array([reason] * b.num_rows, pa.string())}
        return pa.RecordBatch.from_arrays([extra[f.name] if f.name in extra else b[f.name] for f in self.schema], names=self.schema.names)

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        try:
            file = self._open(partition.path)
            rows = sum(b.num_rows for b in self._batches(file))
            if rows != file.metadata.num_rows:
                raise pa.ArrowInvalid("rows are missing")
        except (pa.ArrowException, OSError, EOFError, ValueError) as e:
            want = to_arrow_schema(self.declared)
            none = pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in want], names=want.names)
            yield self._with(none, partition.path, f"not a package: {type(e).__name__}")
            return
        for b in self._batches(file):
            yield self._with(b, partition.path, None)


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tallyloom_package"

    def schema(self) -> StructType:
        raise ValueError("a package is read with the columns that are declared for it")

    def reader(self, schema: StructType) -> PackageReader:
        return PackageReader(self.options["path"], schema)


def declared(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add("_path", StringType()).add("_reason", StringType())
