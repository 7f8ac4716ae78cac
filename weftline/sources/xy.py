"""The flat binary dataset format as a Spark data source, ``spark.read.format("xy")`` and ``df.write.format("xy")``.

A file holds the numbers of features and samples as little-endian 64-bit
integers, then all features by row and all targets as 32-bit floats. Reading
cuts each file into partitions by ranges of samples, from its header alone; a
partition reads its two byte ranges a piece at a time. Writing makes files of
bounded size in a folder; tasks write under names that readers pass over, and
the commit gives them their names, so an attempt that fails leaves nothing that is read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from weftline.errors import ParametersError, ReadingError

#: Bytes of features in a partition that is read unless the option ``partitionBytes`` tells otherwise, in a piece of it, and in a file that is written.
PARTITION_BYTES, PIECE_BYTES, FILE_BYTES = 32 << 20, 4 << 20, 64 << 20
_HEADER = struct.Struct("<QQ")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Range(InputPartition):
    path: str
    p: int
    n: int
    lo: int
    hi: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes

    def partitions(self) -> list[_Range]:
        system, at = _place(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise ReadingError("NotFound", f"there is nothing at {self.path}")
        files = [info] if info.type == fs.FileType.File else sorted((f for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        out = []
        for f in files:
            with system.open_input_file(f.path) as source:
                head = source.read(_HEADER.size)
            if len(head) < _HEADER.size:
                raise ReadingError("InvalidRow", f"{f.base_name} is shorter than its header")
            p, n = _HEADER.unpack(head)
            if f.size != _HEADER.size + 4 * (n * p + n):
                raise ReadingError("InvalidRow", f"{f.base_name}: expected {n * p + n} numbers, found {(f.size - _HEADER.size) / 4:g}")
            step = max(1, self.partition_bytes // (4 * max(1, p)))
            out += [_Range(f.path, p, n, lo, min(n, lo + step)) for lo in range(0, n, step)]
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        step = max(1, PIECE_BYTES // (4 * max(1, part.p)))
        with system.open_input_file(part.path) as source:
            for lo in range(part.lo, part.hi, step):
                n = min(step, part.hi - lo)
                x = np.frombuffer(source.read_at(4 * n * part.p, _HEADER.size + 4 * lo * part.p), "<f4").astype(float)
                y = np.frombuffer(source.read_at(4 * n, _HEADER.size + 4 * (part.n * part.p + lo)), "<f4").astype(float)
                ends = pa.array((np.arange(n + 1) * part.p).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + n)), pa.ListArray.from_arrays(ends, pa.array(x)), pa.array(y)], names=["id", "features", "target"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        system, at = _place(self.path)
        system.create_dir(at, recursive=True)
        files, xs, ys, width = [], [], [], None

        def close() -> None:
            name = f"part-{self.job}-{uuid.uuid4().hex}.xy"
            with system.open_output_stream(f"{at}/_{name}") as out:
                out.write(_HEADER.pack(width, sum(map(len, ys))))
                for v in (*xs, *ys):
                    out.write(v.tobytes())
            files.append(name)
            xs.clear()
            ys.clear()

        for batch in batches:
            features, target = batch.column(batch.schema.get_field_index("features")), batch.column(batch.schema.get_field_index("target"))
            sizes = np.unique(np.diff(features.offsets.to_numpy()))
            if features.null_count or target.null_count or features.values.null_count or len(sizes) > 1 or width not in (None, *sizes.tolist()):
                raise ParametersError("all rows need as many features, and no nulls")
            if not batch.num_rows:
                continue
            width = int(sizes[0])
            xs.append(features.flatten().to_numpy(zero_copy_only=False).astype("<f4"))
            ys.append(target.to_numpy(zero_copy_only=False).astype("<f4"))
            if sum(v.nbytes for v in xs) >= FILE_BYTES:
                close()
        if ys:
            close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        system, at = _place(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if f.base_name.endswith(".xy") and not f.base_name.startswith("_"):
                    system.delete_file(f.path)
        for name in (n for m in messages if m for n in m.files):
            system.move(f"{at}/_{name}", f"{at}/{name}")
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Delete what attempts of this job have left that were not committed."""
        system, at = _place(self.path)
        for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith(f"_part-{self.job}-"):
                system.delete_file(f.path)


class XYSource(DataSource):
    """(id, features, target); ``id`` is the place in the file. Written rows need the columns features and target."""

    @classmethod
    def name(cls) -> str:
        return "xy"

    def schema(self) -> str:
        return "id long, features array<double>, target double"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XYSource)


def read_xy(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(id, features, target) of a file, or of all files of a folder."""
    register(spark)
    return spark.read.format("xy").options(**options).load(path)


def write_xy(df: DataFrame, path: str, features: str = "features", target: str = "target") -> None:
    """Write a table's features and target over what the folder holds."""
    register(df.sparkSession)
    from pyspark.sql import functions as F

    rows = df.select(F.lit(0).cast("long").alias("id"), F.col(features).cast("array<double>").alias("features"), F.col(target).cast("double").alias("target"))
    rows.write.format("xy").mode("overwrite").save(path)
