"""Binary files of points as a Spark data source that reads ranges of bytes.

A file is cut into ranges, each a task's, so one large file is read by many tasks,
none of which holds more than a batch of it. Only the files' names and sizes are
looked at when the read is planned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a point, of a range, and of what a task holds at once.
POINT, RANGE_BYTES, BATCH_BYTES = 8, 2**26, 2**22


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """Bytes of a file, and how many points are before it in its file and in the files before that."""

    path: str
    first: int
    last: int
    before: int


class PointsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.scale = options["path"], int(options.get("scale", 10))
        self.range_bytes = max(int(options.get("range_bytes", RANGE_BYTES)) // POINT, 1) * POINT

    def partitions(self) -> list[Range]:
        store, root = _opened(self.path)
        found = store.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else [f for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name[0] not in "._"]
        ranges, before = [], 0
        for f in sorted(files, key=lambda f: f.path):
            if f.size % POINT:
                raise ValueError(f"{f.path} ends within a point: {f.size} bytes")
            ranges += [Range(f.path, at, min(at + self.range_bytes, f.size), before) for at in range(0, f.size, self.range_bytes)]
            before += f.size // POINT
        return ranges or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, _ = _opened(self.path)
        with store.open_input_file(part.path) as f:
            for at in range(part.first, part.last, BATCH_BYTES):
                f.seek(at)
                yx = np.frombuffer(f.read(min(BATCH_BYTES, part.last - at)), ">i4").reshape(-1, 2)
                own = np.arange(at // POINT, at // POINT + len(yx))
                keep = own % 10 < self.scale
                columns = [own[keep] + part.before, yx[keep, 1].astype(float), yx[keep, 0].astype(float)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pos", "x", "y"])


class BinaryPoints(DataSource):
    """`binary_points`: a file or a folder of files of big-endian int32 pairs y, x."""

    @classmethod
    def name(cls) -> str:
        return "binary_points"

    def schema(self) -> str:
        return "pos long, x double, y double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PointsReader(self.options)


def read_points(spark: SparkSession, path: str, scale: int = 10, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(pos, x, y) from big-endian int32 pairs y, x; of every ten points of a file the first `scale` stay.

    pos counts all points from 0, over the files in the order of their names, also
    those that don't stay. A file that ends within a point fails the read; empty
    files and folders give no rows. The path is a local one or a URI of a store
    that pyarrow can open (file, hdfs, viewfs, s3, gs, ...).
    """
    spark.dataSource.register(BinaryPoints)
    return spark.read.format(BinaryPoints.name()).option("scale", scale).option("range_bytes", range_bytes).load(path)
