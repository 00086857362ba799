"""``fixedkv``: headerless files of ``[key][value]`` records of one width, as a Python data source.

Read options: ``keyBytes`` (default 8), ``valueBytes`` (default 8), ``splitBytes`` (default 64 MB),
``positions`` (``true`` adds part INT, the file's place in name order, and row BIGINT, the record's
place in its file). Any width and any size is read, but a file that is not a whole number of records
is refused. Paths, one or a list, may be files or folders; files keep the order of the paths and, in a folder, of their
names. pyarrow resolves the file system from the URI.

Write: one file a task, ``part-<partition>-<job>.dat``, so that concatenating a range-sorted write in name
order gives one sorted file. Appending adds files of another job beside those that are there. Tasks write under a name of their own attempt; the commit on the driver
renames the files of the attempts that Spark accepted, so retried or lost tasks leave nothing behind. Overwriting deletes
the former files only after that.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


def _widths(options: dict) -> tuple[int, int]:
    key, value = int(options.get("keybytes", options.get("keyBytes", 8))), int(options.get("valuebytes", options.get("valueBytes", 8)))
    if key <= 0 or value < 0:
        raise ValueError("keyBytes must be positive and valueBytes must not be negative")
    return key, value


def _option(options: dict, name: str, default: str = "") -> str:
    return options.get(name, options.get(name.lower(), default))


def _paths(options: dict) -> list[str]:
    """Spark hands over one path as it is, several as a JSON list."""
    several = _option(options, "paths")
    return json.loads(several) if several else [_option(options, "path")]


class _Split(InputPartition):
    def __init__(self, uri: str, path: str, part: int, first: int, records: int):
        self.uri, self.path, self.part, self.first, self.records = uri, path, part, first, records


def _fixed(data: memoryview, rows: int, width: int, start: int, length: int) -> pa.Array:
    """Column of ``length`` bytes at ``start`` of each record, as BINARY."""
    cut = np.frombuffer(data, np.uint8).reshape(rows, width)[:, start : start + length]
    offsets = np.arange(rows + 1, dtype=np.int32) * length
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(cut))])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.key, self.value = _widths(options)
        self.positions = _option(options, "positions", "false").lower() == "true"

    def _files(self):
        for uri in _paths(self.options):
            system, path = file_system(uri)
            info = system.get_file_info(path)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            if info.type == pafs.FileType.File:
                yield uri, info
            else:
                inside = (x for x in system.get_file_info(pafs.FileSelector(path)) if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")))
                yield from ((uri, x) for x in sorted(inside, key=lambda x: x.base_name))

    def partitions(self):
        width = self.key + self.value
        each = max(1, int(_option(self.options, "splitBytes", str(64 << 20))) // width)
        out = []
        for part, (uri, x) in enumerate(self._files()):
            rows, over = divmod(x.size, width)
            if over:
                raise ValueError(f"{x.path}: {x.size} bytes are not a whole number of {width}-byte records")
            out += [_Split(uri, x.path, part, i, min(each, rows - i)) for i in range(0, rows, each)]
        return out or [_Split("", "", 0, 0, 0)]

    def read(self, split):
        if not split.records:
            return
        system, _ = file_system(split.uri)
        width, step = self.key + self.value, max(1, (4 << 20) // (self.key + self.value))
        with system.open_input_file(split.path) as f:
            f.seek(split.first * width)
            for i in range(0, split.records, step):
                rows = min(step, split.records - i)
                data = f.read(rows * width)
                if len(data) != rows * width:
                    raise OSError(f"{split.path} became shorter while it was read")
                columns = [_fixed(data, rows, width, 0, self.key), _fixed(data, rows, width, self.key, self.value)]
                names = ["key", "value"]
                if self.positions:
                    at = split.first + i
                    columns += [pa.array(np.full(rows, split.part, np.int32)), pa.array(np.arange(at, at + rows))]
                    names += ["part", "row"]
                yield pa.RecordBatch.from_arrays(columns, names)


def _matrix(column: pa.Array, width: int) -> np.ndarray | None:
    """The bytes of a BINARY column, a row for each value; None if any is null or of another width."""
    if column.null_count or not pc.all(pc.equal(pc.binary_length(column), width)).as_py():
        return None
    if not width:
        return np.zeros((len(column), 0), np.uint8)
    _, offsets, data = column.buffers()
    begin = int(np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset])
    return np.frombuffer(data, np.uint8, len(column) * width, begin).reshape(len(column), width)


def _records(key: pa.Array, value: pa.Array, key_bytes: int, value_bytes: int) -> bytes:
    if not len(key):
        return b""
    parts = [_matrix(key, key_bytes), _matrix(value, value_bytes)]
    if any(p is None for p in parts):
        raise ValueError(f"a record must have {key_bytes} key bytes and {value_bytes} value bytes")
    return np.concatenate(parts, axis=1).tobytes()


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.key, self.value = _widths(options)
        self.path = _option(options, "path")
        self.job = uuid.uuid4().hex

    def write(self, batches):
        system, path = file_system(self.path)
        task = TaskContext.get()
        folder = f"{path.rstrip('/')}/_temporary-{self.job}"
        system.create_dir(folder, recursive=True)
        name = f"part-{task.partitionId():05d}-{self.job}.dat"
        temporary = f"{folder}/{name}-{task.taskAttemptId()}"
        with system.open_output_stream(temporary) as f:
            for batch in batches:
                f.write(_records(batch.column("key"), batch.column("value"), self.key, self.value))
        return _Written(temporary, f"{path.rstrip('/')}/{name}")

    def commit(self, messages):
        system, path = file_system(self.path)
        former = [x.path for x in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if x.type == pafs.FileType.File] if self.overwrite else []
        for m in messages:
            if m is not None:
                system.move(m.temporary, m.final)
        for x in former:
            system.delete_file(x)
        self._clean(system, path)

    def abort(self, messages):
        self._clean(*file_system(self.path))

    def _clean(self, system, path):
        folder = f"{path.rstrip('/')}/_temporary-{self.job}"
        if system.get_file_info(folder).type == pafs.FileType.Directory:
            system.delete_dir(folder)


class FixedKV(DataSource):
    @classmethod
    def name(cls):
        return "fixedkv"

    def schema(self):
        positions = _option(self.options, "positions", "false").lower() == "true"
        return "key binary, value binary" + (", part int, row bigint" if positions else "")

    def reader(self, schema: StructType):
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool):
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FixedKV)
