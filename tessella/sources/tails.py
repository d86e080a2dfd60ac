"""A data source that reads line logs from their ends: the last model that each file names, without reading the file.

``spark.dataSource.register(TailModels)`` once, then ``spark.read.format("tail_models").load(folder)``. Each file is read backwards in blocks until
a line has what is looked for, so a long log costs one block. Files are listed and opened through Arrow's file systems, so a path may
be a local folder that all executors share, or one of the stores that Arrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Bytes read at once from the end of a file, and bytes after which nothing more is looked for.
BLOCK_BYTES = 256 * 1024
MOST_BYTES = 4 * 1024 * 1024
# What opening a file counts as, so that many short files are not one task's.
OPEN_BYTES = 16 * 1024


def _no_number(name: str):
    raise ValueError(name)


def model_of(line: bytes) -> str | None:
    """The text at message.model of a line that is a JSON object, if it is not empty."""
    if b'"model"' not in line:
        return None
    try:
        entry = json.loads(line.decode(errors="replace"), parse_constant=_no_number)
    except (ValueError, RecursionError):
        return None
    message = entry.get("message") if isinstance(entry, dict) else None
    model = message.get("model") if isinstance(message, dict) else None
    return model if isinstance(model, str) and model else None


def last_of(size: int, read_at: Callable[[int, int], bytes], find: Callable[[bytes], str | None] = model_of, block: int = BLOCK_BYTES, most: int = MOST_BYTES) -> tuple[str | None, int]:
    """(what ``find`` gives for the last line that has it, bytes read) of a file of ``size`` bytes, from its end on.

    A line is looked at once the block that holds its begin is read: the first piece of what has been read may be the end of a longer line.
    """
    left, seen, head = size, 0, b""
    while left > 0 and seen < most:
        n = min(block, left)
        left, seen = left - n, seen + n
        lines = (read_at(left, n) + head).split(b"\n")
        head = lines.pop(0) if left else b""
        for line in reversed(lines):
            if line and (found := find(line)):
                return found, seen
    return None, seen


def write_logs(lines: DataFrame, folder: str, order: str) -> None:
    """A file ``series_id=<series_id>.txt`` of lines (series_id, line, ``order``) for each series, in order, in a folder that all executors share.

    A task writes its series one after another through Arrow's file systems and holds one line. A file has its name once it is whole; a task that runs again
    writes the same files again. Spark's own writer, with a folder for each series, makes, commits and renames two objects for each.
    """

    def run(rows: Iterator[Row]) -> None:
        system, root = arrow_fs.FileSystem.from_uri(folder)
        for series, own in groupby(rows, key=lambda r: r[0]):
            part = f"{root}/.{uuid.uuid4()}"
            with system.open_output_stream(part) as file:
                for row in own:
                    file.write(((row[1] or "") + "\n").encode())
            system.move(part, f"{root}/series_id={'none' if series is None else series}.txt")

    system, root = arrow_fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    dealt = lines.select("series_id", "line", order).repartition(F.xxhash64("series_id")).sortWithinPartitions("series_id", order)
    dealt.select("series_id", "line").foreachPartition(run)


class _Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        super().__init__(paths)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.block = int(options.get("block_bytes", BLOCK_BYTES))
        self.most = int(options.get("most_bytes", MOST_BYTES))
        self.share = int(options.get("partition_bytes", 64 * BLOCK_BYTES))
        if self.block < 1 or self.most < 1:
            raise ValueError("block_bytes and most_bytes must be above zero")

    def partitions(self) -> list[_Files]:
        """Files in turn, until a partition could have ``partition_bytes`` to read."""
        system, root = arrow_fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(arrow_fs.FileSelector(root, recursive=True))
        out, held, cost = [], [], 0
        for file in sorted((f for f in found if f.is_file and f.size and f.base_name[0] not in "._"), key=lambda f: f.path):
            held.append((file.path, file.size))
            cost += min(max(file.size, OPEN_BYTES), self.block)
            if cost >= self.share:
                out.append(_Files(held))
                held, cost = [], 0
        return [*out, _Files(held)] if held or not out else out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = arrow_fs.FileSystem.from_uri(self.path)
        rows = []
        for path, size in partition.value:
            with system.open_input_file(path) as file:
                model, seen = last_of(size, lambda at, n: file.read_at(n, at), block=self.block, most=self.most)
            rows.append((path, model, seen))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["file", "model", "bytes_read"])


class TailModels(DataSource):
    """(file, model, bytes_read) for each file below the path; model is null where no line within the last ``most_bytes`` names one.

    Options: block_bytes, most_bytes, partition_bytes. Lines that are no JSON, and those cut off at either end of what is read, are passed over;
    empty files and those whose name begins with a dot or an underscore are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "tail_models"

    def schema(self) -> str:
        return "file string, model string, bytes_read long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
