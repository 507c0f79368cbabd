"""The last lines of a log, read from its end (SRC-15): a Python data source, ``spark.read.format("log_tail")``.

Options: ``path``, a file or a folder whose files, by name, are one log; ``lines``, how many. The planner reads the end of the
last files in steps until it has seen as many line ends, so what it reads depends on the lines asked for and not on the log;
each file's range is a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STEP = 1 << 16


class Range(InputPartition):
    def __init__(self, order: int, path: str, start: int, end: int):
        super().__init__(order)
        self.order, self.path, self.start, self.end = order, path, start, end


class TailReader(DataSourceReader):
    def __init__(self, path: str, lines: int):
        self.path, self.lines, self.bytes_planned = path, lines, 0

    def _store(self):
        return pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pa.fs.LocalFileSystem(), self.path)

    def _start(self, fs, path: str, size: int, wanted: int) -> tuple[int, int]:
        """(where the last ``wanted`` lines of a file start, how many lines are found)."""
        at, ends, found = size, 0, []
        with fs.open_input_file(path) as f:
            while at > 0 and ends <= wanted:
                step = min(STEP, at)
                at -= step
                part = f.read_at(step, at)
                self.bytes_planned += step
                found.append((at, part))
                ends += part.count(b"\n") - (at + step == size and part.endswith(b"\n"))
        if ends < wanted or (ends == wanted and at == 0):
            return 0, ends + (size > 0)
        # the line feed before the first of the wanted lines
        left, last = wanted, size - 1
        for begin, part in found:
            end = len(part) - (begin + len(part) == size and part.endswith(b"\n"))
            while left and (cut := part.rfind(b"\n", 0, end)) >= 0:
                left, end, last = left - 1, cut, begin + cut
            if not left:
                break
        return last + 1, wanted

    def partitions(self) -> list[InputPartition]:
        fs, path = self._store()
        info = fs.get_file_info(path)
        files = [info] if info.is_file else sorted((x for x in fs.get_file_info(pa.fs.FileSelector(path)) if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.base_name)
        ranges, wanted = [], self.lines
        for order, f in reversed(list(enumerate(files))):
            if wanted <= 0:
                break
            if f.size:
                start, n = self._start(fs, f.path, f.size, wanted)
                ranges.append(Range(order, f.path, start, f.size))
                wanted -= n
        return ranges[::-1] or [Range(0, path, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.start >= partition.end:
            return
        fs, _ = self._store()
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.start)
            held = f.read(partition.end - partition.start)
        for i, line in enumerate(held.removesuffix(b"\n").split(b"\n")):
            yield partition.order, i, line.decode("utf-8", "replace")


class LogTail(DataSource):
    """Lines as (file int, line int, value string); ``file`` and ``line`` order them."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file int, line int, value string"

    def reader(self, schema) -> DataSourceReader:
        return TailReader(self.options["path"], int(self.options.get("lines", 200)))


def last_lines(spark: SparkSession, path: str, lines: int = 200) -> DataFrame:
    """The last lines of a log, newest first; blank ones count as lines."""
    spark.dataSource.register(LogTail)
    from pyspark.sql import functions as F

    return spark.read.format("log_tail").option("path", path).option("lines", lines).load().orderBy(F.desc("file"), F.desc("line")).select("value")
