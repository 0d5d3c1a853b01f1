"""Growing text files as a stream of lines, by byte offset.

The stream's offset is a map of file and the byte after its last whole line. A batch gets the ranges between two such maps, cut
into parts of ``part_bytes``, or larger ones where there would be over ``parts`` (a task each), and reads them on executors,
a piece at a time; a line without its end waits for the next batch. A file
that became shorter was replaced and is read from its start. Paths are those that PyArrow's file systems open, from the
driver and from executors.
"""

from __future__ import annotations

import io
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, position long, line string"
NAMES = ["file", "position", "line"]
BLOCK, PIECE = 1 << 16, 4 << 20


def whole_lines(files: fs.FileSystem, path: str, size: int) -> int:
    """The byte after the last line feed among the first ``size`` bytes."""
    with files.open_input_file(path) as f:
        end = size
        while end > 0:
            begin = max(0, end - BLOCK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


class TailSource(DataSource):
    """``spark.readStream.format("tail_lines").option("path", folder).option("names", regex).load()``"""

    @classmethod
    def name(cls):
        return "tail_lines"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return TailReader(self.options)


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.names = options["path"], options.get("names", r".*\.(txt|log)$")
        self.part_bytes, self.parts = int(options.get("part_bytes", 64 << 20)), int(options.get("parts", 256))

    def initialOffset(self):
        return {}

    def latestOffset(self):
        files, top = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        return {x.path: whole_lines(files, x.path, x.size) for x in found if x.is_file and re.search(self.names, x.path)}

    def partitions(self, start, end):
        fresh = [(path, start.get(path, 0) if start.get(path, 0) <= stop else 0, stop) for path, stop in sorted(end.items())]
        size = max(self.part_bytes, -(-sum(stop - begin for _, begin, stop in fresh) // self.parts))
        return [InputPartition((path, begin, a, min(a + size, stop))) for path, begin, stop in fresh for a in range(begin, stop, size)]

    def read(self, partition):
        path, begin, a, b = partition.value
        files, _ = fs.FileSystem.from_uri(self.path)
        with io.BufferedReader(files.open_input_file(path)) as f:
            f.seek(max(begin, a - 1))
            if a > begin:
                f.readline()  # ends at or after a: the part before has it
            at = f.tell()
            while at < b and (lines := f.readlines(min(PIECE, b - at))):
                ends = list(accumulate(map(len, lines), initial=at))
                n = bisect_left(ends, b, hi=len(lines))  # lines that begin before b
                texts = [x.rstrip(b"\r\n").decode("utf-8", "replace") for x in lines[:n]]
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(ends[:n], pa.int64()), pa.array(texts)], NAMES)
                at = ends[-1]

    def commit(self, end):
        pass


def tail(spark, path: str, **options):
    """(file, position, line) of lines as they are completed."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail_lines").option("path", path).options(**options).load()
