"""A streaming source of the lines of files that grow.

The offset is a map from file to byte position. A trigger reads what each file has gained
up to its last line feed; a line that is still being written waits for the next one. A file that
has become shorter is read again from its start. Ranges are cut in splits, so a large
file is read by many tasks; a line belongs to the split it starts in. Rows carry their file and the byte at
which they start, which orders lines in the way they were written.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").option("suffix", ".jsonl").load(folder)

Options: ``suffix`` of file names; ``exclude``, line feed separated parts of paths to leave out;
``maxAgeDays``, files not written to for so long are passed over (none: all are read);
``splitBytes``. The folder may be any URI that pyarrow's file systems open.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

BLOCK = 1 << 16


@dataclass
class Range(InputPartition):
    """Bytes ``start`` to ``end`` of a file; ``begins``: a line starts at ``start``."""

    path: str
    start: int
    end: int
    begins: bool


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, position long, value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingReader(dict(self.options))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.suffix = options.get("suffix", "")
        self.exclude = [x for x in options.get("exclude", "").split("\n") if x]
        self.max_age = float(options["maxagedays"]) if options.get("maxagedays") else None
        self.split = int(options.get("splitbytes") or 64 << 20)
        self._seen: dict[str, tuple[int, int, int]] = {}  # size, time and end of the last line of files

    def initialOffset(self) -> dict:
        return {}

    def _files(self, store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return [
            f for f in found if f.type == fs.FileType.File and f.base_name.endswith(self.suffix) and not f.base_name.startswith(("_", "."))
            and not any(x in f.path for x in self.exclude)
        ]

    def latestOffset(self) -> dict:
        store, folder = file_system(self.folder)

        def end(f: fs.FileInfo) -> int:
            known = self._seen.get(f.path)
            if known is None or known[:2] != (f.size, f.mtime_ns):
                known = self._seen[f.path] = (f.size, f.mtime_ns, last_line_end(store, f.path, f.size))
            return known[2]

        files = self._files(store, folder)
        with ThreadPoolExecutor(16) as pool:
            return dict(zip((f.path for f in files), pool.map(end, files), strict=True))

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        old = set()
        if self.max_age is not None:
            store, folder = file_system(self.folder)
            least = (time.time() - self.max_age * 86400) * 1e9
            old = {f.path for f in self._files(store, folder) if f.mtime_ns < least}
        out = []
        for path, upto in sorted(end.items()):
            begin = start.get(path, 0)
            begin = 0 if begin > upto else begin
            if path not in old:
                out += [Range(path, a, min(a + self.split, upto), a == begin) for a in range(begin, upto, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.folder)
        try:
            with store.open_input_file(partition.path) as f:
                yield from lines(f, partition)
        except FileNotFoundError:
            return  # the file has gone since


def last_line_end(store: fs.FileSystem, path: str, size: int) -> int:
    """The byte behind the last line feed of a file; 0 where there is none."""
    try:
        with store.open_input_file(path) as f:
            while size > 0:
                a = max(0, size - BLOCK)
                f.seek(a)
                at = f.read(size - a).rfind(b"\n")
                if at >= 0:
                    return a + at + 1
                size = a
    except FileNotFoundError:
        pass
    return 0


def lines(f, part: Range) -> Iterator[pa.RecordBatch]:
    """The lines that start in a range, in batches."""
    at = part.start if part.begins else part.start - 1
    f.seek(at)
    rest, skip = b"", not part.begins
    while at < part.end:
        block = f.read(4 << 20)
        data = rest + block
        found = data.split(b"\n")
        rest = found.pop()
        if not block:
            found, rest = ([rest] if rest else []), b""  # the file is shorter than it was
        values, positions = [], []
        for line in found:
            if skip:
                skip = False
            elif at < part.end:
                values.append(line.decode("utf-8", "replace"))
                positions.append(at)
            at += len(line) + 1
        if values:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.path] * len(values)), pa.array(positions, pa.int64()), pa.array(values)], names=["path", "position", "value"])
        if not block:
            return
