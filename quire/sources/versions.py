"""Tables that change: folders of Parquet parts, and numbered lists of the parts that count.

``_log/<number>.json`` lists the live parts of a version. A writer adds its data in a
folder of its own, then renames the next list into place, which fails where another
writer was first; it then starts again from the version that is there. So versions are in commit order
whatever the clocks say, readers see a whole version, and a job that is lost before its commit leaves nothing that
counts. The files of a version are as many as its parts, however many documents they hold.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Part:
    """A folder below the table's, the instant of its commit (microseconds, rising with the
    versions), the hash bucket it holds (-1: rows of all), and, where its rows are patches, the
    names of the fields they set, with commas."""

    folder: str
    at: int
    bucket: int = -1
    fields: str = ""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._log = self._path(f"{self.path}/_log")
        self._files = self._log.getFileSystem(self._conf)

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def latest(self) -> tuple[int, list[Part], dict]:
        """The newest version (0: none), its parts and the table's settings."""
        if not self._files.exists(self._log):
            return 0, [], {}
        names = [s.getPath().getName() for s in self._files.listStatus(self._log)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, [], {}
        stream = self._files.open(self._path(f"{self.path}/_log/{max(numbers):020d}.json"))
        try:
            kept = json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
        return max(numbers), [Part(**p) for p in kept["parts"]], kept["settings"]

    def commit(self, base: int, parts: Sequence[Part], settings: dict) -> bool:
        """Makes ``parts`` the version after ``base``; False where there is one already."""
        draft = self._path(f"{self.path}/_log/.{uuid.uuid4().hex}")
        stream = self._files.create(draft)
        stream.write(bytearray(json.dumps({"parts": [asdict(p) for p in parts], "settings": settings}).encode()))
        stream.close()
        target = self._path(f"{self.path}/_log/{base + 1:020d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.makeQualified(self._log).toUri(), self._conf)
        try:  # without the option to overwrite
            context.rename(draft, target, self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
        except Exception as e:  # noqa: BLE001
            self._files.delete(draft, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def change(self, make: Callable[[int, list[Part], dict], tuple[Sequence[Part], dict] | None]) -> None:
        """Commits what ``make`` (number of the next part's instant, live parts, settings)
        returns, again until no other writer was first; None changes nothing."""
        while True:
            base, parts, settings = self.latest()
            at = max([time.time_ns() // 1000, *(p.at + 1 for p in parts)])
            made = make(at, parts, settings)
            if made is None or self.commit(base, *made):
                return

    def write(self, rows: DataFrame, *partition: str, **options: str) -> str:
        """Writes rows as a part that does not count yet; its folder."""
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.options(**options).partitionBy(*partition).parquet(f"{self.path}/{folder}")
        return folder

    def drop(self, folder: str) -> None:
        """Deletes a part that has never counted."""
        self._files.delete(self._path(f"{self.path}/{folder}"), True)

    def read(self, parts: Sequence[Part], schema: str) -> DataFrame:
        """The rows of some parts."""
        folders = [f"{self.path}/{p.folder}" for p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
