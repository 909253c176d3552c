"""Exports: ZIP archives, merged Markdown, document files, reports.

Nothing is gathered on the driver: every task writes its own part, and a part
becomes visible when the write commits.
"""

from __future__ import annotations

import os
import uuid
import zipfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quire.operators.pages import page_sections

# entries ----------------------------------------------------------------


@dataclass
class _Part(WriterCommitMessage):
    temporary: str | None
    final: str | None
    entries: int


class ZipSource(DataSource):
    """``df.write.format("quire_zip").save(folder)`` for (name, content, updated_at)
    rows: one archive per task, UTF-8 names, compressed where that helps."""

    @classmethod
    def name(cls) -> str:
        return "quire_zip"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ZipWriter(self.options["path"], schema.fieldNames())


class ZipWriter(DataSourceWriter):
    def __init__(self, folder: str, columns: list[str]):
        self.folder, self.columns = folder.removeprefix("file:"), columns

    def write(self, iterator) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        token = uuid.uuid4().hex
        temporary = os.path.join(self.folder, f"_{token}.tmp")
        count = 0
        with zipfile.ZipFile(temporary, "w") as archive:
            for row in iterator:
                values = dict(zip(self.columns, row))
                raw = values["content"]
                data = bytes(raw) if isinstance(raw, (bytes, bytearray)) else raw.encode()
                at = values.get("updated_at")
                stamp = (max(1980, at.year), at.month, at.day, at.hour, at.minute, at.second) if at else (1980, 1, 1, 0, 0, 0)
                info = zipfile.ZipInfo(values["name"], stamp)
                # tiny texts grow when compressed
                info.compress_type = zipfile.ZIP_DEFLATED if len(data) > 64 else zipfile.ZIP_STORED
                archive.writestr(info, data)
                count += 1
        if not count:
            os.remove(temporary)
            return _Part(None, None, 0)
        return _Part(temporary, os.path.join(self.folder, f"part-{token}.zip"), count)

    def commit(self, messages) -> None:
        for part in messages:
            if part and part.temporary:
                os.replace(part.temporary, part.final)

    def abort(self, messages) -> None:
        for part in messages:
            if part and part.temporary and os.path.exists(part.temporary):
                os.remove(part.temporary)


def write_zip(entries: DataFrame, folder: str, archives: int | None = None) -> None:
    """``entries``: name, content and optionally updated_at. ``folder`` must be one
    every executor reaches. ``archives`` sets how many files are written."""
    spark: SparkSession = entries.sparkSession
    spark.dataSource.register(ZipSource)
    parts = entries.repartition(archives) if archives else entries
    parts.write.format("quire_zip").mode("append").save(folder)


def checksums(entries: DataFrame, content: Column) -> DataFrame:
    return entries.withColumn("crc32", F.crc32(F.encode(content, "UTF-8")))


# Markdown -----------------------------------------------------------------


def merged_parts(documents: DataFrame, order: list[Column], label: str = "来源文件") -> DataFrame:
    """Text blocks of a merged file, in order: a source comment before each
    document, a rule between two. ``documents``: filename, markdown."""
    # the first row of a sorted table has the number 0
    rule = F.when(F.monotonically_increasing_id() == 0, "").otherwise("\n---\n\n")
    block = F.concat(rule, F.lit(f"<!-- {label}："), F.col("filename"), F.lit(" -->\n\n"), F.col("markdown"))
    return documents.orderBy(*order).select(block.alias("value"))


def write_merged(documents: DataFrame, order: list[Column], folder: str) -> None:
    """Merged Markdown as ordered text parts; read by name they are one file."""
    merged_parts(documents, order).write.mode("overwrite").text(folder)


def write_documents(pages: DataFrame, folder: str) -> None:
    """Document files as sorted page sections, written without holding a document:
    one folder per document and thousand pages, sections in page order."""
    ranged = page_sections(pages).withColumn("from_page", F.floor(F.col("page") / 1000) * 1000)
    (
        ranged.repartition("job_id", "from_page")
        # starts with the partition columns, so the writer keeps this order
        .sortWithinPartitions("job_id", "from_page", "page")
        .select("job_id", "from_page", F.col("section").alias("value"))
        .write.mode("overwrite").partitionBy("job_id", "from_page").text(folder)
    )


def write_reports(documents: DataFrame, folder: str) -> None:
    """Quality reports: one JSON object per line."""
    documents.write.mode("overwrite").json(folder)


def append_calls(calls: DataFrame, folder: str) -> None:
    """Adds ledger rows, laid out by day so that period queries read only theirs."""
    calls.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(folder)
