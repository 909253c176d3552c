"""The library as one object: each call returns a lazily computed DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.operators import ledger, library, pages, reflect, search
from quire.sources import sinks


class Library:
    """``jobs``, ``pages`` and ``calls`` as described in the README; ``pages`` holds
    final pages with at least job_id, page and markdown."""

    def __init__(self, jobs: DataFrame, page_rows: DataFrame, calls: DataFrame | None = None):
        self.jobs, self.pages, self.calls = jobs, page_rows, calls

    @property
    def done(self) -> DataFrame:
        return self.jobs.filter(F.col("status") == "done")

    def _done_pages(self) -> DataFrame:
        ids = self.done.select(F.col("id").alias("_id"))
        return self.pages.join(ids, F.col("job_id").cast("string") == F.col("_id"), "left_semi")

    # listings ---------------------------------------------------------------
    def listing(self, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
        return library.listing(library.in_day_range(self.done, since, until), limit)

    def list_jobs(self, limit: int = fv.BATCH_LIMIT) -> DataFrame:
        return library.listing(self.jobs, limit)

    def document(self, job_id: str) -> tuple[DataFrame, DataFrame]:
        """One job's row and its pages in order."""
        rows = self.pages.filter(F.col("job_id").cast("string") == F.lit(str(job_id)))
        return self.jobs.filter(F.col("id") == F.lit(str(job_id))), rows.orderBy("page")

    def batches(self, limit: int | None = fv.BATCH_LIMIT) -> DataFrame:
        return library.batch_summary(self.jobs, limit)

    def batch(self, batch_id: str) -> DataFrame:
        return self.jobs.filter(F.col("batch_id") == F.lit(batch_id)).orderBy("created_at", "id")

    def delete(self, ids: DataFrame) -> DataFrame:
        return library.without(self.jobs, ids)

    # search -----------------------------------------------------------------
    def search(self, query: str) -> tuple[DataFrame, DataFrame]:
        """Ranked documents, and their first hits with context."""
        rows = self._done_pages()
        return search.search(rows, query), search.search_hits(rows, query)

    def word_search(self, words: Sequence[str], match_any: bool = False, since: str | None = None, until: str | None = None, limit: int = fv.WORD_LIMIT) -> DataFrame:
        return search.top_scores(search.word_search(library.in_day_range(self.done, since, until), self._done_pages(), words, match_any), limit)

    def resolve(self, refs: DataFrame) -> DataFrame:
        return search.resolve_prefixes(self.done.select("id"), refs)

    def hits(self, job_id, word: str, limit: int = fv.WORD_LIMIT) -> DataFrame:
        return search.word_hits(self._one(job_id), word, limit).orderBy("n")

    def read(self, job_id, page: int | None = None, at: str | None = None, chars: int = fv.READ_CHARS) -> DataFrame:
        return search.read_window(self._one(job_id), at, chars) if at else search.read_page(self._one(job_id), job_id, page or 1, chars)

    def outline(self, job_id) -> DataFrame:
        return search.outline(self._one(job_id)).orderBy("n")

    def _one(self, job_id) -> DataFrame:
        return self.pages.filter(F.col("job_id") == F.lit(job_id))

    def find(self, question: str, ask: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
        return search.find(question, self.done, ask)

    # statistics ---------------------------------------------------------------
    def stats(self) -> dict[str, DataFrame]:
        d = self.done
        return {"totals": library.totals(d), "timeline": library.daily(d), "top_tags": library.top_tags(d), "by_mode": library.by_mode(d)}

    def months(self) -> DataFrame:
        return library.months(self.done)

    def speed(self) -> DataFrame:
        return library.speed_table(self.done)

    def quality(self) -> DataFrame:
        return library.quality_counts(self.done)

    def causes(self) -> DataFrame:
        return pages.failure_causes(self.pages)

    def usage(self, now: datetime) -> dict[str, DataFrame]:
        at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
        c = self.calls
        return {
            "totals": ledger.usage_totals(c, at), "by": ledger.usage_by_dimension(c, at), "daily": ledger.usage_daily(c, at),
            "unpriced_models": ledger.unpriced_models(c), "refine_cost_per_page": ledger.refine_cost_per_page(c, at),
        }

    def reflect(self, period: str, now: datetime, tz: str = "UTC") -> dict[str, DataFrame]:
        return reflect.report(self.done, period, now, tz)

    # exports ------------------------------------------------------------------
    def export_zip(self, folder: str, documents: DataFrame, archives: int | None = None) -> None:
        """``documents``: job_id, markdown. Names as in the library, repeats numbered."""
        names = library.unique_entry_names(self.done).select(F.col("id"), F.col("entry").alias("name"))
        docs = documents.select(F.col("job_id").cast("string").alias("id"), F.col("markdown").alias("content"))
        stamps = self.done.select("id", F.col("updated_at").cast("timestamp").alias("updated_at"))
        sinks.write_zip(docs.join(names, "id").join(stamps, "id").select("name", "content", "updated_at"), folder, archives)
