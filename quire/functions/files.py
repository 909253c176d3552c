"""File names, file kinds and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.base import js_trim, squash


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.[^.]+\z", 0))


def file_kind(name: Column) -> Column:
    ext = extension(name)
    return (
        F.when(ext == ".pdf", "pdf")
        .when(ext.isin(fv.OFFICE_EXTENSIONS), "office")
        .when(ext.isin(fv.IMAGE_EXTENSIONS), "image")
        .when(ext.isin(fv.MARKDOWN_EXTENSIONS), "markdown")
        .otherwise("other")
    )


def magic_kind(content: Column) -> Column:
    """Kind of a file by its leading bytes."""
    head = F.hex(F.substring(content, 1, 12))
    chain = F.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "WEBP")
    for kind, offset, mark in fv.MAGIC:
        chain = chain.when(F.substring(head, 2 * offset + 1, len(mark)) == mark, kind)
    return chain.otherwise("unknown")


def strip_source_extension(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), fv.SOURCE_EXTENSION, "")


def safe_entry_name(name: Column, fallback: Column) -> Column:
    clean = F.regexp_replace(strip_source_extension(name), r"[/\\]", "_")
    clean = F.regexp_replace(clean, r"[:*?\"<>|\x00-\x1f]", "_")
    clean = js_trim(F.regexp_replace(clean, r"^\.+", ""))
    return F.coalesce(F.nullif(clean, F.lit("")), fallback)


def record_title(filename: Column, ai_title: Column, meaningful: Column) -> Column:
    """Shown name: the model's title when it called the file name meaningless."""
    title = js_trim(F.coalesce(ai_title, F.lit("")))
    stem = js_trim(squash(F.regexp_replace(strip_source_extension(filename), r"_+", " ")))
    return F.when((meaningful == F.lit(False)) & (title != ""), title).otherwise(stem)


def download_name(filename: Column, ai_title: Column, meaningful: Column, day: Column, ext: str) -> Column:
    clean = lambda c: F.left(js_trim(squash(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\\/:*?\"<>|]", ""))), F.lit(80))
    stem, title = clean(strip_source_extension(filename)), clean(ai_title)
    name = (
        F.when((meaningful == F.lit(False)) & (title != ""), title)
        .when(stem != "", stem)
        .when(title != "", title)
        .otherwise("document")
    )
    return F.concat(name, F.lit(" "), day, F.lit(f".{ext}"))


def natural_key(name: Column) -> Column:
    """Sort key with numbers by value: ``IMG_2`` before ``IMG_10``. A number stands behind
    the count of its digits, so it may have any length."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda p: F.ltrim(p, F.lit("0"))
    sized = lambda p: F.concat(F.lpad(F.length(number(p)).cast("string"), 10, "0"), number(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), sized(p)).otherwise(p)), "")


def decode_part_name(name: Column) -> Column:
    """Upload part ``0007-<encoded name>`` as (index, name)."""
    index = F.coalesce(F.substring(name, 1, 4).try_cast("int"), F.lit(0))
    raw = F.substr(name, F.lit(6))
    # "+" is literal here, unlike in a form-encoded string
    plain = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.struct(index.alias("index"), F.coalesce(plain, raw).alias("name"))


def safe_link(href: Column) -> Column:
    """Address fit for a link: an anchor or an absolute http(s)/mailto one."""
    value = js_trim(F.coalesce(href, F.lit("")))
    scheme = F.lower(F.regexp_extract(F.regexp_replace(value, r"[\t\n\r]", ""), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    absolute = F.when(scheme == "mailto", F.lit(True)).otherwise(
        F.regexp_replace(value, r"[\t\n\r]", "").rlike(r"^[A-Za-z]+:[/\\]*[^/\\?#\s]+")
    )
    return F.when(value.rlike(fv.ANCHOR), value).when(scheme.isin(fv.SAFE_PROTOCOLS) & absolute, value)


def safe_image(src: Column) -> Column:
    value = js_trim(F.coalesce(src, F.lit("")))
    return F.when(value.rlike(fv.INLINE_BITMAP), value)


def escape_html(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def foreign_reason(host: Column, origin: Column, port: int) -> Column:
    """Why a request does not come from this machine; NULL when it does."""
    own = [f"127.0.0.1:{port}", f"localhost:{port}", f"[::1]:{port}"]
    shown = F.coalesce(host, F.lit(""))
    return F.when(~F.lower(shown).isin(own), F.concat(F.lit("Host「"), shown, F.lit("」不是本机地址"))).when(
        origin.isNotNull() & ~origin.rlike(fv.LOCAL_ORIGIN), F.concat(F.lit("来源「"), origin, F.lit("」不是本机页面"))
    )


def split_keys(value: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"[\n,]+"), js_trim)
    return F.filter(parts, lambda k: k != "")


def masked_key(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("•" * 8), F.right(value, F.lit(4))))


def merge_keys(entries: Column, previous: Column, keep: str = "__KEEP__") -> Column:
    """Key list of a save request. ``keep:index:suffix`` stands for a stored key:
    the one at that index when its last four characters agree, else the only
    stored key ending so. Duplicates and blanks go; NULL keeps the stored list."""
    stored = split_keys(previous)

    def resolve(entry: Column, position: Column) -> Column:
        part = F.split(entry, ":")
        suffix = F.get(part, F.lit(2))
        at = F.get(stored, F.coalesce(F.get(part, F.lit(1)).try_cast("int"), F.lit(-1)))
        same = F.filter(stored, lambda k: F.right(k, F.lit(4)) == suffix)
        kept = F.when(F.right(at, F.lit(4)) == suffix, at).when(F.size(same) == 1, F.get(same, F.lit(0)))
        return F.when(entry == keep, F.get(stored, position)).when(F.startswith(entry, F.lit(keep + ":")), kept).otherwise(entry)

    merged = F.transform(F.transform(entries, js_trim), resolve)
    clean = F.array_distinct(F.filter(merged, lambda k: k.isNotNull() & (k != "")))
    return F.when(entries.isNull(), stored).otherwise(clean)


def key_rejected(status: Column, message: Column) -> Column:
    return status.isin(401, 403) | ((status == 400) & message.rlike(r"(?i)API key not valid|API_KEY_INVALID"))
