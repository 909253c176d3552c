"""MinHash near-duplicates by an inverted join of signature coordinates.

1. A document's set is its distinct word shingles, as 64-bit hashes. Documents with
   equal sets (128-bit digest) form a class; only classes go on.
2. A class has ``coordinates`` min-hashes. Two classes can be linked only if at
   least ``matches`` coordinates agree; the number is chosen so that a pair at the
   similarity threshold is missed with a probability of at most ``miss``.
3. Classes are posted under (coordinate, value). Values that no other class of a
   fitting size has join nothing and are skipped. With the rarest values first, two classes with
   enough matches meet in the first ``coordinates - matches + 1`` values of both:
   only this prefix is joined.
4. Star rounds: in each posting list every class is paired with one hub (the most
   central class, later a random one). Pairs with enough matches are candidates;
   those whose estimate reaches the threshold are taken as linked for the time
   being. So a list with n close copies costs n pairs, not n^2.
5. Lists with classes that are not yet taken as linked are joined exactly: each pair in
   the first prefix value it shares, of fitting sizes, with enough matches. Classes of crowded
   lists are joined on their full sets instead, in the rarest shingles of both: a class that
   has too many shingles of its own for any link meets nobody, however many are nearly like it.
6. All candidates are confirmed on the full sets, read once from the texts of the
   classes concerned. Confirmed links make the components.
7. Where classes taken as linked turn out to be in several components, their lists are
   joined once more, for the pairs across those components, and confirmed.

No list, component or pair has a cap. Links between classes that are in one
component already add nothing to the result and are not looked for.

Defined cases: a null or empty text, or one without words, has an empty set and is
linked with nothing; a text with fewer words than a shingle is one shingle; equal
texts are one component; rows that repeat an id are one document; a row with a null id
joins a component by an equal set only and is alone otherwise; an empty table gives no
rows. Other columns are kept; an input column named like an output column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow_ops import add_columns, col, keeping, lower_ascii
from quire.session import written

#: lists of more classes are crowded
CROWD = 100
#: the counts of at most so many shingles are sent to the tasks, the most frequent ones of crowded classes
FREQUENT = 500_000
OUT = ("n_shingles", "component_id", "kept")
_SEED = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_matches(coordinates: int, similarity: float, miss: float) -> int:
    """The largest number of agreeing coordinates that a pair at ``similarity`` falls
    short of with a probability of at most ``miss``."""
    below, m = 0.0, 0
    while m < coordinates:
        below += math.comb(coordinates, m) * similarity**m * (1 - similarity) ** (coordinates - m)
        if below > miss:
            break
        m += 1
    return max(1, m)


def _set_of(words: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    n = len(words)
    if not n:
        return words
    k = min(shingle, n)
    code = np.full(n - k + 1, np.uint64(k) * np.uint64(_SEED))
    for i in range(k):
        code = _mixed(code ^ words[i : n - k + 1 + i]) + np.uint64(_SEED)
    return np.unique(code)


@lru_cache
def _multipliers(coordinates: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Min-hash of each coordinate, its number folded in, so that a value says which
    coordinate it is of."""
    out = np.full(coordinates, np.iinfo(np.uint64).max)
    odd = _multipliers(coordinates)
    for start in range(0, len(shingles), 8192):  # bounded memory for very long texts
        part = shingles[start : start + 8192]
        np.minimum(out, (part[None, :] * odd[:, None]).min(axis=1), out=out)
    return _mixed(out ^ (np.arange(coordinates, dtype=np.uint64) * np.uint64(_SEED)))


def word_hashes(text):
    """64-bit hashes of the words of the lower-cased text, in order (JVM)."""
    words = F.regexp_extract_all(F.coalesce(lower_ascii(text.cast("string")), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    return F.transform(words, lambda w: F.xxhash64(w))


def _sets(batch: pa.Array, shingle: int):
    flat = batch.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.concatenate([[0], np.cumsum(batch.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    with np.errstate(over="ignore"):
        for i in range(len(batch)):
            yield _set_of(flat[ends[i] : ends[i + 1]], shingle)


def sketched(docs: DataFrame, text: str, shingle: int, coordinates: int) -> DataFrame:
    """``docs``, without the text, with n_shingles, the set's digest, the number its class goes by (half of the
    digest) and its signature; null for an empty set."""

    def make():
        def compute(hashes):
            counts, names, digests, signatures = [], [], [], []
            for s in _sets(hashes, shingle):
                counts.append(len(s))
                with np.errstate(over="ignore"):
                    high, low = (_mixed(s ^ np.uint64(x)).sum(dtype=np.uint64) for x in (_SEED, 0x5851F42D4C957F2D))
                    names.append(int(high.view(np.int64)) if len(s) else None)
                    digests.append(high.tobytes() + low.tobytes() if len(s) else None)
                    signatures.append(_signature(s, coordinates).view(np.int64) if len(s) else None)
            return counts, names, digests, signatures

        return compute

    return add_columns(docs, [word_hashes(col(text))], "n_shingles long, _class long, _digest binary, _sig array<long>", make, drop=[text])


def with_sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    def make():
        return lambda hashes: [[s.view(np.int64) for s in _sets(hashes, shingle)]]

    return add_columns(docs, [word_hashes(col(text))], "_set array<long>", make, drop=[text])


def _agree(a, b):
    """How many coordinates of two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _fitting(a: str, b: str, percent: int):
    """Sets whose sizes alone do not rule out the similarity."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(*(col(c).alias(name if c == "_class" else f"{c}_{name}") for c in df.columns))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b): those whose full sets have the similarity."""
    joined = pairs.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b")
    both = F.size(F.array_intersect("_set_a", "_set_b")).cast("long")
    either = F.size("_set_a").cast("long") + F.size("_set_b") - both
    return joined.filter(both * 100 >= percent * either).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(_class, _comp): the smallest class that each class of the links (a, b) reaches.
    A class takes the smallest label among its own and its neighbours', then that
    label's own label, until nothing changes; each round is a written table."""
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "dedup-edges")
    labels = written(both.groupBy(F.col("a").alias("_class")).agg(F.least(F.min("b"), F.min("a")).alias("_comp")), "dedup-labels")
    while True:
        near = both.join(labels.select(F.col("_class").alias("b"), "_comp"), "b").groupBy(F.col("a").alias("_class")).agg(F.min("_comp").alias("_near"))
        step = labels.join(near, "_class").select("_class", F.col("_comp").alias("_old"), F.least("_comp", "_near").alias("_mid"))
        jump = labels.select(F.col("_class").alias("_mid"), F.col("_comp").alias("_far"))
        new = step.join(jump, "_mid").select("_class", F.col("_far").alias("_comp"), (F.col("_far") != F.col("_old")).alias("_moved"))
        new = written(new, "dedup-labels")
        labels = new.select("_class", "_comp")
        if new.filter("_moved").isEmpty():
            return labels


def _labelled(classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return classes.withColumn("_comp", F.col("_class"))
    return classes.join(labels, "_class", "left").withColumn("_comp", F.coalesce("_comp", "_class"))


def _band(percent: int):
    """Sizes in steps of the least ratio that a link allows (a thousandth wider, against
    rounding): sets that can be linked are in one band or in neighbouring ones. Bands
    end at 63, so that a long holds one bit for each."""
    step = math.log(max(100 / percent, 1.01)) * 1.001
    return F.least(F.lit(63), F.floor(F.log(F.col("_size")) / step)).cast("int")


def _bit(band):
    return F.call_function("shiftleft", F.lit(1).cast("long"), band)


def prefixes(classes: DataFrame, coordinates: int, matches: int, percent: int) -> DataFrame:
    """Per class that can have a link: its prefix, the rarest values that others of
    fitting sizes share, and its centrality, the number of times its values occur.
    ``classes`` has _size.

    What a value's list says of sizes is one long with a bit for each band that occurs:
    a class is alone in a list if no neighbouring band occurs, and its own only once."""
    postings = classes.select("_class", _band(percent).alias("_band"), F.explode("_sig").alias("_value"))
    lists = postings.groupBy("_value").agg(F.count(F.lit(1)).alias("_n"), F.bit_or(_bit(F.col("_band"))).alias("_bands"))
    doubled = F.col("_n") > F.bit_count("_bands")
    next_to = F.col("_bands").bitwiseAND(F.shiftleft("_bands", 1)) != 0
    shared = written(lists.filter(doubled | next_to), "dedup-values")
    # the bits of the bands below and above
    above = F.when(F.col("_band") < 63, _bit(F.col("_band") + 1)).otherwise(F.lit(0).cast("long"))
    below = F.when(F.col("_band") > 0, _bit(F.col("_band") - 1)).otherwise(F.lit(0).cast("long"))
    company = doubled | (F.col("_bands").bitwiseAND(above.bitwiseOR(below)) != 0)
    found = postings.join(shared, "_value").filter(company).groupBy("_class").agg(
        F.array_sort(F.collect_list(F.struct("_n", "_value"))).alias("_shared")  # one per coordinate at most
    )
    # values that no class of a fitting size shares count as the rarest: they take up places of the prefix and join nothing
    places = F.greatest(F.lit(0), F.lit(coordinates - matches + 1) - (coordinates - F.size("_shared")))
    return found.select(
        "_class", F.slice("_shared", F.lit(1), places).getField("_value").alias("_prefix"),
        F.aggregate("_shared", F.lit(0).cast("long"), lambda t, x: t + x["_n"]).alias("_centre"),
    ).filter(F.size("_prefix") > 0)


def _star_pairs(starts: DataFrame, first, percent: int, matches: int) -> DataFrame:
    """(a, b, _n): classes paired with the hub of a list they stand in, the class that is
    greatest by ``first``; _n coordinates agree. Lists of one component have no pairs.
    ``starts`` has _comp. Only numbers go through the lists; signatures join the pairs."""
    posted = starts.select("_class", "_comp", F.col("_size").cast("int"), first.alias("_first"), F.explode("_prefix").alias("_value"))
    lists = posted.groupBy("_value").agg(
        F.max(F.struct("_first", "_class", "_comp", "_size")).alias("_hub"), F.min("_comp").alias("_low"), F.max("_comp").alias("_high")
    ).filter("_low != _high").select("_value", F.col("_hub._class").alias("_hub"), F.col("_hub._comp").alias("_hub_comp"), F.col("_hub._size").cast("long").alias("_hub_size"))
    met = posted.select("_class", "_comp", F.col("_size").cast("long"), "_value").join(lists, "_value").filter("_comp != _hub_comp").filter(_fitting("_size", "_hub_size", percent))
    pairs = met.select(F.least("_class", "_hub").alias("a"), F.greatest("_class", "_hub").alias("b")).distinct()
    small = starts.select("_class", "_bytes")
    seen = pairs.join(_side(small, "a"), "a").join(_side(small, "b"), "b")
    return seen.select("a", "b", _agree(F.col("_bytes_a"), F.col("_bytes_b")).alias("_n")).filter(F.col("_n") >= matches)


def _cross_pairs(starts: DataFrame, percent: int, matches: int, within: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b): classes of different components (and, if asked, equal ``within``) that meet
    in a list that is not crowded, each pair in the first list it meets in, with enough agreeing
    coordinates; and the classes (_class) of the crowded lists. ``starts`` has _comp."""
    kept = ["_class", "_comp", "_size", "_bytes", *([within] if within else [])]
    # sets of fitting sizes meet under the greater of their bands: each is posted under its own and the next one
    posted = starts.select(
        "_class", "_comp", _band(percent).alias("_band"), F.explode("_prefix").alias("_value"),
    ).select("*", F.explode(F.array(F.col("_band"), F.col("_band") + 1)).alias("_at"))
    ends = (F.min("_comp").alias("_low"), F.max("_comp").alias("_high"), F.max("_band").alias("_top"), (F.count(F.lit(1)) > CROWD).alias("_crowded"))
    lists = posted.groupBy("_value", "_at").agg(*ends).filter("_low != _high and _top = _at").select("_value", "_at", "_crowded")
    numbers = written(posted.join(lists, ["_value", "_at"]).select("_class", "_band", "_value", "_at", "_crowded"), "dedup-lists")
    carried = starts.select(*kept, F.transform("_prefix", _short).alias("_order"))
    live = written(numbers.filter(~F.col("_crowded")).drop("_crowded").join(carried, "_class"), "dedup-rest")
    met = (
        (F.col("_value_a") == F.col("_value_b")) & (F.col("_at_a") == F.col("_at_b")) & (F.col("_at_a") == F.greatest("_band_a", "_band_b")) & (F.col("a") < F.col("b")) & (F.col("_comp_a") != F.col("_comp_b")) & _fitting("_size_a", "_size_b", percent)
        & (F.get(F.array_intersect("_order_a", "_order_b"), F.lit(0)) == _short(F.col("_value_a")))
        & (_agree(F.col("_bytes_a"), F.col("_bytes_b")) >= matches)
    )
    if within:
        met = met & (F.col(f"{within}_a") == F.col(f"{within}_b"))
    return _side(live, "a").join(_side(live, "b"), met).select("a", "b"), numbers.filter("_crowded").select("_class").distinct()


def _frequent(each: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent shingles of ``each`` (FREQUENT at most), sorted, how many classes have them, and the
    least such number that is listed. Counts are summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def out() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], names=["_value", "_n"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            waiting += len(held[-1])
            if waiting > 4_000_000:
                yield out()
                held, waiting = [], 0
        yield out()

    total = each.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    least = max(2, math.ceil(total / FREQUENT))
    found = each.select("_set").mapInArrow(run, "_value long, _n long").groupBy("_value").agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= least).toArrow()
    values, counts = (found.column(c).to_numpy() for c in ("_value", "_n"))
    by = np.argsort(values)
    return values[by], counts[by], least


def _rarest(each: DataFrame, percent: int, frequent: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """``each`` with _rarest in place of _set: the rarest shingles in which a link must meet, each with what is left
    of the set from there on. All sets have one order: by the count of a shingle, for those that are listed, and
    before them the others, by their number. So counts are sent to the tasks and not joined."""
    sent = each.sparkSession.sparkContext.broadcast(frequent[:2])
    alone = frequent[2] == 2

    def make():
        values, counts = sent.value

        def compute(sets):
            flat = sets.flatten().to_numpy(zero_copy_only=False)
            sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            n = np.zeros(len(flat), np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
                n = np.where(values[at] == flat, counts[at], 0)
            order = np.lexsort((flat, n, row))
            place = np.arange(len(flat)) - starts[row]
            chosen = place < (sizes + -sizes * percent // 100 + 1)[row]
            if alone:  # what no other class has takes up a place and is not posted
                chosen &= n[order] > 0
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[chosen], minlength=len(sizes)))])
            made = pa.StructArray.from_arrays([pa.array(flat[order][chosen]), pa.array((sizes[row] - place)[chosen])], names=["_value", "_left"])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)]

        return compute

    return add_columns(each, [F.col("_set")], "_rarest array<struct<_value: long, _left: long>>", make, drop=["_set"])


def _rare_pairs(classes: DataFrame, sets: DataFrame, percent: int, within: str | None = None) -> DataFrame:
    """(a, b): classes of different components (and, if asked, equal ``within``) that share one of the rarest shingles
    of both. Sets with the similarity have ``percent`` hundredths of the greater one in common, so they meet in
    the first ``size - that + 1`` of each; from the first shingle they share, both must have enough left. ``classes``
    has _comp and _size."""
    kept = ["_class", "_comp", "_size", *([within] if within else [])]
    each = written(classes.select(*kept).join(sets, "_class"), "dedup-shingles")
    posted = _rarest(each, percent, _frequent(each))
    posted = written(posted.select(*kept, F.inline("_rarest")), "dedup-shared")
    by = ["_value", *([within] if within else [])]
    lists = posted.groupBy(*by).agg(F.min("_comp").alias("_low"), F.max("_comp").alias("_high"), F.min("_size").alias("_least"))
    # a size above what is left for leaves no partner in the list
    live = posted.join(lists.filter("_low != _high"), by).filter(F.col("_left") * (100 + percent) >= (F.col("_size") + F.col("_least")) * percent)
    live = written(live.select(*kept, "_value", "_left"), "dedup-live")
    met = (
        (F.col("_value_a") == F.col("_value_b")) & (F.col("a") < F.col("b")) & (F.col("_comp_a") != F.col("_comp_b")) & _fitting("_size_a", "_size_b", percent)
        & (F.least("_left_a", "_left_b") * (100 + percent) >= (F.col("_size_a") + F.col("_size_b")) * percent)
    )
    if within:
        met = met & (F.col(f"{within}_a") == F.col(f"{within}_b"))
    return _side(live, "a").join(_side(live, "b"), met).select("a", "b").distinct()


def _short(value):
    return value.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("_class")).distinct()


def link_classes(classes: DataFrame, docs: DataFrame, shingle: int, percent: int, coordinates: int, miss: float, stars: int = 2) -> DataFrame | None:
    """(_class, _comp) for the classes with links, None if there are none. ``classes``
    has _class, _id and _hash of one of its documents, n_shingles and _sig; ``docs`` has
    _id, _hash and _text."""
    matches = least_matches(coordinates, percent / 100, miss)
    likely = math.ceil(percent * coordinates / 100)
    classes = classes.withColumnRenamed("n_shingles", "_size")
    starts = written(prefixes(classes, coordinates, matches, percent).join(
        classes.select(
            "_class", "_id", "_hash", "_size",
            # a byte of each coordinate agrees wherever the whole value does: no pair is lost by comparing bytes
            F.transform("_sig", lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("byte")).alias("_bytes"),
        ), "_class",
    ), "dedup-starts")
    if starts.isEmpty():
        return None
    candidates, taken = None, None
    for turn in range(stars):
        first = F.col("_centre") if turn == 0 else F.xxhash64("_class", F.lit(turn))
        found = written(_star_pairs(_labelled(starts, taken), first, percent, matches), "dedup-pairs")
        candidates = found if candidates is None else candidates.union(found)
        close = candidates.filter(F.col("_n") >= likely)
        if found.filter(F.col("_n") >= likely).isEmpty():
            break
        taken = components(close)

    grouped = _labelled(starts, taken)
    crossed, crowd = _cross_pairs(grouped, percent, matches)
    candidates = written(candidates.select("a", "b").union(crossed).distinct(), "dedup-candidates")
    wanted = starts.join(_ends(candidates).union(crowd), "_class", "left_semi").select("_id", "_hash", F.col("_class").alias("_of"))
    bodies = docs.join(wanted, ["_id", "_hash"]).dropDuplicates(["_of"])
    sets = written(with_sets(bodies, "_text", shingle).select(F.col("_of").alias("_class"), "_set"), "dedup-sets")
    if not crowd.isEmpty():
        candidates = written(candidates.union(_rare_pairs(grouped.join(crowd, "_class", "left_semi"), sets, percent)).distinct(), "dedup-candidates")
    links = written(_confirmed(candidates, sets, percent), "dedup-links")
    if links.isEmpty():
        return None
    labels = components(links)
    if taken is None:
        return labels
    # classes that were taken as linked but are in several components
    groups = _labelled(taken.withColumnRenamed("_comp", "_taken"), labels)
    split = groups.groupBy("_taken").agg(F.min("_comp").alias("_low"), F.max("_comp").alias("_high")).filter("_low != _high").select("_taken")
    again = starts.join(written(groups.join(split, "_taken"), "dedup-split"), "_class")
    more, crowd = _cross_pairs(again, percent, matches, "_taken")
    if not crowd.isEmpty():  # all classes taken as linked are ends of candidates, so their sets are there
        more = more.union(_rare_pairs(again.join(crowd, "_class", "left_semi"), sets, percent, "_taken"))
    more = more.distinct().join(candidates, ["a", "b"], "left_anti")
    found = written(_confirmed(written(more, "dedup-pairs"), sets, percent), "dedup-links")
    return labels if found.isEmpty() else components(links.union(found))


def judged(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, coordinates: int = 64, miss: float = 1e-6
) -> DataFrame:
    """One row per row of ``docs``: _id, _hash (of the text), n_shingles, component_id
    (the smallest id that links reach) and kept (the id is the component's)."""
    body = col(text).cast("string")
    slim = docs.select(col(id).cast("long").alias("_id"), body.alias("_text"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("_hash"))
    sketches = written(sketched(slim, "_text", shingle, coordinates), "dedup-sketches")
    rows = sketches.select("_id", "_hash", "n_shingles", "_class")
    # two different sets go by one number in n^2 / 2^65 of all cases; one of them would then stand for both
    whole = F.struct("_digest", "_id", "_hash", "n_shingles", "_sig")
    one = sketches.filter("_class is not null and _id is not null").groupBy("_class").agg(F.min(whole).alias("_one"))
    classes = written(one.select("_class", "_one.*"), "dedup-classes")
    labels = link_classes(classes, slim, shingle, percent, coordinates, miss)
    names = classes.select("_class", F.col("_id").alias("_least"))
    if labels is not None:
        linked = labels.join(names, "_class")
        smallest = linked.groupBy("_comp").agg(F.min("_least").alias("_reached"))
        names = names.join(linked.join(smallest, "_comp").select("_class", "_reached"), "_class", "left")
        names = names.select("_class", F.coalesce("_reached", "_least").alias("_least"))
    component = F.coalesce("_least", "_id")
    return rows.join(written(names, "dedup-components"), "_class", "left").select(
        "_id", "_hash", "n_shingles", component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept")
    )


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with n_shingles, component_id and kept; links are pairs of documents whose
    shingle sets have a Jaccard similarity of ``percent`` hundredths or more."""
    passed = keeping(docs, OUT)
    verdicts = judged(docs, id, text, **settings).dropDuplicates(["_id", "_hash"])
    verdicts = verdicts.withColumnsRenamed({"_id": "_dedup_id", "_hash": "_dedup_hash"})
    keyed = docs.select(
        *(col(c) for c in passed), col(id).cast("long").alias("_dedup_key"), F.xxhash64(F.coalesce(col(text).cast("string"), F.lit(""))).alias("_dedup_text")
    )
    return keyed.join(
        verdicts, F.col("_dedup_key").eqNullSafe(F.col("_dedup_id")) & (F.col("_dedup_text") == F.col("_dedup_hash")),
    ).select(*(col(c) for c in passed), *OUT)
