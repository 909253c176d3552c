"""Quality by compression: which of two dictionaries makes a text smaller.

zstandard dictionaries are trained from the good and from the bad labelled texts.
A text is compressed with each, in blocks, so that the dictionary and not the text's
own beginning decides; the difference of the two sizes over the text's length is high
where the text is more like the good ones. A logistic curve, fitted on labelled texts
that no dictionary was trained on, turns it into a probability.

Fitting uses at most ``sample_rows`` labelled texts of each class (those with the
smallest hashes of their keys): four fifths for the dictionaries, the rest, whole, for
the curve. Texts for the dictionaries are cut into windows of ``window`` characters, of
which at most ``sample_bytes`` a class reach the driver. Scoring covers every whole
text.

Defined cases: a null or empty text has difference 0 and so the curve's middle value;
labels that are null or neither 0 nor 1 are not used; with one class only, or none,
every score is the share of label 1 (0.5 without labels); repeated rows score alike;
an empty table gives no rows. Other columns are kept; an input column named like an
output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow_ops import add_columns, col, texts
from quire.session import written


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    shift: float
    level: int = 3
    block: int = 1024
    steady: int = 100


class Sizes:
    """Compressed sizes of a text under the two dictionaries."""

    def __init__(self, model: Model):
        self.block, self.steady = model.block, model.steady
        make = lambda raw: zstandard.ZstdCompressor(
            level=model.level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.good, self.bad = make(model.good), make(model.bad)

    def difference(self, text: str) -> float:
        """(bad - good) / (bytes of the text + steady), by blocks; ``steady`` keeps short
        texts, of which little is known, near the middle."""
        data = text.encode()
        if not data:
            return 0.0
        parts = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return sum(len(self.bad.compress(p)) - len(self.good.compress(p)) for p in parts) / (len(data) + self.steady)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; raw content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" " * 8


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with a small ridge."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    ridge = np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge
        w = w - np.linalg.solve(h, a.T @ (p - y) + ridge @ w)
    return float(w[0] / scale), float(w[1])


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 4000,
    sample_bytes: int = 16 << 20, window: int = 1024, dictionary_bytes: int = 112_640, level: int = 3,
) -> Model:
    """The model from the labelled rows of ``docs``."""
    key = col(id).cast("string")
    marked = labels.select(key.alias("_key"), col(label).cast("int").alias("_label")).filter("_label in (0, 1)").dropDuplicates(["_key"])
    order = F.xxhash64("_key")
    chosen = [marked.filter(F.col("_label") == y).orderBy(order, "_key").limit(sample_rows) for y in (0, 1)]
    picked = chosen[0].union(chosen[1]).withColumn("_fold", F.pmod(F.crc32(F.col("_key").cast("binary")), F.lit(5)))
    rows = docs.select(key.alias("_key"), col(text).cast("string").alias("_text")).filter("_text != ''").join(F.broadcast(picked), "_key")  # 2 * sample_rows keys
    sample = written(rows, "quality-sample")
    count = F.ceil(F.length("_text") / window).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("_text"), i * window + 1, F.lit(window)))
    windows = sample.filter("_fold != 0").select("_key", "_label", F.posexplode(pieces).alias("_n", "_part"))
    parts = {}
    for y in (0, 1):
        own = windows.filter(F.col("_label") == y).orderBy(F.xxhash64("_key", "_n"), "_key", "_n").limit(sample_bytes // (4 * window))
        parts[y] = [r["_part"].encode() for r in own.collect()]  # a character has 4 bytes at most
    n = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    flat = _flat(n.get(0, 0), n.get(1, 0), level)
    if not all(parts.values()):
        return flat
    raw = Model(_dictionary(parts[1], dictionary_bytes), _dictionary(parts[0], dictionary_bytes), 1.0, 0.0, level)
    held = score(sample.filter("_fold = 0"), raw, "_text").select("difference", "_label").toPandas()  # numbers of the sample's rows
    if held["_label"].nunique() < 2:
        return flat
    slope, shift = _logistic(held["difference"].to_numpy(float), held["_label"].to_numpy(float))
    return Model(raw.good, raw.bad, slope, shift, level)


def _flat(bad: int, good: int, level: int) -> Model:
    """Without both classes: the share of label 1 as every score."""
    share = (good + 1e-9) / (bad + good + 2e-9)
    return Model(b" " * 8, b" " * 8, 0.0, float(np.clip(np.log(share / (1 - share)), -30, 30)) if 0 < share < 1 else 30.0, level)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from ``threshold`` on) and difference,
    the normalised difference of compressed sizes."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def make():
        sizes, m = Sizes(sent.value), sent.value

        def compute(array):
            d = np.array([sizes.difference(t) for t in texts(array)])
            p = 1 / (1 + np.exp(-np.clip(m.slope * d + m.shift, -30, 30)))
            return p.tolist(), (p >= threshold).astype(int).tolist(), d.tolist()

        return compute

    return add_columns(docs, [col(text).cast("string")], "score double, predicted int, difference double", make)
