"""Adding computed columns to rows in Arrow batches, for the operators that work in numpy.

Every operator keeps the columns of its input. An input column whose name (in
any case) is that of an output column is replaced by the output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: words of a text: everything between ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """A column by its plain name, also when that has dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def fields(ddl: str) -> list[T.StructField]:
    return list(T.StructType.fromDDL(ddl).fields)


def keeping(df: DataFrame, outputs: Sequence[str]) -> list[str]:
    """The input columns that an operator with these outputs passes on."""
    taken = {o.lower() for o in outputs}
    return [c for c in df.columns if c.lower() not in taken]


def slices(batch: pa.RecordBatch, sizes: Sequence[int], most: int) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of about ``most`` characters, one row at least."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def add_columns(
    df: DataFrame, inputs: Sequence[Column], ddl: str, make: Callable[[], Callable[..., Sequence[pa.Array]]], most: int = 4_000_000,
    drop: Sequence[str] = (),
) -> DataFrame:
    """``df``, without the columns ``drop``, with the columns of ``ddl``. ``make`` runs once in each task and
    returns a function from the Arrow arrays of ``inputs`` (the first one a
    string, or a list of 64-bit numbers) to the arrays of the new columns; it sees
    about ``most`` bytes of the first at a time, so memory is bounded by that or by
    the longest row. Workers serve many tasks: what a batch took is given back."""
    new = fields(ddl)
    kept = keeping(df, [*drop, *(f.name for f in new)])
    schema = T.StructType([*(df.schema[c] for c in kept), *new])
    target = to_arrow_schema(T.StructType(new))
    width = len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        pool = pa.default_memory_pool()
        for whole in batches:
            first = whole.column(0)
            lengths = pa.compute.multiply(pa.compute.list_value_length(first), 8) if pa.types.is_list(first.type) else pa.compute.binary_length(first)
            lengths = pa.compute.fill_null(lengths, 0).to_pylist()
            for batch in slices(whole, lengths, most):
                made = compute(*(batch.column(i) for i in range(width)))
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(made, target, strict=True)]
                arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, target, strict=True)]
                rest = [batch.column(i) for i in range(width, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, *arrays], names=[*kept, *(f.name for f in new)])
                del batch, made, arrays, rest
            del whole, first
            pool.release_unused()

    import pyarrow.compute  # noqa: F401, PLC0415

    source = df.select(*(c.alias(f"_input_{i}") for i, c in enumerate(inputs)), *(col(c) for c in kept))
    return source.mapInArrow(run, schema)


def texts(array: pa.Array) -> list[str]:
    """Strings of an Arrow column; null is the empty text."""
    return [t or "" for t in array.to_pylist()]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text: str) -> str:
    """``text`` with A-Z in lower case and all else as it is."""
    return text.encode().lower().decode()  # bytes have ASCII letters only
