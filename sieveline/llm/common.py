"""What several operators of this package share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words are runs of anything but these characters, here as a Java character class.
SPACES = r"[\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def span_text(spans: Iterable[tuple[str, int, int]], kinds: list[str]) -> str:
    """``kind:start:end`` of spans, by start, then kind in the order of ``kinds``, comma-joined."""
    place = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], place[x[0]], x[2])))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch, with an empty one for null."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def per_batch(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one record batch to a dict of columns.

    No state goes from batch to batch, so a lost executor costs only its own tasks' work again.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = fn(b)
                if cols is not None:
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)
