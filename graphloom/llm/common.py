"""Helpers that the corpus operators share: tables, the shared folder, skew-proof joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.partitions import spread
from ..functions.shared import fresh_dir, settled, shared_dir

__all__ = ["fresh_dir", "in_arrow", "join_skewed", "pieces", "settled", "shared_dir", "spread", "table", "with_row"]

#: A key is hot if it holds more than 1/HOT_PARTS of all rows; so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir, over all cores even if it is one file."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def in_arrow(df: DataFrame, schema: str | StructType, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]) -> DataFrame:
    """f over each Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(run, schema)


def with_row(batch: pa.RecordBatch, id_col: str, text_col: str) -> pa.RecordBatch:
    """A batch of whole rows in a struct `row`, with two of its fields, `id` and `text` in bytes, beside it; nothing is copied."""
    row = batch.column("row")
    return pa.RecordBatch.from_arrays([row.field(id_col), row.field(text_col).cast(pa.binary()), row], names=["id", "text", "row"])


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts come to about max_bytes (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def join_skewed(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """rows joined to facts, which has one row per key of rows and in `count` the number of rows with that key.

    facts must have the keys of which it says nothing too, with nulls, so that none of those stays hot.

    Keys with more than total/HOT_PARTS rows number fewer than HOT_PARTS, so that their facts have a
    proven bound and are broadcast; the other keys are small and are joined by a shuffle.
    """
    hot = F.col(count) > F.lit(max(1, total // HOT_PARTS))
    few = facts.where(hot).drop(count)
    rest = facts.where(~hot).drop(count)
    marked = rows.join(F.broadcast(few.select(key, F.lit(True).alias("_hot"))), key, "left")
    of_hot = marked.where("_hot").drop("_hot").join(F.broadcast(few), key, how)
    of_rest = marked.where("_hot is null").drop("_hot").join(rest, key, how)
    return of_hot.unionByName(of_rest)
