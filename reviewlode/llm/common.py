"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Arrow-batched row function: ``make()`` runs once a task and gives a function of one row's values to output rows.

    Rows keep no state between them, so a lost task can run again anywhere.
    """
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            for values in zip(*columns):
                out.extend(f(*values))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, struct)


def spread(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Small inputs that would be read by fewer tasks than there are cores, spread over the cores."""
    n = max(2, spark.sparkContext.defaultParallelism)
    return df.repartition(n) if df.rdd.getNumPartitions() < n / 2 else df


def words(text) -> F.Column:
    """Lower-case words (letters and marks of any script) of a text column, as an array; null and empty give an empty array."""
    return F.expr(f"filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{M}}]+'), w -> w <> '')")


_KEPT: dict[str, object] = {}


def once_a_worker(token: str, build: Callable[[], object]) -> object:
    """What ``build`` makes, kept by the worker process for later tasks of the same query; ``token`` names the query."""
    if token not in _KEPT:
        if len(_KEPT) > 8:
            _KEPT.clear()
        _KEPT[token] = build()
    return _KEPT[token]
