"""Reading tables and sizing broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; every use counts the side first.
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch sent to a Python worker, over which a batch goes by one row at most. Spark's
#: 10,000 rows of long texts would take tens of megabytes in the executor and its workers alike.
BATCH_BYTES = 4 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of at most BATCH_BYTES (and one row more).

    The limit is a session setting that holds when the result is computed, so it stays lowered."""
    spark = df.sparkSession
    have = spark.conf.get(ARROW_BYTES, None)
    if have is None or int(have.lower().rstrip("b") or 0) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """Hint a broadcast if ``df`` is counted to hold at most ``rows`` rows; else leave it to a shuffle join.

    Rows with lists count by ``weight``, the number of a row's elements, and one more."""
    if weight is None:
        held = df.limit(rows + 1).count()
    else:
        held = df.agg(F.coalesce(F.sum(weight + 1), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= rows else df


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named ``_0``, ``_1`` and so on, and the number of each name: names of the
    input then meet no name that an operator uses. ``toDF(*df.columns)`` names them back."""
    names = [f"_{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(reversed(df.columns), reversed(names), strict=True))


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """The columns named by the values, under the names of the keywords; others are not read."""
    body, at = numbered(df)
    return body.select(*[F.col(at[old]).alias(new) for new, old in columns.items()])


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` lacks."""
    name, taken = f"_{stem}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
