"""Helpers of the training-text operators: tables, free column names, and lineage cuts."""

from __future__ import annotations

import contextlib
import functools
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolemeter.operators.layout import stored
from rolemeter.session import ship


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, with the package sent along."""

    @functools.wraps(query)
    def run(spark: SparkSession, *rest) -> DataFrame:
        ship(spark)
        return query(spark, *rest)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Names that clash with none of `columns`; Spark compares names without case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def checkpointed(rows: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names.

    The folder is `spark.checkpoint.dir`; a temporary one is used only by a local session that
    names none. Elsewhere a missing setting is an error, as executors could not share the files.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir is not set: no folder that all executors share")
            folder = tempfile.mkdtemp(prefix="llm-")
        context.setCheckpointDir(folder)
    return rows.checkpoint()


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run within send their Python tasks Arrow batches that end at `most` bytes, or with a row that has more.

    Spark holds a batch about twice and a task two of them, so rows that are large make Spark's own bound too wide.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def numbered(rows: DataFrame, name: str, purpose: str) -> DataFrame:
    """The rows, stored, with the column `name`: their number from 0, by partition and place in it.

    Spark's own row ids hold the partition and the place; only the partitions' sizes are added up,
    one row a partition, which are broadcast. Being stored first, the numbers stay the same when
    the rows are computed again.
    """
    place, part, n, before = fresh([*rows.columns, name], "place", "part", "n", "before")
    kept = stored(rows.withColumn(place, F.monotonically_increasing_id()), purpose).withColumn(part, F.shiftright(place, 33))
    sizes = kept.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    number = F.col(before) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(starts), part).select(*rows.columns, number.alias(name))


def kind(rows: DataFrame, column: str) -> str:
    """The type of a column, as a schema string."""
    return rows.schema[column].dataType.simpleString()


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of consecutive slices of at most `most` bytes, or of a row that has more. A null has none."""
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64)])
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + most, "right")) - 1)
        yield begin, end - begin
        begin = end
