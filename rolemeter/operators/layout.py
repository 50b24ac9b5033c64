"""Physical layout helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rolemeter.session import scratch_dir


def spread(scan: DataFrame, key: str, sized_like: DataFrame | None = None) -> DataFrame:
    """Give a small scan enough partitions to use every core.

    Scoring is heavy per row, so a file with fewer splits than cores would leave cores idle.
    A scan that has more splits than cores, the normal case on large inputs, is left as it
    is and nothing moves. `key` should be close to unique. For a stream, `sized_like` is a batch
    read of what a micro-batch will hold; without it a stream stays as it is.
    """
    if scan.isStreaming and sized_like is None:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if (scan if sized_like is None else sized_like).rdd.getNumPartitions() > cores:
        return scan
    return scan.repartition(4 * cores, key)


def computed_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that filters on it will not evaluate again.

    Filters are pushed below a projection by repeating its expression; they are not pushed
    below a generator.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c != name]
    return rows.select(*kept, F.explode(F.array(value)).alias(name))


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows that several branches of a plan read to shared storage, and read them from there.

    The branches then start from a column-pruned scan, and losing an executor costs no
    recomputation of what lies before.
    """
    folder = scratch_dir(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def stored_counted(rows: DataFrame, purpose: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """`stored`, with aggregates of the rows that were written, counted in the same pass."""
    seen = Observation(purpose)
    kept = stored(rows.observe(seen, *[c.alias(name) for name, c in counts.items()]), purpose)
    return kept, {name: int(seen.get.get(name) or 0) for name in counts}
