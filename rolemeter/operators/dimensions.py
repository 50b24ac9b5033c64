"""Joins to small tables, with their size checked, and the way beyond that size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def is_small(table: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """Whether a table is proven to fit a broadcast. Reads at most `max_rows + 1` rows of it."""
    max_rows = MAX_BROADCAST_ROWS if max_rows is None else max_rows
    max_bytes = MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])))
    rows, size = (
        table.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0)))
        .first()
    )
    return rows <= max_rows and size <= max_bytes


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: str | list[str],
    how: str = "inner",
    small: bool | None = None,
    spread_by: str | list[str] = "resume_id",
) -> DataFrame:
    """Join many rows to a table on `on`.

    A small table is broadcast and `rows` do not move. Otherwise both sides shuffle, and as one
    key may hold a large share of `rows`, every key is split over `SALTS` partitions by
    `spread_by`, which should tell the rows of one key apart.
    """
    if is_small(table) if small is None else small:
        return rows.join(F.broadcast(table), on, how)
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*([spread_by] if isinstance(spread_by, str) else spread_by)), F.lit(SALTS)).cast("int"))
    salted_table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = [on] if isinstance(on, str) else on
    return salted_rows.join(salted_table, [*keys, "_salt"], how).drop("_salt")
