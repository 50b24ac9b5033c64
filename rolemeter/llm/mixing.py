"""Mix sources to target weights: repetition rates from token counts, whole copies and one drawn copy.

Every source gets a target number of words: its weight's share of the whole, at most `most` times
what it has, the excess dealt again by weight. Its documents are taken floor(target / size) times,
and once more with the probability of the remaining fraction, decided by a hash of the seed and the
document's id. All of it is built-in column functions; only one row a source is ever joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolemeter.llm.shared import checkpointed, fresh, table
from rolemeter.operators.dimensions import lookup_join

#: By code point order of the sources, repeating, null last.
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`source_size` by `source` to `target` and `rate`; one row a source, nulls last.

    A target above `most` times its size is cut there and the excess goes to the others by weight,
    until none is above. In the order of size over weight those cut come first, so the end of
    that loop is found from running sums: source i is cut exactly if, with all before it cut, its
    share of the rest is above its limit. A source without words has the target and rate 0.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    place = (F.row_number().over(by_name) - 1) % len(weights)
    return (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), place + 1))
        .withColumn("ratio", F.col("source_size") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("cut", F.col("left") / F.col("weights_left") > most * F.col("ratio"))
        # the first that is not cut fixes the level of all that follow
        .withColumn("level_left", F.min(F.when(~F.col("cut"), F.struct("ratio", F.col("source").isNull(), "source", "left", "weights_left"))).over(whole))
        .withColumn(
            "target",
            F.when(F.col("cut"), (most * F.col("source_size")).cast("double"))
            .otherwise((F.col("weight") * F.col("level_left.left")).cast("double") / F.col("level_left.weights_left")),
        )
        .select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    )


def copies(rate: Column, key: Column, seed: int = SEED) -> Column:
    """floor(rate), and one more if the first 32 bits of the hash of seed and key are below the fraction."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("long")
    whole = F.floor(rate)
    return whole + F.when(drawn < (rate - whole) * F.lit(4294967296.0), 1).otherwise(0)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The documents with `size`, `source_size`, `target` and `copies`, none left out.

    Null texts have size 0. A null source is a source of its own. Rows of one id share one draw;
    where the id is null, the text takes its place. Reruns agree, whatever the partitioning.
    """
    size, source_size, target, rate, times = fresh(docs.columns, "size", "source_size", "target", "rate", "copies")
    sized = docs.withColumn(size, words(F.col(text)))
    sums = checkpointed(targets(sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size")), weights, most))
    (join_key,) = fresh([*docs.columns, size, source_size, target, rate, times], "source_key")
    named = sums.select(  # as JSON a null source is a key like any other
        F.to_json(F.struct("source")).alias(join_key), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("rate").alias(rate),
    )
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text), F.lit(""))))
    rows = sized.withColumn(join_key, F.to_json(F.struct(F.col(source).alias("source"))))
    joined = lookup_join(rows, named, join_key, spread_by=key)
    return joined.withColumn(times, copies(F.col(rate), own, seed).cast("long")).select(*docs.columns, size, source_size, target, times)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns it had."""
    counted = mix(docs, **options)
    times = counted.columns[-1]
    (turn,) = fresh(counted.columns, "turn")
    return counted.where(F.col(times) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """One row a document, those not taken too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_LISTED = ", ".join(f"({i}, {w})" for i, w in enumerate(WEIGHTS))

OP5_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sums AS (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source),
ranked AS (
  SELECT source, s, w, s / w AS ratio FROM (
    SELECT source, s, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} AS k FROM sums) JOIN (VALUES {_LISTED}) AS t(k, w) USING (k)
), running AS (
  SELECT *, (sum(s) OVER () - {MOST} * coalesce(sum(s) OVER b, 0))::BIGINT AS rest, (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS wrest
  FROM ranked WINDOW b AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (SELECT *, rest / wrest > {MOST} * ratio AS cut FROM running),
level AS (SELECT rest, wrest FROM flagged WHERE NOT cut ORDER BY ratio, source IS NULL, source LIMIT 1),
targets AS (
  SELECT source, s, CASE WHEN cut THEN ({MOST} * s)::DOUBLE ELSE (w * (SELECT rest FROM level))::DOUBLE / (SELECT wrest FROM level) END AS target FROM flagged
), rated AS (SELECT *, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate FROM targets)
SELECT doc_id, size::BIGINT AS size, s AS source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('{SEED}:' || doc_id), 1, 8))::BIGINT < (rate - floor(rate)) * 4294967296.0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
"""
