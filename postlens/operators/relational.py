"""Relational building blocks used by every mart.

Each of them keeps a hot key splittable: best-row and top-k filters are pruned
before the shuffle (Spark's window group limit), counts are pre-aggregated, and
per-group facts are joined back instead of computed in a window over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank_as: str | None = None) -> DataFrame:
    """First ``k`` rows of each group; ``order`` must be total."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col("_rank") <= k)
    return kept.withColumnRenamed("_rank", rank_as) if rank_as else kept.drop("_rank")


def dedupe_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Best row per key: latest state, best evidence, cluster representative."""
    return top_per_group(df, keys, order, 1)


def min_sample(df: DataFrame, n: int, count_col: str) -> DataFrame:
    """Drop groups too small to report."""
    return df.filter(F.col(count_col) >= n)


def with_group_facts(df: DataFrame, keys: list[str], **facts: Column) -> DataFrame:
    """Attach per-group aggregates to rows (aggregate, then join back)."""
    agg = df.groupBy(*keys).agg(*[c.alias(name) for name, c in facts.items()])
    on = [df[k].eqNullSafe(agg[k]) for k in keys]
    cond = on[0]
    for extra in on[1:]:
        cond = cond & extra
    return df.join(agg, cond).drop(*[agg[k] for k in keys])


def latest_before(df: DataFrame, key: str, ts: str, is_prior: Column, payload: list[str], bucket: Column) -> DataFrame:
    """As-of join of a log with itself: newest *prior* row strictly before each row.

    A key's history is cut into time buckets so that no task holds a whole hot
    key.  Inside a bucket the newest prior row comes from a window; what came
    before the bucket is carried in from one summary row per (key, bucket).
    Adds ``prior_<ts>`` and ``prior_<payload>``; rows without a prior keep nulls.
    """
    prior = F.struct(F.col(ts), *[F.col(c) for c in payload])
    tagged = df.withColumns({"_b": bucket, "_prior": F.when(is_prior, prior)})
    per_bucket = tagged.groupBy(key, "_b").agg(F.max("_prior").alias("_m"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(key, "_b", F.max("_m").over(before).alias("_carry"))
    # RANGE up to just before the current timestamp keeps the comparison strict on ties.
    inside = (
        Window.partitionBy(key, "_b").orderBy(F.col("_us")).rangeBetween(Window.unboundedPreceding, -1)
    )
    local = tagged.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_local", F.max("_prior").over(inside))
    joined = local.join(carried, [key, "_b"], "left")
    found = F.coalesce(F.col("_local"), F.col("_carry"))
    return joined.withColumn("_found", found).select(
        *df.columns, F.col(f"_found.{ts}").alias(f"prior_{ts}"), *[F.col(f"_found.{c}").alias(f"prior_{c}") for c in payload]
    )


def global_rank(df: DataFrame, key: str, rank_as: str) -> DataFrame:
    """1..n over the whole frame in md5 order of ``key``, without a one-task window.

    The hash spreads rows evenly over 4096 ordered buckets; ranks are the place
    inside the bucket plus the size of all buckets before it.
    """
    hashed = df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return (
        hashed.withColumn("_r", inside).join(offsets, "_b")
        .withColumn(rank_as, F.col("_r") + F.col("_off")).drop("_h", "_b", "_r", "_off")
    )


def trimmed_mean(df: DataFrame, keys: list[str], value: str, low: float = 0.10, high: float = 0.90, out: str = "trimmed_mean") -> DataFrame:
    """Mean of the values between two rank indexes, from per-value counts.

    Equal values are counted before the window, so the window sees one row per
    distinct value of a group, not one per posting.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(run), "_total": F.sum("_n").over(whole)})
    lo = F.floor(F.col("_total") * low)
    hi = F.floor(F.col("_total") * high)
    lo, hi = F.when(hi > lo, lo).otherwise(F.lit(0)), F.when(hi > lo, hi).otherwise(F.col("_total"))
    kept = F.greatest(F.least(F.col("_upto"), hi) - F.greatest(F.col("_upto") - F.col("_n"), lo), F.lit(0))
    return (
        ranked.withColumn("_kept", kept).groupBy(*keys)
        .agg((F.sum(F.col(value) * F.col("_kept")) / F.sum("_kept")).alias(out))
    )


def empirical_percentile(df: DataFrame, keys: list[str], value: str, out: str = "percentile", digits: int = 2) -> DataFrame:
    """Share of the peer group at or below each row's value, in percent."""
    from ..functions.columns import rounded

    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    shares = counts.select(
        *keys, value, rounded(F.sum("_n").over(run) * 100.0 / F.sum("_n").over(Window.partitionBy(*keys)), digits).alias(out)
    )
    return df.join(shares, [*keys, value], "left")


def majority_vote(df: DataFrame, key: str, value: str, min_samples: int = 5, min_share: float = 0.85) -> DataFrame:
    """The value most rows of a key agree on, when they agree strongly enough."""
    votes = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    totals = votes.groupBy(key).agg(F.sum("n").alias("total"), F.max(F.struct("n", value)).alias("top"))
    return totals.filter((F.col("total") >= min_samples) & (F.col("top.n") >= F.col("total") * min_share)).select(
        key, F.col(f"top.{value}").alias(value), F.col("top.n").alias("votes"), "total"
    )


def fair_interleave(df: DataFrame, cls: str, order: list[Column], class_rank: Column, limit: int) -> DataFrame:
    """First ``limit`` rows when classes take turns; each class is in ``order``.

    A row beyond place ``limit`` of its class can never be served, so the class
    windows are pruned to ``limit`` rows before the shuffle.
    """
    placed = top_per_group(df, [cls], order, limit, rank_as="position")
    return placed.orderBy("position", class_rank, *order).limit(limit)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Repeatable audit sample: the ``n`` smallest salted hashes."""
    salted = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", salted).orderBy("_h", key).limit(n).drop("_h")


def distinct_in_parts(df: DataFrame, rows: int, per_part: int = 250_000) -> DataFrame:
    """Distinct rows, dealt out before they are compared, so a task holds some ``per_part`` of about ``rows`` and not a whole input split."""
    return df.repartition(max(64, -(-rows // per_part)), *df.columns).distinct()
