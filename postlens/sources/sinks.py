"""Writes: upserts, partition snapshots, staged swaps, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], policy: dict[str, str | tuple[str, str]]) -> DataFrame:
    """Merge ``batch`` into ``target`` with a policy per column.

    ``overwrite``       new value, even when null (default)
    ``coalesce``        new value unless null
    ``keep``            old value unless null
    ``("reset", col)``  null when ``col`` changed, else the old value

    Both sides must hold one row per key.  Built-in file tables have no MERGE;
    write the result to a new location or partition, never over its own input.
    """
    cols = [c for c in target.columns if c not in keys]
    old = target.select(*keys, F.lit(True).alias("_o"), *[F.col(c).alias(f"_o_{c}") for c in cols])
    new = batch.select(*keys, F.lit(True).alias("_n"), *[(F.col(c) if c in batch.columns else F.lit(None)).alias(f"_n_{c}") for c in cols])
    j = old.join(new, keys, "full")

    def merged(c: str) -> Column:
        o, n, rule = F.col(f"_o_{c}"), F.col(f"_n_{c}"), policy.get(c, "overwrite")
        if rule == "overwrite":
            both = n
        elif rule == "coalesce":
            both = F.coalesce(n, o)
        elif rule == "keep":
            both = F.coalesce(o, n)
        else:
            both = F.when(F.col(f"_o_{rule[1]}").eqNullSafe(F.col(f"_n_{rule[1]}")), o)
        return F.when(F.col("_n").isNull(), o).when(F.col("_o").isNull(), n).otherwise(both).alias(c)

    return j.select(*keys, *[merged(c) for c in cols])


def write_snapshot(df: DataFrame, path: str, day_col: str = "snapshot_date") -> None:
    """Replace only the days present in ``df``; other partitions stay.

    Rebalancing by day keeps small days in one file each and splits a large day
    over several tasks, so a snapshot of one day is not one task's work.
    """
    df.hint("rebalance", day_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_col).parquet(path)


POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, folder, folder.getFileSystem(conf), conf


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that the pointer of a swapped table names."""
    jvm, folder, fs, _ = _hadoop(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(folder, POINTER)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return f"{path}/{jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8').strip()}"
    finally:
        stream.close()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a swapped table."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} has no version yet")
    return spark.read.parquet(version)


def swap_table(df: DataFrame, path: str, min_rows: int = 1) -> int:
    """Write a new version of a table, check it, then point to it; returns the row count.

    The pointer is one small file that is replaced in one step, so a reader finds the old
    version or the new one, never none, and nothing is renamed or copied.  A refused or
    failed version leaves the pointer as it was.  The version before stays for readers that
    have opened it; older ones go.
    """
    spark: SparkSession = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    jvm, folder, fs, conf = _hadoop(spark, path)
    version = jvm.org.apache.hadoop.fs.Path(folder, name)
    before = current_version(spark, path)
    try:
        df.write.parquet(f"{path}/{name}")
        n = spark.read.parquet(f"{path}/{name}").count()
        if n < min_rows:
            raise RuntimeError(f"refusing to swap in {n} rows, {min_rows} required")
        fresh = jvm.org.apache.hadoop.fs.Path(folder, f".{POINTER}-{name}")
        stream = fs.create(fresh, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        kinds = jvm.org.apache.hadoop.fs.Options.Rename
        how = spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fresh, jvm.org.apache.hadoop.fs.Path(folder, POINTER), how)
    except Exception:
        fs.delete(version, True)
        raise
    for status in fs.listStatus(folder):
        old = status.getPath().getName()
        if old.startswith("v-") and old not in (name, (before or "").rsplit("/", 1)[-1]):
            fs.delete(status.getPath(), True)
    return n


def purge_expired(df: DataFrame, ts_col: str, days: int, as_of: str, key: str, children: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(kept rows, kept children, counts of what goes): a dry run simply ignores the first two."""
    old = F.col(ts_col) < F.date_sub(F.lit(as_of).cast("date"), days)
    gone = df.filter(old).select(key)
    kept_children = {n: c.join(gone, key, "left_anti") for n, c in children.items()}
    counts = gone.agg(F.count(F.lit(1)).alias("n")).select(F.lit("parent").alias("table_name"), "n")
    for name, child in children.items():
        counts = counts.unionByName(child.join(gone, key, "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n"))
    return df.filter(~F.coalesce(old, F.lit(False))), kept_children, counts
