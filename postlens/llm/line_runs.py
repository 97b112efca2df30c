"""Repeated lines through levelled sorted runs of line hashes."""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, remove_path, scratch_path

STRIPPED = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]
#: A line held by more than this share of all (document, line) pairs is hot; fewer than 1 / share lines can be.
HOT_SHARE = 0.001


def line_key(line: Column) -> Column:
    """What two lines must agree on: ASCII white space off both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), string.ascii_uppercase, string.ascii_lowercase)


def line_hash(key: Column) -> list[Column]:
    """128 bits in two longs: the second hash is seeded by another constant."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


class LineRuns:
    """Sorted runs of distinct line hashes, in levels.

    A run is a table in the shared folder, bucketed and sorted by hash into the same
    ``buckets`` as every batch, so a batch meets all runs in merge joins without another
    exchange.  ``fan`` runs of one level are compacted into one run of the next, so a batch
    meets fewer than ``fan`` runs a level and a hash is rewritten once a level.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = 3):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def save(self, rows: DataFrame, *parts: str, dealt: bool = False) -> str:
        """Name of a table of ``rows`` in buckets sorted by hash; ``dealt`` if they come from such tables."""
        name = f"lines_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, "lines")
        rows = rows if dealt else rows.repartition(self.buckets, *HASH)
        out = rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self.paths[name])
        (out.partitionBy(*parts) if parts else out).saveAsTable(name)
        return name

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_path(self.spark, self.paths.pop(name))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose hash is in no run."""
        return reduce(lambda rows, run: rows.join(run.select(*HASH).hint("merge"), HASH, "left_anti"), self.runs(), batch)

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds the fresh rows of a batch (one row a hash) as a run; gives them back."""
        name = self.save(self.fresh(batch), dealt=True)
        self.levels = self.levels or [[]]
        self.levels[0].append(name)
        return self.spark.table(name)

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            names = self.levels[level]
            if len(names) >= self.fan:
                merged = reduce(DataFrame.unionByName, [self.spark.table(n) for n in names])
                self.levels += [[]] * (level + 2 - len(self.levels))
                self.levels[level + 1] = [*self.levels[level + 1], self.save(merged)]
                self.levels[level] = []
                self.drop(*names)
            level += 1


def batch_bounds(docs: DataFrame, ident: Column, batches: int) -> list:
    """Ids that cut the table into about equal batches; any cut gives the same result."""
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx(ident, F.array(*map(F.lit, shares)))).first()[0] if shares else []
    return sorted(set(found or []))


def worn_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 20, min_docs: int = 3, batches: int = 6, fan: int = 3) -> DataFrame:
    """h1, h2, docs, top: the line keys of at least ``min_chars`` code points in at least ``min_docs`` documents.

    ``docs`` is in how many documents, ``top`` the largest ``key`` among them.  Documents come in
    batches of falling keys.  A batch's hashes are merge-anti-joined with the runs: what is left is seen for
    the first time, so the batch holds its ``top``, and becomes a run; what the runs knew only
    adds to a ledger of counts.  The texts are read once and shuffled as hashes, folded before.
    """
    spark = docs.sparkSession
    ident = F.col(f"`{key}`")
    bounds = batch_bounds(docs, ident, batches)
    number = reduce(lambda at, b: F.when(ident >= b, F.lit(len(bounds) - bounds.index(b))).otherwise(at), [b for b in bounds], F.lit(len(bounds) + 1))
    number = F.when(ident.isNull(), F.lit(len(bounds) + 1)).otherwise(number)
    keys = F.array_distinct(F.transform(F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "\n"), line_key))
    lines = docs.select(number.alias("batch"), ident.alias("top"), F.explode(keys).alias("line")).filter(F.char_length("line") >= min_chars)
    hashed = lines.select("batch", "top", *line_hash(F.col("line")))
    store = LineRuns(spark, fan=fan)
    # One exchange for all batches; every join after it reads buckets as they lie.
    dealt = store.save(hashed.groupBy("batch", *HASH).agg(F.count(F.lit(1)).alias("docs"), F.max("top").alias("top")), "batch")
    ledger = scratch_path(spark, "ledger")
    for at in range(1, len(bounds) + 2):
        batch = spark.table(dealt).filter(F.col("batch") == at).drop("batch")
        fresh = store.add(batch)
        batch.join(fresh.select(*HASH).hint("merge"), HASH, "left_anti").select(*HASH, "docs").write.mode("append").parquet(ledger)
        store.compact()
    again = spark.read.parquet(ledger).groupBy(*HASH).agg(F.sum("docs").alias("again"))
    first = reduce(DataFrame.unionByName, store.runs())
    counted = first.join(again, HASH, "left").select(*HASH, (F.col("docs") + F.coalesce("again", F.lit(0))).alias("docs"), "top")
    worn = cut_lineage(counted.filter(F.col("docs") >= min_docs))
    store.drop(dealt, *[n for level in store.levels for n in level])
    remove_path(spark, ledger)
    return worn


def drop_worn_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 20, **options) -> DataFrame:
    """One row per input row: row (the input row with what is left of its text), n_lines, n_dropped.

    A worn line (see ``worn_lines``) goes from every document but the one with the largest
    ``key``; lines that stay are joined by \\n in their order.  A null or empty text is one
    empty line; a null text stays null.  Each row is a document of its own, so a repeated row
    counts; rows of equal ``key`` are kept or dropped alike, and a null ``key`` is the
    smallest.  An empty table gives an empty result.  Extra columns ride along in ``row``.

    Hot lines are known by broadcast, fewer than 1 / HOT_SHARE rows at any size, and their rows
    are dealt by document in the join that decides the others.  Texts are shuffled once, where
    a document meets its dropped positions.
    """
    worn = worn_lines(docs, text, key, min_chars, **options)
    least = (worn.agg(F.sum("docs")).first()[0] or 0) * HOT_SHARE
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    named = docs.select(docs[f"`{key}`"].alias("ident"), F.xxhash64(body).alias("body"), F.split(body, "\n").alias("lines"), docs[f"`{text}`"].isNull().alias("none"),
                        F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text], F.lit(1).alias("_")).alias("rest"))
    placed = named.select("ident", "body", F.posexplode(F.transform("lines", line_key)).alias("pos", "line")).filter(F.char_length("line") >= min_chars)
    placed = placed.select("ident", "body", "pos", *line_hash(F.col("line")))
    hot = worn.filter(F.col("docs") > least).select(*HASH, F.col("top").alias("hot_top"), F.lit(True).alias("hot"))
    met = placed.join(F.broadcast(hot), HASH, "left")
    spread = met.select("ident", "body", "pos", "hot", "hot_top", F.when(F.col("hot"), F.xxhash64("ident", "body", "pos")).otherwise(F.col("h1")).alias("h1"), F.when(F.col("hot"), None).otherwise(F.col("h2")).alias("h2"))
    cold = worn.filter(F.col("docs") <= least).select(*HASH, "top", F.lit(True).alias("cold"))
    known = spread.join(cold, HASH, "left").filter((F.col("hot") & ~F.col("ident").eqNullSafe(F.col("hot_top"))) | (F.col("cold") & ~F.col("ident").eqNullSafe(F.col("top"))))
    gone = known.groupBy(F.col("ident").isNull().alias("no_ident"), F.coalesce("ident", F.lit(0)).alias("i"), "body").agg(F.collect_set("pos").alias("gone"))
    whole = named.withColumns({"no_ident": F.col("ident").isNull(), "i": F.coalesce("ident", F.lit(0))}).join(gone, ["no_ident", "i", "body"], "left")
    # Positions are unique, so the difference keeps every line that stays, in order.
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    left = F.when(F.col("none"), F.lit(None).cast("string")).otherwise(F.array_join(F.transform(stays, lambda p: F.get("lines", p)), "\n"))
    made = whole.select("rest", left.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    row = F.struct(*[F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns])
    return made.select(row.alias("row"), "n_lines", "n_dropped")
