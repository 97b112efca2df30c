"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ITEM = "struct<ident:bigint,size:bigint,mass:double,p:double>"


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, n_items, target), from rows (source, size, n) of items.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times all
    sizes.  A target stops at ``cap`` times its source's size and the excess goes to the rest
    by weight.  That fixpoint is found in one pass: by rising cap per weight, the first source
    whose cap is not passed sets the level of all that follow.
    """
    facts = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n_items"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = facts.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    rising = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = weighed.withColumns({
        "rest": F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        "rest_w": F.sum("w").over(after),
        "place": F.row_number().over(rising),
    })
    free = F.col("rest") * F.col("w") <= F.col("most") * F.col("rest_w")
    level = F.min(F.when(free, F.struct("place", "rest", "rest_w"))).over(everything)
    chosen = levelled.withColumn("level", level)
    target = F.when(F.col("place") >= F.col("level.place"), F.col("level.rest") * F.col("w") / F.col("level.rest_w")).otherwise(F.col("most"))
    return chosen.select("source", "source_size", "n_items", F.coalesce(target, F.col("most")).alias("target"))


def _uniform(seed: int, *keys: Column) -> Column:
    """In [0, 1), the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(2**53))


def _pivot(seed: int):
    """One pivotal step of a fold: (settled items, open item) and the next item.

    Size-weighted mass moves from one to the other, in the direction drawn so that neither
    probability changes in the mean, until one of the two is 0 or 1; that one is settled.
    """

    def settle(item: Column, up: bool) -> Column:
        return F.array(F.struct(item["ident"].alias("ident"), item["size"].alias("size"), F.lit(up).alias("up")))

    def still(item: Column, p: Column) -> Column:
        return F.struct(item["ident"].alias("ident"), item["size"].alias("size"), item["mass"].alias("mass"), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["open"]
        to_a = F.least((1 - a["p"]) * a["mass"], x["p"] * x["mass"])
        to_x = F.least(a["p"] * a["mass"], (1 - x["p"]) * x["mass"])
        first = _uniform(seed, a["ident"], a["size"], x["ident"], x["size"]) * (to_a + to_x) < to_x
        a_full, a_none = (1 - a["p"]) * a["mass"] <= x["p"] * x["mass"], a["p"] * a["mass"] <= (1 - x["p"]) * x["mass"]
        done, left = (
            F.when(first & a_full, settle(a, True)).when(first, settle(x, False)).when(a_none, settle(a, False)).otherwise(settle(x, True)),
            F.when(first & a_full, still(x, x["p"] - to_a / x["mass"])).when(first, still(a, a["p"] + to_a / a["mass"]))
            .when(a_none, still(x, x["p"] + to_x / x["mass"])).otherwise(still(a, a["p"] - to_x / a["mass"])),
        )
        return F.when(a.isNull(), F.struct(acc["settled"].alias("settled"), x.alias("open"))).otherwise(F.struct(F.concat(acc["settled"], done).alias("settled"), left.alias("open")))

    return step


def mix_plan(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, block: int = 64, seed: int = 7, broadcast_sources: int = 100_000) -> DataFrame:
    """(source, ident, size, n, source_size, target, copies): how often the mix takes each item.

    An item is all rows equal in source, key and size (``n`` of them), and they get the same
    number of copies.  Within a source every item starts with target / source_size copies; the
    whole part is taken, the fraction is rounded by pivotal sampling weighted by size, so the
    words taken from a source miss its target by one item at most.

    Items are dealt by hash into blocks of about ``block``; a fold pairs the items of a block
    and leaves one open, and those meet again in the next level's blocks, as a reduction tree,
    until one is left per source.  So a source with a third of all rows is only more blocks.
    The table of targets, one short row a source, is broadcast if it has at most
    ``broadcast_sources`` rows.  All draws are hashes of the seed and the pair: reruns agree, however rows are dealt out.

    A null source is a source of its own, last in order.  Items of size 0 take no part in the
    rounding.  A null key is an item like any other.  An empty table gives an empty plan.
    """
    items = cut_lineage(docs.select(F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").cast("long").alias("ident"), F.coalesce(size, F.lit(0)).cast("long").alias("size")).groupBy("source", "ident", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = cut_lineage(source_targets(items, weights, share, cap))
    # Join keys without nulls, for sources and idents alike.
    named = lambda df: df.withColumns({"s_none": F.col("source").isNull(), "s": F.coalesce(F.col("source").cast("string"), F.lit(""))})
    facts = targets.agg(F.count(F.lit(1)).alias("n"), F.max("n_items").alias("most")).first()
    sources = named(targets).drop("source")
    if facts["n"] <= broadcast_sources:  # else a shuffled join, which Spark splits where a source is hot
        sources = F.broadcast(sources)
    all_items = named(items).join(sources, ["s_none", "s"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = all_items.withColumns({"whole": F.floor(ratio).cast("long"), "p": ratio - F.floor(ratio), "mass": (F.col("size") * F.col("n")).cast("double")})

    open_ = rated.filter("mass > 0 and p > 0").select("s_none", "s", "n_items", F.struct("ident", "size", "mass", "p").alias("item"))
    most = facts["most"] or 0
    settled: list[DataFrame] = []
    width, level = most, 0
    while most:
        width = -(-width // block)
        parts = F.ceil(F.col("n_items") / F.lit(block)).cast("long")
        dealt = open_.withColumns({"n_items": parts, "block": F.pmod(F.xxhash64(F.lit(seed + level), "item.ident", "item.size"), parts)})
        ordered = F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed - 1 - level), "item.ident", "item.size").alias("h"), "item")))
        start = F.struct(F.lit([]).cast("array<struct<ident:bigint,size:bigint,up:boolean>>").alias("settled"), F.lit(None).cast(ITEM).alias("open"))
        folded = cut_lineage(dealt.groupBy("s_none", "s", "n_items", "block").agg(ordered.alias("items")).select(
            "s_none", "s", "n_items", F.aggregate("items", start, lambda acc, x: _pivot(seed + level)(acc, x["item"])).alias("out")))
        settled.append(folded.select("s_none", "s", F.explode("out.settled").alias("r")).select("s_none", "s", "r.*"))
        open_ = folded.select("s_none", "s", "n_items", F.col("out.open").alias("item")).filter("item is not null")
        level += 1
        if width <= 1:
            break
    if most:
        last = open_.select("s_none", "s", "item.ident", "item.size", (_uniform(seed + 99, F.col("item.ident"), F.col("item.size")) < F.col("item.p")).alias("up"))
        ups = last
        for part in settled:
            ups = ups.unionByName(part)
        ups = ups.withColumns({"i_none": F.col("ident").isNull(), "i": F.coalesce("ident", F.lit(0))}).drop("ident")
        rated = rated.withColumns({"i_none": F.col("ident").isNull(), "i": F.coalesce("ident", F.lit(0))}).join(ups, ["s_none", "s", "i_none", "i", "size"], "left")
    else:
        rated = rated.withColumn("up", F.lit(False))
    copies = F.col("whole") + F.when(F.coalesce("up", F.lit(False)), 1).otherwise(0)
    return rated.select("source", "ident", "size", "n", "source_size", "target", copies.alias("copies"))


def mix_to_targets(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mixed table: every row as often as the plan says, columns unchanged."""
    plan = mix_plan(docs, size, source, key, **options).filter("copies > 0")
    keys = lambda s, i, z: {"_s0": s.isNull(), "_s1": F.coalesce(s.cast("string"), F.lit("")), "_i0": i.isNull(), "_i1": F.coalesce(i.cast("long"), F.lit(0)), "_z": z}
    right = plan.select(*[c.alias(n) for n, c in keys(F.col("source"), F.col("ident"), F.col("size")).items()], "copies")
    left = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in keys(docs[f"`{source}`"], docs[f"`{key}`"], F.coalesce(size, F.lit(0)).cast("long")).items()])
    repeated = left.join(right, ["_s0", "_s1", "_i0", "_i1", "_z"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_n"))
    return repeated.select("row.*")
