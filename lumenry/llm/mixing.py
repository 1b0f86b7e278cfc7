"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share ``share`` of all words; a target stops at ``most`` times its source's
size and the excess is shared again by weight, until none is above.  That is
water filling, solved in closed form over one row per source.

Quotas: the words to take are cut into equal blocks.  Blocks go to sources by
highest quotients (Sainte-Lague: target / 1, / 3, / 5, ...), and each source's
blocks go the same way to its shards by their sizes.  Seats are found from the
divisor, by bisection; equal quotients at the border go by order.  A block has a
65536th of all words, ``MAX_BLOCK`` at most, and caps are whole blocks, so a source
is off its target by about a block; one of less than half a block takes nothing.

Selection: a shard's documents stand in a seeded order, end to end on a ring of
words.  From a seeded place on, quota x block words are taken; what goes round
more than once is repeated.  No document is taken more than ``most`` times.

Documents meet only in windows of one shard of one source.  Shards have about
``SHARD`` words, or a 2**20th of all words, so a source of any size is split
into many, and at most about a million shards meet their quotas.

Order and places come from MD5 of the seed and doc_id, so that reruns agree and
any SQL engine can follow.  Results: a null text has size 0 and takes nothing;
documents without words get taken 0; equal rows share the seeded order, ties
are broken by size.  The name of a null source is told from any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written

SHARE = 1.5
MOST = 2
WEIGHTS = (5, 2, 1)
SHARD = 32768
MAX_SHARDS = 1 << 20
MAX_BLOCK = 64
SEED = "mix-1"


def _hash(*parts: Column | str) -> Column:
    """A number below 2**52 from MD5 of the parts."""
    text = F.concat_ws(":", F.lit(SEED), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, *, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(has_source, source, source_size) with weight and target.  One row per source."""
    order = Window.orderBy(F.col("has_source").desc(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight)
    # sources are full in the order of cap / weight; the level is where the rest fits
    full = Window.orderBy((F.lit(most) * F.col("source_size") / F.col("weight")).asc(), F.col("has_source").desc(), "source")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (share * F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    leveled = weighed.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("weight") < most * F.col("source_size"))
    # from the first source that isn't full on, levels only fall
    water = F.max(F.when(F.col("_fits"), F.col("_level"))).over(every)
    cap = (most * F.col("source_size")).cast("double")
    target = F.least(cap, F.coalesce(water * F.col("weight"), cap))
    return leveled.withColumn("target", target).drop("_level", "_fits")


def apportion(df: DataFrame, votes: Column, seats: Column, cap: Column, over: list[str], name: str) -> DataFrame:
    """Whole seats by highest quotients votes / (2 k + 1) in each group ``over``, each at most cap.

    A group's rows meet in one array (sources, or the shards of a source), the
    divisor is found there by bisection, and the rows come out again.  Equal
    quotients at the border go by the rows' order.
    """
    columns = df.columns
    rows = df.withColumns({"_votes": votes.cast("double"), "_cap": cap.cast("long"), "_seats": seats.cast("long")})
    rest = [c for c in columns if c not in over]
    group = rows.groupBy(*over).agg(F.array_sort(F.collect_list(F.struct(*rest, "_votes", "_cap", "_seats"))).alias("_rows"))
    seats_at = lambda r, d: F.least(r["_cap"], F.floor(r["_votes"] / d + 0.5))
    total = F.aggregate("_rows", F.lit(0.0), lambda a, r: a + r["_votes"])
    wanted = F.element_at("_rows", 1)["_seats"]
    low = F.greatest(total, F.lit(1e-9)) / (2 * wanted + 2 * F.size("_rows") + 2)
    group = group.withColumns({"_wanted": wanted, "_span": F.struct(low.alias("lo"), (2 * F.greatest(total, F.lit(1.0)) + 1).alias("hi"))})
    half = lambda s: (s["lo"] + s["hi"]) / 2
    narrow = lambda s, _: F.when(
        F.aggregate("_rows", F.lit(0).cast("long"), lambda a, r: a + seats_at(r, half(s))) > F.col("_wanted"), F.struct(half(s).alias("lo"), s["hi"].alias("hi"))
    ).otherwise(F.struct(s["lo"].alias("lo"), half(s).alias("hi")))
    group = group.withColumn("_span", F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.col("_span"), narrow))
    flat = group.select(*over, "_span", "_wanted", F.posexplode("_rows").alias("_n", "_row"))
    flat = flat.withColumn("_got", seats_at(F.col("_row"), F.col("_span")["hi"]))
    window = Window.partitionBy(*over)
    room = F.when(F.col("_got") < F.col("_row._cap"), F.col("_row._votes") / (2 * F.col("_got") + 1))
    first = F.row_number().over(window.orderBy(room.desc_nulls_last(), "_n"))
    short = F.col("_wanted") - F.sum("_got").over(window)
    got = F.col("_got") + F.when(room.isNotNull() & (F.col("_row._votes") > 0) & (first <= short), 1).otherwise(0)
    return flat.select(*over, *[F.col("_row")[c].alias(c) for c in rest], got.cast("long").alias(name))


#: Sources that are sent to every executor at most; more are joined by shuffle.
SENT = 50_000


def mix(docs: DataFrame, *, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document."""
    key = ["has_source", "source"]
    base = docs.select("doc_id", F.col("source").isNotNull().alias("has_source"), F.coalesce(F.col("source"), F.lit("")).alias("source"), words().alias("size"))
    base = written(base, "mixing-sizes")  # the texts are read once
    sources = source_targets(base.groupBy(*key).agg(F.sum("size").alias("source_size")), share=share, most=most)
    # sizes of shards and blocks follow the size of the whole
    every = Window.partitionBy()
    total = F.sum("source_size").over(every)
    block = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(total / 65536)))
    sources = sources.withColumns({"block": block, "shard_words": F.greatest(F.lit(SHARD), F.floor(total / MAX_SHARDS))})
    sources = sources.withColumns(
        {
            "n_shards": F.greatest(F.lit(1), F.floor(F.col("source_size") / F.col("shard_words"))).cast("long"),
            "blocks": F.round(F.sum("target").over(every) / F.col("block")).cast("long"),
        }
    )
    cap = F.floor(most * F.col("source_size") / F.col("block"))
    sources = written(apportion(sources, F.col("target"), F.col("blocks"), cap, [], "source_quota"), "mixing-sources")
    sent = F.broadcast if sources.count() <= SENT else (lambda df: df)

    dealt = base.join(sent(sources.select(*key, "source_size", "target", "block", "n_shards", "source_quota")), key)
    dealt = dealt.withColumn("shard", F.pmod(_hash(F.lit("shard"), "doc_id"), F.col("n_shards")))
    shards = dealt.groupBy(*key, "shard").agg(F.sum("size").alias("shard_size"), F.max("block").alias("block"), F.max("source_quota").alias("source_quota"))
    cap = F.floor(most * F.col("shard_size") / F.col("block"))
    quotas = apportion(shards, F.col("shard_size"), F.col("source_quota"), cap, key, "quota").select(*key, "shard", "quota")

    whole = Window.partitionBy(*key, "shard")
    line = whole.orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_place", _hash("doc_id")).withColumns({"_end": F.sum("size").over(line), "_ring": F.sum("size").over(whole)})
    ring, end = F.greatest(F.col("_ring"), F.lit(1)), F.col("_end")
    begin = end - F.col("size")
    take = F.least(F.col("quota") * F.col("block"), most * F.col("_ring"))
    turns = F.floor(take / ring)
    rest = take - turns * ring
    at = F.pmod(_hash(F.lit("from"), "source", "shard"), ring)
    arc = F.greatest(F.least(end, at + rest) - F.greatest(begin, at), F.lit(0)) + F.greatest(F.least(end, at + rest - ring) - begin, F.lit(0))
    out = placed.join(quotas, [*key, "shard"])
    return out.select("doc_id", "size", "source_size", "target", (turns * F.col("size") + arc).cast("long").alias("taken"))
