"""Usage metrics: totals, groups, baselines, cost, cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: US dollars per million tokens of the built-in rate.
BUILTIN = {"model": "builtin", "input": 0.25, "cached_input": 0.025, "output": 2.0}


def measures() -> list[Column]:
    """Sums and conditional counts of events, null where nothing was recorded."""
    n = lambda c: F.sum(c)
    return [
        F.count("*").alias("events"), F.count_if(F.col("cache_hit")).alias("cache_hits"), n("input_tokens").alias("input_tokens"),
        n("cached_input_tokens").alias("cached_input_tokens"), n("output_tokens").alias("output_tokens"), n("duration_ms").alias("duration_ms"),
        F.sum(F.when(F.col("kind") != "baseline", F.col("saved_input_tokens"))).alias("saved_input_tokens"),
    ]


def totals(events: DataFrame) -> DataFrame:
    return events.agg(*measures())


def grouped(events: DataFrame) -> DataFrame:
    """Measures by project, harness and operation in one pass; operations leave out baselines and hooks."""
    ops = F.when((F.col("kind") != "baseline") & ~F.col("kind").startswith("hook:"), F.col("kind"))
    sets = events.withColumn("dims", F.array(*[F.struct(F.lit(d).alias("dim"), v.alias("value")) for d, v in (("project", F.col("project")), ("harness", F.col("harness")), ("operation", ops))]))
    flat = sets.withColumn("d", F.explode("dims")).where((F.col("d.dim") != "operation") | F.col("d.value").isNotNull())
    return flat.groupBy(F.col("d.dim").alias("dim"), F.col("d.value").alias("value")).agg(
        F.count("*").alias("events"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("saved_input_tokens").alias("saved_input_tokens")
    )


def pair_baselines(events: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Runs with their key's last baseline: saved tokens, not below zero."""
    runs = events.where("kind = 'run'")
    last = F.max(F.struct(*[F.col(c) for c in order], "input_tokens")).alias("b")
    base = events.where("kind = 'baseline'").groupBy(*keys).agg(last).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("b.input_tokens").alias("baseline_input_tokens"))
    on = None
    for k in keys:
        test = F.col(k) == F.col(f"_{k}")
        on = test if on is None else on & test
    out = runs.join(base, on, "left").drop(*[f"_{k}" for k in keys])
    return out.withColumn("saved_input_tokens", F.greatest(F.col("baseline_input_tokens") - F.col("input_tokens"), F.lit(0)))


def cost(events: DataFrame, pricing: DataFrame) -> DataFrame:
    """events with cost_usd: its model's price, else the built-in rate; without a model
    only if all prices are of one model."""
    p = pricing.select(F.col("model").alias("_model"), "input_per_million", "cached_input_per_million", "output_per_million")
    lone = pricing.agg(F.countDistinct("model").alias("_models"), F.first("input_per_million").alias("_i"), F.first("cached_input_per_million").alias("_c"), F.first("output_per_million").alias("_o"))
    j = events.join(p, F.col("model") == F.col("_model"), "left").join(F.broadcast(lone))  # one row
    pick = lambda own, one, builtin: F.coalesce(own, F.when(F.col("model").isNull() & (F.col("_models") == 1), one), F.when(F.col("model").isNotNull(), F.lit(builtin)))
    i, c, o = (pick(F.col(a), F.col(b), BUILTIN[k]) for a, b, k in (("input_per_million", "_i", "input"), ("cached_input_per_million", "_c", "cached_input"), ("output_per_million", "_o", "output")))
    zero = F.lit(0)
    fresh = F.greatest(F.coalesce("input_tokens", zero) - F.coalesce("cached_input_tokens", zero), zero)
    usd = (fresh * i + F.coalesce("cached_input_tokens", zero) * c + F.coalesce("output_tokens", zero) * o) / 1e6
    return j.withColumn("cost_usd", usd).drop("_model", "input_per_million", "cached_input_per_million", "output_per_million", "_models", "_i", "_c", "_o")


def status(events: DataFrame) -> DataFrame:
    z = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return events.agg(F.count("*").alias("events"), z(F.col("cache_hit").cast("int"), "cache_hits"), z("input_tokens", "input_tokens"), z("saved_input_tokens", "saved_input_tokens"))


def percentiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Interpolated p50, p95 and p99."""
    return df.groupBy(*by).agg(*[F.expr(f"percentile({value}, {q})").alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def prune_cache(cache: DataFrame, *, oldest, max_bytes: int, by: list[str] | None = None) -> DataFrame:
    """Entries that stay: not older than ``oldest``, and the latest hit that fit together."""
    live = cache.where(F.col("created_at") >= F.lit(oldest))
    w = Window.partitionBy(*(by or [])).orderBy(F.col("last_hit_at").desc(), F.col("created_at").desc(), "cache_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return live.withColumn("held", F.sum("size_bytes").over(w)).where(F.col("held") <= max_bytes)


def cache_lookup(cache: DataFrame, key: str, now, ttl_seconds: int) -> DataFrame:
    """The entry of a key, unless it is too old."""
    return cache.where((F.col("cache_key") == key) & (F.lit(now) - F.col("created_at") <= ttl_seconds))


def cache_status(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"))
