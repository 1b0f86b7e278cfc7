"""Token budgets, limits and envelopes over ranked hits."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of a hit's fields in its JSON form, on which its cost depends.
FIELDS = ("path", "start", "end", "symbol", "kind", "sig", "snippet", "snippet_truncated", "score", "why")


def hit_json(columns: list[str] | tuple[str, ...] = FIELDS) -> Column:
    """Compact JSON of a hit: nulls stay; snippet_truncated only where it is true."""
    options = {"ignoreNullFields": "false"}
    full = F.to_json(F.struct(*columns), options)
    if "snippet_truncated" not in columns:
        return full
    short = F.to_json(F.struct(*[c for c in columns if c != "snippet_truncated"]), options)
    return F.when(F.col("snippet_truncated"), full).otherwise(short)


def cost(columns: list[str] | tuple[str, ...] = FIELDS) -> Column:
    """Estimated tokens of a hit."""
    return F.greatest(F.lit(1), F.ceil(F.length(hit_json(columns)) / 4)).cast("long")


def running(df: DataFrame, order: list, cost_column: str = "cost", by: list[str] | None = None) -> DataFrame:
    """df with ``used``: the cost of a hit and all before it."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(cost_column).over(w))


def prefix(df: DataFrame, order: list, budget: int, cost_column: str = "cost", by: list[str] | None = None) -> DataFrame:
    """The longest prefix that fits.  Costs are positive, so it is where ``used`` fits.

    Hits are a ranked and limited list when they come here; with ``by``, each
    group has its own budget.
    """
    return running(df, order, cost_column, by).where(F.col("used") <= budget)


def summary(all_hits: DataFrame, kept: DataFrame, hint: str | None = None, coverage: str = "complete") -> DataFrame:
    """One row: tokens used, hits kept and omitted, coverage and a hint."""
    a = all_hits.agg(F.count("*").alias("found"))
    k = kept.agg(F.count("*").alias("hits"), F.coalesce(F.sum("cost"), F.lit(0)).alias("tokens"))
    one = a.join(k)  # one row each
    partial = F.col("hits") < F.col("found")
    return one.select(
        "tokens", "hits", (F.col("found") - F.col("hits")).alias("omitted"), F.when(partial, "partial").otherwise(coverage).alias("coverage"),
        F.coalesce(F.when(partial, F.lit("raise the budget or narrow the query")), F.lit(hint)).alias("hint"),
    )


def fit_snippet(hit: dict, budget: int) -> dict | None:
    """The hit with the longest prefix of its snippet that fits, or None."""

    def price(h: dict) -> int:
        shown = {k: v for k, v in h.items() if k != "snippet_truncated" or v}
        return max(1, math.ceil(len(json.dumps(shown, ensure_ascii=False, separators=(",", ":"))) / 4))

    if price(hit) <= budget:
        return hit
    text = hit["snippet"]
    low, high = -1, len(text)
    while high - low > 1:
        mid = (low + high) // 2
        if price(hit | {"snippet": text[:mid], "snippet_truncated": True}) <= budget:
            low = mid
        else:
            high = mid
    return None if low < 0 else hit | {"snippet": text[:low], "snippet_truncated": True}


def fit_snippets(df: DataFrame, budget: Column | int) -> DataFrame:
    """Each hit shortened to its own ``share`` of the budget; hits that cannot fit go."""
    shared = df.withColumn("share", F.lit(budget) if isinstance(budget, int) else budget)
    names = [c for c in FIELDS if c in df.columns]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                fit = fit_snippet({n: r[n] for n in names}, int(r["share"]))
                if fit is not None:
                    rows.append(r | fit)
            yield pd.DataFrame(rows, columns=pdf.columns)

    return shared.mapInPandas(run, shared.schema).drop("share")


def equal_share(df: DataFrame, budget: int) -> Column:
    """A definition's share: all of the budget if they fit together, else an equal part."""
    w = Window.partitionBy()
    return F.when(F.sum("cost").over(w) > budget, F.floor(F.lit(budget) / F.count("*").over(w))).otherwise(F.lit(budget)).cast("long")


def source_tokens(files: DataFrame, by: list[str]) -> DataFrame:
    """Estimated tokens of whole files, each path once, in each group."""
    sized = files.select("path", *by, F.ceil(F.length("content") / 4).cast("long").alias("_t"))
    return sized.dropDuplicates(["path"]).groupBy(*by).agg(F.sum("_t").alias("tokens"))
