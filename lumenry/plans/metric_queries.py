"""Metrics, cache and window queries over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, metrics
from ..sources import corpus
from ..streaming import events as stream
from .registry import query

#: Events as usage metrics.
METRICS = (
    "ev AS (SELECT event_id, ts, user_id % 5 AS project, CASE event_type WHEN 'error' THEN 'baseline' WHEN 'signup' THEN 'hook:start' WHEN 'purchase' THEN 'run' ELSE event_type END AS kind, "
    "CASE WHEN user_id % 2 = 0 THEN 'cli' ELSE 'mcp' END AS harness, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'large' ELSE 'small' END AS model, user_id % 11 AS query_hash, "
    "(json_extract_string(props, '$.k'))::BIGINT * 10 AS input_tokens, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (json_extract_string(props, '$.k'))::BIGINT END AS cached_input_tokens, "
    "(event_id % 50) AS output_tokens, CASE WHEN event_id % 3 = 0 THEN event_id % 20 END AS saved_input_tokens, event_id % 900 AS duration_ms, event_id % 6 = 0 AS cache_hit FROM events)"
)


def _events(spark, sf):
    e = corpus.table(spark, sf, "events")
    k = extract.json_usage(F.col("props"), ("missing", "k"))
    kind = F.when(F.col("event_type") == "error", "baseline").when(F.col("event_type") == "signup", "hook:start").when(F.col("event_type") == "purchase", "run").otherwise(F.col("event_type"))
    n = F.col("event_id")
    return e.select(
        "event_id", "ts", (F.col("user_id") % 5).alias("project"), kind.alias("kind"), F.when(F.col("user_id") % 2 == 0, "cli").otherwise("mcp").alias("harness"),
        F.when(F.col("user_id") % 7 == 0, None).when(F.col("user_id") % 3 == 0, "large").otherwise("small").alias("model"), (F.col("user_id") % 11).alias("query_hash"),
        (k * 10).alias("input_tokens"), F.when(n % 4 == 0, None).otherwise(k).alias("cached_input_tokens"), (n % 50).alias("output_tokens"),
        F.when(n % 3 == 0, n % 20).alias("saved_input_tokens"), (n % 900).alias("duration_ms"), (n % 6 == 0).alias("cache_hit"),
    )


@query(
    f"WITH {METRICS} SELECT count(*) AS events, count(*) FILTER (WHERE cache_hit) AS cache_hits, sum(input_tokens)::BIGINT AS input_tokens, sum(cached_input_tokens)::BIGINT AS cached_input_tokens, "
    "sum(output_tokens)::BIGINT AS output_tokens, sum(duration_ms)::BIGINT AS duration_ms, (sum(saved_input_tokens) FILTER (WHERE kind <> 'baseline'))::BIGINT AS saved_input_tokens FROM ev"
)
def metrics_totals(spark, sf):
    return metrics.totals(_events(spark, sf))


@query(
    f"WITH {METRICS}, d AS (SELECT 'project' AS dim, project::VARCHAR AS value, ev.* FROM ev UNION ALL SELECT 'harness', harness, ev.* FROM ev UNION ALL SELECT 'operation', kind, ev.* FROM ev WHERE kind <> 'baseline' AND NOT starts_with(kind, 'hook:')) "
    "SELECT dim, value, count(*) AS events, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(saved_input_tokens)::BIGINT AS saved_input_tokens FROM d GROUP BY 1, 2"
)
def metrics_by_group(spark, sf):
    return metrics.grouped(_events(spark, sf).withColumn("project", F.col("project").cast("string")))


@query(
    f"WITH {METRICS}, b AS (SELECT *, row_number() OVER (PARTITION BY project, query_hash, harness ORDER BY ts DESC, event_id DESC) AS k FROM ev WHERE kind = 'baseline') "
    "SELECT r.event_id, b.input_tokens AS baseline_input_tokens, CASE WHEN b.input_tokens IS NOT NULL THEN greatest(b.input_tokens - r.input_tokens, 0) ELSE 0 END AS saved_input_tokens "
    "FROM ev r LEFT JOIN b ON b.k = 1 AND b.project = r.project AND b.query_hash = r.query_hash AND b.harness = r.harness WHERE r.kind = 'run'"
)
def metrics_baseline_pair(spark, sf):
    out = metrics.pair_baselines(_events(spark, sf), ["project", "query_hash", "harness"], ["ts", "event_id"])
    return out.select("event_id", "baseline_input_tokens", F.col("saved_input_tokens").cast("long").alias("saved_input_tokens"))


PRICES = "(VALUES ('large', 2.0::DOUBLE, 0.5::DOUBLE, 8.0::DOUBLE)) AS p(model, i, c, o)"


@query(
    f"WITH {METRICS}, q AS (SELECT ev.*, coalesce(p.i, CASE WHEN ev.model IS NULL THEN 2.0::DOUBLE ELSE 0.25::DOUBLE END) AS pi, coalesce(p.c, CASE WHEN ev.model IS NULL THEN 0.5::DOUBLE ELSE 0.025::DOUBLE END) AS pc, coalesce(p.o, CASE WHEN ev.model IS NULL THEN 8.0::DOUBLE ELSE 2.0::DOUBLE END) AS po "
    f"FROM ev LEFT JOIN {PRICES} ON p.model = ev.model) SELECT event_id, model, round((greatest(coalesce(input_tokens, 0) - coalesce(cached_input_tokens, 0), 0) * pi + coalesce(cached_input_tokens, 0) * pc + coalesce(output_tokens, 0) * po) / 1e6, 9) AS cost_usd FROM q"
)
def metrics_cost(spark, sf):
    prices = spark.range(1).select(F.lit("large").alias("model"), F.lit(2.0).alias("input_per_million"), F.lit(0.5).alias("cached_input_per_million"), F.lit(8.0).alias("output_per_million"))
    return metrics.cost(_events(spark, sf), prices).select("event_id", "model", F.round("cost_usd", 9).alias("cost_usd"))


@query(f"WITH {METRICS} SELECT count(*) AS events, coalesce(sum(cache_hit::INT), 0)::BIGINT AS cache_hits, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(saved_input_tokens), 0)::BIGINT AS saved_input_tokens FROM ev WHERE kind = 'nothing'")
def metrics_status(spark, sf):
    return metrics.status(_events(spark, sf).where("kind = 'nothing'"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def json_usage_extract(spark, sf):
    return corpus.table(spark, sf, "events").select("event_id", extract.json_usage(F.col("props"), ("input_tokens", "k")).alias("k"))


@query(
    "WITH e AS (SELECT o_custkey % 10 AS shard, o_orderkey, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'), "
    "w AS (SELECT *, sum(size) OVER (PARTITION BY shard ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS held FROM e) SELECT o_orderkey, held FROM w WHERE held <= 5000000"
)
def cache_ttl_lru_prune(spark, sf):
    o = corpus.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 10).alias("shard"), F.col("o_orderkey").alias("cache_key"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("last_hit_at"), F.floor("o_totalprice").alias("size_bytes")
    )
    oldest = F.lit("1995-01-01").cast("timestamp_ntz").cast(o.schema["created_at"].dataType)
    live = o.where(F.col("created_at") >= oldest)
    kept = metrics.prune_cache(live.withColumn("created_at", F.lit(0)), oldest=0, max_bytes=5_000_000, by=["shard"])
    return kept.select(F.col("cache_key").alias("o_orderkey"), "held")


@query("SELECT count(*) AS entries, coalesce(sum(o_custkey), 0)::BIGINT AS bytes, coalesce(sum(o_orderkey % 3), 0)::BIGINT AS hits FROM orders")
def cache_status(spark, sf):
    o = corpus.table(spark, sf, "orders")
    return metrics.cache_status(o.select(F.col("o_custkey").alias("size_bytes"), (F.col("o_orderkey") % 3).alias("hit_count")))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    p = metrics.percentiles(corpus.table(spark, sf, "events"), "value", ["event_type"])
    return p.select("event_type", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")])


@query(
    "WITH e AS (SELECT user_id, event_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 3600 THEN 0 ELSE 1 END AS fresh FROM events), "
    "r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM e) SELECT user_id, burst::BIGINT AS burst, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM r GROUP BY 1, 2"
)
def event_coalesce_gap(spark, sf):
    b = stream.bursts(corpus.table(spark, sf, "events"), "user_id", "ts", 3600)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return b.select("user_id", "burst", "n", us("start").alias("first_us"), us("end").alias("last_us"))


@query(
    "SELECT o_orderkey, CASE WHEN v >= 1000000 THEN ((v + 50000) // 100000) // 10 || '.' || ((v + 50000) // 100000) % 10 || 'M' WHEN v >= 1000 THEN ((v + 50) // 100) // 10 || '.' || ((v + 50) // 100) % 10 || 'K' ELSE v::VARCHAR END AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 4) + o_orderkey % 3 AS v FROM orders)"
)
def format_counts(spark, sf):
    o = corpus.table(spark, sf, "orders")
    v = F.floor("o_totalprice") * (F.col("o_orderkey") % 4) + F.col("o_orderkey") % 3
    return o.select("o_orderkey", T.format_count(v).alias("shown"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    w = stream.tumbling(corpus.table(spark, sf, "events"), "ts", "1 hour")
    return w.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n", "total")


@query(
    "SELECT epoch_us(s) AS start_us, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1"
)
def events_sliding(spark, sf):
    w = stream.sliding(corpus.table(spark, sf, "events"), "ts", "12 hours", "6 hours")
    return w.select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), "
    "r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 2 HOUR) AS end_us, count(*) AS n FROM r GROUP BY user_id, s"
)
def events_session(spark, sf):
    s = stream.sessions(corpus.table(spark, sf, "events"), "ts", "user_id", "2 hours")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return s.select("user_id", us("start").alias("start_us"), us("end").alias("end_us"), "n")


@query(
    "SELECT conv_id AS run, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant' AND turn > 3), string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS answer FROM conversations GROUP BY 1"
)
def answer_extract(spark, sf):
    """Turns as JSON lines; an assistant's turn after the third carries a result."""
    c = corpus.table(spark, sf, "conversations")
    late = (F.col("role") == "assistant") & (F.col("turn") > 3)
    line = F.when(late, F.to_json(F.struct("role", "text", F.col("text").alias("result")))).otherwise(F.to_json(F.struct("role", "text")))
    return extract.answer(c.select(F.col("conv_id").alias("run"), F.col("turn").alias("n"), line.alias("line")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_key_search(spark, sf):
    e = corpus.table(spark, sf, "events")
    nested = F.concat(F.lit('{"usage": {"inner": '), "props", F.lit("}}"))
    return e.select("event_id", extract.find_keys(nested, ("tokens", "k")).alias("k"))
