"""The operators of this subpackage applied to whole tables: one query each.

Each query reads its table, calls its operator with production parameters and
derives the digest columns that are asked for from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    out = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.train(spark))
    count = lambda k: F.size(F.filter("_base", lambda c: c["k"] == pii.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.named(F.col("_base")), 256).alias("base_sha256"), pii.named(pii.all_spans()).alias("spans"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score

    return score(_table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontamination as d

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = d.scan(docs, _table(spark, sf_dir, "benchmark"))
    items = F.col("_found.items")
    return out.select(
        "doc_id", "_found.n_words", d.n_hit().alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), d.contaminated().alias("contaminated"),
    )


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    out = scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("_licenses")
    place = lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))
    return out.select(
        "doc_id", F.size(found).cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["license"]))), ",").alias("licenses"),
        F.array_join(F.transform(F.array_sort(F.transform(found, lambda m: F.struct(m["start"], m["license"], m["end"]))), place), ",").alias("spans"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import join

    return join(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.read_bundles(warc.archive(_table(spark, sf_dir, "pages")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    out = extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), name="text")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules as rules

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = rules.train(docs, _table(spark, sf_dir, "labels"))
    out = rules.verdicts(docs, learned)
    return out.select(
        "doc_id", *[f"_stats.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("_stats_failed").alias("base_failed"), F.col("_stats_kept").alias("kept"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_pii": op2_pii,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_source_mixing": op5_source_mixing,
        "op6_license_scan": op6_license_scan,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_warc": op8_warc,
        "op9_html_extraction": op9_html_extraction,
        "op10_quality_rules": op10_quality_rules,
    }


OP8_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, {_ALNUM} AS w FROM documents
), i AS (
  SELECT item_id, {_ALNUM} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN sizes ON len(w) >= n)
), hits AS (
  SELECT doc_id, s, n, item FROM places JOIN windows USING (k, n)
), words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_HASH = lambda *parts: "CAST(('0x' || substring(md5(" + " || ':' || ".join(["'mix-1'", *parts]) + "), 1, 13)) AS BIGINT)"
OP5_SQL = f"""
WITH base AS (
  SELECT doc_id, source IS NOT NULL AS has, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s1 AS (
  SELECT has, source, CAST(sum(size) AS BIGINT) AS s FROM base GROUP BY 1, 2
), s2 AS (
  SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY has DESC, source) - 1) % 3 + 1] AS w FROM s1
), s3 AS (
  SELECT *, (1.5::DOUBLE * sum(s) OVER () - 2 * coalesce(sum(s) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level FROM s2
  WINDOW f AS (ORDER BY 2.0::DOUBLE * s / w, has DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s4 AS (
  SELECT has, source, s, least(2.0::DOUBLE * s, coalesce(max(CASE WHEN level * w < 2 * s THEN level END) OVER () * w, 2.0::DOUBLE * s)) AS target,
    greatest(1, least(64, CAST(floor(sum(s) OVER () / 65536) AS BIGINT))) AS block, greatest(32768, CAST(floor(sum(s) OVER () / 1048576) AS BIGINT)) AS per
  FROM s3
), s5 AS (
  SELECT *, greatest(1, CAST(floor(s / per) AS BIGINT)) AS n, CAST(round(sum(target) OVER () / block) AS BIGINT) AS seats, CAST(floor(2.0::DOUBLE * s / block) AS BIGINT) AS cap FROM s4
), q1 AS (
  SELECT has, source, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, has, source) AS place FROM (SELECT *, unnest(range(cap)) AS k FROM s5)
), q2 AS (
  SELECT has, source, count(*) AS quota FROM q1 WHERE place <= seats GROUP BY 1, 2
), dealt AS (
  SELECT b.*, s5.s, s5.target, s5.block, coalesce(q2.quota, 0) AS source_quota, {_HASH("'shard'", "doc_id")} % s5.n AS shard, {_HASH("doc_id")} AS place
  FROM base b JOIN s5 USING (has, source) LEFT JOIN q2 USING (has, source)
), sh AS (
  SELECT has, source, shard, sum(size) AS ring, max(block) AS block, max(source_quota) AS source_quota FROM dealt GROUP BY 1, 2, 3
), r1 AS (
  SELECT has, source, shard, source_quota, row_number() OVER (PARTITION BY has, source ORDER BY ring::DOUBLE / (2 * k + 1) DESC, shard) AS place
  FROM (SELECT *, unnest(range(CAST(floor(2.0::DOUBLE * ring / block) AS BIGINT))) AS k FROM sh)
), r2 AS (
  SELECT has, source, shard, count(*) AS quota FROM r1 WHERE place <= source_quota GROUP BY 1, 2, 3
), line AS (
  SELECT d.*, CAST(sum(size) OVER (PARTITION BY has, source, d.shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin,
    greatest(CAST(sh.ring AS BIGINT), 1) AS ring, least(coalesce(quota, 0) * d.block, CAST(2 * sh.ring AS BIGINT)) AS take, {_HASH("'from'", "source", "d.shard")} % greatest(CAST(sh.ring AS BIGINT), 1) AS origin
  FROM dealt d JOIN sh USING (has, source, shard) LEFT JOIN r2 USING (has, source, shard)
), e AS (
  SELECT *, fin - size AS start, take // ring AS turns, take % ring AS rest FROM line
)
SELECT doc_id, size, s AS source_size, target,
  CAST(turns * size + greatest(least(fin, origin + rest) - greatest(start, origin), 0) + greatest(least(fin, origin + rest - ring) - start, 0) AS BIGINT) AS taken
FROM e
"""

OP7_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sh x JOIN sh y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT links.b, reach.other FROM reach JOIN links ON links.a = reach.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_benchmark_decontamination": OP4_SQL, "op5_source_mixing": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op8_warc": OP8_SQL}
