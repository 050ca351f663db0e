"""Registered queries of the training-data operators: thin, whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .bpe import encode_digests
from .common import prepared, table, text_or_empty
from .decontaminate import benchmark_matches
from .exact_dedup import marked
from .near_dup import near_duplicates
from .neighbours import nearest
from .periodic import periodic_runs
from .pii import find_spans
from .ranked_search import ranked
from .repeats import without_repeats
from .sharding import write_shards
from .url_filter import judge_urls
from .warc import read_archives, write_archives

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------- 8: URLs ----

#: Fixed by the query's contract: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@register("op8_url_filter", f"""
WITH parts AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES {_RULE_VALUES}),
best AS (
  SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_RULE_VALUES} AS rules(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


# --------------------------------------------------------- 5: sharding ----

@register("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the order is random by design; tests hold the law, the slots and the rows against the input."""
    shards = write_shards(table(spark, sf_dir, "documents"), n_shards=24)
    text = text_or_empty("record.text")
    return shards.select(F.col("record.doc_id").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"),
                         F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


# ------------------------------------------------------------- 1: WARC ----

@register("op1_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, d AS payload_digest,
             CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN best <> page_id THEN best END AS refers_to
FROM q""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_archives(write_archives(table(spark, sf_dir, "pages")), whole=True).where("kind = 'record'")
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")  # noqa: E731  after "urn:page:"
    revisit = F.col("record_type") == "revisit"
    return rows.select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("header_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("header_digest")).otherwise(F.sha1("payload")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"))


# -------------------------------------------------------------- 7: BPE ----

@register("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: tests hold ids and texts against the tokenizers library."""
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


# -------------------------------------------------- 3: decontamination ----

@register("op3_decontaminate")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: edit distance within a text; tests hold the matches against full dynamic programming."""
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# -------------------------------------------------------------- 4: PII ----

@register("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: DuckDB's regular expressions give no offsets; tests hold the base spans against ``re``."""
    return find_spans(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------- 2: quality ----

@register("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: a trained model; tests hold its accuracy on the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return (quality.scored(docs.select("doc_id", "text"), model)
            .select("doc_id", quality.held_out("doc_id").alias("held_out"), "score",
                    (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")))


# --------------------------------------------- 10: nearest neighbours ----

@register("op10_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: approximate; tests and ``brute_force`` measure its recall."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


# -------------------------------------------------- 6: near-duplicates ----

@register("op6_near_duplicates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: connected groups of a set similarity; tests hold the classes against all pairs."""
    return (near_duplicates(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "class_id", F.lower(F.hex("class_key")).alias("class_key")))


# --------------------------------------------------- 9: long repeats ----

@register("op9_repeats")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL on whole tables; tests hold the result against all windows of a small table."""
    return (without_repeats(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))


# ---------------------------------------------------- 11: exact dedup ----

@register("op11_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
           FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW best AS (PARTITION BY t ORDER BY length(x) DESC, doc_id NULLS LAST)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (marked(table(spark, sf_dir, "documents"))
            .select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")))


# -------------------------------------------------- 12: ranked search ----

_SQL_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


@register("op12_ranked_search", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS t FROM documents),
dn AS (SELECT r, doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM dn),
q AS (SELECT qr, item_id, unnest(t) AS term
      FROM (SELECT row_number() OVER () AS qr, item_id, list_distinct({_SQL_TERMS}) AS t FROM benchmark)),
words AS (SELECT DISTINCT term FROM q),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM dn) SEMI JOIN words USING (term) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM tf, s GROUP BY term),
impact AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total)))) AS score
           FROM tf JOIN w USING (term) JOIN dn USING (r), s),
found AS (SELECT qr, item_id, r, doc_id, sum(score)::BIGINT AS score FROM q JOIN impact USING (term)
          GROUP BY qr, item_id, r, doc_id HAVING sum(score) > 0)
SELECT item_id, row_number() OVER best::INTEGER AS rank, doc_id, score FROM found
WINDOW best AS (PARTITION BY qr ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER best <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# -------------------------------------------------- 13: periodic runs ----

def _with_periods(docs: DataFrame) -> DataFrame:
    """Fixed by the query's contract: every tenth text (by the id's checksum) repeats its words from ``a`` with period ``p``."""
    h = F.crc32(F.col("doc_id").cast("string"))
    n = F.size("words")
    g = F.floor(F.col("h") / 10)
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    planted = (docs.select("doc_id", "text", h.alias("h"))
               .withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
               .withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8))))
    return planted.select("doc_id", F.when(F.col("p").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


@register("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: all periods of all stretches; tests hold the runs against every start and period."""
    runs = F.col("runs")
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    found = periodic_runs(_with_periods(table(spark, sf_dir, "documents"))).withColumn("best", best)
    return found.select(
        F.col("id").alias("doc_id"), F.size(runs).cast("long").alias("n_runs"), F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.expr("1000 * -best.l div best.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(runs, line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
