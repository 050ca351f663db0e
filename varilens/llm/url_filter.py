"""URL rules through a blocked Bloom filter and an exact hash join (DataFrame functions only).

A rule list holds canonical keys ``host + path``.  Every URL is cut into its
candidate keys (host suffixes at label bounds x path prefixes, only of
lengths that occur in the list).  A blocked Bloom filter of the listed keys
(512-bit blocks of 8 words, one bit per word) passes the candidates that may
be listed; an exact join with the list removes its false positives; the
longest rule left decides, and a URL without a rule is allowed.

Defined results: NULL url, or one without ``://``, has empty host and path
and no rule; repeated rows stay repeated; an empty rule list allows all;
other columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8          # 64-bit words per block
MAX_RULE = 4096    # longest host or path of a rule; bounds the sets of lengths the driver sees


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end; only A-Z are lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks).cast("long"))


def _mask(key: Column, word: int) -> Column:
    bit = F.shiftright(F.xxhash64(F.lit(1), key), 6 * word).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter: a row ``(block, w0..w7)`` for each block that has a bit; at most ``n_blocks`` rows."""
    return (keys.select(_block(F.col(key), n_blocks).alias("block"),
                        *[_mask(F.col(key), w).alias(f"w{w}") for w in range(WORDS)])
            .groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)]))


def bloom_hits(rows: DataFrame, key: str, blocks: DataFrame, n_blocks: int, *, hits: bool = True) -> DataFrame:
    """Rows whose key may be in the filter; with ``hits=False`` the others, which surely are not listed.

    The broadcast holds at most ``n_blocks`` rows of 72 bytes.
    """
    hit = F.lit(True)
    for w in range(WORDS):
        m = _mask(F.col(key), w)
        hit = hit & (F.col(f"w{w}").bitwiseAND(m) == m)
    return (rows.withColumn("block", _block(F.col(key), n_blocks))
            .join(F.broadcast(blocks), "block", "inner" if hits else "left")
            .where(hit if hits else ~F.coalesce(hit, F.lit(False)))
            .drop("block", *[f"w{w}" for w in range(WORDS)]))


def _lengths(rules: DataFrame) -> tuple[list[int], list[int]]:
    row = rules.agg(F.sort_array(F.collect_set(F.length("host"))), F.sort_array(F.collect_set(F.length("path")))).first()
    hosts, paths = row[0], row[1]
    if max([0, *hosts, *paths]) > MAX_RULE:
        raise ValueError(f"a rule's host or path is longer than {MAX_RULE}")
    return hosts, paths


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
               n_blocks: int = 1 << 16, salts: int = 16, default: str = "allow") -> DataFrame:
    """``rules(host, path, verdict)`` over ``pages``: ``id, host, path, rule, verdict`` per page.

    ``n_blocks`` (65,536 blocks, 4.7 MB) bounds the broadcast filter; a list
    too long for it only sends more candidates to the exact join.  The list
    is replicated ``salts`` times in that join, so the pages of one hot rule
    spread over as many tasks.
    """
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null").groupBy(
        "host", "path").agg(F.min("verdict").alias("verdict")).withColumn("key", F.concat("host", "path"))
    host_lengths, path_lengths = _lengths(rules)

    base = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"), F.spark_partition_id().alias("part"))
    # Copies of a row within a partition become one row with a count: a hot URL travels once per partition.
    base = base.groupBy("id", "host", "path", "part").agg(F.count("*").alias("copies"))

    hosts = F.array_compact(F.array(*[
        F.when((F.length("host") == n) | ((F.length("host") > n) & (F.substr("host", F.length("host") - n, F.lit(1)) == ".")),
               F.right(F.col("host"), F.lit(n))) for n in host_lengths]) if host_lengths else F.array(F.lit(None).cast("string")))
    paths = F.array_compact(F.array(*[
        F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in path_lengths])
        if path_lengths else F.array(F.lit(None).cast("string")))
    cands = (base.where(F.col("host") != "")
             .withColumn("rule_host", F.explode(hosts)).withColumn("rule_path", F.explode(paths))
             .withColumn("key", F.concat("rule_host", "rule_path")))
    hits = bloom_hits(cands, "key", bloom_blocks(rules, "key", n_blocks), n_blocks)
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.lit(salts)).cast("int"))
    listed = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"),
                          F.col("verdict").alias("rule_verdict"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    found = (hits.join(listed, ["rule_host", "rule_path", "salt"])
             .select("id", "host", "path", "part", "copies",
                     F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"),
                              F.length("rule_host").alias("host_size"),
                              F.concat("rule_host", "rule_path").alias("rule"),
                              F.col("rule_verdict").alias("verdict")).alias("best")))
    none = base.withColumn("best", F.lit(None).cast(found.schema["best"].dataType))
    judged = (found.unionByName(none).groupBy("id", "host", "path", "part")
              .agg(F.max("copies").alias("copies"), F.max("best").alias("best")))
    return (judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
