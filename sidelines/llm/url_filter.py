"""URL filter: a blocked Bloom filter of the listed URLs, then an exact join.

Native: DataFrame functions only.

A rule is a canonical URL prefix (host, path prefix) with a verdict.  It fits
the host and its subdomains when the URL's path starts with the rule's path.
Every distinct (host, path) of the input yields its possible rule keys: each
host suffix at a label border, with each path prefix of a length that some
rule has.  The keys are tested against a split-block Bloom filter: a key's
hash picks one block of ``WORDS`` 64-bit words and sets one bit in each.  The
filter has a fixed number of blocks, so its size (and that of its broadcast)
has a bound whatever the list's length; a longer list only lets more false
positives through.  Keys that pass meet the rules in an equi-join, which
removes the false positives; the longest fitting rule wins.

Defined results: a NULL URL, or one without ``://``, has an empty host and path
and no rule.  Of fitting rules the longest host + path wins, at equal length
the one with the longer host, and of a rule listed twice with both verdicts,
'allow'.  Without a fitting rule the verdict is 'allow'.  Repeated rows get
equal answers, one per row; an empty list or table works; further columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidelines.llm.catalog import register
from sidelines.llm.common import UPPER, table

WORDS = 4


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column, blocks: int) -> list[Column]:
    """Block number and one single-bit word per word of the block."""
    h = F.xxhash64(key)
    g = F.xxhash64(key, F.lit("bits"))
    return [F.pmod(h, F.lit(blocks)).cast("int").alias("block")] + [
        F.call_function("shiftleft", F.lit(1).cast("bigint"),
                        F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")).alias(f"w{i}")
        for i in range(WORDS)]


def bloom_blocks(keys: DataFrame, key: str = "key", blocks: int = 1 << 16) -> DataFrame:
    """The filter as rows (block, w0..): at most ``blocks`` rows, 40 bytes each."""
    return (keys.select(*_bits(F.col(key), blocks)).groupBy("block")
            .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]))


def possible(candidates: DataFrame, filter_rows: DataFrame, key: str = "key", blocks: int = 1 << 16) -> DataFrame:
    """Rows of ``candidates`` whose key may be listed (no listed key is lost)."""
    probe = candidates.select("*", F.struct(*_bits(F.col(key), blocks)).alias("probe"))
    f = filter_rows.select(F.struct("block", *[f"w{i}" for i in range(WORDS)]).alias("f"))
    cond = F.col("probe.block") == F.col("f.block")
    for i in range(WORDS):
        cond = cond & (F.col(f"f.w{i}").bitwiseAND(F.col(f"probe.w{i}")) == F.col(f"probe.w{i}"))
    return probe.join(F.broadcast(f), cond, "left_semi").drop("probe")


def judge(urls: DataFrame, rules: DataFrame, blocks: int = 1 << 16) -> DataFrame:
    """(host, path, rule, verdict) for each distinct (host, path) of ``urls`` that a rule fits.

    ``rules`` has host, path, verdict; hosts in lower case.
    """
    listed = (rules.select("host", "path", "verdict", F.length("path").alias("plen")).dropna()
              .groupBy("host", "path", "plen").agg(F.min("verdict").alias("verdict")))
    listed = listed.withColumn("key", F.concat_ws("\n", "host", "path"))
    lengths = listed.agg(F.sort_array(F.collect_set("plen")).alias("lens"))
    pages = urls.select("host", "path").filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = (pages.withColumn("suffix", F.explode(F.array_distinct(suffixes)))
              .withColumn("lens", lengths.scalar())
              .withColumn("plen", F.explode(F.filter("lens", lambda n: n <= F.length("path")))).drop("lens")
              .withColumn("prefix", F.expr("substring(path, 1, plen)"))
              .withColumn("key", F.concat_ws("\n", "suffix", "prefix")))
    hits = possible(spread, bloom_blocks(listed, blocks=blocks), blocks=blocks)
    r = listed.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    exact = hits.join(r, (F.col("suffix") == F.col("rule_host")) & (F.col("prefix") == F.col("rule_path")))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("all"), F.length("rule_host").alias("h"))
    best = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank)
    return exact.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 blocks: int = 1 << 16) -> DataFrame:
    """One row per input row: id, host, path, rule (NULL if none fits), verdict."""
    u = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    j = judge(u, rules, blocks)
    return u.join(j, ["host", "path"], "left").select(
        id_col, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


#: The list of the query, as its contract gives it (fixed values).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@register("op6_url_filter", r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
f AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM f""")
def op6_url_filter(spark, sf_dir):
    """Verdict of every page url under the listed rules."""
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)
