"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A listed URL (a rule) is ``host/path``.  It fits the host itself and all its
subdomains, for URLs whose path starts with the rule's path.  A page's
canonical URL therefore has one key for each (host suffix, path prefix); only
prefix lengths that occur in the list are formed.  Most keys are in no list:
they are discarded by a blocked Bloom filter, a table of at most
``MAX_BLOCKS`` rows of eight 32-bit words (one bit a word and key), which may be
broadcast because that bound holds for any list.  What passes is joined exactly
(equality of the full key), which removes the false positives; the longest
listed URL wins.

Distinct (host, path) pairs are judged once and joined back, so a URL shared by
many pages is judged once.

Defined results: a null URL, or one without ``://``, has an empty host and path
and no rule; an empty list gives every page the default verdict; of listed URLs
of equal length the one with the longer host wins, then the larger string;
a URL listed twice with both verdicts is blocked.  Repeated rows each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C

#: Rows of the filter at most (64 bytes each with its key): 8 MB whatever the list's length.  A longer list
#: raises the share of false positives, which the exact join removes.
MAX_BLOCKS = 1 << 17
KEYS_PER_BLOCK = 16
WORDS = 8

# fixed values: (verdict, rule) of the contract
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]
DEFAULT = "allow"


def host_path(url: Column) -> tuple[Column, Column]:
    """Canonical host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + F.lit(3), F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.substring(rest, F.length(host) + F.lit(1), F.length(rest))
    return C.ascii_lower(host), F.regexp_extract(path, r"^[^?#]*", 0)


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _masks(prefix: str) -> list[str]:
    """SQL of the eight masks of a hash column ``prefix``."""
    return [f"shiftleft(1, cast(shiftrightunsigned({prefix}, {5 * i}) & 31 as int))" for i in range(WORDS)]


def build_filter(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """Blocks (block, w0..w7) of the filter of column ``key``, and their number."""
    n = max(1, min(MAX_BLOCKS, -(-n_keys // KEYS_PER_BLOCK)))
    k = keys.select(_block(F.col("key"), n).alias("block"), F.xxhash64("key", F.lit("bloom")).alias("h"))
    words = [F.expr(f"bit_or({m})").alias(f"w{i}") for i, m in enumerate(_masks("h"))]
    return k.groupBy("block").agg(*words), n


def maybe_listed(keys: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """Rows of ``keys`` whose key may be in the filter; no listed key is lost."""
    probe = (keys.withColumn("__block", _block(F.col("key"), n))
             .withColumn("__h", F.xxhash64("key", F.lit("bloom"))))
    hit = F.expr(" and ".join(f"(w{i} & {m}) = {m}" for i, m in enumerate(_masks("__h"))))
    b = F.broadcast(blocks)  # at most MAX_BLOCKS rows
    return probe.join(b, (F.col("__block") == b["block"]) & hit, "left_semi").drop("__block", "__h")


def rule_keys(rules: DataFrame) -> DataFrame:
    """(rule, verdict) -> (key, host_len, path_len, rule, verdict); one row a rule."""
    r = (rules.where("rule is not null").groupBy("rule")
         .agg(F.max("verdict").alias("verdict")))  # block before allow
    at = F.instr("rule", "/")
    host = F.when(at > 0, F.substring(F.col("rule"), F.lit(1), at - 1)).otherwise(F.col("rule"))
    path = F.when(at > 0, F.substring(F.col("rule"), at, F.length("rule"))).otherwise(F.lit(""))
    r = r.withColumn("__host", C.ascii_lower(host)).withColumn("__path", path)
    return r.select(F.concat("__host", F.lit("\n"), "__path").alias("key"), "rule", "verdict",
                    F.length("__host").alias("host_len"), F.length("__path").alias("path_len"))


def page_keys(urls: DataFrame, path_lens: list[int]) -> DataFrame:
    """(host, path) -> one row per host suffix and listed prefix length: (host, path, key)."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lens = F.array(*[F.lit(n) for n in path_lens]).cast("array<int>")
    fit = F.filter(lens, lambda n: n <= F.length("path"))
    rows = urls.where("host != ''").select("host", "path", F.explode(suffixes).alias("__suffix"))
    rows = rows.select("host", "path", "__suffix", F.explode(fit).alias("__len"))
    return rows.select("host", "path", F.concat("__suffix", F.lit("\n"),
                                                F.substring(F.col("path"), F.lit(1), F.col("__len"))).alias("key"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Pages (page_id, url) with host, path, the longest rule that fits, and the verdict."""
    keys = C.freeze(rule_keys(rules), "llm_url_rules")
    # at most one entry per length of a URL path
    lens = [r[0] for r in keys.select("path_len").distinct().orderBy("path_len").collect()]
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    if not lens:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"))
    blocks, n = build_filter(keys, keys.count())
    urls = rows.select("host", "path").distinct()
    hits = maybe_listed(page_keys(urls, lens), blocks, n)
    exact = hits.join(keys, "key")
    best = exact.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "host_len", "rule", "verdict")).alias("best"))
    best = best.select("host", "path", "best.rule", "best.verdict")
    return (rows.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("verdict", F.lit(default)).alias("verdict")))


# -- query --------------------------------------------------------------------

def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with host, path, the rule that decides and the verdict."""
    rules = spark.sql("select * from values " + ", ".join(f"('{r}', '{v}')" for v, r in RULES)
                      + " as t(rule, verdict)")
    return judge(C.read(spark, sf_dir, "pages"), rules)


SQL = """
with p as (
  select page_id, case when url is null or strpos(url, '://') = 0 then ''
                       else substr(url, strpos(url, '://') + 3) end as rest from pages),
h as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from p),
u as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
r(verdict, rule, rhost, rpath) as (values
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
  ('block', 'com/de/', 'com', '/de/')),
m as (
  select u.page_id, u.host, u.path, r.rule, r.verdict,
         row_number() over (partition by u.page_id order by length(r.rule) desc nulls last) as n
  from u left join r on (u.host = r.rhost or ends_with(u.host, '.' || r.rhost)) and starts_with(u.path, r.rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where n = 1
"""
