"""URL filters: host and path rules, then a blocked Bloom filter of listed URLs with an exact check.

Listed canonical URLs are folded into 512-bit blocks of eight words, one bit in each; ``bit_or`` merges a
block's URLs by aggregation.  A page's canonical URL and that of its site's root, which when listed stands for
the whole site, are tested against their blocks; only possible hits meet the list itself in a hash join, which
removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relgen.llm.tables import apart, written

#: (verdict, host, path); the longest fitting rule wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: More rules than these are joined by host instead of being one expression.
MAX_RULES = 200
BITS_PER_URL = 16
#: Blocks up to this number (64 bytes each) go to every executor; more are joined by shuffle.
MAX_BROADCAST_BLOCKS = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The example list: whole sites by their root URL, and single pages /language/number below ``LISTED_PAGES`` of others.
LISTED_ROOTS = ("cheap-pills.example.com", "free-bets.example.com", "adult-x.example.net", "spam-farm.example.org", "ads-track.example.org")
LISTED_SITES = ("spam-farm.example.com", "ads-track.example.com")
LISTED_LANGUAGES = ("de", "en", "es", "fr")
LISTED_PAGES = 1000


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Without a leading www. or m., a trailing slash or .html, query and fragment."""
    return F.concat(F.regexp_replace(host, "^(www|m)\\.", ""), F.regexp_replace(path, "(/|\\.html)$", ""))


def example_list(spark: SparkSession) -> DataFrame:
    sites = F.explode(F.array(*map(F.lit, LISTED_SITES)))
    languages = F.explode(F.array(*map(F.lit, LISTED_LANGUAGES)))
    pages = spark.range(LISTED_PAGES).select("id", sites.alias("site")).select("id", "site", languages.alias("lang")).select(F.concat_ws("/", "site", "lang", F.col("id").cast("string")).alias("url"))
    return pages.unionByName(spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED_ROOTS))).alias("url")))


def _block(url: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: str) -> list[Column]:
    g = F.xxhash64(url, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(8)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the URLs in ``listed.url``."""
    rows = listed.select(_block("url", blocks).alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(_masks("url"))))
    return rows.groupBy("block").agg(*(F.expr(f"bit_or(m{i})").alias(f"w{i}") for i in range(8)))


def listed_pages(pages: DataFrame, listed: DataFrame, urls: dict[str, str]) -> DataFrame:
    """``pages`` with a boolean for each of ``urls`` (column of canonical URLs to name of the boolean): whether ``listed.url`` has it.

    The list is written, so that its side of the join has an exchange of its own and a hot site can be split.
    """
    listed = written(listed.where("url <> ''").select("url").distinct(), "listed")
    blocks = max(1, -(-listed.count() * BITS_PER_URL // 512))
    table = written(bloom(listed, blocks), "bloom")
    table = F.broadcast(table) if blocks <= MAX_BROADCAST_BLOCKS else table
    names = listed.select(F.col("url").alias("__url"))
    for url, flag in urls.items():
        columns = pages.columns
        pages = pages.withColumns({"__block": _block(url, blocks), **{f"__m{i}": m for i, m in enumerate(_masks(url))}})
        possible = F.lit(True)
        for i in range(8):
            possible = possible & (F.col(f"w{i}").bitwiseAND(F.col(f"__m{i}")) == F.col(f"__m{i}"))
        probed = pages.join(table, pages["__block"] == table["block"], "left").withColumn("__maybe", F.coalesce(possible, F.lit(False)))
        # the others get keys that no URL has, spread over all partitions
        key = F.when(F.col("__maybe"), F.col(url)).otherwise(F.concat(F.lit("\n"), F.monotonically_increasing_id().cast("string")))
        probed = probed.select(*columns, key.alias("__key"))
        pages = probed.join(names, F.col("__key") == names["__url"], "left").select(*columns, F.col("__url").isNotNull().alias(flag))
    return pages


def ruled(pages: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """``pages`` with __rule and __verdict of the longest rule that fits __host and __path, or nulls."""
    if len(rules) <= MAX_RULES:
        fits, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
            match = ((F.col("__host") == h) | F.col("__host").endswith("." + h)) & F.col("__path").startswith(p)
            fits, verdict = F.when(match, h + p).otherwise(fits), F.when(match, kind).otherwise(verdict)
        return pages.withColumns({"__rule": fits, "__verdict": verdict})
    table = pages.sparkSession.createDataFrame([(h, p, h + p, kind, i) for i, (kind, h, p) in enumerate(rules)], "__site string, __start string, __name string, __kind string, __ord int")
    # each different host and path meets the rules of the host and the domains above it
    labels = F.split("__host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    different = pages.select("__host", "__path").distinct()
    met = different.select("__host", "__path", F.explode(above).alias("__site")).join(table, "__site").where(F.startswith("__path", "__start"))
    best = met.groupBy(F.col("__host").alias("__h"), F.col("__path").alias("__p")).agg(F.max(F.struct(F.length("__name").alias("n"), "__ord", "__name", "__kind")).alias("x"))
    joined = pages.join(best, (pages["__host"] == best["__h"]) & (pages["__path"] == best["__p"]), "left")
    return joined.withColumns({"__rule": F.col("x.__name"), "__verdict": F.col("x.__kind")}).drop("__h", "__p", "x")


def filtered(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """All columns of ``pages`` with host, path, rule and verdict.

    A page is listed if its canonical URL or the root of its site is.  Null URLs and those without :// have
    an empty host and path, fit no rule and are not listed.  Repeated
    rows are judged each; columns of the input with these names are replaced, and an empty table gives an
    empty result.  Of equally long rules the last one counts.
    """
    made = ("host", "path", "rule", "verdict")
    own, back = apart(pages, ("url",))
    names = own.columns
    judged = ruled(own.select(*names, host(F.col("url")).alias("__host"), path(F.col("url")).alias("__path")), rules)
    judged = judged.withColumns({"__canonical": canonical(F.col("__host"), F.col("__path")), "__root": canonical(F.col("__host"), F.lit(""))})
    judged = listed_pages(judged, listed, {"__canonical": "__page_listed", "__root": "__site_listed"})
    kept = [b for c, b in zip(pages.columns, back, strict=True) if c not in made]
    return judged.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.coalesce("__verdict", F.when(F.col("__page_listed") | F.col("__site_listed"), "block").otherwise("allow")).alias("verdict"))


def _oracle() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    when = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in enumerate(cases))
    names, kinds = when.format(*(h + p for _, h, p in cases)), when.format(*(k for k, _, _ in cases))
    return f"""
WITH l AS (SELECT DISTINCT site || '/' || lang || '/' || id AS url
  FROM (SELECT unnest({list(LISTED_SITES)}) AS site), (SELECT unnest({list(LISTED_LANGUAGES)}) AS lang), range({LISTED_PAGES}) r(id) UNION SELECT unnest({list(LISTED_ROOTS)})),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE {names} END AS rule,
  coalesce(CASE {kinds} END, CASE WHEN l.url IS NOT NULL OR r.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN l ON l.url = regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/|\\.html)$', '')
LEFT JOIN l r ON r.url = regexp_replace(host, '^(www|m)\\.', '')
"""


ORACLE_SQL = _oracle()
