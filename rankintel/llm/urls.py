"""URL filters: host-suffix and path-prefix expressions met by rules on short hash prefixes.

Each url is expanded into the expressions (last k labels of its host, first p characters of its path) for those
(k, p) that some rule has. Expressions and rules meet in an equi-join on a short prefix of their digest, which keeps
the shuffled rows narrow; the full digests are compared after the join, and the longest rule wins. Built-in
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the digest that the join sees.
PREFIX_DIGITS = 8
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?` or `#`, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?` or `#`; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """key, host, path, rule, verdict of each row of `pages`.

    `rules` has columns host, path, verdict. A rule fits its host and all subdomains if the path starts with the
    rule's path. The longest rule (host and path together) wins, then the one with the longer host, then a block.
    Without a rule, `rule` is null and the verdict is `default`. A null url, or one without `://`, has an empty host
    and path, which no rule fits; rules with a null or empty host are no rules. Repeated rows are judged each on its own.
    """
    known = rules.select("host", "path", "verdict").where((F.col("host") != "") & F.col("path").isNotNull()).distinct()
    # At most the longest path of a rule times its labels, however many rules there are.
    shapes = known.select(_labels(F.col("host")).alias("k"), F.length("path").alias("p")).distinct().collect()
    parts = pages.select(F.col(key).alias("__key"), host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"))

    expressions = F.filter(
        F.array(*[
            F.when(
                (F.col("__host") != "") & (_labels(F.col("__host")) >= s["k"]) & (F.length("__path") >= s["p"]),
                _digest(F.substring_index("__host", ".", -s["k"]), F.substring("__path", 1, s["p"])),
            )
            for s in shapes
        ])
        if shapes
        else F.array().cast("array<string>"),
        lambda digest: digest.isNotNull(),
    )
    urls = parts.select("__host", "__path").distinct()
    expanded = urls.select("__host", "__path", F.explode(expressions).alias("__digest"))
    rule_text = F.concat("host", "path")
    hashed = known.select(
        _digest(F.col("host"), F.col("path")).alias("__full"),
        F.struct(F.length(rule_text).alias("n"), F.length("host").alias("h"), F.col("verdict").eqNullSafe(BLOCK).alias("b"), rule_text.alias("rule"), F.col("verdict").alias("verdict")).alias("__found"),
    ).withColumn("__short", F.left("__full", F.lit(PREFIX_DIGITS)))
    met = expanded.withColumn("__short", F.left("__digest", F.lit(PREFIX_DIGITS))).join(hashed, "__short").where("__digest = __full")
    best = met.groupBy("__host", "__path").agg(F.max("__found").alias("__found"))
    # Rows meet the distinct urls that a rule fits; a host that a third of all rows share has many paths, and the join can be split.
    return parts.join(best, ["__host", "__path"], "left").select(
        F.col("__key").alias(key),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__found.rule").alias("rule"),
        F.coalesce("__found.verdict", F.lit(default)).alias("verdict"),
    )
