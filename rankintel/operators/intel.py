"""Competitor intelligence over search results: ranked competitors, coverage, label shares, insights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankintel.functions.text import cut, or_else
from rankintel.operators.lookup import attach, only_keywords, top_per_group

# Default label, widths, label groups and the share boundaries of the two summaries (in percent).
UNKNOWN = "unknown"
EVIDENCE_CHARS = 120
SOLID, VERMEIL, PLATED = "solid_gold", "vermeil", ("gold_plated", "gold_filled")
INSIGHT_SHARE, FEW_SHARE, SOME_SHARE = 25, 25, 50

# The sentences of the two summaries, with printf placeholders.
INSIGHTS = {
    "no_data": "No competitor data found for these keywords.",
    "none_solid": "Zero solid gold competitors in top results. Lead hard on '18k Solid Gold' — "
    "%1$d plated and %2$d vermeil rank above you.",
    "few_solid": "Only %3$d/%4$d solid gold competitors. Strong differentiation opportunity on material quality.",
    "many_solid": "%3$d/%4$d competitors are solid gold — differentiate on designer credentials, handcrafted, "
    "Nevada-made.",
}
SUMMARIES = {
    "no_data": "No data for these keywords yet.",
    "none_solid": "0%% solid gold in top results across all keywords. "
    "Massive opening — every competitor is plated or vermeil.",
    "few_solid": "Only %1$s%% solid gold. %2$s%% is plated/vermeil. Strong differentiation opportunity.",
    "some_solid": "%1$s%% solid gold competitors. Still meaningful differentiation available — "
    "focus on price-quality story.",
    "many_solid": "%1$s%% solid gold competitors. Market is competitive on material. "
    "Differentiate on craft, credentials, price-per-karat.",
}


def _ranked(serp: DataFrame, keywords, limit: int | None, per_query: bool) -> DataFrame:
    """Results of the keywords in query and position order, cut globally or per query."""
    order = [F.asc("position"), F.asc("url")]
    if per_query and limit is not None and isinstance(keywords, DataFrame):
        # The cut comes first: after a semi join on the query, a query with very many results would sit in one task.
        return only_keywords(top_per_group(serp, ["query"], order, limit), keywords)
    chosen = only_keywords(serp, keywords)
    if limit is None:
        return chosen
    if per_query:
        return top_per_group(chosen, ["query"], order, limit)
    return chosen.orderBy("query", *order).limit(limit)


def _bound(limit: int | None, per_query: bool) -> int | None:
    return None if per_query else limit


def competitor_intel(
    serp: DataFrame,
    pages: DataFrame,
    classes: DataFrame,
    keywords: Sequence | DataFrame | None = None,
    limit: int | None = 15,
    per_query: bool = False,
    evidence_chars: int | None = EVIDENCE_CHARS,
) -> DataFrame:
    """Ranked results with page title and labels, defaults filled in.

    The limit is global in query order, so late keywords of a long list can come out empty; per_query
    applies it to each query. Labels and pages are unique per url and never multiply rows, so the limit is
    taken before the joins, and so is the cut of the evidence (None: whole).
    """
    ranked = _ranked(serp.select("query", "position", "url", F.col("title").alias("_title")), keywords, limit, per_query)
    labels = classes.select("url", *_label_columns(classes)).withColumn("evidence", cut(F.col("evidence"), evidence_chars))
    joined = attach(ranked, [pages.select("url", "page_title"), labels], bound=_bound(limit, per_query))
    shown = joined.select(
        "query",
        "position",
        "url",
        or_else(F.col("page_title"), or_else(F.col("_title"), "")).alias("page_title"),
        or_else(F.col("metal_type"), UNKNOWN).alias("metal_type"),
        or_else(F.col("karat"), UNKNOWN).alias("karat"),
        or_else(F.col("base_metal"), UNKNOWN).alias("base_metal"),
        "price_usd",
        F.coalesce("evidence", F.lit("")).alias("evidence"),
        or_else(F.col("confidence"), UNKNOWN).alias("confidence"),
    )
    return shown if limit is None or per_query else shown.orderBy("query", "position")


def _label_columns(classes: DataFrame) -> list[Column]:
    names = ("metal_type", "karat", "base_metal", "price_usd", "evidence", "confidence")
    return [
        F.col(n) if n in classes.columns else F.lit(None).cast("double" if n == "price_usd" else "string").alias(n) for n in names
    ]


def keyword_coverage(keywords: DataFrame, intel: DataFrame) -> DataFrame:
    """ordinal, keyword, found: which keywords (columns ordinal, keyword) have rows in the intel."""
    seen = intel.select(F.col("query").alias("keyword")).distinct().withColumn("_seen", F.lit(True))
    return keywords.join(seen, "keyword", "left").select("ordinal", "keyword", F.coalesce("_seen", F.lit(False)).alias("found"))


def metal_summary(intel: DataFrame) -> DataFrame:
    """metal_type, n: label counts of intel rows."""
    return intel.groupBy("metal_type").agg(F.count(F.lit(1)).alias("n"))


def _count_of(*labels: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("metal_type").isin(*labels), F.col("n"))), F.lit(0)).cast("bigint")


def insight(summary: DataFrame) -> DataFrame:
    """One row: total, solid, plated, vermeil, insight_code, insight, from label counts."""
    counts = summary.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"),
        _count_of(SOLID).alias("solid"),
        _count_of(*PLATED).alias("plated"),
        _count_of(VERMEIL).alias("vermeil"),
    )
    code = (
        F.when(F.col("total") == 0, "no_data")
        .when(F.col("solid") == 0, "none_solid")
        .when(F.col("solid") * 100 <= F.col("total") * INSIGHT_SHARE, "few_solid")
        .otherwise("many_solid")
    )
    return _worded(counts.withColumn("insight_code", code), "insight_code", "insight", INSIGHTS, "plated", "vermeil", "solid", "total")


def _worded(df: DataFrame, code: str, out: str, sentences: dict[str, str], *values: str) -> DataFrame:
    text = None
    for name, sentence in sentences.items():
        said = F.format_string(sentence, *values)
        text = F.when(F.col(code) == name, said) if text is None else text.when(F.col(code) == name, said)
    return df.withColumn(out, text)


def _labelled(serp: DataFrame, classes: DataFrame, keywords, limit: int | None, per_query: bool) -> DataFrame:
    ranked = _ranked(serp.select("query", "position", "url"), keywords, limit, per_query)
    joined = attach(ranked, [classes.select("url", "metal_type")], bound=_bound(limit, per_query))
    return joined.select("query", or_else(F.col("metal_type"), UNKNOWN).alias("metal_type"))


def metal_breakdown(
    serp: DataFrame, classes: DataFrame, keywords=None, limit: int | None = 15, per_query: bool = False
) -> DataFrame:
    """metal_type, n, pct: label counts and shares in percent, one decimal, half-even."""
    counts = metal_summary(_labelled(serp, classes, keywords, limit, per_query))
    # The window covers one row per label.
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))) * 100
    return counts.withColumn("pct", F.bround(share, 1))


def metal_breakdown_by_query(
    serp: DataFrame, classes: DataFrame, keywords=None, limit: int | None = 15, per_query: bool = False
) -> DataFrame:
    """query, metal_type, n."""
    labelled = _labelled(serp, classes, keywords, limit, per_query)
    return labelled.groupBy("query", "metal_type").agg(F.count(F.lit(1)).alias("n"))


def breakdown_summary(breakdown: DataFrame) -> DataFrame:
    """One row: solid_pct, plated_vermeil_pct, summary_code, summary, from a metal breakdown."""

    def pct_of(*labels: str) -> Column:
        shares = [F.coalesce(F.max(F.when(F.col("metal_type") == label, F.col("pct"))), F.lit(0.0)) for label in labels]
        return sum(shares[1:], shares[0])

    shares = breakdown.agg(
        F.count(F.lit(1)).alias("_labels"),
        pct_of(SOLID).alias("solid_pct"),
        pct_of(*PLATED, VERMEIL).alias("plated_vermeil_pct"),
    )
    code = (
        F.when(F.col("_labels") == 0, "no_data")
        .when(F.col("solid_pct") == 0, "none_solid")
        .when(F.col("solid_pct") < FEW_SHARE, "few_solid")
        .when(F.col("solid_pct") < SOME_SHARE, "some_solid")
        .otherwise("many_solid")
    )
    coded = shares.withColumn("summary_code", code)
    texts = coded.withColumns({"_solid": F.col("solid_pct").cast("string"), "_rest": F.col("plated_vermeil_pct").cast("string")})
    return _worded(texts, "summary_code", "summary", SUMMARIES, "_solid", "_rest").drop("_labels", "_solid", "_rest")


def keyword_context(
    serp: DataFrame,
    pages: DataFrame,
    classes: DataFrame,
    keywords=None,
    limit: int | None = 15,
    per_query: bool = False,
) -> DataFrame:
    """Results that have both a page and a label, best positions first.

    Pages and labels are merged on their unique url first, so results pass one join that can be split.
    """
    page = pages.select("url", "page_title", F.lit(True).alias("_page"))
    label = classes.select("url", *_label_columns(classes), F.lit(True).alias("_label"))
    rows = attach(only_keywords(serp.select("query", "position", "url"), keywords), [page, label])
    shown = rows.where(F.col("_page") & F.col("_label")).select(
        "metal_type", "karat", "base_metal", "price_usd", "evidence", "page_title", "query", "position", "url"
    )
    if limit is None:
        return shown
    order = [F.asc("position"), F.asc("query"), F.asc("url")]
    return top_per_group(shown, ["query"], order, limit) if per_query else shown.orderBy(*order).limit(limit)
