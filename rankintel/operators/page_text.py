"""Page html to plain text, and the guard for pages too thin to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankintel.functions.jsonld import BROKEN_BLOCK_CHARS, LEAF_LIMIT, jsonld_blocks, leaves_of
from rankintel.functions.text import cut, first_match, is_blank, squeeze, strip
from rankintel.session import bounded_batches

# Fixed values of the text form: patterns, the joiner and the three lengths.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
INLINE_PRODUCT = r'"product"\s*:\s*(\{[^}]{20,500}\})'
SCRIPT = r"(?is)<script[^>]*>.*?</script>"
STYLE = r"(?is)<style[^>]*>.*?</style>"
TAG = r"<[^>]+>"
JOINER = " | "
THIN_TEXT, BODY_CHARS, TEXT_CHARS = 100, 3000, 8000

# Shortest readable product page and listing page, width of a fallback reason.
PRODUCT_PAGE_CHARS, LISTING_PAGE_CHARS, REASON_CHARS = 300, 500, 120


def jsonld_leaves(
    df: DataFrame, html: str = "html", leaf_limit: int | None = LEAF_LIMIT, broken_chars: int | None = BROKEN_BLOCK_CHARS
) -> DataFrame:
    """All input columns but the html, with block, seq, key and value of each JSON-LD leaf."""
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c != html]
    leaves = df.select(*kept, leaves_of(jsonld_blocks(F.col(html)), leaf_limit, broken_chars).alias("_leaves"))
    return leaves.select(*kept, F.explode("_leaves").alias("_leaf")).select(*kept, "_leaf.*")


def html_to_text(
    df: DataFrame,
    html: str = "html",
    out: str = "page_text",
    max_chars: int | None = TEXT_CHARS,
    body_chars: int | None = BODY_CHARS,
    thin_chars: int = THIN_TEXT,
    leaf_limit: int | None = LEAF_LIMIT,
    broken_chars: int | None = BROKEN_BLOCK_CHARS,
) -> DataFrame:
    """Add the page's text: title, JSON-LD leaves and inline product, plus the stripped body if these are thin.

    The widths are for a reader that pays by length: they cut the body, the text and unreadable blocks, and leave out
    long leaves. None keeps all of it.
    """
    bounded_batches(df.sparkSession)
    page = F.col(html)
    body = squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(page, SCRIPT, " "), STYLE, " "), TAG, " "))
    leaf_text = F.transform(
        "_leaves", lambda x: F.when(x["key"] == "", x["value"]).otherwise(F.concat(x["key"], F.lit(": "), x["value"]))
    )
    parts = df.withColumn("_leaves", leaves_of(jsonld_blocks(page), leaf_limit, broken_chars)).withColumn(
        "_parts",
        F.array_compact(
            F.concat(F.array(strip(first_match(page, TITLE))), leaf_text, F.array(first_match(page, INLINE_PRODUCT)))
        ),
    )
    thin = F.length(F.array_join("_parts", " ")) < thin_chars
    whole = F.when(thin, F.array_append("_parts", cut(body, body_chars))).otherwise(F.col("_parts"))
    text = cut(squeeze(F.array_join(F.filter(whole, lambda p: ~is_blank(p)), JOINER)), max_chars)
    return parts.withColumn(out, text).drop("_leaves", "_parts")


def page_guard(
    df: DataFrame,
    min_chars: int = PRODUCT_PAGE_CHARS,
    html: str = "html",
    text: str | None = None,
    blank_reason: str = "could not extract text from HTML",
    out: str = "fallback_reason",
    chars: str | None = None,
) -> DataFrame:
    """Add why a page cannot be classified: too short, or without text; NULL for a readable page.

    `chars` names a column with the length of the html where the html itself is no longer at hand.
    """
    size = F.coalesce(F.length(html) if chars is None else F.col(chars), F.lit(0))
    reason = F.when(size < min_chars, F.format_string("empty page (%d chars)", size))
    if text is not None:
        reason = reason.when(is_blank(F.col(text)), F.lit(blank_reason))
    return df.withColumn(out, reason)
