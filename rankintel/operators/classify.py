"""Product labels: a batch classifier given by the user, or ordered rules; and parsing of model answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankintel.functions import labels as L
from rankintel.functions.text import cut, first_match, or_else, strip, to_number
from rankintel.operators.page_text import REASON_CHARS, page_guard

# The label fields with the default of each, and the cuts of two of them.
LABEL_DEFAULTS: dict[str, str | None] = {
    "metal_type": "unknown",
    "karat": "unknown",
    "base_metal": "unknown",
    "price_usd": None,
    "price_raw": None,
    "title": "",
    "description": "",
    "materials": "",
    "availability": "unknown",
    "evidence": "",
    "confidence": "low",
}
LABEL_FIELDS = tuple(LABEL_DEFAULTS)
FENCE_OPEN, FENCE_CLOSE = r"\A```[a-z]*\n?", r"\n?```\z"
TITLE_CHARS, DESCRIPTION_CHARS = 120, 300

Classifier = Callable[[pd.Series], pd.DataFrame]


def _typed(name: str, value: Column | None) -> Column:
    kind = "double" if name == "price_usd" else "string"
    default = LABEL_DEFAULTS[name]
    column = F.lit(None) if value is None else value
    if default is not None:
        column = F.coalesce(column, F.lit(default))
    return column.cast(kind).alias(name)


def fallback_labels(reason: Column) -> list[Column]:
    """The label columns of a page that could not be classified."""
    evidence = F.substring(F.concat(F.lit("fallback: "), reason), 1, REASON_CHARS)
    return [_typed(name, evidence if name == "evidence" else None) for name in LABEL_FIELDS]


def parse_model_json(df: DataFrame, raw: str = "raw_response", keep: list[str] | None = None) -> DataFrame:
    """Label columns from the text of a model's answer; an unreadable answer gives the fallback labels.

    `in_vocabulary` tells whether all coded fields hold known codes; the codes themselves are kept as given.
    """
    kept = [c for c in df.columns if c != raw] if keep is None else keep
    bare = F.regexp_replace(F.regexp_replace(strip(F.col(raw)), FENCE_OPEN, ""), FENCE_CLOSE, "")
    parsed = df.select(*kept, F.try_parse_json(bare).alias("_answer"))
    readable = F.coalesce(F.startswith(F.schema_of_variant("_answer"), F.lit("OBJECT")), F.lit(False))
    fallback = dict(zip(LABEL_FIELDS, fallback_labels(F.lit("JSON parse error"))))

    def field(name: str) -> Column:
        text = F.try_variant_get("_answer", f"$.{name}", "string")
        value = _typed(name, to_number(text) if name == "price_usd" else text)
        return F.when(readable, value).otherwise(fallback[name]).alias(name)

    coded = {
        "metal_type": L.METAL_TYPES,
        "karat": L.KARATS,
        "base_metal": L.BASE_METALS,
        "availability": L.AVAILABILITIES,
        "confidence": L.CONFIDENCES,
    }
    known = F.lit(True)
    for name, codes in coded.items():
        known = known & F.col(name).isin(*codes)
    return parsed.select(*kept, *[field(name) for name in LABEL_FIELDS]).withColumn("in_vocabulary", known)


def rule_labels(
    df: DataFrame, text: str, rules: list[L.Rule] | tuple[L.Rule, ...], out: str = "label", default: str = "unknown"
) -> DataFrame:
    """Add the label of the first rule found in the text (built-in expressions only)."""
    return df.withColumn(out, L.first_rule(F.col(text), rules, default))


def _labels_by_rule(
    df: DataFrame, text: str, metal_rules, title_chars: int | None = TITLE_CHARS, description_chars: int | None = DESCRIPTION_CHARS
) -> DataFrame:
    words = F.col(text)
    named = df.withColumn("_metal", L.first_rule(words, metal_rules)).withColumn("_karat", L.first_rule(words, L.KARAT_RULES))
    metal, karat = F.col("_metal"), F.col("_karat")
    found = {
        "metal_type": metal,
        "karat": karat,
        "base_metal": L.first_rule(words, L.BASE_METAL_RULES),
        "price_usd": to_number(first_match(words, L.DOLLAR_PRICE)),
        "price_raw": first_match(words, L.DOLLAR_PRICE, 0),
        "title": cut(F.substring_index(words, " | ", 1), title_chars),
        "description": cut(words, description_chars),
        "materials": F.when(karat != "unknown", F.concat(karat, F.lit(" gold"))),
        "availability": L.first_rule(words, L.AVAILABILITY_RULES),
        "evidence": L.rule_quote(words, metal_rules),
        "confidence": F.when(metal == "unknown", "low").when(karat == "unknown", "medium").otherwise("high"),
    }
    return named.select(*df.columns, *[_typed(name, found[name]) for name in LABEL_FIELDS])


def classify_products(
    df: DataFrame,
    text: str = "page_text",
    classifier: Classifier | None = None,
    metal_rules: tuple[L.Rule, ...] | list[L.Rule] = L.METAL_RULES,
    title_chars: int | None = TITLE_CHARS,
    description_chars: int | None = DESCRIPTION_CHARS,
) -> DataFrame:
    """Replace the text column by the label columns.

    Rules read the whole text; the widths are those of the title and description they report (None: whole).

    `classifier` takes a pandas Series of texts and returns a DataFrame with any of the label columns; it
    runs on Arrow batches. Without one the ordered rules decide, inside the JVM.
    """
    kept = [c for c in df.columns if c != text and c not in LABEL_FIELDS]
    narrow = df.select(*kept, text)
    if classifier is None:
        return _labels_by_rule(narrow, text, metal_rules, title_chars, description_chars).drop(text)
    fields = [f for f in narrow.schema.fields if f.name != text]
    label_types = [T.StructField(n, T.DoubleType() if n == "price_usd" else T.StringType()) for n in LABEL_FIELDS]
    schema = T.StructType(fields + label_types)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = classifier(batch[text]).set_axis(batch.index).reindex(columns=list(LABEL_FIELDS))
            prices = pd.to_numeric(answers["price_usd"])
            # Plain objects: Spark's Arrow writer does not take every string type pandas may choose.
            yield pd.concat([batch[kept], answers.astype(object).assign(price_usd=prices)], axis=1)

    raw = narrow.mapInPandas(label, schema)
    return raw.select(*kept, *[_typed(name, F.col(name)) for name in LABEL_FIELDS])


def label_pages(
    pages: DataFrame,
    min_chars: int,
    blank_reason: str,
    classifier: Classifier | None = None,
    html_chars: str = "html_chars",
    text: str = "page_text",
) -> DataFrame:
    """Guard and classify pages already reduced to their text; thin pages get the fallback labels.

    Rules label in one pass over the pages; a classifier of the user's own is not asked about thin pages.
    """
    kept = [c for c in pages.columns if c not in (html_chars, text)]
    reason = F.col("_reason")
    judged = page_guard(pages, min_chars, text=text, blank_reason=blank_reason, out="_reason", chars=html_chars)
    if classifier is None:
        labelled = classify_products(judged, text)
        thin = dict(zip(LABEL_FIELDS, fallback_labels(reason)))
        return labelled.select(
            *kept, *[F.when(reason.isNull(), F.col(n)).otherwise(thin[n]).alias(n) for n in LABEL_FIELDS]
        )
    thin = judged.where(reason.isNotNull()).select(*kept, *fallback_labels(reason))
    good = classify_products(judged.where(reason.isNull()).select(*kept, text), text, classifier)
    return good.unionByName(thin)


def unread_pages(labels: DataFrame, read: str, reason: Column) -> DataFrame:
    """The fallback labels where the column `read` is NULL, because no page was there to be labelled; drops it."""
    fallback = dict(zip(LABEL_FIELDS, fallback_labels(reason)))
    found = F.col(read).isNotNull()
    return labels.select(
        *[
            F.when(found, F.col(c)).otherwise(fallback[c]).alias(c) if c in fallback else F.col(c)
            for c in labels.columns
            if c != read
        ]
    )


def classification_row(labels: DataFrame, classified_at: Column, url: str = "url") -> DataFrame:
    """The columns the label table keeps."""
    return labels.select(
        F.col(url).alias("url"),
        "metal_type",
        "karat",
        "base_metal",
        "price_usd",
        or_else(F.col("evidence"), "").alias("evidence"),
        "confidence",
        classified_at.alias("classified_at"),
    )
