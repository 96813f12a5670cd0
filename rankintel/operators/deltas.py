"""Field-level change log and snapshot change flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankintel.functions.text import cut, float_text, strip
from rankintel.operators.previous import with_previous
from rankintel.operators.upsert import last_per_key

# The tracked fields, the smallest price step that counts, and the compared and stored text widths.
TRACKED_FIELDS = ("metal_type", "karat", "price_usd")
PRICE_STEP = 0.01
COMPARED_CHARS, TITLE_CHARS, DESCRIPTION_CHARS = 200, 120, 300


def _as_text(df: DataFrame, field: str) -> Column:
    value = F.col(field)
    return float_text(value) if dict(df.dtypes)[field] in ("double", "float") else value.cast("string")


def detect_deltas(
    classes: DataFrame,
    deltas: DataFrame | None,
    detected_at: Column,
    fields: Sequence[str] = TRACKED_FIELDS,
    key: str = "url",
    order: Sequence[str] = ("detected_at",),
) -> DataFrame:
    """New change rows: a baseline per url and field never logged, a change where the last logged value differs.

    `order` sorts the log; add a tie-break when timestamps repeat. The log is reduced to its newest row per
    url and field by a top-1 window before it meets the (unique) labels.
    """
    current = classes.select(key, *[_as_text(classes, f).alias(f) for f in fields]).unpivot(
        key, list(fields), "field", "new_value"
    )
    if deltas is None:
        changed = current.withColumn("old_value", F.lit(None).cast("string"))
    else:
        logged = last_per_key(deltas, [key, "field"], list(order)).select(
            key, "field", F.col("new_value").alias("old_value"), F.lit(True).alias("_logged")
        )
        changed = current.join(logged, [key, "field"], "left").where(
            F.col("_logged").isNull() | ~F.col("old_value").eqNullSafe(F.col("new_value"))
        )
    return changed.select(key, "field", "old_value", "new_value", detected_at.alias("detected_at"))


def delta_log(
    history: DataFrame,
    fields: Sequence[str] = TRACKED_FIELDS,
    key: str = "url",
    order: Sequence[str] = ("scraped_at",),
    chunk: Column | None = None,
) -> DataFrame:
    """The change log a run after every observation would have accumulated, in one pass.

    Rows stay wide until the changes are known; only changed fields are exploded.
    """
    wide = history.select(key, *order, *[_as_text(history, f).alias(f) for f in fields])
    seen = with_previous(wide, [key], list(order), list(fields), chunk)
    before = F.col("previous")
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                before[f].alias("old_value"),
                F.col(f).alias("new_value"),
                (before.isNull() | ~before[f].eqNullSafe(F.col(f))).alias("changed"),
            )
            for f in fields
        ]
    )
    changed = F.explode(F.filter(cells, lambda c: c["changed"]))
    return seen.select(key, *order, changed.alias("_cell")).select(
        key, "_cell.field", "_cell.old_value", "_cell.new_value", F.col(order[0]).alias("detected_at")
    )


def snapshot_change_flags(
    snapshots: DataFrame,
    products: DataFrame | None = None,
    key: str = "url",
    order: Sequence[str] = ("scraped_at",),
    chunk: Column | None = None,
    compared_chars: int | None = COMPARED_CHARS,
    description_chars: int | None = DESCRIPTION_CHARS,
    title_chars: int | None = TITLE_CHARS,
) -> DataFrame:
    """Add price_changed and description_changed against the product's preceding snapshot.

    With a product registry only registered products are kept. Stored texts are cut and defaulted, and descriptions
    are compared by their first characters; a width of None takes the whole text. Whole descriptions are compared by
    their hash, so that no long text goes along with the snapshot after it.
    """
    tracked = snapshots if products is None else snapshots.join(products.select(key), key, "left_semi")
    columns = set(tracked.columns)
    whole = strip(F.coalesce("description", F.lit("")))
    said = F.when(whole == "", "").otherwise(F.sha2(whole, 256)) if compared_chars is None else cut(whole, compared_chars)
    trimmed = tracked.withColumn("_said", said)
    seen = with_previous(trimmed, [key], list(order), ["price_usd", "_said"], chunk)
    before = F.col("previous")
    price = F.abs(F.col("price_usd") - before["price_usd"]) > PRICE_STEP
    said = (F.col("_said") != "") & (before["_said"] != "") & (F.col("_said") != before["_said"])
    flagged = seen.withColumn("price_changed", F.coalesce(price, F.lit(False))).withColumn(
        "description_changed", F.coalesce(said, F.lit(False))
    )
    stored = {"description": cut(F.coalesce("description", F.lit("")), description_chars)}
    if "title" in columns:
        stored["title"] = cut(F.coalesce("title", F.lit("")), title_chars)
    for name in ("metal_type", "karat", "availability"):
        if name in columns:
            stored[name] = F.coalesce(name, F.lit("unknown"))
    if "materials" in columns:
        stored["materials"] = F.coalesce("materials", F.lit(""))
    return flagged.withColumns(stored).drop("previous", "_said")
