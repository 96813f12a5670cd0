"""The digest of a run: at most ten lines per kind of change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankintel.functions.text import ellipsize

# Fixed values of the digest: section order, lines per section, text widths, icons and the sign for no position.
SECTIONS = ("entrants", "dropouts", "price_changes", "pos_shifts")
LINES = 10
QUERY_CHARS, SUBJECT_CHARS = 50, 45
ICONS = {"entrants": "🆕", "dropouts": "👋", "up": "⬆️", "down": "⬇️", "good": "🟢", "bad": "🔴"}
NO_POSITION = "—"
GOOD_DIRECTIONS = ("improved", "entered results")


def _whole(value: Column, sign: str = "") -> Column:
    """Rounded half-even to a whole number, as text."""
    return F.format_string(f"%{sign}d", F.bround(value, 0).cast("bigint"))


def digest_rows(
    entrants: DataFrame,
    dropouts: DataFrame,
    moves: DataFrame,
    shifts: DataFrame,
    cap: int = LINES,
    all_moves: DataFrame | None = None,
) -> DataFrame:
    """section, rank, icon, subject, detail, section_total, overflow; no rows when nothing changed.

    The top lines are pruned per section before the shuffle; totals are a separate count. With `all_moves`, its n_pairs
    are what the price section totals, and `moves` need hold only the pairs that can be among the first lines.
    """

    def text(c: str) -> Column:
        return F.col(c).cast("string")

    def section(df: DataFrame, no: int, icon: Column, subject: Column, detail: Column, size: Column, *sort: Column) -> DataFrame:
        return df.select(
            F.lit(no).alias("section_no"),
            icon.alias("icon"),
            subject.alias("subject"),
            detail.alias("detail"),
            size.cast("bigint").alias("_size"),
            *[k.alias(f"_k{i}") for i, k in enumerate(sort)],
        )

    one, flat = F.lit(1), F.lit(0.0)
    pct = F.col("pct")
    arrow = F.when(pct > 0, ICONS["up"]).otherwise(ICONS["down"])
    price = F.concat(
        F.lit("$"), _whole(F.col("old_price")), F.lit("→$"), _whole(F.col("new_price")), F.lit(" ("), _whole(pct, "+"), F.lit("%)")
    )
    good = F.col("direction").isin(*GOOD_DIRECTIONS)
    light = F.when(good, ICONS["good"]).otherwise(ICONS["bad"])

    def position(c: str) -> Column:
        return F.concat(F.lit("#"), F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("string"), F.lit(NO_POSITION)))

    lines = (
        section(entrants, 1, F.lit(ICONS["entrants"]), F.col("domain"), ellipsize(text("query"), QUERY_CHARS), one, flat, text("query"), F.col("domain"))
        .unionByName(
            section(dropouts, 2, F.lit(ICONS["dropouts"]), F.col("domain"), ellipsize(text("query"), QUERY_CHARS), one, flat, text("query"), F.col("domain"))
        )
        .unionByName(
            section(moves, 3, arrow, ellipsize(text("url"), SUBJECT_CHARS), price, F.col("n_pairs"), -F.abs(pct), text("url"), price)
        )
        .unionByName(
            section(
                shifts, 4, light, ellipsize(text("query"), SUBJECT_CHARS),
                F.concat(position("prev_pos"), F.lit("→"), position("curr_pos")), one, flat, text("query"), F.lit(""),
            )
        )
    )
    sizes = lines.select("section_no", "_size")
    if all_moves is not None:
        sizes = sizes.where("section_no != 3").union(all_moves.select(F.lit(3), "n_pairs"))
    totals = sizes.groupBy("section_no").agg(F.sum("_size").alias("section_total"))
    first = Window.partitionBy("section_no").orderBy("_k0", "_k1", "_k2")
    top = lines.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= cap)
    names = F.array(*[F.lit(s) for s in SECTIONS])
    return top.join(totals, "section_no").select(
        F.element_at(names, F.col("section_no")).alias("section"),
        "rank",
        "icon",
        "subject",
        "detail",
        "section_total",
        F.greatest(F.col("section_total") - cap, F.lit(0)).alias("overflow"),
    )
