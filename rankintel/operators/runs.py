"""Run-over-run comparison: domains entering or leaving the top, our position, prices."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankintel.operators.upsert import last_per_key

# How far down the top reaches, and the smallest position and price changes worth telling.
TOP_DOMAINS = 5
MIN_SHIFT = 3
PRICE_CHANGE = 0.15

#: Bands of price levels to a doubling of the price, and how far outside its price a probe is put.
BANDS = 64
PROBE_MARGIN = 1e-14


def with_run_date(df: DataFrame) -> DataFrame:
    return df if "run_date" in df.columns else df.withColumn("run_date", F.to_date("scraped_at"))


def recent_runs(snapshots: DataFrame, n: int = 2) -> DataFrame:
    """The newest n distinct run dates, newest first."""
    return with_run_date(snapshots).select("run_date").distinct().orderBy(F.desc("run_date")).limit(n)


def latest_pair(snapshots: DataFrame) -> tuple[date | None, date | None]:
    """(current, previous) run date. Two values reach the driver, so that scans can prune by literal dates."""
    found = [r.run_date for r in recent_runs(snapshots, 2).collect()]
    return (*found, None, None)[:2]


def top_n_domains(
    snapshots: DataFrame, results: DataFrame, runs: Sequence[date] | None = None, n: int = TOP_DOMAINS, query: str = "query"
) -> DataFrame:
    """Distinct run_date, query, domain of foreign domains at position n or better; all runs if none are given.

    Positions are unique within a snapshot, so a snapshot adds at most n rows to the join.
    """
    headers = with_run_date(snapshots).select("snapshot_id", F.col(query).alias("query"), "run_date")
    if runs is not None:
        headers = headers.where(F.col("run_date").isin(*runs))
    top = results.where((F.col("position") <= n) & ~F.col("is_ours") & (F.col("domain") != "")).select("snapshot_id", "domain")
    return headers.join(top, "snapshot_id").select("run_date", "query", "domain").distinct()


def entrants(current: DataFrame, previous: DataFrame) -> DataFrame:
    """query, domain pairs of the current top that the previous top lacks."""
    pair = ["query", "domain"]
    return current.select(*pair).join(previous.select(*pair), pair, "left_anti")


def dropouts(current: DataFrame, previous: DataFrame) -> DataFrame:
    """query, domain pairs of the previous top that the current top lacks."""
    return entrants(previous, current)


def our_positions(
    snapshots: DataFrame,
    run: date | None = None,
    order: Sequence[str] = ("scraped_at", "snapshot_id"),
    query: str = "query",
) -> DataFrame:
    """One position per query and run, NULL included; of several headers on a date the last counts."""
    headers = with_run_date(snapshots)
    if run is not None:
        headers = headers.where(F.col("run_date") == F.lit(run))
    narrow = headers.select(F.col(query).alias("query"), "run_date", "our_position", *order)
    return last_per_key(narrow, ["query", "run_date"], list(order)).select("query", "run_date", "our_position")


def _shifts(positions: DataFrame, min_shift: int) -> DataFrame:
    """Rate rows holding curr_pos and prev_pos; pairs that did not move enough are dropped."""
    now, then = F.col("curr_pos"), F.col("prev_pos")
    direction = (
        F.when(now.isNull() & then.isNull(), None)
        .when(then.isNull(), "entered results")
        .when(now.isNull(), "dropped from results")
        .when(F.abs(now - then) >= min_shift, F.when(now < then, "improved").otherwise("dropped"))
    )
    return positions.withColumn("direction", direction).where("direction IS NOT NULL")


def position_shifts(
    snapshots: DataFrame,
    current: date,
    previous: date,
    min_shift: int = MIN_SHIFT,
    order: Sequence[str] = ("scraped_at", "snapshot_id"),
    query: str = "query",
) -> DataFrame:
    """query, prev_pos, curr_pos, direction between two runs.

    A query without a position and one absent from a run read the same, so both runs fold into one
    aggregate per query; no join is needed.
    """
    both = with_run_date(snapshots).where(F.col("run_date").isin(current, previous))

    def position(run: date) -> Column:
        # The order is NULL off the run, and rows of NULL order never win.
        return F.max_by(F.struct("our_position"), F.when(F.col("run_date") == F.lit(run), F.struct(*order)))["our_position"]

    folded = both.groupBy(F.col(query).alias("query")).agg(
        position(previous).alias("prev_pos"), position(current).alias("curr_pos")
    )
    return _shifts(folded, min_shift)


def _priced_days(snapshots: DataFrame, current: date, previous: date, key: str, *more: str) -> DataFrame:
    """_key, price, _is_now of the two days' snapshots with a positive price; NaN and infinity are none."""
    price = F.col("price_usd")
    both = with_run_date(snapshots).where(F.col("run_date").isin(current, previous) & (price > 0) & (price < float("inf")))
    return both.select(
        F.col(key).alias("_key"), F.col("price_usd").alias("price"), (F.col("run_date") == F.lit(current)).alias("_is_now"), *more
    )


def _change(old: Column, new: Column) -> Column:
    """Signed change in percent."""
    return (new - old) / old * 100


def _moved(old: Column, new: Column, pct: float) -> Column:
    return F.abs(new - old) / old > pct


def _urls(products: DataFrame, key: str) -> DataFrame:
    return products.select(F.col(key).alias("_key"), F.col("url").alias("url"))


def price_moves(
    products: DataFrame,
    snapshots: DataFrame,
    current: date,
    previous: date,
    pct: float = PRICE_CHANGE,
    key: str = "url",
    order: Sequence[str] = ("scraped_at",),
) -> DataFrame:
    """Products whose last positive price of the day moved by more than `pct`: url, old_price, new_price, pct, n_pairs.

    One row per product (n_pairs is 1); both days fold into one aggregate. `price_move_pairs` gives every pair of prices
    of the two days, `price_move_ranges` folds them.
    """
    days = _priced_days(snapshots, current, previous, key, *[c for c in order if c != key])
    last = F.struct(*[F.col("_key") if c == key else F.col(c) for c in order])
    # The order is NULL off the day, and rows of NULL order never win.
    newest = days.groupBy("_key").agg(
        F.max_by("price", F.when(~F.col("_is_now"), last)).alias("old_price"),
        F.max_by("price", F.when(F.col("_is_now"), last)).alias("new_price"),
    )
    old, new = F.col("old_price"), F.col("new_price")
    return newest.where(_moved(old, new, pct)).join(_urls(products, key), "_key").select(
        "url", "old_price", "new_price", _change(old, new).alias("pct"), F.lit(1).cast("bigint").alias("n_pairs")
    )


def _price_levels(snapshots: DataFrame, current: date, previous: date, key: str) -> DataFrame:
    """_key, price, then, now: how many snapshots of each day show a product at a price."""
    now = F.col("_is_now").cast("bigint")
    return _priced_days(snapshots, current, previous, key).groupBy("_key", "price").agg(
        F.sum(1 - now).alias("then"), F.sum(now).alias("now")
    )


def price_move_pairs(
    products: DataFrame, snapshots: DataFrame, current: date, previous: date, pct: float = PRICE_CHANGE, key: str = "url"
) -> DataFrame:
    """Every price of one day against every price of the other, where they differ by more than `pct`.

    url, old_price, new_price, pct and n_pairs, a row for each pair of prices of a product; n_pairs tells how many pairs
    of snapshots it stands for, since equal prices are counted before the join. The output, and so the work, grows with
    the square of a product's prices on a day.
    """
    levels = _price_levels(snapshots, current, previous, key)
    now = levels.where("now > 0").select("_key", F.col("price").alias("new_price"), "now")
    then = levels.where("then > 0").select("_key", F.col("price").alias("old_price"), "then")
    old, new = F.col("old_price"), F.col("new_price")
    moved = now.join(then, "_key").where(_moved(old, new, pct))
    # Hashed by price too, so that the pairs of a product with very many prices are not held to one task.
    return moved.repartition("_key", "new_price").join(_urls(products, key), "_key").select(
        "url", "old_price", "new_price", _change(old, new).alias("pct"), (F.col("now") * F.col("then")).alias("n_pairs")
    )


def price_move_ranges(
    products: DataFrame, snapshots: DataFrame, current: date, previous: date, pct: float = PRICE_CHANGE, key: str = "url"
) -> DataFrame:
    """Every price of one day against every price of the other, folded to one row per product that moved.

    url, n_pairs (pairs of snapshots further apart than `pct`), old_price, new_price and pct of the largest such move,
    smallest_pct of the smallest; of equally large moves the rise counts. NULL and non-positive prices take no part.

    No pairs are made. The older day's price levels and two probes for each newer level (the prices from which on the
    older level is far enough below or above) are sorted together, and running counts tell how many snapshots lie
    beyond a probe: linear in the levels but for the sort. A product's levels are sorted in bands of about one
    percent, and a band's neighbours reach it as one summary row each, so that a product with very many levels is not
    held to one task. Probes lie a little outside, and the level next to one is tested itself; the counts are exact
    unless two price levels differ by less than one part in 10^13.
    """
    levels = _price_levels(snapshots, current, previous, key)
    price = F.col("price")

    def row(when: Column, at: Column, rise: bool | None, old: Column, n: str) -> Column:
        return F.when(when, F.struct(at.alias("at"), F.lit(rise).alias("rise"), old.alias("old"), F.col(n).alias("n")))

    level = F.struct(price.alias("price"), F.col("then").alias("n"))
    marks = [
        row(F.col("then") > 0, price, None, level, "then"),
        row(F.col("now") > 0, price / (1 + pct) * (1 - PROBE_MARGIN), True, F.lit(None).cast("struct<price:double,n:bigint>"), "now"),
    ]
    if pct < 1:  # no price falls by all of itself
        marks.append(
            row(F.col("now") > 0, price / (1 - pct) * (1 + PROBE_MARGIN), False, F.lit(None).cast("struct<price:double,n:bigint>"), "now")
        )
    placed = (
        levels.withColumn("price", price.cast("double"))
        .select("_key", "price", F.explode(F.array_compact(F.array(*marks))).alias("_m"))
        .select("_key", "price", "_m.*")
        .withColumn("band", F.floor(F.log2("at") * BANDS).cast("int"))
    )
    older = F.when(F.col("rise").isNull(), F.col("n")).otherwise(0)

    # Inside a band: older snapshots up to a row, the older level before it and the one behind it.
    up = Window.partitionBy("_key", "band").orderBy("at", "rise").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_key", "band").orderBy(F.desc("at"), F.desc("rise")).rowsBetween(Window.unboundedPreceding, 0)
    probes = (
        placed.withColumn("_below", F.sum(older).over(up))
        .withColumn("_low", F.last("old", ignorenulls=True).over(up))
        .withColumn("_high", F.last("old", ignorenulls=True).over(down))
        .where("rise IS NOT NULL")
    )

    # Between bands: a summary row for each, at most BANDS for a doubling of the price.
    bands = placed.groupBy("_key", "band").agg(F.sum(older).alias("_n"), F.min("old").alias("_first"), F.max("old").alias("_last"))
    before = Window.partitionBy("_key").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_key").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    around = bands.select(
        "_key",
        "band",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lower"),
        F.last("_last", ignorenulls=True).over(before).alias("_lower_level"),
        F.last("_first", ignorenulls=True).over(after).alias("_upper_level"),
        F.sum("_n").over(whole).alias("_total"),
        F.min("_first").over(whole)["price"].alias("_least"),
        F.max("_last").over(whole)["price"].alias("_most"),
    )

    low, high = F.coalesce("_low", "_lower_level"), F.coalesce("_high", "_upper_level")
    below, rise = F.col("_below") + F.col("_lower"), F.col("rise")
    near, sure = F.when(rise, high).otherwise(low), F.when(rise, low).otherwise(high)
    near_counts = F.coalesce(_moved(near["price"], price, pct) & F.when(rise, near["price"] < price).otherwise(near["price"] > price), F.lit(False))
    beyond = F.when(rise, below).otherwise(F.col("_total") - below) + F.when(near_counts, near["n"]).otherwise(0)
    edge = F.when(near_counts, near["price"]).otherwise(sure["price"])
    far = F.when(rise, F.col("_least")).otherwise(F.col("_most"))

    def ranked(old: Column, sign: int) -> Column:
        change = _change(old, price)
        return F.struct((sign * F.abs(change)).alias("size"), change.alias("pct"), old.alias("old"), price.alias("new"))

    counted = probes.join(around, ["_key", "band"]).select("_key", "price", rise, "n", beyond.alias("_beyond"), edge.alias("_edge"), far.alias("_far"))
    folded = counted.where("_beyond > 0").groupBy("_key").agg(
        F.sum(F.col("n") * F.col("_beyond")).alias("n_pairs"),
        F.max(ranked(F.col("_far"), 1)).alias("_largest"),
        F.max(ranked(F.col("_edge"), -1)).alias("_smallest"),
    )
    return folded.join(_urls(products, key), "_key").select(
        "url",
        "n_pairs",
        F.col("_largest.old").alias("old_price"),
        F.col("_largest.new").alias("new_price"),
        F.col("_largest.pct").alias("pct"),
        F.col("_smallest.pct").alias("smallest_pct"),
    )


def largest_price_moves(
    products: DataFrame,
    snapshots: DataFrame,
    current: date,
    previous: date,
    ranges: DataFrame,
    n: int = 10,
    pct: float = PRICE_CHANGE,
    key: str = "url",
) -> DataFrame:
    """The pairs of price levels that can be among the n largest moves: url, old_price, new_price, pct, n_pairs.

    `ranges` is what price_move_ranges gives. The n largest pairs belong to the n products with the largest moves, and
    there to the n lowest and n highest levels of either day, since each further level has n better ones before it.
    The urls of `products` are taken to be unique. At most 2 n levels of a day and product are paired.
    """
    chosen = ranges.orderBy(F.desc(F.abs("pct")), F.col("url").cast("string")).limit(n).select("url")
    wanted = F.broadcast(_urls(products, key).join(F.broadcast(chosen), "url"))
    levels = _price_levels(snapshots, current, previous, key).join(wanted, "_key")

    def ends(rows: str, price: str) -> DataFrame:
        shown = levels.where(F.col(rows) > 0).select("url", F.col("price").alias(price), rows)
        cuts = [
            shown.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy(o(price)))).where(F.col("_r") <= n).drop("_r")
            for o in (F.asc, F.desc)
        ]
        return cuts[0].union(cuts[1]).distinct()

    old, new = F.col("old_price"), F.col("new_price")
    pairs = ends("then", "old_price").join(ends("now", "new_price"), "url")
    return pairs.where(_moved(old, new, pct)).select(
        "url", "old_price", "new_price", _change(old, new).alias("pct"), (F.col("then") * F.col("now")).alias("n_pairs")
    )


def _run_calendar(snapshots: DataFrame) -> DataFrame:
    """run_date, prev_run, next_run; one row per calendar day with a run, so a single task is safe."""
    by_date = Window.orderBy("run_date")
    runs = with_run_date(snapshots).select("run_date").distinct()
    return runs.select(
        "run_date", F.lag("run_date").over(by_date).alias("_prev_run"), F.lead("run_date").over(by_date).alias("_next_run")
    )


def _as_pairs(facts: DataFrame, calendar: DataFrame, fact: Sequence[str]) -> DataFrame:
    """Each fact once as the current side of its run and once as the previous side of the run after it."""
    dated = facts.join(calendar, "run_date")
    sides = F.array(
        F.struct(F.col("run_date").alias("cur"), F.col("_prev_run").alias("prev"), F.lit(True).alias("is_cur")),
        F.struct(F.col("_next_run").alias("cur"), F.col("run_date").alias("prev"), F.lit(False).alias("is_cur")),
    )
    return dated.select(*fact, F.explode(sides).alias("_s")).where("_s.cur IS NOT NULL AND _s.prev IS NOT NULL").select(
        *fact, F.col("_s.cur").alias("run_date"), F.col("_s.prev").alias("prev_run_date"), F.col("_s.is_cur").alias("_is_cur")
    )


def run_position_shifts(
    snapshots: DataFrame, min_shift: int = MIN_SHIFT, order: Sequence[str] = ("scraped_at", "snapshot_id"), query: str = "query"
) -> DataFrame:
    """position_shifts for every pair of consecutive runs at once, in one aggregate per query and pair."""
    facts = our_positions(snapshots, order=order, query=query)
    sided = _as_pairs(facts, _run_calendar(snapshots), ["query", "our_position"])
    folded = sided.groupBy("run_date", "prev_run_date", "query").agg(
        F.max(F.when(~F.col("_is_cur"), F.col("our_position"))).alias("prev_pos"),
        F.max(F.when(F.col("_is_cur"), F.col("our_position"))).alias("curr_pos"),
    )
    return _shifts(folded, min_shift)


def run_domain_changes(
    snapshots: DataFrame, results: DataFrame, n: int = TOP_DOMAINS, query: str = "query"
) -> DataFrame:
    """Entrants and dropouts for every pair of consecutive runs at once: run_date, prev_run_date, change, query, domain."""
    facts = top_n_domains(snapshots, results, n=n, query=query)
    sided = _as_pairs(facts, _run_calendar(snapshots), ["query", "domain"])
    folded = sided.groupBy("run_date", "prev_run_date", "query", "domain").agg(
        F.bool_or("_is_cur").alias("_now"), F.bool_or(~F.col("_is_cur")).alias("_then")
    )
    return folded.where("_now != _then").select(
        "run_date", "prev_run_date", F.when(F.col("_now"), "entrant").otherwise("dropout").alias("change"), "query", "domain"
    )


def run_diffs(
    snapshots: DataFrame,
    results: DataFrame,
    n: int = TOP_DOMAINS,
    min_shift: int = MIN_SHIFT,
    order: Sequence[str] = ("scraped_at", "snapshot_id"),
    query: str = "query",
) -> DataFrame:
    """All run-over-run changes of the whole history: domain changes and position shifts in one shape."""
    shifts = run_position_shifts(snapshots, min_shift, order, query).select(
        "run_date", "prev_run_date", F.lit("shift").alias("change"), "query", F.lit(None).cast("string").alias("domain"),
        "prev_pos", "curr_pos", "direction",
    )
    domains = run_domain_changes(snapshots, results, n, query)
    return domains.unionByName(shifts, allowMissingColumns=True)
