import random
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankintel.functions.text import float_text
from rankintel.operators import deltas, runs
from rankintel.operators.digest import digest_rows
from rankintel.operators.previous import with_previous
from rankintel.plans.catalog import queries

DAY1, DAY2 = date(2024, 1, 1), date(2024, 1, 8)


def stamped(df):
    return df.withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))


def history(spark, values, column="metal_type", kind="string"):
    data = [("u", f"2024-01-{i + 1:02d} 00:00:00", v) for i, v in enumerate(values)]
    return stamped(spark.createDataFrame(data, f"url string, scraped_at string, {column} {kind}"))


def test_delta_log_tells_nulls_apart(spark):
    log = deltas.delta_log(history(spark, [None, "14k", "14k", None]), ["metal_type"]).orderBy("detected_at").collect()
    assert [(r.old_value, r.new_value) for r in log] == [(None, None), (None, "14k"), ("14k", None)]


def test_delta_log_equals_repeated_detection(spark, rows):
    rng = random.Random(7)
    data = [
        (f"u{rng.randrange(4)}", f"2024-01-{1 + n // 8:02d} {n % 8:02d}:00:00", rng.choice([None, "a", "b"]), rng.choice([None, 1.0, 2.5]))
        for n in range(48)
    ]
    df = stamped(spark.createDataFrame(data, "url string, scraped_at string, metal_type string, price_usd double"))
    fields = ["metal_type", "price_usd"]
    log = None
    for stamp in sorted({d[1] for d in data}):
        new = deltas.detect_deltas(df.where(F.col("scraped_at") == F.lit(stamp).cast("timestamp")), log, F.lit(stamp).cast("timestamp"), fields)
        grown = new if log is None else log.unionByName(new)
        log = spark.createDataFrame(grown.collect(), new.schema)
    assert rows(log) == rows(deltas.delta_log(df, fields))


def test_price_text(spark):
    values = [(0.0,), (124.0,), (12.5,), (12345678.9,), (10000000.0,), (None,), (-15000000.25,)]
    got = [r[0] for r in spark.createDataFrame(values, "p double").select(float_text(F.col("p"))).collect()]
    assert got == ["0.0", "124.0", "12.5", "12345678.9", "10000000.0", None, "-15000000.25"]


def test_price_flags(spark):
    df = history(spark, [10.0, 10.01, 10.02, None, 12.0, 12.5], "price_usd", "double").withColumn("description", F.lit(" same "))
    got = deltas.snapshot_change_flags(df).orderBy("scraped_at").collect()
    # 10.02 - 10.01 is a hair below a cent and 10.01 - 10.00 too; NULL never flags.
    assert [r.price_changed for r in got] == [abs(10.01 - 10.0) > 0.01 if i == 1 else abs(10.02 - 10.01) > 0.01 if i == 2 else i == 5 for i in range(6)]
    assert not any(r.description_changed for r in got)


def test_description_flags(spark):
    long = "x" * 200
    df = history(spark, ["a", " a ", "", "b", "c", long + "1", long + "2"], "description").withColumn("price_usd", F.lit(1.0))
    got = deltas.snapshot_change_flags(df).orderBy("scraped_at").collect()
    assert [r.description_changed for r in got] == [False, False, False, False, True, True, False]


def test_flags_keep_only_registered_products(spark):
    df = history(spark, [1.0, 2.0], "price_usd", "double").withColumn("description", F.lit(None).cast("string"))
    assert deltas.snapshot_change_flags(df, spark.createDataFrame([("other",)], "url string")).count() == 0
    assert deltas.snapshot_change_flags(df, spark.createDataFrame([("u",)], "url string")).first().description == ""


def test_previous_equals_lag_with_a_hot_key(spark, rows):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}", rng.randrange(400), n, rng.choice([None, "a", "b"])) for n in range(600)]
    df = spark.createDataFrame(data, "k string, t int, id int, v string")
    chunked = with_previous(df, ["k"], ["t", "id"], ["v"], F.floor(F.col("t") / 50))
    plain = df.withColumn("previous", F.lag(F.struct("v")).over(Window.partitionBy("k").orderBy("t", "id")))
    shape = ("k", "id", F.col("previous").isNull(), F.col("previous.v"))
    assert rows(chunked, *shape) == rows(plain, *shape)


def heads(spark, data):
    df = spark.createDataFrame(data, "query string, run_date date, our_position int, snapshot_id long")
    return df.withColumn("scraped_at", F.col("run_date").cast("timestamp"))


def test_position_shifts(spark, rows):
    pairs = [("a", 5, 2), ("b", 5, 3), ("c", None, 4), ("d", 4, None), ("e", None, None), ("f", 1, 4)]
    data = [(q, day, p, 1) for q, before, after in pairs for day, p in ((DAY1, before), (DAY2, after))]
    data += [("g", DAY2, 1, 1), ("h", DAY1, 1, 1), ("a", DAY2, 1, 0)]
    expected = [
        ("a", 5, 2, "improved"), ("c", None, 4, "entered results"), ("d", 4, None, "dropped from results"),
        ("f", 1, 4, "dropped"), ("g", None, 1, "entered results"), ("h", 1, None, "dropped from results"),
    ]
    snaps = heads(spark, data)
    assert rows(runs.position_shifts(snaps, DAY2, DAY1), "query", "prev_pos", "curr_pos", "direction") == expected
    assert rows(runs.run_position_shifts(snaps), "query", "prev_pos", "curr_pos", "direction") == expected


def test_last_header_of_a_day_counts_even_if_null(spark, rows):
    snaps = heads(spark, [("a", DAY1, 3, 1), ("a", DAY1, None, 2)])
    assert rows(runs.our_positions(snaps), "query", "our_position") == [("a", None)]


def tops(spark, current, previous):
    shape = "query string, domain string"
    return spark.createDataFrame(current, shape), spark.createDataFrame(previous, shape)


def test_entrants_and_dropouts_swap(spark, rows):
    now, then = tops(spark, [("q", "a"), ("q", "b"), ("r", "a")], [("q", "b"), ("q", "c")])
    assert rows(runs.entrants(now, then)) == [("q", "a"), ("r", "a")]
    assert rows(runs.dropouts(now, then)) == [("q", "c")] == rows(runs.entrants(then, now))


def priced(spark, data):
    df = spark.createDataFrame(data, "url string, scraped_at string, price_usd double")
    return stamped(df)


def test_price_moves(spark, rows):
    data = [
        ("same", "2024-01-01 01:00:00", 100.0), ("same", "2024-01-08 01:00:00", 115.0),
        ("up", "2024-01-01 01:00:00", 100.0), ("up", "2024-01-08 01:00:00", 116.0),
        ("free", "2024-01-01 01:00:00", 0.0), ("free", "2024-01-08 01:00:00", 116.0),
        ("twice", "2024-01-01 01:00:00", 10.0), ("twice", "2024-01-01 02:00:00", 10.0), ("twice", "2024-01-01 03:00:00", 19.0),
        ("twice", "2024-01-08 01:00:00", 20.0), ("gone", "2024-01-01 01:00:00", 5.0),
    ]
    snaps = priced(spark, data)
    products = spark.createDataFrame([("same",), ("up",), ("free",), ("twice",), ("gone",)], "url string")
    shape = ("url", "old_price", "new_price", F.bround("pct", 6), "n_pairs")
    assert rows(runs.price_move_ranges(products, snaps, DAY2, DAY1), *shape) == [("twice", 10.0, 20.0, 100.0, 2), ("up", 100.0, 116.0, 16.0, 1)]
    assert rows(runs.price_moves(products, snaps, DAY2, DAY1), *shape) == [("up", 100.0, 116.0, 16.0, 1)]


def all_pairs(data, pct):
    """url -> every pair of an old and a new price that differ by more than pct, by two loops."""
    found = {}
    for url in {u for u, _, _ in data}:
        then = [p for u, at, p in data if u == url and at[:10] == str(DAY1) and p and p > 0]
        now = [p for u, at, p in data if u == url and at[:10] == str(DAY2) and p and p > 0]
        pairs = [((new - old) / old * 100, old, new) for old in then for new in now if abs(new - old) / old > pct]
        if pairs:
            found[url] = pairs
    return found


@pytest.mark.parametrize("pct", [0.0, 0.15, 0.5, 1.5])
def test_price_ranges_against_loops(spark, pct):
    draw = random.Random(7)
    data = []
    for product in range(40):
        # Few, close and round prices, so that pairs lie exactly at the threshold and copies are common.
        prices = [draw.choice([20.0, 23.0, 10.0, 11.5, 17.0, 40.0, 46.0, 0.01, 1e6, 0.0, None]) for _ in range(12)]
        prices += [round(draw.uniform(90, 140), 2) for _ in range(draw.randrange(30))]
        days = [draw.choice([DAY1, DAY2]) for _ in prices]
        data += [(f"u{product}", f"{day} 0{draw.randrange(10)}:00:00", price) for day, price in zip(days, prices, strict=True)]
    products = spark.createDataFrame([(f"u{n}",) for n in range(40)], "url string")
    snaps = priced(spark, data)
    ranges = runs.price_move_ranges(products, snaps, DAY2, DAY1, pct)
    got = {r.url: (r.n_pairs, r.pct, r.old_price, r.new_price, r.smallest_pct) for r in ranges.collect()}
    pairs = all_pairs(data, pct)
    want = {}
    for url, found in pairs.items():
        largest = max(found, key=lambda p: (abs(p[0]), p[0]))
        want[url] = (len(found), *largest, max(found, key=lambda p: (-abs(p[0]), p[0]))[0])
    assert got == want

    top = runs.largest_price_moves(products, snaps, DAY2, DAY1, ranges, 10, pct)
    seen = sorted({(-abs(p[0]), url, p[1], p[2]) for url, found in pairs.items() for p in found})
    rows = sorted((-abs(r.pct), r.url, r.old_price, r.new_price) for r in top.collect())
    assert [(size, url) for size, url, *_ in rows[:10]] == [(size, url) for size, url, *_ in seen[:10]]


def test_price_pairs_are_all_rows(spark):
    draw = random.Random(11)
    data = [(f"u{draw.randrange(4)}", f"{draw.choice([DAY1, DAY2])} 01:00:00", draw.choice([20.0, 23.0, 23.5, 10.0, 0.0, None])) for _ in range(80)]
    products = spark.createDataFrame([("u0",), ("u1",), ("u2",), ("other",)], "url string")
    want = Counter((url, old, new) for url, found in all_pairs(data, 0.15).items() if url != "u3" for _, old, new in found)
    got = runs.price_move_pairs(products, priced(spark, data), DAY2, DAY1).collect()
    assert len(got) == len(want) and {(r.url, r.old_price, r.new_price): r.n_pairs for r in got} == dict(want)


def test_price_moves_query_gives_every_pair(spark, tmp_path):
    spark.range(6).selectExpr(
        "id AS event_id", "1L AS user_id", f"cast(if(id % 2 = 0, '{DAY1}', '{DAY2}') AS timestamp_ntz) AS ts", "'view' AS event_type",
        "double(10 + 5 * id) AS value", "'' AS props",
    ).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(1).selectExpr("1L AS l_partkey", "1L AS l_suppkey", f"cast('{DAY1}' AS timestamp_ntz) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = {(r.old_price, r.new_price) for r in queries()["price_moves"](spark, str(tmp_path)).collect()}
    assert pairs == {(old, new) for old in (10.0, 20.0, 30.0) for new in (15.0, 25.0, 35.0) if abs(new - old) / old > 0.15}


def test_many_price_levels_give_one_row(spark):
    at = {0: DAY1, 1: DAY2}
    snaps = spark.range(4000).selectExpr(
        "'hot' url", f"timestamp(if(id % 2 = 0, '{at[0]}', '{at[1]}')) scraped_at", "double(100 + (id div 2) % 2000) price_usd"
    )
    products = spark.createDataFrame([("hot",)], "url string")
    (row,) = runs.price_move_ranges(products, snaps, DAY2, DAY1).collect()
    levels = range(100, 2100)
    assert row.n_pairs == sum(abs(new - old) / old > 0.15 for old in levels for new in levels)
    assert (row.old_price, row.new_price, row.pct) == (100.0, 2099.0, 1999 / 100 * 100)


def test_price_ranges_without_rows(spark):
    products = spark.createDataFrame([], "url string")
    assert runs.price_move_ranges(products, priced(spark, []), DAY2, DAY1).collect() == []


def test_prices_that_are_no_numbers_take_no_part(spark):
    odd = [float("nan"), float("inf"), -1.0, 0.0, None]
    data = [("u", f"{day} 0{i}:00:00", p) for day in (DAY1, DAY2) for i, p in enumerate(odd)]
    data += [("u", f"{DAY1} 09:00:00", 10.0), ("u", f"{DAY2} 09:00:00", 5.0)]
    products, snaps = spark.createDataFrame([("u",)], "url string"), priced(spark, data)
    (row,) = runs.price_move_ranges(products, snaps, DAY2, DAY1).collect()
    assert (row.n_pairs, row.old_price, row.new_price, row.pct, row.smallest_pct) == (1, 10.0, 5.0, -50.0, -50.0)
    (last,) = runs.price_moves(products, snaps, DAY2, DAY1).collect()
    assert (last.old_price, last.new_price) == (10.0, 5.0)


def test_one_run_has_no_pair(spark):
    assert runs.latest_pair(heads(spark, [("a", DAY1, 1, 1)])) == (DAY1, None)
    assert runs.latest_pair(heads(spark, [])) == (None, None)


@pytest.mark.parametrize("count", [0, 12])
def test_digest(spark, count):
    now, then = tops(spark, [("q" * 60, f"d{n:02d}") for n in range(count)], [])
    moves = spark.createDataFrame(
        [("https://a.example/" + "p" * 40, 100.0, 120.0, 20.0, 1), ("b", 10.0, 5.0, -50.0, 3)][: count],
        "url string, old_price double, new_price double, pct double, n_pairs long",
    )
    shifts = spark.createDataFrame(
        [("q", None, 4, "entered results"), ("r", 1, 9, "dropped")][:count], "query string, prev_pos int, curr_pos int, direction string"
    )
    got = digest_rows(now, then, moves, shifts).orderBy("section", "rank").collect()
    if not count:
        assert got == []
        return
    by = {}
    for r in got:
        by.setdefault(r.section, []).append(r)
    assert len(by["entrants"]) == 10 and by["entrants"][0].section_total == 12 and by["entrants"][0].overflow == 2
    assert by["entrants"][0].detail == "q" * 49 + "…" and by["entrants"][0].subject == "d00"
    assert [(r.icon, r.subject, r.detail) for r in by["price_changes"]] == [
        ("⬇️", "b", "$10→$5 (-50%)"), ("⬆️", ("https://a.example/" + "p" * 40)[:44] + "…", "$100→$120 (+20%)"),
    ]
    assert by["price_changes"][0].section_total == 4
    assert [(r.icon, r.detail) for r in by["pos_shifts"]] == [("🟢", "#—→#4"), ("🔴", "#1→#9")]
