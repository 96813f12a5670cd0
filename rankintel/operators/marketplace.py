"""Ranked marketplace results of saved marketplace search pages, entirely with built-in expressions.

Each page is one row and its listings one array, so running counts, deduplication and the cut are array
functions inside the row: no shuffle. The array is exploded last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankintel.functions.jsonld import (
    block_roots,
    first_offer,
    kind,
    offer_price,
    part_at,
    text_at,
    typed,
)
from rankintel.functions.labels import DOLLAR_PRICE
from rankintel.functions.text import first_match, or_else, strip, to_number
from rankintel.functions.urls import listing_id_of, without_query

# Fixed values of the marketplace's page format.
MARKETPLACE_DOMAIN = "etsy.com"
LISTING_MARK = "data-listing-id="
LISTING_QUOTED = r"""^["'](\d+)(["'])"""
LISTING_HEADING = r"<h[23][^>]*>\s*([^<]{10,200})\s*</h[23]>"
CHARS_BEFORE, CHARS_AFTER = 200, 1000

RESULT_TYPE = (
    "array<struct<position:int,listing_id:string,url:string,title:string,price_usd:double,"
    "shop:string,reviews:int,star_seller:boolean>>"
)


def _listing(position: Column, listing_id: Column, url: Column, title: Column, price: Column, star: Column) -> Column:
    return F.struct(
        position.cast("int").alias("position"),
        listing_id.alias("listing_id"),
        without_query(url).alias("url"),
        title.alias("title"),
        price.alias("price_usd"),
        F.lit(None).cast("string").alias("shop"),
        F.lit(None).cast("int").alias("reviews"),
        star.alias("star_seller"),
    )


def _whole(position: Column) -> Column:
    """A stated position: a whole number as text, or a number cut to whole; NULL if unreadable."""
    text = position.try_cast("string")
    return F.when((kind(position) != "STRING") | text.rlike(r"^\s*[+-]?\d+\s*$"), to_number(text).cast("bigint"))


def structured_results(html: Column, domain: str = MARKETPLACE_DOMAIN) -> Column:
    """Listings named by the page's JSON-LD item lists; malformed items are left out one by one.

    One transform per step, so that each step reads the one before instead of computing it again.
    """
    none = F.array().cast("array<variant>")
    # Of a root array only the first item list counts.
    lists = F.flatten(F.transform(block_roots(html), lambda roots: F.slice(typed(roots, "ItemList"), 1, 1)))
    items = F.flatten(
        F.transform(lists, lambda o: F.coalesce(F.try_variant_get(o, "$.itemListElement", "array<variant>"), none))
    )

    def opened(item: Column) -> Column:
        nested = part_at(item, "$.item")
        return F.struct(
            item.alias("item"),
            F.coalesce(nested, item).alias("thing"),
            (nested.isNull() | F.startswith(kind(nested), F.lit("OBJECT"))).alias("usable"),
            part_at(item, "$.position").alias("position"),
        )

    def parts(x: Column) -> Column:
        item, thing = x["item"], x["thing"]
        return F.struct(
            x["usable"].alias("usable"),
            x["position"].isNull().alias("unplaced"),
            _whole(x["position"]).alias("position"),
            or_else(text_at(thing, "$.url"), text_at(item, "$.url")).alias("url"),
            F.coalesce(or_else(text_at(thing, "$.name"), text_at(item, "$.name")), F.lit("")).alias("title"),
            first_offer(thing).alias("offer"),
        )

    def wanted(x: Column) -> Column:
        ours = F.coalesce(F.contains(x["url"], F.lit(domain)), F.lit(False))
        return ours & x["usable"] & (x["unplaced"] | x["position"].isNotNull())

    def reading(x: Column, order: Column) -> Column:
        place = F.coalesce(x["position"], order + 1)
        return _listing(place, listing_id_of(x["url"]), x["url"], x["title"], offer_price(x["offer"]), F.lit(False))

    return F.transform(F.filter(F.transform(F.transform(items, opened), parts), wanted), reading)


def attribute_results(html: Column, domain: str = MARKETPLACE_DOMAIN, top: int | None = None) -> Column:
    """The first `top` listings read from listing-id attributes and the markup around their first occurrence.

    The page is split at the attribute once and the markup around an occurrence put together from short ends of
    the pieces, so the work grows with the page and not with page times listings. One transform per step, so
    that each step reads the one before instead of computing it again.
    """
    site = f"https://www.{domain}"
    mark = F.lit(LISTING_MARK)
    # A window of n characters spans at most this many pieces, each piece costing at least the mark itself.
    reach_back, reach_on = (n // len(LISTING_MARK) + 2 for n in (CHARS_BEFORE, CHARS_AFTER))

    def piece(text: Column) -> Column:
        return F.struct(
            F.regexp_extract(text, LISTING_QUOTED, 1).alias("listing"),
            F.substr(text, F.lit(1), F.lit(1)).alias("quote"),
            F.regexp_extract(text, LISTING_QUOTED, 2).alias("closing"),
            F.substring(text, 1, CHARS_AFTER).alias("start"),
            F.right(text, F.lit(CHARS_BEFORE)).alias("end"),
        )

    def paired(quote: str):
        return lambda x: F.when((x["quote"] == quote) & (x["closing"] == quote), x["listing"])

    # One struct per page, kept in an array of one so that its fields are computed once.
    pieces = F.transform(F.split(html, LISTING_MARK), piece)
    page = F.transform(F.array(pieces), lambda p: F.struct(p.alias("pieces"), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))).alias("marked")))
    keyed = F.transform(
        page,
        lambda p: F.struct(
            p["marked"]["listing"].alias("all"),
            F.transform(p["marked"], paired('"')).alias("double"),
            F.transform(p["marked"], paired("'")).alias("single"),
            p["pieces"]["start"].alias("starts"),
            p["pieces"]["end"].alias("ends"),
        ),
    )

    def near(p: Column, listing: Column) -> Column:
        hit = F.coalesce(
            F.nullif(F.array_position(p["double"], listing), F.lit(0)), F.nullif(F.array_position(p["single"], listing), F.lit(0))
        ).cast("int")
        return F.struct(listing.alias("listing"), hit.alias("hit"))

    def surroundings(p: Column, x: Column) -> Column:
        first = F.greatest(x["hit"] - reach_back, F.lit(0)) + 1
        before = F.right(F.array_join(F.slice(p["ends"], first, x["hit"] - first + 1), LISTING_MARK), F.lit(CHARS_BEFORE))
        after = F.concat(mark, F.array_join(F.slice(p["starts"], x["hit"] + 1, reach_on), LISTING_MARK))
        text = F.concat(before, F.substring(after, 1, CHARS_AFTER))
        return F.struct(x["listing"].alias("listing"), F.coalesce(text, F.lit("")).alias("text"))

    def link(x: Column) -> Column:
        pattern = F.concat(F.lit(r"""href=["']([^"']*listing/"""), x["listing"], F.lit(r"""[^"']*)["']"""))
        found = F.call_function("regexp_extract", x["text"], pattern, F.lit(1))
        return F.struct(x["listing"].alias("listing"), x["text"].alias("text"), found.alias("link"))

    def reading(x: Column, position: Column) -> Column:
        text, lowered = x["text"], F.lower(x["text"])
        url = (
            F.when(x["link"] == "", F.concat(F.lit(f"{site}/listing/"), x["listing"], F.lit("/")))
            .when(F.startswith(x["link"], F.lit("/")), F.concat(F.lit(site), x["link"]))
            .otherwise(x["link"])
        )
        star = F.contains(lowered, F.lit("star-seller")) | F.contains(lowered, F.lit("star_seller"))
        title = strip(F.regexp_extract(text, LISTING_HEADING, 1))
        return _listing(position + 1, x["listing"], url, title, to_number(first_match(text, DOLLAR_PRICE)), star)

    def windows(p: Column) -> Column:
        ids = F.filter(F.array_distinct(p["all"]), lambda i: i != "")
        # Cut first: each listing left is looked up among all marks of the page.
        ids = ids if top is None else F.slice(ids, 1, top)
        return F.transform(F.transform(ids, lambda i: near(p, i)), lambda x: surroundings(p, x))

    return F.transform(F.transform(F.flatten(F.transform(keyed, windows)), link), reading)


def _first_per_listing(df: DataFrame, results: str) -> DataFrame:
    """Reduce an array column to the first result per listing id (or url without one), keeping page order.

    Keys are sorted with their places and compared with their neighbours, so the work is that of a sort. Arrays stand
    in an array of one where a lambda reads them, so that they are computed once.
    """

    def keyed(result: Column, at: Column) -> Column:
        return F.struct(F.coalesce(result["listing_id"], result["url"]).alias("key"), at.alias("at"))

    def firsts(keys: Column) -> Column:
        return F.filter(keys, lambda k, i: k["key"].isNotNull() & ~k["key"].eqNullSafe(F.get(keys, i - 1)["key"]))

    def reduced(all_: Column) -> Column:
        kept = F.flatten(F.transform(F.array(F.sort_array(F.transform(all_, keyed))), firsts))
        return F.transform(F.sort_array(F.transform(kept, lambda k: k["at"])), lambda at: F.get(all_, at))

    return df.withColumn(results, F.flatten(F.transform(F.array(results), reduced)))


def fix_zero_positions(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Position 0 becomes the result's 1-based order on its page."""
    return df.withColumn("position", F.when(F.col("position") == 0, F.col(seq)).otherwise(F.col("position")))


def marketplace_results(
    pages: DataFrame, top: int = 48, domain: str = MARKETPLACE_DOMAIN, query: str = "query", html: str = "html"
) -> DataFrame:
    """Ranked listings per page: the structured item lists, else the listing-id attributes.

    `seq` is the order on the page; positions stated by a page may repeat.
    """
    kept = [c for c in pages.columns if c not in (query, html)]
    named = pages.where(F.length(html) > 0).select(
        F.col(query).alias("query"),
        *kept,
        F.col(html).alias("_html"),
        structured_results(F.col(html), domain).cast(RESULT_TYPE).alias("_named"),
    )
    chosen = _first_per_listing(named, "_named").select(
        "query",
        *kept,
        F.when(F.size("_named") > 0, F.col("_named"))
        .otherwise(attribute_results(F.col("_html"), domain, top).cast(RESULT_TYPE))
        .alias("_results"),
    )
    rows = chosen.select("query", *kept, F.posexplode(F.slice("_results", 1, top)).alias("_pos", "_r"))
    return fix_zero_positions(rows.select("query", "_r.*", *kept, (F.col("_pos") + 1).alias("seq")))
