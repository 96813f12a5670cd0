"""Facts of saved marketplace listing pages, with built-in expressions inside the page's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankintel.functions.jsonld import block_roots, first_offer, kind, offer_price, part_at, text_at, typed
from rankintel.functions.labels import DOLLAR_PRICE
from rankintel.functions.text import cut, first_match, or_else, strip, to_number
from rankintel.functions.urls import listing_id_of
from rankintel.operators.page_text import TEXT_CHARS, TITLE

# Fixed values of the listing page format.
PRODUCT_TYPES = ("Product", "IndividualProduct")
TAG_ARRAY = r'"tags"\s*:\s*(\[[^\]]{0,1000}\])'
MATERIAL_ARRAY = r'"materials"\s*:\s*(\[[^\]]{0,500}\])'
FAVORITES = r'"num_favorers"\s*:\s*(\d+)'
REVIEWS = r'"num_ratings"\s*:\s*(\d+)'
DESCRIPTION_CHARS = 500


def _first_given(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0))


def _words(html: Column, pattern: str) -> Column:
    return F.coalesce(F.from_json(first_match(html, pattern), "array<string>"), F.array().cast("array<string>"))


def listing_metadata(
    pages: DataFrame, html: str = "html", description_chars: int | None = DESCRIPTION_CHARS
) -> DataFrame:
    """title, description, price_usd, shop, materials, tags, reviews and favorites of each page.

    Structured product data decides, the first non-empty value across all blocks; the page title and the
    first dollar amount stand in where it says nothing. The html itself is dropped. A description is cut to its width;
    None keeps it whole.
    """
    kept = [c for c in pages.columns if c != html]
    page = F.col(html)
    products = typed(F.flatten(block_roots(page)), *PRODUCT_TYPES)

    def shops(product: Column) -> Column:
        brand = F.when(kind(part_at(product, "$.brand")) == "STRING", text_at(product, "$.brand"))
        return F.array(F.coalesce(brand, text_at(product, "$.brand.name")), text_at(product, "$.seller.name"))

    offers = F.transform("_products", first_offer)
    read = pages.withColumn("_products", products).select(
        *kept,
        _first_given(F.transform("_products", lambda p: text_at(p, "$.name"))).alias("_name"),
        cut(_first_given(F.transform("_products", lambda p: text_at(p, "$.description"))), description_chars).alias("description"),
        F.get(F.filter(F.transform(offers, offer_price), lambda v: v != 0), F.lit(0)).alias("_price"),
        _first_given(F.flatten(F.transform("_products", shops))).alias("shop"),
        _words(page, MATERIAL_ARRAY).alias("materials"),
        _words(page, TAG_ARRAY).alias("tags"),
        first_match(page, REVIEWS).try_cast("int").alias("reviews"),
        first_match(page, FAVORITES).try_cast("int").alias("favorites"),
        strip(F.substring_index(strip(first_match(page, TITLE)), "|", 1)).alias("_page_title"),
        to_number(first_match(page, DOLLAR_PRICE)).alias("_page_price"),
    )
    return read.select(
        *kept,
        F.coalesce("_name", "_page_title").alias("title"),
        "description",
        F.coalesce("_price", "_page_price").alias("price_usd"),
        "shop",
        "materials",
        "tags",
        "reviews",
        "favorites",
    )


def classification_text(meta: DataFrame, out: str = "page_text", max_chars: int | None = TEXT_CHARS) -> DataFrame:
    """Add the text a listing is classified by; facts without a value are left out. A width of None keeps it whole."""

    def part(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{label}: "), value))

    text = F.concat_ws(
        " | ",
        part("Title", F.col("title")),
        part("Description", F.col("description")),
        part("Materials", F.array_join("materials", ", ")),
        part("Tags", F.array_join("tags", ", ")),
    )
    return meta.withColumn(out, cut(text, max_chars))


def listing_row(facts: DataFrame, scraped_at: Column) -> DataFrame:
    """Listing table row from page facts joined with labels (columns `label_price`, metal_type, karat, confidence).

    The page's own price counts unless it is missing or 0.
    """
    return facts.select(
        listing_id_of(F.col("url")).alias("listing_id"),
        "url",
        "title",
        F.coalesce(F.nullif(F.col("price_usd"), F.lit(0.0)), F.col("label_price")).alias("price_usd"),
        "shop",
        F.coalesce("materials", F.array().cast("array<string>")).alias("materials"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        "reviews",
        "favorites",
        or_else(F.col("metal_type"), "unknown").alias("metal_type"),
        or_else(F.col("karat"), "unknown").alias("karat"),
        or_else(F.col("confidence"), "low").alias("confidence"),
        scraped_at.alias("scraped_at"),
    )
