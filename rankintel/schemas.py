"""Declared schemas of every table and input file; nothing is inferred."""

from __future__ import annotations

Schema = dict[str, str]


def _schema(columns: str) -> Schema:
    """Column name → type, in order, from 'name type, name type'."""
    return dict(column.split(" ") for column in columns.split(", "))


def ddl(schema: Schema) -> str:
    """The form readers take."""
    return ", ".join(f"{name} {kind}" for name, kind in schema.items())


KEYWORD_FILE = _schema(
    "product_handle string, product_title string, our_url string, views_90d int, queries array<string>"
)
SERP_PAGES = _schema("query string, html string, fetched_at timestamp")
PAGE_FETCHES = _schema("url string, html string, fetched_at timestamp")

SERP_RESULTS = _schema(
    "query string, position int, url string, title string, snippet string, scraped_at timestamp"
)
PRODUCT_PAGES = _schema("url string, page_title string, raw_html string, scraped_at timestamp, run_date date")
CLASSIFICATIONS = _schema(
    "url string, metal_type string, karat string, base_metal string, price_usd double, "
    "evidence string, confidence string, classified_at timestamp"
)
DELTAS = _schema(
    "url string, field string, old_value string, new_value string, detected_at timestamp, run_date date"
)
OUR_PRODUCTS = _schema(
    "handle string, title string, our_url string, views_90d int, queries array<string>, "
    "ordinal bigint, created_at timestamp"
)
COMPETITORS = _schema("domain string, name string, first_seen_at timestamp, updated_at timestamp")
COMPETITOR_PRODUCTS = _schema("url string, domain string, first_seen_at timestamp, last_scraped_at timestamp")
SERP_SNAPSHOTS = _schema(
    "snapshot_id bigint, our_handle string, query string, our_url string, our_position int, "
    "total_results int, scraped_at timestamp, run_date date"
)
SERP_SNAPSHOT_RESULTS = _schema(
    "snapshot_id bigint, position int, url string, title string, domain string, is_ours boolean, "
    "scraped_at timestamp, run_date date"
)
PRODUCT_SNAPSHOTS = _schema(
    "url string, scraped_at timestamp, title string, price_raw string, price_usd double, description string, "
    "metal_type string, karat string, materials string, availability string, price_changed boolean, "
    "description_changed boolean, run_date date"
)
SHOP_SERP_RESULTS = _schema(
    "query string, position int, listing_id string, url string, title string, price_usd double, shop string, "
    "reviews int, star_seller boolean, scraped_at timestamp"
)
SHOP_LISTINGS = _schema(
    "listing_id string, url string, title string, price_usd double, shop string, materials array<string>, "
    "tags array<string>, reviews int, favorites int, metal_type string, karat string, confidence string, "
    "scraped_at timestamp"
)

# Keyed tables are rewritten by a run that changes them; appended tables only grow, partitioned by run_date.
# Stored pages are keyed by url too, but the first page of a url stays, so new ones are appended.
KEYED_TABLES = {
    "serp_results": SERP_RESULTS,
    "classifications": CLASSIFICATIONS,
    "our_products": OUR_PRODUCTS,
    "competitors": COMPETITORS,
    "competitor_products": COMPETITOR_PRODUCTS,
    "shop_serp_results": SHOP_SERP_RESULTS,
    "shop_listings": SHOP_LISTINGS,
}
APPENDED_TABLES = {
    "product_pages": PRODUCT_PAGES,
    "deltas": DELTAS,
    "serp_snapshots": SERP_SNAPSHOTS,
    "serp_snapshot_results": SERP_SNAPSHOT_RESULTS,
    "product_snapshots": PRODUCT_SNAPSHOTS,
}
TABLES = KEYED_TABLES | APPENDED_TABLES
