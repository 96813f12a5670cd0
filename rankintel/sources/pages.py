"""Page corpora: saved html, one row per page, in place of live fetching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankintel import schemas
from rankintel.functions.text import cut, first_match, strip
from rankintel.operators.page_text import TITLE
from rankintel.operators.upsert import first_per_key

# Fixed value: characters of html a stored page keeps.
STORED_CHARS = 50_000


def fetched(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages that arrived: a failed fetch is an empty or missing html."""
    return pages.where(F.length(html) > 0)


def read_pages(
    spark: SparkSession, path: str, schema: schemas.Schema = schemas.PAGE_FETCHES, fmt: str = "parquet"
) -> DataFrame:
    """Scan a page corpus (parquet by default) by its declared schema; failed fetches are left out.

    Pages are parsed where they lie; how finely a scan is split is a matter of `spark.sql.files.*`.
    """
    return fetched(spark.read.schema(schemas.ddl(schema)).format(fmt).load(path))


def stored_pages(
    pages: DataFrame, scraped_at: Column, existing: DataFrame | None = None, html_chars: int | None = STORED_CHARS
) -> DataFrame:
    """New page table rows: title and html, the first fetch per url, none for urls stored already.

    The html is cut to its width before it is moved; None stores it whole.
    """
    seen = "fetched_at" if "fetched_at" in pages.columns else "url"
    rows = fetched(pages).select(
        "url",
        F.col(seen).alias("_seen"),
        F.coalesce(strip(first_match(F.col("html"), TITLE)), F.lit("")).alias("page_title"),
        cut(F.col("html"), html_chars).alias("raw_html"),
        scraped_at.alias("scraped_at"),
    )
    first = first_per_key(rows, ["url"], ["_seen"]).drop("_seen")
    return first if existing is None else first.join(existing.select("url"), "url", "left_anti")
