"""URL pieces computed with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scheme (optional), two slashes, then the authority; brackets count only as a pair.
AUTHORITY = (
    r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#\[\]]*(?:\[[^/?#]*\][^/?#\[\]]*)?)(?=[/?#]|$)"
)
DROPPED = r"www\.|[\t\r\n]"
LISTING_ID = r"/listing/(\d+)/"


def domain_of(url: Column) -> Column:
    """Lower-cased authority without any `www.`; ports stay, a url without authority gives ''."""
    host = F.lower(F.regexp_extract(url, AUTHORITY, 1))
    return F.coalesce(F.regexp_replace(host, DROPPED, ""), F.lit(""))


def listing_id_of(url: Column) -> Column:
    """Marketplace listing id, or NULL when the path has none."""
    return F.nullif(F.regexp_extract(url, LISTING_ID, 1), F.lit(""))


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)
