"""JSON-LD blocks of a page: native variant access, and the one Arrow function for free-depth leaves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankintel.functions.text import strip, to_number

# Fixed value: how a structured-data script element is recognised.
JSONLD_SCRIPT = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""

# Longest leaf kept is one below the first, longest raw text of an unreadable block is the second.
LEAF_LIMIT = 200
BROKEN_BLOCK_CHARS = 500

# Characters of blocks that are read before their leaves are handed over; a longer page is alone.
PORTION_CHARS = 1_000_000

LEAF_TYPE = T.ArrayType(
    T.StructType()
    .add("block", T.IntegerType())
    .add("seq", T.IntegerType())
    .add("key", T.StringType())
    .add("value", T.StringType())
)


def jsonld_blocks(html: Column) -> Column:
    """All JSON-LD script bodies of a page, in order, as array<string>."""
    return F.regexp_extract_all(html, F.lit(JSONLD_SCRIPT), F.lit(1))


def block_roots(html: Column) -> Column:
    """Per block its root object or the elements of its root array, array<array<variant>>; unreadable ones are empty."""
    none = F.array().cast("array<variant>")
    bodies = F.transform(jsonld_blocks(html), strip)
    read = F.transform(bodies, lambda b: F.struct(F.startswith(b, F.lit("{")).alias("single"), F.try_parse_json(b).alias("value")))
    return F.transform(
        read,
        lambda x: F.when(x["single"], F.array_compact(F.array(x["value"]))).otherwise(
            F.coalesce(F.try_variant_get(x["value"], "$", "array<variant>"), none)
        ),
    )


def typed(objects: Column, *types: str) -> Column:
    """The objects whose @type is one of the given ones; anything that is no object has none."""
    return F.filter(objects, lambda o: text_at(o, '$["@type"]').isin(*types))


def kind(value: Column) -> Column:
    """Type name of a variant such as STRING, BIGINT or OBJECT<...>. Cheap on scalars only."""
    return F.schema_of_variant(value)


def text_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def part_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def first_offer(thing: Column) -> Column:
    """struct(price, low) of the first offer, as variants."""
    return F.struct(
        F.coalesce(part_at(thing, "$.offers[0].price"), part_at(thing, "$.offers.price")).alias("price"),
        F.coalesce(part_at(thing, "$.offers[0].lowPrice"), part_at(thing, "$.offers.lowPrice")).alias("low"),
    )


def offer_price(offer: Column) -> Column:
    """Number of an offer: its price, or its low price where that is missing, empty or 0."""

    def given(value: Column) -> Column:
        text = value.try_cast("string")
        zero = (kind(value) != "STRING") & (to_number(text) == 0)
        return F.when((text != "") & ~F.coalesce(zero, F.lit(False)), text)

    return to_number(F.coalesce(given(offer["price"]), given(offer["low"])))


def _leaves(block_no: int, text: str, leaf_limit: int | None, broken_chars: int | None) -> Iterator[tuple[int, str, str]]:
    """(block, key, rendered scalar) for each leaf, depth first; list elements keep the list's key."""
    try:
        pending = [("", json.loads(text.strip()))]
    except ValueError:
        yield block_no, "", text[:broken_chars]
        return
    while pending:
        key, node = pending.pop()
        if isinstance(node, dict):
            pending.extend(reversed(node.items()))
        elif isinstance(node, list):
            pending.extend((key, child) for child in reversed(node))
        else:
            shown = str(node).strip()
            if shown and (leaf_limit is None or len(shown) < leaf_limit):
                yield block_no, key, shown


def _portions(pages: pa.Array) -> Iterator[list[list[str] | None]]:
    """The pages as lists of texts, at most `PORTION_CHARS` characters of a batch at a time."""
    taken, size = [], 0
    for page in pages:
        texts = page.as_py()
        chars = sum(map(len, texts or ()))
        if taken and size + chars > PORTION_CHARS:
            yield taken
            taken, size = [], 0
        taken.append(texts)
        size += chars
    if taken:
        yield taken


def leaves_of(blocks: Column, leaf_limit: int | None = LEAF_LIMIT, broken_chars: int | None = BROKEN_BLOCK_CHARS) -> Column:
    """Leaves of every block of a page. Only the (usually empty) block arrays travel to Python.

    Leaves of leaf_limit characters and more are left out, and an unreadable block is cut; None keeps both whole. Leaves
    are handed over a portion of a batch at a time, so that a task holds the leaves of few pages, however many rows
    Spark puts into a batch.
    """
    kind = pa.list_(pa.struct([("block", pa.int32()), ("seq", pa.int32()), ("key", pa.string()), ("value", pa.string())]))

    @F.arrow_udf(LEAF_TYPE)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def page(texts):
            if texts is None:
                return None
            found = (leaf for no, text in enumerate(texts) for leaf in _leaves(no, text, leaf_limit, broken_chars))
            return [
                {"block": block, "seq": seq, "key": key, "value": value}
                for seq, (block, key, value) in enumerate(found)
            ]

        for pages in batches:
            for portion in _portions(pages):
                yield pa.array([page(texts) for texts in portion], kind)

    return read(blocks)
