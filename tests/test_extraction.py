import json

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankintel.functions.jsonld import PORTION_CHARS, _portions
from rankintel.operators.classify import classify_products, parse_model_json
from rankintel.operators.listing import classification_text, listing_metadata, listing_row
from rankintel.operators.marketplace import fix_zero_positions, marketplace_results
from rankintel.operators.page_text import html_to_text, jsonld_leaves, page_guard
from rankintel.operators.ranked_links import ranked_links
from rankintel.plans.batch import RunOptions, listing_rows, product_labels


def jsonld(value):
    text = value if isinstance(value, str) else json.dumps(value)
    return f'<script type="application/ld+json">{text}</script>'


def links(spark, html, **options):
    page = spark.createDataFrame([("q", html)], "query string, html string")
    return [(r.position, r.url, r.title) for r in ranked_links(page, **options).orderBy("position").collect()]


@pytest.mark.parametrize(
    "html, expected",
    [
        ('<a href="http://a/1"><h3>T <b>x</b></h3></a>', [(1, "http://a/1", "T x")]),
        ('<a href="/x"><h3>T</h3></a>', []),
        ('<a href="http://a"><h3>A</h3></a><a href="http://a"><h3>B</h3></a>', [(1, "http://a", "A")]),
        ('<a href="http://o"><a href="/rel"><h3>inner</h3></a></a>', [(1, "http://o", "inner")]),
        ('<a href="http://a"></a><h3>outside</h3>', []),
        ('<a href="http://a"><h3> &nbsp; </h3></a>', []),
        ('<a href="http://a"><h3>A &amp; B</h3></a>', [(1, "http://a", "A & B")]),
        ('<a href><h3>no target</h3></a>', []),
        ('<script><a href="http://a"><h3>code</h3></a></script>', []),
        ("", []),
    ],
)
def test_ranked_links(spark, html, expected):
    assert links(spark, html) == expected


def test_ranked_links_keeps_the_first_ten(spark):
    html = "".join(f'<a href="http://a/{i}"><h3>{i}</h3></a>' for i in range(12))
    assert [p for p, _, _ in links(spark, html)] == list(range(1, 11))
    assert len(links(spark, html, top=12)) == 12


def shop(spark, html, **options):
    page = spark.createDataFrame([("q", html)], "query string, html string")
    return marketplace_results(page, **options).orderBy("seq").collect()


def item(number, **more):
    return {"@type": "ListItem", "url": f"https://www.etsy.com/listing/{number}/x?ref={number}", **more}


def test_marketplace_item_list(spark):
    found = shop(
        spark,
        jsonld(
            {
                "@type": "ItemList",
                "itemListElement": [
                    item(1, position=0, name="first", offers={"price": 0, "lowPrice": "7"}),
                    {"position": "2", "item": {**item(2), "name": "second", "offers": [{"price": "12.5"}, {"price": "1"}]}},
                    item(1, position=9, name="again"),
                    {"url": "https://other.example/listing/5/x"},
                    item(6, position="six"),
                    item(7, position=None),
                    {"item": "https://www.etsy.com/listing/8/x"},
                    "text",
                    item(9, offers={"price": "1,234"}),
                    {"name": "outer", "url": "https://www.etsy.com/x?y", "item": {"offers": {"price": 3.5}}},
                ],
            }
        ),
    )
    assert [(r.position, r.listing_id, r.url, r.title, r.price_usd) for r in found] == [
        (1, "1", "https://www.etsy.com/listing/1/x", "first", 7.0),
        (2, "2", "https://www.etsy.com/listing/2/x", "second", 12.5),
        (4, "9", "https://www.etsy.com/listing/9/x", "", None),
        (5, None, "https://www.etsy.com/x", "outer", 3.5),
    ]
    assert not any(r.star_seller for r in found)


def test_marketplace_blocks_and_roots(spark):
    first = jsonld([{"@type": "Thing"}, {"@type": "ItemList", "itemListElement": [item(1)]}, {"@type": "ItemList", "itemListElement": [item(3)]}])
    html = first + jsonld("{bad") + jsonld({"@graph": [{"@type": "ItemList", "itemListElement": [item(4)]}]}) + jsonld({"@type": "ItemList", "itemListElement": [item(2)]})
    assert [(r.position, r.listing_id) for r in shop(spark, html)] == [(1, "1"), (2, "2")]


def test_marketplace_cut(spark):
    html = jsonld({"@type": "ItemList", "itemListElement": [item(n) for n in range(1, 60)]})
    assert [r.position for r in shop(spark, html)] == list(range(1, 49))
    assert len(shop(spark, html, top=5)) == 5


def test_marketplace_fallback(spark):
    pad = " " * 1300
    html = (
        '<div data-listing-id="7"><a href="/listing/7/ring?x=1"><h3> A gold ring for you </h3></a>$ 19.99 Star-Seller</div>' + pad
        + "<div data-listing-id='8'><h2>short</h2></div>" + pad
        + '<div data-listing-id="7">again $5</div>' + pad
        + '<div data-listing-id="9"><a href="https://www.etsy.com/listing/9/b?q">$3.5</a></div>'
    )
    assert [(r.position, r.listing_id, r.url, r.title, r.price_usd, r.star_seller) for r in shop(spark, html)] == [
        (1, "7", "https://www.etsy.com/listing/7/ring", "A gold ring for you", 19.99, True),
        (2, "8", "https://www.etsy.com/listing/8/", "", None, False),
        (3, "9", "https://www.etsy.com/listing/9/b", "", 3.0, False),
    ]


def test_listing_id_needs_the_closing_slash(spark):
    blocks = jsonld({"@type": "ItemList", "itemListElement": [{"url": "https://www.etsy.com/listing/123"}, {"url": "https://www.etsy.com/listing/123/x"}]})
    assert [r.listing_id for r in shop(spark, blocks)] == [None, "123"]


def test_fix_zero_positions(spark):
    df = spark.createDataFrame([(0, 1), (5, 2), (0, 3)], "position int, seq int")
    assert [tuple(r) for r in fix_zero_positions(df).orderBy("seq").collect()] == [(1, 1), (5, 2), (3, 3)]


def text_of(spark, html):
    return html_to_text(spark.createDataFrame([(html,)], "html string")).first().page_text


def test_text_of_thin_page_adds_the_body(spark):
    html = "<title> My\n page </title><style>x{}</style><script>var a;</script><p>Hello  <b>you</b></p>"
    assert text_of(spark, html) == "My page | My page Hello you "


def test_text_of_rich_page_has_no_body(spark):
    product = {"@type": "Product", "name": "n" * 120, "offers": [{"price": 3}, {"price": None}], "ok": True, "empty": "", "long": "x" * 200}
    html = "<title>T</title>" + jsonld(product) + "<p>body</p>"
    assert text_of(spark, html) == f"T | @type: Product | name: {'n' * 120} | price: 3 | price: None | ok: True"


def test_text_keeps_broken_block_and_inline_product(spark):
    html = jsonld("{bad" + "z" * 600) + '<script>{"product" : {"title": "a ring of gold and more"}}</script>'
    assert text_of(spark, html) == "{bad" + "z" * 496 + ' | {"title": "a ring of gold and more"}'


def test_text_is_cut(spark):
    html = jsonld([{"k": "v" * 150} for _ in range(100)])
    assert len(text_of(spark, html)) == 8000


def test_jsonld_leaves(spark):
    page = spark.createDataFrame([("u", jsonld({"a": None, "b": True, "c": [1, {"d": " x "}]}) + jsonld("[2.50, [], \"\"]"))], "url string, html string")
    assert [tuple(r) for r in jsonld_leaves(page).orderBy("seq").collect()] == [
        ("u", 0, 0, "a", "None"), ("u", 0, 1, "b", "True"), ("u", 0, 2, "c", "1"), ("u", 0, 3, "d", "x"), ("u", 1, 4, "", "2.5"),
    ]


def test_leaves_are_read_in_bounded_batches_and_portions(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "10000")
        pages = spark.range(3000, numPartitions=1).selectExpr("id", """concat('<script type="application/ld+json">{"k": ', id, ', "l": ["', repeat('x', 150), '", null]}</script>') AS html""")
        leaves = jsonld_leaves(pages)
        assert int(spark.conf.get(setting)) <= 500
        assert leaves.where("key = 'k' AND seq = 0 AND value = id").count() == 3000 and leaves.count() == 9000
    finally:
        spark.conf.set(setting, before)
    texts = [["a" * 400_000, "b"], ["c" * 700_000], None, [], ["d" * (PORTION_CHARS + 1)], ["e"]]
    portions = list(_portions(pa.array(texts, pa.list_(pa.string()))))
    assert portions == [texts[:1], texts[1:4], texts[4:5], texts[5:]]


def listing_of(spark, html):
    return listing_metadata(spark.createDataFrame([("https://www.etsy.com/listing/5/x", html)], "url string, html string"))


@pytest.mark.parametrize(
    "product, shop_name",
    [
        ({"brand": "Atelier"}, "Atelier"),
        ({"brand": {"name": "House"}}, "House"),
        ({"seller": {"name": "Seller"}}, "Seller"),
        ({"brand": {"name": ""}, "seller": {"name": "Seller"}}, "Seller"),
        ({}, None),
    ],
)
def test_listing_shop(spark, product, shop_name):
    assert listing_of(spark, jsonld({"@type": "Product", **product})).first().shop == shop_name


def test_listing_metadata_first_value_wins(spark):
    html = (
        jsonld({"@type": "WebPage", "name": "no"})
        + jsonld([{"@type": "Product", "name": "", "offers": {"price": "x"}}, {"@type": "IndividualProduct", "name": "Ring", "description": "d" * 600, "offers": [{"lowPrice": "9.5"}]}])
        + '<script>{"tags" : ["a", "b"], "materials":["gold"], "num_favorers": 12, "num_ratings":3}</script>$99'
    )
    row = listing_of(spark, html).first()
    assert (row.title, row.description, row.price_usd) == ("Ring", "d" * 500, 9.5)
    assert (row.tags, row.materials, row.favorites, row.reviews) == (["a", "b"], ["gold"], 12, 3)


def test_listing_metadata_falls_back_to_the_page(spark):
    row = listing_of(spark, '<title> Ring | Shop</title><p>$ 12.50</p>"tags": [bad]').first()
    assert (row.title, row.price_usd, row.tags, row.materials, row.shop) == ("Ring", 12.5, [], [], None)


def test_classification_text_and_listing_row(spark):
    meta = listing_of(spark, '<title>Ring</title>"tags": ["a", "b"]')
    assert classification_text(meta).first().page_text == "Title: Ring | Tags: a, b"
    labelled = meta.withColumns(
        {"price_usd": F.lit(0.0), "label_price": F.lit(8.0), "metal_type": F.lit("vermeil"), "karat": F.lit(None).cast("string"), "confidence": F.lit("high")}
    )
    row = listing_row(labelled, F.lit("2024-01-01").cast("timestamp")).first()
    assert (row.listing_id, row.price_usd, row.metal_type, row.karat) == ("5", 8.0, "vermeil", "unknown")


def test_parse_model_json(spark):
    answers = [
        (1, '```json\n{"metal_type":"vermeil","karat":"14k","base_metal":"brass","price_usd":"12.5","confidence":"high","availability":"in_stock"}\n```'),
        (2, "not json"),
        (3, '{"metal_type":"platinum","price_usd":7}'),
        (4, "[1]"),
        (5, None),
    ]
    got = {r.id: r for r in parse_model_json(spark.createDataFrame(answers, "id int, raw_response string")).collect()}
    assert (got[1].metal_type, got[1].price_usd, got[1].title, got[1].in_vocabulary) == ("vermeil", 12.5, "", True)
    for bad in (2, 4, 5):
        assert (got[bad].metal_type, got[bad].evidence, got[bad].confidence) == ("unknown", "fallback: JSON parse error", "low")
    assert (got[3].metal_type, got[3].price_usd, got[3].confidence, got[3].in_vocabulary) == ("platinum", 7.0, "low", False)


@pytest.mark.parametrize(
    "text, metal, karat, base",
    [
        ("Ring | 14k gold vermeil over sterling silver", "vermeil", "14k", "sterling_silver"),
        ("18K solid gold band, $1250.00", "solid_gold", "18k", "gold"),
        ("solid 14 karat yellow gold", "solid_gold", "14k", "gold"),
        ("gold plated brass", "gold_plated", "unknown", "brass"),
        ("14/20 gold-filled chain", "gold_filled", "unknown", "gold"),
        ("sterling silver hoop", "sterling_silver", "unknown", "sterling_silver"),
        ("wooden box", "unknown", "unknown", "unknown"),
    ],
)
def test_default_rules(spark, text, metal, karat, base):
    row = classify_products(spark.createDataFrame([(1, text)], "id int, page_text string")).first()
    assert (row.metal_type, row.karat, row.base_metal) == (metal, karat, base)


def test_custom_classifier(spark):
    def by_word(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"metal_type": ["vermeil" if "v" in t else None for t in texts], "price_usd": [1.5] * len(texts)})

    df = spark.createDataFrame([(1, "v"), (2, "x")], "id int, page_text string")
    got = classify_products(df, classifier=by_word).orderBy("id").collect()
    assert [(r.metal_type, r.price_usd, r.karat, r.confidence) for r in got] == [("vermeil", 1.5, "unknown", "low"), ("unknown", 1.5, "unknown", "low")]


def test_page_guard(spark):
    df = spark.createDataFrame([("x" * 299, "t"), ("x" * 300, " "), ("x" * 300, "t"), (None, "t")], "html string, page_text string")
    reasons = [r.fallback_reason for r in page_guard(df, text="page_text").collect()]
    assert reasons == ["empty page (299 chars)", "could not extract text from HTML", None, "empty page (0 chars)"]


def test_a_page_of_very_many_listings(spark):
    items = ",".join(f'{{"item": {{"name": "n{i % 6000}", "url": "https://www.etsy.com/listing/{i % 6000}/x"}}}}' for i in range(12000))
    named = f'<script type="application/ld+json">{{"@type": "ItemList", "itemListElement": [{items}]}}</script>'
    marked = "".join(f'<div data-listing-id="{i % 6000}">' for i in range(12000))
    pages = spark.createDataFrame([("named", named), ("marked", marked)], "query string, html string")
    found = marketplace_results(pages).orderBy("query", "seq").collect()
    for name in ("marked", "named"):
        assert [r.listing_id for r in found if r.query == name] == [str(i) for i in range(48)]


def test_widths_of_none_keep_whole_texts(spark):
    long = "x" * 9000
    page = f"<p>{long} vermeil</p>" + '<script type="application/ld+json">{"a": "%s"}</script>' % ("y" * 300)
    df = spark.createDataFrame([(page,)], "html string")
    (cut,) = html_to_text(df).collect()
    assert "vermeil" not in cut.page_text and len(cut.page_text) == 3000
    (whole,) = html_to_text(df, max_chars=None, body_chars=None).collect()
    assert whole.page_text.endswith("vermeil ")  # a tag leaves a blank
    assert [r.value for r in jsonld_leaves(df, leaf_limit=None).collect()] == ["y" * 300] and not jsonld_leaves(df).collect()
    broken = spark.createDataFrame([('<script type="application/ld+json">%s</script>' % ("z" * 900),)], "html string")
    assert [len(r.value) for r in jsonld_leaves(broken).collect()] == [500]
    assert [len(r.value) for r in jsonld_leaves(broken, broken_chars=None).collect()] == [900]


def test_rules_of_a_batch_read_whole_pages(spark):
    product = {"@type": "Product", "name": "Ring", "description": "d " * 600 + "vermeil 14k"}
    block = f'<script type="application/ld+json">{json.dumps(product)}</script>'
    data = [
        ("body", "<p>" + "a " * 5000 + "vermeil</p>", 1), ("leaf", block, 1), ("thin", "vermeil", 1),
        ("twice", "<p>" + "a " * 400 + "vermeil</p>", 1), ("twice", "<p>" + "a " * 400 + "sterling silver</p>", 2), ("other", block, 1),
    ]
    corpus = spark.createDataFrame(data, "url string, html string, day int").selectExpr("url", "html", "make_timestamp(2024, 1, day, 0, 0, 0) fetched_at")
    selected = spark.createDataFrame([("body",), ("leaf",), ("thin",), ("twice",), ("absent",)], "url string")
    labels = {r.url: r for r in product_labels(selected, corpus, RunOptions()).collect()}
    assert {u: r.metal_type for u, r in labels.items()} == {
        "body": "vermeil", "leaf": "vermeil", "thin": "unknown", "twice": "sterling_silver", "absent": "unknown"
    }
    assert labels["absent"].evidence == "fallback: empty page (0 chars)" and labels["thin"].evidence == "fallback: empty page (7 chars)"
    assert labels["absent"].confidence == "low" and labels["absent"].availability == "unknown"
    shops = {r.url: r.metal_type for r in listing_rows(selected, corpus, RunOptions(), F.lit("2024-01-09").cast("timestamp")).collect()}
    assert shops["leaf"] == "vermeil" and shops["absent"] == shops["thin"] == "unknown"

    def asked(texts):
        return pd.DataFrame({"metal_type": ["vermeil" if "vermeil" in t else "unknown" for t in texts]})

    cut = {r.url: r.metal_type for r in product_labels(selected, corpus, RunOptions(classifier=asked)).collect()}
    assert cut["body"] == "unknown" and cut["twice"] == "unknown"
    wide = RunOptions(classifier=asked, body_chars=None, text_chars=None)
    assert {r.url: r.metal_type for r in product_labels(selected, corpus, wide).collect()}["body"] == "vermeil"
