"""The analytics tables derived from the test tables, so that every operator has whole tables to run on.

Join misses come from the data itself (labels and documents cover only some of the parts); no rows are
filtered away to make them.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankintel.operators.upsert import last_per_key
from rankintel.sources.tables import dropped_shuffles, write_staged

# Which label a part type stands for; the remaining type reads as a blank label.
METAL_OF_TYPE = {
    "ECONOMY": "solid_gold",
    "LARGE": "vermeil",
    "MEDIUM": "gold_plated",
    "PROMO": "gold_filled",
    "SMALL": "sterling_silver",
}
# Word forms in which generated pages wrap the lines of a document.
LINK_SITE = "https://site.example/"
OUR_REGION = 0


def metal_of(part_type: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for kind, metal in METAL_OF_TYPE.items():
        chain = chain.when(part_type == kind, metal)
    return chain.otherwise("")


def part_url(brand: Column, key: Column) -> Column:
    host = F.lower(F.replace(brand, F.lit("#"), F.lit("-")))
    return F.concat(F.lit("https://www."), host, F.lit(".example.com/p/"), key.cast("string"))


def html_text(text: Column) -> Column:
    """Escape text for an html body."""
    amp = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def script_json(value: Column) -> Column:
    """A JSON-LD script element; `<` is written as an escape so that no text can end the script."""
    body = F.replace(F.to_json(value), F.lit("<"), F.lit("\\u003c"))
    return F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))


def spread(scan: DataFrame, *key: str) -> DataFrame:
    """A test table of fewer splits than cores, dealt out by its key: its files are too few to keep the cores busy."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *key) if scan.rdd.getNumPartitions() < cores else scan


class Bound:
    """Lazily built DataFrames over one directory of test tables."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def docs(self) -> DataFrame:
        return spread(self.table("documents"), "doc_id")

    @cached_property
    def html_pages(self) -> DataFrame:
        return spread(self.table("pages"), "page_id")

    @cached_property
    def result_rows(self) -> DataFrame:
        """Every line of every order as a search result of its customer, before the upsert."""
        lines = spread(self.table("lineitem"), "l_orderkey").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.select(
            F.col("o_custkey").alias("query"),
            F.col("l_linenumber").alias("position"),
            F.col("l_partkey").alias("url"),
            F.col("o_orderdate").alias("scraped_at"),
            "l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus",
        )

    arrival = ["scraped_at", "l_orderkey", "url", "l_suppkey", "l_extendedprice"]

    def titled(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.table("part").select(F.col("p_partkey").alias("url"), F.col("p_name").alias("title")), "url")

    # Titles join before the rows are hashed by query and position: joined after it, by url, the result would
    # share its shuffle with the next join on url, and a url filling many rows could not be split.

    @cached_property
    def serp(self) -> DataFrame:
        newest = last_per_key(self.titled(self.result_rows), ["query", "position"], self.arrival)
        return newest.select("query", "position", "url", "title", "scraped_at")

    def newest_shop(self, rows: DataFrame) -> DataFrame:
        ties = [*self.arrival, "l_quantity", "l_returnflag", "l_linestatus"]
        newest = last_per_key(rows, ["query", "position"], ties)
        return newest.withColumnsRenamed({"l_extendedprice": "price_usd", "l_returnflag": "shop"}).withColumns(
            {"reviews": F.col("l_quantity").cast("int"), "star_seller": F.col("l_linestatus") == "F"}
        )

    shop_columns = ["query", "position", "url", "title", "scraped_at", "price_usd", "shop", "reviews", "star_seller"]

    @cached_property
    def shop_serp(self) -> DataFrame:
        return self.newest_shop(self.titled(self.result_rows)).select(*self.shop_columns)

    def stored_shop_serp(self, root: str) -> DataFrame:
        """The rows of `shop_serp` as a table below `root`, for a query that reads them several times.

        Only the newest row of each place is joined with its title. Rows without a part go before, by the keys that no
        part has: these are few as a rule and then sent to all, where a join with the parts would shuffle every row.
        A part that is there twice gives one title.
        """
        parts = self.table("part").groupBy(F.col("p_partkey").alias("url")).agg(F.max("p_name").alias("title"))
        with dropped_shuffles(self.spark):
            titles = write_staged(parts, root, "shop_titles")
            keys = self.table("lineitem").select(F.col("l_partkey").alias("url")).distinct()
            unknown = write_staged(keys.join(titles, "url", "left_anti"), root, "shop_unknown")
            newest = self.newest_shop(self.result_rows.where("url IS NOT NULL").join(unknown, "url", "left_anti"))
            return write_staged(newest.join(titles, "url").select(*self.shop_columns), root, "shop_results")

    @cached_property
    def web(self) -> DataFrame:
        """Results with real url strings, one per order line."""
        parts = self.table("part").select("p_partkey", "p_brand", F.col("p_name").alias("title"))
        rows = self.result_rows.join(parts, F.col("url") == F.col("p_partkey"))
        return rows.select(
            "query", "position", part_url(F.col("p_brand"), F.col("p_partkey")).alias("url"), "title", "scraped_at", "l_orderkey"
        )

    @cached_property
    def labelled_parts(self) -> DataFrame:
        docs = self.table("documents").join(self.table("labels"), "doc_id")
        return self.table("part").join(docs, F.col("p_partkey") == F.col("doc_id"))

    @cached_property
    def classes(self) -> DataFrame:
        dated = self.labelled_parts.join(self.table("events").select("event_id", "ts"), F.col("p_partkey") == F.col("event_id"))
        return dated.select(
            F.col("p_partkey").alias("url"), metal_of(F.col("p_type")).alias("metal_type"), F.col("p_brand").alias("karat"),
            F.col("lang").alias("base_metal"), F.col("p_retailprice").alias("price_usd"), F.col("text").alias("evidence"),
            F.when(F.col("quality") == 1, "high").otherwise("low").alias("confidence"), F.col("ts").alias("classified_at"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("url"), F.concat_ws(" ", "source", "lang").alias("page_title")
        )

    @cached_property
    def listings(self) -> DataFrame:
        good = F.col("quality") == 1
        return self.labelled_parts.select(
            F.col("p_partkey").alias("url"),
            F.when(F.col("toxic") == 1, "").otherwise(F.concat("p_name", F.lit(" listing"))).alias("title"),
            F.when(good, F.col("p_retailprice")).otherwise(0.0).alias("price_usd"),
            F.col("p_brand").alias("shop"), F.array("p_type", "p_brand").alias("materials"),
            F.split(F.regexp_replace("text", r"\s+", " "), " ").alias("tags"), F.col("p_size").alias("favorites"),
            metal_of(F.col("p_type")).alias("metal_type"), F.col("lang").alias("karat"),
            F.when(good, "high").otherwise("low").alias("confidence"),
        )

    @cached_property
    def snap_res(self) -> DataFrame:
        """Result rows of each order's snapshot; a domain is ours if its supplier sits in our region."""
        rows = spread(self.table("lineitem"), "l_orderkey").select(
            F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").alias("position"),
            F.col("l_partkey").alias("url"), "l_suppkey", "l_extendedprice",
        )
        newest = last_per_key(rows, ["snapshot_id", "position"], ["url", "l_suppkey", "l_extendedprice"])
        owned = newest.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return owned.join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            "snapshot_id", "position", "url", F.col("s_name").alias("domain"), (F.col("n_regionkey") == OUR_REGION).alias("is_ours")
        )

    @cached_property
    def snaps(self) -> DataFrame:
        """One snapshot per order. query is the customer, query_grp the priority shared by many orders."""
        counted = self.snap_res.groupBy("snapshot_id").agg(
            F.min(F.when(F.col("is_ours"), F.col("position"))).alias("our_position"), F.count(F.lit(1)).alias("_n")
        )
        heads = self.table("orders").select(
            F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("query"),
            F.col("o_orderpriority").alias("query_grp"), F.col("o_orderdate").alias("scraped_at"),
            F.to_date("o_orderdate").alias("run_date"),
        )
        return heads.join(counted, "snapshot_id", "left").withColumn("total_results", F.coalesce("_n", F.lit(0))).drop("_n")

    @cached_property
    def sightings(self) -> DataFrame:
        return self.snap_res.join(self.snaps.select("snapshot_id", "scraped_at"), "snapshot_id")

    @cached_property
    def prod_snaps(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("product_id"), F.col("ts").alias("scraped_at"),
            F.to_date("ts").alias("run_date"), F.col("value").alias("price_usd"), F.col("event_type").alias("metal_type"),
            F.col("props").alias("description"),
        )

    @cached_property
    def competitors(self) -> DataFrame:
        named = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return named.select(F.col("s_suppkey").alias("competitor_id"), F.col("s_name").alias("domain"), F.col("n_name").alias("name"))

    @cached_property
    def comp_products(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("product_id"))
            .agg(
                F.min("l_suppkey").alias("competitor_id"), F.min("l_shipdate").alias("first_seen_at"),
                F.max("l_shipdate").alias("last_scraped_at"),
            )
            .withColumn("url", F.col("product_id"))
        )

    @cached_property
    def owned_products(self) -> DataFrame:
        return self.comp_products.join(self.competitors, "competitor_id").select("product_id", "url", "domain")

    # Pages generated from whole documents: every line of a text becomes one link, listing or leaf.

    @cached_property
    def lines(self) -> DataFrame:
        return self.docs.withColumn("lines", F.split("text", "\n"))

    @cached_property
    def search_pages(self) -> DataFrame:
        link = F.transform(
            "lines",
            lambda s: F.concat(
                F.lit(f'<div><a href="{LINK_SITE}'), F.md5(s), F.lit('"><h3><b>'), html_text(s), F.lit("</b></h3></a></div>")
            ),
        )
        page = F.concat(F.lit('<html><body><a href="/nav"><h3>menu</h3></a>'), F.array_join(link, "\n"), F.lit("</body></html>"))
        return self.lines.select(F.col("doc_id").alias("query"), page.alias("html"))

    @cached_property
    def shop_pages(self) -> DataFrame:
        """Item lists, and for one language pages that only carry listing attributes."""
        site = "https://www.etsy.com/listing/"
        items = F.transform(
            "lines",
            lambda s, i: F.struct(
                i.alias("position"), s.alias("name"),
                F.concat(F.lit(site), F.length(s).cast("string"), F.lit("/x?ref="), i.cast("string")).alias("url"),
                F.array(F.struct(F.concat(F.length(s).cast("string"), F.lit(".5")).alias("price"))).alias("offers"),
            ),
        )
        named = script_json(F.struct(F.lit("ItemList").alias("@type"), items.alias("itemListElement")))

        def block(s: Column, i: Column) -> Column:
            size = F.length(s).cast("string")
            shown = F.replace(F.trim(s), F.lit("<"), F.lit("("))
            return F.concat(
                F.lit('<div data-listing-id="'), size, F.lit('"><a href="/listing/'), size, F.lit("/x?ref="), i.cast("string"),
                F.lit('">$ '), size, F.lit(".50</a><h2>"), shown, F.lit("</h2></div>"), F.repeat(F.lit(" "), 1300),
            )

        marked = F.array_join(F.transform("lines", block), "")
        return self.lines.select(
            F.col("doc_id").alias("query"), F.when(F.col("lang") == "de", marked).otherwise(named).alias("html")
        )

    @cached_property
    def article_pages(self) -> DataFrame:
        meta = F.struct(F.col("n_chars").alias("n"), "lang", F.lit(True).alias("ok"))
        article = F.struct(F.lit("Article").alias("@type"), F.col("lines").alias("body"), meta.alias("meta"))
        return self.lines.select("doc_id", script_json(article).alias("html"))

    @cached_property
    def listing_pages(self) -> DataFrame:
        """Product blocks, and for one language pages with visible title and price only."""
        product = F.struct(
            F.lit("Product").alias("@type"), F.col("source").alias("name"), F.col("text").alias("description"),
            F.struct(F.concat(F.col("n_chars").cast("string"), F.lit(".25")).alias("price")).alias("offers"),
            F.struct(F.col("lang").alias("name")).alias("brand"),
        )
        inline = F.concat(
            F.lit('<script>{"tags": '), F.to_json(F.array("source", "lang")), F.lit(', "materials": ["gold", "silver"], "num_favorers": '),
            F.col("n_chars").cast("string"), F.lit("}</script>"),
        )
        plain = F.concat(
            F.lit("<title> "), F.col("source"), F.lit(" | shop</title>"), inline, F.lit("<p>$"), F.col("n_chars").cast("string"), F.lit(".75</p>")
        )
        return self.docs.select(
            F.concat(F.lit("https://www.etsy.com/listing/"), F.col("doc_id").cast("string"), F.lit("/item")).alias("url"),
            F.when(F.col("lang") == "fr", plain).otherwise(F.concat(script_json(product), inline)).alias("html"),
        )

    @cached_property
    def model_answers(self) -> DataFrame:
        answer = F.struct(
            F.lit("vermeil").alias("metal_type"), F.lit("14k").alias("karat"), F.col("n_chars").alias("price_usd"),
            F.col("source").alias("title"), F.col("text").alias("description"), F.lit("high").alias("confidence"),
        )
        fenced = F.concat(F.lit("```json\n"), F.to_json(answer), F.lit("\n```"))
        return self.docs.select(
            "doc_id", F.when(F.col("lang") == "de", F.concat(F.lit("no json: "), F.col("text"))).otherwise(fenced).alias("raw_response")
        )


@lru_cache(maxsize=4)
def bound(spark: SparkSession, root: str) -> Bound:
    """The bindings of a directory, kept so that queries share file listings and schemas (never data)."""
    return Bound(spark, root)
