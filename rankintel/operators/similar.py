"""Stored queries that contain the first word of a query without results: for one query, or for a table of them.

Many words are not compared with every stored query. Stored queries are indexed by their substrings (grams) of up to
`GRAM` characters. A word of that length or less is a gram itself, and the first texts of the gram are its answer; a
longer one, or one with wildcards, meets the texts that share its rarest gram, and these few are confirmed by the whole
pattern. Words, queries and texts grow with the tables, so they are joined by shuffles (the merge hints) and never sent to
the driver, whatever their size is taken to be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIMILAR_QUERIES = 5
GRAM = 8
# Grams that no word needs are left out where they are made, by the hash of their length and first characters.
START, STARTS = 3, 65_536
# A word: anything but white space of any script and the four information separators.
WORD = r"(?U)[^\s\x1C-\x1F]+"


def similar_queries(stored: DataFrame, query: str, limit: int = SIMILAR_QUERIES, column: str = "query") -> DataFrame:
    """Up to five stored queries that contain the first word of `query`, ignoring case; % and _ are wildcards.

    A blank query is similar to none.
    """
    words = query.split()
    pattern = words[0].replace("\\", "\\\\") if words else ""
    found = F.col("query").ilike(f"%{pattern}%") if words else F.lit(False)
    return stored.select(F.col(column).alias("query")).where(found).distinct().orderBy("query").limit(limit)


def _grams(text: Column, size: Column) -> Column:
    """All substrings of `size` characters, in order; none if the text is shorter or the size is 0."""
    last = F.length(text) - size + 1
    each = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size))
    return F.when((last > 0) & (size > 0), each).otherwise(F.array().cast("array<string>"))


def _start(text: Column, at: Column, size: Column) -> Column:
    first = F.substring(text, at, F.least(size, F.lit(START)))
    return F.pmod(F.xxhash64(size, first), F.lit(STARTS))


def _postings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """_text, _low, _gram of the grams that start as one in `wanted` does, and maybe of some others, one row a place."""
    one = F.lit(1)
    starts = wanted.select(_start(F.col("_gram"), one, F.length("_gram")).alias("_start")).distinct()  # at most STARTS numbers
    places = texts.where("_low != ''").select("_text", "_low", F.explode(F.sequence(one, F.length("_low"))).alias("_at"))
    sizes = F.sequence(one, F.least(F.lit(GRAM), F.length("_low") - F.col("_at") + 1))
    sized = places.select("_text", "_low", "_at", F.explode(sizes).alias("_size"))
    started = sized.withColumn("_start", _start(F.col("_low"), F.col("_at"), F.col("_size"))).join(F.broadcast(starts), "_start", "left_semi")
    return started.select("_text", "_low", F.substring("_low", F.col("_at"), F.col("_size")).alias("_gram"))


def _contains(text: Column, word: Column) -> Column:
    """Both in lower case; % and _ in the word are wildcards, a backslash is none."""
    pattern = F.concat(F.lit("%"), F.replace(word, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.when(word.rlike("[%_]"), F.like(text, pattern)).otherwise(F.contains(text, word))


def similar_to_each(asked: DataFrame, stored: DataFrame, limit: int = SIMILAR_QUERIES, column: str = "query") -> DataFrame:
    """query, rank (from 1), similar: for each query in the first column of `asked` what `similar_queries` finds.

    Queries that are null or blank are similar to none, and null stored queries to no query.
    """
    queries = asked.select(F.col(asked.columns[0]).alias("query")).where("query IS NOT NULL").distinct()
    queries = queries.withColumn("_word", F.lower(F.regexp_extract(F.col("query").cast("string"), WORD, 0)))
    # The longest stretch between wildcards has to be in the text as it is.
    stretch = F.reduce(F.split("_word", "[%_]"), F.lit(""), lambda best, s: F.when(F.length(s) > F.length(best), s).otherwise(best))
    words = queries.where("_word != ''").select("_word").distinct().withColumn("_stretch", stretch)
    texts = stored.select(F.col(column).cast("string").alias("_text")).where("_text IS NOT NULL").distinct().withColumn("_low", F.lower("_text"))

    # A short word is a gram: its first texts are the gram's.
    is_gram = (F.col("_word") == F.col("_stretch")) & (F.length("_word") <= GRAM)
    short = words.where(is_gram).select(F.col("_word").alias("_gram"))
    order = F.dense_rank().over(Window.partitionBy("_gram").orderBy("_text"))
    listed = _postings(texts, short).select("_gram", "_text").withColumn("_nth", order).where(F.col("_nth") <= limit)
    met = listed.join(short.hint("merge"), "_gram").select(F.col("_gram").alias("_word"), "_text")

    size = F.least(F.lit(GRAM), F.length("_stretch"))
    of_words = words.where(~is_gram).select("_word", F.explode(F.array_distinct(_grams(F.col("_stretch"), size))).alias("_gram"))
    index = _postings(texts, of_words)
    counts = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # A word with a gram that no text has is in no text.
    rarest = of_words.join(counts.hint("merge"), "_gram", "left").groupBy("_word").agg(F.min_by("_gram", "_n").alias("_gram"), F.count_if(F.col("_n").isNull()).alias("_absent"))
    shared = rarest.where("_absent = 0").join(index.hint("merge"), "_gram")
    met = met.union(shared.where(_contains(F.col("_low"), F.col("_word"))).select("_word", "_text"))

    # A word of wildcards alone asks for a length only: the first texts of each length answer for all texts.
    order = F.row_number().over(Window.partitionBy("_length").orderBy("_text"))
    firsts = texts.select("_text", F.length("_low").alias("_length")).withColumn("_nth", order).where(F.col("_nth") <= limit)
    long_enough = firsts.select("_text", F.explode(F.sequence(F.lit(0), F.col("_length"))).alias("_least"))
    open_words = words.where("_stretch = ''").select("_word", F.length(F.replace("_word", F.lit("%"), F.lit(""))).alias("_least"))
    met = met.union(open_words.join(long_enough.hint("merge"), "_least").select("_word", "_text"))

    # A text that meets a word in several places is one.
    rank = F.dense_rank().over(Window.partitionBy("_word").orderBy("_text"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= limit).dropDuplicates(["_word", "rank"])
    return queries.join(best.hint("merge"), "_word").select("query", "rank", F.col("_text").alias("similar"))


def missing_queries(asked: DataFrame, stored: DataFrame, limit: int = SIMILAR_QUERIES, column: str = "query") -> DataFrame:
    """query, similar_queries (at most `limit`, in order) of each asked query that `stored` has no row of; null is not asked."""
    known = stored.select(F.col(column).alias("query")).distinct()
    missing = asked.select(F.col(asked.columns[0]).alias("query")).where("query IS NOT NULL").distinct().join(known.hint("merge"), "query", "left_anti")
    listed = similar_to_each(missing, known, limit).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "similar")))["similar"].alias("similar_queries"))
    return missing.join(listed.hint("merge"), "query", "left").select("query", F.coalesce("similar_queries", F.array().cast("array<string>")).alias("similar_queries"))


def with_missing(report: DataFrame, asked: DataFrame, stored: DataFrame, column: str = "query") -> DataFrame:
    """The report with a column `similar_queries`, null but in one row more for each asked query without stored rows."""
    shown = report.withColumn("similar_queries", F.lit(None).cast("array<string>"))
    return shown.unionByName(missing_queries(asked, stored, column=column), allowMissingColumns=True)
