"""Keyword search over several fields (S12): an inverted index with postings by field, ranked.

Every product is indexed under the words of its fields; a word counts with
the points of the best field that holds it. A request's result is the page of
products that hold most of its words, then those with most points, then the first by key.

The search never compares all requests with all products that share a word.
Requests with equal sets of known words are one unit. A unit first looks at
the postings of its rarest word and at the best page of each of its words
(a product that holds one word only is never better than that page). If the
page's last product holds c of m words, a product that is missing must hold c
of them as well, so that it holds one of the m - c + 1 rarest: only the
postings of these are looked at, once more.

Known limit: a unit all of whose words are common looks through the postings
of all but its most common one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nutrilake.session import materialize

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Different lower-case words (runs of letters and digits) of a text; none of a null."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), F.array().cast("array<string>"))


def field_words(fields: dict[str, int]) -> Column:
    """Array of (word, points): every word of the fields once, with the points of the best field that holds it."""
    def with_points(points: int):
        return lambda w: F.struct(w.alias("word"), F.lit(points).alias("points"))

    found, taken = [], None
    for name in sorted(fields, key=lambda f: (-fields[f], f)):
        own = words(F.col(name).cast("string"))
        new = own if taken is None else F.array_except(own, taken)
        taken = own if taken is None else F.array_union(taken, own)
        found.append(F.transform(new, with_points(fields[name])))
    return F.flatten(F.array(*found))


def held_words(products: DataFrame, key: str, fields: dict[str, int]) -> DataFrame:
    """Rows (_row, _key, ``held``): all words of a product and their points, kept once a product."""
    return materialize(products.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), field_words(fields).alias("held")))


def inverted_index(held: DataFrame) -> DataFrame:
    """Postings (word, points, _row, _key) of ``held_words``."""
    return held.select("_row", "_key", F.inline("held"))


def request_units(requests: DataFrame, request_id: str, text: str, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request, unit) and (unit, ``rare``): the known words of a request, the rarest first; requests without a known word are in neither."""
    asked = requests.select(F.col(request_id).alias("_qid"), F.explode(words(F.col(text))).alias("word"))
    counted = index.groupBy("word").agg(F.count("*").alias("df"))
    known = asked.join(counted, "word").groupBy("_qid").agg(F.sort_array(F.collect_set(F.struct("df", "word"))).alias("w"))
    units = materialize(known.select("_qid", F.transform("w", lambda x: x["word"]).alias("rare")).withColumn("unit", F.concat_ws(" ", "rare")))
    return units.select("_qid", "unit"), units.select("unit", "rare").dropDuplicates(["unit"])


def _ranked(candidates: DataFrame, page_size: int) -> DataFrame:
    """The best page a unit of (unit, rare, _key, held): adds ``n_words``, ``points`` and ``pos``."""
    hit = F.filter("held", lambda h: F.array_contains("rare", h["word"]))
    scored = candidates.withColumn("_hit", hit).withColumn("n_words", F.size("_hit")) \
        .withColumn("points", F.aggregate("_hit", F.lit(0), lambda total, h: total + h["points"])) \
        .select("unit", "rare", "_key", "n_words", "points").distinct()
    order = Window.partitionBy("unit").orderBy(F.col("n_words").desc(), F.col("points").desc(), "_key")
    return scored.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= page_size)


def keyword_search(requests: DataFrame, request_id: str, text: str, products: DataFrame, key: str, fields: dict[str, int],
                   page_size: int = 5) -> DataFrame:
    """The page of each request: (request_id, pos, key, n_words, points).

    ``key`` is unique; rows that share a ``request_id`` are one request with the words of all; null texts have no words.
    """
    held = held_words(products, key, fields)
    index = inverted_index(held)
    of_request, units = request_units(requests, request_id, text, index)
    units = materialize(units)
    best = Window.partitionBy("word").orderBy(F.col("points").desc(), "_key")
    pages = index.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= page_size).drop("_n")
    by_page = units.withColumn("word", F.explode("rare")).join(pages, "word")
    by_rarest = units.where(F.size("rare") > 1).withColumn("word", F.get("rare", F.lit(0))).join(index, "word")
    columns = ["unit", "rare", "_row"]  # a product's words meet a unit once it is a candidate

    def with_words(candidates: DataFrame) -> DataFrame:
        return candidates.distinct().join(held, "_row")
    first = materialize(_ranked(with_words(by_page.select(*columns).unionByName(by_rarest.select(*columns))), page_size))
    # Words of the last product of a full page; one word is what the pages of words have settled.
    reached = first.where(F.col("pos") == page_size).select("unit", F.col("n_words").alias("reached"))
    more = units.join(reached, "unit", "left") \
        .withColumn("_n", F.size("rare") - F.greatest(F.coalesce("reached", F.lit(2)), F.lit(2))) \
        .where(F.col("_n") > 0).select("unit", "rare", F.explode(F.slice("rare", F.lit(2), F.col("_n"))).alias("word"))
    second = _ranked(with_words(more.join(index, "word").select(*columns)), page_size)
    order = Window.partitionBy("unit").orderBy(F.col("n_words").desc(), F.col("points").desc(), "_key")
    both = first.unionByName(second).drop("pos").distinct().withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= page_size)
    return of_request.join(both, "unit").select(F.col("_qid").alias(request_id), "pos", F.col("_key").alias(key), "n_words", "points")
