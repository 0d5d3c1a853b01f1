"""Postings of words and of trigrams as tables partitioned by term, so that a search reads only the terms it asks for.

An index is a folder with two tables: ``documents`` (the rows indexed, whole) and ``postings`` (bucket, term, key, ...), where a
bucket is a hash of the term and a folder of its own. It is extended by rows that it lacks; postings are written before
documents, so an extension that failed is made again, and postings that come twice count once. Rows of a bucket are dealt to
several tasks by key, so that a very common term is no single task's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparrowlog.functions.text import contains_ci, tokens, trigrams, websearch
from sparrowlog.streaming.live import read_table

BUCKETS, SPREAD = 64, 8
PLACES, COUNTS = "places array<int>", "field string, n int"


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def extend(path: str, rows: DataFrame, key: str, postings) -> None:
    """Add the rows whose key the index lacks; ``postings`` makes (term, key, ...) of them."""
    spark = rows.sparkSession
    known = read_table(spark, f"{path}/documents", rows.schema).select(key)
    fresh = rows.dropDuplicates([key]).join(known, key, "left_anti")
    made = postings(fresh).withColumn("bucket", bucket(F.col("term")))
    made = made.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(SPREAD))).sortWithinPartitions("bucket", "term")
    made.write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    fresh.write.mode("append").parquet(f"{path}/documents")


def wanted(spark: SparkSession, path: str, schema: StructType, key: str, more: str, terms: list[str]) -> DataFrame:
    """The postings (term, key and more) of some terms: of the folders only those of their buckets are read."""
    rows = spark.read.schema(f"`{key}` {schema[key].dataType.simpleString()}, term string, {more}, bucket int").parquet(f"{path}/postings")
    buckets = {r.b for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket(F.col("t")).alias("b")).collect()}
    return rows.filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms)).drop("bucket")


# --- words


def extend_words(path: str, rows: DataFrame, key: str, text: str) -> None:
    """Index the words of ``text`` with their places."""

    def postings(fresh):
        words = fresh.select(key, F.posexplode(tokens(F.col(text))).alias("at", "term"))
        return words.groupBy("term", key).agg(F.sort_array(F.collect_list("at")).alias("places"))

    extend(path, rows, key, postings)


def search_words(spark: SparkSession, path: str, schema: StructType, key: str, query: str) -> DataFrame:
    """The indexed rows whose words satisfy a web search text (all words, ``or``, ``-word``, ``"phrase"``)."""
    alternatives = websearch(query)
    terms = sorted({w for terms in alternatives for _, words in terms for w in words})
    documents = read_table(spark, f"{path}/documents", schema)
    if not terms:
        return documents.filter("false")
    places = wanted(spark, path, schema, key, PLACES, terms).select(key, F.struct("term", "places").alias("p")).distinct().groupBy(key).agg(F.map_from_entries(F.collect_list("p")).alias("_places"))
    hit = F.lit(False)
    for alternative in alternatives:
        all_ = F.lit(True)
        for want, words in alternative:
            one = has_phrase(F.col("_places"), words)
            all_ = all_ & (one if want else ~one)
        hit = hit | all_
    if all(any(want for want, _ in alternative) for alternative in alternatives):
        return documents.join(places.filter(hit).select(key), key, "left_semi")
    # an alternative that only excludes words is also met by rows without any of the terms
    none = F.create_map().cast("map<string,array<int>>")
    return documents.join(places, key, "left").withColumn("_places", F.coalesce("_places", none)).filter(hit).drop("_places")


def has_phrase(places: Column, words: list[str]) -> Column:
    """Whether the words follow one another somewhere."""
    at = lambda w: F.coalesce(F.try_element_at(places, F.lit(w)), F.array().cast("array<int>"))

    def follows(p: Column) -> Column:
        out = F.lit(True)
        for k, w in enumerate(words[1:], 1):
            out = out & F.array_contains(at(w), p + k)
        return out

    return F.exists(at(words[0]), follows)


# --- trigrams


def extend_trigrams(path: str, rows: DataFrame, key: str, fields: list[str]) -> None:
    """Index the trigrams of text fields, with how many distinct ones each field has."""

    def postings(fresh):
        out = None
        for name in fields:
            grams = trigrams(F.coalesce(F.col(name), F.lit("")))
            part = fresh.select(key, F.lit(name).alias("field"), F.size(grams).alias("n"), F.explode(grams).alias("term"))
            out = part if out is None else out.unionByName(part)
        return out

    extend(path, rows, key, postings)


def trigrams_within(part: str) -> list[str]:
    """The trigrams that every text with this part has: words are padded at the ends that the part itself shows. % and _ are
    wildcards and show nothing."""
    out: set[str] = set()
    for piece in re.split(r"[%_]", part.lower()):
        for m in re.finditer(r"[^\W_]+", piece):
            padded = ("  " if m.start() else "") + m[0] + (" " if m.end() < len(piece) else "")
            out |= {padded[i : i + 3] for i in range(len(padded) - 2)}
    return sorted(out)


def search_part(spark: SparkSession, path: str, schema: StructType, key: str, fields: list[str], part: str) -> DataFrame:
    """The indexed rows of which a field contains the part, in any case: rows with all its trigrams, then checked. A part without
    a trigram is searched in all rows."""
    documents, grams = read_table(spark, f"{path}/documents", schema), trigrams_within(part)
    hit = F.lit(False)
    for name in fields:
        hit = hit | F.coalesce(contains_ci(F.col(name), part), F.lit(False))
    if grams:
        some = wanted(spark, path, schema, key, COUNTS, grams).filter(F.col("field").isin(*fields)).groupBy(key, "field").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(grams))
        documents = documents.join(some.select(key).distinct(), key, "left_semi")
    return documents.filter(hit)


def similar_to(spark: SparkSession, path: str, schema: StructType, key: str, field: str, text: str, least: float) -> DataFrame:
    """(key, relevance) of the rows whose field has a trigram similarity of at least ``least`` (over 0) with a text, from counts
    of shared trigrams alone."""
    own = spark.createDataFrame([(text,)], "t string").select(trigrams(F.col("t")).alias("g")).first().g
    if not own:
        return wanted(spark, path, schema, key, COUNTS, [""]).select(key, F.lit(0.0).alias("relevance"))
    shared = wanted(spark, path, schema, key, COUNTS, own).filter(F.col("field") == field).groupBy(key).agg(F.count_distinct("term").alias("shared"), F.first("n").alias("n"))
    relevance = F.col("shared").cast("double") / (F.col("n") + len(own) - F.col("shared"))
    return shared.select(key, relevance.alias("relevance")).filter(F.col("relevance") >= least)
