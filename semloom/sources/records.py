"""Nested JSON records to flat typed rows, keyed enrichment from delimited files, and JSON reading by schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semloom.functions.text import clean_or_null
from semloom.sources.zipped import read_zipped

NAMED = "array<struct<name:string>>"
#: A nested detail record; fields that a payload lacks are null.
DETAIL = (
    "id long, imdb_id string, external_ids struct<imdb_id:string>, title string, original_title string, overview string, tagline string, "
    f"release_date string, runtime int, adult boolean, video boolean, original_language string, genres {NAMED}, keywords struct<keywords:{NAMED}>, "
    "reviews struct<results:array<struct<author:string,content:string>>>, credits struct<cast:array<struct<name:string>>,crew:array<struct<job:string,name:string>>>, "
    f"production_companies {NAMED}, production_countries {NAMED}, poster_path string, backdrop_path string, popularity double, vote_average double, vote_count int"
)


def read_details(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Detail records of JSON files {"results": [...]}; malformed files fail if strict, else are left out."""
    payload = T.StructType([T.StructField("results", T.ArrayType(T.StructType.fromDDL(DETAIL)))])
    read = spark.read.schema(payload).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return read.select(F.posexplode("results").alias("ord", "r")).select("ord", "r.*")


def _names(c):
    """Cleaned, non-empty names in order."""
    return F.coalesce(F.array_compact(F.transform(c, lambda g: clean_or_null(g["name"]))), F.array().cast("array<string>"))


def normalize(details: DataFrame) -> DataFrame:
    """One flat row per detail record: cleaned text, year, arrays of names that are never null, at most ten of the cast."""
    year = F.nullif(F.regexp_extract("release_date", r"^(\d{4})", 1), F.lit("")).cast("int")
    crew = F.filter("credits.crew", lambda c: c["job"] == "Director")
    reviews = F.transform("reviews.results", lambda r: F.substring(clean_or_null(r["content"]), 1, 500))
    return details.select(
        "id", F.coalesce(clean_or_null(F.col("imdb_id")), clean_or_null(F.col("external_ids.imdb_id"))).alias("imdb_id"),
        F.coalesce(clean_or_null(F.col("title")), F.lit("")).alias("title"), clean_or_null(F.col("original_title")).alias("original_title"),
        "release_date", year.alias("year"), "runtime", clean_or_null(F.col("overview")).alias("overview"),
        _names(F.col("genres")).alias("genres"), _names(F.col("keywords.keywords")).alias("keywords"), "vote_average", "vote_count", "popularity",
        F.coalesce(F.array_compact(reviews), F.array().cast("array<string>")).alias("reviews"), "original_language",
        _names(F.col("production_countries")).alias("production_countries"), _names(F.col("production_companies")).alias("production_companies"),
        F.slice(_names(F.col("credits.cast")), 1, 10).alias("cast"), _names(crew).alias("directors"), "poster_path", "backdrop_path",
    )


def eligible(details: DataFrame, since: int, today: str, runtime: int, votes: int) -> DataFrame:
    """Details that are released, not adult or video, in English, long and voted enough, and described. Null numbers count as 0."""
    year = F.coalesce(F.nullif(F.regexp_extract("release_date", r"^(\d{4})", 1), F.lit("")).cast("int"), F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return details.where(
        (year >= since) & (F.col("release_date") <= today) & ~F.coalesce("adult", F.lit(False)) & ~F.coalesce("video", F.lit(False))
        & (F.lower("original_language") == "en") & (zero("runtime") >= runtime) & (zero("vote_count") >= votes) & clean_or_null(F.col("overview")).isNotNull()
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and quoted fields that may span lines."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def tag_signals(entities: DataFrame, links: DataFrame, scores: DataFrame, tags: DataFrame, least: float = 0.32, top: int = 24) -> DataFrame:
    """(id, tags): each entity's most relevant tags, best first; ties to the larger tag id; tags without a name shrink the list.

    entities: id; links: movieId, tmdbId (the last one by movieId wins); scores: movieId, tagId, relevance; tags: tagId, tag.
    """
    own = links.join(entities.select(F.col("id").alias("tmdbId")), "tmdbId", "left_semi").groupBy("tmdbId").agg(F.max("movieId").alias("movieId"))
    order = Window.partitionBy("tmdbId").orderBy(F.desc("relevance"), F.desc("tagId"))
    best = scores.where(F.col("relevance") >= least).join(own, "movieId").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = best.join(tags, "tagId").groupBy("tmdbId").agg(F.array_sort(F.collect_list(F.struct("rank", "tag"))).alias("t"))
    return named.select(F.col("tmdbId").alias("id"), F.transform("t", lambda s: s["tag"]).alias("tags"))


def zipped_signals(spark: SparkSession, entities: DataFrame, path: str, least: float = 0.32, top: int = 24) -> DataFrame:
    """tag_signals of a zip file's members links.csv, genome-tags.csv and genome-scores.csv, read by the executors; a missing member gives no signals."""
    links = read_zipped(spark, path, "links.csv", "movieId long, tmdbId long")
    tags = read_zipped(spark, path, "genome-tags.csv", "tagId long, tag string").select("tagId", clean_or_null(F.col("tag")).alias("tag")).where("tag is not null")
    scores = read_zipped(spark, path, "genome-scores.csv", "movieId long, tagId long, relevance double")
    return tag_signals(entities, links, scores, tags, least, top)


def enrich(entities: DataFrame, signals: DataFrame, synopses: DataFrame) -> DataFrame:
    """entities (id, imdb_id, ...) with tags (empty if none), plot_tags and synopsis; of repeated imdb_ids the last by ord wins."""
    last = synopses.where("imdb_id <> ''").groupBy("imdb_id").agg(F.max_by(F.struct("plot_tags", "synopsis"), "ord").alias("s"))
    out = entities.join(signals, "id", "left").join(last, "imdb_id", "left")
    none = F.array().cast("array<string>")
    return out.select(*[c for c in entities.columns], F.coalesce("tags", none).alias("tags"), F.coalesce("s.plot_tags", none).alias("plot_tags"), F.col("s.synopsis").alias("synopsis"))
