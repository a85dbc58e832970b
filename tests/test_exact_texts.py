"""Text functions where rounding, places or letters beyond 16 bits once gave other results than SQL."""

from pyspark.sql import functions as F

from semloom.functions import text as X


def test_values_to_redact_keep_their_digits(spark):
    row = spark.createDataFrame([("fr", "src1", " src22 ")], "a string, b string, c string")
    values = X.redaction_values(F.array("a", "b", "c", F.lit("the3")))
    assert row.select(values.alias("v")).first().v == ["src22", "src1", "the3"]
    assert row.select(X.redact(F.lit("x src1 desrcy"), values).alias("t")).first().t == "x desrcy"


def test_tokens_of_twenty_words_are_27(spark):
    words = spark.range(1, 400).select(F.col("id").cast("int").alias("n"), F.repeat(F.lit("a "), F.col("id").cast("int")).alias("t"))
    for r in words.select("n", X.token_estimate(F.col("t")).alias("tokens")).collect():
        assert r.tokens == max(1, -(-r.n * 135 // 100)), r.n


def small_tables(spark, at, docs):
    """A folder in which every table is docs."""
    from compare import TABLES

    for t in TABLES:
        docs.coalesce(1).write.parquet(str(at / "t" / t))
        (file,) = (at / "t" / t).glob("*.parquet")
        file.rename(at / f"{t}.parquet")
    return str(at)


def test_costs_equal_their_sql(spark, tmp_path):
    from compare import difference

    from semloom.plans import audit_queries, text_queries

    docs = spark.createDataFrame([(1, "a " * 20, "en", "s"), (2, "b " * 40, "fr", "s"), (3, "c " * 7, "de", "t")], "doc_id long, text string, lang string, source string")
    at = small_tables(spark, tmp_path, docs)
    for name, queries in (("token_cost", text_queries.QUERIES), ("variant_cost", audit_queries.QUERIES)):
        query, sql = queries[name]
        assert difference(query(spark, at), sql, at) == ""


def test_hash_of_letters_equals_its_sql(spark, tmp_path):
    from compare import difference

    from semloom.plans.labelling_queries import QUERIES

    texts = [None, "", " ", "      x", "a b c d e f g", "é x", "🙂 a", "a 🇩🇪 👨‍👩‍👧 b", "\uffff\U0010ffff"]
    at = small_tables(spark, tmp_path, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    query, sql = QUERIES["fnv_hash"]
    assert difference(query(spark, at), sql, at) == ""
