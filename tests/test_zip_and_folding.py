"""Zipped CSV members read by executors; text without accents."""

import io
import unicodedata
import zipfile

from pyspark.sql import functions as F

from semloom.functions import text as X
from semloom.operators import search as B
from semloom.sources.records import zipped_signals
from semloom.sources.zipped import read_zipped


def archive(tmp_path, **members):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)
    return str(path)


def test_members_by_suffix_quotes_missing_columns_and_bad_fields(spark, tmp_path):
    path = archive(tmp_path, **{"x/one.csv": 'id,name,score\n1,"a ""b""\nc, d",0.5\n2,,x\n', "y/two.csv": "name,id\r\né,3\r\n", "z/other.txt": "id\n9\n"})
    rows = read_zipped(spark, path, ".csv", "id long, name string, score double, member string")
    assert rows.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, rows.collect())) == [(1, 'a "b"\nc, d', 0.5, "x/one.csv"), (2, None, None, "x/one.csv"), (3, "é", None, "y/two.csv")]
    assert read_zipped(spark, path, "none.csv", "id long").count() == 0


def test_long_members_are_streamed(spark, tmp_path):
    out = io.StringIO()
    out.write("movieId,tagId,relevance\n")
    for i in range(60_000):
        out.write(f"{i % 50},{i},{i / 60_000}\n")
    path = archive(tmp_path, **{"g/genome-scores.csv": out.getvalue()})
    got = read_zipped(spark, path, "genome-scores.csv", "movieId long, tagId long, relevance double").agg(F.count("*"), F.sum("tagId")).first()
    assert tuple(got) == (60_000, sum(range(60_000)))


def test_signals_of_an_archive(spark, tmp_path):
    path = archive(
        tmp_path,
        **{
            "m/links.csv": "movieId,imdbId,tmdbId\n1,x,100\n2,y,200\n3,z,\n",
            "m/genome-tags.csv": "tagId,tag\n7, space  opera \n8,noir\n9,\n",
            "m/genome-scores.csv": "movieId,tagId,relevance\n1,7,0.9\n1,8,0.95\n1,9,0.99\n2,7,0.1\n2,8,0.4\n",
        },
    )
    entities = spark.createDataFrame([(100,), (200,), (300,)], "id long")
    assert {r.id: r.tags for r in zipped_signals(spark, entities, path).collect()} == {100: ["noir", "space opera"], 200: ["noir"]}


def test_folding_equals_unicode_decomposition(spark):
    words = ["Café", "CAFÉ", "Café", "Ǖber", "naïve Ñandú", "Ångström", "łódź ß ø", "日本 が 한글", "ὕδωρ", "", "ạ́"]
    want = [X.folded_literal(w) for w in words]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", X.folded(F.col("w")).alias("f")).orderBy("i").collect()
    assert [unicodedata.normalize("NFC", r.f) for r in rows] == [unicodedata.normalize("NFC", w) for w in want]
    assert rows[0].f == rows[1].f == rows[2].f == "cafe"


def test_search_finds_accents_without_them(spark):
    nodes = spark.createDataFrame(
        [(1, "Café", None, "1999", ""), (2, "Zoo", "Cafeteria", "2001", ""), (3, "Un café noir", None, None, ""), (4, None, None, "2003", "im Cafè"), (5, "Tee", None, "cafe", None)],
        "id long, title string, original_title string, year string, everything string",
    )
    for q in ("cafe", "CAFÉ"):
        assert [(r.id, round(r.score, 3)) for r in B.folded_search(nodes, q).collect()] == [(1, 0.0), (2, 1.0), (3, 2.03), (5, 3.0), (4, 4.003)]
    assert B.folded_search(nodes, "c").count() == 0
