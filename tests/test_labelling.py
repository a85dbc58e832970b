"""Labels in context, patterns, notes and label texts on small cases."""

from pyspark.sql import functions as F

from semloom.functions import text as X
from semloom.operators import labelling as L


def test_context_of_missing_parents_and_labels(spark):
    evidence = spark.createDataFrame([(1, ["w"]), (2, None), (3, [])], "cluster int, warnings array<string>")
    parents = spark.createDataFrame([(1, 7), (2, 8)], "cluster int, parent int")
    labels = spark.createDataFrame([(7, "Seven")], "parent int, label string")
    got = {r.cluster: r.warnings for r in L.label_context(evidence, parents, labels, "micro").collect()}
    assert got == {1: ["w", "Parent neighborhood label: Seven", L.GENERAL], 2: [L.GENERAL], 3: [L.GENERAL]}
    assert L.label_context(evidence, parents, labels, "macro").collect() == evidence.collect()


def test_patterns_look_at_the_first_neighbours_of_the_last_title(spark):
    near = spark.createDataFrame([(1, 2, 1), (1, 3, 8), (5, 3, 1)], "src long, nbr long, rank int")
    titles = spark.createDataFrame([(1, "One"), (5, "ONE"), (2, "Space Two"), (3, "Sea three")], "id long, title string")
    patterns = spark.createDataFrame([("one", "sea", True), ("One", "space", False), ("Gone", "sea", True)], "title string, pattern string, good boolean")
    got = sorted(map(tuple, L.pattern_hits(near, titles, patterns).collect()))
    assert got == [("Gone", False, "sea", True, False), ("One", True, "space", False, False), ("one", True, "sea", True, True)]


def test_notes_without_variants(spark):
    schema = "variant string, confidence double, coherence double, tiny int, noise int"
    rows = [("no_reviews", 0.5, 0.5, 1, 0), ("light_reviews", 0.5, 0.48, 0, 0)]
    made = L.variant_notes(spark.createDataFrame(rows, schema)).first()
    assert tuple(made) == ("no_reviews" if 1.0 - 0.02 > 0.98 else "light_reviews", "light may hurt", "insufficient variants")
    assert tuple(L.variant_notes(spark.createDataFrame([], schema)).first()) == (None, "insufficient variants", "insufficient variants")


def test_hash_wrap_runtime_and_year(spark):
    row = spark.createDataFrame([("a", "é🙂", "", None)], "a string, b string, c string, d string")
    got = row.select(*[X.fnv1a(F.col(c)) for c in "abcd"]).first()

    def plain(text):
        h = 2166136261
        raw = text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2])) * 16777619 % (1 << 32)
        return h

    assert tuple(got) == (0xE40C292C, plain("é🙂"), 2166136261, None)
    lines = spark.createDataFrame([("one two  three",), ("extraordinarily long",), ("",)], "t string").select(X.wrapped(F.col("t"), 8).alias("l")).collect()
    assert [r.l for r in lines] == [["one two", "three"], ["extraordinarily", "long"], [""]]
    rows = spark.createDataFrame([(None, None, None), (45, 1999, "2001-02-03"), (125, None, "2001-02-03"), (0, None, "")], "m int, y int, d string")
    assert [tuple(r) for r in rows.select(X.runtime_text(F.col("m")), X.year_text(F.col("y"), F.col("d"))).collect()] == [("", "Unknown year"), ("45 min", "1999"), ("2h 5m", "2001"), ("", "Unknown year")]


def test_the_full_selection_finds_neighbours_once(spark, sf, monkeypatch):
    from semloom.plans import labelling_queries as Q

    asked, nearest = [], Q.N.nearest
    monkeypatch.setattr(Q.N, "nearest", lambda *a: asked.append(a) or nearest(*a))
    assert Q.selection_full(spark, sf).count() == 1 and len(asked) == 1
