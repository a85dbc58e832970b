"""The corpus pipeline, stage by stage, on the smallest tables."""

import corpus_pipeline

from semloom.llm import queries


def test_stages_keep_the_columns_and_shrink_the_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert sorted(out.columns) == sorted(docs.columns)
        docs = out.checkpoint()
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and left, name
        ids = left
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in rows} == ids


def test_rows_of_null_or_one_id_are_judged_each_by_itself(spark, sf):
    import random

    def prose(seed):
        r = random.Random(seed)
        return " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(60))

    def frame(rows):
        return spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema)

    rows = [(None, prose(i)) for i in range(5)] + [(7, prose(i)) for i in range(5, 9)]
    again = [(7, prose(8)), (None, prose(8)), (3, prose(7)), (None, prose(0))]
    left = corpus_pipeline.near_dedup(spark, frame(rows + again), sf).collect()
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text) for r in left), key=key) == sorted([r for r in rows if r[1] != prose(7)] + [(3, prose(7))], key=key)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    left = corpus_pipeline.decontaminate(spark, frame([*rows, (None, f"{prose(20)} {item}"), (7, f"{prose(21)} {item}")]), sf).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=key) == sorted(rows, key=key)
    junk = " ".join(["the same few words"] * 40)
    left = corpus_pipeline.quality_rules(spark, frame([*rows, (None, junk), (7, junk)]), sf).collect()
    assert left and junk not in [r.text for r in left]


def test_registered_queries():
    names = queries.queries()
    assert [n for i in range(1, 14) for n in names if n.startswith(f"op{i}_")] == sorted(names, key=lambda n: int(n[2:].split("_")[0]))
