"""Questions asked again with names of another number of words."""

import random

from semloom.llm import template_decontam

VERBS = "carries borrows paints repairs counts collects gathers sells".split()
THINGS = "lanterns barrels ribbons saddles kettles pebbles candles feathers".split()


def question(r, first, second, n, m, verb, thing):
    return f"On the market day {first} {verb} {n} {thing} while {second} {verb} {m} more of them than {first}, so how many {thing} do {first} and {second} have when the evening comes"


def prose(seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(40))


def test_names_of_several_words_are_one_slot(spark):
    r = random.Random(4)
    cases = [(VERBS[i % 8], THINGS[i // 8]) for i in range(40)]
    items = [(i, question(r, "Alice", "Bob", 12, 5, v, t)) for i, (v, t) in enumerate(cases)]
    longer = [question(r, "Mary Ann", "John Smith", 31, 8, v, t) for v, t in cases]
    rows = [(i, f"{prose(i)}. {q}? {prose(i + 100)}") for i, q in enumerate(longer)] + [(100 + i, prose(200 + i)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in template_decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(got[i].contaminated and i in got[i]["items"] for i in range(40))
    assert not any(got[100 + i].contaminated for i in range(20))


def test_names_fold_only_side_by_side(spark):
    texts = ["we saw Mary Ann Lee there", "we saw Mary, Ann and Lee there", "we saw mary ann there"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", template_decontam.template(template_decontam.valued("text")).alias("t")).orderBy("i").collect()
    n = template_decontam.NAME
    assert [r.t for r in rows] == [["we", "saw", n, "there"], ["we", "saw", n, n, "and", n, "there"], ["we", "saw", "mary", "ann", "there"]]
