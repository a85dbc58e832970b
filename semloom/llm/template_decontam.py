"""Benchmark decontamination by template canonicalisation, with DataFrame functions alone.

White space counts as single spaces. Numbers, names (words inside a sentence with a capital and then a small letter, several in a row as one) and units after numbers become typed
placeholders; all else counts in lower case, so words all in capitals do too; windows of WINDOW template words of every document meet those of the benchmark items in a
hash join. Windows with fewer than LITERALS plain words don't count. Then slots are held side by side: in
one alignment of a document with an item, equal slot values of the item must stand for equal
values in the document, and different names for different names, else the windows that hold such a torn slot don't count; so a question with other numbers and
names counts, an accidental template doesn't. Items stand as written and in lower case. An item is found if its windows are
covered to SHARE by alignments close to each other (a word more or less shifts them), if RUN of its words follow each other word by word, or if an alignment without torn
slots holds NEAR of its template words.

Null texts are empty: no windows, not contaminated. An item with fewer than WINDOW words is one window; with fewer than LITERALS
plain words it matches nothing. Each row is judged by its own text, whatever its doc_id (null or repeated):
rows are told apart by a 64-bit hash of the text, and equal texts are worked on once. Empty tables: an
empty benchmark leaves every document clean. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semloom.llm.common import text_of, written

WINDOW = 8
LITERALS = 4
SHARE = 0.5
RUN = 15
NEAR = 0.8
#: What names an alignment of a text with a form of an item.
AT = ["row", "item_id", "form", "shift"]
#: Benchmark windows, and ids of documents with hits, up to which they are broadcast (about 40 bytes each); beyond, Spark shuffles.
BROADCAST_ROWS = 500_000
#: Units that may follow a number.
UNITS = "kg|mg|g|lb|lbs|oz|km|cm|mm|m|mi|ft|in|yd|l|ml|s|ms|sec|min|h|hr|hrs|hour|hours|minute|minutes|second|seconds|day|days|week|weeks|month|months|year|years|mph|kmh|usd|eur|dollars|cents|euros|percent|meters|metres|miles|feet|inches|grams|kilograms|kilometers|kilometres|liters|litres|degrees"
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"


def valued(text):
    """Words of the text, lower case; a slot starts with its placeholder and holds its value."""
    s = F.regexp_replace(text, f" *[{NUMBER}-{UNIT}\\t-\\r\\x85\\xa0\\u2028\\u2029][{NUMBER}-{UNIT}\\t-\\r\\x85\\xa0\\u2028\\u2029 ]*| {{2,}}", " ")
    s = F.regexp_replace(s, r"[0-9]+", f" {NUMBER}$0 ")
    s = F.regexp_replace(s, r" (?<=[\p{L},;:] )(?=\p{Lu}\p{Ll})", f" {NAME}")
    s = F.regexp_replace(F.lower(s), rf" {NAME}(?<={NAME}[\p{{L}}'’-]{{1,40}} {NAME})", "")  # names that follow each other are one; the place comes first, then the look back
    s = F.regexp_replace(s, f"({NUMBER}[0-9]+ {{1,3}})(?=(?:{UNITS})(?![\\p{{L}}]))", f"$1{UNIT}")
    words = F.split(F.regexp_replace(s, rf"[^\p{{L}}\p{{N}} {NUMBER}-{UNIT}]+", " "), " ")
    return F.filter(words, lambda w: w != "")


def is_slot(w):
    return (w >= NUMBER) & (w < chr(ord(UNIT) + 1))


def reduced(w):
    """The word, or the placeholder of a slot."""
    return F.when(is_slot(w), F.substring(w, 1, 1)).otherwise(w)


def template(words):
    """The words with slots reduced to their placeholder."""
    return F.transform(words, reduced)


def codes(words):
    return F.transform(words, lambda w: F.xxhash64(reduced(w)))


def window_hash(c, m):
    """Hash of the m codes c: of WINDOW codes by pairs of pairs, as windows() makes it for all places at once."""
    level = [F.get(c, F.lit(i)) for i in range(WINDOW)]
    while len(level) > 1:
        level = [F.xxhash64(a, b) for a, b in zip(level[::2], level[1::2])]
    return F.when(m == WINDOW, level[0]).otherwise(F.xxhash64(c))


def windows(docs: DataFrame, key: str, n: int = WINDOW) -> DataFrame:
    """(key, pos, h) for each n-word template window of the texts."""
    def step(c, by):
        """Hashes of each code with the one `by` places on."""
        ahead = lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - by, F.lit(0))), F.slice(x, by + 1, F.size(x) + 1), lambda a, b: F.xxhash64(a, b))
        return F.transform(F.array(c), ahead)[0]  # the lambda makes c once

    made = codes(valued(text_of()))
    if n == WINDOW:  # hashes of 2, 4, 8 codes from each place on
        hashes = step(step(step(made, 1), 2), 4)
    else:
        starts = lambda c: F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(F.array(made), lambda c: F.transform(starts(c), lambda i: F.xxhash64(F.slice(c, i + 1, F.lit(n)))))[0]
    # outer: without it Spark would make the array once more, to leave empty ones out
    return docs.select(key, F.posexplode_outer(hashes).alias("pos", "h")).where("h is not null")


def benchmark_words(items: DataFrame) -> DataFrame:
    """(item_id, form, words) of the items as written (form 0) and, where it differs, in lower case (form 1)."""
    texts = items.select("item_id", text_of().alias("text"))
    forms = F.filter(F.array(F.col("text"), F.lower("text")), lambda t, i: (i == 0) | (t != F.col("text")))
    return texts.select("item_id", F.posexplode(forms).alias("form", "text")).select("item_id", "form", valued(F.col("text")).alias("words"))


def benchmark_windows(words: DataFrame, n: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(item_id, form, ipos, h, slots, n_windows) of the usable windows of benchmark_words; an item of fewer than n words is one window."""
    words = words.where(F.size("words") > 0).withColumn("m", F.least(F.size("words"), F.lit(n)))
    coded = words.withColumn("codes", codes("words"))
    at = coded.withColumn("ipos", F.explode(F.sequence(F.lit(0), F.size("codes") - F.col("m"))))
    at = at.withColumn("slots", F.slice("words", F.col("ipos") + 1, F.col("m")))
    plain = F.size(F.filter("slots", lambda w: ~is_slot(w)))
    at = at.where(plain >= literals).withColumn("codes", F.slice("codes", F.col("ipos") + 1, F.col("m")))
    at = at.select("item_id", "form", "ipos", window_hash(F.col("codes"), F.col("m")).alias("h"), "slots")
    count = at.groupBy("item_id", "form").agg(F.countDistinct("ipos").alias("n_windows"))
    return at.join(count, ["item_id", "form"])


def literal_runs(marked: DataFrame, n: int) -> DataFrame:
    """(AT, run): words of an alignment's longest passage of windows equal word by word; windows at most n apart meet or overlap."""
    place = Window.partitionBy(*AT).orderBy("ipos")
    at = marked.where("literal").select(*AT, "ipos", F.size("slots").alias("m"))
    apart = F.coalesce(F.col("ipos") - F.lag("ipos").over(place) > n, F.lit(True)).cast("int")
    at = at.withColumn("apart", apart).withColumn("part", F.sum("apart").over(place))
    return at.groupBy(*AT, "part").agg((F.max(F.col("ipos") + F.col("m")) - F.min("ipos")).alias("run"))


def near_copies(aligned: DataFrame, words: DataFrame, texts: DataFrame) -> DataFrame:
    """(AT, near): the share of the item's template words that the text holds at their place or one beside it."""
    both = aligned.join(words.withColumnRenamed("words", "item"), ["item_id", "form"]).join(texts, "row")
    base = F.greatest(F.col("shift") - 1, F.lit(0))
    both = both.withColumn("own", template(F.slice("words", base + 1, F.size("item") + 3))).withColumn("item", template(F.col("item")))
    here = lambda i, d: F.get("own", F.col("shift") + i + F.lit(d) - base) == F.get("item", i)
    held = F.filter(F.sequence(F.lit(0), F.size("item") - 1), lambda i: here(i, 0) | here(i, -1) | here(i, 1))
    return both.select(*AT, (F.size(held) / F.size("item")).alias("near"))


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, contaminated, n_items, items, coverage) for every row of docs."""
    words = written(benchmark_words(items), "items")
    bench = written(benchmark_windows(words, n), "bench")
    hashes = bench.select("h").distinct()
    few = bench.count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("row", F.xxhash64("text"))
    lengths = sorted(r[0] for r in bench.select(F.size("slots")).distinct().collect()) or [n]  # n, and those of shorter items
    hits = reduce(DataFrame.union, [windows(rows, "row", m) for m in lengths]).join(F.broadcast(hashes) if few else hashes, "h")
    hits = written(hits.distinct(), "hits")
    found = hits.join(F.broadcast(bench) if few else bench, "h").withColumn("shift", F.col("pos") - F.col("ipos"))
    # slots of the texts that have hits, at the hits
    ids = written(hits.select("row").distinct(), "hitdocs")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids  # so that only their texts move, not all
    texts = rows.join(ids, "row", "left_semi").groupBy("row").agg(F.min("text").alias("text"))
    texts = written(texts.select("row", valued(F.col("text")).alias("words")), "hitwords")
    slotted = F.exists("slots", is_slot)
    paired = found.where(slotted).join(texts, "row").withColumn("own", F.slice("words", F.col("pos") + 1, F.size("slots"))).drop("words")
    plain = found.where(~slotted).withColumn("own", F.col("slots"))
    marked = plain.unionByName(paired).withColumn("literal", F.col("own") == F.col("slots"))
    marked = written(marked.select(*AT, "ipos", "n_windows", "slots", "own", "literal"), "marked")
    slot = marked.select(*AT, F.explode(F.arrays_zip("slots", "own")).alias("z"))
    slot = slot.where(is_slot(F.col("z.slots")) & F.col("z.own").isNotNull()).select(*AT, "z.slots", "z.own").distinct()
    split = slot.groupBy(*AT, "slots").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi")
    names = slot.where(F.col("slots").startswith(NAME))
    merged = names.groupBy(*AT, "own").agg(F.min("slots").alias("lo"), F.max("slots").alias("hi")).where("lo <> hi")
    merged = names.join(merged.select(*AT, "own"), [*AT, "own"]).select(*AT, "slots")
    torn = split.select(*AT, "slots").union(merged)
    torn = written(torn.groupBy(*AT).agg(F.collect_set("slots").alias("torn")), "torn")  # at most an item's slots
    sound = marked.join(torn, AT, "left").where(F.col("torn").isNull() | ~F.arrays_overlap("slots", "torn"))
    of = ["row", "item_id", "form"]
    near_by = F.array(F.struct(F.lit(0).alias("k"), F.floor(F.col("shift") / (2 * n)).alias("at")), F.struct(F.lit(1).alias("k"), F.floor((F.col("shift") + n) / (2 * n)).alias("at")))
    cover = sound.select(*of, "ipos", "n_windows", F.explode(near_by).alias("part")).groupBy(*of, "part").agg((F.countDistinct("ipos") / F.first("n_windows")).alias("coverage"))
    cover = cover.groupBy(*of).agg(F.max("coverage").alias("coverage"))
    aligned = marked.select(*AT).distinct().join(torn, AT, "left_anti")
    runs = literal_runs(marked, n).groupBy(*of).agg(F.max("run").alias("run"))
    near = near_copies(aligned, words, texts).groupBy(*of).agg(F.max("near").alias("near"))
    judged = cover.join(runs, of, "full").join(near, of, "full")
    counts = (F.col("coverage") >= share) | (F.col("run") >= RUN) | (F.col("near") >= NEAR)
    by_text = judged.groupBy("row").agg(
        F.max("coverage").alias("coverage"), F.array_sort(F.collect_set(F.when(counts, F.col("item_id")))).alias("items")
    )
    out = rows.select("doc_id", "row").join(by_text, "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<long>"))
    return out.select(
        "doc_id", (F.size(items_of) > 0).alias("contaminated"), F.size(items_of).cast("long").alias("n_items"),
        items_of.alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )
