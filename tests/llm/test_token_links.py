"""Token links against whole texts, tokenised one by one and aligned byte by byte."""

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from semloom.llm import packs, queries, token_links

SCHEMA = "doc_id long, text string, key string, n long, pair string"
PATHS = (public_tokenizers.path(token_links.BYTE_LEVEL), public_tokenizers.path(token_links.PIECES))


@pytest.fixture(scope="module")
def whole():
    v = token_links.Vocabularies(*PATHS)

    def groups(text):
        """[(A ids, B ids)] of a whole text, by the contract's words."""
        if not text:
            return []
        raw = f" {text}".encode()
        a, b = v.a.encode(" " + text, add_special_tokens=False).ids, v.b.encode(text)
        if b"".join(v.a_bytes[i] for i in a) != raw or b"".join(v.b_bytes[i] for i in b) != raw:
            return []
        out, x, y = [([], [])], 0, 0
        a, b = list(a), list(b)
        while a or b:
            if x <= y:
                out[-1][0].append(a.pop(0))
                x += len(v.a_bytes[out[-1][0][-1]])
            else:
                out[-1][1].append(b.pop(0))
                y += len(v.b_bytes[out[-1][1][-1]])
            if x == y:
                out.append(([], []))
        return out[:-1]

    return groups


def want(rows, groups):
    """Rows of the contract for [(doc_id, text)]."""
    made = [groups(t) for _, t in rows]
    links = [[(a, b) for x, y in g for a in x for b in y] for g in made]
    count = Counter(p for each in links for p in set(each))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    for (doc_id, _), g, each in zip(rows, made, links):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        sizes = sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(each)
        yield (doc_id, *sizes, sum(count[p] == top[p[0]] for p in each), sum(count[p] for p in each), sha256(shown.encode()).hexdigest() if g else "")


MARKS = ["a", "the", " ", "  ", "\n", "\r", "\t", "é", " ", "　", "日本", ";", "\x01", "\x1c", "12", "}\r", "'s", "<s>", "<|endoftext|>", "naïve", "🙂", " ", "!", "...", "Zq", "\x00"]


def test_pieces_are_encoded_as_in_whole_texts(whole):
    made, r = token_links.aligner(PATHS), np.random.default_rng(6)
    for i in range(1200):
        text = "".join(r.choice(MARKS + ["▁"] * (i % 40 == 0), r.integers(1, 16)))
        (rows,) = made.rows([token_links.spaced(text.encode())])
        shown = made.shown.gather(rows)[:-1].tobytes().decode() if made.fits[rows].all() else ""
        groups = whole(text)
        assert shown == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), text
        if shown:
            assert made.sums[rows].sum(0).tolist() == [sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(len(x) * len(y) for x, y in groups)]
            pairs = [(p >> token_links.SHIFT, p & ((1 << token_links.SHIFT) - 1)) for p in made.links.gather(rows).tolist()]
            assert pairs == [(a, b) for x, y in groups for a in x for b in y]


def test_odd_rows(spark, whole, monkeypatch):
    monkeypatch.setattr(packs, "PACK", 64)
    monkeypatch.setattr(packs, "GROUP", 300)
    monkeypatch.setattr(token_links, "KEPT", 40)
    monkeypatch.setattr(token_links, "KEPT_PLAIN", 60)
    r = np.random.default_rng(8)
    texts = ["The cat sat", None, "", " \n\t ", "a▁b", "x" * 900, "日本語のテキスト unglaublich", "one\n\n  two"] + ["".join(r.choice(MARKS, 30)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "The cat sat"), (3, "The cat sat"), (None, None)] + [(100 + i, "hot text") for i in range(60)]
    frame = spark.createDataFrame([(i, t, "k", 1, "p") for i, t in rows], SCHEMA)
    assert sorted(map(repr, map(tuple, token_links.links(frame).collect()))) == sorted(map(repr, want(rows, whole)))
    assert token_links.links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_of_hot_and_rare_texts(spark):
    keyed = spark.createDataFrame([(i, b"h") for i in range(50)] + [(i, b"r%d" % (i // 2)) for i in range(50, 80)], "doc_id long, key binary")
    found = spark.createDataFrame([(b"h", 1)] + [(b"r%d" % i, i) for i in range(25, 40)], "key binary, n long")
    got = token_links.to_copies(keyed, found, hot=10)
    assert sorted(map(tuple, got.collect())) == [(i, 1 if i < 50 else i // 2) for i in range(80)]
    assert "Broadcast" in got._jdf.queryExecution().toString()


def test_query_equals_whole_texts(spark, sf, whole):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_token_links(spark, sf).collect())) == sorted(want(rows, whole))
