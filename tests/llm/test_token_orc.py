"""Cutting of texts into pieces for op7."""

import random
import re

import public_tokenizers

from semloom.llm import token_orc

BEHIND = re.compile(rb"[.,!?;:%$&*#|](?:(?<=[A-Za-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[.,!?;:%$&*#|]*(?=\s|\Z)")


def test_pieces_are_words_and_the_marks_behind_them():
    draw = random.Random(3)
    some = list("abAZ09.,!?;:%$&*#| \t\n\r\x0b\x0c\x1c\x85\xa0éÉ×÷ÀİßŒ́漢😀-'\"")
    raws = ["".join(draw.choices(some, k=draw.randint(0, 40))).encode() for _ in range(3000)] + [b"", b" ", b"...", b"a" + b"!" * 3000]
    pieces, counts = token_orc.cut(raws)
    want = [BEHIND.sub(rb" \g<0>", r.lower()).split() for r in raws]
    assert token_orc.bytes_of(pieces) == [p for w in want for p in w] and counts.tolist() == [len(w) for w in want]
    assert token_orc.cut([])[1].tolist() == [] and token_orc.cut([b"", b" "])[1].tolist() == [0, 0]


def test_a_piece_is_looked_up_once_a_run(monkeypatch):
    asked, real = [], token_orc.WordTable.rows
    monkeypatch.setattr(token_orc.WordTable, "rows", lambda self, words: asked.append(len(words)) or real(self, words))
    encoder = token_orc.Encoder(public_tokenizers.path(token_orc.VOCABULARY))
    ids, sizes = encoder.encode([b"one two, one. " * 50, b"", b"two one"], 2)
    assert asked == [4]  # one two , .
    model = [encoder.model.encode(t, add_special_tokens=False).ids + [2] for t in ("one two, one. " * 50, "", "two one")]
    assert ids.tolist() == sum(model, []) and sizes.tolist() == [len(m) for m in model]
