"""Ids of whole columns are those of their words one by one."""

import random

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import tokens, words


def texts(rng):
    forms = ["the", "The", "the,", "réel", "RÉEL", "İx", "한국어", "漢字", "a1", "don't", "x" * 200, "…", "😀", "ét", "##", "naïve!"] + ["".join(rng.choices("aeiorst", k=rng.randint(1, 5))) for _ in range(60)]
    return [None, "", " \n\t "] + [rng.choice(("", " ", " ")) + rng.choice((" ", "\n", "\r\n\x0b")).join(rng.choices(forms, k=rng.randint(1, 40))) for _ in range(50)]


@pytest.mark.parametrize("most", [1 << 19, 40])
@pytest.mark.parametrize("mask", [2**64 - 1, 7])
def test_columns_equal_words(monkeypatch, most, mask):
    """With few bits different words have one hash; with little room words go and come back."""
    hashed = words.Words.hash.fget
    monkeypatch.setattr(words.Words, "hash", property(lambda self: hashed(self) & np.uint64(mask)))
    rng, table, one = random.Random(3), tokens.WordTable(tokens.WordIds(), most), tokens.WordIds()
    for _ in range(6):
        rows = texts(rng)
        ids, first = table.rows(pa.array(["left out", *rows]).slice(1))
        assert len(first) == len(rows) + 1 and len(table.hash) <= max(most, 8)
        assert [ids[a:b].astype("<u4").tobytes() for a, b in zip(first, first[1:], strict=False)] == [one.text(t) for t in rows]
    assert table.rows(pa.array([], pa.string()))[0].tolist() == [] and table.rows(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0, 0]
