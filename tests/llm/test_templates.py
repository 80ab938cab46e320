"""Texts on one template: large groups without links are cut by their rarest members, and lose no link."""

import collections
import itertools
import random

import numpy as np
import pytest

from factloom.llm import jaccard
from tests.llm.test_operators import components


def templated(seed, n):
    """Ids with lists of words: most on one of two templates with words of their own, and near copies of some."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    common = [[word() for _ in range(34)] for _ in range(2)]
    rows = []
    for _ in range(n):
        c, own = rng.choice(common), [word() for _ in range(rng.choice((2, 5, 8, 8, 8, 30)))]
        at = rng.randrange(len(c))
        rows.append([*c[:at], *own, *c[at:]])
    for w in rng.sample(rows, n // 4):
        near = [*w]
        near[rng.choice((0, -1))] = word()
        rows.append(near)
    rows += [rng.choice(rows) for _ in range(5)]
    return list(enumerate(rows))


def wanted(rows):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for _, w in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return dict(enumerate(components(len(sets), links)))


@pytest.mark.parametrize(("sharers", "classes", "often"), [(4, 3, 1 << 18), (16, 1024, 20)])
def test_cut_groups_agree_with_brute_force(spark, tmp_path, monkeypatch, sharers, classes, often):
    rows = templated(sharers, 160)
    spark.createDataFrame([(i, " ".join(w)) for i, w in [*rows, rows[3]]], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    cuts = []
    made = jaccard.Cut.__call__
    monkeypatch.setattr(jaccard.Cut, "__call__", lambda self, items: (cuts.append(self.block), made(self, items))[1])
    monkeypatch.setattr(jaccard, "SHARERS_A_BLOCK", sharers)
    monkeypatch.setattr(jaccard, "CLASSES_A_BLOCK", classes)
    monkeypatch.setattr(jaccard, "OFTEN", often)
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == wanted(rows)
    assert cuts and len(set(got.values())) < len(got)


def test_rarest_members_of_sets_that_link_meet():
    rng = np.random.default_rng(1)
    common = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64))
    counts = rng.integers(2, 9, len(common))
    met = collections.Counter()
    for n in (1, 2, 4, 5, 9, 38, 200, 3000):
        for _ in range(40):
            a = np.unique(np.concatenate([rng.choice(common, n // 2, replace=False), rng.integers(0, 2**64, n - n // 2, dtype=np.uint64)]))
            gone = rng.integers(0, n // 5 + 1)
            more = rng.integers(0, n // 5 + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, more, dtype=np.uint64)]))
            if 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b)):
                continue
            words = [collections.defaultdict(int) for _ in range(2)]
            for found, s in zip(words, (a, b), strict=True):
                for tokens, side in jaccard.rarest(s, common, counts):
                    for t in tokens.tolist():
                        found[t] |= side
            assert any(words[0][t] | words[1][t] == 3 for t in words[0].keys() & words[1].keys())
            met[n] += 1
    assert min(met[n] for n in (9, 38, 200, 3000)) > 5


def test_templates_share_no_group_by_their_common_members():
    rng = np.random.default_rng(2)
    common = np.unique(rng.integers(0, 2**64, 26, dtype=np.uint64))
    counts = np.full(len(common), 1000)
    seen = collections.Counter()
    for _ in range(200):
        own = rng.integers(0, 2**64, 12, dtype=np.uint64)
        for tokens, _ in jaccard.rarest(np.unique(np.concatenate([common, own])), common, counts):
            seen.update(tokens.tolist())
    assert max(seen.values()) == 1
