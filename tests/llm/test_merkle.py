"""The manifest against a tree that is built in memory."""

import hashlib
import zlib

from pyspark.sql import functions as F

from factloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, g int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves, fan):
    """Root, and of each leaf the siblings left and right of its path."""
    nodes, paths = list(leaves), [[] for _ in leaves]
    held = [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fan, len(nodes))) for i in range(0, len(nodes), fan)]
        for run in runs:
            for at in run:
                step = ([nodes[x] for x in run if x < at], [nodes[x] for x in run if x > at])
                for leaf in held[at]:
                    paths[leaf].append(step)
        nodes, held = [h(*(nodes[x] for x in run)) for run in runs], [sum((held[x] for x in run), []) for run in runs]
    return nodes[0], paths


def expected(rows, fan=3):
    leaf = lambda r, text: h(*map(field, r[:4]), field(text))
    by = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
        by.setdefault(r[1], []).append((r[0], leaf(r, r[4]), leaf(r, r[4].replace("\n", "") if hit else r[4])))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        made[s] = tree([r[1] for r in by[s]], fan)
    root, above = tree([made[s][0] for s in order], fan)
    out = []
    for s, top in zip(order, above, strict=True):
        for (doc, one, other), path in zip(by[s], made[s][1], strict=True):
            node, siblings = other, []
            for left, right in path + top:
                node = h(*left, node, *right)
                siblings += left + right
            out.append((doc, one, made[s][0], root, h(*siblings), node, node == root))
    return out


def got(spark, rows, fan=3):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(5)
    return merkle.verified(docs, merkle.newlines_deleted(docs), fan).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()


def same(a, b):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, a)) == sorted(map(key, b))


def rows():
    out = [(i, f"s{i % 3}" if i % 7 else "é", "en", i * 3, f"line {i}\nnext\n" if i % 2 else f"flat {i}") for i in range(90)]
    out += [(200 + i, "hot", None, None, "a\nb" * i) for i in range(83)]
    out += [(None, None, None, None, None), (None, "s1", "x", 1, "a\n"), (1, None, "", 0, ""), (2, "", "", 0, "\n"), (3, "lone", "k", -5, "z" * 40_000 + "\n"), (-4, "Z", "k", 2**60, "\n\r\n")]
    return out + [out[4]] * 5 + [(4, "s1", "en", 12, "other text\n"), (4, "s1", None, 12, "flat 4")]


def test_agrees_with_a_tree_in_memory(spark):
    same(got(spark, rows()), expected(rows()))


def test_small_tables(spark):
    some = [(i, f"s{n}", "l", i, f"t{i}\n") for n in (1, 2, 3, 4, 9, 10) for i in range(n)]
    same(got(spark, some), expected(some))
    some = [(1, "s", "l", 1, "t\n")]
    same(got(spark, some), expected(some))
    assert got(spark, []) == []


def test_levels_beyond_the_small_ones_meet_by_merging(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SMALL_LEVEL", 0)
    same(got(spark, rows(), fan=2), expected(rows(), fan=2))


def test_every_proof_leads_to_the_root_and_no_other_leaf_does(spark):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows()], SCHEMA)
    made = merkle.build(docs)
    p = merkle.proofs(made)
    assert p.where(merkle.folded(F.col("leaf"), F.col("path")) != made.root).count() == 0
    assert p.where(merkle.folded(F.sha2(F.col("leaf"), 256), F.col("path")) == made.root).count() == 0
    assert made.root == expected(rows())[0][3]
