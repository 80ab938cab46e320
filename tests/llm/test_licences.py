"""The suffix automaton and the licence scan against brute force."""

import random
import re

import pytest

from factloom.llm import licences
from factloom.llm.automaton import SuffixAutomaton

TEMPLATES = (("x", "a b c d e f g h i j"), ("y", "c d e f a a a a"), ("z", "a b c d q r s t u v w"))
PHRASES = (("p", "b c"), ("q", "c d e"), ("r", "a a"))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def segments(words, template, least):
    """All maximal common strings, diagonal by diagonal."""
    out = []
    for shift in range(-len(template), len(words) + 1):
        run = 0
        for k in range(len(template) + 1):
            i = shift + k
            if k < len(template) and 0 <= i < len(words) and words[i] == template[k]:
                run += 1
            else:
                if run >= least:
                    out.append((i - run, k - run, run))
                run = 0
    return sorted(out)


def best_chain(found, gap):
    """The most words that a chain covers, trying all chains."""

    def tail(i):
        t, p, m = found[i]
        return m + max([0] + [tail(j) - over for j, (u, q, n) in enumerate(found) if t < u and p < q and (over := max(t + m - u, p + m - q, 0)) < n and u - t - m <= gap and q - p - m <= gap])

    return max(map(tail, range(len(found))), default=0)


def test_automaton_knows_every_substring():
    rng = random.Random(1)
    for _ in range(60):
        sequences = [[rng.randrange(3) for _ in range(rng.randint(0, 9))] for _ in range(rng.randint(1, 4))]
        automaton = SuffixAutomaton(sequences)
        known = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        tokens = [rng.randrange(4) for _ in range(30)]
        for at, (size, state) in enumerate(automaton.statistics(tokens), 1):
            assert size == max(n for n in range(at + 1) if n == 0 or tuple(tokens[at - n : at]) in known)
            if size:
                whole = {(k, e) for k, s in enumerate(sequences) for e in range(size, len(s) + 1) if s[e - size : e] == tokens[at - size : at]}
                assert set(automaton.places(state)) == whole
                got = {(k, e): n for k, e, n in automaton.suffixes(size, state)}
                for k, s in enumerate(sequences):
                    for e in range(1, len(s) + 1):
                        common = max(n for n in range(min(e, at) + 1) if n == 0 or s[e - n : e] == tokens[at - n : at])
                        assert got.get((k, e), 0) == common


def texts():
    rng = random.Random(2)
    out = [None, "", " \n ", "a b c d e f g h i j", "A,B-C.D/E:F(G)H;I!J", "A_b`c", "éa b c", "x" * 50_000, "a " * 3000, "b c" * 2000]
    for _ in range(300):
        words = []
        while len(words) < 60:
            _, t = rng.choice(TEMPLATES)
            t = t.split()
            a = rng.randrange(len(t))
            words += t[a : a + rng.randint(1, 9)] if rng.random() < 0.7 else rng.choices("abcdefgxyzé", k=rng.randint(1, 4))
        out.append(rng.choice((" ", ", ", "\n")).join(w.upper() if rng.random() < 0.2 else w for w in words))
    return out


def test_scan_agrees_with_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "b c d e"), (3, "a b c d e f g h i j"), (3, "a b c d e f g h i j")]
    docs = spark.createDataFrame([(i, t, "l", 1.0) for i, t in rows], "doc_id long, text string, labels string, score double").repartition(3)
    got = licences.scanned(docs, TEMPLATES, PHRASES, least=3, gap=2, share=0.8).collect()
    want = []
    for doc, text in rows:
        words = split(text)
        places = [(label, at) for label, p in PHRASES for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
        share = {}
        for label, t in TEMPLATES:
            share[label] = max(share.get(label, 0), best_chain(segments(words, t.split(), 3), 2) / len(t.split()))
        base = {label for label, _ in places}
        starts = [at for _, at in places]
        labels = base | {k for k, v in share.items() if v >= 0.8}
        want.append((doc, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else float(max(share.values()))))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, (r[:8] for r in got))) == sorted(map(key, want))


def test_segments_are_all_maximal_matches():
    import pyarrow as pa

    scanner = licences.Scanner(TEMPLATES, PHRASES, 3, 2, 0.8)
    sample = texts()
    _, _, found = scanner.scan(pa.array(sample))
    for text, got in zip(sample, found, strict=True):
        for number, (_, t) in enumerate(TEMPLATES):
            assert sorted(got.get(number, [])) == segments(split(text), t.split(), 3)


def test_spans_and_own_labels(spark):
    mine = "All code here. Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met: none."
    rows = [(1, mine), (2, "Licensed under CC BY-NC 4.0."), (3, "Licensed under CC BY-SA 4.0."), (4, "the license of mit"), (5, "Released under the MIT License.")]
    got = {r.doc_id: r for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["bsd", "cc-by-nc", "", "", "mit"]
    span = got[1].spans[0]
    assert (span.label, span.first_word, span.last_word, span.covered) == ("bsd", 3, 24, 21) and span.share == 1.0
    assert got[3].score < 0.8 and got[4].score == 0 and got[5].base_labels == "mit"
    assert licences.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        licences.Scanner((("x", "a b"),), (), 4, 8, 0.8)
