"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and further columns."""

import collections
import datetime
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import bitslice, exact_dedup, fmindex, fuse, jaccard, language_model, mixing, packing, pseudonyms, substrings, token_counts, toxicity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, n string, row string, k1 string"


def split(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def made():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 7))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choices(vocabulary, k=n))

    passage, base = text(60), text(120)
    rows = [(i, text(rng.randint(1, 150)), f"s{i % 4}") for i in range(40)]
    rows += [(40, base, "s0"), (41, base, "s1"), (42, "  ".join(base.split()), "s0"), (43, base.upper(), None)]
    for i in range(44, 60):
        w = base.split()
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w), "s0"))
    rows += [(i, text(20) + "\n" + passage + "\t" + text(15), "s2") for i in range(60, 70)]
    rows += [(70, None, "s1"), (71, "", None), (72, " \n\t ", "s3"), (73, text(30_000), "s3"), (74, "ab cd", "s1"), (75, "AB cd", "s1"), (76, "one two three four five", "s9"), (77, passage, None), (None, passage, "s1"), (None, None, None)]
    rows += [rows[3], rows[70]]
    return [(i, t, s, "x", "y", "z") for i, t, s in rows]


ROWS = made()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_their_hashes():
    import pyarrow as pa

    texts = [r[1] for r in ROWS]
    w = words.Words(pa.array(texts))
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[f:t], w.end[f:t], strict=True)] for f, t in zip(w.first, w.first[1:], strict=False)]
    assert got == [split(t) for t in texts]
    by_word = {}
    for word, h in zip(itertools.chain(*got), w.hash.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_exact_dedup(docs, empty):
    got = exact_dedup.dedup(docs, exact_dedup.earlier_half(docs)).collect()
    assert len(got) == len(ROWS)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        groups[hashlib.sha256(norm(t).encode()).hexdigest()].append(i)
    for r in got:
        ids = groups[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min((i for i in ids if i is not None), default=None), len(ids))
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert kept == dict.fromkeys(groups, 1)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.dedup(empty, exact_dedup.earlier_half(empty)).count() == 0
    assert exact_dedup.deduplicated(docs).count() == len(groups)


def test_fuse_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 10, 1000, 30_000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        blob = fuse.build(np.concatenate([keys, keys[: n // 2]]))
        assert fuse.probe(blob, keys).all()
        assert fuse.probe(blob, rng.integers(0, 2**64, 10_000, dtype=np.uint64)).mean() < 0.02
        assert len(blob) < 1.6 * n + 200


def components(n, links):
    at = list(range(n))
    for a, b in links:
        x, y = at[a], at[b]
        if x != y:
            at = [min(x, y) if v in (x, y) else v for v in at]
    return at


def test_jaccard_join(docs, empty):
    ids = sorted({i for i, *_ in ROWS if i is not None})
    sets = {}
    for i, t, *_ in ROWS:
        w = split(t, lower=True)
        sets[i, t] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    of = collections.defaultdict(set)
    for (i, _), s in sets.items():
        of[i].add(s)
    links = [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) for x in of[ids[a]] for y in of[ids[b]] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    want = dict(zip(ids, (ids[c] for c in components(len(ids), links)), strict=True))
    degree = collections.Counter(x for pair in links for x in pair)
    distinct = {s for s in sets.values() if s}
    linked = {s: sum(100 * len(s & o) >= 80 * len(s | o) for o in distinct if o != s) for s in distinct}
    got = jaccard.join(docs, count_links=True).collect()
    assert degree and all(r.n_links in {linked.get(s, 0) for s in of[r.doc_id]} for r in got if r.doc_id is not None)
    assert len(got) == len(ROWS) and len({want[i] for i in range(44, 60)}) < 16
    for r in got:
        assert r.n_shingles in {len(s) for s in of[r.doc_id]}
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    assert jaccard.join(empty).count() == 0


def test_groups_of_many_blocks_are_connected_whole(docs, monkeypatch):
    whole = collections.Counter((r.doc_id, r.component_id) for r in jaccard.join(docs).collect())
    for sharers, classes in ((2, 1024), (2048, 3), (3, 2)):
        monkeypatch.setattr(jaccard, "SHARERS_A_BLOCK", sharers)
        monkeypatch.setattr(jaccard, "CLASSES_A_BLOCK", classes)
        assert collections.Counter((r.doc_id, r.component_id) for r in jaccard.join(docs).collect()) == whole


@pytest.mark.parametrize("hub", [1, 5, 1000])
def test_components_with_hubs(spark, monkeypatch, hub):
    from factloom.llm import components as stars

    monkeypatch.setattr(stars, "HUB", hub)
    rng = random.Random(hub)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(50, i) for i in range(200, 260)] + [(i, i + 1) for i in range(400, 420)]
    at = components(421, links)
    got = {r.node: r.component for r in stars.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: c for i, c in enumerate(at) if c != i}


def test_parts_never_lose_a_link():
    rng = np.random.default_rng(3)
    for n in (1, 4, 5, 9, 30, 200, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            swapped = rng.integers(0, max(1, n // 9) + 1)
            b = np.unique(np.concatenate([a[swapped:], rng.integers(0, 2**64, swapped, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 9 * both >= 4 * (len(a) + len(b)):
                assert set(np.concatenate(jaccard.tokens_of(a)).tolist()) & set(np.concatenate(jaccard.tokens_of(b)).tolist())
                x, y = jaccard.folded([jaccard.sketch(a), jaccard.sketch(b)])
                assert (x ^ y).bit_count() <= len(a) + len(b) - 2 * both
                assert jaccard.linked([a], [b])[0, 0]
            else:
                assert not jaccard.linked([a], [b])[0, 0]


def removals(rows):
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = split(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    want = collections.Counter()
    for i, t, *_ in rows:
        w = split(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        want[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    return want


def removed(docs):
    return collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeated(docs).collect())


def test_substring_removal(docs, empty):
    assert removed(docs) == removals(ROWS)
    assert substrings.repeated(empty).count() == 0


def test_substring_removal_of_repeated_ids(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choices("abcdef", k=4)) for _ in range(n))
    passage, other = text(40), text(30)
    rows = [(1, f"{text(9)} {passage}"), (5, f"{passage} {text(20)}"), (7, f"{text(5)} {passage} {other}"), (9, f"{other} {text(8)}"), (9, f"{text(3)} {passage}"), (9, text(60)), (None, passage), (12, passage), (12, passage)]
    rows += [rows[2], rows[3], rows[1]]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    assert removed(spark.read.parquet(str(tmp_path / "d"))) == removals(rows)


def test_the_index_decides_whatever_the_screens_let_through(docs, monkeypatch):
    monkeypatch.setattr(substrings, "LOW48", np.uint64(63))  # almost all hashes are shared
    assert removed(docs) == removals(ROWS)


def test_of_two_segments_of_a_shingle_the_later_streams_through_the_earlier_once():
    rng = np.random.default_rng(5)
    anchor, doc = rng.integers(0, 12, 150), rng.integers(0, 90, 150)
    anchor[:70] = 3
    met = collections.Counter((int(a), int(b)) for low, up in substrings.rounds(anchor, doc) for a in low for b in up if anchor[a] == anchor[b] and doc[a] < doc[b])
    assert all(met[i, j] >= 1 for i in range(150) for j in range(150) if anchor[i] == anchor[j] and doc[i] < doc[j])
    for low, up in substrings.rounds(anchor, doc):
        assert not set(low.tolist()) & set(up.tolist())
    assert len(list(substrings.rounds(anchor, doc))) == 7  # 70 to 128 of one shingle
    assert not list(substrings.rounds(np.arange(5), np.arange(5))) and not list(substrings.rounds(np.zeros(0, np.int64), np.zeros(0, np.int64)))


def test_matching_statistics_of_streamed_segments_stop_short_of_the_threshold():
    rng = np.random.default_rng(9)
    rows = [rng.integers(1, 4, n) for n in (40, 25, 60)]
    indexed = np.concatenate([np.append(r, 0) for r in rows]).astype(np.uint64)
    ids = np.repeat([8, 2, 5], [41, 26, 61])
    at = np.flatnonzero(indexed)
    passing = np.concatenate([rng.integers(1, 5, 50), rows[0][3:20], rng.integers(1, 5, 9), rows[2][:9]]).astype(np.uint64)
    ends = np.arange(6, len(passing) + 1)
    size, least = substrings.streamed((indexed[at], at), passing, ends, ids, 6)
    parts = [r.tolist() for r in rows]
    holds = lambda p: [i for r, i in zip(parts, (8, 2, 5), strict=True) if any(r[k : k + len(p)] == p for k in range(len(r) - len(p) + 1))]
    for e, n, m in zip(ends.tolist(), size.tolist(), least.tolist(), strict=True):
        assert n == max(j for j in range(7) if j == 0 or holds(passing[e - j : e].tolist()))
        assert m == (min(holds(passing[e - 6 : e].tolist())) if n == 6 else np.iinfo(np.int64).max)
    assert 0 < (size < 6).sum() < len(size)


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(7)
    text = np.concatenate([np.append(rng.integers(1, 5, n), 0) for n in (30, 1, 50)])
    index = fmindex.FMIndex(text, 8)
    query = rng.integers(0, 6, 60)
    size, low, high = index.matching(query, np.arange(61), 8)
    whole = text.tolist()
    count = lambda p: sum(whole[i : i + len(p)] == p for i in range(len(whole) - len(p) + 1))
    for end in range(61):
        k = int(size[end])
        fits = [j for j in range(min(8, end) + 1) if j == 0 or (0 not in query[end - j : end] and count(query[end - j : end].tolist()))]
        assert k == max(fits)
        if k:
            assert high[end] - low[end] == count(query[end - k : end].tolist())


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(docs).collect()
    assert len({r.sequence_id for r in got}) == len(got) and packing.pack(empty).count() == 0
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and len(r.ids) == 4 * r.length and 1 << r.bucket == r.length for r in got)
    for capacity in (0, 3, 1 << 16, 1 << 17):
        with pytest.raises(ValueError):
            packing.pack(docs, capacity=capacity)
    wide = packing.pack(docs, capacity=1 << 15).select("sequence_id", "bucket").collect()
    assert [r.bucket for r in sorted(wide, key=lambda r: r.sequence_id)] == sorted(r.bucket for r in wide) and min(r.sequence_id for r in wide) >= 0
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    seen = collections.Counter(i for i, *_ in ROWS)
    for i, text, *_ in ROWS:
        if seen[i] == 1:
            pieces = sorted(by_doc[i], key=lambda r: r.start)
            ids = np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist()
            assert ids == t.encode(text or "", add_special_tokens=False).ids + [2]
            assert [p.start for p in pieces] == list(itertools.accumulate([0, *(p.length for p in pieces[:-1])])) and {p.doc_tokens for p in pieces} == {len(ids)}


@pytest.mark.parametrize("text", ["Don't STOP! it's 42 naïve café—ok…", "<|endoftext|> x<|endoftext|>y", " a b İstanbul ΣΑΣ é", "日本語 テキスト 한국어", "a\x1cb c\x00d 🎉🎉", "...!!! ,, 'll 's"])
def test_cached_ids_are_the_tokenizers(text):
    from factloom.llm.tokens import WordIds

    ids = WordIds()
    for _ in range(2):
        assert np.frombuffer(ids.text(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_frequent_words_stay_in_the_cache():
    from factloom.llm.tokens import WordIds

    class Counted:
        def __init__(self, model):
            self.inner, self.seen = model, []

        def tokenize(self, text):
            self.seen.append(text)
            return self.inner.tokenize(text)

    ids = WordIds(most=8)
    ids.model = Counted(ids.model)
    rare = ["".join(chr(97 + (i * 7 + j * i) % 26) for j in range(6)) + chr(97 + i % 26) + chr(97 + i // 26) for i in range(60)]
    for word in rare:
        text = f"often {word} Often*** {word}!?"
        assert np.frombuffer(ids.text(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.model.seen.count("often") == 1 and len(ids.model.seen) == 1 + len(set(rare))
    assert max(map(len, (ids, ids.older, ids.cores, ids.older_cores))) <= 8
    for p in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
        for word in ("ab" + p, "s" + p + "s" + p, p + "ll" + p, "Éa" + p + "'", "a'" + p):
            assert np.frombuffer(ids.text(word), "<u4").tolist() == ids.tokenizer.encode(word, add_special_tokens=False).ids, word


def test_later_stages_empty_the_cache_of_words():
    import pyarrow as pa

    from factloom.llm import words
    from factloom.llm.tokens import word_ids

    batch = pa.RecordBatch.from_arrays([pa.array(["a b"])], ["text"])
    held = word_ids(None)
    assert list(words.portions([batch], cache="word_ids")) == [batch] and word_ids(None) is held
    assert list(words.portions([batch])) == [batch] and word_ids(None) is not held


def test_token_counts(spark, docs, empty, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = collections.Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in ROWS)
    assert collections.Counter((r.doc_id, r.n_tokens) for r in token_counts.counted(docs).collect()) == want
    assert token_counts.counted(empty).count() == 0
    sep = 9
    rng = np.random.default_rng(2)
    ids = np.where(rng.random(5000) < 0.01, sep, rng.integers(10, 99, 5000)).astype("<u2")
    (tmp_path / "one.bin").write_bytes(ids.tobytes())
    (tmp_path / "none.bin").write_bytes(b"")
    parts = [len(p) - 1 for p in np.split(np.append(ids, sep), np.flatnonzero(np.append(ids, sep) == sep) + 1)[:-1]]
    for block, run in ((1, 7), (1, 1024), (3, 2), (64, 5), (4999, 1), (10_000, 1)):
        monkeypatch.setattr(token_counts, "RUN", run)
        got = sorted((r.ordinal, r.n_tokens) for r in token_counts.scan(spark, str(tmp_path), sep, 2, block).where("file like '%one.bin'").collect())
        assert got == [(k, n) for k, n in enumerate(parts) if n or k < len(parts) - 1]


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.01, 0.3, 0.7]) for _ in range(6)]) for i in range(90)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (120, None), (140, [0.1] * 5 + [None]), (160, [0.1] * 5 + [float("nan")]), (180, [float("inf")] * 6), (200, [0.5] * 3), (None, [0.1] * 6), (20, rows[20][1]), (220, []), (5, [1e300] * 6), (240, [-1e300, 1.5, 0.0, 0.0, 0.0, 3e5]), (300, [0.25, -3e5, 1.0, 0.0, 1e15, 0.0]), (40, [0.25] * 3), (260, [-0.75] * 3), (280, [3e306, 1.0]), (7, [-3e306, 2.5]), (9, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    ok = [(i, [math.floor(64 * x) if abs(x) < 1e290 else int(x) * 64 for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = collections.Counter()
    for q, dims in {(q, len(v)) for q, v in ok if q % 20 == 0}:
        v = min(v for i, v in ok if i == q and len(v) == dims)
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == dims)[:20]
        want.update((q, k + 1, i, -s if abs(s) < 2**63 else None) for k, (s, i) in enumerate(best))
    got = collections.Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in bitslice.top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert got == want and any(q == 240 and s is None for q, _, _, s in want)
    assert bitslice.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, t, s, *_ in ROWS:
        sizes[s] += len(split(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else level * weight[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    assert len(got) == len(ROWS)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in order)
    assert mixing.mixture(docs).count() == sum(r.times for r in got)
    assert mixing.mix(empty).count() == 0


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pseudonyms(spark, empty):
    texts = ["card 4539578763621486 and 4539-5787-6362-1486, wrong 4539578763621487", "on 2024-02-29 or 29.02.2024, never 2023-02-29; 12/31/1999", "+1 (212) 555-0187 ssn 123-45-6789 not 000-45-6789 at 10.0.0.1 or 999.1.1.1", "mail.me42@x.example.com", "again 4539578763621486 2024-02-29", None, "", "plain 12"]
    rows = [r.text for r in pseudonyms.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert rows[5:] == [None, "", "plain 12"] and pseudonyms.pseudonymised(empty, "k").count() == 0
    a, b, wrong = re.search(r"card (\d{16}) and ([\d-]{19}), wrong (\d{16})", rows[0]).groups()
    assert luhn(a) and a != "4539578763621486" and b.replace("-", "") == a and wrong == "4539578763621487"
    assert f"again {a} " in rows[4] and "2023-02-29" in rows[1] and "2024-02-29" not in rows[1]
    iso, dots = re.search(r"on (\d{4}-\d\d-\d\d) or (\d\d\.\d\d\.\d{4})", rows[1]).groups()
    assert iso == "-".join(reversed(dots.split("."))) and iso in rows[4]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} ssn \d{3}-\d\d-\d{4} not 000-45-6789 at (\d{1,3}\.){3}\d{1,3} or 999\.1\.1\.1", rows[2]) and "555-0187" not in rows[2]
    assert re.fullmatch(r"[a-z]{4}\.[a-z]{2}\d\d@x\.example\.com", rows[3]) and "mail.me42" not in rows[3]


def test_pseudonyms_are_a_permutation(spark):
    n = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d")).select(pseudonyms.permuted_digits("k", "t", F.col("d")).alias("p"))
    assert n.distinct().count() == 1000 and n.where(F.length("p") != 3).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 8))) for _ in range(900)]
    rows, labels = [], []
    for i in range(500):
        w = rng.choices(vocabulary, k=rng.randint(10, 80))
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zwerx" + rng.choice("aeiou") + "k", "qumvix", "yjovvy"]))
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (None, "x " * 50_000)]
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.trained(df, known)
    got = {r.doc_id: r for r in toxicity.scored(df, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    right = [got[i].predicted == int(i % 5 == 0) for i in range(500) if i >= 400 or got[i].held_out]
    assert sum(right) >= 0.95 * len(right) and got[901].predicted == 0
    assert toxicity.not_toxic(df, known).count() == sum(not r.predicted for r in got.values())
    nothing = toxicity.trained(df, known.where("false"))
    assert {r.predicted for r in toxicity.scored(df, nothing).collect()} == {0} and toxicity.scored(empty, nothing).count() == 0


def test_language_model(docs, empty):
    tokens = [(i, split(t, lower=True) + [None]) for i, t, *_ in ROWS]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(x for i, t in tokens if not out(i) for x in t)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, out(i), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 5)) for i, t in tokens)
    rows = language_model.judged(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert language_model.judged(empty).count() == 0


def test_language_model_shares_add_up(docs):
    model, counts = language_model.trained(docs.select("doc_id", "text"))
    import pyarrow as pa

    batch = language_model.Batch(pa.array(["ab cd ef"]), model.frequent)
    assert np.allclose(np.exp(language_model.Softmax(model.weights).log_shares(batch.features)).sum(1), 1, atol=1e-5)
    in_class = collections.Counter()
    own = dict(zip(model.frequent.hashes.tolist(), model.frequent.own.tolist(), strict=True))
    for r in counts.collect():
        k = own.get(r.h % 2**64, -1)
        in_class[k if k >= 0 else language_model.OWN + r.kind] += r.c + 1
    for k, total in in_class.items():
        assert total + (k >= language_model.OWN) == model.denominator[k]


def test_language_model_words_follow_the_word_before(spark, monkeypatch):
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2]
    free = iter(i for i in range(1000) if i not in set(held))
    rows = [(next(free), " ".join(f"f{j}" for j in range(40))) for _ in range(30)]
    rows += [(next(free), f"k{i} xy{i}z") for i in range(8) for _ in range(5)]  # xy0z to xy7z: one class by spelling, equally frequent
    rows += [(held[0], "k1 xy1z"), (held[1], "k1 xy2z"), (held[2], "unseen xy2z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for frequent in (language_model.FREQUENT, 36):  # the counts of xy0z to xy7z are at hand, or joined by hash
        monkeypatch.setattr(language_model, "FREQUENT", frequent)
        scores.append({r.doc_id: r.score for r in language_model.judged(df).collect()})
    assert scores[0][held[0]] > scores[0][held[1]] + 0.5
    assert all(math.isclose(s, scores[1][i], abs_tol=1e-4) for i, s in scores[0].items())


def test_language_model_pair_weights_add_up():
    rng = np.random.default_rng(4)
    vocabulary = rng.integers(0, 2**64, 50, dtype=np.uint64)
    base = rng.dirichlet(np.ones(50))
    group, word = rng.integers(0, 6, 400).astype(np.uint32), rng.integers(0, 30, 400)
    every = np.repeat(np.arange(7, dtype=np.uint32), 50)  # each word after each group, not trained; group 6 has no pair
    asked = np.tile(np.arange(50), 7)
    rest, share = language_model.weighed(np.concatenate([group, every]), vocabulary[np.concatenate([word, asked])], np.repeat([1, 0], [400, 350]))
    p = base[asked] * 10 ** rest[400:] * (1 + share[400:] / base[asked])
    assert np.allclose(p.reshape(7, 50).sum(1), 1) and np.allclose(p[300:], base)


def test_pseudonyms_of_other_forms(spark):
    values = ["(212) 555-0187", "212-555-0187", "010-1234-5678", "01012345678", "+82 10-1234-5678", "02-123-4567", "(031) 123-4567", "+44 20 7946 0958", "3782-822463-10005", "1799-12-31", "12/31/2200", "01.03.0004", "9999-12-31", "+1 212 555 0187"]
    kept = ["12-34-5678-9", "2023-02-29", "order 212-555-01877", "3782-822463-10006", "version 1.2.3", "10-12"]
    rows = spark.createDataFrame(list(enumerate(f"x {v} y" for v in values + kept)), "doc_id long, text string")
    got = [r.text[2:-2] for r in pseudonyms.pseudonymised(rows, "k").orderBy("doc_id").collect()]
    new, digits = got[: len(values)], lambda t: re.sub(r"\D", "", t)
    assert got[len(values) :] == kept and all(a != b and re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b) for a, b in zip(values, new, strict=True))
    assert digits(new[0]) == digits(new[1]) == digits(new[13])[1:] and digits(new[2]) == digits(new[3]) and digits(new[2])[3:] == digits(new[4])[4:]
    assert luhn(digits(new[8])) and all(not 1800 <= int(re.search(r"\d{4}", new[i])[0]) < 2200 for i in (9, 10, 11, 12))


def test_pseudonyms_of_other_dates_differ(spark):
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1798-01-01").cast("date"), (F.col("id") + F.when(F.col("id") >= 730, 146097).otherwise(0)).cast("int")), "yyyy-MM-dd").alias("m"))
    assert days.select(pseudonyms.pseudonym(F.col("m"), "k")["new"].alias("new")).where("new < '1800' OR new >= '2200'").distinct().count() == 3000


def test_pseudonyms_against_a_network_of_our_own(spark):
    def drawn(*parts):
        return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)

    def network(kind, l, r, a, b):
        for i in range(8):
            if i % 2:
                r = (r + drawn("k", kind, i, a, b, l)) % b
            else:
                l = (l + drawn("k", kind, i, a, b, r)) % a
        return l, r

    def digits(kind, d):
        n = len(d) // 2
        l, r = network(kind, int(d[:n]), int(d[n:]), 10**n, 10 ** (len(d) - n))
        return f"{l:0{n}d}{r:0{len(d) - n}d}"

    def card(d):
        p = digits("card", d[:-1])
        return next(p + c for c in "0123456789" if luhn(p + c))

    def day(y, m, d):
        n = (datetime.date(y, m, d) - datetime.date(1800, 1, 1)).days
        l, r = network("date", n // 773, n % 773, 189, 773)
        return (datetime.date(1800, 1, 1) + datetime.timedelta(l * 773 + r)).isoformat()

    def address(a, b, c, d):
        l, r = network("ip", a * 256 + b, c * 256 + d, 65536, 65536)
        return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"

    rng = random.Random(8)
    cards = [p + next(c for c in "0123456789" if luhn(p + c)) for p in ("".join(rng.choices("0123456789", k=15)) for _ in range(20))]
    days = [(rng.randint(1800, 2199), rng.randint(1, 12), rng.randint(1, 28)) for _ in range(20)]
    hosts = [tuple(rng.randint(0, 255) for _ in range(4)) for _ in range(20)]
    phones = ["".join(rng.choices("23456789", k=10)) for _ in range(20)]
    rows = [(i, f"a {c} b {y:04d}-{m:02d}-{d:02d} c {'.'.join(map(str, h))} d +1 {p[:3]} {p[3:6]} {p[6:]} e") for i, (c, (y, m, d), h, p) in enumerate(zip(cards, days, hosts, phones, strict=True))]
    want = []
    for c, date, h, p in zip(cards, days, hosts, phones, strict=True):
        q = digits("phone", p)
        want.append(f"a {card(c)} b {day(*date)} c {address(*h)} d +1 {q[:3]} {q[3:6]} {q[6:]} e")
    got = [r.text for r in pseudonyms.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert got == want
    with pytest.raises(ValueError):
        pseudonyms.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "")


def test_mixing_breaks_ties_and_takes_no_column_name(spark, tmp_path):
    rows = [(None, "a b c", "s", i, i, i, i) for i in range(100)] + [(7, "a b c", "s", i, i, i, i) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, row int, times int, turn int, _row int").coalesce(1).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = mixing.mix(df).collect()
    assert sum(r.taken for r in got) == got[0].target == 900 and {r.times for r in got} == {1, 2}
    mixture = mixing.mixture(df).collect()
    assert len(mixture) == 300 and {r.row for r in mixture} == set(range(100)) and all(r.row == r.times == r.turn == r._row for r in mixture)


def test_snapshots_are_written_once_and_opened_again(spark, tmp_path):
    old = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, None), (None, "x y")], "doc_id long, text string").coalesce(1)
    exact_dedup.take(exact_dedup.digests(old), str(tmp_path / "s"))
    held = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*")}
    for texts in (["a b", "c"], ["", "x\ty", "z"]):
        new = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").coalesce(1)
        again = exact_dedup.opened(spark, str(tmp_path / "s"))
        out = exact_dedup.against(exact_dedup.grouped(exact_dedup.digests(new)), new, again, old)
        known = {r.text_sha256 for r in out.where("proved").collect()}
        assert known == {hashlib.sha256(re.sub(r"\s+", " ", t).encode()).hexdigest() for t in texts if t in ("a b", "", "x\ty")}
    assert held == {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*")}
    clash = old.select("*", *(F.lit(5).alias(c) for c in ("row", "_row", "old", "digest")))
    kept = exact_dedup.deduplicated(clash).collect()
    assert len(kept) == 3 and {(r.row, r._row, r.old, r.digest) for r in kept} == {(5, 5, 5, 5)}


def test_language_model_scores_by_definition(spark, docs):
    import pyarrow as pa

    held = language_model.held_out(F.col("doc_id"))
    model, counts = language_model.trained(docs.where(~held))
    again, _ = language_model.trained(docs.where(~held).repartition(7))
    assert np.array_equal(model.weights, again.weights)  # however the table is partitioned
    c = {r.h % 2**64: r.c for r in counts.collect()}
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    batch = lambda t: language_model.Batch(pa.array([t], pa.string()), model.frequent)
    after = collections.defaultdict(collections.Counter)
    for i, t, *_ in ROWS:
        if not out(i):
            b = batch(t)
            for h, kind, before in zip(b.h.tolist(), b.target.tolist(), b.before.tolist(), strict=True):
                after[before, kind][h] += 1
    want = []
    for i, t, *_ in ROWS:
        b, total = batch(t), 0.0
        for n, (h, kind, before) in enumerate(zip(b.h.tolist(), b.target.tolist(), b.before.tolist(), strict=True)):
            s = model.weights[b.features[:, n]].astype(float).sum(0) + model.weights[-1]
            p = math.exp(s[kind] - s.max()) / np.exp(s - s.max()).sum()
            share = (c.get(h, 0) + 1) / model.denominator[kind]
            seen = after[before, kind]
            if kind >= language_model.OWN and seen:
                share = (share * len(seen) + seen[h]) / (sum(seen.values()) + len(seen))
            total += math.log10(p * share)
        want.append((i is None, i or 0, round(total / len(b.h), 3)))
    rows = language_model.scored(docs, model, counts, held).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score / r.n_tokens) for r in rows)
    assert all(g[:2] == w[:2] and math.isclose(g[2], w[2], abs_tol=2e-3) for g, w in zip(got, sorted(want), strict=True))


def test_shared_folder_is_needed_beyond_one_machine(spark):
    from factloom.llm import store

    class Away:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        store.shared_folder(Away())
    before = set(store._made)
    out = store.settled(spark, lambda: store.written(spark.range(5), "inner").where("id > 1"), "outer")
    assert out.count() == 3 and len(set(store._made) - before) == 1
