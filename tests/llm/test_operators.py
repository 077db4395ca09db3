"""Edge cases of every operator on one small table, and brute-force versions or held-out scores of each."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from framewright.llm import decontam, embeddings, html, langid, mixing, passages, pii, pitman_yor, quality, shingles, simhash
from framewright.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, fp long, low long, c int, row long, score double, size long, held_out string"


def word(rng, kind):
    syllables = {"en": "th er on an re the ing and".split(), "de": "sch ung ein ver keit ge lich".split()}[kind]
    return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))


def text(rng, n, kind="en"):
    return " ".join(word(rng, kind) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(120):
        kind = "de" if i % 3 == 0 else "en"
        t = text(rng, rng.randint(5, 120), kind)
        if i % 7 == 0:
            t = " ".join(w + "###" for w in t.split())
        out.append([i, t, kind, f"s{i % 4}", len(t)])
    long = text(rng, 90)
    out += [[200, long, "en", "s0", None], [201, long, "en", "s0", 1], [202, long.replace(long.split()[45], "odd", 1), "en", "s1", 2]]
    out += [[203, text(rng, 30) + " " + " ".join(long.split()[10:75]) + " " + text(rng, 30), "en", None, 3]]
    out += [[300, None, "en", "s0", 0], [301, "", None, None, None], [302, "  \n\t ", "en", "s1", 3], [303, "1234 567", "de", "s9", 8], [None, "the and the", "en", "s1", 11], [200, long, "en", "s0", None]]
    out += [[304, "word " * 30_000, "en", "s2", 150_000], [305, "write a.b@c.example.com or +1 (017) 555-7713 from 97.51.17.173, Frau Anna Schmidt", "de", "s3", 70]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    wide = [[*r, 1, 2, 3, 4, 5.0, 6, "x"] for r in rows]
    return spark.createDataFrame(wide, EXTRA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], 0 if r[0] is not None and r[0] % 7 == 0 else 1, 0) for r in rows] + [(999, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality(spark, docs, none, labels, rows):
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 == 0)
    held = [(r["score"], r["doc_id"] % 7 == 0) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 120]
    assert max(s for s, bad in held if bad) < min(s for s, bad in held if not bad)
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 3}


def test_language(spark, docs, none, rows):
    model = langid.train(docs, 40)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    right = [got[r[0]]["lang_pred"] == r[2] for r in rows if r[0] is not None and r[0] < 120 and got[r[0]]["held_out"]]
    assert sum(right) >= 0.95 * len(right)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (300, 301, 302, 303))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none, model).count() == 0 and {r["lang_pred"] for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}
    # more languages than share arrays: the same decisions whatever the groups
    rng = random.Random(1)
    many = {f"l{k:03d}": Counter({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))): 1 + rng.randrange(5) for _ in range(40)}) for k in range(700)}
    texts = [" ".join(list(many[x])[:25]) for x in sorted(many)[::7]]
    one, two = (langid.build(many, sorted(many), size) for size in (700, 16))
    assert one.decide(texts)[0] == two.decide(texts)[0] == sorted(many)[::7] and np.allclose(one.texts(texts)[0], two.texts(texts)[0])
    # a model is a distribution over words: all words of up to seven letters have nearly all of the mass
    m = langid.build({"x": Counter({"ab": 3, "ba": 2, "a": 9, "b": 4})}, ["x"])
    every = ["".join(c) for n in range(1, 8) for c in itertools.product("ab", repeat=n)]
    assert 0.6 < (2 ** m.words(every)[0][:, 0]).sum() <= 1 + 1e-9


def test_pitman_yor(docs, none, rows):
    got = pitman_yor.scored(docs).collect()
    count = Counter()
    for r in rows:
        if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 != 2 and r[1] is not None:
            count.update(pitman_yor.tokens(r[1].encode()))
    by = {(r["doc_id"], r["n_tokens"]): r for r in got}
    assert len(got) == len(rows)
    n, v = sum(count.values()), len(count)
    for r in rows:
        w = pitman_yor.tokens((r[1] or "").encode())
        g = by[r[0], len(w)]
        assert g["n_known"] == sum(count[x] > 0 for x in w) and g["train_tokens"] == n
        assert g["base_score"] == pytest.approx(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert g["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert pitman_yor.scored(none).count() == 0


def partitions(n):
    """Set partitions of n things, as lists of block sizes."""
    if n == 0:
        yield []
        return
    for p in partitions(n - 1):
        for i in range(len(p)):
            yield [*p[:i], p[i] + 1, *p[i + 1 :]]
        yield [*p, 1]


def test_pitman_yor_posterior():
    """Gibbs sweeps over a word in two contexts, against the posterior by enumeration of all seatings."""
    d, d0, n, others, total = 0.6, 0.3, (5, 4), (3.0, 2.0), 9.0
    rising = lambda x, k: np.prod([x + i for i in range(k)])
    shape = lambda p: np.prod([rising(1 - d, s - 1) for s in p])
    want = Counter()
    for p, q in itertools.product(partitions(n[0]), partitions(n[1])):
        t = len(p), len(q)
        new = np.prod([np.prod([1 + d * (o + i) for i in range(k)]) for o, k in zip(others, t, strict=True)])
        want[t] += shape(p) * shape(q) * new * rising(1 - d0, sum(t) - 1) / rising(1 + total, sum(t))
    scale = sum(want.values())
    copies, rng = 4000, np.random.default_rng(1)
    sizes, k, ns = np.full(copies, 2), np.tile([0, 1], copies), np.tile(n, copies)
    t, opened, seen = np.ones(2 * copies, dtype=np.int64), np.zeros(0, dtype=np.int64), Counter()

    for sweep in range(25):
        m = pitman_yor.group_sums(t, sizes)
        for j in (0, 1):
            at = np.arange(j, 2 * copies, 2)
            edges = np.cumsum(t - 1) - (t - 1)
            rows = np.repeat(np.arange(len(t)), t - 1)
            old = opened[np.repeat(edges[at], t[at] - 1) + pitman_yor.spans(t[at] - 1)[1]]
            seats = pitman_yor.Seats(np.full(copies, 1 + d * others[j]), (m - t[at]).astype(float), 1 + total + (m - t[at]).astype(float), d, d0)
            new, places = seats.reseat(ns[at], t[at], old, rng)
            keep = ~np.isin(rows, at)
            order = np.argsort(np.r_[rows[keep], np.repeat(at, new - 1)], kind="stable")
            opened = np.r_[opened[keep], places][order]
            m += new - t[at]
            t[at] = new
        if sweep >= 5:
            seen.update(map(tuple, t.reshape(-1, 2).tolist()))
    for x, w in want.items():
        assert abs(seen[x] / (20 * copies) - w / scale) < 0.01, x
    # the plan's own sweep keeps tables and openings in step
    now = pitman_yor.State(np.r_[np.full(pitman_yor.CONTEXTS, 50.0), np.full(pitman_yor.CONTEXTS, 20.0), 30, 10, 4, 9, 3])
    sizes = rng.integers(1, 6, 300)
    n = rng.integers(1, 40, sizes.sum()) ** 2
    t, opened = np.ones(len(n), dtype=np.int64), np.zeros(0, dtype=np.int64)
    for _ in range(3):
        t, opened = pitman_yor.resampled(sizes, rng.integers(0, 41, len(n)), n, t, opened, now, rng)
        row, _ = pitman_yor.spans(t - 1)
        assert len(opened) == (t - 1).sum() and (t <= n).all() and (opened >= 1).all() and (opened < n[row]).all()
        assert (np.diff(opened)[row[1:] == row[:-1]] > 0).all()
    x = np.array([0.1, 0.5, 1, 3.3, 7.9, 8, 100, 1e7])
    assert np.allclose(pitman_yor.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


def test_pitman_yor_contexts(spark, monkeypatch):
    """Every preceding word is a context, and a word has as many as it comes after: rare ones tell what comes next, wherever the rows and buckets are cut."""
    rng = random.Random(3)
    rows = [(i, " ".join(x for j in (rng.randrange(150) for _ in range(25)) for x in (f"before{j}", f"after{j}"))) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    many = pitman_yor.scored(d, most=(40, 1 << 20)).collect()
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 1 << 15)  # several buckets
    for got in (many, pitman_yor.scored(d, most=(40, 1 << 20)).collect()):
        held = [r for r in got if r["held_out"]]
        per = sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held)
        assert len(got) == 500 and abs(per + 0.5 * np.log10(150)) < 0.12  # half of all words are certain, half one of 150
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in many} == {(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got}


def test_pitman_yor_pairs(spark, monkeypatch):
    """What follows a word, of few words seen often, is told by the counts of pairs."""
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 1 << 10)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9))) for _ in range(300)]
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [*enumerate(texts), *((held[k], f"a {w}") for k, w in enumerate("abcdefgh")), *((held[8 + k], w) for k, w in enumerate("abcdefgh"))]
    got = {r["doc_id"]: r["score"] for r in pitman_yor.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), most=(50, 1 << 20)).collect()}
    after: dict = {b"": Counter(), b"a": Counter()}
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = [b"", *pitman_yor.tokens(t.encode())]
            for u, x in zip(w, w[1:], strict=False):
                after.setdefault(u, Counter())[x] += 1
    for k, w in enumerate("abcdefgh"):  # p(a | start) p(w | a) / p(w | start): the end after w is in both texts
        want = after[b""][b"a"] * after[b"a"][w.encode()] / after[b"a"].total() / after[b""][w.encode()]
        assert 10 ** (got[held[k]] - got[held[8 + k]]) == pytest.approx(want, rel=0.35), w


def test_pitman_yor_seats(monkeypatch):
    """Customers seated one by one, and by drawing who opens the next table, follow one law."""
    got = []
    for few in (16, 1):
        monkeypatch.setattr(pitman_yor, "FEW", few)
        size = 40_000
        seats = pitman_yor.Seats(np.full(size, 3.0), np.full(size, 2.0), np.full(size, 20.0), 0.6, 0.3)
        tables, places = seats.seat(np.full(size, 9), np.random.default_rng(2))
        got.append((np.bincount(tables, minlength=10)[:10] / size, np.bincount(places, minlength=10)[:10] / size))
    assert np.abs(got[0][0] - got[1][0]).max() < 0.012 and np.abs(got[0][1] - got[1][1]).max() < 0.012


def test_pitman_yor_blocks(docs):
    whole = sorted(map(repr, pitman_yor.scored(docs).drop("score").collect()))
    cut = pitman_yor.scored(docs, most=(7, 2_000))
    assert sorted(map(repr, cut.drop("score").collect())) == whole and cut.where("score < 0").count() == len(whole)
    runs, raw = pitman_yor.Runs(7, 2_000), ["x" * n for n in (900, 900, 900, 5_000, 1, 1, 1, 1, 1, 1, 1, 1)]
    batch = pitman_yor.pa.RecordBatch.from_pydict({"row": list(range(10, 22)), "text": raw})
    assert runs.of(batch).tolist() == [10, 10, 12, 13, *[14] * 7, 21]
    texts = [" The  cat\x0b\nÄ the\x1cx ", None, "", "a\tb\fa"]
    codes, words, counts = pitman_yor.coded(pitman_yor.pa.array(texts))
    assert [words[c] for c in codes] == [w for t in texts for w in pitman_yor.tokens(None if t is None else t.encode())] and counts.tolist() == [5, 1, 1, 4]
    for n in (3, 300, 70_000, 2**24 + 5):
        x = np.array([0, 1, 2, n - 1], dtype=np.int32)
        assert (pitman_yor.unpacked(pitman_yor.packed(x)) == x).all()


def test_mixing(spark, docs, none, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(size.values())), set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * size[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 3.0 * size[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        biggest = max([x["size"] for x in got if x["source"] == s], default=0)
        assert abs(taken[s] - target[s]) <= 2 * biggest
    again = sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))
    assert again == sorted(map(repr, got)) and mixing.mix(none).count() == 0


def fingerprint(t, k=4):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, none, rows):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.grouped(docs).collect()}
    want = [(r[0], fingerprint(r[1])) for r in rows]
    assert {(i, f & (2**64 - 1)) for i, f in got} == set(want)
    part = list(range(len(want)))
    find = lambda x: x if part[x] == x else find(part[x])
    for i in range(len(want)):
        for j in range(i):
            if (want[i][1] ^ want[j][1]).bit_count() <= 4:
                part[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(want):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    for i, (d, f) in enumerate(want):
        assert got[d, f - 2**64 if f >= 2**63 else f] == low.get(find(i))
    kept = simhash.first_of_each(docs).collect()
    assert len({r["doc_id"] for r in kept}) == len(kept) and 201 not in {r["doc_id"] for r in kept}
    assert simhash.grouped(none).count() == 0


def test_first_of_each_by_row(spark):
    """Rows without an id and unrelated rows with one id are documents of their own; equal rows are one."""
    rng = random.Random(8)
    rows = [(i, text(rng, 200)) for i in (None, None, None, None, None, 7, 7, 8)]
    rows = [(i, t, "x", 1) for i, t in rows]
    schema = "doc_id long, text string, _keep string, maybe int"
    for stage in (simhash.first_of_each, shingles.first_of_each):
        d = spark.createDataFrame(rows, schema)
        kept = stage(d)
        assert kept.columns == d.columns and Counter(kept.collect()) == Counter(d.collect())
        more = [*rows, (9, rows[0][1], "y", 2), (3, rows[5][1], "y", 2), (None, rows[1][1], "y", 2), (8, rows[7][1], "x", 1), (8, rows[7][1], "a", 1), (20, None, "n", 0), (21, "", "n", 0), (None, None, "n", 0)]
        got = [sorted(map(repr, stage(spark.createDataFrame(more, schema).repartition(n)).collect())) for n in (1, 4)]
        assert got[0] == got[1]
        kept = stage(spark.createDataFrame(more, schema)).collect()
        assert len(kept) == 9 and {(r[0], r[1]) for r in kept} == {(9, rows[0][1]), (3, rows[5][1]), (7, rows[6][1]), (8, rows[7][1]), (20, None), *((None, r[1]) for r in rows[1:5])}


def test_simhash_covering():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 500, dtype=np.int64).view(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    ka, ra, ha = simhash.anchors(a)
    kb, rb, _ = simhash.anchors(b)
    assert ha.sum() == 2 * len(a)
    assert {r for _, r in set(zip(ka[ha], ra[ha], strict=True)) & set(zip(kb, rb, strict=True))} == set(range(500))


def test_simhash_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    rng = random.Random(1)
    fps = sorted({7 ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)} | {2**62 - 1, 2**62 - 2})
    fps = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert len(set(got.values())) == 2 and len(got) == len(fps)


def test_shingles(spark, docs, none, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(40):  # 200 words of which 3 differ: Jaccard about 0.86 of five-word shingles
        w = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((2 * i, " ".join(w)))
        for at in rng.sample(range(0, 200, 10), 3 if i % 2 else 12):
            w[at] = "other"
        rows.append((2 * i + 1, " ".join(w)))
    rows += [(100, None), (101, ""), (None, rows[0][1]), (102, rows[0][1]), (103, "a b"), (104, "A  b")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [set(s.tolist()) for s in shingles.shingle_sets([(t or "").encode() for _, t in rows])]
    near = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[0:80:2], sets[1:80:2], strict=True)]
    assert near == [bool(i % 2) for i in range(40)]
    want = {i for i in range(80) if not (i % 4 == 3)} | {100, 103}
    for block, most in ((4000, 1 << 20), (1, 1 << 20), (4000, 250)):
        monkeypatch.setattr(shingles, "BLOCK", block)
        monkeypatch.setattr(shingles, "MOST", most)
        assert {r["doc_id"] for r in shingles.first_of_each(d).collect()} == want
    assert len({r["doc_id"] for r in simhash.first_of_each(d, 5).collect()} & set(range(3, 80, 4))) > 10  # what 4 bits leave
    assert shingles.first_of_each(docs).columns == docs.columns and shingles.grouped(none).count() == 0
    many = [np.unique(np.array(s)) for s in ([1, 2, 3, 4, 5, 6, 7, 8, 9], [20, 21], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [2, 3, 4, 5, 6, 7, 8, 9, 10, 11])]
    assert sorted(sorted(p) for p in shingles.spanning(many)) == [[0, 2], [2, 3]]


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64))
    vec = [v.tolist() for v in base]
    for i in range(30):
        r = rng.normal(size=64)
        r -= r @ base[i] / (base[i] @ base[i]) * base[i]
        c = 0.93 if i % 2 else 0.905
        vec.append((c * base[i] / np.linalg.norm(base[i]) + np.sqrt(1 - c * c) * r / np.linalg.norm(r)).tolist())
    vec += [vec[0]] * 3 + [[0.0] * 64, None, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [], [1.0, 2.0]]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(vec)], "vec_id long, embedding array<float>, label int, n string").repartition(3)
    got = {r["vec_id"]: r for r in embeddings.linked(df).collect()}
    assert len(got) == len(vec)
    ok = [i for i, v in enumerate(vec) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = {i: np.array(vec[i], dtype=np.float32).astype(float) for i in ok}
    n, hits = 0, 0
    for i in range(len(vec)):
        want = [j for j in ok if i in x and j != i and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.9]
        n, hits = n + len(want), hits + got[i]["n_links"]
        assert got[i]["n_links"] <= len(want) and got[i]["kept"] == (got[i]["component_id"] == i)
    assert hits >= 0.97 * n and got[90]["component_id"] == 0
    assert embeddings.linked(df.limit(0)).count() == 0


def test_pii(spark, docs, none, rows):
    key = b"k"
    got = {r["doc_id"]: r for r in pii.found(docs, key).collect()}
    r = got[305]
    assert r["kinds"] == ["email", "phone", "ip", "person"] and all(e not in r["text"] for e in r["entities"])
    assert r["surrogates"][3].startswith("Frau ") and r["surrogates"][3].split()[1] in pii.NAMES["latin", "f"] and r["surrogates"][3].split()[2] in pii.SURNAMES["latin"]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", r["surrogates"][1])
    for x in rows:
        if x[0] not in (305, 303):
            assert got[x[0]]["n_entities"] == 0
    assert got[300]["text"] is None and pii.found(none, key).count() == 0
    out = pii.pseudonymise(docs, key)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert pii.collisions(pii.found(docs, key)).count() == 0
    for size in (2, 10, 1000):
        assert sorted(pii.permute(i, size, b"k", b"t") for i in range(size)) == list(range(size))
    assert pii.key_of(spark) == pii.TEST_KEY
    spark.conf.set(pii.KEY_SETTING, "00ff")
    assert pii.key_of(spark) == b"\x00\xff"
    spark.conf.unset(pii.KEY_SETTING)


def test_pii_surrogates_are_distinct():
    """No two entities of a type share a surrogate, none is its own, and checks hold as before."""
    key, rng = b"k", random.Random(2)
    fresh = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    digits, letters = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    every = {
        "card": [f"{n:016d}" for n in range(4000_0000_0000_0000, 4000_0000_0000_0300)],
        "iban": [f"DE{pii.iban_check('DE', a) if k % 2 else k % 97:02d}{a}" for k, a in enumerate(fresh(digits, 18) for _ in range(300))],
        "ip": [f"{a}.{b}.0.{c}" for a in (1, 9, 255) for b in (0, 7) for c in range(40)] + [f"{a}.{b}.0{c}.{c}" for a in ("01", "1", "001") for b in (0, 7) for c in range(8)],
        "email": [f"{fresh(letters, 3)}@{fresh(letters, 4)}.org" for _ in range(300)], "ssn": [f"{n:03d}-12-3456" for n in range(300)],
        "phone": [f"+49 30 {n}" for n in range(100000, 100300)] + [f"(212) 555-{n}" for n in range(1000, 1300)],
        "secret": [fresh("0123456789abcdef", 32) for _ in range(100)] + ["AKIA" + fresh(digits, 16) for _ in range(100)],
        "person": [f"{g} {f}" for names in pii.NAMES.values() for g in names for f in ("Kowalska", "Smith", "Öztürk", "Иванов", "Li")] + [f"Mr {fresh(letters, 4).title()}" for _ in range(300)] + [a + b for a in "王李张" for b in ("明", "小明", "丽")],
    }
    for kind, texts in every.items():
        texts = sorted(set(texts))
        new = [pii.surrogate(kind, t, key) for t in texts]
        assert len(set(new)) == len(texts), kind
        assert all(a != b and len(a) == len(b) for a, b in zip(texts, new, strict=True) if kind not in ("ip", "person")) and not {a for a, b in zip(texts, new, strict=True) if a == b}, kind
        assert new == [pii.surrogate(kind, t, key) for t in texts] != [pii.surrogate(kind, t, b"other") for t in texts]
    valid = lambda x: int(x[2:4]) == pii.iban_check(x[:2], x[4:])
    assert [valid(x) for x in every["iban"]] == [valid(pii.surrogate("iban", x, key)) for x in every["iban"]] and valid("GB82WEST12345698765432")
    assert [pii.luhn(c) for c in every["card"]] == [pii.luhn(pii.surrogate("card", c, key)) for c in every["card"]]
    assert pii.surrogate("person", "Mr ⅷ", key) != "Mr ⅷ" and pii._like("--", key, "card", bool).startswith("card-")  # nothing to permute: a keyed token


def test_pii_leaves_no_name():
    key = b"k"
    for size in (2, 3, 8, 24, 1000):
        got = [pii.permute(i, size, b"k", b"t") for i in range(size)]
        assert sorted(got) == list(range(size)) and all(a != b for a, b in enumerate(got))
    for (script, _), names in pii.NAMES.items():
        for given in names:
            for family in pii.SURNAMES[script]:
                new = pii.surrogate("person", f"{given} {family}", key).split()
                assert new[0] != given and new[1] != family
    short = [a + b for a in "ABCDEÖЁ" for b in ("a", "o", "ø", "ё", "å")]
    assert all(pii.surrogate("person", f"Mr {n}", key) != f"Mr {n}" for n in short)
    cases = [
        ("met Anna Kowalska today", ["Kowalska"]), ("Anna Maria Kowalska", ["Maria", "Kowalska"]), ("Иван Чехов", ["Чехов"]), ("Mr Brown", ["Brown"]), ("Carmen López", ["López"]),
        ("Frau Anna Maria Schmidt", ["Anna", "Maria", "Schmidt"]), ("to Dr. Wolfgang Becker.", ["Wolfgang", "Becker"]), ("Mr Łukasz Öztürk", ["Łukasz", "Öztürk"]), ("Kenji Tanaka", ["Kenji", "Tanaka"]), ("Aisha Khan", ["Aisha", "Khan"]),
        ("Herr Prof. Hans von der Heide", ["Hans", "Heide"]), ("Jean-Luc Picard", ["Jean", "Luc", "Picard"]), ("Lady Adalind Thornbury", ["Adalind", "Thornbury"]), ("我叫王小明，你好", ["王小明"]), ("请问张丽女士", ["张丽"]),
    ]
    for text, left in cases:
        new, said = pii.replaced(text, key)
        assert [k for k, _, _ in said] == ["person"] and not [x for x in left if x in new], (text, new)
    new, said = pii.replaced("Frau Anna Schmidt came. Later Schmidt left, and Anna, too. Frau Schmidt", key)
    first = said[0][2].split()
    assert new == f"Frau {first[1]} {first[2]} came. Later {first[2]} left, and {first[1]}, too. Frau {first[2]}"
    assert pii.entities("Anna went home") == [] and pii.entities("a Kowalska") == [] and pii.entities("今天天气很好，我们去高山") == []


def test_decontamination(spark, docs, none, monkeypatch):
    rng = random.Random(9)
    items = [(i, text(rng, 40)) for i in range(20)]
    rows = [(0, text(rng, 100)), (1, text(rng, 80) + " " + items[3][1] + " " + text(rng, 90)), (2, items[5][1].upper()), (3, None), (4, ""), (None, text(rng, 50)), (5, text(rng, 30) + " " + " ".join(w for k, w in enumerate(items[7][1].split()) if k % 6 != 1))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([*items, (50, None), (51, ""), (3, items[3][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()}
    assert got == {(1, 3), (2, 5), (5, 7)}
    assert {r["doc_id"] for r in decontam.clean(d, b).collect()} == {0, 3, 4, None}
    assert [len(p) for p in decontam._fitting(items)] == [20]
    monkeypatch.setattr(decontam, "MAX_TERMS", 150)  # two indices or more: the same rows
    assert len(decontam._fitting(items)) > 1 and sum(decontam._fitting(items), []) == items
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()} == {(1, 3), (2, 5), (5, 7)}
    monkeypatch.undo()
    assert decontam.contaminated(docs, b.limit(0)).count() == 0 and decontam.contaminated(none, b).count() == 0
    assert decontam.clean(docs, b.limit(0)).count() == docs.count()
    for _ in range(50):
        x, y = [[rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2)]
        t = np.zeros((len(x) + 1, len(y) + 1), dtype=int)
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1, j + 1] = t[i, j] + 1 if x[i] == y[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontam.lcs(x, y) == t[-1, -1]


def test_decontamination_space_of_all_passages(spark):
    """The latent space is that of all passages: as a dense range finder over every one of them has it."""
    rng = random.Random(12)
    items = [(i, " ".join(f"w{40 * i + j}" for j in range(40))) for i in range(50)]
    rows = [(i, " ".join(f"w{(40 * rng.randrange(50) + rng.randrange(rng.randrange(1, 41))) % 2000}" for _ in range(rng.randrange(5, 30)))) for i in range(9_000)]
    ix = decontam.index(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), items)
    names = {w: k for k, w in enumerate(ix.names.to_pylist())}
    a = np.zeros((len(rows) + len(items), len(names)))
    for r, (_, t) in enumerate(rows + items):
        for w in t.split():
            if w in names:
                a[r, names[w]] += 1
    a *= np.log((len(rows) + 2) / ((a[: len(rows)] > 0).sum(axis=0) + 1))
    a /= np.maximum(1e-9, np.linalg.norm(a, axis=1, keepdims=True))
    a[len(rows) :] *= (len(rows) / len(items)) ** 0.5
    q = np.linalg.qr(np.random.default_rng(7).normal(size=(len(names), decontam.RANK + decontam.OVERSAMPLE)))[0]
    for _ in range(decontam.POWER):
        q = np.linalg.svd(a.T @ (a @ q), full_matrices=False)[0]
    want = a[len(rows) :] @ q[:, : decontam.RANK]
    want /= np.maximum(1e-9, np.linalg.norm(want, axis=1, keepdims=True))
    assert np.abs(ix.items @ ix.items.T - want @ want.T).max() < 0.01


def test_decontamination_of_frequent_items(spark):
    """An item that a third of all documents hold, and items in three documents of a small table."""
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [(i, fresh(30)) for i in range(6)]
    for n, times in ((300, 100), (12, 3)):
        held = {k: 2 for k in range(times)}
        rows = [(k, fresh(60) + " " + items[2][1] + " " + fresh(40)) if k in held else (k, fresh(100)) for k in range(n)]
        rows.append((n, " ".join(w for k, w in enumerate(items[2][1].split()) if k % 6 != 1)))
        d = spark.createDataFrame(rows, "doc_id long, text string")
        b = spark.createDataFrame(items, "item_id long, text string")
        got = decontam.contaminated(d, b).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {*held.items(), (n, 2)} and all(0.4 <= r["cosine"] <= 1.0001 for r in got)
        assert {r["doc_id"] for r in decontam.clean(d, b).collect()} == set(range(times, n))


def test_decontamination_of_long_items(spark, docs):
    """Items of 60 to 3,000 words, whole, in part, and in wide tables with long texts."""
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    items = {n: fresh(n) for n in (60, 300, 1000, 3000)}
    rows = [(n, fresh(80) + w + fresh(50)) for n, w in items.items()] + [(5, fresh(70) + items[3000][1000:1250] + fresh(90)), (6, fresh(2000))]
    b = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    d = spark.createDataFrame([(i, " ".join(w), "x", "s", 1, 1, 2, 3, 4, 5.0, 6, "x") for i, w in rows], EXTRA)
    got = decontam.contaminated(d.unionByName(docs), b).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(5, 3000), (60, 60), (300, 300), (1000, 1000), (3000, 3000)]
    kept = decontam.clean(d.unionByName(docs), b)
    assert kept.columns == docs.columns and kept.count() == docs.count() + 1
    assert [len(p) for p in decontam.parts_of(fresh(3000))][:2] == [125, 125] and decontam.parts_of([]) == [[]]
    for n in range(5):
        t = [" ".join(fresh(n)) + "\u2003Straße ΟΔΟΣ, x_1\u00a0y\n" * n, None, ""]
        w = decontam.Words(decontam.pa.array(t, type=decontam.pa.string()))
        assert [w.of(i) for i in range(3)] == [re.findall(r"\w+", (x or "").lower().replace("ς", "σ")) for x in t]


def test_passages(spark, docs, none):
    got = [r for r in passages.repeated(docs).collect()]
    by = {r["doc_id"]: r for r in got}
    assert {201, 202, 203} <= set(by) and all(r["doc_id"] != r["of_doc_id"] and r["similarity"] >= 0.8 for r in got)
    assert by[203]["n_words"] >= 60 and by[203]["first_word"] <= 31
    assert passages.repeated(none).count() == 0
    at, at2 = np.array([0, 5, 10, 3, 30]), np.array([100, 105, 110, 50, 130])
    assert passages.chain(at, at2)[0][:4] == (0, 34, 100, 134)


def test_passages_two_in_a_chain(spark):
    """Two copies with unrelated words between them, which one chain spans."""
    fresh = lambda n, k=itertools.count(): " ".join(f"w{next(k)}" for _ in range(n))
    rows, want = [], set()
    for i, between in enumerate((40, 60, 100)):
        one, two = fresh(60), fresh(60)
        for d in (2 * i, 2 * i + 1):
            rows.append((d, " ".join([fresh(20), one, fresh(between), two, fresh(20)])))
        want |= {(2 * i + 1, 20, 60, 2 * i, 1.0), (2 * i + 1, 80 + between, 60, 2 * i, 1.0)}
    got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["first_word"], r["n_words"], r["of_doc_id"], r["similarity"]) for r in got} == want


def passage_rows(spark, rows, parts=3, **more):
    return sorted(tuple(r) for r in passages.repeated(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(parts), **more).collect())


def test_passages_with_partial_holders(spark):
    """Documents that hold a part of a passage, before and between its holders, take nothing away; nor does the way rows are dealt."""
    fresh = lambda n, k=itertools.count(): [f"u{next(k)}" for _ in range(n)]
    p = fresh(60)
    rows = [(1, p[:25]), (2, p[25:50]), (3, p[40:]), (10, fresh(30) + p + fresh(30)), (11, fresh(50) + p + fresh(10)), (4, fresh(20) + p[:25] + fresh(50))]
    want = [(11, 50, 60, 10, 30, 60, 1.0)]
    assert passage_rows(spark, rows) == passage_rows(spark, rows, parts=1) == passage_rows(spark, rows, bucket=2) == want
    rows += [(12, fresh(9) + p), (13, p[:39] + fresh(40))]
    got = {(r[0], r[3]) for r in passage_rows(spark, rows, parts=5)}
    assert got == {(11, 10), (12, 11), (12, 10)} or got == {(11, 10), (12, 11)}


def test_passages_with_holders_of_all_seeds(spark):
    """Two word-for-word copies of a passage, all of whose shorter runs have other holders before and between them, are linked."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for size in (47, 60, 90):
        whole = fresh(size)
        parts = [whole[i : i + 39] for i in range(size - 38)]  # too short for a result
        rows = [(i, fresh(20) + p + fresh(20)) for i, p in enumerate(parts)] + [(200 + i, fresh(20) + p + fresh(20)) for i, p in enumerate(parts)]
        rows += [(100, fresh(30) + whole + fresh(30)), (300, fresh(30) + whole + fresh(30))]
        got = passages.repeated(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
        assert any((r["doc_id"], r["of_doc_id"]) == (300, 100) and r["n_words"] >= size for r in got), size


def test_passages_within_a_text(spark):
    fresh = lambda n, k=itertools.count(): [f"v{next(k)}" for _ in range(n)]
    p = fresh(60)
    assert passage_rows(spark, [(1, fresh(20) + p + fresh(100) + p + fresh(9)), (2, fresh(80))]) == [(1, 180, 60, 1, 20, 60, 1.0)]
    got = passage_rows(spark, [(1, ["word"] * 3000), (2, ["word"] * 3000)])  # one seed, used over and over
    assert (2, 1) in {(r[0], r[3]) for r in got}
    assert passage_rows(spark, [(7, p), (7, p)]) == []


@pytest.mark.parametrize("every", [6, 8, 12])
def test_passages_recall(spark, every):
    """Against every planted pair: one word of ``every`` is another one."""
    fresh = lambda n, k=itertools.count(): [f"x{every}_{next(k)}" for _ in range(n)]
    rows, n = [], 50
    for i in range(2 * n):
        w = fresh((60, 140)[i % 2])
        rows += [(2 * i, fresh(30) + w + fresh(30)), (2 * i + 1, fresh(10) + [x if k % every else f"{x}y" for k, x in enumerate(w)] + fresh(30))]
    got = {r[0] // 2: r for r in passage_rows(spark, rows) if r[0] // 2 == r[3] // 2}
    for part in (0, 1):
        assert sum(k % 2 == part for k in got) >= 0.9 * n
    assert all(r[6] >= 0.8 and 10 <= r[1] and r[1] + r[2] <= 152 for r in got.values())


def test_html(spark):
    page = "<html><head><title>x</title></head><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy</div><article><h1>T &amp; U</h1><p>One, two,\n three <b>four</b><p>Five.<script>a()</script></article><div id='comments'><p>Nice, very nice, thanks, all!</p></div><footer>&copy; me</footer>"
    assert html.extract(page) == "T & U One, two, three four Five."
    rows = [(0, "u", page), (1, None, None), (2, "u", ""), (3, "u", "<<<>"), (4, "u", "plain text"), (None, "u", page), (5, "u", "<div>" * 3000 + "deep")]
    got = {r["page_id"]: r for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for deep in ("<ul><li>a, b " * 4500, "<blockquote>x, y. " * 3500, "<b>" * 9000 + "<p>x" * 2000, "</foo>" * 9000 + "<i>" * 9000 + "</foo>" * 9000):
        began = time.process_time()
        html.extract(deep)
        assert time.process_time() - began < 4  # in proportion to the page, however deep
    long = "<article>" + "<p>One, two, three and four.</p>" * 20_000 + "</article><footer>x</footer>"
    assert html.extract(long) == " ".join(["One, two, three and four."] * 20_000)
    assert [got[k]["text"] for k in (1, 2, 4)] == ["", "", "plain text"] and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 240)]
    part = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(part[a], part[b])
            changed |= part[a] != m or part[b] != m
            part[a] = part[b] = m
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: c for n, c in part.items() if n not in loops}
