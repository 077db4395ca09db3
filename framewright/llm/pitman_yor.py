"""LM scoring by a hierarchical Pitman-Yor model.

Restaurants: one per preceding word (or the start of the text), whatever the word, as of a bigram model; all share one
parent, the restaurant of all words, whose base is diffuse: what it leaves to the base is the share of words not seen in
training, one token as in the base score. Customers of the parent are the tables of the contexts. A Gibbs sweep goes over
the contexts of each word: its customers there are taken up, with the tables that they have in the parent, and seated again one
by one by the Chinese-restaurant process; as each seat was drawn without regard for those to come, the new seating is
taken or left by the ratio of what the two make of all customers (a Metropolis step that keeps the posterior). Totals of restaurants
are those of the sweep before, so that all words are seated in parallel; so are the contexts of one turn of a word that has
more than CONTEXTS. A pair of words that was seen once has one table, and only counts. The predictive probabilities of the last
sweeps are averaged.

Texts are coded once, in blocks, runs of rows of an input split with a bounded size. Words, and pairs of words, are dealt to
buckets by their hashes, about BUCKET_BYTES of text to each: a block sends each bucket one packed message with all that it asks
of it, and gets one with the answers in the order asked. Word buckets number the words (so that pairs are told apart exactly)
and hold the seating; pair buckets add up the pairs of all blocks. What goes to all tasks has a fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import crc_mod, dropped, group_sums, released, spans, table, written

#: Turns of a sweep: up to so many contexts of a word are seated one after the other; of a word with more, as many turns of several.
CONTEXTS = 41
SWEEPS, KEPT = 3, 2
STRENGTH = 1.0
#: Up to so many customers are seated one by one, more by drawing who opens the next table; both draw from the same law.
FEW = 16
#: Rows and bytes of text of a block at most (a longer text is a block).
BLOCK_ROWS, BLOCK_BYTES = 4_096, 16 << 20
#: Bytes of text for each bucket of words, and of pairs of words.
BUCKET_BYTES = 16 << 20
#: The end of a text, a token, and its start, a context.
END, START = b"\n", b""


# -- words and contexts ---------------------------------------------------------------------------


def tokens(raw: bytes | None) -> list[bytes]:
    return [*(raw or b"").lower().split(), END]


def _runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Per token: word code; tokens per text (without ends); the distinct words. A-Z are lower-cased, white space is that of ``tokens``."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    codes, words = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.cast(pa.binary()).to_pylist()
    full = np.array([len(w) > 0 for w in words], dtype=bool)[codes] if len(words) else np.zeros(0, dtype=bool)
    return codes[full], group_sums(full.astype(np.int64), np.diff(lists.offsets.to_numpy())), words


def coded(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Per token of a block, ends included: word code; the distinct words in order of their first use; tokens per text."""
    known: dict[bytes, int] = {}
    parts, sizes = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
    for lo in range(0, len(texts), 512):  # the words of a few texts at a time
        local, n, names = _runs(texts.slice(lo, 512))
        names.append(END)
        whole = np.insert(local, np.cumsum(n), len(names) - 1)
        order, used = pd.factorize(whole)
        parts.append(np.fromiter((known.setdefault(names[j], len(known)) for j in used), dtype=np.int32, count=len(used))[order])
        sizes.append(n + 1)
    return np.concatenate(parts), list(known), np.concatenate(sizes)


def pairs_of(codes: np.ndarray, number: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per token: the numbers of the word before it, or of the start (the last word), and of its own, in one integer."""
    own = number[codes]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.cumsum(counts) - counts] = number[-1]
    return before << 32 | own


def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def packed(codes: np.ndarray) -> bytes:
    """Whole numbers in as few whole bytes each as the largest takes, byte by byte and compressed, after their number and width."""
    width = max(1, -(-int(codes.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(codes).to_bytes(8, "little") + bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), raw[8]
    rows = np.frombuffer(pa.decompress(raw[9:], decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8).reshape(width, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = rows.T
    return out.view("<i8").ravel()


def together(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *map(unpacked, parts)])


#: Messages: to and of which block or bucket, of what kind, and packed numbers.
MAIL = "to long, of long, kind string, x array<binary>"


def mail(rows: list[tuple[int, int, str, list]]) -> pa.Table:
    x = [[v if isinstance(v, bytes) else packed(v) for v in r[3]] for r in rows]
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.table([*(pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)), pa.array(x, type=pa.list_(pa.binary()))], names=["to", "of", "kind", "x"])


def letters(t: pa.Table | pa.RecordBatch, kind: str) -> tuple[list[int], list[list[bytes]]]:
    """Senders, in order, and contents of messages of a kind."""
    got = sorted((o, x) for o, k, x in zip(*(t.column(c).to_pylist() for c in ("of", "kind", "x")), strict=True) if k == kind)
    return [o for o, _ in got], [x for _, x in got]


def dealt(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each receiver, in order, its part of some columns, in theirs."""
    order = np.argsort(to, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0, True]) if len(to) else np.zeros(1, np.int64)
    columns = [c[order] for c in columns]
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        yield int(to[order[lo]]), [c[lo:hi] for c in columns]


def sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, weights=values, minlength=size).astype(np.int64)


# -- seating --------------------------------------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    low = x < 8
    y = np.where(low, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    if low.any():
        z = x[low]
        out[low] -= np.log(z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6) * (z + 7))
    return out


class Seats:
    """What a new table weighs for dishes, given all customers but their own: (a + d t) (m + t - d0) / (total + t) with t tables of theirs."""

    def __init__(self, a: np.ndarray, m: np.ndarray, total: np.ndarray, d: float, d0: float):
        self.a, self.m, self.total, self.d, self.d0 = a, m, total, d, d0

    def fresh(self, row: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (self.a[row] + self.d * t) * (self.m[row] + t - self.d0) / (self.total[row] + t)

    def weight(self, n: np.ndarray, tables: np.ndarray, opened: np.ndarray) -> np.ndarray:
        """Logarithm of the product, over a dish's customers after the first, of what all their seats weighed. ``opened``: who sat at a new table, by dish."""
        row, k = spans(tables)  # with k + 1 tables customers came from the one after an opening to the next
        own = spans(tables - 1)
        lo, hi = np.ones(len(row)), n[row].astype(np.float64)
        start = np.cumsum(tables) - tables
        lo[start[own[0]] + own[1] + 1] = opened + 1
        hi[start[own[0]] + own[1]] = opened + 1
        t = k + 1.0
        f = self.fresh(row, t)
        return group_sums(lgamma(hi - self.d * t + f) - lgamma(lo - self.d * t + f), tables)

    def seat(self, n: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Dishes with n customers seated one after the other: tables, and who after the first opened one.

        With i seated at t tables the next one opens a table with probability fresh / (i - d t + fresh); the first to do so is
        drawn at once, by bisection of the probability that none does before.
        """
        tables = np.ones(len(n), dtype=np.int64)
        rows, places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        live = np.flatnonzero((n > 1) & (n <= FEW))
        for seated in range(1, FEW):
            live = live[n[live] > seated]
            if not len(live):
                break
            t = tables[live].astype(np.float64)
            f = self.fresh(live, t)
            opens = live[rng.random(len(live)) * (seated - self.d * t + f) < f]
            tables[opens] += 1
            rows.append(opens), places.append(np.full(len(opens), seated))
        live, i = np.flatnonzero((n > 1) & (n > FEW)), np.ones(len(n), dtype=np.int64)
        while len(live):
            t = tables[live].astype(np.float64)
            f, x = self.fresh(live, t), i[live] - self.d * t
            # the logarithm of the probability that none of i to j - 1 does is that of these less u
            none = lambda j, t, f: lgamma(j - self.d * t) - lgamma(j - self.d * t + f)
            u = np.log(rng.random(len(live))) + lgamma(x) - lgamma(x + f)
            some = none(n[live].astype(np.float64), t, f) < u
            live, t, f, u = live[some], t[some], f[some], u[some]
            lo, hi = i[live].copy(), n[live] - 1  # the least j with none(j + 1) < u
            wide = np.flatnonzero(lo < hi)
            while len(wide):
                mid = (lo[wide] + hi[wide]) // 2
                over = none(mid + 1.0, t[wide], f[wide]) < u[wide]
                lo[wide], hi[wide] = np.where(over, lo[wide], mid + 1), np.where(over, mid, hi[wide])
                wide = wide[lo[wide] < hi[wide]]
            tables[live] += 1
            i[live] = lo + 1
            rows.append(live), places.append(lo)
            live = live[i[live] < n[live]]
        row, place = np.concatenate(rows), np.concatenate(places)
        return tables, place[np.argsort(row, kind="stable")]

    def reseat(self, n: np.ndarray, tables: np.ndarray, opened: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """A step of the chain for dishes seated at ``tables``."""
        new, places = self.seat(n, rng)
        take = np.log(rng.random(len(n))) < self.weight(n, new, places) - self.weight(n, tables, opened)
        old, fresh = np.repeat(~take, tables - 1), np.repeat(take, new - 1)
        row = np.r_[np.repeat(np.arange(len(n)), tables - 1)[old], np.repeat(np.arange(len(n)), new - 1)[fresh]]
        return np.where(take, new, tables), np.r_[opened[old], places[fresh]][np.argsort(row, kind="stable")]


# -- the model over words -------------------------------------------------------------------------


class State:
    """Totals that a sweep has left: customers and tables of some contexts; the tables of all, distinct words, and the discounts."""

    def __init__(self, dense: np.ndarray, total: float | None = None):
        n = (len(dense) - 5) // 2
        self.customers, self.tables, self.distinct = dense[:n], dense[n : 2 * n], dense[2 * n]
        one, two, one_root, two_root = dense[2 * n + 1 :]
        self.total = self.tables.sum() if total is None else total
        rate = lambda a, b: float(np.clip(a / max(1.0, a + 2 * b), 0.1, 0.9))
        self.d, self.d_root = rate(one, two), rate(one_root, two_root)

    def root(self, m: np.ndarray) -> np.ndarray:
        """Share of words with m customers in the root: the base is diffuse, so each word has one table there."""
        return np.maximum(m - self.d_root, 0) / (STRENGTH + self.total)

    def new(self) -> float:
        """What the root leaves to its base: the share of all words that it has not seen."""
        return (STRENGTH + self.d_root * self.distinct) / (STRENGTH + self.total)

    def leaf(self, customers: np.ndarray, tables: np.ndarray, n: np.ndarray, t: np.ndarray, up: np.ndarray) -> np.ndarray:
        """Share of words with n customers at t tables in contexts with so many of all words."""
        return (np.maximum(n - self.d * t, 0) + (STRENGTH + self.d * tables) * up) / (STRENGTH + customers)


def resampled(
    sizes: np.ndarray, k: np.ndarray, n: np.ndarray, t: np.ndarray, opened: np.ndarray, now: State, rng: np.random.Generator, lone: np.ndarray | int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """A Gibbs sweep over the contexts of some words: tables and openings. Words have ``lone`` more tables in the root, of contexts that saw them once."""
    t = t.copy()
    owner, nth = spans(sizes)
    m = group_sums(t, sizes) + lone
    edges = np.cumsum(t - 1) - (t - 1)
    row_of, place_of = [np.repeat(np.arange(len(t)), t - 1)], [opened]
    turn = np.where(sizes[owner] > CONTEXTS, nth * CONTEXTS // sizes[owner], nth)
    live = np.flatnonzero(n > 1)  # one customer has one table
    for _, (at,) in dealt(turn[live], live):
        own = t[at]
        old = opened[np.repeat(edges[at], own - 1) + spans(own - 1)[1]]
        w = owner[at]
        seated = Seats(STRENGTH + now.d * (now.tables[k[at]] - own), (m[w] - own).astype(np.float64), STRENGTH + now.total - own, now.d, now.d_root)
        new, places = seated.reseat(n[at], own, old, rng)
        np.add.at(m, w, new - own)
        t[at] = new
        row_of.append(np.repeat(at, new - 1)), place_of.append(places)
    single = n[row_of[0]] <= 1
    rows, places = np.concatenate([row_of[0][single], *row_of[1:]]), np.concatenate([place_of[0][single], *place_of[1:]])
    return t, places[np.argsort(rows, kind="stable")]


# -- the model over buckets -----------------------------------------------------------------------
# A word's number is its place in its bucket times the buckets, plus the bucket.


def _numbered(t: pa.Table, buckets: int) -> pa.Table:
    """The words of a bucket, the most frequent first: to each block the numbers and training counts of its own, and the sums of all."""
    bucket = t.column("to")[0].as_py()
    blocks, got = letters(t, "words")
    words = pa.array(b" ".join(x[0] for x in got).split(b" "), type=pa.binary()).dictionary_encode().indices.to_numpy()
    n = [unpacked(x[1]) for x in got]
    c = sums(words, np.concatenate(n), int(words.max()) + 1)
    place = np.empty(len(c), dtype=np.int64)
    place[np.argsort(-c, kind="stable")] = np.arange(len(c))
    edge = np.cumsum([0, *map(len, n)])
    out = mail([(b, bucket, "numbers", [place[words[lo:hi]] * buckets + bucket, c[words[lo:hi]]]) for b, lo, hi in zip(blocks, edge[:-1], edge[1:], strict=True)])
    first = np.arange(len(out)) == 0
    return out.append_column("n", pa.array(first * int(c.sum()))).append_column("v", pa.array(first * int((c > 0).sum())))


def _block(left: pa.Table, right: pa.Table):
    """Of a block: its row, and per token the pair; the numbers' order of its words, and their training counts."""
    row = left.slice(0, 1).to_pylist()[0]
    codes, order = map(unpacked, row["x"])
    counts = np.array(row["sizes"], dtype=np.int64)
    _, got = letters(right, "numbers")
    number, c = np.empty_like(order), np.empty_like(order)
    number[order], c[order] = together([x[0] for x in got]), together([x[1] for x in got])
    return row, codes, counts, order, c, pairs_of(codes, number, counts)


def _asked(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    """The pairs of a block and their training counts, to each bucket its own."""
    row, _, counts, _, _, pairs = _block(left, right)
    learn = np.repeat(~np.array(row["held"], dtype=bool), counts)
    code, every = pd.factorize(pairs)
    order = np.argsort(every)
    every, count = every[order], np.bincount(code[learn], minlength=len(every))[order]
    return mail([(to, row["block"], "pairs", [p >> 32, p & 0xFFFFFFFF, k]) for to, (p, k) in dealt(bucket_of(every, buckets), every, count)])


def _counted(t: pa.Table, buckets: int) -> pa.Table:
    """The pairs of a bucket: which of them the blocks ask for, and to the buckets of their words those seen again and the numbers of those seen once."""
    bucket = t.column("to")[0].as_py()
    blocks, got = letters(t, "pairs")
    u, w, n = (together([x[i] for x in got]) for i in range(3))
    size = np.array([int.from_bytes(x[0][:8], "little") for x in got], dtype=np.int64)
    pairs, where = np.unique(u << 32 | w, return_inverse=True)
    n = sums(where, n, len(pairs))
    u, w, many = pairs >> 32, pairs & 0xFFFFFFFF, n > 1
    out = [(bucket, -1, "asked", [np.array(blocks, dtype=np.int64), size, where, n, w[many] % buckets])]
    out += [(to, bucket, "many", x) for to, x in dealt(w[many] % buckets, u[many], w[many], n[many])]
    names, at = np.unique(np.r_[u[n == 1], w[n == 1]], return_inverse=True)
    before, own = (np.bincount(x, minlength=len(names)) for x in (at[: len(at) // 2], at[len(at) // 2 :]))
    return mail(out + [(to, bucket, "once", x) for to, x in dealt(names % buckets, names // buckets, before, own)])


def _begun(t: pa.Table, buckets: int) -> pa.Table:
    """The seating of a bucket of words, a table for each pair: pairs seen once by context and by word, then contexts, words, customers, tables by sweep and openings of the others."""
    bucket = t.column("to")[0].as_py()
    once, many = letters(t, "once")[1], letters(t, "many")[1]
    names, before, own = (together([x[i] for x in once]) for i in range(3))
    u, w, n = (together([x[i] for x in many]) for i in range(3))
    w //= buckets
    size = int(max(names.max(initial=-1), w.max(initial=-1))) + 1
    order = np.lexsort((u, -n, w))  # the contexts with most customers first: a turn has such of about as many
    u, w, n = u[order], w[order], n[order]
    return mail([(bucket, -1, "state", [sums(names, before, size), sums(names, own, size), u, w, n, *[np.ones_like(n)] * KEPT, np.zeros(0, np.int64)])])


def _told(b: pa.RecordBatch, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a bucket's state tells the buckets of its contexts, customers and tables by sweep; to itself pairs seen once by context, and tables by word and sweep."""
    for bucket, x in zip(b.column("to").to_pylist(), b.column("x").to_pylist(), strict=True):
        before, own, u, w, n, *t = map(unpacked, x[:-1])
        names, at = np.unique(u, return_inverse=True)
        some = [sums(at, v, len(names)) for v in (n, *t)]
        out = [(bucket, -1, "own", [before, *(own + sums(w, v, len(own)) for v in t)])]
        yield from mail(out + [(to, bucket, "sums", x) for to, x in dealt(names % buckets, names // buckets, *some)]).to_batches()


def _totals(t: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Of a bucket: who told of contexts, and which; all customers and tables by sweep of its words as contexts, and tables of its words by sweep."""
    of, got = letters(t, "sums")
    own = [unpacked(v) for x in letters(t, "own")[1] for v in x] or [np.zeros(0, np.int64)] * (KEPT + 1)
    asked = [unpacked(x[0]) for x in got]
    size = max([len(own[0]), *(int(a.max(initial=-1)) + 1 for a in asked)])
    at = np.concatenate([np.zeros(0, np.int64), *asked])
    lone = np.r_[own[0], np.zeros(size - len(own[0]), np.int64)]
    return of, asked, np.stack([lone + sums(at, together([x[i] for x in got]), size) for i in range(1, KEPT + 2)]), own[1:]


def _replied(t: pa.Table) -> pa.Table:
    bucket = t.column("to")[0].as_py()
    of, asked, all_of, _ = _totals(t)
    return mail([(o, bucket, "totals", [all_of[0][a], all_of[-1][a]]) for o, a in zip(of, asked, strict=True)])


def _swept(left: pa.Table, right: pa.Table, overall: np.ndarray, sweep: int, buckets: int) -> pa.Table:
    """One Gibbs sweep over the words of a bucket."""
    bucket = left.column("to")[0].as_py()
    before, own, u, w, n, *t, opened = map(unpacked, left.column("x")[0].as_py())
    _, got = letters(right, "totals")
    names, at = np.unique(u, return_inverse=True)
    order = np.argsort(names % buckets, kind="stable")
    customers, tables = np.empty(len(names)), np.empty(len(names))
    customers[order], tables[order] = (together([x[i] for x in got]) for i in (0, 1))
    word, sizes = np.unique(w, return_counts=True)
    now = State(np.r_[customers, tables, overall[1:]], overall[0])
    new, opened = resampled(sizes, at, n, t[-1], opened, now, np.random.default_rng([sweep, bucket]), own[word])
    return mail([(bucket, -1, "state", [before, own, u, w, n, *[*t, new][-KEPT:], opened])])


def totals(state: DataFrame) -> np.ndarray:
    """Sums over all words at a fixed number of places: tables, distinct words, and how many pairs and words have one or two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(6)
        for b in batches:
            for x in b.column("x").to_pylist():
                own, w, n, t = (unpacked(x[i]) for i in (1, 3, 4, 4 + KEPT))
                m = own + sums(w, t, len(own))
                out += m.sum(), (m > 0).sum(), own.sum(), (n == 2).sum(), (m == 1).sum(), (m == 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["at", "v"])

    dense = np.zeros(6)
    for r in state.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        dense[r["at"]] = r["v"]
    return dense


def _words_answered(t: pa.Table, buckets: int) -> pa.Table:
    """To each block, in the order of its words in the bucket: customers and tables by sweep as contexts, and tables in the root by sweep."""
    bucket = t.column("to")[0].as_py()
    _, _, all_of, own = _totals(t)
    of, got = letters(t, "numbers")
    asked = [unpacked(x[0]) // buckets for x in got]
    size = max([all_of.shape[1], *(int(a.max(initial=-1)) + 1 for a in asked)])
    every = np.stack([np.r_[v, np.zeros(size - len(v), np.int64)] for v in (*all_of, *own)])
    return mail([(o, bucket, "words", list(every[:, a])) for o, a in zip(of, asked, strict=True)])


def _pairs_back(b: pa.RecordBatch, buckets: int) -> Iterator[pa.RecordBatch]:
    """The tables by sweep of a bucket's pairs, to the buckets that they were counted in, in the order of pairs."""
    for bucket, x in zip(b.column("to").to_pylist(), b.column("x").to_pylist(), strict=True):
        u, w, _, *t = map(unpacked, x[2:-1])
        pairs = u << 32 | (w * buckets + bucket)
        order = np.argsort(pairs)
        yield from mail([(to, bucket, "tables", x) for to, x in dealt(bucket_of(pairs[order], buckets), *(v[order] for v in t))]).to_batches()


def _pairs_answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """To each block, in the order asked: customers and tables by sweep of its pairs."""
    bucket = left.column("to")[0].as_py()
    blocks, size, where, n, word = map(unpacked, left.column("x")[0].as_py())
    _, got = letters(right, "tables")
    many = np.flatnonzero(n > 1)[np.argsort(word, kind="stable")]
    t = np.tile(np.minimum(n, 1), (KEPT, 1))
    for i in range(KEPT):
        t[i, many] = together([x[i] for x in got])
    edge = np.r_[0, np.cumsum(size)]
    return mail([(int(b), bucket, "pairs", [n[where[lo:hi]], *t[:, where[lo:hi]]]) for b, lo, hi in zip(blocks, edge[:-1], edge[1:], strict=True)])


def scored(docs: DataFrame, modulus: int = 7, held: int = 2, most: tuple[int, int] = (BLOCK_ROWS, BLOCK_BYTES)) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``.

    Null and empty texts are the end token alone. A null id counts as the empty text for ``held_out``.
    Rows that repeat are scored alike. Without any training row every token's base is 1 / (V + 1) = 1 and the model is
    certain of the unknown token. Texts are taken whole; no rows give no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    buckets = max(1, -(-int(size) // BUCKET_BYTES))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", (crc_mod("doc_id", modulus) == held).alias("held_out"))

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "ids", "held", "sizes"]
        for block, ids, out, texts in _blocks(batches, Runs(*most)):
            codes, words, counts = coded(texts)
            n = np.r_[np.bincount(codes[np.repeat(~out, counts)], minlength=len(words)), 0]
            words.append(START)
            at = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % buckets
            asked = [(to, block, "words", [b" ".join([words[i] for i in some]), n[some]]) for to, (some,) in dealt(at, np.arange(len(words)))]
            got = mail([*asked, (-1, block, "texts", [codes, np.argsort(at, kind="stable")])])
            row = [block, ids.to_pylist(), out.tolist(), counts.tolist()]
            for name, v, t in zip(names, row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())), strict=True):
                got = got.append_column(name, pa.array([None] * len(asked) + [v], type=t))
            yield from got.combine_chunks().to_batches()

    def to(df: DataFrame, n: int = buckets, by: str = "to") -> DataFrame:
        return df.repartition(n, by)  # as many partitions as receivers: what a task reads does not grow with the input

    both = written(rows.mapInArrow(need, f"{MAIL}, block long, ids array<long>, held array<boolean>, sizes array<long>"), "blocks", by="kind")
    texts = both.where("kind = 'texts'").select("block", "ids", "held", "sizes", "x")
    blocks = max(1, texts.count())
    columns = ["to", "of", "kind", "x"]
    numbers = written(to(both.where("kind = 'words'").select(*columns)).groupBy("to").applyInArrow(lambda t: _numbered(t, buckets), f"{MAIL}, n long, v long"), "numbers")
    dropped(both, "kind=words")
    seen = numbers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    big_n, big_v = int(seen["n"]), int(seen["v"])
    numbers = numbers.select(*columns)
    by_block = to(texts, blocks, "block").groupBy("block")
    asked = by_block.cogroup(to(numbers, blocks).groupBy("to")).applyInArrow(lambda a, b: _asked(a, b, buckets), MAIL)
    pairs = written(to(asked).groupBy("to").applyInArrow(lambda t: _counted(t, buckets), MAIL), "pairs", by="kind")
    released(docs.sparkSession)
    state = written(to(pairs.where("kind in ('many', 'once')").select(*columns)).groupBy("to").applyInArrow(lambda t: _begun(t, buckets), MAIL), "state")
    for kind in ("many", "once"):
        dropped(pairs, f"kind={kind}")

    def told(state: DataFrame) -> DataFrame:
        return state.mapInArrow(lambda batches: (m for b in batches for m in _told(b, buckets)), MAIL)

    def step(overall: np.ndarray, sweep: int):
        return lambda a, b: _swept(a, b, overall, sweep, buckets)

    models = [totals(state)]
    for sweep in range(SWEEPS):
        replies = to(told(state)).groupBy("to").applyInArrow(_replied, MAIL)
        after = written(to(state).groupBy("to").cogroup(to(replies).groupBy("to")).applyInArrow(step(models[-1], sweep), MAIL), "state")
        dropped(state)
        state = after
        models.append(totals(state))
    models = [State(m[1:], m[0]) for m in models[-KEPT:]]
    by_bucket = numbers.select(F.col("of").alias("to"), F.col("to").alias("of"), "kind", "x")
    words = to(told(state).unionByName(by_bucket)).groupBy("to").applyInArrow(lambda t: _words_answered(t, buckets), MAIL)
    back = to(state.mapInArrow(lambda batches: (m for b in batches for m in _pairs_back(b, buckets)), MAIL))
    found = to(pairs.where("kind = 'asked'").select(*columns)).groupBy("to").cogroup(back.groupBy("to")).applyInArrow(_pairs_answered, MAIL)
    answers = numbers.unionByName(words).unionByName(found)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block, codes, counts, order, c, pairs = _block(left, right)
        own = np.zeros((2 * KEPT + 1, len(order)))  # customers and tables as contexts, tables in the root
        got = letters(right, "words")[1]
        for i in range(len(own)):
            own[i, order] = together([x[i] for x in got])
        got = letters(right, "pairs")[1]
        code, every = pd.factorize(pairs)
        place = np.argsort(every)
        place = place[np.argsort(bucket_of(every[place], buckets), kind="stable")]
        seats = np.zeros((KEPT + 1, len(every)), dtype=np.int64)
        for i in range(len(seats)):
            seats[i, place] = together([x[i] for x in got])
        first = np.empty(len(every), dtype=np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[np.cumsum(counts) - counts] = len(order) - 1
        ups = [np.where(c == 0, m.new(), m.root(own[KEPT + 1 + j])) for j, m in enumerate(models)]  # all that is unknown is one token, as for the base score
        base = np.log10((c + 1) / (big_n + big_v + 1))
        logs, run = np.zeros(len(every)), 1 << 18
        for lo in range(0, len(every), run):
            at, (n, *t) = first[lo : lo + run], seats[:, lo : lo + run]
            word, k = codes[at], before[at]
            p = sum(m.leaf(own[0, k], own[1 + j, k], n, t[j], ups[j][word]) for j, m in enumerate(models)) / len(models)
            logs[lo : lo + run] = np.log10(np.maximum(p, 1e-300))
        scores = logs[code]
        return pa.table(
            {
                "doc_id": pa.array(block["ids"], type=pa.int64()), "held_out": pa.array(block["held"], type=pa.bool_()), "n_tokens": pa.array(counts),
                "n_known": pa.array(group_sums((c[codes] > 0).astype(np.int64), counts)), "train_tokens": pa.array(np.full(len(counts), big_n)),
                "base_score": pa.array(group_sums(base[codes], counts)), "score": pa.array(group_sums(scores, counts)),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_block.cogroup(to(answers, blocks).groupBy("to")).applyInArrow(score, schema)


class Runs:
    """Blocks of a split, named by their first row; where they are cut depends on the rows in their order alone."""

    def __init__(self, most_rows: int, most_bytes: int):
        self.most_rows, self.most_bytes = most_rows, most_bytes
        self.block, self.rows, self.bytes = -1, most_rows, 0

    def of(self, b: pa.RecordBatch) -> np.ndarray:
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
        out = np.zeros(len(b), dtype=np.int64)
        for j, (row, size) in enumerate(zip(b.column("row").to_pylist(), sizes, strict=True)):
            if self.rows >= self.most_rows or self.bytes + size > self.most_bytes:
                self.block, self.rows, self.bytes = row, 0, 0
            self.rows += 1
            self.bytes += size
            out[j] = self.block
        return out


def _blocks(batches: Iterator[pa.RecordBatch], runs: Runs):
    """Whole blocks of rows: (block, ids, held out, texts)."""
    now, held = None, []
    for b in batches:
        blocks = runs.of(b)
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(b)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            if blocks[lo] != now and held:
                yield now, *_joined(held)
                held = []
            now = int(blocks[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, *_joined(held)


def _joined(parts: list[pa.RecordBatch]):
    t = pa.Table.from_batches(parts)
    return t.column("doc_id"), t.column("held_out").to_numpy(), t.column("text").combine_chunks()


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
