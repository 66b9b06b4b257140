"""A hierarchical Pitman-Yor bigram model over the corpus, and scores of texts under it.

Restaurants.  The context of a token is the word before it (or the start of a text), known by its
64-bit hash; each has a restaurant of its own, and all of them have the unigram restaurant as parent,
whose base is uniform over the V training words and one class for all others.

Seating is kept as numbers of tables for each (context, word) and each word and sampled by Gibbs: a
number of tables given all others has weights of generalized Stirling numbers, of opening that many
tables, and of the parent's probability.  Words are dealt to shards by hash, so all restaurants'
tables of a word and its seating in the parent are in one place; shards share only the restaurants'
totals, which are summed after each epoch: each shard sends its part for every context it holds or is
asked for to the owner of a range of contexts, and gets the sums of just those back (see `_shared`), so
no one place holds all contexts.  A shard's seating after an epoch goes with the totals into the shared folder, packed, and the next epoch
goes on from there; draws have fixed seeds, so a shard that is lost is sampled again alike.
After the last epoch each shard sweeps `SAMPLES` times more, the totals of every one of these seatings
are summed in one more exchange, and predictive probabilities are averaged over them: each is taken
with the totals of its own seating, so over all words (and the class of others) they sum to one.

Texts never move.  Each block of texts asks the shards for its distinct (word, context) pairs with
their training counts; the same table makes the counts and, after sampling, carries the answers back.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import give_back, hash_words, scratch, stored, utf8

FOLDS, HELD_OUT = 7, 2
#: The least stride of the codes of pairs (word * stride + context); no bound on contexts.
CONTEXTS = 4096
BLOCK_TOKENS = 2_000_000
SPLIT_TOKENS = 200_000
EPOCHS, SAMPLES = 2, 3
STRENGTH = 1.0
STIRLING_ROWS = 1024
#: The saddle point serves where the series of log_stirling would cancel more than twice this many e-folds.
SADDLE_FROM = 4.0
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0)
COUNTS = "r int, words binary, degree binary, context binary, n binary, keys binary"
REQUEST = "r int, b string, words binary, degree binary, context binary, n binary, keys binary"


def packed(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).reshape(-1).view(kind)


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, packed in as few bytes each as the largest needs."""
    most = int(x.max()) if len(x) else 0
    return packed(x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)))


def widened(raw: bytes, count: int) -> np.ndarray:
    """`count` whole numbers packed at any width."""
    size = len(zstandard.ZstdDecompressor().decompress(raw)) // max(count, 1)
    return unpacked(raw, np.dtype(f"u{size or 1}")).astype(np.int64)


def packed_keys(x: np.ndarray) -> bytes:
    """Ascending hashes, as their differences."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


def stride(contexts: int) -> int:
    return max(CONTEXTS, contexts)


# --- tokens --------------------------------------------------------------------------------------


def is_held_out(doc_id: str | None) -> bool:
    return zlib.crc32((doc_id or "").encode()) % FOLDS == HELD_OUT


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts, each closed by END, and the number of tokens of each."""
    words = [t.lower().split() for t in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    out = np.full(int(sizes.sum()), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = hash_words([x for w in words for x in w])
    return out, sizes


def contexts_of(hashes: np.ndarray, sizes: np.ndarray, word: np.ndarray | None = None) -> np.ndarray:
    """The context of each token: 0 at the start of a text, else 1 + the place of the word before it
    among the distinct words of all these texts, ascending (word: each token's own place there)."""
    if word is None:
        word = np.unique(hashes, return_inverse=True)[1]
    ctx = np.zeros(len(hashes), np.int64)
    ctx[1:] = word[:-1] + 1
    ctx[(np.cumsum(sizes) - sizes)] = 0
    return ctx


@dataclass
class Block:
    """Some consecutive texts: their ids and tokens, and the distinct pairs of those."""

    name: str
    ids: list
    sizes: np.ndarray
    words: np.ndarray  # distinct, ascending
    degree: np.ndarray  # contexts of each word
    context: np.ndarray  # of each pair, by word and context: 0 or 1 + a place in words
    pair: np.ndarray  # of each token
    word: np.ndarray  # of each token


def _block(name: str, ids: list, hashes: list[np.ndarray], sizes: list[np.ndarray]) -> Block:
    h, size = np.concatenate(hashes), np.concatenate(sizes)
    hashes.clear()
    words, word = np.unique(h, return_inverse=True)
    by = stride(len(words) + 1)
    codes, pair = np.unique(word * by + contexts_of(h, size, word), return_inverse=True)
    return Block(name, ids, size, words, np.bincount(codes // by, minlength=len(words)), codes % by, pair, word)


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[Block]:
    """Cut the rows of a split into blocks; the cuts depend on the rows alone, not on batches."""
    now, seq, ids, hashes, sizes, total = None, 0, [], [], [], 0
    wait_ids: list = []
    wait: list[bytes] = []
    size = 0

    def settle() -> None:
        nonlocal wait_ids, wait, size, total
        if wait:
            h, s = tokens_of(wait)
            hashes.append(h)
            sizes.append(s)
            ids.extend(wait_ids)
            total += len(h)
            wait_ids, wait, size = [], [], 0

    for pdf in batches:
        for split, doc_id, text in zip(pdf["split"], pdf["id"], pdf["text"], strict=True):
            if split != now or total >= BLOCK_TOKENS:
                settle()
                if ids:
                    yield _block(hashlib.md5(f"{now}#{seq}".encode()).hexdigest(), ids, hashes, sizes)
                seq = 0 if split != now else seq + 1
                now, ids, hashes, sizes, total = split, [], [], [], 0
            raw = utf8(text)
            wait_ids.append(doc_id)
            wait.append(raw)
            size += len(raw)
            if size >= SPLIT_TOKENS * 6:
                settle()
    settle()
    if ids:
        yield _block(hashlib.md5(f"{now}#{seq}".encode()).hexdigest(), ids, hashes, sizes)


def _cuts(words: np.ndarray, degree: np.ndarray, shards: int) -> Iterator[tuple[int, slice, slice]]:
    """(shard, its words, its pairs): shards are equal ranges of the hash."""
    edge = np.searchsorted(words, (np.arange(1, shards, dtype=np.uint64) * np.uint64((1 << 64) // shards)))
    edge = [0, *edge.tolist(), len(words)]
    total = np.r_[0, np.cumsum(degree)]
    for r in range(shards):
        if edge[r] < edge[r + 1]:
            yield r, slice(edge[r], edge[r + 1]), slice(int(total[edge[r]]), int(total[edge[r + 1]]))


def _requests(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks(batches):
            known = np.repeat([not is_held_out(i) for i in b.ids], b.sizes)
            n = np.bincount(b.pair[known], minlength=len(b.context))
            hashes = np.r_[START, b.words]
            rows = []
            for r, w, p in _cuts(b.words, b.degree, shards):
                own, context = np.unique(b.context[p], return_inverse=True)
                rows.append((r, b.name, packed_keys(b.words[w]), narrow(b.degree[w]), narrow(context), narrow(n[p]), packed_keys(hashes[own])))
            yield pd.DataFrame(rows, columns=["r", "b", "words", "degree", "context", "n", "keys"])
            del b, known, n, hashes, rows
            give_back()

    return run


# --- shards --------------------------------------------------------------------------------------


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The training counts of a shard: pairs with a count, by word and context, and the contexts (also
    those that are only asked for)."""
    words = [unpacked_keys(x) for x in pdf["words"]]
    every = np.unique(np.concatenate(words))
    keys = np.unique(np.concatenate([unpacked_keys(x) for x in pdf["keys"]]))
    by = stride(len(keys))
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for w, d, c, n, k in zip(words, pdf["degree"], pdf["context"], pdf["n"], pdf["keys"], strict=True):
        d = widened(d, len(w))
        pairs = int(d.sum())
        n = widened(n, pairs)
        code = np.repeat(np.searchsorted(every, w), d) * by + np.searchsorted(keys, unpacked_keys(k))[widened(c, pairs)]
        held.append((code[n > 0], n[n > 0]))
        size += len(code)
        if size > 4_000_000:
            codes, counts, held, size = *_summed(codes, counts, held), [], 0
    codes, counts = _summed(codes, counts, held)
    own, degree = np.unique(codes // by, return_counts=True)
    row = (pdf["r"].iloc[0], every[own].tobytes(), narrow(degree), narrow(codes % by), narrow(counts), packed_keys(keys))
    return pd.DataFrame([row], columns=["r", "words", "degree", "context", "n", "keys"])


def _summed(codes: np.ndarray, counts: np.ndarray, held: list) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate([codes, *[x[0] for x in held]])
    n = np.concatenate([counts, *[x[1] for x in held]])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


@dataclass
class Totals:
    """What shards share: customers and tables of a shard's contexts, customers and tables of the root."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: float
    root_tables: float


@dataclass
class Prior:
    """Discounts by counts of counts, the vocabulary and the training tokens."""

    d1: float
    d0: float
    vocabulary: int
    tokens: int

    @property
    def base(self) -> float:
        return 1.0 / (self.vocabulary + 1)


@functools.lru_cache(4)
def stirling(d: float, rows: int = STIRLING_ROWS) -> np.ndarray:
    """log S_d(n, t) for t <= n < rows: S(n+1, t) = S(n, t-1) + (n - t d) S(n, t)."""
    columns = rows - 1
    out = np.full((rows, columns + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(columns + 1)
    for n in range(1, rows - 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            grow = np.where(n > t * d, np.log(np.maximum(n - t * d, 1e-300)), -np.inf) + out[n]
        out[n + 1] = np.logaddexp(grow, np.r_[-np.inf, out[n, :-1]])
    return out


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Of positive numbers: Stirling's series after a shift by 8."""
    z = np.asarray(z, float)
    y = z + 8
    tail = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / y**2) / y**2) / y**2) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + tail - np.log(functools.reduce(np.multiply, [z + i for i in range(8)]))


def log_stirling(d: float, n: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log S_d(n, t) for 1 <= t <= n and large n, up to a factor that hangs on n alone.

    S_d(n, t) is n!/t! times the coefficient of x^n in ((1 - (1 - x)^d) / d)^t.  While t is small against
    n^d its expansion around x = 1, a finite sum, is summed; else the coefficient is taken from the
    saddle point with its second-order term.
    """
    n, t = np.asarray(n, float), np.asarray(t, float)
    out = np.zeros(len(n))
    near = (1 - d) / d * np.exp((np.log(d) + np.log(t) - d * np.log(n)) / (1 - d)) <= SADDLE_FROM
    i = np.flatnonzero(near)
    if len(i):
        a, b = n[i], t[i]
        first = np.log(b) + log_gamma(a - d) - log_gamma(a)
        total, live, j = np.zeros(len(i)), np.arange(len(i)), 1
        ways, scale = np.zeros(len(i)), first + log_gamma(a)
        while len(live):
            x, y = a[live], b[live]
            ways[live] += np.log((y - j + 1) / j)
            size = ways[live] + log_gamma(x - j * d) + log_gamma(np.array(1 + j * d)) - scale[live]
            total[live] += np.exp(size) * np.sin(np.pi * j * d) * (1 if j % 2 else -1) / np.pi
            # Terms fall from about SADDLE_FROM / (1 - d) on; what is left then is below rounding.
            past = (size < -60) & (j > 2 * SADDLE_FROM / (1 - d)) if j > 2 else np.zeros(len(live), bool)
            j += 1
            live = live[~past & (y >= j)]
        out[i] = np.log(np.maximum(total, 1e-300)) + first - log_gamma(b + 1) - b * np.log(d) + log_gamma(a)
    i = np.flatnonzero(~near & (t < n))
    if len(i):
        a, b = n[i], t[i]
        low, high = np.full(len(i), -300.0), np.zeros(len(i))
        start = np.log(b * d / a)
        for _ in range(14):
            v = (low + high) / 2
            over = start + np.log(np.expm1(v) / np.expm1(d * v)) + (d - 1) * v > 0
            low, high = np.where(over, v, low), np.where(over, high, v)
        v = (low + high) / 2
        for _ in range(6):
            up, all_up = np.expm1(v), np.expm1(d * v)
            slope = (up + 1) / up - d * (all_up + 1) / all_up + d - 1
            v = np.clip(v - (start + np.log(up / all_up) + (d - 1) * v) / slope, low, np.minimum(high, -1e-12))
        x, r = -np.expm1(v), np.exp(v)
        m, c = a / b, (1 - d) * x / r
        q = 1 + c - m
        q1 = c / r - m * q
        q2 = c * (1 + x) / r**2 - m * q * q - m * q1
        k2, k3, k4 = a * q, a * (q * q + q1), a * (q**3 + 3 * q * q1 + q2)
        more = 1 + k4 / (8 * k2**2) - 5 * k3**2 / (24 * k2**3)
        out[i] = log_gamma(a + 1) - log_gamma(b + 1) - b * np.log(d) + b * np.log(-np.expm1(d * v)) - a * np.log(x) - 0.5 * np.log(2 * np.pi * k2) + np.log(np.maximum(more, 0.5))
    return out


def _draw_many(rng: np.random.Generator, count: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float) -> np.ndarray:
    """draw_tables for counts beyond the table: the weights are log-concave, so the mode is found by
    bisection and numbers are drawn from all around it that have a weight in double precision."""
    strength = STRENGTH / d + others

    def weight(i: np.ndarray, t: np.ndarray) -> np.ndarray:
        return log_stirling(d, count[i], t) + log_gamma(strength[i] + t) - log_gamma(strength[i]) + t * np.log(d * parent[i])

    def last(drop: float, sign: int) -> np.ndarray:
        """The largest t where the weight still rises (sign 0), or the edge of its support to one side."""
        low, high = (np.ones(len(count), np.int64), mode.copy()) if sign < 0 else (mode.copy(), count.copy())
        while (low < high).any():
            t = (low + high + (sign > 0)) // 2
            inside = weight(every, t) > top - drop
            low, high = (np.where(inside, t, low), np.where(inside, high, t - 1)) if sign > 0 else (np.where(inside, low, t + 1), np.where(inside, t, high))
            high = np.maximum(low, high)
        return low

    every = np.arange(len(count))
    low, high = np.ones(len(count), np.int64), count.astype(np.int64)
    while (low < high).any():
        t = (low + high) // 2
        rises = weight(every, np.minimum(t + 1, count)) > weight(every, t)
        low, high = np.where(rises & (low < high), t + 1, low), np.where(rises, high, t)
        low = np.minimum(low, high)
    mode = low
    top = weight(every, mode)
    first, end = last(40.0, -1), last(40.0, 1)
    out = np.ones(len(count), np.int64)
    sizes = end - first + 1
    for some in np.split(every, np.flatnonzero(np.diff(np.cumsum(sizes) // 500_000)) + 1):
        own = np.repeat(some, sizes[some])
        start = np.cumsum(sizes[some]) - sizes[some]
        t = np.arange(len(own)) - np.repeat(start, sizes[some]) + first[own]
        level = np.cumsum(np.exp(weight(own, t) - top[own]))
        base = np.r_[0.0, level][start]
        pick = base + rng.random(len(some)) * (level[start + sizes[some] - 1] - base)
        at = np.clip(np.searchsorted(level, pick, side="right"), start, start + sizes[some] - 1)
        out[some] = t[at]
    return out


def draw_tables(rng: np.random.Generator, table: np.ndarray, count: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float) -> np.ndarray:
    """Numbers of tables (at least 1) of restaurants with `count` customers of a dish.

    others: tables of the restaurant's other dishes; parent: the parent's probability of the dish.
    Counts within the table are drawn from its row, larger ones by _draw_many; no number is ruled out.
    """
    out = np.ones(len(count), np.int64)
    todo = np.flatnonzero((count > 1) & (count < len(table)))
    width = count[todo]
    for low, high in ((2, 2), (3, 3), (4, 6), (7, 15), (16, 63), (64, 255), (256, len(table) - 1)):
        rows = todo[(width >= low) & (width <= high)]
        step = max(1, (1 << 22) // max(high, 64))
        for i in range(0, len(rows), step):
            at = rows[i : i + step]
            t = np.arange(1, high + 1)
            opened = np.cumsum(np.log(STRENGTH + d * (others[at][:, None] + t - 1.0)), axis=1)
            weight = table[count[at], 1 : high + 1] + opened + t * np.log(parent[at])[:, None]
            weight = np.exp(weight - weight.max(axis=1, keepdims=True))
            level = np.cumsum(weight, axis=1)
            out[at] = 1 + (level < rng.random(len(at))[:, None] * level[:, -1:]).sum(axis=1)
    many = np.flatnonzero(count >= len(table))
    if len(many):
        out[many] = _draw_many(rng, count[many], others[many].astype(float), parent[many], d)
    return out


class Shard:
    """A shard's words, sampled from fixed seeds under given totals."""

    def __init__(self, row, prior: Prior) -> None:
        self.r, self.prior = int(row.r), prior
        self.words = np.frombuffer(row.words, np.uint64)
        self.word = np.repeat(np.arange(len(self.words)), widened(row.degree, len(self.words)))
        self.context = widened(row.context, len(self.word))
        self.count = widened(row.n, len(self.word))
        self.tables = np.ones(len(self.count), np.int64)
        self.seats = self._seats()
        self.root = np.ones(len(self.words), np.int64)
        self.stirling = (stirling(prior.d1), stirling(prior.d0))
        self.sweeps = 0

    def _seats(self) -> np.ndarray:
        return np.bincount(self.word, weights=self.tables, minlength=len(self.words)).astype(np.int64)

    def parent(self, totals: Totals, seats: np.ndarray, root: np.ndarray) -> np.ndarray:
        """The root's probability of words."""
        p = self.prior
        rest = (STRENGTH + p.d0 * totals.root_tables) * p.base
        return (np.maximum(seats - p.d0 * root, 0) + rest) / (STRENGTH + totals.root_customers)

    def sweep(self, totals: Totals) -> None:
        rng = np.random.default_rng([self.r, self.sweeps])
        self.sweeps += 1
        p = self.prior
        before = self.tables
        others = np.maximum(totals.tables[self.context] - before, 0)
        parent = self.parent(totals, self.seats, self.root)
        self.tables = draw_tables(rng, self.stirling[0], self.count, others, parent[self.word], p.d1)
        self.seats = self._seats()
        others = np.maximum(totals.root_tables - self.root, 0)
        self.root = draw_tables(rng, self.stirling[1], self.seats, others, np.full(len(self.words), p.base), p.d0)

    def seat(self, tables: np.ndarray, root: np.ndarray, sweeps: int) -> None:
        """Take the seating that a number of sweeps has led to."""
        self.tables, self.root, self.sweeps = tables, root, sweeps
        self.seats = self._seats()


def _answers(shard: Shard, keys: np.ndarray, samples: list[tuple[np.ndarray, np.ndarray, Totals]], requests: pd.DataFrame) -> Iterator[tuple]:
    """For each request the log10 of the averaged probability of its pairs, and its words' counts.

    samples: seatings (tables, those of the root) with their totals."""
    p = shard.prior
    seatings = []
    for tables, root, own in samples:
        shard.seat(tables, root, 0)
        unseen = (STRENGTH + p.d0 * own.root_tables) * p.base / (STRENGTH + own.root_customers)
        seatings.append((np.maximum(shard.count - p.d1 * shard.tables, 0), shard.parent(own, shard.seats, shard.root), unseen, STRENGTH + p.d1 * own.tables))
    by = stride(len(keys))
    codes = shard.word * by + shard.context
    total = np.bincount(shard.word, weights=shard.count, minlength=len(shard.words)).astype(np.int64)
    under = STRENGTH + samples[0][2].customers
    for b, words, degree, context, names in zip(requests["b"], requests["words"], requests["degree"], requests["context"], requests["keys"], strict=True):
        words = unpacked_keys(words)
        at, there = _find(shard.words, words)
        own = np.repeat(np.arange(len(words)), widened(degree, len(words)))
        ctx = np.searchsorted(keys, unpacked_keys(names))[widened(context, len(own))]
        place, seen = _find(codes, np.where(there, at, -1)[own] * by + ctx)
        value = np.zeros(len(own))
        for held, parent, unseen, top in seatings:
            value += np.where(seen, held[place] if len(held) else 0.0, 0.0) + top[ctx] * np.where(there, parent[at] if len(parent) else 0.0, unseen)[own]
        value /= len(seatings) * under[ctx]
        yield b, shard.r, packed(np.log10(value).astype(np.float32)), packed(np.where(there, total[at] if len(total) else 0, 0).astype(np.uint64))


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


# --- training and scoring ------------------------------------------------------------------------


FIGURES = ["one", "two", "alone", "paired", "words", "tokens", *(f"root_{x}{i}" for x in ("tables", "customers") for i in range(SAMPLES))]
TABLES, ROOT = -2, -3
SENT = "k int, r int, keys binary, sums int, x binary"
TOLD = "r int, k int, size long, sums int, x binary"


def _messages(r: int, keys: np.ndarray, x: list[np.ndarray], shards: int, figures: dict[str, float], seating: list[tuple[np.ndarray, np.ndarray]] = []) -> pd.DataFrame:  # noqa: B006
    """A shard's parts of sums over its contexts to the owners k of ranges of contexts, its figures to
    owner -1, and its seatings to owners below that, which hand them back."""
    edge = np.searchsorted(keys, np.arange(1, shards, dtype=np.uint64) * np.uint64((1 << 64) // shards))
    edge = [0, *edge.tolist(), len(keys)]
    rows = [(-1, r, b"", 0, packed(np.array([figures.get(f, 0.0) for f in FIGURES])))]
    for i, parts in enumerate(zip(*seating, strict=True)):
        rows.append((TABLES - 2 * r - i, r, b"", len(seating), narrow(np.concatenate(parts))))
    for k in range(shards):
        at = slice(edge[k], edge[k + 1])
        if at.start < at.stop:
            rows.append((k, r, packed_keys(keys[at]), len(x), narrow(np.concatenate([v[at] for v in x]))))
    return pd.DataFrame(rows, columns=["k", "r", "keys", "sums", "x"])


def _owner(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums over shards, told to each in the order it sent its contexts."""
    k = pdf["k"].iloc[0]
    if k == -1:
        return pd.DataFrame([(-1, -1, 0, 0, packed(np.sum([unpacked(x, float) for x in pdf["x"]], axis=0)))], columns=["r", "k", "size", "sums", "x"])
    if k <= TABLES:
        return pd.DataFrame({"r": pdf["r"], "k": ROOT if (TABLES - k) % 2 else TABLES, "size": 0, "sums": pdf["sums"], "x": pdf["x"]})
    keys = [unpacked_keys(x) for x in pdf["keys"]]
    sizes = [len(x) for x in keys]
    place = np.unique(np.concatenate(keys), return_inverse=True)[1]
    sums = int(pdf["sums"].iloc[0])
    parts = np.concatenate([widened(x, sums * n).reshape(sums, n) for x, n in zip(pdf["x"], sizes, strict=True)], axis=1)
    whole = np.stack([np.bincount(place, weights=v)[place].astype(np.int64) for v in parts])
    told = [narrow(x.reshape(-1)) for x in np.split(whole, np.cumsum(sizes)[:-1], axis=1)]
    return pd.DataFrame({"r": pdf["r"], "k": k, "size": sizes, "sums": sums, "x": told})


def _shared(sent: DataFrame, shards: int) -> tuple[str, dict[str, float]]:
    """The folder of the sums for each shard, and the summed figures."""
    spark = sent.sparkSession
    path = scratch(spark, "lm-totals")
    told = sent.groupBy("k").applyInPandas(_owner, TOLD)
    told.repartition(shards, "r").write.option("compression", "uncompressed").partitionBy("r").parquet(path)
    row = spark.read.schema(TOLD).parquet(path).where("r = -1").first()
    return path, dict(zip(FIGURES, unpacked(row.x, float).tolist() if row else [0.0] * len(FIGURES), strict=True))


@dataclass
class Epoch:
    """Where the sums that an exchange told are, and customers and tables of the root for each seating."""

    path: str
    root: list[tuple[float, float]]


def _told(row, epoch: Epoch) -> pd.DataFrame:
    store, root = fs.FileSystem.from_uri(epoch.path)
    return pq.read_table(f"{root}/r={row.r}", filesystem=store, partitioning=None).to_pandas().sort_values("k")


def _sums(got: pd.DataFrame) -> np.ndarray:
    """What a shard was told: a row of sums over its contexts for each that it sent."""
    got = got[got["k"] >= 0]
    return np.concatenate([widened(x, n * m).reshape(m, n) for x, n, m in zip(got["x"], got["size"], got["sums"], strict=True)], axis=1).astype(float)


def _customers(row, history: list[Epoch]) -> np.ndarray:
    return _sums(_told(row, history[0]))[0]


def _seatings(row, shard: Shard, customers: np.ndarray, epoch: Epoch) -> list[tuple[np.ndarray, np.ndarray, Totals]]:
    """A shard's seatings after an epoch, each with its totals."""
    got = _told(row, epoch)
    tables, root = (np.concatenate([widened(x, n * m).reshape(m, n) for x, m in zip(got["x"][got["k"] == k], got["sums"][got["k"] == k], strict=True)]) for k, n in ((TABLES, len(shard.count)), (ROOT, len(shard.words))))
    return [(t, r, Totals(customers, sums, *own)) for t, r, sums, own in zip(tables, root, _sums(got), epoch.root, strict=True)]


def _start(row, shard: Shard, history: list[Epoch]) -> Totals:
    """Seat a shard as the last epoch left it and give that epoch's totals."""
    if len(history) == 1:
        first = _sums(_told(row, history[0]))
        return Totals(first[0], first[1], *history[0].root[0])
    tables, root, totals = _seatings(row, shard, _customers(row, history), history[-1])[-1]
    shard.seat(tables, root, len(history) - 1)
    return totals


def _held(path: str, r: int) -> pd.DataFrame | None:
    """The requests to a shard, from the shared folder."""
    store, root = fs.FileSystem.from_uri(path)
    if store.get_file_info(f"{root}/r={r}").type == fs.FileType.NotFound:
        return None
    return pq.read_table(f"{root}/r={r}", filesystem=store, partitioning=None).to_pandas().assign(r=r)


def train(counts: DataFrame, shards: int) -> tuple[Prior, list[Epoch], Epoch]:
    """counts: a row for each shard (r, words, degree, context, n, keys) -> the prior, the totals that
    each epoch of sweeps started from, and those of the sampled seatings."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                keys, degree = unpacked_keys(row.keys), widened(row.degree, len(row.words) // 8)
                ctx = widened(row.context, int(degree.sum()))
                c = widened(row.n, len(ctx))
                x, y = np.bincount(ctx, weights=c, minlength=len(keys)).astype(np.int64), np.bincount(ctx, minlength=len(keys))
                seen = dict(one=(c == 1).sum(), two=(c == 2).sum(), alone=(degree == 1).sum(), paired=(degree == 2).sum(), words=len(degree), tokens=c.sum(), root_customers0=len(c))
                yield _messages(row.r, keys, [x, y], shards, seen)

    def discount(one: float, two: float) -> float:
        return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5

    path, f = _shared(counts.mapInPandas(tell, SENT), shards)
    prior = Prior(discount(f["one"], f["two"]), discount(f["alone"], f["paired"]), int(f["words"]), int(f["tokens"]))
    history = [Epoch(path, [(f["root_customers0"], f["words"])])]

    def after(sweeps: int) -> Epoch:
        """Go on from the last epoch's seating under its totals and share what comes out."""

        def run(batches: Iterator[pd.DataFrame], history: list[Epoch] = history[:]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    shard, keys = Shard(row, prior), unpacked_keys(row.keys)
                    totals = _start(row, shard, history)
                    tables, seating, told = [], [], {}
                    for i in range(sweeps):
                        shard.sweep(totals)
                        tables.append(np.bincount(shard.context, weights=shard.tables, minlength=len(keys)).astype(np.int64))
                        seating.append((shard.tables, shard.root))
                        told |= {f"root_tables{i}": shard.root.sum(), f"root_customers{i}": shard.seats.sum()}
                    yield _messages(row.r, keys, tables, shards, told, seating)
                    del shard, keys, totals, tables, seating
                    give_back()

        path, f = _shared(counts.mapInPandas(run, SENT), shards)
        return Epoch(path, [(f[f"root_customers{i}"], f[f"root_tables{i}"]) for i in range(sweeps)])

    for _ in range(EPOCHS):
        history.append(after(1))
    return prior, history, after(SAMPLES)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows outside the held-out fold and scores all.  Null texts have the end token
    alone; a null id folds like an empty one; repeated rows are each learnt from and scored; without
    training rows every token has the base probability; an empty table gives none.
    """
    spark = docs.sparkSession
    file = F.input_file_name()
    split = F.concat_ws("|", file, F.input_file_block_start().cast("string"), F.when(file == "", F.spark_partition_id().cast("string")))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), split.alias("split"))
    parts = rows.rdd.getNumPartitions()
    shards = 1 << max(2, (parts - 1).bit_length())
    asked = scratch(spark, "lm-requests")
    rows.mapInPandas(_requests(shards), REQUEST).repartition(shards, "r").write.option("compression", "uncompressed").partitionBy("r").parquet(asked)
    _freed(spark)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf["id"]:
                mine = _held(asked, r)
                if mine is not None:
                    yield _merge(mine)
                    del mine
                    give_back()

    counts = stored(spark.range(0, shards, 1, shards).mapInPandas(merge, COUNTS), "lm-counts")
    prior, history, samples = train(counts, shards)
    _freed(spark)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                shard = Shard(row, prior)
                found = _answers(shard, unpacked_keys(row.keys), _seatings(row, shard, _customers(row, history), samples), _held(asked, row.r))
                yield pd.DataFrame(found, columns=["b", "r", "logp", "count"])
                del shard, found
                give_back()

    told = counts.mapInPandas(answer, "b string, r int, logp binary, count binary")
    path = scratch(spark, "lm-answers")
    told.repartition(shards, "b").write.option("compression", "uncompressed").partitionBy("b").parquet(path)
    _freed(spark)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path)
        for b in blocks(batches):
            got = pq.read_table(f"{root}/b={b.name}", filesystem=store, partitioning=None).sort_by("r")
            logp = np.concatenate([unpacked(x, np.float32) for x in got["logp"].to_pylist()]).astype(float)
            count = np.concatenate([unpacked(x, np.uint64) for x in got["count"].to_pylist()]).astype(np.int64)
            if len(logp) != len(b.context) or len(count) != len(b.words):
                raise RuntimeError("the splits of the documents changed between two reads")
            first = np.cumsum(b.sizes) - b.sizes
            base = np.log10((count + 1) / (prior.tokens + prior.vocabulary + 1))
            total = lambda x: np.add.reduceat(x, first)
            out = pd.DataFrame({
                "id": b.ids, "held_out": [is_held_out(i) for i in b.ids], "n_tokens": b.sizes, "n_known": total((count > 0).astype(np.int64)[b.word]),
                "train_tokens": prior.tokens, "base_score": total(base[b.word]), "score": total(logp[b.pair]),
            })
            del b, got, logp, count, base, total
            give_back()
            yield out

    schema = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInPandas(score, schema).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity a token under the model and under the base, of the held-out and the training rows."""
    n = F.sum("n_tokens")
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum("score") / n).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / n).alias("base_perplexity"), n.alias("n_tokens"))


def _freed(spark) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()
