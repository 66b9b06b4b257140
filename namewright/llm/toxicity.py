"""Toxicity of texts after noisy-channel deobfuscation.

A word written in leetspeak, spaced out or with letters repeated is taken as noise over a word:
each character may be one of a few letters, nothing (a separator, a repetition, a mark), at a cost;
Viterbi decoding of this lattice under a character trigram model gives the likeliest word.  The
restored text is scored by a logistic regression on words and word beginnings, which is fitted on
texts restored in the same way.

The character model counts every document.  The classifier learns from a bounded sample of labelled
training rows (`PER_CLASS` of each class, those of the least id hash), copies of a text once; its
features are those whose smoothed log odds are `LEAST_Z` standard errors or more from zero to either
side, so their number is bounded by the sample too.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import fresh, give_back, stored, utf8

FOLDS = 5
HELD_OUT = 0
PER_CLASS = 8000
LEAST_Z = 2.0
#: Features that the fit gives less weight than this go, and the rest are fitted again.
LEAST_WEIGHT = 0.05
#: Tokens that a process remembers the features of, and spans it remembers the decoding of.
REMEMBERED = 100_000
PREFIXES = (4, 5, 6)
#: What a character may stand for in leetspeak.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i",
}
COST_LEET, COST_KEEP, COST_DROP, COST_REPEAT, COST_VOWEL = 0.7, 0.0, 2.5, 0.2, 2.0
SIZE = 28  # boundary, a-z, any other letter
EDGE = ".,;:!?\"'()[]{}<>%&#*~`^=/\\…-_|$+"
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+])(?:(?:\s+|[ .\-_*~]{1,2})(?:[^\W_]|[@$!|+])(?![^\W_])){2,}")
DOUBLED = re.compile(r"([^\W\d_])\1")
TRIPLED = re.compile(r"([^\W\d_])\1\1")
REPEATED = re.compile(r"([^\W\d_])\1+")
SUSPECT = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*[0-9@$|+*€£!._\-]\S*[^\W\d_]|\S*[0-9@$!]|\S*[аеорсхі]|\S*([^\W\d_])\1\1)\S+")


def remembered(held: dict, key: str, make: Callable[[str], object]) -> object:
    """make(key), kept in a dictionary of at most REMEMBERED keys."""
    if key not in held:
        if len(held) >= REMEMBERED:
            held.clear()
        held[key] = make(key)
    return held[key]


def char_code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else SIZE - 1 if c.isalpha() else 0


_BYTE_CODE = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else SIZE - 1 if b >= 128 else 0 for b in range(256)], np.int64)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams over all texts, SIZE ** 3 of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE**3, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                raw = utf8(text)
                for i in range(0, len(raw), 1 << 20):
                    code = _BYTE_CODE[np.frombuffer(b" " + raw[max(i - 2, 0) : i + (1 << 20)] + b" ", np.uint8)]
                    keep = np.ones(len(code), bool)
                    keep[1:] = (code[1:] != code[:-1]) | (code[1:] != 0) & (code[1:] != SIZE - 1)
                    code = code[keep]
                    total += np.bincount((code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:], minlength=SIZE**3) if len(code) > 2 else 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE**3, np.int64)
    for r in rows:  # SIZE ** 3 rows at most
        out[r.gram] = r.n
    return out


class Restorer:
    """Decodes noisy spans under a character trigram model."""

    def __init__(self, counts: np.ndarray, lexicon: dict[str, float] | None = None) -> None:
        corpus = self._smooth(counts.astype(float))
        if lexicon:
            own = np.zeros(SIZE**3)
            for word, weight in lexicon.items():
                code = [0, *map(char_code, word), 0]
                for a, b, c in zip(code, code[1:], code[2:], strict=False):
                    own[(a * SIZE + b) * SIZE + c] += weight
            corpus = 0.5 * corpus + 0.5 * self._smooth(own)
        self.logp = np.log(corpus).tolist()
        self.held: dict[str, str] = {}

    def __getstate__(self) -> bytes:
        return np.array(self.logp).tobytes()

    def __setstate__(self, logp: bytes) -> None:
        self.logp = np.frombuffer(logp).tolist()
        self.held = {}

    @staticmethod
    def _smooth(counts: np.ndarray) -> np.ndarray:
        three = counts.reshape(SIZE, SIZE, SIZE)
        two = three.sum(axis=0)
        one = two.sum(axis=0) + 1.0
        back = (two + 20 * one / one.sum()) / (two.sum(axis=1, keepdims=True) + 20)
        return ((three + 5 * back) / (three.sum(axis=2, keepdims=True) + 5)).reshape(-1)

    def _decode(self, span: str) -> str:
        """The likeliest word; span is lower case."""
        logp = self.logp
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        before = ""
        for i, c in enumerate(span):
            options: list[tuple[str, float]] = []
            same = c == before
            if c.isalpha() and c not in LEET:
                options = [("", COST_REPEAT), (c, COST_DROP if i >= 2 and span[i - 2] == c else COST_KEEP)] if same else [(c, COST_KEEP)]
            elif c in LEET:
                options = [(x, COST_LEET) for x in LEET[c]] + [("", COST_REPEAT if same else COST_DROP)]
            elif c == "*":
                options = [("", 0.5)] + [(v, COST_VOWEL) for v in "aeiou"]
            else:
                options = [("", 0.0)]
            before = c
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for letter, cost in options:
                    if letter:
                        k = char_code(letter)
                        # At the start the only history is the boundary.
                        step = logp[(a * SIZE + b) * SIZE + k] if path else logp[k] + 0.0
                        to, value, own = (b, k), score + step - cost, (path, letter)
                    else:
                        to, value, own = (a, b), score - cost, path
                    if to not in new or value > new[to][0]:
                        new[to] = (value, own)
            states = new
        ends = ((score + (logp[(a * SIZE + b) * SIZE] if path else -5.0), path) for (a, b), (score, path) in states.items())
        path = max(ends, key=lambda x: x[0])[1]
        letters = []
        while path:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))

    def decode(self, span: str) -> str:
        return remembered(self.held, span, self._decode) if len(span) <= 64 else self._decode(span)

    def token(self, token: str) -> str:
        core = token.strip(EDGE)
        head = len(token) - len(token.lstrip(EDGE))
        if not core or (core.isalpha() and not re.search(r"(.)\1\1|[аеорсхі]", core)):
            # A mark at either end may stand for a letter, as in $cum.
            if core and (token[:1] in "$@" or token[-1:] in "$@"):
                return self.decode(token)
            return token
        decoded = self.decode(core)
        return token[:head] + decoded + token[head + len(core) :]

    def restore(self, text: str) -> str:
        """The text in lower case with noisy words and spaced-out words restored."""
        low = text.lower()
        low = SPACED.sub(lambda m: self.decode(m[0]), low)
        return SUSPECT.sub(lambda m: self.token(m[0]), low)


def features(word: str) -> Iterator[str]:
    yield word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n] + "~"


def _words(text: str) -> set[str]:
    return {w.strip(EDGE) for w in set(text.split())} - {""}


def _plain(token: str, core: str) -> bool:
    """Nothing in the token can be noise: letters alone, none twice in a row, none that stands for another."""
    return core.isalpha() and not DOUBLED.search(core) and (core.isascii() or LEET.keys().isdisjoint(core)) and token[0] not in "@$" and token[-1] not in "@$"


class Model:
    """Weights of words and word beginnings, and the restorer of noisy words."""

    def __init__(self, weights: dict[str, float], bias: float, restorer: Restorer) -> None:
        self.weights, self.bias, self.restorer = weights, bias, restorer
        self._index()
        self.held: dict[str, tuple[str, ...]] = {}
        self.nothing: set[str] = set()
        self.name = hashlib.sha256(repr((sorted(weights.items()), bias, restorer.logp)).encode()).hexdigest()

    def __getstate__(self) -> tuple:
        return self.name, self.weights, self.bias, self.restorer

    def __setstate__(self, state: tuple) -> None:
        self.name, self.weights, self.bias, self.restorer = state
        self._index()
        # What a reused worker has learnt of this very model; of any other it is forgotten.
        if _REMEMBERED.get("name") != self.name:
            _REMEMBERED.clear()
            _REMEMBERED.update(name=self.name, tokens={}, nothing=set(), spans={})
        self.held, self.nothing, self.restorer.held = (_REMEMBERED[k] for k in ("tokens", "nothing", "spans"))

    def _index(self) -> None:
        """Beginnings of features, and features without repetitions: most words have none of them."""
        self.heads = {f[: PREFIXES[0]] for f in self.weights}
        self.bare = {REPEATED.sub(r"\1", f) for f in self.weights}

    def _known(self, token: str) -> tuple[str, ...]:
        """Features of a token as restored that have a weight."""
        core = token.strip(EDGE)
        if _plain(token, core):
            return tuple([f for f in features(core) if f in self.weights]) if core[: PREFIXES[0]] in self.heads else ()
        return tuple(sorted({f for w in self._restored(token) for f in features(w) if f in self.weights}))

    def _restored(self, token: str) -> set[str]:
        core = token.strip(EDGE)
        if _plain(token, core) or core.isalpha() and core.isascii() and token[0] not in "@$" and token[-1] not in "@$" and not TRIPLED.search(core) and not self._repeats(core):
            return {core}
        words = _words(self.restorer.token(token)) if SUSPECT.fullmatch(token) else {core} - {""}
        return words | {self.restorer.decode(w) for w in words if self._repeats(w)}

    def _repeats(self, word: str) -> bool:
        """A word without a weight whose doubled letters may be repetitions; of letters alone, only if
        some way of dropping them gives a feature, as no other decoding of it does."""
        if not DOUBLED.search(word) or word in self.weights:
            return False
        if not word.isalpha() or not LEET.keys().isdisjoint(word) or len(DOUBLED.findall(word)) > 8:
            return True
        # All ways have the same letters once repetitions are gone, and so have their features.
        bare = REPEATED.sub(r"\1", word)
        if bare not in self.bare and self.bare.isdisjoint(bare[:n] + "~" for n in range(1, PREFIXES[-1] + 1)):
            return False
        ways = {""}
        for i, c in enumerate(word):
            kept = {w + c for w in ways}
            ways = kept | ways if i and word[i - 1] == c else kept
        return any(f in self.weights for w in ways for f in features(w))

    def words(self, text: str) -> set[str]:
        """The words of the text with noisy and spaced-out words restored."""
        return {w for token in self._tokens(text) for w in self._restored(token)}

    def found(self, text: str) -> set[str]:
        """The features with a weight of the text as restored."""
        out: set[str] = set()
        held, nothing, weights, n = self.held, self.nothing, self.weights, PREFIXES[0]
        for t in self._tokens(text) - nothing:
            own = held.get(t)
            if own is None:
                core = t.strip(EDGE)
                if _plain(t, core):
                    own = [f for f in (core, *[core[:k] + "~" for k in PREFIXES if len(core) > k]) if f in weights] if core[:n] in self.heads else ()
                else:
                    own = self._known(t)
                if len(t) <= 64:
                    if not own:
                        nothing.add(t)
                        continue
                    if len(held) >= REMEMBERED:
                        held.clear()
                    held[t] = own
            out.update(own)
        if len(nothing) >= 2 * REMEMBERED:
            nothing.clear()
        return out

    def _tokens(self, text: str) -> set[str]:
        """Different tokens of the text in lower case, and its spaced-out words put together."""
        low = text.lower()
        tokens = set(low.split())
        if sum(1 for t in tokens if len(t) <= 3 and len(t.strip(EDGE)) == 1) > 1:
            tokens |= {self.restorer.decode(m[0]) for m in SPACED.finditer(low)}
        return tokens

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(self.found(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


_REMEMBERED: dict = {}


def fold(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(text, y) of at most per_class rows of each class outside the held-out fold.

    Labels without an id or a class are left out, of several for an id the largest counts; null texts
    are empty; equal texts are one row, toxic if any of them is; empty tables give none."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = known.where(fold(F.col("doc_id")) != HELD_OUT)
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_class rows
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    return rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y")


def _counted(sample: DataFrame, words: Callable[[str], set[str]], sizes: tuple[int, int]) -> DataFrame:
    """(f, clean, toxic, z): in how many rows of each class a feature stands, and how many standard
    errors its smoothed log odds are from zero."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = [Counter(), Counter()]
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                held[int(y)].update({f for w in words(text) for f in features(w)})
            names = list(held[0].keys() | held[1].keys())
            yield pd.DataFrame({"f": names, "clean": [held[0][f] for f in names], "toxic": [held[1][f] for f in names]})
            del held, names
        give_back()

    counts = sample.mapInPandas(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    clean, toxic = F.col("clean") + 0.5, F.col("toxic") + 0.5
    return counts.withColumn("z", (F.log(toxic / (sizes[1] + 1.0)) - F.log(clean / (sizes[0] + 1.0))) / F.sqrt(1 / toxic + 1 / clean))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit the classifier on the sample and the character model on all docs.

    Words that tell toxic rows as written go into the character model; then the sample is restored,
    features are chosen and weights fitted on it.  Null texts are empty; without labelled rows of
    both classes nothing has a weight and the bias is the log odds of what labels there are."""
    sample = stored(training_sample(docs, labels, per_class), "toxicity-sample")
    totals = {int(r.y): r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sizes = totals.get(0, 0), totals.get(1, 0)
    told = _counted(sample, lambda t: _words(t.lower()), sizes).where((F.col("z") >= LEAST_Z) & (F.col("clean") * 20 < F.col("toxic")) & ~F.col("f").endswith("~"))
    lexicon = {r.f: float(r.toxic) for r in told.select("f", "toxic").collect()}  # bounded by the sample
    restorer = Restorer(trigram_counts(docs), lexicon)
    first = Model({f: 0.0 for w in lexicon for f in features(w)}, 0.0, restorer)
    names = sorted(r.f for r in _counted(sample, first.words, sizes).where(F.abs("z") >= LEAST_Z).select("f").collect())
    place = {f: i for i, f in enumerate(names)}
    blank = Model(dict.fromkeys(names, 0.0), 0.0, restorer)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"y": pdf["y"].astype("int64"), "at": [sorted(place[f] for f in blank.found(t)) for t in pdf["text"]]})

    # Numbers of 2 * per_class rows at most.
    told = sample.mapInPandas(lambda it: map(match, it), "y long, at array<int>").toArrow().combine_chunks()
    y, at = told["y"].to_numpy().astype(float), told["at"].chunk(0) if told.num_rows else None
    row = np.repeat(np.arange(len(y)), np.diff(at.offsets.to_numpy())) if len(y) else np.zeros(0, np.int64)
    at = at.flatten().to_numpy().astype(np.int64) if len(y) else np.zeros(0, np.int64)
    keep = np.flatnonzero(np.abs(_fit(row, at, y, len(names))[0]) >= LEAST_WEIGHT)
    new = np.full(len(names), -1)
    new[keep] = np.arange(len(keep))
    held = new[at] >= 0
    weights, bias = _fit(row[held], new[at[held]], y, len(keep))
    model = Model({names[i]: w for i, w in zip(keep, weights.tolist(), strict=True)}, bias, restorer)
    del told, row, at, blank, first, names, place
    give_back()
    return model


def _fit(row: np.ndarray, at: np.ndarray, y: np.ndarray, n: int, ridge: float = 3e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features (row has feature at) by accelerated gradient descent; classes weigh alike, and
    the bias is drawn towards the log odds of the classes, which decide where no feature speaks."""
    odds = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else float(np.log(0.1 / 0.9))
    if not len(y) or y.min() == y.max():
        return np.zeros(n), odds
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w = np.zeros(n + 1)
    v, top = np.ones(n + 1), 1.0
    for _ in range(20):  # the largest curvature, which bounds the step
        seen = weight * (np.bincount(row, weights=v[at], minlength=len(y)) + v[n])
        v = np.r_[np.bincount(at, weights=seen[row], minlength=n), seen.sum()]
        top = float(np.linalg.norm(v))
        v /= top
    ahead, rate = w.copy(), min(2.0, 1 / (0.25 * top + ridge))
    centre = np.r_[np.zeros(n), odds]
    for step in range(steps):
        z = np.bincount(row, weights=ahead[at], minlength=len(y)) + ahead[n]
        left = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        slope = np.r_[np.bincount(at, weights=left[row], minlength=n), left.sum()] + ridge * (ahead - centre)
        new = ahead - rate * slope
        ahead = new + step / (step + 3) * (new - w)
        w = new
    return w[:n], float(w[n])


def _rated(model: Model) -> Callable[[Column], Column]:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score("" if t is None else t) for t in texts], dtype="float64")

    return F.pandas_udf(run, "double")


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on) appended.

    Null texts score as empty ones; repeated rows score alike; an empty table gives none; columns
    named score or predicted are replaced.
    """

    scored = docs.withColumn("score", _rated(model)(F.col(text_col).cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows predicted toxic; columns as they were, whatever their names.

    Null texts are judged as empty ones; repeated rows go or stay together; ids don't matter; an
    empty table gives an empty one."""
    model = learn(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    told = fresh("toxic")
    return docs.withColumn(told, _rated(model)(F.col(text_col).cast("string"))).where(F.col(told) < 0.5).select(docs.columns)
