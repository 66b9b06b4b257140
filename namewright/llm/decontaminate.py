"""Benchmark decontamination by winnowing.

Texts become words; every `K` consecutive words give a k-gram hash and of every window of
`WINDOW - K + 1` consecutive k-grams the least is kept.  Two texts that share `WINDOW` consecutive
words keep the same k-gram there, so a join of kept hashes misses no shared span.  Hits are extended
word by word on their diagonal, and spans of at least a window count.  Items shorter than a window
are matched whole, through hashes of all runs of their length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import fresh, hash_words, mix64, per_batch, rolling, stored, utf8

WINDOW = 13
K = 5
#: Characters of texts that are in words at once.
PIECE = 1 << 21
_SEPARATE = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SEPARATE).split()


def winnow(hashes: np.ndarray, k: int = K, window: int = WINDOW) -> np.ndarray:
    """Positions of the kept k-grams of a text's word hashes: the least of each window, the first of equals."""
    grams = rolling(hashes, k)
    w = window - k + 1
    if len(grams) < w:
        return np.zeros(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(grams, w).argmin(axis=1) + np.arange(len(grams) - w + 1)
    return np.unique(at)


def _marks(hashes: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Fingerprints of a text: kept k-grams, and all runs of the lengths of short items."""
    out = [rolling(hashes, K)[winnow(hashes)]]
    out += [mix64(rolling(hashes, n) ^ np.uint64(n)) for n in lengths]
    return np.unique(np.concatenate(out))


def _fingerprints(rows: DataFrame, lengths: list[int], whole: bool) -> DataFrame:
    """rows(id, rid, text) -> (id, rid, h, n_words).  whole: of an item under a window only its full
    length.  Of each row a first line tells n_words; its h is the row's own rid, so that no value
    is shared by many lines.  n_words is null on the lines of fingerprints."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [words_of(utf8(t)) for t in pdf["text"]]
        sizes = np.array([len(w) for w in words], np.int64)
        flat = hash_words([x for w in words for x in w])
        ends = np.cumsum(sizes)
        marks = []
        for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
            own = flat[end - n : end]
            marks.append(_marks(own, [n] if whole and 0 < n < WINDOW else [] if whole else [x for x in lengths if x <= n]) if n else own)
        count = np.array([len(m) + 1 for m in marks], np.int64)
        rid = np.repeat(pdf["rid"].to_numpy(np.int64), count)
        first = np.cumsum(count) - count
        h, n_words = rid.copy(), np.full(len(rid), -1, np.int64)
        n_words[first] = sizes
        h[n_words < 0] = np.concatenate([*marks, np.zeros(0, np.uint64)]).view(np.int64)
        told = pd.arrays.IntegerArray(n_words, n_words < 0)
        return pd.DataFrame({"id": pdf["id"].repeat(count).to_numpy(), "rid": rid, "h": h, "n_words": told})

    return rows.mapInPandas(per_batch(run, PIECE), "id string, rid long, h long, n_words long")


def spans(doc: list[bytes], items: list[tuple[str, list[bytes]]]) -> tuple[np.ndarray, list[str]]:
    """Which words of doc lie in an occurrence of an item's window, and the ids of items with one."""
    ids: dict[bytes, int] = {}
    d = np.array([ids.setdefault(w, len(ids)) for w in doc], np.int64)
    delta = np.zeros(len(d) + 1, np.int64)
    found = []
    kept = winnow(d.astype(np.uint64))
    grams = rolling(d.astype(np.uint64), K)
    for name, item in items:
        e = np.array([ids.setdefault(w, len(ids)) for w in item], np.int64)
        need = min(WINDOW, len(e))
        if not need or len(d) < need:
            continue
        if len(e) < WINDOW:
            run = rolling(d.astype(np.uint64), need)
            starts = np.flatnonzero(run == rolling(e.astype(np.uint64), need)[0])
            hits = [(p, p + need) for p in starts.tolist() if (d[p : p + need] == e).all()]
        else:
            hits = _extended(d, e, kept, grams, need)
        for a, b in hits:
            delta[a] += 1
            delta[b] -= 1
        if hits:
            found.append(name)
    return np.cumsum(delta)[:-1] > 0, found


def _extended(d: np.ndarray, e: np.ndarray, kept: np.ndarray, grams: np.ndarray, need: int) -> list[tuple[int, int]]:
    item_at = winnow(e.astype(np.uint64))
    item_grams = rolling(e.astype(np.uint64), K)
    where: dict[int, list[int]] = {}
    for q in item_at.tolist():
        where.setdefault(int(item_grams[q]), []).append(q)
    reach: dict[int, int] = {}
    hits = []
    own = kept[np.isin(grams[kept], item_grams[item_at])]
    for p in own.tolist():
        for q in where.get(int(grams[p]), ()):
            if p < reach.get(p - q, -1):
                continue
            left = min(p, q)
            back = d[p - left : p][::-1] != e[q - left : q][::-1]
            a = int(back.argmax()) if back.any() else left
            right = min(len(d) - p, len(e) - q)
            on = d[p : p + right] != e[q : q + right]
            b = int(on.argmax()) if on.any() else right
            reach[p - q] = p + max(b, 1)
            if a + b >= need:
                hits.append((p - a, p + b))
    return hits


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for text, items in zip(pdf["text"], pdf["items"], strict=True):
        hit, found = spans(words_of(utf8(text)), [(i["item_id"], words_of(utf8(i["text"]))) for i in items])
        names = sorted(set(found))
        out.append((int(hit.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
    n_hit, n_items, digest = zip(*out, strict=True) if out else ((), (), ())
    return pd.DataFrame({"rid": pdf["rid"], "id": pdf["id"], "n_hit": n_hit, "n_items": n_items, "items_sha256": digest})


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id column, rid, n_words, n_hit, n_items, items_sha256, contaminated).

    Null texts have no words; items without words match nothing; rows of one item id are one item;
    a null item id is the item 'null'; repeated documents are all judged; ids may be null; an empty
    benchmark or table of documents is allowed.  rid is a hash of id and text.
    """
    rid = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), rid.alias("rid"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    marks = stored(_fingerprints(items.select(F.col("item_id").alias("id"), F.lit(0).cast("long").alias("rid"), "text"), [], True), "benchmark-marks")
    # At most WINDOW - 1 numbers whatever the benchmark holds.
    lengths = [r[0] for r in marks.where(f"n_words > 0 and n_words < {WINDOW}").select("n_words").distinct().collect()]
    marks = marks.where("n_words is null").select(F.col("id").alias("item_id"), F.col("h").alias("mark"))
    seen = _fingerprints(rows, sorted(lengths), False)
    met = seen.join(marks, F.col("n_words").isNull() & (F.col("h") == F.col("mark")), "left").where("n_words is not null or item_id is not null")
    met = stored(met.select("rid", "id", "n_words", "item_id"), "contamination-met")
    pairs = met.where("item_id is not null").select("rid", "id", "item_id").distinct()
    named = pairs.join(items, "item_id").groupBy("rid", "id").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    named = stored(named, "contamination-pairs")
    chosen = rows.join(named.withColumnsRenamed({"rid": "_r", "id": "_i"}).hint("shuffle_hash"), (F.col("rid") == F.col("_r")) & F.col("id").eqNullSafe(F.col("_i")))
    judged = chosen.select("id", "rid", "text", "items").mapInPandas(per_batch(_verify, PIECE), "rid long, id string, n_hit long, n_items long, items_sha256 string").distinct()
    judged = judged.withColumnsRenamed({"rid": "_r", "id": "_i"})
    base = met.where("n_words is not null").select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "rid", "n_words")
    full = base.join(judged, (F.col("rid") == F.col("_r")) & F.col(id_col).cast("string").eqNullSafe(F.col("_i")), "left")
    none = hashlib.sha256(b"").hexdigest()
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return full.select(
        id_col, "rid", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"), ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones; columns as they were, whatever their names.

    Null texts have no words and stay; repeated rows go or stay together; ids may be null; an empty
    benchmark removes nothing; an empty table gives an empty one."""
    row = fresh("rid")
    bad = contamination(docs, benchmark, id_col, text_col).where("contaminated").select(F.col("rid").alias(row)).distinct()
    return docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text_col))).join(bad.hint("shuffle_hash"), row, "left_anti").drop(row)
