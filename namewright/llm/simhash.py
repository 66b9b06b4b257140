"""SimHash near-duplicate detection.

Fingerprints are compared through an inverted index on byte positions.  Two 64-bit fingerprints
that differ in at most `max_bits` <= 4 bits share at least 8 - max_bits positional bytes.  Single
bytes would give 2,048 posting lists whose pairs grow as N^2 / 256, so postings are keyed by three
positional bytes at a time: 20 triples of positions are enough for every choice of four shared
positions to contain one of them (`byte_triples`).  A candidate pair's shared positional bytes are
tallied, pairs below the guaranteed minimum go, and the rest are verified bit by bit.

A group of near copies would meet in quadratically many pairs.  Equal fingerprints are one node;
postings are range-partitioned and sorted, and each posting is compared with the few before it
(linear, no group is ever gathered), which already joins such groups.  What is left is exact:
within a posting list only members outside its largest component are compared with the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import per_batch, stored, utf8
from namewright.llm.components import connected_components

SHINGLE = 4
MAX_BITS = 4
LAGS = 8
#: Characters of texts whose shingles are held at once.
PIECE = 1 << 22


def byte_triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 byte positions such that any 4 positions contain one: positions fall into
    three classes; a triple lies within a class or has two in a class and one in the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        g = sorted(group[i] for i in t)
        if g[0] == g[2] or any(g.count(a) == 2 and g.count((a + 1) % 3) == 1 for a in range(3)):
            out.append(t)
    return out


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included; fewer words give one hash, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    every = hashes.view(np.uint8).reshape(-1, 8)
    for i in range(0, len(every), 1 << 16):
        counts += np.unpackbits(every[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for every row; null and wordless texts have fp 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.array([fingerprint(utf8(t), shingle) for t in pdf["text"]], np.uint64).view(np.int64)
        return pd.DataFrame({"id": pdf["id"], "fp": fps})

    # Ids go through as strings: of any type, and exact beside null ones.
    chosen = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInPandas(per_batch(run, PIECE), "id string, fp long").withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def _close(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter on shared positional bytes, then verification of the bits."""
    diff = x ^ y
    shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = shared >= 8 - max_bits
    ok[ok] = np.bitwise_count(diff[ok].view(np.uint64)) <= max_bits
    return ok


def _postings(nodes: DataFrame) -> DataFrame:
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = [F.lit(n << 24).cast("long") + byte[a] * 65536 + byte[b] * 256 + byte[c] for n, (a, b, c) in enumerate(byte_triples())]
    return nodes.select("*", F.explode(F.array(*keys)).alias("key"))


def _neighbours(postings: DataFrame, max_bits: int) -> DataFrame:
    """Links between postings that stand near each other in (key, fp) order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = np.zeros((2, 0), np.int64)
        for pdf in batches:
            key = np.concatenate([tail[0], pdf["key"].to_numpy(np.int64)])
            fp = np.concatenate([tail[1], pdf["fp"].to_numpy(np.int64)])
            found = []
            for lag in range(1, LAGS + 1):
                at = np.flatnonzero(key[lag:] == key[:-lag]) if len(key) > lag else np.zeros(0, np.int64)
                a, b = fp[at], fp[at + lag]
                ok = _close(a, b, max_bits)
                found.append(np.stack([a[ok], b[ok]]))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            tail = np.stack([key[-LAGS:], fp[-LAGS:]])
            yield pd.DataFrame({"u": pairs[0], "v": pairs[1]})

    ordered = postings.select("key", "fp").repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")
    return ordered.mapInPandas(run, "u long, v long").distinct()


def link_fingerprints(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """nodes(fp distinct) -> (fp, component): connected by links of at most max_bits bits."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the byte-position index guarantees links of at most 4 bits")
    first = connected_components(_neighbours(_postings(nodes), max_bits), "simhash-near")
    known = stored(
        nodes.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("comp")),
        "simhash-known",
    )
    postings = _postings(known)
    sizes = postings.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("top")).where("comps > 1")
    mixed = stored(mixed.select("key", F.col("top.comp").alias("top")), "simhash-mixed-keys")
    # Spark takes exploded rows to be no more than the rows they come from, and would broadcast 20 postings
    # a node through the driver: these joins are always shuffled, and split where a key is hot.
    held = stored(postings.hint("merge").join(mixed, "key"), "simhash-mixed")
    few = held.where("comp <> top").select("key", F.col("fp").alias("x"), F.col("comp").alias("a"))
    rest = held.select("key", F.col("fp").alias("y"), F.col("comp").alias("b"))
    diff = F.col("x").bitwiseXOR(F.col("y"))
    shared = sum((F.shiftrightunsigned(diff, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8))
    linked = few.hint("merge").join(rest, (few.key == rest.key) & (F.col("a") != F.col("b")) & (F.bit_count(diff) <= max_bits) & (shared >= 8 - max_bits))
    links = linked.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    joined = connected_components(links, "simhash-rest")
    return known.join(joined.withColumnRenamed("node", "comp"), "comp", "left").select("fp", F.coalesce("component", "comp").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: (id, fingerprint, component_id).

    component_id is the smallest id reachable over links of at most max_bits differing bits.  Null
    and wordless texts have fingerprint zero and link like any other; repeated rows give repeated
    rows; a null id is kept and never names a component unless no other id is there; an empty table
    gives an empty result; other columns are not looked at.
    """
    own = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    nodes = own.groupBy("fp").agg(F.min("id").alias("least"))
    component = link_fingerprints(own.select("fp").distinct(), max_bits)
    placed = stored(nodes.join(component, "fp"), "simhash-placed")
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = placed.join(named, "component").select("fp", "component_id")
    return own.join(ids, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
