"""SimHash near-dedup at a Jaccard similarity of word shingles.

Fingerprints of 64 bits can't tell a similarity of 0.8: there two texts differ in about 10 bits, more
than the byte-position index can guarantee.  So here a fingerprint has `POSITIONS` positional bytes,
each the SimHash of a min-wise sample of one shingle: two texts share a byte with a probability of
their similarity (and 1/256 of the rest).  The inverted index is keyed by `ROWS` positions at a time,
`BANDS` keys a text, which finds a pair at 0.8 with a probability of 0.9999 and more similar ones with
more; shared positional bytes of a pair are tallied, pairs below `LEAST` shared (five standard errors
under what 0.8 gives) go, and the rest are verified exactly on their sets of shingles.

Equal texts are one node.  Postings are range-partitioned and sorted by key and 64-bit fingerprint;
each is first compared with the few before it and with its list's hub, the member whose own lists
hold most postings (in a group of copies one that was edited least): linear work, which joins large
groups of copies.
After that only members outside a posting list's largest component are compared with the rest, and of
these only texts of whose shingles enough occur in other texts at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import fresh, mix64, per_batch, stored, utf8
from namewright.llm.components import connected_components
from namewright.llm.simhash import majority, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 6
BANDS = 32
POSITIONS = ROWS * BANDS
LEAST = 126
LAGS = 2
#: One bit of each of the first samples; at 0.8 a tenth of them differ, and MOST_OFF is more than five
#: standard errors over that.
SKETCH, MOST_OFF = 128, 32
#: Characters of texts whose shingles are held at once.
PIECE = 1 << 21
_ODD = mix64(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)
_SALT = mix64(np.arange(1001, 1001 + BANDS, dtype=np.uint64))


def samples(distinct: np.ndarray) -> np.ndarray:
    """For each position, the least product of the shingle hashes with the position's odd number."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(distinct), 4096):
        least = np.minimum(least, (distinct[i : i + 4096, None] * _ODD).min(axis=0))
    return least


def index_row(text: bytes, shingle: int = SHINGLE) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of distinct shingles, 64-bit fingerprint, positional bytes, keys, sketch."""
    hashes = shingle_hashes(text, shingle)
    distinct = np.unique(hashes)
    scrambled = mix64(samples(distinct))
    bands = scrambled.reshape(BANDS, ROWS)
    keys = _SALT.copy()
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, r])
    sketch = np.packbits(scrambled[:SKETCH] >> np.uint64(63) != 0).view(np.int64)
    return len(distinct), majority(hashes), scrambled.astype(np.uint8).view(np.int8), keys.view(np.int64), sketch


def _prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Ids go through as strings, so that they are of any type and null ones stay exact."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, fp, pos, keys, sketch = zip(*(index_row(utf8(t), shingle) for t in pdf["text"]), strict=True)
        fps = np.array(fp, np.uint64).view(np.int64)
        one, two = np.array(sketch).T
        return pd.DataFrame({"id": pdf["id"], "node": pdf["node"], "n": n, "fp": fps, "one": one, "two": two, "pos": [p.tobytes() for p in pos], "keys": list(keys)})

    chosen = docs.select(F.col(id_col).cast("string").alias("id"), _node(F.col(text_col)).alias("node"), F.col(text_col).cast("string").alias("text"))
    made = chosen.mapInPandas(per_batch(run, PIECE), "id string, node long, n long, fp long, one long, two long, pos binary, keys array<long>")
    return made.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def _node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _adjacent(postings: DataFrame) -> DataFrame:
    """Pairs of nodes that stand next to each other in a posting list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = np.zeros((2, 0), np.int64)
        for pdf in batches:
            key, node = (np.concatenate([tail[i], pdf[c].to_numpy(np.int64)]) for i, c in enumerate(("key", "node")))
            found = []
            for lag in range(1, LAGS + 1):
                at = np.flatnonzero(key[lag:] == key[:-lag]) if len(key) > lag else np.zeros(0, np.int64)
                found.append(np.stack([np.minimum(node[at], node[at + lag]), np.maximum(node[at], node[at + lag])]))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            tail = np.stack([key[-LAGS:], node[-LAGS:]])
            yield pd.DataFrame({"u": pairs[0], "v": pairs[1]})

    ordered = postings.select("key", "fp", "node").repartitionByRange("key", "fp", "node").sortWithinPartitions("key", "fp", "node")
    return ordered.mapInPandas(run, "u long, v long").distinct()


def _to_hubs(postings: DataFrame) -> DataFrame:
    """Pairs of each node with the hubs of its posting lists of three and more."""
    sizes = postings.groupBy("key").agg(F.count("*").alias("c")).where("c > 2")
    crowded = stored(postings.join(sizes, "key").select("key", "node", "c"), "similar-crowded")
    score = crowded.groupBy("node").agg(F.sum("c").alias("score"))
    hubs = crowded.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    pairs = crowded.join(hubs, "key").where("node <> hub")
    return pairs.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()


def _tallied(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that share LEAST positional bytes, which are fetched once a pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(-1, POSITIONS) for c in ("a", "b"))
            yield pdf.loc[(a == b).sum(axis=1) >= LEAST, ["u", "v"]]

    u, v = nodes.select(F.col("node").alias("u"), F.col("pos").alias("a")), nodes.select(F.col("node").alias("v"), F.col("pos").alias("b"))
    return pairs.join(u, "u").join(v, "v").select("u", "v", "a", "b").mapInPandas(run, "u long, v long")


def _off(a: str, b: str) -> Column:
    """How many bits of two sketches differ."""
    return sum(F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in (1, 2))


def _sizes_fit(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * (similarity - 1e-9)


def _sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, held): the sets of shingles of the nodes asked for.  A node's text is read from its rows of
    the least id, so that large groups of copies are not gathered."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(utf8(t), shingle)).view(np.int64) for t in pdf["text"]]
        return pd.DataFrame({"node": pdf["node"], "held": sets})

    first = nodes.select(F.col("node").alias("of"), "least").join(asked.select(F.col("node").alias("of")), "of", "left_semi")
    rows = docs.select(_node(F.col(text_col)).alias("node"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = rows.join(first, (F.col("node") == F.col("of")) & F.col("id").eqNullSafe(F.col("least")), "left_semi")
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    return stored(texts.mapInPandas(per_batch(run, PIECE), "node long, held array<long>"), "similar-sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets of shingles have the similarity; exact."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("held").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("held").alias("b")), "v")
    shared, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    return both.where(shared * (1 + similarity) >= total * similarity - 1e-6).select("u", "v")


def _met(sets: DataFrame) -> DataFrame:
    """(node, m): how many of a node's shingles any other of these sets holds, so the most that it
    can share with one of them."""
    alone = sets.select("node", F.explode("held").alias("g")).groupBy("g").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    alone = alone.where("c = 1").groupBy("node").agg(F.count("*").alias("alone"))
    return sets.join(alone, "node", "left").select("node", (F.size("held") - F.coalesce("alone", F.lit(0))).alias("m"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: (id, component_id), the smallest id reachable over pairs of texts whose
    sets of shingles have a Jaccard similarity of at least `similarity` (0.8 or more).

    Null, empty and wordless texts are alike and form one group; repeated rows give repeated rows; a
    null id is kept and names a group only where no other id is there; an empty table gives an empty
    result; other columns are not looked at.
    """
    prints, placed = _grouped(docs, id_col, text_col, shingle, similarity)
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.select("id", "node").join(placed.join(named, "component").select("node", "component_id"), "node").select("id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of similar_documents: that of the smallest id, a null id last; of several
    texts with that id the one of the least hash, of several rows with both the least row.

    Columns are as they were, whatever their names; an empty table gives an empty one."""
    prints, placed = _grouped(docs, id_col, text_col, shingle, similarity)
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("nameless"), "least", "node")).alias("first")).select("first.node", "first.least")
    rows = prints.groupBy("node", "id").agg(F.count("*").alias("rows"))
    same = (rows["node"] == first["node"]) & rows["id"].eqNullSafe(first["least"])
    node, key, many = fresh("node"), fresh("id"), fresh("rows")
    chosen = stored(rows.join(first, same).select(rows["node"].alias(node), F.col("least").alias(key), F.col("rows").alias(many)), "similar-chosen")
    found = docs.join(chosen, (_node(F.col(text_col)) == F.col(node)) & F.col(id_col).eqNullSafe(F.col(key)))
    row, held = F.struct(*docs.columns), fresh("row")
    rest = found.where(F.col(many) > 1).groupBy(node).agg(F.min(row).alias(held)).select(f"{held}.*")
    return found.where(F.col(many) == 1).select(docs.columns).unionByName(rest)


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of rows, and (node, least, component) of texts: their smallest id and group."""
    if similarity < SIMILARITY:
        raise ValueError("the index is built for a similarity of 0.8 or more")
    prints = stored(_prints(docs, id_col, text_col, shingle), "similar-prints")
    own = ["n", "fp", "one", "two", "pos", "keys"]
    nodes = stored(prints.groupBy("node").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in own]), "similar-nodes")
    listed = nodes.select("node", "fp", F.explode("keys").alias("key"))
    near = stored(_adjacent(listed).unionByName(_to_hubs(listed)).distinct(), "similar-adjacent")
    light = nodes.select("node", "n", "one", "two")
    tried = near.join(light.toDF("u", "nu", "u1", "u2"), "u").join(light.toDF("v", "nv", "v1", "v2"), "v")
    tried = tried.where(_sizes_fit("nu", "nv", similarity) & (_off("u", "v") <= MOST_OFF)).select("u", "v")
    tried = stored(_tallied(tried, nodes), "similar-tried")
    asked = tried.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = _verified(tried, _sets(asked, nodes, docs, id_col, text_col, shingle), similarity)
    first = connected_components(links, "similar-first").withColumnRenamed("component", "comp")
    known = stored(nodes.drop("pos").join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "similar-known")
    postings = known.select("node", "comp", F.explode("keys").alias("key"))
    sizes = postings.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top")).where("comps > 1").select("key", F.col("top.comp").alias("top"))
    members = stored(postings.join(mixed, "key"), "similar-members")
    sets = _sets(members.select("node").distinct(), nodes, docs, id_col, text_col, shingle)
    # A text can't be similar to another one if too few of its shingles occur in any other.
    able = known.select("node", "n", "one", "two").join(_met(sets), "node").where(F.col("m") >= F.col("n") * similarity - 1e-6)
    held = stored(members.join(able, "node"), "similar-mixed")
    few, rest = (held.select("key", *[F.col(c).alias(a) for c, a in zip(("node", "comp", "n", "m", "one", "two"), (s, f"c{s}", f"n{s}", f"m{s}", f"{s}1", f"{s}2"), strict=True)], "top") for s in "xy")
    enough = F.least("mx", "my") * (1 + similarity) >= (F.col("nx") + F.col("ny")) * similarity - 1e-6
    close = (F.col("cx") != F.col("cy")) & enough & _sizes_fit("nx", "ny", similarity) & (_off("x", "y") <= MOST_OFF)
    apart = few.where("cx <> top").drop("top").join(rest.drop("top"), "key").where(close)
    untried = apart.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct().join(tried, ["u", "v"], "left_anti")
    late = _verified(stored(_tallied(untried, nodes), "similar-untried"), sets, similarity)
    of = known.select("node", "comp")
    over = late.join(of.toDF("u", "cu"), "u").join(of.toDF("v", "cv"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    last = connected_components(over, "similar-last").withColumnRenamed("node", "comp")
    placed = stored(known.select("node", "comp", "least").join(last, "comp", "left").select("node", "least", F.coalesce("component", "comp").alias("component")), "similar-placed")
    return prints, placed
