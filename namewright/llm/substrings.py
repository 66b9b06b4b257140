"""Exact repeats of long byte strings removed across a corpus, by suffix arrays.

Which shard must compare what: every 100-byte window has an anchor, the least-hashed of the k-grams
inside it, so equal windows have equal anchors and meet under the anchor's hash.  Consecutive windows
whose anchors have one hash are a segment with their bytes (so a run of one byte, or of a short period,
is one segment, cut only at `RUN` windows).  Segments whose anchor occurs once in the
corpus can repeat nothing and stay where they are.  The others are dealt by ranges of (anchor, row),
which split a very frequent anchor over many tasks, and cut into shards of bounded size.

In a shard equal segments are one; the rest get a suffix array by Larsson-Sadakane refinement, with
common prefixes by Kasai's inheritance (all segments of the shard step together; it needs suffixes in
their whole order, so refinement goes on to the longest segment), and neighbours that share 100 bytes
are one string.  Strings of an anchor that reaches over the end of a shard are merged across shards, in
the order of the suffixes themselves: each is placed by binary search among splitters of that order,
and equal ones meet, byte for byte.
The first occurrence stays, by (document, start); all others cut the bytes they cover.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import give_back, mix64, stored, utf8

LENGTH = 100
GRAM = 52
SHARD_BYTES = 4 << 20
CHUNK = 4 << 20
RUN = 1 << 16
SALTS = 16
NO_ID = (1 << 63) - 1
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Polynomial hashes of all k consecutive bytes, by doubling."""
    power, held, out, done, width = base, _BYTES[raw], None, 0, 1
    while width <= k:
        if k & width:
            if out is None:
                out = held
            else:  # what is done stands in front
                n = len(raw) - done - width + 1
                out = out[:n] * np.uint64(power) + held[done : done + n]
            done += width
        if 2 * width <= k:
            held = held[:-width] * np.uint64(power) + held[width:]
        power = power * power % (1 << 64)
        width *= 2
    return mix64(out[: len(raw) - k + 1])


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, count): runs of at most RUN consecutive windows whose anchors have one hash."""
    return runs(raw, length, gram)[:3]


def runs(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchors, and whether a run's anchors stand at more than one place: then it may repeat itself."""
    found = []
    for at in range(0, len(raw) - length + 1, CHUNK):
        part = raw[at : at + CHUNK + length - 1]
        h = gram_hashes(part, gram)
        low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        need, width = length - gram + 1, 1
        while 2 * width <= need:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < need:
            low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
        where = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        least = h[where]
        start = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        count = np.diff(np.r_[start, len(least)])
        parts = -(-count // RUN)
        run = np.repeat(np.arange(len(start)), parts)
        skip = (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
        found.append((least[start[run]], start[run] + skip + at, np.minimum(count[run] - skip, RUN), (where[start + count - 1] != where[start])[run]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffix_array(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, told apart to `depth` bytes at least.

    ends[i] is where the string of position i ends; an end sorts before any byte.  Larsson-Sadakane:
    a group's number is its place in the array, so groups that are settled are never touched again.
    """
    n = len(text)
    key, at = np.zeros(n, np.int64), np.arange(n)
    for t in range(7):
        there = at + t < ends
        key = key * 257 + np.where(there, text[np.minimum(at + t, n - 1)].astype(np.int64) + 1, 0)
    order = np.argsort(key, kind="stable")
    first = np.r_[True, key[order][1:] != key[order][:-1]]
    rank = np.zeros(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, at, 0))
    width = 7
    while width < depth:
        alone = first & np.r_[first[1:], True]
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            break
        p = order[open_at]
        after = np.where(p + width < ends[p], rank[np.minimum(p + width, n - 1)] + 1, 0)
        both = rank[p] * (n + 1) + after
        by = np.argsort(both, kind="stable")
        p, both = p[by], both[by]
        order[open_at] = p
        new = np.r_[True, both[1:] != both[:-1]]
        first[open_at] = new
        rank[p] = np.maximum.accumulate(np.where(new, open_at, 0))
        width *= 2
    return order


def common_prefixes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix (at most `most`) of each suffix in order with the one before.

    Kasai: a suffix shares at least one byte less than the suffix one byte longer did.  Strings step
    together, one offset at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    share = np.zeros(n, np.int64)
    begin = np.unique(starts)
    held = np.zeros(len(begin), np.int64)
    size = ends[begin] - begin
    for o in range(int(size.max()) if n else 0):
        live = np.flatnonzero(size > o)
        p = begin[live] + o
        q = before[p]
        l = np.maximum(held[live] - 1, 0)
        l[q < 0] = 0
        go = np.flatnonzero((q >= 0) & (l < most))
        while len(go):
            a, b = p[go] + l[go], q[go] + l[go]
            inside = (a < ends[p[go]]) & (b < ends[q[go]])
            same = inside & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
            go = go[same]
            l[go] += 1
            go = go[l[go] < most]
        held[live] = l
        share[p] = l
    return share[order]


def _shard(rows: list[tuple], open_anchors: set[int], length: int) -> tuple[list[tuple], list[tuple]]:
    """rows (h, key, rid, start, count, bytes) in order; a negative count marks a run that may repeat itself -> cuts (rid, a, b) and first strings
    (rid, key, start, string) of anchors that may reach over the shard's ends."""
    cuts, keep = [], []
    i = 0
    while i < len(rows):
        j, seen, many = i, {}, False
        while j < len(rows) and rows[j][0] == rows[i][0]:
            h, key, rid, start, count, raw = rows[j]
            if (first := seen.setdefault(raw, rows[j])) is not rows[j]:
                if (key, start) > (first[1], first[3]):
                    cuts.append((rid, start, start + abs(count) - 1 + length))
            many |= count < 0
            j += 1
        if len(seen) > 1 or many or rows[i][0] in open_anchors:
            keep += seen.values()
        i = j
    if not keep:
        return cuts, []
    sizes = np.array([len(r[5]) for r in keep], np.int64)
    stop = np.cumsum(sizes)
    joined = b"".join(r[5] for r in keep)
    text = np.frombuffer(joined, np.uint8)
    which = np.repeat(np.arange(len(keep)), sizes)
    ends, starts = stop[which], (stop - sizes)[which]
    order = suffix_array(text, ends, int(sizes.max()))
    share = common_prefixes(text, starts, ends, order, length)
    group = np.cumsum(share < length)
    whole = ends[order] - order >= length
    at, group = order[whole], group[whole]
    own = which[at]
    key = np.array([r[1] for r in keep], np.int64)[own]
    start = np.array([r[3] for r in keep], np.int64)[own] + at - starts[at]
    by = np.lexsort((start, key, group))
    at, group, own, key, start = at[by], group[by], own[by], key[by], start[by]
    head = np.r_[True, group[1:] != group[:-1]]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
    later = (key != key[lead]) | (start != start[lead])
    cut = np.lexsort((start[later], own[later]))
    o, s = own[later][cut], start[later][cut]
    edge = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)]) if len(o) else np.zeros(0, np.int64)
    last = np.r_[edge[1:] - 1, len(o) - 1] if len(o) else edge
    cuts += [(keep[o[a]][2], int(s[a]), int(s[b]) + length) for a, b in zip(edge.tolist(), last.tolist(), strict=True)]
    reach = np.array([r[0] in open_anchors for r in keep])[own] & ~later
    if not reach.any():
        return cuts, []
    rid = np.array([r[2] for r in keep], np.int64)[own[reach]]
    strings = [joined[i : i + length] for i in at[reach].tolist()]
    return cuts, list(zip(rid.tolist(), key[reach].tolist(), start[reach].tolist(), strings, strict=True))


def _find_anchors(length: int):
    def frame(held: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("h", "rid", "start", "n"), map(np.concatenate, zip(*held, strict=True)), strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, size = [], 0
            for rid, text in zip(pdf["rid"], pdf["text"], strict=True):
                raw = utf8(text)
                if len(raw) >= length:
                    h, start, count, many = runs(np.frombuffer(raw, np.uint8), length)
                    # A run that may repeat itself has its count negative.
                    held.append((h.view(np.int64), np.full(len(h), rid, np.int64), start, np.where(many, -count, count)))
                    size += len(h)
                if size > 200_000:
                    yield frame(held)
                    held, size = [], 0
            if held:
                yield frame(held)
        give_back()

    return run


def _repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order of h those whose h a neighbour has or that may repeat themselves, and the first and
    last of the partition, whose neighbours may be elsewhere."""
    held, told, opening = None, False, True
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        h = pdf["h"].to_numpy()
        same = np.r_[False, h[1:] == h[:-1]]
        keep = same | np.r_[same[1:], False] | (pdf["n"].to_numpy() < 0)
        if held is not None and told:
            keep[0] = True
        elif opening and len(keep):
            keep[0] = True
        opening = False
        # The last row waits for its neighbour.
        held, told = pdf.iloc[-1:], bool(keep[-1])
        yield pdf[keep & (np.arange(len(h)) < len(h) - 1)].copy()
    if held is not None:
        yield held
    give_back()


def _cut_out(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], 0
            for rid, key, text, wanted in zip(pdf["rid"], pdf["key"], pdf["text"], pdf["wanted"], strict=True):
                raw = utf8(text)
                for w in wanted:
                    a, n = w["start"], w["n"]
                    out.append((w["h"], key, rid, a, n, raw[a : a + abs(n) - 1 + length]))
                    size += abs(n) + length
                if size > 8 << 20:
                    yield pd.DataFrame(out, columns=["h", "key", "rid", "start", "n", "raw"])
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=["h", "key", "rid", "start", "n", "raw"])

    return run


def _shards(length: int, shard_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in batches:
            for row in zip(pdf["h"], pdf["key"], pdf["rid"], pdf["start"], pdf["n"], pdf["raw"], strict=True):
                rows.append(row)
                size += len(row[5])
                if size >= shard_bytes:
                    yield _told(rows, length)
                    rows, size = [], 0
        if rows:
            yield _told(rows, length)
        give_back()

    return run


def _told(rows: list[tuple], length: int) -> pd.DataFrame:
    cuts, firsts = _shard(rows, {rows[0][0], rows[-1][0]}, length)
    out = [(rid, 0, a, b, None) for rid, a, b in cuts] + [(rid, key, a, a + length, x) for rid, key, a, x in firsts]
    return pd.DataFrame(out, columns=["rid", "key", "a", "b", "string"])


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings in order, then by key and start: all but the first of equal ones."""
    last = None
    for pdf in batches:
        rows = pdf if last is None else pd.concat([last, pdf], ignore_index=True)
        string, key, a = rows["string"].to_numpy(), rows["key"].to_numpy(np.int64), rows["a"].to_numpy(np.int64)
        head = np.r_[True, string[1:] != string[:-1]].astype(bool)
        lead = np.maximum.accumulate(np.where(head, np.arange(len(string)), 0))
        later = (key != key[lead]) | (a != a[lead])
        last = rows.iloc[lead[-1] : lead[-1] + 1]
        yield pdf[later[len(later) - len(pdf) :]][["rid", "a", "b"]]


def _freed(spark) -> None:
    """Let Spark drop the shuffle files of steps that are written down."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for text, cuts in zip(pdf["text"], pdf["cuts"], strict=True):
        raw, kept, spans, removed, at = utf8(text), hashlib.sha256(), 0, 0, 0
        for a, b in merged(cuts):
            kept.update(raw[at:a])
            spans, removed, at = spans + 1, removed + b - a, b
        kept.update(raw[at:])
        out.append((removed, spans, kept.hexdigest()))
    removed, spans, digest = zip(*out, strict=True) if out else ((), (), ())
    return pd.DataFrame({"id": pdf["id"], "n_bytes": pdf["n_bytes"], "n_removed": removed, "n_spans": spans, "kept_sha256": digest})


def merged(cuts) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((c["a"], c["b"]) for c in cuts) if cuts is not None else ():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _with_first(thin: DataFrame) -> DataFrame:
    """thin with the first key of rows of its sha.  Groups of copies are joined under salts, so that a
    large one is dealt over tasks; texts that are alone take no part in the join."""
    groups = thin.groupBy("sha").agg(F.min("key").alias("_first"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("sha", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = thin.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(groups, ["sha", "salt"], "left")
    return salted.withColumn("first", F.coalesce("_first", "key")).drop("salt", "_first")


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, thin, cuts): rows (id, key, rid, text) of docs, the same as (id, key, rid, n_bytes, sha)
    stored, and byte ranges (rid, a, b) to remove from rows that are the first of their text.  Later copies of a whole text have no cuts: all of
    them goes if it is long enough."""
    if length <= GRAM:
        raise ValueError(f"strings must be longer than {GRAM} bytes")
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), text.alias("text"))
    sha, mark = F.sha2(F.col("text").cast("binary"), 256), F.xxhash64("key", "text")
    thin = stored(rows.select("id", "key", mark.alias("mark"), F.octet_length("text").cast("long").alias("n_bytes"), sha.alias("sha")), "substring-rows")
    # Rows are told apart by their ids; only where ids repeat (or are null) by a hash of id and text.
    own = thin.groupBy("key").count().where("count > 1").isEmpty()
    rows = rows.withColumn("rid", F.col("key") if own else mark)
    thin = thin.withColumn("rid", F.col("key" if own else "mark")).drop("mark")
    copies = stored(_with_first(thin).where("key <> first").select("rid").distinct(), "substring-copies")
    found = rows.select("rid", "text").mapInPandas(_find_anchors(length), "h long, rid long, start long, n long")
    ordered = found.repartitionByRange("h", "rid").sortWithinPartitions("h", "rid")
    again = stored(ordered.mapInPandas(_repeated, "h long, rid long, start long, n long").join(copies, "rid", "left_anti"), "substring-anchors")
    _freed(spark)
    wanted = again.groupBy("rid").agg(F.collect_set(F.struct("h", "start", "n")).alias("wanted"))
    held = rows.select("key", "rid", "text").join(wanted.hint("shuffle_hash"), "rid")
    cut = stored(held.mapInPandas(_cut_out(length), "h long, key long, rid long, start long, n long, raw binary"), "substring-segments")
    _freed(spark)
    dealt = cut.repartitionByRange("h", "key", "start").sortWithinPartitions("h", "key", "start")
    told = stored(dealt.mapInPandas(_shards(length, shard_bytes), "rid long, key long, a long, b long, string binary"), "substring-told")
    _freed(spark)
    strings = told.where("string is not null").repartitionByRange("string").sortWithinPartitions("string", "key", "a")
    across = strings.mapInPandas(_merge, "rid long, a long, b long")
    return rows, thin, told.where("string is null").select("rid", "a", "b").unionByName(across)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row: id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller id, or
    in the same at an earlier start.  Null texts are empty; null ids come after all others and are one
    document; rows that repeat id and text do not count as earlier than each other; an empty table
    gives none.
    """
    rows, thin, cuts = removed_spans(docs, id_col, text_col, length, shard_bytes)
    by_row = stored(cuts.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("cuts")), "substring-cuts")
    _freed(docs.sparkSession)
    n_bytes = F.octet_length("text").cast("long")
    hit = rows.join(by_row.hint("shuffle_hash"), "rid", "inner").select(F.col("id").cast("string").alias("id"), n_bytes.alias("n_bytes"), "text", "cuts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(_finish, batches)

    done = hit.mapInPandas(run, "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    done = done.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
    rest = _with_first(thin).join(by_row, "rid", "left_anti")
    gone = (F.col("key") > F.col("first")) & (F.col("n_bytes") >= length)
    rest = rest.select(
        "id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"), F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    return done.unionByName(rest).withColumnRenamed("id", id_col)
