"""SimHash, line dedup, decontamination and shards against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import pandas as pd
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from namewright.llm import decontaminate, linededup, sharding, simhash
from namewright.llm.common import pieces
from namewright.llm.components import connected_components


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, bits):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= bits:
            parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(d, f"{fp:016x}", min([x for x in least[find(i)] if x is not None], default=None)) for i, (d, fp) in enumerate(rows)]


def key(rows):
    return sorted(rows, key=repr)


def test_triples_cover_any_four_positions():
    triples = [set(t) for t in simhash.byte_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_simhash_equals_brute_force(spark, documents, awkward):
    for docs in (documents, awkward):
        rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
        assert key(map(tuple, simhash.near_duplicates(docs).collect())) == key(slow_components(rows, 4))
    assert simhash.near_duplicates(documents.limit(0)).count() == 0


def test_simhash_sends_no_postings_through_the_driver(spark):
    """20 postings a node, which Spark's estimate of exploded rows does not see, are not broadcast."""
    rng = random.Random(5)
    fps = [rng.getrandbits(63) for _ in range(8000)]
    spark.conf.set("spark.sql.maxBroadcastTableSize", str(4 << 20))
    try:
        got = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"))
        assert sorted(map(tuple, got.collect())) == sorted((f, f) for f in fps)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_simhash_chain_and_stragglers(spark):
    """A group whose members differ in few bits, and values four bits off that sorting keeps apart."""
    fps = [0, 0b1111, 0b11110000, 0xF << 60, (0xF << 60) | (0xF << 30), 0x5555_5555_5555_5555]
    fps += [0x0123_4567_89AB_CDEF ^ (1 << i) ^ (1 << (63 - i)) for i in range(32)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"))
    groups = defaultdict(set)
    for fp, comp in got.collect():
        groups[comp].add(fp % (1 << 64))
    slow = defaultdict(set)
    for d, _, c in slow_components(list(enumerate(fps)), 4):
        slow[c].add(fps[d])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (7, 7), (102, 100), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100}


def slow_contamination(text, items):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = words_of(text), set(), set()
    for name, t in items:
        item = words_of(t)
        n = min(13, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if windows and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(name) if name is not None else "null")
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


def check_contamination(docs, bench):
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    want = [(r.doc_id, *slow_contamination(r.text, items)) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in decontaminate.contamination(docs, bench).drop("rid").collect()]
    assert key(got) == key(want)
    return got


def test_decontamination_equals_brute_force(spark, documents, sf_dir, awkward):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert any(r[-1] for r in check_contamination(documents, bench))
    odd = spark.createDataFrame([(1, "three four FIVE"), (1, "no id here"), (2, None), (3, ""), (None, "tail"), (4, "lorem ipsum dolor " * 9)], "item_id long, text string")
    check_contamination(awkward, odd)
    check_contamination(documents.limit(0), odd)
    check_contamination(awkward, odd.limit(0))


def test_decontaminated_drops_only_contaminated(spark, documents, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.contamination(documents, bench).where("contaminated").collect()}
    left = decontaminate.decontaminated(documents, bench)
    assert left.columns == documents.columns
    assert {r.doc_id for r in left.select("doc_id").collect()} == {r.doc_id for r in documents.select("doc_id").collect()} - bad


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=80), st.lists(st.sampled_from("abc"), max_size=40))
def test_spans_on_repetitive_words(doc, item):
    hit, found = decontaminate.spans([w.encode() for w in doc], [("x", [w.encode() for w in item])])
    want = slow_contamination(" ".join(doc), [("x", " ".join(item))])
    assert (int(hit.sum()), len(found)) == want[1:3]


def slow_lines(rows, sites=10, chars=1):
    on, first = defaultdict(set), {}
    for d, t, s in rows:
        for line in (t.split("\n") if t is not None else []):
            line = line.strip(" ")
            on[line].add(s)
            if d is not None:
                first[line] = min(d, first.get(line, d))
    out = []
    for d, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if len(x.strip(" ")) < chars or len(on[x.strip(" ")] - {None}) < sites or d is not None and first[x.strip(" ")] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept) if t is not None else None))
    return out


def test_line_dedup_equals_brute_force(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for d, sites in ((docs, 10), (awkward, 2), (docs.limit(0), 10)):
        rows = [tuple(r) for r in d.select("doc_id", "text", "source").collect()]
        got = linededup.strip_boilerplate(d, min_sites=sites).select("doc_id", "n_lines", "n_removed", "text").collect()
        assert key(map(tuple, got)) == key(slow_lines(rows, sites))
    left = linededup.strip_boilerplate(awkward.withColumnsRenamed({"lang": "_rid", "n_chars": "h", "id": "cut"}), min_sites=2)
    assert left.columns == ["doc_id", "text", "_rid", "source", "h", "cut", "n_lines", "n_removed"]
    assert any(x[2] for x in slow_lines([tuple(r) for r in docs.select("doc_id", "text", "source").collect()]))


def test_shards(spark, documents, awkward):
    for docs in (documents, awkward, documents.limit(0)):
        rows = sharding.shard_documents(docs).collect()
        assert len(rows) == docs.count()
        texts = defaultdict(set)
        for r in docs.collect():
            texts[r.doc_id].add((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())))
        slots = defaultdict(list)
        for r in rows:
            assert (r.size, r.text_crc32) in texts[r.doc_id]
            assert r.grown_shard in (r.shard, 8) and r.law == "key"
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_near_weights(spark):
    from pyspark.sql import functions as F

    ids = spark.range(40_000)
    tree = sharding.balanced_tree(8)
    heavy = (*tree[:1], sharding.Node("region4", children=tuple(sharding.Node(n.name, children=tuple(sharding.Node(x.name, x.shard, 3.0) for x in n.children)) for n in tree[1].children)))
    got = ids.select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), heavy).alias("b"), sharding.place(F.col("id"), sharding.grown(tree, 8)).alias("c"))
    rows = got.collect()
    for s in range(8):
        assert abs(sum(r.a == s for r in rows) - 5000) < 400
        assert abs(sum(r.b == s for r in rows) - (2500 if s < 4 else 7500)) < 500
    # Movement is confined: within the heavier region nothing moves, and nothing leaves it.
    assert all(r.b == r.a for r in rows if r.a >= 4) and all(r.b == r.a or r.b >= 4 for r in rows)
    assert abs(sum(r.c == 8 for r in rows) - 40_000 / 9) < 400


def test_pieces_keep_every_row_in_order():
    pdf = pd.DataFrame({"text": ["a" * 5, None, "", "b" * 30, "c", None, "d" * 4], "rid": range(7)})
    assert [p["rid"].tolist() for p in pieces(pdf, 8)] == [[0, 1, 2, 3], [4, 5, 6]]
    assert [p["rid"].tolist() for p in pieces(pdf, 1 << 20)] == [list(range(7))]
    assert [p["rid"].tolist() for p in pieces(pdf.assign(text=None), 8)] == [list(range(7))]


def plain_shard(doc_id, tree):
    """The tree by hand: at each level the child with the largest ln(u) / weight."""
    import math

    node = tree
    while True:
        if len(node) > 1:
            def draw(child):
                raw = f"{'null' if doc_id is None else doc_id}:{child.name}".encode()
                return math.log((int(hashlib.md5(raw).hexdigest()[:13], 16) + 0.5) / 16**13) / child.weight

            best = max(node, key=draw)
        else:
            best = node[0]
        if best.shard is not None:
            return best.shard
        node = best.children


def test_shards_equal_a_plain_descent(spark, documents, awkward):
    tree = sharding.balanced_tree(8)
    for docs in (documents, awkward.withColumnRenamed("id", "shard"), awkward.withColumn("doc_id", awkward.text)):
        for r in sharding.shard_documents(docs).collect():
            assert r.shard == plain_shard(r.doc_id, tree) and r.grown_shard == plain_shard(r.doc_id, sharding.grown(tree, 8))


def test_string_ids_and_large_ids_beside_null(spark):
    rows = [("b", "one two three four five"), ("a", "one two three four five"), (None, "one two three four five"), ("z", "quite other words stand here")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.id or "", r.component_id) for r in got) == [("", "a"), ("a", "a"), ("b", "a"), ("z", "z")]
    big = (1 << 62) + 1
    got = simhash.near_duplicates(spark.createDataFrame([(big, "one two"), (None, "x")], "doc_id long, text string")).collect()
    assert {r.id for r in got} == {big, None}


def test_decontaminated_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "three four five", 7, "x"), (None, None, 8, "y"), (2, "else", 9, None)], "doc_id long, text string, _rid int, id string")
    left = decontaminate.decontaminated(docs, spark.createDataFrame([(1, "three four five")], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r["_rid"] for r in left.collect()) == [8, 9]
