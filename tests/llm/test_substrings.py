"""Removal of repeated byte strings against brute force."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from namewright.llm import substrings as S


def slow(rows, length=100):
    first = {}
    docs = [(S.NO_ID if d is None else d, d, (t or "").encode()) for d, t in rows]
    for key, _, raw in docs:
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            first[w] = min((key, i), first.get(w, (key, i)))
    out = []
    for key, d, raw in docs:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (key, i):
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(rows):
    return sorted(rows, key=repr)


def check(docs, **more):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in S.remove_repeats(docs, **more).collect()]
    assert key(got) == key(slow(rows))
    return got


def test_repeats_equal_brute_force(spark, documents, awkward):
    assert sum(r[2] for r in check(documents)) > 1000
    check(documents, shard_bytes=2000)
    check(awkward.withColumnRenamed("id", "key"), shard_bytes=3000)
    assert S.remove_repeats(documents.limit(0)).count() == 0


def test_hot_passage_over_many_shards(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    hot, other = word(180), word(101)
    rows = [(i, word(int(rng.integers(0, 300))) + hot + (other if i % 3 else "") + word(int(rng.integers(0, 200)))) for i in range(150)]
    rows += [(1000, "ab" * 400), (1001, "a" * 350), (1002, "a" * 99), (1003, hot[:100]), (1004, hot[1:100]), (500, hot * 3)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), shard_bytes=4000)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=40), min_size=1, max_size=8))
def test_suffix_array_and_prefixes(strings):
    raw = [s.encode() for s in strings]
    text = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw])
    stop = np.cumsum(sizes)
    which = np.repeat(np.arange(len(raw)), sizes)
    ends, starts = stop[which], (stop - sizes)[which]
    order = S.suffix_array(text, ends, 64)
    suffix = lambda p: bytes(text[p : ends[p]])
    assert [suffix(p) for p in order] == sorted(suffix(p) for p in range(len(text)))
    share = S.common_prefixes(text, starts, ends, order, 64)
    for a, b, n in zip(order, order[1:], share[1:], strict=False):
        x, y = suffix(a), suffix(b)
        assert n == next((i for i, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))


def test_windows_have_one_anchor_each():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    h, start, count = S.anchors(raw)
    assert start[0] == 0 and (start[1:] == start[:-1] + count[:-1]).all() and count.sum() == len(raw) - 99
    grams = S.gram_hashes(raw, S.GRAM)
    again = S.gram_hashes(raw[17:], S.GRAM)
    assert (grams[17:] == again).all()
    for x, s, n in zip(h[:40], start[:40], count[:40], strict=True):
        assert all(x in grams[s + i : s + i + 100 - S.GRAM + 1] for i in range(n))


def test_runs_are_few_segments():
    """A run of one byte, or of a short period, costs no more than about its own bytes."""
    for raw in (b"a" * 200_000, b"ab" * 100_000, b"0123456789abcdef" * 12_500):
        h, start, count = S.anchors(np.frombuffer(raw, np.uint8))
        assert (count + 99).sum() <= 3 * len(raw) and len(h) < 20 and count.sum() == len(raw) - 99
        assert (start[1:] == start[:-1] + count[:-1]).all() and count.max() <= S.RUN


def test_long_runs_and_a_long_text_without_blanks(spark):
    rng = np.random.default_rng(9)
    own = "".join(rng.choice(list("abcdefgh"), 70_000))
    rows = [(1, "x" * 70_500), (2, "xy" * 300 + "x" * 400), (3, own), (4, own[300:900] + "!"), (5, None), (5, ""), (None, own[:150]), (None, "x" * 120)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_prefixes_of_suffixes_that_share_more_than_a_string():
    """Strings that are equal for longer than the length looked for, and differ after it."""
    rng = np.random.default_rng(4)
    base = bytes(rng.integers(97, 123, 140).astype(np.uint8))
    raw = [base[:30] + base[30:130] + bytes([c]) * 18 for c in (98, 97, 99)] + [base[40:140], b"zz" + base[35:125] + b"q" * 40]
    text, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
    stop = np.cumsum(sizes)
    which = np.repeat(np.arange(len(raw)), sizes)
    ends, starts = stop[which], (stop - sizes)[which]
    order = S.suffix_array(text, ends, int(sizes.max()))
    share = S.common_prefixes(text, starts, ends, order, 100)
    suffix = lambda p: bytes(text[p : ends[p]])
    for a, b, n in zip(order, order[1:], share[1:], strict=False):
        x, y = suffix(a), suffix(b)
        assert n == min(100, next((i for i, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y))))
