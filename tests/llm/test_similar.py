"""Near copies by similarity of shingles against brute force."""

import random
from collections import defaultdict
from itertools import combinations

from namewright.llm import similar


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_similar(rows, similarity=0.8):
    """{id: least id reachable} for rows of (id, text); ids that repeat stand for the same row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) < similarity * max(len(a), len(b)):
            continue
        shared = len(a & b)
        if shared >= similarity * (len(a) + len(b) - shared) - 1e-9:
            parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(d, min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def key(rows):
    return sorted(rows, key=repr)


def made_up():
    """Groups of near copies about the threshold, a chain, a passage that many share."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts, passage = [], " ".join(rng.choices(words, k=60))
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([3, 12, 60, 300]))
        for edits in (0, 1, 2, 4, 6):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    chain = rng.choices(words, k=200)
    for _ in range(40):
        chain[rng.randrange(200)] = rng.choice(words)
        texts.append(" ".join(chain))
    texts += [f"{passage} {' '.join(rng.choices(words, k=rng.choice([2, 10, 60])))}" for _ in range(150)]
    return list(enumerate(texts + texts[:7] + ["", None, "  "]))


def test_similar_documents_equal_brute_force(spark, awkward):
    for rows, docs in (
        (made_up(), spark.createDataFrame(made_up(), "doc_id long, text string")),
        ([(r.doc_id, r.text) for r in awkward.collect()], awkward),
    ):
        assert key(map(tuple, similar.similar_documents(docs).collect())) == key(slow_similar(rows))
    assert similar.similar_documents(awkward.limit(0)).count() == 0


def test_one_row_of_each_group(spark):
    """Repeated rows, rows of one id and rows without an id leave one row of each group."""
    import corpus_pipeline as cp

    a, b, c, d = (" ".join(f"{w}{i}" for i in range(60)) for w in "abcd")
    rows = [
        (5, a, "en", "s2", 1), (5, a, "en", "s1", 1), (5, a, "en", "s1", 1), (None, a, "en", "s0", 1), (9, a + " more", "en", "s1", 1),
        (None, b, "en", "s3", 1), (None, b, "en", "s2", 1), (None, b + " more", "en", "s2", 1), (7, c, "en", "s1", 1), (7, d, "en", "s1", 1), (7, d + " more", "en", "s1", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = [tuple(r) for r in cp.near_copies(spark, spark.createDataFrame(rows, schema), "").collect()]
    assert len(got) == 4
    assert (5, a, "en", "s1", 1) in got and (7, c, "en", "s1", 1) in got
    assert sum(r[0] is None for r in got) == 1 and sum(r[0] == 7 for r in got) == 2
    assert all(r in rows for r in got)


def test_any_ids_and_clashing_columns(spark):
    """Ids may be strings, and no column of the caller is lost or taken for one of ours."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [("b", base, 1, "x"), ("a", base + " tail", 2, None), (None, base, 3, "y"), ("c", "other words", 4, "z"), ("c", "other words", 4, "z"), (None, None, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, node int, _id string").withColumnRenamed("_id", "key")
    assert key(map(tuple, similar.similar_documents(docs).collect())) == key([("b", "a"), ("a", "a"), (None, "a"), ("c", "c"), ("c", "c"), (None, None)])
    assert key(map(tuple, similar.one_of_each(docs.withColumnRenamed("key", "_id")).collect())) == key([rows[1], rows[3], rows[5]])


def test_tally_and_sketch_keep_pairs_at_the_threshold():
    """Pairs of texts at 0.8 share far more positional bytes, and differ in fewer sketch bits, than asked for."""
    import numpy as np

    rng = random.Random(2)
    for _ in range(60):
        both = [f"w{rng.random()}" for _ in range(rng.choice([100, 400, 1000]))]
        size = len(both) - 4
        more = int(size / 0.8 - size) // 2  # further shingles on either side
        a, b = (" ".join(both + [f"{s}{i}" for i in range(more)]) for s in "xy")
        (_, _, pa, _, sa), (_, _, pb, _, sb) = (similar.index_row(t.encode()) for t in (a, b))
        assert (pa == pb).sum() >= similar.LEAST
        assert np.bitwise_count((sa ^ sb).view(np.uint64)).sum() <= similar.MOST_OFF
