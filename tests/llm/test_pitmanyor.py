"""The Pitman-Yor model: counts against brute force, draws against enumeration, sums to one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from namewright.llm import pitmanyor as M


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())), None]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def check(docs):
    rows = [(r.doc_id, tokens(r.text)) for r in docs.select("doc_id", "text").collect()]
    counts = Counter(t for d, ts in rows if not held(d) for t in ts)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((d, held(d), len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), 6)) for d, ts in rows), key=repr)
    got = M.score_documents(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(r.score <= 1e-6 and math.isfinite(r.score) for r in got)
    return got


def test_counts_and_base_scores(spark, documents, awkward):
    got = check(documents)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    check(documents.repartition(5))
    check(awkward)
    check(documents.limit(0))
    check(awkward.where("doc_id = 8"))
    again = {r.doc_id: r.score for r in M.score_documents(documents).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_blocks_do_not_depend_on_batches(documents, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(M, "SPLIT_TOKENS", 300)
    rows = pd.DataFrame([("s", str(r.doc_id), r.text) for r in documents.collect()], columns=["split", "id", "text"])
    cuts = [[(b.name, b.ids, b.pair.tolist()) for b in M.blocks(iter(np.array_split(rows, k) if k > 1 else [rows]))] for k in (1, 7, 50)]
    assert cuts[0] == cuts[1] == cuts[2] and len(cuts[0]) > 5


def test_draws_follow_the_posterior():
    """Enumerate seatings of 4 customers: weights of table numbers, and frequencies of draws."""
    d, others, parent = 0.6, 3.0, 0.3
    weights = Counter()

    def seat(sizes, left, w):
        if not left:
            weights[len(sizes)] += w
            return
        for i in range(len(sizes)):
            seat([s + (j == i) for j, s in enumerate(sizes)], left - 1, w * (sizes[i] - d))
        seat([*sizes, 1], left - 1, w * (M.STRENGTH + d * (others + len(sizes))) * parent)

    seat([], 4, 1.0)
    drawn = M.draw_tables(np.random.default_rng(1), M.stirling(d), np.full(60_000, 4), np.full(60_000, others), np.full(60_000, parent), d)
    for t in range(1, 5):
        assert abs((drawn == t).mean() - weights[t] / sum(weights.values())) < 0.01


def test_probabilities_sum_to_one():
    """Over the vocabulary and one more class, in every context."""
    rng = np.random.default_rng(5)
    words = np.sort(rng.integers(1, 1 << 63, 30).astype(np.uint64))
    text = words[rng.integers(0, 30, 4000) ** 2 // 30]
    ctx = M.contexts_of(text, np.array([len(text)]))
    code = np.searchsorted(words, text) * M.CONTEXTS + ctx
    codes, n = np.unique(code, return_counts=True)
    own, degree = np.unique(codes // M.CONTEXTS, return_counts=True)
    row = next(pd.DataFrame([(0, words[own].tobytes(), M.packed(degree.astype(np.uint16)), M.packed((codes % M.CONTEXTS).astype(np.uint16)), M.packed(n.astype(np.uint64)))], columns=["r", "words", "degree", "context", "n"]).itertuples())
    prior = M.Prior(0.7, 0.6, len(own), len(text))
    customers = np.bincount(codes % M.CONTEXTS, weights=n, minlength=M.CONTEXTS)
    shard = M.Shard(row, prior)
    totals = M.Totals(customers, np.bincount(codes % M.CONTEXTS, minlength=M.CONTEXTS).astype(float), float(len(codes)), float(len(own)))
    for _ in range(4):
        shard.sweep(totals)
        totals = M.Totals(customers, np.bincount(shard.context, weights=shard.tables, minlength=M.CONTEXTS), float(shard.seats.sum()), float(shard.root.sum()))
    assert 1 <= shard.tables.min() and (shard.tables <= shard.count).all() and (shard.root <= shard.seats).all()
    parent = shard.parent(totals, shard.seats, shard.root)
    unseen = (M.STRENGTH + prior.d0 * totals.root_tables) * prior.base / (M.STRENGTH + totals.root_customers)
    assert abs(parent.sum() + unseen - 1) < 1e-9
    for u in np.flatnonzero(customers)[:10]:
        mine = np.zeros(len(own))
        at = shard.context == u
        mine[shard.word[at]] = shard.count[at] - prior.d1 * shard.tables[at]
        top = M.STRENGTH + prior.d1 * totals.tables[u]
        assert abs((mine.sum() + top * (parent.sum() + unseen)) / (M.STRENGTH + customers[u]) - 1) < 1e-9


def test_each_word_is_a_context_of_its_own(spark):
    """Two words that shared a restaurant when contexts were hashed into 4,096 are told apart."""
    place = {}
    for i in range(20_000):
        word = f"w{i}"
        other = place.setdefault(int(M.hash_words([word.encode()])[0] % np.uint64(4095)), word)
        if other != word:
            break
    ids = [i for i in range(4000) if not held(i)][:2000]
    rows = [(d, f"{other} left" if n % 2 else f"{word} right") for n, d in enumerate(ids)]
    asked = [i for i in range(4000, 5000) if held(i)][:4]
    rows += zip(asked, [f"{other} left", f"{word} right", f"{other} right", f"{word} left"], strict=True)
    score = {r.doc_id: r.score for r in M.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # The word before settles what follows: what is left is the choice of the first word.
    assert abs(score[asked[0]] - math.log10(0.5)) < 0.05 and abs(score[asked[1]] - math.log10(0.5)) < 0.05
    assert score[asked[2]] < score[asked[0]] - 2 and score[asked[3]] < score[asked[1]] - 2


def test_contexts_grow_with_the_words():
    words = M.hash_words([f"w{i}".encode() for i in range(20_000)])
    assert len(np.unique(M.contexts_of(words, np.array([len(words)])))) == 20_000


def test_totals_are_summed_over_shards(spark, documents):
    """What shards are told of a context: all its customers, and the numbers of its followers."""
    rows = [("s", str(r.doc_id), r.text) for r in documents.collect()]
    asked = pd.concat(M._requests(4)(iter([pd.DataFrame(rows, columns=["split", "id", "text"])])))
    merged = pd.concat([M._merge(g) for _, g in asked.groupby("r")])
    _, history, _ = M.train(spark.createDataFrame(list(merged.itertuples(index=False, name=None)), M.COUNTS), 4)
    after = {}
    for _, d, text in rows:
        if not held(d):
            before = M.START
            for h in M.tokens_of([M.utf8(text)])[0]:
                after.setdefault(int(before), Counter())[int(h)] += 1
                before = h
    for row in merged.itertuples():
        totals = M._start(row, M.Shard(row, M.Prior(0.5, 0.5, 1, 1)), history[:1])
        for key, x, y in zip(M.unpacked_keys(row.keys).tolist(), totals.customers, totals.tables, strict=True):
            assert x == sum(after.get(key, {}).values()) and y == len(after.get(key, {}))


def test_numbers_of_tables_have_no_bound():
    """Draws for counts of hundreds and thousands against the whole recursion of Stirling numbers."""
    for n, d, others, parent in ((300, 0.762, 8000.0, 0.03), (3000, 0.762, 30_000.0, 0.02), (9868, 0.762, 4000.0, 0.06), (2000, 0.5, 900.0, 0.9), (5000, 0.3, 5.0, 0.3)):
        most = min(n, 1500)
        t = np.arange(most + 1)
        row = np.where(t == 1, 0.0, -np.inf)
        for k in range(1, n):
            grow = np.where(k > t * d, np.log(np.maximum(k - t * d, 1e-300)), -np.inf) + row
            row = np.logaddexp(grow, np.r_[-np.inf, row[:-1]])
        weight = row[1:] + np.cumsum(np.log(M.STRENGTH + d * (others + t[:-1]))) + t[1:] * math.log(parent)
        weight = np.exp(weight - weight.max())
        assert weight[-1] < 1e-9 or most == n
        weight /= weight.sum()
        mean = (weight * t[1:]).sum()
        spread = math.sqrt((weight * (t[1:] - mean) ** 2).sum())
        size = 2000
        drawn = M.draw_tables(np.random.default_rng(3), M.stirling(d), np.full(size, n), np.full(size, others), np.full(size, parent), d)
        assert abs(drawn.mean() - mean) < 5 * spread / math.sqrt(size) + 1e-3, (n, drawn.mean(), mean)
        assert abs(drawn.std() - spread) < 0.08 * spread + 1e-3
        seen = np.bincount(drawn, minlength=most + 1)[1 : most + 1].cumsum() / size
        assert np.abs(seen - weight.cumsum()).max() < 0.05
        assert (mean > 60) == (n != 5000)


def trained(spark, rows):
    """Requests, merged counts, prior and totals of (id, text) rows over four shards."""
    split = pd.DataFrame([("s", str(d), t) for d, t in rows], columns=["split", "id", "text"])
    asked = pd.concat(M._requests(4)(iter([split])))
    merged = pd.concat([M._merge(g) for _, g in asked.groupby("r")])
    return asked, merged, *M.train(spark.createDataFrame(list(merged.itertuples(index=False, name=None)), M.COUNTS), 4)


def test_answers_sum_to_one_and_equal_a_plain_evaluation(spark, documents):
    """Over all training words and one unknown, in contexts that are frequent, rare, unseen; and the score
    of each text by the sampled seatings, token by token."""
    rows = [(r.doc_id, r.text) for r in documents.collect()][:60]
    training = [t for d, t in rows if not held(d)]
    words = sorted({w.decode() for t in training for w in tokens(t) if w is not None})
    contexts = ["the", words[3], words[-1], "neverseen"]
    out = next(i for i in range(10_000, 20_000) if held(i))
    everything = " ".join(f"{u} {w}" for u in contexts for w in [*words, "otherwise"]) + " " + " ".join(contexts)
    rows += [(out, everything), *((i, u) for i, u in zip([i for i in range(30_000, 31_000) if held(i)], contexts, strict=False))]
    asked, merged, prior, history, samples = trained(spark, rows)
    p, seats = {}, [{} for _ in range(M.SAMPLES)]
    for row in merged.itertuples():
        shard, keys = M.Shard(row, prior), M.unpacked_keys(row.keys)
        sampled = M._seatings(row, shard, M._customers(row, history), samples)
        own = asked[asked["r"] == row.r]
        for (_, _, logp, _), (_, q) in zip(M._answers(shard, keys, sampled, own), own.iterrows(), strict=True):
            w = M.unpacked_keys(q["words"])
            degree = M.widened(q["degree"], len(w))
            ctx = M.unpacked_keys(q["keys"])[M.widened(q["context"], int(degree.sum()))]
            p.update(zip(zip(np.repeat(w, degree).tolist(), ctx.tolist(), strict=True), 10.0 ** M.unpacked(logp, np.float32).astype(float), strict=True))
        # The seating that was handed on is what sweeping from the first epoch on gives.
        again = M.Shard(row, prior)
        for h in [history[:1], *[history[: i + 1] for i in range(1, len(history))]]:
            under = M._start(row, M.Shard(row, prior), h)
            for _ in range(M.SAMPLES if len(h) == len(history) else 1):
                again.sweep(under)
        assert (again.tables == sampled[-1][0]).all() and (again.root == sampled[-1][1]).all()
        for s, (tables, root, _) in enumerate(sampled):
            seats[s].update(((int(shard.words[i]), int(keys[j])), (int(c), int(t), int(root[i]))) for i, j, c, t in zip(shard.word, shard.context, shard.count, tables, strict=True))
    of = lambda w: int(M.hash_words([w.encode()])[0])
    for u in contexts:
        total = sum(p[of(w), of(u)] for w in [*words, "otherwise"]) + p[int(M.END), of(u)]
        assert abs(total - 1) < 1e-5, (u, total)  # answers are kept in single precision
    # A plain evaluation of the same seatings, from dictionaries.
    sums = []
    for held_seats in seats:
        customers, tables, up, root = Counter(), Counter(), Counter(), {}
        for (w, u), (c, t, r) in held_seats.items():
            customers[u] += c
            tables[u] += t
            up[w] += t
            root[w] = r
        sums.append((customers, tables, up, root, sum(up.values()), sum(root.values())))

    def plain(w, u):
        out = []
        for held_seats, (customers, tables, up, root, n, r) in zip(seats, sums, strict=True):
            top = (max(up[w] - prior.d0 * root.get(w, 0), 0) + (1 + prior.d0 * r) / (prior.vocabulary + 1)) / (1 + n)
            c, t, _ = held_seats.get((w, u), (0, 0, 0))
            out.append((c - prior.d1 * t + (1 + prior.d1 * tables[u]) * top) / (1 + customers[u]))
        return sum(out) / len(out)

    got = {r.doc_id: r.score for r in M.score_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    for d, t in rows[:20] + rows[-4:]:
        hashes = [int(M.START), *M.tokens_of([M.utf8(t)])[0].tolist()]
        want = sum(math.log10(plain(w, u)) for u, w in zip(hashes, hashes[1:], strict=False))
        assert abs(got[d] - want) < 1e-4 * max(1, abs(want)), (d, got[d], want)
