"""WARC packages, MinHash, SentencePiece, toxicity and the pipeline against brute force."""

import hashlib
import io
import struct
import zipfile
import zlib
from collections import defaultdict

import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs

from namewright.llm import common, minhash, sentencepieces, toxicity, warc


def key(rows):
    return sorted(rows, key=repr)


# --- WARC ---------------------------------------------------------------------------------------


def slow_pages(rows):
    best = {}
    for page, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and page is not None:
            best[raw] = max(page, best.get(raw, page))
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        keep = best.get(raw)
        revisit = keep is not None and keep != page
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return out


def test_packages_give_back_pages(spark, sf_dir):
    real = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    big = "ä\r\n\r\n" * 400
    odd = [(1000, None, None), (1001, "http://a/\r\nX: y", ""), (1002, "u", big), (1003, "u", big), (1003, "u", big), (None, "u", big), (1004, "u", "x" * 999), (1005, "u", "x" * 999), (None, None, "z" * 2000)]
    for rows in (real + odd, odd, []):
        pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
        got = [tuple(r) for r in warc.round_trip(pages).collect()]
        assert key(got) == key(slow_pages([(r[0], r[2]) for r in rows]))


def test_package_is_an_ordinary_zip_and_payloads_survive(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = warc.write_packages(pages, common.scratch(spark, "warc-test"))
    back = {r.page_id: bytes(r.payload) for r in warc.read_packages(manifest, with_payload=True).collect()}
    assert back == {r.page_id: r.html.encode() for r in pages.collect()}
    store, path = fs.FileSystem.from_uri(manifest.first().package)
    with store.open_input_file(path) as f, zipfile.ZipFile(io.BytesIO(f.read())) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_zip64_directory():
    """A package whose sizes, offsets and counts stand in ZIP64 fields."""
    data, name = b"stored bytes", b"m"
    local = warc.LOCAL + struct.pack("<5H3I2H", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<2H2Q", 1, 16, 12, 12)
    extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), 0)
    central = warc.CENTRAL + struct.pack("<6H3I5H2I", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local) + len(data)
    end64 = warc.END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, at + len(central), 1)
    end = warc.END + struct.pack("<4H2IH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end"
    raw = local + data + central + end64 + locator + end
    read = lambda o, n: raw[o : o + n]
    member = warc.members(read, len(raw))["m"]
    start = warc.data_offset(read, member)
    assert raw[start : start + member.size] == data
    with pytest.raises(ValueError):
        warc.members(lambda o, n: b"x" * n, 50)


# --- MinHash ------------------------------------------------------------------------------------


def chain(*parts):
    seed = 42
    for p in parts:
        if p is not None:
            raw = p.encode() if isinstance(p, str) else struct.pack("<q", p) if p < -(1 << 31) or p >= 1 << 31 or isinstance(p, Long) else struct.pack("<i", p)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


class Long(int):
    pass


def signed(x):
    return Long(x - (1 << 64) if x >> 63 else x)


def slow_values(text):
    words = [signed(chain(w)) for w in (text or "").lower().split()]
    if not words:
        return []
    grams = [chain(*[words[i + k] if i + k < len(words) else None for k in range(5)]) for i in range(max(1, len(words) - 4))]
    least = {}
    for h in grams:
        h >>= 64 - 48 - 7
        b, v = h >> 48, h & ((1 << 48) - 1)
        least[b] = min(v, least.get(b, v))
    out = []
    for i in range(128):
        a, s = signed(chain(i, "start")) % 128, signed(chain(i, "step")) % 64 * 2 + 1
        at = next(x for x in [i, *[(a + s * n) % 128 for n in range(128)]] if x in least)
        out.append(least[at] & 255)
    return out


def slow_likeness(a, b):
    if not a or not b:
        return float(a == b)
    return min(1.0, max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 128 - 2**-8) / (1 - 2**-8)))


def test_minhash_equals_brute_force(spark, documents):
    docs = [(r.doc_id * 700, r.text) for r in documents.collect()] + [(5, None), (6, ""), (-4, "one two"), (1 << 40, "Ünï 😀 three four five six"), (2048, " \n ")]
    rows = sorted(docs, key=lambda r: -r[0])
    got = {r.doc_id: r for r in minhash.fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, (d, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, changed, r = slow_values(text), slow_values(edited), got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == bytes(own).hex() and r.edited_fingerprint == bytes(changed).hex()
        assert abs(r.near_edited - slow_likeness(own, changed)) < 1e-12 and abs(r.near_next - slow_likeness(own, slow_values(after))) < 1e-12


def test_minhash_likeness_is_near_resemblance(spark, documents):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    off = []
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), reverse=True)
    got = {r.doc_id: r for r in minhash.fingerprint_documents(documents).collect()}
    for i, (d, text) in enumerate(rows):
        cut = len(text) // 3
        a, b = shingles(text), shingles(text[: len(text) - cut] + rows[(i + 1) % len(rows)][1][:cut])
        off.append(got[d].near_edited - len(a & b) / len(a | b))
    assert abs(sum(off) / len(off)) < 0.02 and sum(x * x for x in off) / len(off) < 0.08**2


def test_minhash_awkward(spark, awkward):
    assert minhash.fingerprint_documents(awkward).count() == awkward.count()
    assert minhash.fingerprint_documents(awkward.limit(0)).count() == 0
    one = minhash.fingerprint_documents(awkward.where("doc_id = 9")).first()
    assert one.near_next == 1.0


def test_minhash_order_of_any_ids(spark, monkeypatch):
    """Ranges are found for sparse, repeated, null and string ids, and every row's next is the right one."""
    import random

    monkeypatch.setattr(minhash, "RANGE_ROWS", 10)
    rng = random.Random(3)
    text = lambda: " ".join(rng.choices("abcdefghij", k=rng.randrange(1, 30)))
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(150)] + [7] * 20 + [None] * 40
    for kind, own in (("long", ids), ("string", [None if i is None else str(i) for i in ids])):
        rows = [(i, text() + str(n)) for n, i in enumerate(own)]
        got = minhash.fingerprint_documents(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
        assert len(got) == len(rows)
        # Of rows that tie any may be next; each text is the next of just one row.
        asked = {(r.doc_id, r.n_chars, r.edited_sha256) for r in got}
        by_id = sorted({i for i in own if i is not None}, reverse=True) + [None]
        of = {i: [t for j, t in rows if j == i] for i in by_id}
        for n, i in enumerate(by_id):
            after = of[i] + of[by_id[(n + 1) % len(by_id)]] if len(of[i]) > 1 else of[by_id[(n + 1) % len(by_id)]]
            for t in of[i]:
                cut = len(t) // 3
                assert any((i, len(t), hashlib.sha256((t[: len(t) - cut] + x[:cut]).encode()).hexdigest()) in asked for x in after)


# --- SentencePiece ------------------------------------------------------------------------------

LIB = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
MODEL = sentencepieces.load()
ENCODER = sentencepieces.Encoder(MODEL)


def test_encoding_equals_the_public_library(documents):
    texts = [r.text for r in documents.collect()]
    texts += ["", " ", "a", "  a  b\n\n c", "😀😀 ünï\x00ß", "      x       y", "日本語テキスト 漢字", "1234 56,7", "\tx\r\n", "supercalifragilistic" * 30, "x" * 5000]
    for t in texts:
        ids = list(ENCODER.encode(t))
        assert ids == LIB.encode(t), t[:80]
        assert sentencepieces.decode(MODEL, ids) == t == LIB.decode(ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeionrst hE1.é\n▁漢"), max_size=60))
def test_encoding_of_random_texts(text):
    ids = list(ENCODER.encode(text))
    assert ids == LIB.encode(text)
    assert sentencepieces.decode(MODEL, ids) == text.replace("▁", " ")


def test_long_runs_without_blanks_equal_the_public_library():
    """Far beyond LONG characters, in parts that overlap; blanks, letters, digits, unknown characters."""
    import base64
    import random
    import time

    rng = random.Random(11)
    raw = base64.b64encode(rng.randbytes(700_000)).decode()
    began = time.time()
    got = ENCODER.encode(raw)
    assert time.time() - began < 20  # 0.9 million characters
    assert list(got) == LIB.encode(raw)
    for t in (" " * 9001, "x" * 20_011, "ab" * 7000, "".join(rng.choices("aeionrst", k=15_000)), "漢字😀" * 3000, "".join(rng.choices("a1é漢\n", k=12_000)), "the" * 5000):
        assert list(ENCODER.encode(t)) == LIB.encode(t), t[:20]


def unigram_file(path):
    """A small model written by hand, not trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.escape_whitespaces = True
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3.5, 1), ("a", -4, 1), ("b", -4.25, 1), ("ab", -6, 1), ("aba", -7.5, 1), ("▁a", -5, 1), ("▁ab", -6.125, 1), ("ba", -6.5, 1), ("bab", -9, 1), ("▁▁", -6, 1), ("c", -12, 1), ("abcab", -14, 1)]:
        m.pieces.add(piece=piece, score=score, type=kind)
    path.write_bytes(m.SerializeToString())
    return str(path)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabbc xé"), max_size=50))
def test_unigram_models_equal_the_public_library(tmp_path_factory, text):
    if "own" not in UNIGRAM:
        path = unigram_file(tmp_path_factory.mktemp("m") / "u.model")
        UNIGRAM.update(own=sentencepieces.Encoder(sentencepieces.load(path)), lib=sentencepiece.SentencePieceProcessor(model_file=path))
    assert list(UNIGRAM["own"].encode(text)) == UNIGRAM["lib"].encode(text)


UNIGRAM: dict = {}


def test_encode_documents(spark, awkward):
    for docs in (awkward, awkward.limit(0)):
        got = [(r.id, r.n_pieces, list(r.ids), r.round_trip) for r in sentencepieces.encode_documents(docs, with_ids=True).collect()]
        want = [(r.doc_id, len(LIB.encode(r.text or "")), LIB.encode(r.text or ""), True) for r in docs.collect()]
        assert key(got) == key(want)


# --- toxicity -----------------------------------------------------------------------------------


def test_restores_noisy_words():
    import numpy as np

    words = "idiot clown worthless moron pathetic disgusting trash loser stupid scum".split()
    restorer = toxicity.Restorer(np.ones(toxicity.SIZE**3, np.int64), {w: 100.0 for w in words})
    noisy = {"1d10t": "idiot", "l0$er": "loser", "tr@sh!": "trash!", "i.d.i.o.t": "idiot", "s t u p i d": "stupid", "idiooot": "idiot", "$cum": "scum", "st*pid": "stupid", "M0R0N": "moron"}
    for a, b in noisy.items():
        assert restorer.restore(f"The {a} there") == f"the {b} there"
    assert restorer.restore("nothing here is noisy, 2024") == "nothing here is noisy, 2024"


def slow_restore(restorer, span):
    """The best of all paths through the lattice."""
    logp, size = restorer.logp, toxicity.SIZE
    best = (-1e18, "")

    def walk(i, a, b, score, word):
        nonlocal best
        if i == len(span):
            score += logp[(a * size + b) * size] if word else -5.0
            if score > best[0] + 1e-12:
                best = (score, word)
            return
        c, before = span[i], span[i - 1] if i else ""
        if c.isalpha() and c not in toxicity.LEET:
            options = [("", 0.2), (c, 2.5 if i >= 2 and span[i - 2] == c else 0.0)] if c == before else [(c, 0.0)]
        elif c in toxicity.LEET:
            options = [(x, 0.7) for x in toxicity.LEET[c]] + [("", 0.2 if c == before else 2.5)]
        else:
            options = [("", 0.5), *[(v, 2.0) for v in "aeiou"]] if c == "*" else [("", 0.0)]
        for letter, cost in options:
            k = toxicity.char_code(letter) if letter else 0
            step = logp[((a * size + b) * size if word else 0) + k] if letter else 0
            walk(i + 1, *((b, k) if letter else (a, b)), score + step - cost, word + letter)

    walk(0, 0, 0, 0.0, "")
    return best[1]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab10e*.s", min_size=1, max_size=7))
def test_viterbi_is_the_best_path(span):
    import numpy as np

    rng = np.random.default_rng(7)
    restorer = toxicity.Restorer(rng.integers(1, 1000, toxicity.SIZE**3))
    assert restorer._decode(span) == slow_restore(restorer, span)


def test_held_out_accuracy_and_awkward_rows(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.learn(docs, labels)
    rows = toxicity.score_documents(docs, model).join(labels, "doc_id").where(toxicity.fold(docs.doc_id) == 0).select("predicted", "toxic").collect()
    assert len(rows) > 50 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93
    got = toxicity.score_documents(awkward, model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score_documents(awkward.limit(0), toxicity.learn(awkward.limit(0), labels.limit(0))).count() == 0
    noisy = spark.createDataFrame([(1, "you st*pid 1d10t and w0rthless l0$er")], "doc_id long, text string")
    assert toxicity.score_documents(noisy, model).first().predicted == 1


def test_doubled_letters_and_letters_far_apart_reach_the_decoder():
    import numpy as np

    words = "idiot clown worthless moron pathetic disgusting trash loser stupid scum".split()
    restorer = toxicity.Restorer(np.ones(toxicity.SIZE**3, np.int64), {w: 100.0 for w in words})
    model = toxicity.Model({w: 9.0 for w in words}, -5.0, restorer)
    for noisy in ("stuupid", "iddiot", "Stuupid!", "sccuum", "s\tt\tu\tp\ti\td", "s\nt\nu\np\ni\nd", "i   d   i   o   t"):
        assert model.score(f"the {noisy} there") > 0.5, noisy
    for clean in ("letter", "all good people agree", "a b c", "p\tq\nr"):
        assert model.score(f"the {clean} there") < 0.5, clean


def test_few_labels_give_a_sensible_classifier(spark):
    """The smallest table: not all texts are toxic, and held-out rows do better than the majority."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    rows = toxicity.score_documents(docs, model).select("doc_id", "score", "predicted").collect()
    assert len({r.score for r in rows}) > 5 and 0 < sum(r.predicted for r in rows) < 40
    told = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.predicted, told[r.doc_id]) for r in rows if r.doc_id in told and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right, most = sum(a == b for a, b in held), max(sum(y for _, y in held), sum(not y for _, y in held))
    assert right > most
    # One class alone, or no label at all: nothing is toxic on no evidence.
    for none in (labels.where("toxic = 0"), labels.limit(0)):
        got = toxicity.score_documents(docs, toxicity.learn(docs, none)).collect()
        assert len({r.score for r in got}) == 1 and not any(r.predicted for r in got)


def test_rejecting_keeps_the_callers_columns(spark, awkward):
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1), (5, None), (9, 0), (9, 1)], "doc_id long, toxic int")
    docs = awkward.withColumnsRenamed({"lang": "score", "source": "predicted", "id": "y"})
    for d in (docs, docs.limit(0)):
        left = toxicity.reject_toxic(d, labels)
        assert left.columns == d.columns
        assert not {tuple(r) for r in left.collect()} - {tuple(r) for r in d.collect()}


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as cp

    from tests.llm.test_pairs import slow_contamination, slow_lines
    from tests.llm.test_similar import slow_similar

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shape = dict(docs.dtypes)
    states = [docs]
    for name, stage in cp.STAGES[:-1]:
        path = common.scratch(spark, "test-" + name.replace(" ", "-"))
        stage(spark, states[-1], sf).write.parquet(path)
        states.append(spark.read.parquet(path))
        assert dict(states[-1].dtypes) == shape
    rows = [[(r.doc_id, r.text, r.source) for r in s.collect()] for s in states]
    assert 0 < len(rows[1]) < len(rows[0])
    assert key((d, t) for d, t, _ in rows[2]) == key((d, t) for d, _, _, t in slow_lines(rows[1]))
    assert {d for d, _, _ in rows[3]} == {c for _, c in slow_similar([(d, t) for d, t, _ in rows[2]])}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {d for d, _, _ in rows[4]} == {d for d, t, _ in rows[3] if not slow_contamination(t, items)[-1]}
    final = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    assert set(final) == {d for d, _, _ in rows[4]}
    assert all(final[d].n_pieces == len(LIB.encode(t)) for d, t, _ in rows[4])


def test_pipeline_stages_take_awkward_rows(spark, awkward, sf_dir):
    import corpus_pipeline as cp

    docs = awkward.drop("id")
    for d in (docs, docs.limit(0)):
        sizes = defaultdict(int)
        for name, stage in cp.STAGES:
            sizes[name] = stage(spark, d, sf_dir).count()
        assert all(v <= d.count() for v in sizes.values())
