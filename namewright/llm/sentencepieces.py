"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

A text is escaped as the model asks (space to U+2581, one in front) and cut before every run of
U+2581; no piece of such a model spans a cut, which is checked.  Distinct units of equal length stand
as rows of one matrix and advance together: for every end and every piece length, polynomial hashes
of the substrings probe the sorted hashes of the pieces (matches are compared character by
character), and a vectorised maximum over the candidates stores the backpointer.

A BPE model's ranks do not add up to a path score (the plain sum of scores gives other pieces than
the public library), so the Viterbi state is the last piece: a candidate keeps its path's score only
if merging the last piece and the candidate's characters by rank gives back just these two, and falls
to minus infinity otherwise.  An encoding is right if all its neighbouring pairs are, so exactly one
candidate an end survives and the path is the one that merging gives.  In a unigram model the state is
plain: the sum of the pieces' scores.

A BPE unit of more than `LONG` characters (a run without blanks) is cut into overlapping parts, which
advance together like any units; two parts are joined at an end that both have, if the pieces on its
two sides are a right pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
CHUNK_CHARS = 2 << 20
CACHE_UNITS = 250_000
TOP_BITS = 20
PAIR_SLOTS = 21  # bits
LONG, PART, LAP = 4096, 1024, 64
UNKNOWN_PENALTY = 10.0  # fixed value: what the public library takes off the least score for an unknown character


@dataclass
class Model:
    """Pieces and scores of a model, and lookups derived from them."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray  # 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
    dummy_prefix: bool
    byte_fallback: bool
    unigram: bool = False
    ids: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (1, 4)}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece spans a space; units can't be cut there")
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if self.byte_fallback else []
        self.unk = int(np.flatnonzero(self.kinds == 2)[0])
        names = list(self.ids)
        self.longest = max(map(len, names))
        self.codes = np.zeros((len(names), self.longest), np.uint32)
        for i, p in enumerate(names):
            self.codes[i, : len(p)] = [ord(c) for c in p]
        keys = np.array([_key([ord(c) for c in p]) for p in names], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.codes = keys[order], self.codes[order]
        # Which values the top bits of the keys take: most substrings are turned away here.
        self.there = np.zeros(1 << TOP_BITS, bool)
        self.there[self.keys >> np.uint64(64 - TOP_BITS)] = True
        self.key_ids = np.array([self.ids[p] for p in names], np.int64)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        # As the public library does: least score of all pieces that are not control ones.
        self.unknown = np.float32(min((self.scores[i] for i in self.ids.values() if self.kinds[i] == 1), default=0.0) - UNKNOWN_PENALTY)
        self.surface = [self._surface(i) for i in range(len(self.pieces))]

    def _surface(self, i: int) -> bytes:
        kind, piece = self.kinds[i], self.pieces[i]
        return bytes([int(piece[3:5], 16)]) if kind == 6 else b" \xe2\x81\x87 " if kind == 2 else b"" if kind == 3 else piece.replace(SPACE, " ").encode()


def _key(codes: list[int]) -> np.uint64:
    h = 0
    for c in codes:
        h = (h * int(BASE) + c + 1) % (1 << 64)
    return np.uint64((h ^ (len(codes) * 0xC4CEB9FE1A85EC53)) % (1 << 64))


def load(path: str = MODEL) -> Model:
    """Read a model file with the public library's proto classes."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models are encoded")
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only identity normalisation with escaped, leading spaces is known here")
    return Model(
        [p.piece for p in m.pieces], np.array([p.score for p in m.pieces], np.float32), np.array([p.type for p in m.pieces], np.int8),
        m.normalizer_spec.add_dummy_prefix, m.trainer_spec.byte_fallback, m.trainer_spec.model_type == 1,
    )


class Encoder:
    """Encodes distinct units in batches; keeps the encodings of up to CACHE_UNITS of them."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.cache: dict[str, bytes] = {}
        self.pair_keys = np.full(1 << PAIR_SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(1 << PAIR_SLOTS, bool)

    def units(self, text: str) -> list[str]:
        escaped = text.replace(" ", SPACE)
        if escaped and self.model.dummy_prefix:
            escaped = SPACE + escaped
        return UNIT.findall(escaped)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return np.frombuffer(self.encode_all([text])[0], "<i4")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers; their distinct new units are encoded together."""
        units = [self.units(t) for t in texts]
        self._learn(list({u for own in units for u in own} - self.cache.keys()))
        out = [b"".join(map(self.cache.__getitem__, own)) for own in units]
        if not self.model.byte_fallback:
            out = [self._one_unknown(x) for x in out]
        if len(self.cache) > CACHE_UNITS:
            self.cache = dict(list(self.cache.items())[: CACHE_UNITS // 2])
        return out

    def _one_unknown(self, flat: bytes) -> bytes:
        """Unknown characters in a row are one unknown piece."""
        ids = np.frombuffer(flat, "<i4")
        again = (ids[1:] == self.model.unk) & (ids[:-1] == self.model.unk)
        return np.delete(ids, np.flatnonzero(again) + 1).tobytes() if again.any() else flat

    def _long(self, unit: str, part: int = PART, lap: int = LAP) -> bytes:
        """The encoding of a long BPE unit, from parts that overlap by 2 * lap characters."""
        n = len(unit)
        if part >= n:
            return self.viterbi([unit], n)[0]
        starts = list(range(0, n, part))
        spans = [(max(0, s - lap), min(n, s + part + lap)) for s in starts]
        paths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[int]] = {}
        for k, (a, b) in enumerate(spans):
            by_length.setdefault(b - a, []).append(k)
        for size, which in by_length.items():
            step = max(1, (1 << 18) // size)
            for i in range(0, len(which), step):
                some = which[i : i + step]
                table, ends, used = self._walk([unit[slice(*spans[k])] for k in some], size)
                for r, k in enumerate(some):
                    paths[k] = table[r][used[r]], ends[r][used[r]] + spans[k][0]
        ids, ends = [paths[0][0]], [paths[0][1]]
        for k in range(1, len(starts)):
            own, stop = paths[k]
            left, left_stop = ids[-1], ends[-1]
            both = np.intersect1d(left_stop, stop)
            for p in both[np.argsort(np.abs(both - starts[k]), kind="stable")].tolist():
                i, j = int(np.searchsorted(left_stop, p)), int(np.searchsorted(stop, p))
                if j + 1 < len(own) and self._valid(int(left[i]), int(own[j + 1])):
                    ids[-1], ends[-1] = left[: i + 1], left_stop[: i + 1]
                    ids.append(own[j + 1 :])
                    ends.append(stop[j + 1 :])
                    break
            else:  # no such end: wider parts, up to the whole
                return self._long(unit, part * 2, lap * 2)
        return self._flat(unit, np.concatenate(ids), np.concatenate(ends))

    def _flat(self, unit: str, ids: np.ndarray, ends: np.ndarray) -> bytes:
        m = self.model
        if not m.byte_fallback or not (ids == m.unk).any():
            return ids.astype("<i4").tobytes()
        wide: list[int] = []
        for i, e in zip(ids.tolist(), ends.tolist(), strict=True):
            wide += [m.byte_ids[b] for b in unit[e - 1].encode("utf-8", "surrogatepass")] if i == m.unk else [i]
        return np.array(wide, "<i4").tobytes()

    def _learn(self, units: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for u in units:
            if len(u) > LONG and not self.model.unigram:
                self.cache[u] = self._long(u)
            else:
                by_length.setdefault(len(u), []).append(u)
        for n, group in sorted(by_length.items()):
            step = max(1, (1 << 18) // n)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.cache.update(zip(part, self.viterbi(part, n), strict=True))

    def viterbi(self, units: list[str], n: int) -> list[bytes]:
        """Encodings of units of n characters each."""
        table, ends, used = self._walk(units, n)
        m = self.model
        flat, stop = table[used].tobytes(), np.cumsum(used.sum(axis=1)) * 4
        out = [flat[a:b] for a, b in zip([0, *stop.tolist()], stop.tolist(), strict=False)]
        if m.byte_fallback:
            for r in np.flatnonzero((table == m.unk).any(axis=1)).tolist():
                out[r] = self._flat(units[r], table[r][used[r]], ends[r][used[r]])
        return out

    def _walk(self, units: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each unit the ids of its best path and the ends of its pieces, filled up in front, and
        which are used."""
        m = self.model
        rows = len(units)
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(rows, n)
        prefix = np.zeros((n + 1, rows), np.uint64)
        power = np.ones(m.longest + 1, np.uint64)
        for j in range(n):
            prefix[j + 1] = prefix[j] * BASE + code[:, j] + np.uint64(1)
        for i in range(m.longest):
            power[i + 1 : i + 2] = power[i : i + 1] * BASE
        score = np.full((n + 1, rows), -np.inf, np.float32)
        score[0] = 0
        piece = np.full((n + 1, rows), -1, np.int32)  # of the best path's last step
        length = np.zeros((n + 1, rows), np.int32)
        alone = np.ones(rows, bool)
        for j in range(1, n + 1):
            open_rows = np.arange(rows)  # without a candidate that ends here
            for w in range(min(m.longest, j), 0, -1):  # long ones first: of equals they win
                key = (prefix[j, open_rows] - prefix[j - w, open_rows] * power[w]) ^ np.uint64(w * 0xC4CEB9FE1A85EC53 % (1 << 64))
                maybe = np.flatnonzero(m.there[key >> np.uint64(64 - TOP_BITS)])
                if len(maybe):
                    key = key[maybe]
                    at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
                    same = m.keys[at] == key
                    hit, at = open_rows[maybe[same]], at[same]
                    same = (m.codes[at, :w] == code[hit, j - w : j]).all(axis=1)
                    hit, at = hit[same], at[same]
                    if w == 1:
                        alone[:] = True
                        alone[hit] = False
                    if len(hit):
                        self._improve(score, piece, length, j, w, hit, m.key_ids[at])
                        if not m.unigram:
                            open_rows = open_rows[piece[j, open_rows] < 0]
                elif w == 1:
                    alone[:] = True
            rest = open_rows[alone[open_rows]]
            lone = score[j - 1, rest] + (m.unknown if m.unigram else np.float32(0))
            rest, lone = (rest[lone > score[j, rest]], lone[lone > score[j, rest]]) if m.unigram else (rest, lone)
            score[j, rest], piece[j, rest], length[j, rest] = lone, m.unk, 1
        return self._trace(piece, length, n)

    def _improve(self, score: np.ndarray, piece: np.ndarray, length: np.ndarray, j: int, w: int, hit: np.ndarray, ids: np.ndarray) -> None:
        if self.model.unigram:
            cand = score[j - w, hit] + self.model.scores[ids]
        else:
            ok = self._pairs(piece[j - w, hit].astype(np.int64), ids) if j > w else np.ones(len(hit), bool)
            cand = np.where(ok, score[j - w, hit], np.float32(-np.inf))
        better = cand > score[j, hit]
        to = hit[better]
        score[j, to], piece[j, to], length[j, to] = cand[better], ids[better], w

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of two pieces by rank gives these two pieces."""
        size = len(self.model.pieces)
        key = left * size + right
        slot = ((key.astype(np.uint64) * BASE) >> np.uint64(64 - PAIR_SLOTS)).astype(np.int64)
        ok = self.pair_ok[slot]
        for i in np.flatnonzero(self.pair_keys[slot] != key).tolist():
            ok[i] = self._valid(int(left[i]), int(right[i]))
            self.pair_keys[slot[i]], self.pair_ok[slot[i]] = key[i], ok[i]
        return ok

    def _valid(self, a: int, b: int) -> bool:
        m = self.model
        if m.unk in (a, b):
            return True  # no piece holds an unknown character, so nothing merges across it
        left, right = m.pieces[a], m.pieces[b]
        return self._merged(left + right) == (left, right)

    def _merged(self, text: str) -> tuple[str, ...]:
        ids, scores = self.model.ids, self.model.scores
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def _trace(self, piece: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.arange(piece.shape[1])
        at = np.full(len(rows), n)
        steps = []
        while (at > 0).any():
            ids = np.where(at > 0, piece[at, rows], -1)
            if ((at > 0) & (ids < 0)).any():
                raise ValueError("a text has no path through the pieces")
            steps.append((ids, at))
            at = np.where(at > 0, at - length[at, rows], 0)
        table = np.array([x[0] for x in steps[::-1]], "<i4").T
        ends = np.array([x[1] for x in steps[::-1]]).T
        return table, ends, table >= 0


def decode(model: Model, ids: list[int] | np.ndarray) -> str:
    """The text of ids: pieces joined, U+2581 as a space, byte pieces as bytes, without the space in front."""
    text = b"".join(map(model.surface.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, with_ids: bool = False) -> DataFrame:
    """One row per row: (id, n_chars, n_pieces, ids_sha256, decoded_sha256, round_trip [, ids]).

    ids_sha256 is over the ids as little-endian 32-bit integers, decoded_sha256 over the UTF-8 of the
    text decoded from them.  Null is the empty text and has no pieces; U+2581 in a text decodes to a
    space (as in the public library), so round_trip is false there; repeated rows are encoded alike;
    an empty table gives none; other columns are not looked at.
    """
    model = load(model_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(model)
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"]]
            start, rows = 0, []
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= CHUNK_CHARS):
                    size += len(texts[stop])
                    stop += 1
                rows += [_row(model, t, flat, with_ids) for t, flat in zip(texts[start:stop], encoder.encode_all(texts[start:stop]), strict=True)]
                start = stop
            out = pd.DataFrame(rows, columns=["n_chars", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip", "ids"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out if with_ids else out.drop(columns="ids")
            del out, rows, texts
        give_back()

    chosen = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id string, n_chars long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    return chosen.mapInPandas(run, schema + ", ids array<int>" * with_ids).withColumn("id", F.col("id").cast(kind))


#: The last encoder of this process: what it has learnt serves the next task of a reused worker.
_LAST: list[Encoder] = []


def _encoder(model: Model) -> Encoder:
    if not _LAST or _LAST[0].model.pieces != model.pieces or (_LAST[0].model.scores != model.scores).any():
        _LAST[:] = [Encoder(model)]
    return _LAST[0]


def _row(model: Model, text: str, flat: bytes, with_ids: bool) -> tuple:
    ids = np.frombuffer(flat, "<i4")
    back = decode(model, ids)
    return len(text), len(ids), hashlib.sha256(flat).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text, ids.tolist() if with_ids else None
