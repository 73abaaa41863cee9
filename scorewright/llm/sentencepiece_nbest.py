"""SentencePiece encoding with N-best segmentations, and exact decoding.

Pieces and scores come from a public model file. A text, led by one space, is cut
where no piece can cross (before runs of spaces, around line ends); each part has a
lattice of pieces, with one fallback edge for a character that is no piece. Forward
Viterbi finds a part's best segmentation, vectorised over all distinct parts of a
batch, and its scores are exact heuristics for the backward A* search that lists a
part's next best ones. The N best of a text can only differ from its best in the
N - 1 parts whose second best costs least, so A* runs on those lattices alone and
their alternatives are combined. Fallback characters become UTF-8 byte pieces, so
decoding gives back every text exactly, U+2581 included.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import rolling as R
from scorewright.llm.common import arrow_batches, documents

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
#: Longer parts are solved one by one instead of side by side.
WIDE = 40
#: Distinct parts whose solutions a task keeps.
KEPT = 300_000
_MARK = "▁"
_PARTS = re.compile(r"\n| *[^ \n]+| +")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def load(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a model file; kind 0: ordinary, 1: control or unknown, 2: byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = (1 if sp.is_control(i) or sp.is_unknown(i) else 2 if sp.is_byte(i) else 0 for i in range(sp.get_piece_size()))
    return [(sp.id_to_piece(i), sp.get_score(i), k) for i, k in enumerate(kinds)]


class Lattice:
    """Piece table, Viterbi and A*."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.text = [p.replace(_MARK, " ") for p, _, _ in pieces]
        self.score = np.array([s for _, s, _ in pieces])
        self.id = {p: i for i, p in enumerate(self.text) if pieces[i][2] == 0}
        self.bytes = {int(_BYTE.fullmatch(p)[1], 16): i for i, (p, _, k) in enumerate(pieces) if k == 2}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.id), default=1)
        #: of a character that is no piece
        self.fallback = float(min((self.score[i] for i in self.id.values()), default=0.0)) - 10
        self._table()
        each = [bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(self.text)]
        #: UTF-8 bytes of all pieces one after another, and where each begins
        self.flat, self.cut = np.frombuffer(b"".join(each), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in each])))

    def _hash(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of rows of code points, and the inverse powers, for hashes of their stretches."""
        symbols = R.mix(codes.astype(np.uint64) + np.uint64(0x51ED))
        prefix = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum(symbols * R.powers(R.BASE, codes.shape[1]), axis=1, out=prefix[:, 1:])
        return prefix, R.powers(R.BASE_INV, codes.shape[1] + 1)

    def _table(self) -> None:
        """Two direct tables from hash bits to piece ids; the second takes what collides in the first."""
        bits = 20
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.first, self.second = np.full(1 << bits, -1, np.int32), np.full(1 << bits, -1, np.int32)
        self.hashes = np.zeros(len(self.text) + 1, np.uint64)
        sizes = {i: len(piece) for piece, i in self.id.items()}
        for size in {*sizes.values()} - {0}:
            own = [i for i, n in sizes.items() if n == size]
            prefix, inv = self._hash(np.array([[ord(c) for c in self.text[i]] for i in own], np.uint32))
            self.hashes[own] = R.mix(prefix[:, -1] * inv[0])
        top, low = (self.hashes >> self.shift).tolist(), (self.hashes & self.mask).tolist()
        for i in self.id.values():
            if self.first[top[i]] < 0:
                self.first[top[i]] = i
            else:
                if self.second[low[i]] >= 0:
                    raise ValueError("piece hashes collide")
                self.second[low[i]] = i

    def _find(self, h: np.ndarray) -> np.ndarray:
        i = self.first[h >> self.shift]
        miss = np.flatnonzero((self.hashes[i] != h) & (i >= 0))  # where the first table has none, the second has none
        if len(miss):
            j = self.second[h[miss] & self.mask]
            i[miss] = np.where(self.hashes[j] == h[miss], j, -1)
        return i

    def side_by_side(self, parts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best pieces (rows, filled with -1 on the right; -2 - code point: fallback), and the cost of the second best, of parts of one length."""
        n = len(parts)
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size)
        prefix, inv = self._hash(codes)
        edge, worth = {}, {}  # pieces of all rows; the rows that have one, and what it scores there
        for i in range(size):
            for j in range(i + 1, min(size, i + self.longest) + 1):
                piece = self._find(R.mix((prefix[:, j] - prefix[:, i]) * inv[i]))
                if j == i + 1:
                    worth[i, j] = np.arange(n), np.where(piece >= 0, self.score[piece], self.fallback)
                    edge[i, j] = np.where(piece >= 0, piece, -2 - codes[:, i].astype(np.int64))
                elif len(some := np.flatnonzero(piece >= 0)):
                    edge[i, j], worth[i, j] = piece, (some, self.score[piece[some]])
        ahead, back = np.full((size + 1, n), -np.inf), np.zeros((size + 1, n), np.int32)
        ahead[0] = 0
        behind = np.full((size + 1, n), -np.inf)
        behind[size] = 0
        for i, j in sorted(worth, key=lambda e: (e[1], e[0])):
            some, value = worth[i, j]
            value = ahead[i, some] + value
            better = value > ahead[j, some]
            some = some[better]
            ahead[j, some], back[j, some] = value[better], i
        for i, j in sorted(worth, reverse=True):
            some, value = worth[i, j]
            behind[i, some] = np.maximum(behind[i, some], value + behind[j, some])
        rows = np.arange(n)
        on = np.zeros((size + 1, n), bool)
        path, at = [], np.full(n, size)
        start = np.full((size + 1, n), -1, np.int32)
        while (at > 0).any():
            live = at > 0
            before = np.where(live, back[at, rows], 0)
            start[at[live], rows[live]] = before[live]
            on[at[live], rows[live]] = True
            piece = np.full(n, -1, np.int64)
            for i, j in {*zip(before[live].tolist(), at[live].tolist(), strict=True)}:
                here = live & (before == i) & (at == j)
                piece[here] = edge[i, j][here]
            path.append(piece)
            at = before
        path = np.stack(path[::-1], 1)
        # ragged on the left now; move each row's pieces to the front
        lead = (path == -1).sum(axis=1)
        path = np.take_along_axis(path, (np.arange(path.shape[1]) + lead[:, None]) % path.shape[1], 1)
        other = np.full(n, -np.inf)
        for (i, j), (some, value) in worth.items():
            through = ahead[i, some] + value + behind[j, some]
            through[on[j, some] & (start[j, some] == i)] = -np.inf
            other[some] = np.maximum(other[some], through)
        return path, np.full(n, np.inf) if size == 0 else ahead[size] - other, ahead[size]

    def _edges(self, part: str) -> list[list[tuple[int, int, float]]]:
        """Edges (start, piece or -2 - code point, score) that end at each place."""
        into = [[] for _ in range(len(part) + 1)]
        for j in range(1, len(part) + 1):
            for i in range(max(0, j - self.longest), j):
                piece = self.id.get(part[i:j])
                if piece is not None:
                    into[j].append((i, piece, float(self.score[piece])))
                elif j == i + 1:
                    into[j].append((i, -2 - ord(part[i]), self.fallback))
        return into

    def nbest(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations (score, pieces), best first.

        Of equal hypotheses the one nearest to the start goes on first, so ties are not
        explored side by side; and as the forward score is exact, the hypotheses of a
        place leave the agenda in order of their own score, so none after the n-th can
        be part of the n best.
        """
        into = self._edges(part)
        ahead = [0.0] + [-np.inf] * len(part)
        for j in range(1, len(part) + 1):
            ahead[j] = max((ahead[i] + s for i, _, s in into[j]), default=-np.inf)
        # hypotheses grow from the end backwards; the forward score of what is left is exact
        agenda, count, found, left = [(-ahead[-1], len(part), 0, 0.0, None)], 1, [], [n] * (len(part) + 1)
        while agenda and len(found) < n:
            _, place, _, gained, tail = heapq.heappop(agenda)
            if not left[place]:
                continue
            left[place] -= 1
            if place == 0:
                pieces = []
                while tail:
                    pieces.append(tail[0])
                    tail = tail[1]
                found.append((gained, tuple(pieces)))
                continue
            for i, piece, s in into[place]:
                heapq.heappush(agenda, (-(ahead[i] + s + gained), i, count, gained + s, (piece, tail)))
                count += 1
        return found

    def ids(self, pieces) -> list[int]:
        """Token ids: fallback characters become the ids of their UTF-8 bytes."""
        out = []
        for p in pieces:
            if p >= 0:
                out.append(int(p))
            else:
                out.extend(self.bytes[b] for b in chr(-2 - int(p)).encode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids) -> str:
        return self.decoded(ids).decode("utf-8", "surrogatepass")

    def decoded(self, ids, step: int = 1 << 18) -> bytes:
        """The text, in UTF-8, of token ids that encode() gave."""
        ids, out = np.asarray(ids, np.int64), []
        for lo in range(0, len(ids), step):
            begin = self.cut[ids[lo : lo + step]]
            size = self.cut[ids[lo : lo + step] + 1] - begin
            out.append(self.flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes())
        return b"".join(out)[1:]

    def solve(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids (one after another, with offsets), cost of the second best, and best score of distinct parts."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (places of parts, how many ids each, ids of one after another)
        gap, best = np.full(len(parts), np.inf), np.zeros(len(parts))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))

        def singly(where: np.ndarray, each: list[list[int]]) -> None:
            found.append((where, np.array([len(x) for x in each], np.int64), np.array([i for x in each for i in x], np.int32)))

        for size in np.unique(sizes):
            where = np.flatnonzero(sizes == size)
            if size > WIDE:
                own = []
                for w in where:
                    two = self.nbest(parts[w], 2)
                    own.append(self.ids(two[0][1]))
                    best[w] = two[0][0]
                    gap[w] = two[0][0] - two[1][0] if len(two) > 1 else np.inf
                singly(where, own)
                continue
            for lo in range(0, len(where), 1 << 15):
                some = where[lo : lo + (1 << 15)]
                path, gap[some], best[some] = self.side_by_side([parts[w] for w in some], int(size))
                plain = ~(path < -1).any(axis=1)
                there = path != -1
                found.append((some[plain], there[plain].sum(axis=1), path[plain][there[plain]].astype(np.int32)))
                singly(some[~plain], [self.ids(p[t].tolist()) for p, t in zip(path[~plain], there[~plain], strict=True)])
        length = np.zeros(len(parts), np.int64)
        for where, each, _ in found:
            length[where] = each
        offsets = np.concatenate(([0], np.cumsum(length)))
        ids = np.zeros(offsets[-1], np.int32)
        for where, each, flat in found:
            ids[np.repeat(offsets[where] - (np.cumsum(each) - each), each) + np.arange(len(flat))] = flat
        return ids, offsets, gap, best


def combined(options: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n least sums of one loss from each list, with the places taken."""
    best: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for losses in options:
        best = heapq.nsmallest(n, ((total + loss, (*taken, k)) for total, taken in best for k, loss in enumerate(losses)))
    return best


class Numbers(dict):
    """A number for each key: new ones get the next."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


_encoders: dict[str, Encoder] = {}


def encoder(name: str, pieces: list[tuple[str, float, int]], n: int) -> Encoder:
    """The encoder of a call of encode(), which its name tells; a worker keeps it, and the parts it has solved, for its next tasks."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(pieces, n)
    return _encoders[name]


class Encoder:
    """Encodes batches of texts."""

    def __init__(self, pieces: list[tuple[str, float, int]], n: int):
        self.lattice, self.n, self.lists = Lattice(pieces), n, {}
        self._clear()

    def alternatives(self, part: str, first: np.ndarray) -> tuple[list[float], list[np.ndarray]]:
        """Losses and ids of a part's n best segmentations, `first` (a best one) leading."""
        if part not in self.lists:
            if len(self.lists) > 20_000:
                self.lists.clear()
            own = first.tolist()
            found = self.lattice.nbest(part, self.n)
            rest = [(found[0][0] - x, k) for x, pieces in found for k in [self.lattice.ids(pieces)] if k != own][: self.n - 1]
            self.lists[part] = [0.0, *(x for x, _ in rest)], [first.copy(), *(np.array(k, np.int32) for _, k in rest)]
        return self.lists[part]

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """Number of each part; new ones are solved and kept."""
        if len(self.known) > KEPT:
            self._forget()
        which = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        new = list(islice(self.known, len(self.parts), None))
        if new:
            self._add(new, *self.lattice.solve(new))
        self.used = np.minimum(self.used + np.bincount(which, minlength=len(self.used)), 1 << 40)
        return which

    def _add(self, parts: list[str], ids: np.ndarray, offsets: np.ndarray, gap: np.ndarray, best: np.ndarray) -> None:
        self.offsets = np.concatenate((self.offsets, offsets[1:] + self.offsets[-1]))
        self.ids, self.gap, self.best = np.concatenate((self.ids, ids)), np.concatenate((self.gap, gap)), np.concatenate((self.best, best))
        self.used = np.concatenate((self.used, np.zeros(len(parts), np.int64)))
        self.parts.extend(parts)

    def _clear(self) -> None:
        self.known, self.parts = Numbers(), []
        self.ids, self.offsets, self.gap, self.best, self.used = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """The half of KEPT that was met most often, more than once at least, stays."""
        often = np.flatnonzero(self.used > 1)
        if len(often) > KEPT // 2:
            often = np.sort(often[np.argpartition(-self.used[often], KEPT // 2)[: KEPT // 2]])
        parts, ids, offsets, gap, best = [self.parts[k] for k in often.tolist()], self.ids, self.offsets, self.gap[often], self.best[often]
        size = offsets[often + 1] - offsets[often]
        ids = ids[np.repeat(offsets[often] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self._clear()
        self.known.update(zip(parts, range(len(parts)), strict=True))
        self._add(parts, ids, np.concatenate(([0], np.cumsum(size))), gap, best)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, float, list[float], bool, list[np.ndarray]]]:
        """(ids, score, losses of the n best against the best, whether decoding each of them whole gives the text back, ids of the n best) for each text."""
        split = [_PARTS.findall(" " + t) if t else [] for t in texts]
        which = self._numbers([p for s in split for p in s])
        ids, offsets, gap, best = self.ids, self.offsets, self.gap, self.best
        lo = 0
        for t, s in zip(texts, split, strict=True):
            own = which[lo : lo + len(s)]
            lo += len(s)
            size = offsets[own + 1] - offsets[own]
            take = np.repeat(offsets[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            whole = ids[take]
            losses, every = [0.0], [whole]
            if len(own) and self.n > 1:
                cost, m = gap[own], min(self.n - 1, len(own))
                near = np.argpartition(cost, m - 1)[:m] if m < len(own) else np.arange(len(own))
                near = np.sort(near[np.isfinite(cost[near])])
                options = [self.alternatives(self.parts[own[k]], ids[offsets[own[k]] : offsets[own[k] + 1]]) for k in near.tolist()]
                best_of = combined([o[0] for o in options], self.n)
                losses = [total for total, _ in best_of]
                start = (np.cumsum(size) - size)[near].tolist()
                stop = np.cumsum(size)[near].tolist()
                every += [_spliced(whole, start, stop, [o[1][k] for o, k in zip(options, taken, strict=True)]) for _, taken in best_of[1:]]
            raw = t.encode("utf-8", "surrogatepass")
            yield whole, float(best[own].sum()), losses, all(self.lattice.decoded(x) == raw for x in every), every


def _spliced(whole: np.ndarray, start: list[int], stop: list[int], parts: list[np.ndarray]) -> np.ndarray:
    """`whole` with other ids between each start and stop, which ascend."""
    out, at = [], 0
    for a, z, ids in zip(start, stop, parts, strict=True):
        out += [whole[at:a], ids]
        at = z
    return np.concatenate([*out, whole[at:]])


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = NBEST, model: str = MODEL, keep_ids: bool = True) -> DataFrame:
    """Encode every text: one row per input row.

    Columns: id_col, n_pieces, ids_sha256 (of the ids as little-endian 32-bit
    integers), best_score, losses (what each of the n best segmentations scores less
    than the best, ascending; fewer if the text has fewer), nbest_sha256 (of the ids of
    each of them, in that order), exact (decoding each gives the text back) and, if
    keep_ids, ids and nbest_ids. Null and empty texts have no ids.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared, name = spark.sparkContext.broadcast(load(model)), uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(name, shared.value, n)
        for batch in batches:
            lo = 0
            while lo < batch.num_rows or (lo == 0 and batch.num_rows == 0):
                part = batch.slice(lo, max(1, min(1000, batch.num_rows - lo)))
                got = list(coder.encode([t or "" for t in part["text"].to_pylist()]))
                ids = [g[0] for g in got]
                losses = [np.array(g[2]) for g in got]
                every = [x for g in got for x in g[4]]
                each = np.concatenate(([0], np.cumsum([len(g[4]) for g in got], dtype=np.int64))).astype(np.int32)
                digests = [_digest(x) for x in every]
                cols = [part["id"], pa.array([len(x) for x in ids], pa.int64()), pa.array([digests[k] for k in each[:-1]], pa.string()), pa.array([g[1] for g in got], pa.float64()), _lists(losses, pa.float64()), pa.ListArray.from_arrays(each, pa.array(digests, pa.string())), pa.array([g[3] for g in got], pa.bool_())]
                names = ["id", "n_pieces", "ids_sha256", "best_score", "losses", "nbest_sha256", "exact"]
                if keep_ids:
                    cols += [_lists(ids, pa.int32()), pa.ListArray.from_arrays(each, _lists(every, pa.int32()))]
                    names += ["ids", "nbest_ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                lo += max(1, part.num_rows)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(task, f"id {kind}, n_pieces long, ids_sha256 string, best_score double, losses array<double>, nbest_sha256 array<string>, exact boolean" + ", ids array<int>, nbest_ids array<array<int>>" * keep_ids).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Add text_col, the text of each row's ids (null: null)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))

    @F.pandas_udf("string")
    def back(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(shared.value)
        for ids in column:
            yield ids.map(lambda x: None if x is None else lattice.decode(x))

    return encoded.withColumn(text_col, back(F.col(ids_col)))


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows) if rows else [], kind))


def op6_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the N best segmentations of every document, their losses, and whether each decodes to the text."""
    return encode(documents(spark, sf_dir), keep_ids=False)
