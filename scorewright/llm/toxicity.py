"""Toxic spans and document scores from a linear-chain conditional random field trained here in numpy.

Labels come by document, so tokens are labelled first: an affix or word that, among
the sampled texts, stands almost only in toxic ones marks a token of a toxic text
as toxic. The field has two states; a token's state score is the sum of weights of
its hashed features (the word, its first 4, 5 and 6 bytes, its last 4 bytes, and the
words beside it), and chains are sentences. Forward-backward marginals give each
token a probability; a logistic layer over a text's largest and summed marginal
gives the score of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import rolling as R
from scorewright.llm.common import arrow_batches, documents
from scorewright.llm.langid import SHARES, held_out, share_limit

#: Bound of the training sample: about so many texts for each label, each of them whole.
PER_LABEL = 1500
FEATURE_BITS = 18
#: A feature marks toxic tokens if so large a share of its (balanced) texts is toxic, and so many are.
PURITY = 0.9
SUPPORT = 5
EPOCHS = 6
PREDICT_AT = 0.7

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True
_KINDS = 7
#: How many of the kinds describe the token itself; only those can mark it.
_OWN = 5


class Tokens:
    """Tokens of a chunk with hashed features and the sentence of each."""

    def __init__(self, chunk: R.Chunk):
        words = R.Words(chunk, lower=True, letters=_LETTERS)
        self.start, self.end, self.offsets = words.start, words.end, words.offsets
        n = len(self.start)
        doc = np.repeat(np.arange(chunk.hi - chunk.lo), np.diff(self.offsets))
        self.doc = doc
        stops = np.concatenate(([0], np.cumsum(_STOP[chunk.data])))
        before = np.concatenate(([True], (doc[1:] != doc[:-1]) | (stops[self.start[1:]] != stops[self.start[:-1]]))) if n else np.zeros(0, bool)
        self.sentence = np.flatnonzero(before)
        size = self.end - self.start
        own = [words.hash, *(words.poly.of(self.start, np.minimum(self.end, self.start + k)) for k in (4, 5, 6)), words.poly.of(np.maximum(self.start, self.end - 4), self.end)]
        gone = np.uint64(0)
        prev = np.where(before, gone, np.concatenate(([gone], words.hash[:-1]))) if n else words.hash
        last = np.concatenate((before[1:], [True])) if n else before
        nxt = np.where(last, gone, np.concatenate((words.hash[1:], [gone]))) if n else words.hash
        f = np.stack([R.mix(h + np.uint64(1 + i)) for i, h in enumerate([*own, prev, nxt])]) if n else np.zeros((_KINDS, 0), np.uint64)
        f[1:5][:, size < 4] = 0
        f[2, size < 5] = 0
        f[3, size < 6] = 0
        #: 64-bit feature hashes by kind; 0: the token has none of that kind
        self.features = f

    def index(self) -> np.ndarray:
        return (self.features >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def marginals(score: np.ndarray, begins: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of each token, and expected transitions (2 x 2), over all chains at once.

    `score` is what state 1 gains over state 0 at each token, `begins` where chains
    begin, `trans` the log weights of going from one state to another. Chains are
    stepped side by side, longest first, so each step works on those still running.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    sizes = np.diff(np.concatenate((begins, [n])))
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1), side="left")
    gain = np.exp(np.clip(score, -30, 30))
    t = np.exp(trans)
    alpha, beta = np.empty((n, 2)), np.ones((n, 2))
    a = np.stack([np.ones(len(begins)), gain[begins]], 1)
    a /= a.sum(1, keepdims=True)
    alpha[begins] = a
    for k in range(1, int(sizes[0])):
        a = a[: alive[k]] @ t
        at = begins[: alive[k]] + k
        a[:, 1] *= gain[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    pairs = np.zeros((2, 2))
    for k in range(int(sizes[0]) - 1, 0, -1):
        at = begins[: alive[k]] + k
        b = beta[at].copy()
        b[:, 1] *= gain[at]
        both = alpha[at - 1][:, :, None] * t[None] * b[:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        b = b @ t.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(1), pairs


class ToxicityModel:
    def __init__(self):
        self.weights = np.zeros(1 << FEATURE_BITS, np.float32)
        self.trans = np.zeros((2, 2))
        #: bias, largest marginal, log of 1 + summed marginals
        self.layer = np.array([-4.0, 0.0, 0.0])

    def token_probabilities(self, tokens: Tokens) -> np.ndarray:
        score = self.weights[tokens.index()].sum(axis=0, dtype=np.float64)
        return marginals(score, tokens.sentence, self.trans)[0]

    @staticmethod
    def pooled(p: np.ndarray, tokens: Tokens) -> np.ndarray:
        """Largest marginal and log of 1 + summed marginals of each text (0 without tokens)."""
        out = np.zeros((len(tokens.offsets) - 1, 2))
        some = np.flatnonzero(np.diff(tokens.offsets) > 0)
        if len(some):
            out[some, 0] = np.maximum.reduceat(p, tokens.offsets[some])
            out[some, 1] = np.log1p(np.add.reduceat(p, tokens.offsets[some]))
        return out

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        z = self.layer[0] + pooled @ self.layer[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def token_labels(parts: list[tuple[Tokens, np.ndarray]]) -> list[np.ndarray]:
    """Toxic tokens of each part: those of toxic texts with a feature that almost only toxic texts have."""
    keys, toxic = [], []
    for tokens, y in parts:
        own = tokens.features[:_OWN]
        key = (own ^ (tokens.doc.astype(np.uint64) * np.uint64(R.BASE))[None]).ravel()
        first = np.unique(key, return_index=True)[1]  # each feature of a text once
        keys.append(own.ravel()[first])
        toxic.append(y[np.tile(tokens.doc, _OWN)[first]])
    keys, toxic = np.concatenate(keys), np.concatenate(toxic)
    names, where = np.unique(keys, return_inverse=True)
    bad, good = np.bincount(where, toxic), np.bincount(where, 1 - toxic)
    rate = max(1.0, (1 - toxic).sum()) / max(1.0, toxic.sum())
    marks = names[(bad >= SUPPORT) & (bad * rate >= PURITY * (bad * rate + good)) & (names != 0)]
    return [np.isin(t.features[:_OWN], marks).any(axis=0) & (y[t.doc] == 1) for t, y in parts]


def fit(texts: list[str], y: np.ndarray, prior: float) -> ToxicityModel:
    """Train the field by mini-batch gradient steps (Adagrad), then the logistic layer, corrected for the share `prior` of toxic texts."""
    model = ToxicityModel()
    order = np.random.default_rng(5).permutation(len(texts))
    parts = []
    for lo in range(0, len(order), 100):
        pick = order[lo : lo + 100]
        (chunk,) = R.chunks(pa.array([texts[i] for i in pick], pa.string()), most=1 << 40)
        parts.append((Tokens(chunk), y[pick]))
    if not parts or y.min() == y.max():
        model.layer[0] = np.log(max(prior, 1e-4) / max(1 - prior, 1e-4))
        return model
    labels = token_labels(parts)
    gsum, tsum = np.full(len(model.weights), 1e-6), np.full((2, 2), 1e-6)
    for epoch in range(EPOCHS):
        for (tokens, _), mark in zip(parts, labels, strict=True):
            index = tokens.index()
            p, pairs = marginals(model.weights[index].sum(axis=0, dtype=np.float64), tokens.sentence, model.trans)
            if not len(p):
                continue
            wrong = mark - p
            grad = np.bincount(index.ravel(), np.tile(wrong, _KINDS), len(model.weights)) - 1e-3 * model.weights
            gsum += grad * grad
            model.weights += (0.5 * grad / np.sqrt(gsum)).astype(np.float32)
            inner = np.ones(len(p), bool)
            inner[tokens.sentence] = False
            at = np.flatnonzero(inner)
            seen = np.zeros((2, 2))
            np.add.at(seen, (mark[at - 1].astype(int), mark[at].astype(int)), 1)
            tgrad = (seen - pairs) - 1e-3 * model.trans
            tsum += tgrad * tgrad
            model.trans += 0.2 * tgrad / np.sqrt(tsum)
    x = np.concatenate([ToxicityModel.pooled(model.token_probabilities(t), t) for t, _ in parts])
    target = np.concatenate([y for _, y in parts]).astype(float)
    w, design = np.zeros(3), np.column_stack([np.ones(len(x)), x])
    for _ in range(30):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (target - q) - 0.1 * w
        w += np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design + 0.1 * np.eye(3), grad)
    share = target.mean()
    w[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    model.layer = w
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> ToxicityModel:
    """Fit on about `per_label` whole texts of each label, chosen by a hash of the id; rows of held_out() are not used."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("lid")).agg(F.max(label_col).alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts:
        return fit([], np.zeros(0), 0.01)
    limit = {k: share_limit(per_label, c) for k, c in counts.items()}
    chosen = known.where(F.pmod(F.xxhash64("lid"), F.lit(SHARES)) < F.when(F.col("y") == 1, F.lit(limit.get(1, 0))).otherwise(F.lit(limit.get(0, 0))))
    # at most about 2 * per_label rows, whatever the number of labels
    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen["lid"]).select("lid", "y", F.coalesce(text_col, F.lit("")).alias("text")).collect()
    rows.sort(key=lambda r: (r["lid"], r["text"]))
    share = counts.get(1, 0) / sum(counts.values())
    return fit([r["text"] for r in rows], np.array([r["y"] for r in rows]), min(max(share, 1e-4), 1 - 1e-4))


def tag(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, score, predicted, spans (start and end in UTF-8 bytes, and probability, of tokens at 0.5 or more).

    Null, empty and letterless texts have no tokens and get the score of a text
    without any sign of toxicity. The whole text counts; equal texts score alike.
    """
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.trans, model.layer))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = ToxicityModel()
        field.weights, field.trans, field.layer = shared.value
        for batch in batches:
            scores, counts, starts, ends, probs = [], [], [], [], []
            for chunk in R.chunks(batch["text"]):
                tokens = Tokens(chunk)
                p = field.token_probabilities(tokens)
                scores.append(field.scores(ToxicityModel.pooled(p, tokens)))
                hit = np.flatnonzero(p >= 0.5)
                base = chunk.offsets[tokens.doc[hit]]
                counts.append(np.bincount(tokens.doc[hit], minlength=chunk.hi - chunk.lo))
                starts.append(tokens.start[hit] - base)
                ends.append(tokens.end[hit] - base)
                probs.append(p[hit])
            join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            score = join(scores, np.float64)
            flat = pa.StructArray.from_arrays([pa.array(join(starts, np.int32)), pa.array(join(ends, np.int32)), pa.array(join(probs, np.float64))], fields=list(span))
            offsets = np.concatenate(([0], np.cumsum(join(counts, np.int64)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(score), pa.array((score >= PREDICT_AT).astype(np.int32)), pa.ListArray.from_arrays(offsets, flat)], names=["id", "score", "predicted", "spans"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(task, f"id {kind}, score double, predicted int, spans array<struct<start:int,end:int,p:double>>").withColumnRenamed("id", id_col)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, and the number, starts, ends and marginals of its offending tokens; a null doc_id is not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return tag(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), "spans")
