"""Language identification by a small byte convolutional network trained here in numpy.

Windows of WINDOW bytes are embedded byte by byte, convolved with filters of
several widths, max-pooled over the window and classified by a softmax layer. A
text's prediction is the mean of the class probabilities of all of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import rolling as R
from scorewright.llm.common import arrow_batches, documents

WINDOW = 96
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 6
#: Bound of the training sample: about so many texts for each label, each of them whole.
PER_LABEL = 500
STEPS = 900
BATCH = 96
#: Windows scored together.
GROUP = 512


class ByteCNN:
    """Parameters and passes of the network."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"emb": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (1 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.p["bias"] = np.zeros(len(classes), np.float32)

    def _columns(self, windows: np.ndarray, w: int) -> np.ndarray:
        """Each place's next w embedded bytes side by side, for all windows."""
        n, size = windows.shape
        e = self.p["emb"][windows].reshape(n, size * EMBED)
        shape, strides = (n, size - w + 1, w * EMBED), (e.strides[0], EMBED * e.strides[1], e.strides[1])
        return np.lib.stride_tricks.as_strided(e, shape, strides).reshape(-1, w * EMBED)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = []
        for w in WIDTHS:
            h = self._columns(windows, w) @ self.p[f"w{w}"]
            pooled.append(h.reshape(len(windows), -1, FILTERS).max(axis=1) + self.p[f"b{w}"])
        return self._softmax(pooled)

    def _softmax(self, pooled: list[np.ndarray]) -> np.ndarray:
        z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def tables(self) -> dict[tuple[int, int], np.ndarray]:
        """For each width and even place k under its filters: what two bytes in a row at k add to them; the last byte of an odd width stands alone."""
        out = {}
        for w in WIDTHS:
            one = [self.p["emb"] @ part for part in np.split(self.p[f"w{w}"], w)]
            for k in range(0, w, 2):
                after = one[k + 1] if k + 1 < w else np.zeros_like(one[k])
                out[w, k] = (one[k][:, None] + after[None]).reshape(-1, FILTERS)
        return out

    def looked_up(self, windows: np.ndarray, tables: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        """The probabilities, with the convolutions read from tables()."""
        first = np.ascontiguousarray(windows.T)
        pair = first.astype(np.intp) << 8
        pair[:-1] |= first[1:]
        pooled = []
        for w in WIDTHS:
            n = len(first) - w + 1
            h = tables[w, 0].take(pair[:n], axis=0)
            for k in range(2, w, 2):
                h += tables[w, k].take(pair[k : k + n], axis=0)
            pooled.append(h.max(axis=0) + self.p[f"b{w}"])
        return self._softmax(pooled)

    def _gradients(self, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, g = len(windows), {}
        cols, tops, pooled = {}, {}, []
        for w in WIDTHS:
            cols[w] = self._columns(windows, w).reshape(n, -1, w * EMBED)
            h = cols[w] @ self.p[f"w{w}"] + self.p[f"b{w}"]
            tops[w] = h.argmax(axis=1)
            pooled.append(np.take_along_axis(h, tops[w][:, None, :], 1)[:, 0])
        z = np.concatenate(pooled, axis=1)
        a = np.maximum(z, 0)
        o = a @ self.p["out"] + self.p["bias"]
        o = np.exp(o - o.max(axis=1, keepdims=True))
        o /= o.sum(axis=1, keepdims=True)
        o[np.arange(n), y] -= 1
        o /= n
        g["out"], g["bias"] = a.T @ o, o.sum(axis=0)
        dz = (o @ self.p["out"].T) * (z > 0)
        g["emb"] = np.zeros_like(self.p["emb"])
        for i, w in enumerate(WIDTHS):
            d = dz[:, i * FILTERS : (i + 1) * FILTERS]
            best = np.take_along_axis(cols[w], tops[w][:, :, None], 1)  # n, filters, w * EMBED
            g[f"w{w}"] = np.einsum("nfk,nf->kf", best, d)
            g[f"b{w}"] = d.sum(axis=0)
            back = (d[:, :, None] * self.p[f"w{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            at = tops[w][:, :, None] + np.arange(w)
            np.add.at(g["emb"], windows[np.arange(n)[:, None, None], at], back)
        return g

    def fit(self, windows: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam over mini-batches drawn evenly from the classes."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == c) for c in range(len(self.classes))]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            pick = np.concatenate([rng.choice(b, -(-BATCH // len(by))) for b in by if len(b)])
            rate = 0.01 * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, g in self._gradients(windows[pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts (the last one of a text is filled up with zeros) and the text of each."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    place = offsets[doc][:, None] + nth[:, None] * WINDOW + np.arange(WINDOW)
    inside = place < offsets[doc + 1][:, None]
    return np.where(inside, data[np.minimum(place, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(doc) else np.zeros((0, WINDOW), np.uint8), doc


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model of this subpackage learns from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


#: Steps in which share_limit() counts.
SHARES = 1 << 40


def share_limit(wanted: int, there: int) -> int:
    """Hashes modulo SHARES below this number are about `wanted` of `there` rows."""
    return int(SHARES * min(1.0, wanted / there))


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> list:
    """About `per_label` whole texts of each label, chosen by a hash of the id."""
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.length(text_col)).alias("h"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return []
    limits = F.create_map(*[F.lit(x) for k, c in sorted(counts.items()) for x in (k, share_limit(per_label, c))])
    picked = rows.where(F.pmod("h", F.lit(SHARES)) < limits[F.col("label")])
    return sorted(picked.select("label", "text", "h").collect(), key=lambda r: (r["label"], r["h"], r["text"]))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL) -> ByteCNN:
    """Fit on all windows of about `per_label` texts of each label; without labelled texts the model has no classes."""
    sample = training_sample(docs, id_col, text_col, label_col, per_label)
    classes = sorted({r["label"] for r in sample})
    model = ByteCNN(classes)
    if sample:
        texts = [r["text"].encode() for r in sample]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        windows, doc = cut_windows(np.frombuffer(b"".join(texts), np.uint8), offsets)
        label = np.array([classes.index(r["label"]) for r in sample])
        if len(windows):
            model.fit(windows, label[doc])
    return model


def identify(docs: DataFrame, model: ByteCNN, *, text_col: str = "text", keep: list[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """Columns `keep` of docs with lang_pred and score.

    A null text, a text without letters, or a model without classes gives `und`
    with score 0.0. Every window of a text counts; equal texts get equal scores.
    Results are called lang_pred and score unless `rename` says otherwise.
    """
    arrow_batches(docs.sparkSession)
    keep = list(docs.columns if keep is None else keep)
    names = {"lang_pred": "lang_pred", "score": "score"} | (rename or {})
    place = f"k{keep.index(text_col)}" if text_col in keep else "text_"
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *([] if text_col in keep else [F.col(text_col).alias("text_")]), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters_"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]] + ["lang_pred string", "score double"])
    shared = docs.sparkSession.sparkContext.broadcast((model.classes, model.p))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, parts = shared.value
        net = ByteCNN(classes)
        net.p = parts
        tables = net.tables()
        for batch in batches:
            letters = batch["letters_"].to_numpy(zero_copy_only=False)
            total = np.zeros((batch.num_rows, max(1, len(classes))), np.float64)
            count = np.zeros(batch.num_rows)
            for chunk in R.chunks(batch[place]) if classes else ():
                windows, doc = cut_windows(chunk.data, chunk.offsets)
                for lo in range(0, len(windows), GROUP):
                    p = net.looked_up(windows[lo : lo + GROUP], tables)
                    at = doc[lo : lo + GROUP]
                    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                    total[chunk.lo + at[first]] += np.add.reduceat(p, first, axis=0)
                count[chunk.lo : chunk.hi] = -(-np.diff(chunk.offsets) // WINDOW)
            mean = total / np.maximum(count, 1)[:, None]
            known = letters & (count > 0) & bool(classes)
            best = mean.argmax(axis=1)
            lang = np.where(known, np.array(classes or ["und"], object)[best], "und")
            score = np.where(known, np.minimum(mean[np.arange(len(best)), best], 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch[f"k{i}"] for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score)], names=[*(f"k{i}" for i in range(len(keep))), "lang_pred", "score"])

    out = source.mapInArrow(task, schema)
    return out.toDF(*keep, names["lang_pred"], names["score"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; a null doc_id is not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify(docs, train(docs), keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
