"""Toxicity by class-conditional Kneser-Ney models.

Words, with marks at both ends, are sequences of bytes. In each class a byte
follows the bytes before it with an absolutely discounted probability from
the class's own counts; the discounted mass goes to one distribution that
both classes share, an interpolated Kneser-Ney model of the pooled
continuation counts. A word that neither class knows well is thus explained
by the same shared counts in both and says little, one that only toxic texts
use says much. A text is judged by the toxic minus the ordinary
log-likelihood, normalised by length, over the whole text, over its worst
windows and over its strongest words, and by how many words speak clearly for
toxic. A word counts up to a limit, so that several words of some weight say
as much as one that no ordinary text has. The calibration sees every labelled
text through counts that have not seen it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import tokens
from quernel.llm.scratch import Scratch

#: Bytes of a gram: seven and its length fill a 64-bit integer.
ORDER = 7
DISCOUNT = 0.95
WINDOWS = (8, 64)
#: Numbers of strongest words, the most that a word counts, and the ratio from which it speaks clearly for toxic.
STRONGEST, LIMIT, CLEAR = (3, 8), 5.0, 2.5
WIDTH = 5 + len(WINDOWS) + len(STRONGEST)
#: Parts of the labelled texts: each is calibrated on counts of the others.
FOLDS = 4
START, STOP = 0x20, 0x0A
_U = np.uint64


def distinct_words(ws: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct word, the distinct word of each occurrence)."""
    _, at, back = np.unique(ws.hashes, return_index=True, return_inverse=True)
    return at, back


def grams_of(ws: tokens.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest gram of every byte place of the chosen words and the end mark: (gram, word, place).

    A gram is up to ORDER bytes in a 64-bit integer, the last lowest, with its
    length in the highest byte. It reaches back to the word's start mark at most.
    """
    lengths = ws.ends[at] - ws.starts[at] + 1
    word = np.repeat(np.arange(len(at)), lengths)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(word)) - first[word]
    src = ws.starts[at][word] + place
    last = place == lengths[word] - 1
    byte = np.where(last, STOP, ws.data[np.minimum(src, len(ws.data) - 1)]).astype(_U)
    gram = byte.copy()
    for back in range(1, ORDER):
        j = place - back
        prior = np.where(j >= 0, ws.data[np.maximum(src - back, 0)], START).astype(_U)
        gram |= np.where(j >= -1, prior << _U(8 * back), _U(0))
    order = np.minimum(place + 2, ORDER).astype(_U)
    return gram | (order << _U(56)), word, place


def shorter(gram: np.ndarray) -> np.ndarray:
    """Grams without their first byte."""
    order = (gram >> _U(56)) - _U(1)
    return (gram & ((_U(1) << (order * _U(8))) - _U(1))) | (order << _U(56))


def context(gram: np.ndarray) -> np.ndarray:
    """Grams without their last byte."""
    return ((gram & _U(0x00FFFFFFFFFFFFFF)) >> _U(8)) | (((gram >> _U(56)) - _U(1)) << _U(56))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float = 0.0) -> np.ndarray:
    if not len(keys):
        return np.full(wanted.shape, missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def _grouped(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    u, back = np.unique(keys, return_inverse=True)
    return u, *[np.bincount(back, w, len(u)) for w in weights]


@dataclass
class Model:
    """Sorted grams with their log-likelihood ratios, sorted contexts with those of an unseen byte, and the calibration."""

    grams: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray
    unseen: np.ndarray
    weights: np.ndarray | None = None

    @classmethod
    def fit(cls, grams: np.ndarray, toxic: np.ndarray, plain: np.ndarray) -> Model:
        """From the longest grams of the training words and how often each class has them."""
        grams, toxic, plain = _grouped(grams, toxic, plain)
        # shared continuation counts: a shorter gram counts its distinct extensions to the left
        levels = {}
        now = grams
        for order in range(ORDER - 1, 0, -1):
            longer = now[(now >> _U(56)) == _U(order + 1)]
            # longest grams of this order end at the word's start: they extend by nothing and count once
            own = grams[(grams >> _U(56)) == _U(order)]
            levels[order] = _grouped(np.concatenate([shorter(longer), own]), np.ones(len(longer) + len(own)))
            now = levels[order][0]
        # Kneser-Ney probabilities of the last byte given the others, from the shortest grams up; every shorter gram is in its level
        shared = {}
        for order, (keys, n) in sorted(levels.items()):
            _, back, types = np.unique(context(keys), return_inverse=True, return_counts=True)
            lower = _lookup(*shared[order - 1], shorter(keys)) if order > 1 else 1 / 256
            shared[order] = keys, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * types[back] * lower) / np.bincount(back, n, len(types))[back] if len(keys) else n

        ctx = context(grams)
        below = np.empty(len(grams))
        for order in range(1, ORDER + 1):
            at = np.flatnonzero((grams >> _U(56)) == _U(order))
            below[at] = _lookup(*shared[max(order - 1, 1)], shorter(grams[at]) if order > 1 else grams[at])
        contexts, n_toxic, n_plain, k_toxic, k_plain = _grouped(ctx, toxic, plain, (toxic > 0).astype(float), (plain > 0).astype(float))

        def log_p(c, total, types):
            t, k = _lookup(contexts, total, ctx), _lookup(contexts, types, ctx)
            return np.log(np.where(t > 0, (np.maximum(c - DISCOUNT, 0) + DISCOUNT * k * below) / np.where(t > 0, t, 1), below))

        def log_rest(total, types):
            return np.log(np.where(total > 0, DISCOUNT * types / np.where(total > 0, total, 1), 1.0))

        ratios = log_p(toxic, n_toxic, k_toxic) - log_p(plain, n_plain, k_plain)
        return cls(grams, ratios, contexts, log_rest(n_toxic, k_toxic) - log_rest(n_plain, k_plain))

    def word_ratios(self, ws: tokens.Words) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of every word."""
        if not len(ws.starts):
            return np.zeros(0)
        at, back = distinct_words(ws)
        gram, word, _ = grams_of(ws, at)
        each = _lookup(self.grams, self.ratios, gram, np.nan)
        each = np.where(np.isnan(each), _lookup(self.contexts, self.unseen, context(gram)), each)
        return np.bincount(word, each, len(at))[back]

    def features(self, ws: tokens.Words) -> np.ndarray:
        """Of each text: 1, the ratio per word over the whole text and its worst windows, the most that any word says, the means of its strongest words, and how many are clear, as a logarithm and by the root of the length; 0 without words."""
        ratios, n = self.word_ratios(ws), len(ws.first) - 1
        out = np.zeros((n, WIDTH))
        out[:, 0] = 1
        counts = np.diff(ws.first)
        some = np.flatnonzero(counts)
        if not len(some):
            return out
        limited = np.minimum(ratios, LIMIT)
        total = np.concatenate([[0], np.cumsum(limited)])
        out[:, 1] = (total[ws.first[1:]] - total[ws.first[:-1]]) / np.maximum(counts, 1)
        doc = np.repeat(np.arange(n), counts)
        place = np.arange(len(ratios))
        for j, size in enumerate(WINDOWS):
            end = np.minimum(place + size, ws.first[1:][doc])
            begin = np.maximum(end - size, ws.first[:-1][doc])
            sums = (total[end] - total[begin]) / size
            out[some, 2 + j] = np.maximum.reduceat(sums, ws.first[:-1][some])
        at = 2 + len(WINDOWS)
        out[some, at] = np.maximum(np.maximum.reduceat(ratios, ws.first[:-1][some]), 0)
        # words that speak for toxic, the strongest of each text first
        bad = np.flatnonzero(ratios > 0)
        bad = bad[np.lexsort((-ratios[bad], doc[bad]))]
        rank = np.arange(len(bad)) - np.searchsorted(doc[bad], doc[bad])
        for j, k in enumerate(STRONGEST):
            best = bad[rank < k]
            out[:, at + 1 + j] = np.bincount(doc[best], limited[best], n) / k
        clear = np.bincount(doc, ratios > CLEAR, n)
        out[:, -2], out[:, -1] = np.log1p(clear), clear / np.sqrt(np.maximum(counts, 1))
        return out

    def score(self, ws: tokens.Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(ws) @ self.weights, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the ordinary and the toxic texts of each fold have each gram."""
    for batch in batches:
        part = 2 * batch.column("fold").to_numpy() + batch.column("toxic").to_numpy()
        for lo, hi, data, offsets in tokens.text_slices(batch.column("text")):
            ws = tokens.words_of(data, offsets)
            if not len(ws.starts):
                continue
            at, back = distinct_words(ws)
            of_word = np.bincount(back * 2 * FOLDS + np.repeat(part[lo:hi], np.diff(ws.first)), minlength=len(at) * 2 * FOLDS).reshape(len(at), 2 * FOLDS)
            gram, word, _ = grams_of(ws, at)
            keys, *sums = _grouped(gram, *(of_word[word, j] for j in range(2 * FOLDS)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[pa.array(x.astype(np.int64)) for x in sums]], ["gram", *_PARTS])


_PARTS = [f"{kind}{fold}" for fold in range(FOLDS) for kind in ("plain", "toxic")]


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_docs: int = 20_000,
    max_bytes: int = 32 << 20,
    scratch: Scratch | None = None,
) -> Model:
    """A model from a sample of the labelled texts: about ``max_docs`` of them and ``max_bytes`` in all at most.

    Both bounds are documented ones of the sample that the classifier is
    fitted on. Where more is labelled, the ids with the smallest hashes are
    taken, and of their texts those with the smallest hashes of text, so that
    an id with very many texts cannot exceed them; texts over a sixteenth of
    ``max_bytes`` are not learned from. What comes to the driver, distinct
    grams of at most seven bytes (not more than the sample has bytes and ends
    of words) and a few numbers per text, is bounded by these. Each of FOLDS
    parts is calibrated on counts of the others; the model's counts are those
    of all. Labels that are null, and ids that are null or repeated among the
    labels with both values, are not used. Without texts of both classes every
    text scores the share of toxic labels.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "toxicity")
    marks = labels.select(F.col(f"`{doc_id}`").alias("l_id"), F.col(f"`{label}`").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND l_id IS NOT NULL").groupBy("l_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    n = marks.count()
    spot = F.pmod(F.xxhash64("l_id"), F.lit(1 << 20))
    chosen = marks.filter(spot < (1 << 20) * min(1.0, max_docs / max(n, 1))).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "l_id"), F.lit(FOLDS)))
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # chosen has about max_docs rows at most, so it is broadcast; the texts are read once and kept as a table
    rows = own.join(F.broadcast(chosen), own.doc_id == chosen.l_id).select("text", "toxic", "fold").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes // 16)
    rows = scratch.keep(rows.repartition(spark.sparkContext.defaultParallelism))
    size, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).head()
    share = min(1.0, max_bytes / max(size, 1), max_docs / max(n_rows, 1))
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("text"), "text"), F.lit(1 << 20)) < int((1 << 20) * share))
    counted = rows.mapInArrow(_count, "gram long, " + ", ".join(f"{p} long" for p in _PARTS)).groupBy("gram").agg(*[F.sum(p).cast("int").alias(p) for p in _PARTS]).toArrow()
    grams = counted.column("gram").to_numpy().view(_U)
    order = np.argsort(grams)
    grams, parts = grams[order], [counted.column(p).to_numpy()[order] for p in _PARTS]
    del counted, order

    def fitted(folds: list[int]) -> Model:
        plain, toxic = (sum(parts[2 * f + j] for f in folds) if folds else np.zeros(len(grams), np.int32) for j in (0, 1))
        some = np.flatnonzero(plain + toxic)
        return Model.fit(grams[some], toxic[some].astype(float), plain[some].astype(float))

    found = [_calibration(rows.filter(F.col("fold") == f), fitted([g for g in range(FOLDS) if g != f])) for f in range(FOLDS)]
    x, y = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
    model = fitted(list(range(FOLDS)))
    if 0 < y.sum() < len(y):
        order = np.lexsort((y, *x.T))
        model.weights = calibrate(x[order], y[order])
    else:
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.001
        model.weights = np.array([np.log(share / (1 - share)), *[0.0] * (WIDTH - 1)])
    return model


def _calibration(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Features under the model, and the label, of each row; the model goes from the executors when they are here."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tokens.text_slices(batch.column("text")):
                x = shared.value.features(tokens.words_of(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(lo, hi - lo), *[pa.array(x[:, j].copy()) for j in range(WIDTH)]], ["toxic", *[f"x{j}" for j in range(WIDTH)]])

    got = rows.select("text", "toxic").mapInArrow(features, "toxic int, " + ", ".join(f"x{j} double" for j in range(WIDTH))).toArrow()
    shared.destroy()
    return np.stack([got.column(f"x{j}").to_numpy() for j in range(WIDTH)], axis=1).reshape(-1, WIDTH), got.column("toxic").to_numpy().astype(float)


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id and score from 0 to 1.

    Null and empty texts get the score of a text without evidence. Ids may be
    null or repeated; rows are scored one by one, by their text alone. Other
    columns are ignored. A very long text is scored whole. An empty table gives
    an empty result. The model,
    whose size ``train`` bounds, is broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tokens.text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(shared.value.score(tokens.words_of(data, offsets)))], ["doc_id", "score"])

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, below: float, text: str = "text") -> DataFrame:
    """The rows whose texts score less than ``below``, with all their columns.

    Rows are scored and kept one by one, in place: nothing is shuffled or
    joined, and only texts go to Python, from which a score comes back. Null
    and empty texts, null and repeated ids are rows like others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [shared.value.score(tokens.words_of(data, offsets)) for _, _, data, offsets in tokens.text_slices(texts, 1 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.filter(score(F.col(f"`{text}`")) < below)
