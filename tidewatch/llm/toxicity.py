"""Toxicity by maximum-scoring segments.

Tokens get log-odds of standing in a toxic document, with Dirichlet priors: a word's prior is the odds of its six-byte
prefix, whose prior is that of a shorter prefix, and so on to the corpus. Less a drift, a benign text's tokens sum
downwards, and a linear scan finds every maximal-scoring passage. Under the extreme-value law a passage of score S in a text
of n tokens is expected K n exp(-lambda S) times by chance; significant passages are added up and calibrated to a
probability.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold_id, releasing, strings, with_ids

#: Labelled documents that a model is fitted on, at most; a quarter of them calibrates and is not counted.
FIT_ROWS = 20_000
#: Token features hash into so many counters: the size of the model.
BUCKETS = 1 << 20
PRIOR, DRIFT, EVALUE = 4.0, 1.5, 0.05
#: Passages expected less often than this add to a text's score; those below EVALUE are significant by themselves.
COUNTS = 1.0
THRESHOLD = 0.7
#: Rows that a filter passes on together.
SLICE = 512
#: Words whose score a worker remembers.
REMEMBERED = 150_000
#: Letters and digits stay, other ASCII becomes a space; bytes of other characters stay.
KEEP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
BINS = np.arange(-8.0, 12.01, 0.25)

SCHEMA = "doc_id long, score double, n_passages long, passages array<struct<start:int,end:int,evalue:double>>"
TYPES = {"score": pa.float64(), "n_passages": pa.int64(), "passages": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evalue", pa.float64())]))}


def tokens(text: str) -> list[bytes]:
    """Lower-cased runs of letters and digits, in UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(KEEP).split()


def features(word: bytes) -> tuple[int, int, int, int]:
    """Counters of the word and its prefixes of six, five and four bytes."""
    return zlib.crc32(b"w" + word) % BUCKETS, zlib.crc32(b"6" + word[:6]) % BUCKETS, zlib.crc32(b"5" + word[:5]) % BUCKETS, zlib.crc32(b"4" + word[:4]) % BUCKETS


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal-scoring segments, in order of start, in time linear in the scores.

    Every candidate keeps the sums before it and up to its end, and a pointer to the nearest earlier candidate with a
    smaller sum before it. A new positive run joins that one if it lifts the sum, and takes in all between.
    """
    positive = scores > 0
    if not positive.any():
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], positive.view(np.int8), [0]))))
    start, end, left, right, link = [], [], [], [], []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        low, high = float(sums[a]), float(sums[b])
        while True:
            j = len(start) - 1
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= high:
                break
            a, low = start[j], left[j]
            for column in (start, end, left, right, link):
                del column[j:]
        start.append(a), end.append(b), left.append(low), right.append(high), link.append(j)
    return [(a, b, r - x) for a, b, x, r in zip(start, end, left, right, strict=True)]


@dataclass
class Model:
    """Counters of toxic and all tokens, the extreme-value constants, and the calibration's weights."""

    toxic: np.ndarray
    every: np.ndarray
    base: float
    rate: float = 1.0
    scale: float = 0.1
    weights: tuple[float, float, float] = (-4.0, 0.5, 1.0)

    def __post_init__(self) -> None:
        self.known: dict[bytes, float] = {}

    def word_score(self, word: bytes) -> float:
        odds = self.base
        for k in reversed(features(word)):
            odds = (float(self.toxic[k]) + PRIOR * odds) / (float(self.every[k]) + PRIOR)
        return math.log(odds / (1 - odds)) - math.log(self.base / (1 - self.base)) - DRIFT

    def token_scores(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for word in {w for w in words if w not in known}:
            known[word] = self.word_score(word)
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def evalue(self, score: float, n: int) -> float:
        return self.scale * n * math.exp(-min(700.0, self.rate * score))

    def passages(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(start, end, expected number by chance) of the passages that count, in tokens."""
        found = [(a, b, self.evalue(s, len(words))) for a, b, s in maximal_segments(self.token_scores(words))]
        return [x for x in found if x[2] <= COUNTS]

    @staticmethod
    def summary(passages: list[tuple[int, int, float]]) -> tuple[float, float]:
        """What the calibration reads: surprise of the best passage and of all together."""
        surprise = [-math.log(max(e, 1e-300) / COUNTS) for *_, e in passages]
        return math.log1p(max(surprise, default=0.0)), math.log1p(sum(surprise))

    def probability(self, passages: list[tuple[int, int, float]]) -> float:
        best, total = self.summary(passages)
        z = self.weights[0] + self.weights[1] * best + self.weights[2] * total
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression, the constant first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (p - y) + keep @ w)
    return w


def gumbel(bins: np.ndarray, best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and K from the background's token scores (a histogram over BINS) and its documents' best segments."""
    share, mids = bins / max(1, bins.sum()), BINS
    if not (share[mids > 0].sum() > 0 and (share * mids).sum() < 0):
        return 1.0, 0.1
    low, high = 1e-6, 1.0
    while (share * np.exp(high * mids)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(mid * mids)).sum() < 1 else (low, mid)
    rate = min(max(low, 0.2), 3.0)
    seen = best > 0
    # the mean of a Gumbel variable stands Euler's constant above its mode
    scale = math.exp(float(np.mean(rate * best[seen] - np.log(n[seen]))) - 0.5772156649) if seen.any() else 0.1
    return rate, min(max(scale, 1e-4), 1.0)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, scratch: Scratch | None = None) -> Model:
    """Fit on labelled rows whose fold_id(doc_id, 3) is not 1, at most ``fit_rows`` of them, chosen by a hash of the id.

    A document labelled more than once counts as toxic if any label says so; null labels and ids are left out. Without
    toxic or without benign rows the model scores every text the same, low.
    """
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    sample = (
        labels.filter("doc_id is not null and toxic is not null")
        .filter(fold_id(F.col("doc_id"), 3) != 1)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
        .withColumn("calibrates", F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 3) % 4 == 0)
    )
    # bounded by fit_rows
    sample = F.broadcast(scratch.save(sample, "labels"))
    chosen = docs.filter("text is not null").select("doc_id", "text").join(sample, "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, every = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, label in zip(strings(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                at = np.array([k for word in tokens(text) for k in features(word)], np.int64)
                np.add.at(every, at, 1)
                if label:
                    np.add.at(toxic, at, 1)
        k = np.flatnonzero(every)
        yield pa.RecordBatch.from_pydict({"k": k, "t": toxic[k], "n": every[k]})

    # at most BUCKETS rows come to the driver
    counted = chosen.filter("not calibrates").select("text", "toxic").mapInArrow(releasing(count), "k long, t long, n long").groupBy("k").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).toArrow()
    toxic, every = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    k = counted.column("k").to_numpy()
    toxic[k], every[k] = counted.column("t").to_numpy(), counted.column("n").to_numpy()
    if not 0 < toxic.sum() < every.sum():
        return Model(toxic * 0, every, 0.01)
    model = Model(toxic, every, float(np.clip(toxic.sum() / every.sum(), 1e-4, 0.5)))
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in strings(batch.column("text")):
                words = tokens(text)
                scores = cast.value.token_scores(words)
                bins = np.bincount(np.clip(np.rint((scores - BINS[0]) * 4), 0, len(BINS) - 1).astype(int), minlength=len(BINS))
                rows.append((len(words), max((s for *_, s in maximal_segments(scores)), default=0.0), bins))
            yield with_ids(batch, rows, {"n": pa.int64(), "best": pa.float64(), "bins": pa.list_(pa.int64())})

    # at most a quarter of fit_rows, a row of fixed length each
    benign = chosen.filter("calibrates and toxic = 0").select("doc_id", "text").mapInArrow(releasing(measure), "doc_id long, n long, best double, bins array<long>").filter("n > 0").orderBy("doc_id").collect()
    if not benign:
        return model
    model.rate, model.scale = gumbel(np.sum([r.bins for r in benign], axis=0), np.array([r.best for r in benign]), np.array([r.n for r in benign], float))
    model.known = {}
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cast.value.summary(cast.value.passages(tokens(text))) for text in strings(batch.column("text"))]
            yield with_ids(batch, rows, {"best": pa.float64(), "total": pa.float64()}).append_column("toxic", batch.column("toxic"))

    # three numbers a row
    held = chosen.filter("calibrates").select("doc_id", "text", "toxic").mapInArrow(releasing(summarise), "doc_id long, best double, total double, toxic int").orderBy("doc_id", "best", "total").collect()
    if any(r.toxic for r in held):
        model.weights = tuple(logistic(np.array([(r.best, r.total) for r in held]), np.array([float(r.toxic > 0) for r in held])).tolist())
    model.known = {}
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_passages, passages of every whole text.

    Null and empty texts have no passage and the calibration's lowest score. Repeated rows each give their row; an empty
    table gives none; columns other than doc_id and text are ignored. One map over the rows.
    """
    # two arrays of BUCKETS floats
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in strings(batch.column("text")):
                found = cast.value.passages(tokens(text or ""))
                sure = [{"start": a, "end": b, "evalue": e} for a, b, e in found if e <= EVALUE]
                rows.append((cast.value.probability(found), len(sure), sure))
            yield with_ids(batch, rows, TYPES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(work), SCHEMA)


def keep_clean(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the rows that the model rejects: one map over the rows, no join.

    Rows are judged by their own texts, so different texts under one doc_id (or none) stay or go each by itself. Columns
    may have any name and are carried along.
    """
    cast = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), SLICE):  # rows go on some at a time, as they carry whole texts
                part = batch.slice(begin, SLICE)
                keep = [cast.value.probability(cast.value.passages(tokens(text or ""))) < THRESHOLD for text in strings(part.column(at))]
                yield part.filter(pa.array(keep, pa.bool_()))

    # by place, as names may hold dots
    at, places = docs.columns.index("text"), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return places.mapInArrow(releasing(work), places.schema).toDF(*docs.columns)


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of every document, by a model fitted on its labelled rows."""
    scored = score(docs, fit(docs, labels, fit_rows))
    return scored.select(
        "doc_id",
        (fold_id(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "n_passages",
    )
