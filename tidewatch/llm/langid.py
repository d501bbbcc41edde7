"""Language ID in two steps: the family first, then one-versus-one linear machines within it.

Features are a text's character n-grams of one to three letters, hashed and counted; as all machines are linear, a word
adds a fixed vector to each machine's margin, and a worker remembers it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, fold_id, strings, with_ids

#: Labelled documents that the machines are fitted on: of a language, and of all, at most.
FIT_ROWS, FIT_TOTAL = 400, 20_000
#: How many times as many candidates as needed a hash lets through, so that no task ranks a whole language.
SPARE = 8
DIMS = 4096
REMEMBERED = 300_000
UNKNOWN = "und"
#: Letters stay, other ASCII becomes a space.
KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indo-iranian": ("bn", "fa", "gu", "hi", "mr", "ne", "pa", "ur"),
}
TYPES = {"lang_pred": pa.string(), "score": pa.float64()}
SCHEMA = "doc_id long, lang_pred string, score double"


def family(lang: str) -> str:
    code = lang.lower().split("-")[0].split("_")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes), lang)


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(KEEP).split()


def has_letter(text: str, found: list[bytes]) -> bool:
    return any(word[:1].isalpha() for word in found) or any(c.isalpha() for c in text)


def grams(word: bytes) -> list[int]:
    """Hashed n-grams of one to three characters of the word between spaces."""
    s = f" {word.decode('utf-8', 'replace')} "
    return [zlib.crc32(s[i : i + n].encode()) % DIMS for n in (1, 2, 3) for i in range(len(s) - n + 1)]


def machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and constant of a linear support vector machine (squared hinge), by accelerated gradient steps; y is -1 or 1."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    top = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest curvature
        top = x.T @ (share * (x @ top))
        top /= np.linalg.norm(top) or 1
    step = 1 / (2 * float(top @ (x.T @ (share * (x @ top)))) + penalty)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for i in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead)).astype(np.float32)
        new = ahead - step * (penalty * ahead - 2 * x.T @ (share * slack * y))
        ahead, w = new + i / (i + 3) * (new - w), new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Languages by family, and one column of weights for every machine: families against the rest, then pairs."""

    families: dict[str, list[str]]
    machines: list[tuple] = field(default_factory=list)
    weights: np.ndarray | None = None
    constants: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((1024, 0 if self.weights is None else self.weights.shape[1] + 1), np.float32)

    def margins(self, found: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.__post_init__()
        known = self.known
        for word in {w for w in found if w not in known}:
            if len(known) == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            at = grams(word)
            self.rows[len(known), :-1] = self.weights[at].sum(axis=0)
            self.rows[len(known), -1] = len(at)
            known[word] = len(known)
        index = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        total = np.zeros(self.rows.shape[1])
        for at in range(0, len(index), 1 << 16):  # a long text in pieces
            total += self.rows[index[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return total[:-1] / max(1.0, total[-1]) + self.constants

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text) if text else []
        if not found or not self.families or not has_letter(text, found):
            return UNKNOWN, 0.0
        margin = dict(zip(self.machines, self.margins(found).tolist(), strict=True)) if self.machines else {}
        sure = lambda m: 1 / (1 + float(np.exp(-2 * np.clip(m, -50, 50))))
        best = max(self.families, key=lambda f: margin.get((f,), 0.0))
        score = sure(margin[best,]) if (best,) in margin else 1.0
        votes = {lang: [0, 0.0] for lang in self.families[best]}
        for a, b in combinations(self.families[best], 2):
            m = margin[a, b]
            for lang, s in ((a, m), (b, -m)):
                votes[lang][0] += s > 0
                votes[lang][1] += s
        lang = max(votes, key=lambda x: (*votes[x], x))
        pairs = [m if a == lang else -m for (a, b), m in ((k, m) for k, m in margin.items() if len(k) == 2) if lang in (a, b)]
        return lang, score * sure(min(pairs)) if pairs else score


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, scratch: Scratch | None = None) -> Model:
    """Fit on documents with a lang whose fold_id(doc_id, 4) is not 2, chosen by a hash of the id.

    At most ``fit_rows`` a language and FIT_TOTAL in all, evenly; with more languages than that, those that come first by a
    hash of their name. Null texts, langs and ids and texts without a letter are left out.
    """
    scratch = scratch or Scratch(docs.sparkSession, "langid")
    able = docs.filter("doc_id is not null and lang is not null and text is not null").filter(fold_id(F.col("doc_id"), 4) != 2).select("doc_id", "lang")
    # a row a language, FIT_TOTAL at most
    per = scratch.save(able.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.xxhash64("lang"), "lang").limit(FIT_TOTAL), "langs")
    most = max(1, min(fit_rows, FIT_TOTAL // max(1, per.count())))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.col("rows") < SPARE * most * (1 << 20)
    chosen = able.join(F.broadcast(per), "lang").filter(few).select("doc_id", "lang").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).drop("nth")
    # FIT_TOTAL ids
    sample = F.broadcast(scratch.save(chosen, "sample"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in strings(batch.column("text")):
                found = words(text)
                bins = np.bincount(np.array([k for w in found for k in grams(w)] if has_letter(text, found) else [], np.int64), minlength=DIMS)
                k = np.flatnonzero(bins)
                rows.append((k.astype(np.int32), bins[k].astype(np.int32)))
            out = with_ids(batch, rows, {"k": pa.list_(pa.int32()), "n": pa.list_(pa.int32())})
            yield out.append_column("lang", batch.column("lang"))

    texts = docs.filter("text is not null").select("doc_id", "text").join(sample, "doc_id").select("doc_id", "text", "lang")
    rows = texts.mapInArrow(count, "doc_id long, k array<int>, n array<int>, lang string").filter("size(k) > 0").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    langs = rows.column("lang").to_pylist()
    x = np.zeros((len(langs), DIMS), np.float32)
    for i, (k, n) in enumerate(zip(rows.column("k"), rows.column("n"), strict=True)):
        n = n.values.to_numpy().astype(np.float32)
        x[i, k.values.to_numpy()] = n / n.sum()
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family(lang), []).append(lang)
    machines: list[tuple] = [(f,) for f in families if len(families) > 1]
    machines += [pair for members in families.values() for pair in combinations(members, 2)]
    if not machines:
        return Model(families)
    spread = x.std(axis=0) + 1e-4
    x = x / spread / np.sqrt(DIMS)
    of = np.array([family(lang) for lang in langs])
    langs = np.array(langs)
    weights, constants = [], []
    for m in machines:
        rows_of = np.ones(len(x), bool) if len(m) == 1 else (langs == m[0]) | (langs == m[1])
        y = np.where((of if len(m) == 1 else langs)[rows_of] == m[0], 1, -1).astype(np.float32)
        w, c = machine(x[rows_of], y)
        weights.append(w / spread / np.sqrt(DIMS))
        constants.append(c)
    return Model(families, machines, np.column_stack(weights).astype(np.float32), np.array(constants))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text.

    Null texts and texts without a letter are ``und`` with score 0, as all are when nothing was learned. Repeated rows each
    give their row; an empty table gives none; columns other than doc_id and text are ignored. One map over the rows.
    """
    # a column of DIMS floats for every machine
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_ids(batch, [cast.value.predict(text) for text in strings(batch.column("text"))], TYPES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SCHEMA)


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by machines fitted on its labelled rows."""
    found = predict(docs, fit(docs, fit_rows))
    return found.select("doc_id", (fold_id(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
