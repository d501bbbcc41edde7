"""Phrase collocations by prefix-free parsing.

A text is a sequence of words and of marks where pieces end. It is cut where the hash of the last four tokens is a multiple of
SPACING: equal passages are cut alike, wherever they stand, so the distinct chunks form a dictionary with the numbers of their
occurrences. A chunk begins with the last four tokens of the one before, marks at a text's start, and a phrase is counted in the chunk in
which its last word is new: inside that chunk it stands whole, and in no other chunk is it counted.

Phrases are counted in the dictionary alone, weighted, one length after the other: a phrase can be frequent only if what it is without
its last word and what it is without its first word are. A phrase goes by the numbers of these two, which makes its key exact
given theirs, and its words, the counts of its beginnings and of its ends come from them by two joins.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, releasing, strings, union_all

LONGEST, LEAST, TOP = 5, 100, 2000
#: Tokens between two cuts, on average.
SPACING = 64
#: Distinct words that a task holds before it reports them; tokens looked at together; phrases summed up together.
WORDS, TOKENS, PHRASES = 1 << 18, 1 << 19, 1 << 22
#: Bits of a filter of frequent phrases: eight megabytes, whatever the corpus. On more phrases than it can tell apart it lets more through.
FILTER_BITS = 1 << 26

_MARK = b"."
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _MARK * 10)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers of the phrases whose beginnings and ends, a word shorter, have these numbers."""
    return _mix(_mix(first * _A) ^ second)


def digests(tokens: list[bytes]) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, tokens)), np.uint64)


def language_digest(lang: str) -> np.uint64:
    return digests([b" " + lang.encode()])[0]


_MARK_DIGEST = digests([_MARK])[0]


def tokens(raw: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased, and a mark at each place where a piece ends."""
    return raw.lower().translate(_PIECES).replace(_MARK, b" . ").split() if raw else []


def chunks(words: list[bytes], overlap: int, spacing: int) -> Iterator[bytes]:
    """The text's chunks, tokens joined by blanks, each with ``overlap`` tokens of the one before."""
    padded = [_MARK] * overlap + words
    h = digests(words)
    rolled = np.zeros(max(0, len(words) - overlap + 1), np.uint64)
    for j in range(overlap):
        rolled = _mix(rolled * _A + h[j : j + len(rolled)])
    cuts = np.flatnonzero(rolled % np.uint64(spacing) == 0) + overlap
    begin = 0
    for end in [*cuts[cuts < len(words)].tolist(), len(words)]:
        yield b" ".join(padded[begin : end + overlap])
        begin = end


def parse(docs: DataFrame, overlap: int, spacing: int) -> DataFrame:
    """The dictionary: lang, chunk, and freq, the number of its occurrences in all texts of the language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                lang, raw = (batch.column(c).slice(at, 256).to_pylist() for c in ("lang", "raw"))
                found = [(own, c.decode()) for own, text in zip(lang, raw, strict=True) if (words := tokens(text)) for c in chunks(words, overlap, spacing)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], names=["lang", "chunk"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(releasing(work), "lang string, chunk string").groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("freq"))


def _words(dictionary: DataFrame, overlap: int) -> DataFrame:
    """lang, word, f over all chunks' new words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def report() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.pop(_MARK, None)
                words = pa.array([w.decode() for w in counts], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), words, pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "c"])
            held.clear()

        for batch in batches:
            for lang, chunk, freq in zip(batch.column("lang").to_pylist(), strings(batch.column("chunk")), batch.column("freq").to_pylist(), strict=True):
                new, own = chunk.encode().split()[overlap:], held[lang]
                if freq == 1:
                    own.update(new)
                else:
                    for word, n in Counter(new).items():
                        own[word] += n * freq
                if len(own) > WORDS:
                    yield from report()
        yield from report()

    return dictionary.mapInArrow(releasing(work), "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("a"))


def _numbered(frequent: DataFrame) -> DataFrame:
    """Frequent words (lang, word, a) with their number, as level 1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, word = batch.column("lang").to_pylist(), batch.column("word").to_pylist()
            of = {x: language_digest(x) for x in set(lang)}
            number = _mix(digests([w.encode() for w in word]) ^ np.array([of[x] for x in lang], np.uint64))
            yield batch.append_column("id", pa.array(number.view(np.int64)))

    rows = frequent.mapInArrow(releasing(work), "lang string, word string, a long, id long")
    none = F.array().cast("array<long>")
    return rows.select("id", "lang", "a", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("begins"), none.alias("ends"))


def _filter(level: DataFrame):
    """A broadcast bit field of FILTER_BITS, set for the numbers of a level's phrases."""
    word = F.expr(f"cast(pmod(id, {FILTER_BITS}) div 64 as int)")
    bit = F.expr("shiftleft(1L, cast(pmod(id, 64) as int))")
    rows = level.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    field = np.zeros(FILTER_BITS // 64, np.int64)
    field[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return level.sparkSession.sparkContext.broadcast(field.view(np.uint64))


def _holds(field: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = numbers & np.uint64(64 * len(field) - 1)
    return (field[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _longer(dictionary: DataFrame, filters: list, overlap: int, least: int) -> DataFrame:
    """begin, end, id, a of the frequent phrases that are one word longer than those of the last of ``filters``."""

    def phrases(rows: list[tuple[str, str, int]], seeds: dict[str, np.uint64]) -> tuple[np.ndarray, ...]:
        """Beginning, end and weight of every phrase whose parts may be frequent and whose last word is new in its chunk."""
        split = [chunk.encode().split() for _, chunk, _ in rows]
        n = np.array([len(x) for x in split])
        h = digests([t for x in split for t in x])
        number = _mix(h ^ np.repeat(np.array([seeds[lang] for lang, _, _ in rows], np.uint64), n))
        at = np.flatnonzero((h != _MARK_DIGEST) & _holds(filters[0].value, number))
        number = number[at]
        for field in [*filters[1:], None]:
            beside = np.flatnonzero(at[1:] == at[:-1] + 1)
            begin, end, at = number[beside], number[beside + 1], at[beside + 1]
            if field is not None:
                number = joined(begin, end)
                fine = _holds(field.value, number)
                number, at = number[fine], at[fine]
        starts = np.cumsum(n) - n
        chunk = np.searchsorted(starts, at, "right") - 1
        new = at - starts[chunk] >= overlap
        return begin[new], end[new], np.array([freq for _, _, freq in rows], np.int64)[chunk[new]]

    def summed(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        begin, end, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(begin):
            order = np.argsort(joined(begin, end))
            begin, end = begin[order], end[order]
            starts = np.flatnonzero(np.r_[True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])])
            columns = [pa.array(begin[starts].view(np.int64)), pa.array(end[starts].view(np.int64)), pa.array(np.add.reduceat(weight[order], starts))]
            yield pa.RecordBatch.from_arrays(columns, names=["begin", "end", "c"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: dict[str, np.uint64] = {}
        rows: list[tuple[str, str, int]] = []
        parts: list[tuple[np.ndarray, ...]] = []
        size = held = 0
        for batch in batches:
            for row in zip(batch.column("lang").to_pylist(), strings(batch.column("chunk")), batch.column("freq").to_pylist(), strict=True):
                if row[0] not in seeds:
                    seeds[row[0]] = language_digest(row[0])
                rows.append(row)
                size += len(row[1])
                if size >= 4 * TOKENS:
                    parts.append(phrases(rows, seeds))
                    held += len(parts[-1][0])
                    rows, size = [], 0
                    if held >= PHRASES:
                        yield from summed(parts)
                        parts, held = [], 0
        if rows:
            parts.append(phrases(rows, seeds))
        if parts:
            yield from summed(parts)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = joined(*(batch.column(c).to_numpy().view(np.uint64) for c in ("begin", "end")))
            yield batch.append_column("id", pa.array(own.view(np.int64)))

    counted = dictionary.mapInArrow(releasing(work), "begin long, end long, c long").groupBy("begin", "end").agg(F.sum("c").alias("a")).filter(F.col("a") >= least)
    return counted.mapInArrow(releasing(number), "begin long, end long, a long, id long")


def _scored(level: DataFrame, n: int) -> DataFrame:
    """The lowest-scoring cut of each phrase of ``n`` words; ``total`` is the language's number of words."""
    big = lambda c: c.cast("decimal(38,0)")  # noqa: E731  products of counts may pass 64 bits

    def cut(k: int) -> Column:
        left, right = F.element_at("begins", k), F.element_at("ends", n - k)
        score = F.call_function("div", big(F.lit(1000)) * big(F.col("a")) * big(F.col("total")), big(left) * big(right))
        return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    best = F.array_min(F.array(*[cut(k) for k in range(1, n)]))
    return level.withColumn("cut", best).select("id", "lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, spacing: int = SPACING, scratch: Scratch | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` words.

    Texts (null: empty) are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs. Per lang (null:
    ``und``), n counts all words, a a phrase's occurrences within pieces, overlapping ones included; candidates have a >= ``least``. Cutting a
    candidate after k words gives l and r, the occurrences of its two parts, and floor(1000 a n / (l r)); the least such score counts,
    ties to the smallest k. A candidate inside a longer one of as many occurrences goes. Order: score and a descending, then the
    phrase by its bytes. Rows repeated count as often as they stand; only text and lang are read; an empty table gives no rows.
    Words are told apart by 64 bits, phrases by 128 of their parts.
    """
    if not 2 <= longest or least < 1:
        raise ValueError("phrases have two words at least and occur once at least")
    scratch, overlap = scratch or Scratch(docs.sparkSession, "phrases"), longest - 1
    dictionary = scratch.save(parse(docs, overlap, spacing), "dictionary")
    words = scratch.save(_words(dictionary, overlap), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("total"))
    level = scratch.save(_numbered(words.filter(F.col("a") >= least)).join(totals, "lang"), "level")
    filters, found, gone = [], [], []
    for n in range(2, longest + 1):
        filters.append(_filter(level))
        longer = scratch.save(_longer(dictionary, filters, overlap, least), "counted")
        side = lambda key, *own: level.select(F.col("id").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in own])  # noqa: B023, E731
        both = longer.join(side("begin", "a", "lang", "total", "phrase", "begins"), "begin").join(side("end", "a", "last", "ends"), "end")
        level = both.select(
            "id", F.col("begin_lang").alias("lang"), F.col("begin_total").alias("total"), "a", F.concat_ws(" ", "begin_phrase", "end_last").alias("phrase"), F.col("end_last").alias("last"),
            F.array_append("begin_begins", F.col("begin_a")).alias("begins"), F.array_append("end_ends", F.col("end_a")).alias("ends"), "begin", "end", "begin_a", "end_a",
        )
        level = scratch.save(level, "level")
        found.append(_scored(level, n))
        if n > 2:
            # a phrase inside a longer one of its frequency is so inside one that is a single word longer
            gone += [level.filter(F.col("a") == F.col(f"{part}_a")).select(F.col(part).alias("id")) for part in ("begin", "end")]
    kept = union_all(found)
    if gone:
        kept = kept.join(scratch.save(union_all(gone).distinct(), "gone"), "id", "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
