"""N-gram Jaccard self-join by token-combination prefixes.

A document is the set of its word shingles, its tokens. Tokens are ordered from rare to frequent; a document whose set
may lack t tokens of a partner's needs a prefix that still shares something after t losses. Rare tokens count alone. Frequent
tokens fall into classes of which k tokens together form one index entry, and a class of x prefix tokens counts
x - k + 1, so prefixes extend further into frequent tokens. Two sets similar enough share an index entry.

The sets that share an entry with a set, of which it is the smallest, are its bucket. Within a bucket, parity sketches of the sets bound each pair's difference from below;
the most promising pairs are verified on the texts; what links makes components, and only pairs between components are looked at again, until
none is left unverified. No bucket's pairs are ever written out as rows before the sketches have passed them, and a set that no sketch passes is not looked at
again. Only the texts of sets in passed pairs leave their place.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, quoted, releasing, split_by_ids, strings
from .components import components

#: Frequent tokens that are told apart, at most: the size of the broadcast table.
FREQUENT = 1 << 18
#: Shingles counted together in a task, and how often a token must occur there to be reported as frequent.
COUNTED, OFTEN = 1 << 21, 4
#: Classes of frequent tokens, by hash; tokens of an entry; documents' share from which entries take one token more.
CLASSES, VERY_FREQUENT = 16, 0.02
#: Sizes from which sets have more classes, and how many times as large the next size is.
LARGE, LARGER = 128, 4
#: Bits of a set's sketch: the power of two that is no less than the set's size, between these.
FEWEST_BITS, MOST_BITS = 64, 1 << 14
#: Rows of a bucket's part; two parts are compared in one task.
BLOCK = 1024
#: Rows of groups whose pairs are compared together with other groups'; words of sketches compared at once.
SMALL, WORDS = 64, 1 << 21
#: Buckets of one component that are left out of a round, from this many members on.
CLOSED = 64
#: Shingles that a task verifying pairs remembers, about.
VERIFIED = 1 << 21
#: Pairs that a bucket offers for verification for each of its members, round by round; the last offers all.
OFFERS = (1, 16, None)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``k``-word shingles.

    A-Z are lower-cased; words are runs of other bytes than space and \\x09-\\x0D. Fewer words form one shingle, none no
    shingle.
    """
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
    size = min(k, len(h))
    s = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        s = _mix(s * _A + h[j : len(h) - size + 1 + j])
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def set_id(tokens: np.ndarray, moved: dict[tuple[int, int], int] | None = None) -> int:
    """A signed 64-bit id of the set; ``moved`` gives those of sets whose first digest is another set's too."""
    import xxhash

    own = int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens) & 0xFFFF)).astype(np.int64))
    return moved.get((own, set_check(tokens)), own) if moved else own


def set_check(tokens: np.ndarray) -> int:
    """A second digest: sets are the same if both agree."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes(), seed=7)).astype(np.int64))


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the set's tokens by hash. Two sketches of one width differ in at most as many bits as the sets in tokens.

    A sketch folds to half its width by xor of its halves, so sets of sizes up to twice each other can be compared.
    """
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def losses(n: int, num: int, den: int) -> int:
    """Tokens of a set of ``n`` that a partner may lack."""
    return n - -(-num * n // den)


def small_size(num: int, den: int) -> int:
    """Sets up to this size are indexed by single tokens alone: larger ones always find enough in the classes."""
    return max(32, -(-(CLASSES + 3) * den // num))


def level(n: int, num: int, den: int) -> int:
    """0 for sets of fewer than ``LARGE`` tokens, 1 more for each size ``LARGER`` times as large.

    Below a similarity of a third the classes would take more tokens than partners share, so all sets are of level 0.
    """
    found = 0
    while 3 * num >= den and n >= LARGE * LARGER**found:
        found += 1
    return found


def classes(at: int) -> tuple[int, int]:
    """Classes of two-token and of three-token entries: as many as keep a set's entries in proportion to its size."""
    return CLASSES * LARGER ** max(0, at - 4), 8 * LARGER ** (at - 1) if at else 1


@lru_cache(maxsize=256)
def _choices(n: int, k: int) -> np.ndarray:
    """The combinations of ``k`` of ``n`` places, a row for each place."""
    return np.array(list(itertools.combinations(range(n), k)), np.int64).reshape(-1, k).T


def _prefix_entries(tokens: np.ndarray, k: np.ndarray, need: int, at: int) -> Iterator[np.ndarray]:
    """Entries of the ordered tokens' prefix by the classes of a level; a token stands in entries of ``k`` tokens."""
    pairs, triples = classes(at)
    label = np.where(k == 1, 0, np.where(k == 2, 1 + (tokens % np.uint64(pairs)).astype(np.int64), 1 + pairs + (tokens % np.uint64(triples)).astype(np.int64)))
    by = np.argsort(label, kind="stable")
    starts = np.flatnonzero(np.r_[True, label[by][1:] != label[by][:-1]])
    seen = np.empty(len(tokens), np.int64)
    seen[by] = np.arange(1, len(tokens) + 1) - np.repeat(starts, np.diff(np.r_[starts, len(tokens)]))
    gained = np.cumsum(seen >= k)
    end = int(np.searchsorted(gained, need)) + 1 if gained[-1] >= need else len(tokens)
    tokens, k, label = tokens[:end], k[:end], label[:end]
    yield _mix(tokens[k == 1] ^ _B)
    tokens, label = tokens[k > 1], label[k > 1]
    by = np.lexsort((tokens, label))
    tokens, label = tokens[by], label[by]
    if not len(tokens):
        return
    for own in np.split(tokens, np.flatnonzero(label[1:] != label[:-1]) + 1):
        if label[0] <= pairs:
            a, b = np.triu_indices(len(own), 1)
            yield _mix(_mix(own[a] + _A) + own[b])
        else:
            a, b, d = _choices(len(own), 3)
            yield _mix(_mix(_mix(own[a] + _B) + own[b]) + own[d])
        label = label[len(own) :]


def entries(tokens: np.ndarray, counts: np.ndarray, very: int, num: int, den: int) -> np.ndarray:
    """Index entries of a set: ``counts`` are its tokens' frequencies, 0 for rare ones; from ``very`` on three form an entry.

    A pair goes by the classes of its smaller set's level, so a set has entries by each level that a smaller partner may have.
    """
    n = len(tokens)
    need, out = losses(n, num, den) + 1, []
    small = small_size(num, den)
    rare = tokens[counts == 0]
    if n > -(-small * den // num) and len(rare) >= need:  # the prefix has rare tokens alone; they come sorted
        return _mix(rare[:need] ^ _B)
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    if n <= -(-small * den // num):
        out.append(_mix(tokens[:need] ^ _A))
    if n > small:
        k = np.where(counts == 0, 1, np.where(counts < very, 2, 3))
        for at in range(level(n - losses(n, num, den), num, den), level(n, num, den) + 1):
            out += _prefix_entries(tokens, k, need, at)
    return np.unique(np.concatenate(out)) if out else tokens[:0]


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """Two kinds of rows: (doc_id, n, cls, chk, bits) of every document, and (tok, cnt) of tokens that a task meets often."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "n", "cls", "chk", "bits", "tok", "cnt"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]
        held: list[np.ndarray] = []
        size = 0

        def often() -> Iterator[pa.RecordBatch]:
            tok, cnt = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            tok, cnt = tok[cnt >= OFTEN].view(np.int64), cnt[cnt >= OFTEN]
            none = [pa.nulls(len(tok), kind) for kind in kinds[:5]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(tok), pa.array(cnt, pa.int32())], names=names)

        for batch in batches:
            n, cls, chk, bits = [], [], [], []
            for text in strings(batch.column("text")):
                tokens = shingle_hashes(text, k)
                n.append(len(tokens))
                cls.append(set_id(tokens) if len(tokens) else None)
                chk.append(set_check(tokens) if len(tokens) else None)
                bits.append(sketch(tokens) if len(tokens) else None)
                held.append(tokens)
                size += len(tokens)
                if size >= COUNTED:
                    yield from often()
                    held, size = [], 0
            columns = [batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(cls, pa.int64()), pa.array(chk, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(n), kind) for kind in kinds[5:]]], names=names)
        yield from often()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(work), "doc_id long, n int, cls long, chk long, bits binary, tok long, cnt int")


def _index(docs: DataFrame, frequent, moved: dict, k: int, num: int, den: int) -> DataFrame:
    """(sig, cls): the index entries of every document's set, once a set and task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count, very = frequent.value
        maybe = np.zeros(1 << 22, bool)
        maybe[(common & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
        done: set[int] = set()
        for batch in batches:
            sig, cls = [], []
            for text in strings(batch.column("text")):
                tokens = shingle_hashes(text, k)
                if not len(tokens) or (own := set_id(tokens, moved)) in done:
                    continue
                if len(done) < 1_000_000:
                    done.add(own)
                counts = np.zeros(len(tokens), np.int64)
                if len(likely := np.flatnonzero(maybe[(tokens & np.uint64(len(maybe) - 1)).astype(np.int64)])):
                    at = np.minimum(np.searchsorted(common, tokens[likely]), len(common) - 1)
                    counts[likely] = np.where(common[at] == tokens[likely], count[at], 0)
                found = entries(tokens, counts, very, num, den)
                sig.append(found)
                cls.append(np.full(len(found), own, np.int64))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(cls))], names=["sig", "cls"])

    return docs.filter("doc_id is not null").select(F.col("text").cast("string").alias("text")).mapInArrow(releasing(work), "sig long, cls long")


def _shared(sigs: DataFrame) -> DataFrame:
    """(lo, cls): for every index entry, its smallest set beside each of its others.

    Entries are dealt by sig and sorted; one pass over them keeps a row. A set's bucket holds all that share an entry of
    which it is the smallest: the pairs of every entry are pairs of one bucket, and each bucket is there once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple[int, int] | None = None  # the last entry so far and its smallest set
        for batch in batches:
            sig, cls = batch.column("sig").to_numpy(), batch.column("cls").to_numpy()
            if not len(sig):
                continue
            starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            first = cls[starts]
            if tail is not None and sig[0] == tail[0]:
                first[0] = tail[1]
            lo = np.repeat(first, np.diff(np.r_[starts, len(sig)]))
            tail = int(sig[-1]), int(lo[-1])
            other = lo != cls
            yield pa.RecordBatch.from_arrays([pa.array(lo[other]), pa.array(cls[other])], names=["lo", "cls"])

    return sigs.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(releasing(work), "lo long, cls long").distinct()


def _texts(docs: DataFrame, wanted: DataFrame, moved: dict, k: int) -> DataFrame:
    """(cls, text) of the ``wanted`` (cls, rep); other documents' texts aren't shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = [set_id(shingle_hashes(text, k), moved) for text in strings(batch.column("text"))]
            yield batch.append_column("cls", pa.array(cls, pa.int64()))

    read = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).filter("rep is not null and text is not null")
    likely, _ = split_by_ids(read, wanted.select("rep"), "rep")
    return likely.mapInArrow(releasing(work), "rep long, text string, cls long").join(wanted, ["rep", "cls"]).select("cls", "text").dropDuplicates(["cls"])


def _small_pairs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within the small groups."""
    sizes = ends - starts
    keep = (sizes > 1) & (sizes <= SMALL)
    places = np.concatenate([np.arange(a, b) for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)] or [np.empty(0, np.int64)])
    stop = np.repeat(ends[keep], sizes[keep])
    found = []
    for apart in range(1, int(sizes[keep].max(initial=1))):
        fine = places + apart < stop
        places, stop = places[fine], stop[fine]
        found.append((places, places + apart))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


class _Sketches:
    """Sketches of rows that are sorted by nothing in particular, compared for given pairs of rows."""

    def __init__(self, bits: list[bytes]) -> None:
        self.words = np.array([len(b) // 8 for b in bits], np.int64)
        self.at = np.cumsum(self.words) - self.words
        self.flat = np.frombuffer(b"".join(bits), np.uint64)

    def _rows(self, rows: np.ndarray, words: int) -> np.ndarray:
        """The rows' sketches, of one width, folded to ``words`` where they are twice as wide."""
        wide = self.words[rows[0]] > words
        found = self.flat[self.at[rows][:, None] + np.arange(words)]
        return found ^ self.flat[self.at[rows][:, None] + np.arange(words, 2 * words)] if wide else found

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of every pair differ, at the narrower one's width."""
        out = np.empty(len(i), np.int64)
        narrow = np.minimum(self.words[i], self.words[j])
        kind = narrow * 4 + 2 * (self.words[i] > narrow) + (self.words[j] > narrow)
        for one in np.unique(kind).tolist():
            of = np.flatnonzero(kind == one)
            for begin in range(0, len(of), max(1, WORDS // (one // 4))):
                part = of[begin : begin + max(1, WORDS // (one // 4))]
                out[part] = np.bitwise_count(self._rows(i[part], one // 4) ^ self._rows(j[part], one // 4)).sum(axis=1, dtype=np.int64)
        return out


def _offers(members: DataFrame, num: int, den: int, offer: int | None) -> DataFrame:
    """(a, b): pairs of sets in a bucket, in different components, that the sketches don't rule out."""

    def near(i: np.ndarray, j: np.ndarray, n: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pairs whose sizes allow a link, of different components, and of the two parts if those differ."""
        few, many = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        return (few * den >= many * num) & (comp[i] != comp[j]) & (left[i] & right[j] | right[i] & left[j])

    def offers(table: pa.Table, cuts: np.ndarray) -> pa.Table | None:
        cls, n, comp = (table.column(c).to_numpy() for c in ("cls", "n", "comp"))
        n = n.astype(np.int64)
        left, right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        sketches = _Sketches(table.column("bits").to_pylist())
        starts, ends = cuts[:-1], cuts[1:]

        def nearest(i: np.ndarray, j: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of pairs of rows, the ``offer`` nearest of each row on either side."""
            if offer is None or not len(i):
                return i, j, far
            keep = np.zeros(len(i), bool)
            for side, other in ((i, j), (j, i)):
                order = np.lexsort((cls[other], far, side))
                keep[order[np.arange(len(side)) - np.searchsorted(side[order], side[order]) < offer]] = True
            return i[keep], j[keep], far[keep]

        def take(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            fine = near(i, j, n, comp, left, right)
            i, j = i[fine], j[fine]
            if not len(i):
                return i, j, np.empty(0)
            apart, total = sketches.apart(i, j), n[i] + n[j]
            fine = apart * (den + num) <= (den - num) * total
            return nearest(i[fine], j[fine], apart[fine] / total[fine])

        parts = [take(*_small_pairs(starts, ends))]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a <= SMALL or (comp[a:b] == comp[a]).all():
                continue
            by, own_parts = a + np.argsort(n[a:b], kind="stable"), []
            sizes = n[by]
            for at in range(0, b - a, SMALL):  # by size, so that only a stretch of the group can link
                own = by[at : at + SMALL]
                stretch = by[at : int(np.searchsorted(sizes, sizes[at + len(own) - 1] * den // num, "right"))]
                x, y = np.meshgrid(np.arange(len(own)), np.arange(len(stretch)), indexing="ij")
                later = x < y
                own_parts.append(take(own[x[later]], stretch[y[later]]))  # thinned at once: in a group of copies all pairs are near
            parts.append(nearest(*(np.concatenate(x) for x in zip(*own_parts, strict=True))))
        rows, cols, _ = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(rows):
            return None
        return pa.table({"a": np.minimum(cls[rows], cls[cols]), "b": np.maximum(cls[rows], cls[cols])})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group so far, which the next batch may go on with

        def flush(table: pa.Table, last: bool) -> tuple[pa.Table | None, pa.Table | None]:
            keys = np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in ("lo", "bi", "bj")])
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            whole = table if last else table.slice(0, cuts[-2])
            found = offers(whole.combine_chunks(), cuts if last else cuts[:-1]) if len(whole) else None
            return found, None if last else table.slice(cuts[-2])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            found, held = flush(table if held is None else pa.concat_tables([held, table]), False)
            if found is not None:
                yield from found.to_batches()
        if held is not None and (found := flush(held, True)[0]) is not None:
            yield from found.to_batches()

    # groups of two parts at most, several to a task: one call each would cost more than the work
    keys = ("lo", "bi", "bj")
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(releasing(work), "a long, b long").distinct()


def _verify(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b, links): whether the two sets' Jaccard similarity is num / den or more, on the texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # sets of the last pairs, several of which share one
        size = 0
        for batch in batches:
            links = []
            for a, b, x, y in zip(*(strings(batch.column(c), 64) for c in ("a", "b", "x", "y")), strict=True):
                if size > VERIFIED:
                    known, size = {}, 0
                for cls, text in ((a, x), (b, y)):
                    if cls not in known:
                        known[cls] = shingle_hashes(text, k)
                        size += len(known[cls])
                shared = len(np.intersect1d(known[a], known[b], assume_unique=True))
                links.append(den * shared >= num * (len(known[a]) + len(known[b]) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(links, pa.bool_())], names=["a", "b", "links"])

    sides = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b")
    return sides.select("a", "b", "x", "y").mapInArrow(releasing(work), "a long, b long, links boolean")


def _moved(sets: DataFrame) -> dict[tuple[int, int], int]:
    """New ids for sets that share their first digest with another: {(digest, second digest): id}.

    Of n sets about n * n / 2**65 pairs do, a handful at 10**10, so the table is small.
    """
    known = sets.filter("cls is not null")
    clash = known.groupBy("cls").agg(F.min("chk").alias("least"), F.max("chk").alias("most")).filter("least <> most").select("cls", "least")
    if clash.isEmpty():
        return {}
    rows = known.join(clash, "cls").filter("chk <> least").select("cls", "chk", F.xxhash64("cls", "chk").alias("id")).distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("too many sets share a digest")
    return {(r.cls, r.chk): r.id for r in rows}


def _sets(docs: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, dict]:
    """(doc_id, n, cls) of every row, (cls, rep) of every set that a row with an id has, and ``_moved``.

    rep is the smallest doc_id that the set's links reach.
    """
    spark = docs.sparkSession
    described = scratch.save(_describe(docs, k), "sets")
    sets = described.filter("n is not null").select("doc_id", "n", "cls", "chk", "bits")
    moved = _moved(sets)
    if moved:
        # as few rows as there are pairs of sets with one 64-bit digest
        other = spark.createDataFrame([(c, x, to) for (c, x), to in moved.items()], "cls long, chk long, _to long")
        sets = sets.join(F.broadcast(other), ["cls", "chk"], "left").withColumn("cls", F.coalesce("_to", "cls")).drop("_to")
    total = sets.count()
    # FREQUENT rows at most, whatever the corpus
    common = described.filter("tok is not null").groupBy("tok").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "tok").limit(FREQUENT).toArrow()
    tok, cnt = common.column("tok").to_numpy().view(np.uint64), common.column("cnt").to_numpy()
    order = np.argsort(tok)
    frequent = spark.sparkContext.broadcast((tok[order], cnt[order], max(1000, int(VERY_FREQUENT * total))))

    shared = scratch.save(_shared(_index(docs, frequent, moved, k, num, den)), "shared")
    sizes = scratch.save(shared.groupBy("lo").agg((F.count(F.lit(1)) + 1).alias("m")), "sizes")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    others = shared.join(sizes.filter(F.col("m") > BLOCK), "lo", "left").select("lo", "cls", F.coalesce(parts, F.lit(1)).alias("blocks"))
    members = others.unionByName(sizes.select("lo", F.col("lo").alias("cls"), parts.alias("blocks")))
    members = members.withColumn("blk", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    classes = sets.filter("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = scratch.save(classes, "classes")

    links = comps = None
    for offer in OFFERS:
        if comps is None:
            rows = members.withColumn("comp", F.col("cls"))
        else:
            rows = members.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
            closed = rows.groupBy("lo").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("m")).filter((F.col("a") == F.col("b")) & (F.col("m") >= CLOSED))
            rows = rows.join(scratch.save(closed.select("lo"), "closed"), "lo", "left_anti")
        rows = rows.join(classes.select("cls", "n", "bits"), "cls")
        # a large bucket is compared part by part: a row goes to the pairs of parts that its own is one of
        pairs_of = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("blk", o).alias("bi"), F.greatest("blk", o).alias("bj")))
        rows = rows.withColumn("p", F.explode(pairs_of)).select("lo", "cls", "n", "bits", "comp", "p.bi", "p.bj", (F.col("blk") == F.col("p.bi")).alias("left"), (F.col("blk") == F.col("p.bj")).alias("right"))
        offers = _offers(rows, num, den, offer)
        # what was verified before is not verified again
        pairs = scratch.save(offers if links is None else offers.join(links.select("a", "b"), ["a", "b"], "left_anti"), "offers")
        if pairs.isEmpty():
            if offer is None or links is None:
                break
            continue
        live = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        wanted = scratch.save(classes.join(live, "cls").select("cls", "rep"), "wanted")
        if comps is None:
            # what no sketch passes now, none passes later
            members = scratch.save(members.join(wanted.select("cls"), "cls"), "members")
        texts = scratch.save(_texts(docs, wanted, moved, k), "texts")
        found = _verify(pairs, texts, k, num, den)
        links = scratch.save(found if links is None else links.unionByName(found), "links")
        comps = scratch.save(components(links.filter("links").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch), "components")
    # from sets to documents: a component's id is its smallest document
    reps = classes.select("cls", "rep")
    if comps is not None:
        reps = reps.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        least = scratch.save(reps.groupBy("component").agg(F.min("rep").alias("least")), "least")
        reps = scratch.save(reps.join(least, "component").select("cls", F.col("least").alias("rep")), "reps")
    return sets.select("doc_id", "n", "cls"), reps, moved


def ngram_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: ``k``-word shingles, links at Jaccard similarity num / den or more.

    component_id is the smallest doc_id that links reach, the row's own included; equal sets link. Null texts, empty ones
    and ones without words have no shingles and link with nothing. A row with a null doc_id keeps a null component and
    links nothing. Rows under one doc_id are one document with all their links, whatever their texts. An empty table gives no
    rows; columns other than doc_id and text are ignored. ``num`` / ``den`` must be at least a half.
    """
    if not 1 <= k or not den <= 2 * num <= 2 * den:
        raise ValueError("k must be positive and the similarity between a half and one")
    scratch = scratch or Scratch(docs.sparkSession, "ngrams")
    sets, reps, _ = _sets(docs, k, num, den, scratch)
    found = sets.filter("doc_id is not null").join(reps, "cls", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("component_id"))
    found = scratch.save(found, "found")
    # texts of one document may lie in several components, which are one then
    several = found.groupBy("doc_id").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).filter("lo <> hi")
    several = scratch.save(several, "several")
    if not several.isEmpty():
        ties = found.join(several, "doc_id").filter("component_id <> lo").select(F.col("component_id").alias("u"), F.col("lo").alias("v"))
        merged = scratch.save(components(ties, scratch), "merged").withColumnRenamed("node", "component_id")
        found = found.join(merged, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))
    return found.unionByName(sets.filter("doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without near duplicates: of the rows whose texts links join, one of the smallest doc_id stays.

    Texts are judged one by one: of different texts under one doc_id only those go that another row stands for. Rows
    with a null doc_id, and texts without words, stay. Columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    sets, reps, moved = _sets(docs, k, num, den, scratch)
    each = sets.filter("doc_id is not null and cls is not null").groupBy("doc_id", "cls").agg(F.count(F.lit(1)).alias("times"))
    judged = each.join(reps, "cls").filter("rep <> doc_id or times > 1").select(F.col("doc_id").alias("id"), F.col("cls").alias("of"), (F.col("rep") != F.col("doc_id")).alias("gone"))
    judged = scratch.save(judged, "judged")
    # the rows' own columns lie in a struct, so that no name of theirs meets one of ours
    rows = docs.select(F.struct(*quoted(docs)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    likely, rest = split_by_ids(rows, judged.select(F.col("id").alias("doc_id")), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = [set_id(own, moved) if len(own := shingle_hashes(text, k)) else None for text in strings(batch.column("text"))]
            yield batch.select(["row", "doc_id"]).append_column("cls", pa.array(cls, pa.int64()))

    kinds = likely.select("row", "doc_id", F.lit(None).cast("long").alias("cls")).schema
    placed = likely.mapInArrow(releasing(work), kinds).join(judged, (F.col("doc_id") == F.col("id")) & (F.col("cls") == F.col("of")), "left").filter("gone is null or not gone")
    repeated = placed.filter("gone is not null").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "cls").orderBy("doc_id"))).filter("nth = 1")
    every = placed.filter("gone is null").select("row").unionByName(repeated.select("row")).unionByName(rest.select("row"))
    return every.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
