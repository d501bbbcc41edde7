"""Ranked lexical search by pipelined term partitioning.

One pass over the documents cuts the posting lists of the items' terms into pieces: a piece holds a term's occurrences in one
block of documents, as two short arrays. Terms belong to a few successive owners, rare terms to the first, frequent ones to
the last. Items travel in bundles: at each owner a cogroup brings a bundle's sparse accumulators of a block together with the
owner's pieces of that block, adds whole-number contributions and passes the accumulators on; the last owner selects.

Between two owners each item's 50th best sum so far is known. A document that can't reach it with all terms to come is not
carried on, nor begun where none could: sums only grow, so the result is that of carrying everything.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, releasing

TOP = 50
#: Documents of a block, and postings from which a block ends earlier: what bounds a group's memory.
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 21
#: Items of a bundle, about.
BUNDLE = 64
#: A term's owner: how many of these parts of all documents hold fewer documents than the term. One owner more than parts.
OWNERS = (1000, 100, 10)
#: Terms of all items, and their bytes, up to which they are broadcast; beyond, every term's pieces are written and the join picks.
VOCABULARY, VOCABULARY_BYTES = 1 << 18, 1 << 23

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(raw: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order: runs of ASCII letters, digits and all characters beyond ASCII; A-Z lower-cased."""
    return raw.translate(_LETTERS).split() if raw else []


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each item's terms, once each. Rows under one item_id are one item; null ids take no part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t.decode()) for i, raw in zip(batch.column("item_id").to_pylist(), batch.column("raw").to_pylist(), strict=True) for t in set(terms(raw))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], names=["item_id", "term"])

    rows = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(releasing(work), "item_id long, term string").distinct()


_PIECES = pa.schema(
    [("block", pa.int64()), ("term", pa.string()), ("rows", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())), ("n_terms", pa.int64())]
)


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)], pa.int32()), pa.array(values, kind))


class _Block:
    """Documents of one block, gathered; ``cut`` gives its pieces and one row (ids, ns) of its documents in order of doc_id."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.ns: list[int] = []
        self.names: dict[bytes, int] = {}
        self.which: list[int] = []
        self.row: list[int] = []
        self.tf: list[int] = []

    def add(self, doc_id: int | None, words: list[bytes], known: frozenset[bytes] | None) -> None:
        counts = Counter(words)
        hits = list(counts if known is None else known.intersection(counts))
        self.which += [self.names.setdefault(t, len(self.names)) for t in hits]
        self.tf += [counts[t] for t in hits]
        self.row += [len(self.ids)] * len(hits)
        self.ids.append(doc_id)
        self.ns.append(len(words))

    def cut(self, block: int) -> pa.RecordBatch:
        missing = np.array([i is None for i in self.ids])
        order = np.lexsort((np.array([i or 0 for i in self.ids], np.int64), missing))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        which, row, tf = np.array(self.which, np.int64), place[np.array(self.row, np.int64)], np.array(self.tf, np.int32)
        by = np.lexsort((row, which))
        which, row, tf = which[by], row[by], tf[by]
        starts, k = np.searchsorted(which, np.arange(len(self.names))), len(self.names)
        own = [self.ids[i] for i in order.tolist()]
        columns = [
            pa.array(np.full(k + 1, block)),
            pa.array([*(t.decode() for t in self.names), None], pa.string()),
            pa.concat_arrays([_lists(row, starts, pa.int32()), pa.nulls(1, pa.list_(pa.int32()))]),
            pa.concat_arrays([_lists(tf, starts, pa.int32()), pa.nulls(1, pa.list_(pa.int32()))]),
            pa.concat_arrays([pa.nulls(k, pa.list_(pa.int64())), pa.array([own], pa.list_(pa.int64()))]),
            pa.concat_arrays([pa.nulls(k, pa.list_(pa.int64())), pa.array([np.array(self.ns, np.int64)[order]], pa.list_(pa.int64()))]),
            pa.array([*[None] * k, sum(self.ns)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_PIECES)


def pieces(docs: DataFrame, known) -> DataFrame:
    """Pieces (block, term, rows, tfs) of posting lists, and a row (block, ids, ns, n_terms) for each block, with term null.

    ``known`` is a broadcast set of the terms wanted, or None for all. Documents without a term are in no block.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wanted, made, block = known.value if known else None, TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            ids, raw = batch.column("doc_id"), batch.column("raw")
            for at in range(0, len(batch), 256):
                for doc_id, text in zip(ids.slice(at, 256).to_pylist(), raw.slice(at, 256).to_pylist(), strict=True):
                    if not (words := terms(text)):
                        continue
                    block.add(doc_id, words, wanted)
                    if len(block.ids) >= BLOCK_DOCS or len(block.row) >= BLOCK_POSTINGS:
                        yield block.cut(made)
                        made, block = made + 1, _Block()
        if block.ids:
            yield block.cut(made)

    kind = "block long, term string, rows array<int>, tfs array<int>, ids array<long>, ns array<long>, n_terms long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw")).mapInArrow(releasing(work), kind)


def _numbers(column: pa.ChunkedArray, at: int) -> np.ndarray:
    return column[at].values.to_numpy(zero_copy_only=False)


def _owner(n_docs: int, n_terms: int, top: int, last: bool):
    """What one owner does to a bundle and a block: contributions are added, what can't reach an item's floor any more goes."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        sums: dict[int, np.ndarray] = {}
        room: dict[int, tuple[int, int]] = {}  # floor, and what later owners may add
        for at, item in enumerate(left.column("item").to_pylist()):
            if item is None:
                lengths, ids = _numbers(left.column("ns"), at), left.column("ids")[at].as_py() if last else None
        m20 = 20 * (50 + (50 * lengths * n_docs) // n_terms)
        for at, item in enumerate(left.column("item").to_pylist()):
            if item is not None:
                sums[item] = np.zeros(len(lengths), np.int64)
                sums[item][_numbers(left.column("rows"), at)] = _numbers(left.column("scores"), at)
        for at, (w, asked) in enumerate(zip(right.column("w").to_pylist(), right.column("items").to_pylist(), strict=True)):
            rows, tf = _numbers(right.column("rows"), at), _numbers(right.column("tfs"), at).astype(np.int64)
            more = w * ((1_000_000_000 * tf) // (1000 * tf + m20[rows]))
            for item in asked:
                room[item["item"]] = item["floor"], item["after"]
                sums.setdefault(item["item"], np.zeros(len(lengths), np.int64))[rows] += more
        out = []
        for item, own in sums.items():
            floor, after = room.get(item, (0, 0))
            rows = np.flatnonzero((own > 0) & (own + after >= floor))
            best = rows[np.lexsort((rows, -own[rows]))[:top]] if len(rows) > top else rows
            if len(rows):
                chosen = best if last else rows
                out.append((item, chosen.astype(np.int32), own[chosen], [ids[i] for i in chosen.tolist()] if last else np.sort(own[best])))
        bundle, block = (pa.scalar(left.column(c)[0].as_py(), kind) for c, kind in (("bundle", pa.int32()), ("block", pa.int64())))
        columns = [
            pa.array([bundle.as_py()] * len(out), pa.int32()),
            pa.array([block.as_py()] * len(out), pa.int64()),
            pa.array([x[0] for x in out], pa.int64()),
            pa.array([x[1] for x in out], pa.list_(pa.int32())),
            pa.array([x[2] for x in out], pa.list_(pa.int64())),
            pa.array([x[3] for x in out], pa.list_(pa.int64())),
        ]
        return pa.table(columns, names=["bundle", "block", "item", "rows", "scores", "best"])

    return work


def _first(rows: DataFrame, top: int, *order: Column) -> DataFrame:
    """The first ``top`` rows of each item; Spark thins every partition before it deals rows out by item."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: for every item its ``top`` documents of highest score above 0, ties by ascending doc_id.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is 50 + 50 n N div L, and a term adds weight
    times (10**9 tf div (1000 tf + 20 m)), all in 64-bit whole numbers. Null and empty texts have no terms: they are no part of
    N and are never returned. Each row of ``docs`` is a document of its own, rows repeated under one doc_id too; a null doc_id
    comes last among ties. Rows under one item_id are one item with all their terms; items with a null id, or without a term
    that a document has, have no rows. An empty table gives none; columns other than ids and texts are ignored.
    """
    spark, scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession, "lexical")
    asked = scratch.save(item_terms(items), "asked")
    wanted = asked.select("term").distinct()
    size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    few = size[0] <= VOCABULARY and size[1] <= VOCABULARY_BYTES
    known = spark.sparkContext.broadcast(frozenset(t.encode() for t in wanted.toArrow().column("term").to_pylist())) if few else None
    index = pieces(docs, known)
    path = scratch.write(index, "pieces")
    lists = scratch.read(path, index.schema).filter("term is not null").select("block", "term", "rows", "tfs")
    blocks = scratch.read(path, index.schema).filter("term is null").select("block", "ids", "ns", "n_terms")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum(F.size("ns")), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n_bundles = max(1, -(-asked.select("item_id").distinct().count() // BUNDLE))

    df = lists.groupBy("term").agg(F.sum(F.size("rows")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    owner = sum(F.when(F.col("df") * part > n_docs, 1).otherwise(0) for part in OWNERS)
    asked = asked.join(df, "term").select(F.col("item_id").alias("item"), "term", weight.alias("w"), owner.alias("owner"), F.pmod(F.xxhash64("item_id"), F.lit(n_bundles)).cast("int").alias("bundle"))
    asked = scratch.save(asked, "weights")

    carried = floors = None
    for at in range(len(OWNERS) + 1):
        last = at == len(OWNERS)
        # a document gains less than a million times the weights to come
        rest = asked.groupBy("item").agg((1_000_000 * F.coalesce(F.sum(F.when(F.col("owner") > at, F.col("w"))), F.lit(0))).alias("after"))
        rest = rest.join(floors, "item", "left").select("item", "after", F.coalesce("floor", F.lit(0)).alias("floor")) if floors is not None else rest.withColumn("floor", F.lit(0).cast("long"))
        own = asked.filter(F.col("owner") == at).join(rest, "item")
        own = scratch.save(own.groupBy("term", "w", "bundle").agg(F.collect_list(F.struct("item", "floor", "after")).alias("items")), "owned")
        given = lists.join(own, "term").select("bundle", "block", "w", "rows", "tfs", "items")
        none = {"item": "long", "rows": "array<int>", "scores": "array<long>"}
        side = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle"), "block", *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()], "ns", F.col("ids") if last else F.lit(None).cast("array<long>").alias("ids"))
        if carried is not None:
            side = side.unionByName(carried.select("bundle", "block", "item", "rows", "scores"), allowMissingColumns=True)
        kind = "bundle int, block long, item long, rows array<int>, scores array<long>, best array<long>"
        carried = scratch.save(side.groupBy("bundle", "block").cogroup(given.groupBy("bundle", "block")).applyInArrow(_owner(n_docs, n_terms, top, last), kind), "carried")
        if not last:
            sums = _first(carried.select("item", F.explode("best").alias("sum")), top, F.desc("sum"))
            floors = scratch.save(sums.groupBy("item").agg(F.min("sum").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == top).select("item", "floor"), "floors")
    found = carried.select("item", F.explode(F.arrays_zip("scores", "best")).alias("x")).select("item", F.col("x.scores").alias("score"), F.col("x.best").alias("doc_id"))
    return _first(found, top, F.desc("score"), F.asc_nulls_last("doc_id")).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
