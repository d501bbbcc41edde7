"""Near-dedup of embeddings: sign hashing by random hyperplanes, exact cosines, connected components.

Vectors that are equal, of one label, form one class; classes are hashed. A table's hash of a vector is the signs of its products
with that table's random hyperplanes. Vectors that share a hash in any table are candidates; a pair is judged in the first table
that brings it together, by its cosine in double precision on the original vectors. A bucket gives each member's number of
links and ties it to one other member: as many rows as members, not as pairs, so large groups of near copies stay small.

More rows get longer hashes, so that buckets stay short, and as many more tables as keep the chance to miss a pair at the threshold
under MISS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Scratch, releasing, split_by_ids
from .components import components

COSINE = 0.98
#: Chance that no table brings together a pair exactly at the threshold, at most.
MISS = 0.005
FEWEST_BITS, MOST_BITS = 8, 48
#: Rows of a bucket's part; two parts are compared in one task.
BLOCK = 512
#: Buckets up to this size are compared several at once; pairs computed at once.
SMALL, PAIRS = 32, 1 << 14
SEED = 20_011

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def tables(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a hash, and tables, for ``n`` vectors: about as many hashes as vectors."""
    bits = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(max(2, n)))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - together))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as float64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_scaled(x: np.ndarray) -> np.ndarray:
    """Each row by a power of two, which changes no digit of a cosine, so that its largest component is about 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def bucket_keys(x: np.ndarray, label: np.ndarray, bits: int, n_tables: int) -> np.ndarray:
    """A row of ``n_tables`` bucket keys for each vector: its signs in the table, with label, length and table mixed in."""
    x = unit_scaled(x)
    out = np.empty((len(x), n_tables), np.uint64)
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    for t in range(n_tables):
        planes = np.random.default_rng((SEED, x.shape[1], t)).standard_normal((x.shape[1], bits))
        h = ((x @ planes > 0) * weights).sum(axis=1, dtype=np.uint64)
        for part in (label.astype(np.int64).view(np.uint64), np.uint64(x.shape[1] * 4096 + t)):
            h = (h ^ (h >> np.uint64(31))) * _B
            h = (h ^ part) * _A
        out[:, t] = h ^ (h >> np.uint64(29))
    return out.view(np.int64)


def _hashed(classes: DataFrame, bits: int, n_tables: int) -> DataFrame:
    """``classes`` with keys, their buckets in all tables."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(dims := batch.column("dim").to_numpy()).tolist():
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, len(part), 4096):
                    some = part.slice(at, 4096)
                    keys = bucket_keys(matrix(some.column("embedding")), some.column("lab").to_numpy(), bits, n_tables)
                    ends = pa.array(np.arange(0, keys.size + 1, n_tables, dtype=np.int32))
                    yield some.append_column("keys", pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1))))

    kinds = ", ".join(f"{name} {kind}" for name, kind in classes.dtypes)
    return classes.mapInArrow(releasing(work), f"{kinds}, keys array<bigint>")


def _pairs_within(starts: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within the groups of up to ``most`` rows."""
    left, right = [], []
    for size in range(2, most + 1):
        own = starts[sizes == size][:, None]
        if len(own):
            i, j = np.triu_indices(size, 1)
            left.append((own + i).ravel())
            right.append((own + j).ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def cosines(x: np.ndarray, norms: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        out[at : at + PAIRS] = np.einsum("ij,ij->i", x[a], x[b]) / (norms[a] * norms[b])
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches by the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
        root = root[root]
        if (root == before).all():
            return root


def _linked(rows: DataFrame, cosine: float) -> DataFrame:
    """(a, links, b): for each member of a bucket its links found there, and a member that they reach; see the module."""
    keys = ("dim", "key", "bi", "bj")

    def judge(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = unit_scaled(matrix(table.column("embedding")))
        norms = np.linalg.norm(x, axis=1)
        unit = x / norms[:, None]
        cid, lab, t, part, copies = (table.column(c).to_numpy() for c in ("cid", "lab", "t", "part", "copies"))
        own = matrix_of_keys(table.column("keys"))
        bi, bj = (table.column(c).to_numpy() for c in ("bi", "bj"))
        starts, sizes = cuts[:-1], np.diff(cuts)
        found = [_pairs_within(starts, sizes, SMALL)]
        for a, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            one, other = np.arange(a, a + size), np.arange(a, a + size)
            if bi[a] != bj[a]:
                one, other = one[part[one] == bi[a]], other[part[other] == bj[a]]
            near = unit[one] @ unit[other].T >= cosine - 1e-9
            i, j = np.nonzero(np.triu(near, 1) if bi[a] == bj[a] else near)
            found.append((one[i], other[j]))
        i, j = (np.concatenate(side) for side in zip(*found, strict=True))
        fine = (lab[i] == lab[j]) & ((bi[i] == bj[i]) | (part[i] != part[j]))
        i, j = i[fine], j[fine]
        fine = cosines(x, norms, i, j) >= cosine
        i, j = i[fine], j[fine]
        first = np.ones(len(i), bool)
        for earlier in range(int(t.max(initial=0))):
            first &= (t[i] <= earlier) | (own[i, earlier] != own[j, earlier])
        i, j = i[first], j[first]
        links = np.zeros(len(cid), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root, has = _roots(len(cid), i, j), links > 0
        yield pa.RecordBatch.from_arrays([pa.array(cid[has]), pa.array(links[has]), pa.array(cid[root[has]])], names=["a", "links", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group so far, which the next batch may go on with

        def whole_groups(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            own = np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in keys])
            cuts = np.r_[0, np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1, len(own)]
            end = len(cuts) - 1 if last else len(cuts) - 2
            held = None if last else table.slice(cuts[end])
            dims = own[cuts[:end], 0]
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                at, to = cuts[of[0]], cuts[of[-1] + 1]
                yield from judge(table.slice(at, to - at).combine_chunks(), cuts[of[0] : of[-1] + 2] - at)

        for batch in batches:
            if len(batch):
                table = pa.Table.from_batches([batch])
                yield from whole_groups(table if held is None else pa.concat_tables([held, table]), False)
        if held is not None and len(held):
            yield from whole_groups(held, True)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(releasing(work), "a long, links long, b long")


def matrix_of_keys(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _whole(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda v: v != 0)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``: links at a cosine of ``cosine`` or more within a label.

    n_links counts the other rows linked directly, component_id is the smallest vec_id that links reach, the row's own
    included, and a row is kept if that is its own. A pair at the threshold is missed with a chance of ``miss`` at most, nearer
    ones less; equal vectors are never missed. Vectors that are null, empty, zero or hold null or non-finite components,
    and those with a null label, link with nothing; vectors are compared with those of their own length. Rows repeated are
    vectors of their own, linked with each other. A null vec_id takes part but names no component: it is dropped where a
    row with an id is near, and kept else. An empty table gives no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "hyperplanes")
    kind = vectors.schema["label"].dataType
    lab = F.col("label").cast("long") if isinstance(kind, IntegralType) else F.xxhash64("label")
    numbers = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), lab.alias("lab"), F.col("label").isNotNull().alias("labelled"), numbers.alias("embedding"))
    fine = F.coalesce(F.col("labelled") & _whole(F.col("embedding")), F.lit(False))
    classes = rows.filter(fine).groupBy("lab", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "classes")
    hashed = scratch.save(_hashed(classes.select("cid", "lab", "dim", "copies", "embedding"), *tables(classes.count(), cosine, miss)), "hashed")

    placed = hashed.select("cid", "lab", "dim", "copies", "embedding", "keys", F.posexplode("keys").alias("t", "key"))
    buckets = scratch.save(hashed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "buckets")
    likely, _ = split_by_ids(placed, buckets.select("key"), "key")  # what stands alone in a bucket is not shuffled
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    members = likely.join(buckets, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int"))
    # a large bucket is compared part by part: a row goes to the pairs of parts that its own is one of
    pairs_of = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("bi"), F.greatest("part", o).alias("bj")))
    members = members.withColumn("p", F.explode(pairs_of)).select("dim", "key", "p.bi", "p.bj", "part", "t", "cid", "lab", "copies", "embedding", "keys")
    linked = scratch.save(_linked(members, cosine), "linked")

    comps = components(linked.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    comps = scratch.save(comps.join(classes.select(F.col("cid").alias("node"), "least"), "node"), "nodes")
    named = scratch.save(comps.groupBy("component").agg(F.min("least").alias("first")), "named")
    counts = linked.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    of = comps.join(named, "component").select(F.col("node").alias("cid"), F.col("first"))
    found = classes.join(counts, "cid", "left").join(of, "cid", "left")
    known = found.select(
        F.col("lab").alias("_lab"), F.xxhash64("embedding").alias("_h"), F.col("embedding").alias("_embedding"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("first", "least").alias("component_id"),
    )
    known = scratch.save(known, "found")
    joined = rows.filter(fine).withColumn("h", F.xxhash64("embedding")).join(known, (F.col("h") == F.col("_h")) & (F.col("lab") == F.col("_lab")) & (F.col("embedding") == F.col("_embedding")))
    alone = rows.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
