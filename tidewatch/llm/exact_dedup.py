"""Exact dedup by distributed MSD radix partitioning.

Documents are split by the first bytes of their normalised texts; groups of more than one document whose texts go on are
split by the bytes that follow, and so on. A document is done when it stands alone or its group's text has ended.
Equality is that of the bytes themselves. A level's digit is several bytes wide and widens, so that even long texts
take a few levels. A group goes by a number from one level to the next, not by its bytes.

Each level is one aggregation with map-side combining. Only groups of two and more are written; a filter of fixed size
tells the documents that surely stand alone before any text is shuffled; the few groups that hold a large part of the rows are
broadcast, so their rows stay where they are; the rest meet their groups in a join of two written tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, split_by_ids, union_all

#: Bytes of the first digit, and how much wider each next one is.
FIRST_DIGIT, WIDER = 48, 8
#: Groups that are broadcast, at most, and their digits' bytes: a group counts as hot when it holds more than its share of the rows.
HOT_GROUPS, HOT_BYTES = 256, 1 << 25

_LEVEL = "doc_id long, keep_id long, group_size long, text_sha256 string, grp long, rest binary, done boolean"


def _split(rows: DataFrame, width: int, n: int, scratch: Scratch) -> DataFrame:
    """One level: the ``n`` ``rows`` (doc_id, grp, rest, and text_sha256 but on the first level) split by the next ``width`` bytes.

    ``grp`` is the group that shares all bytes before; ``ended`` tells a text that stops within this digit from one that only
    begins like it.
    """
    keys = ["grp", "digit", "ended"]
    digit = rows.withColumn("digit", F.substring("rest", 1, width)).withColumn("ended", F.octet_length("rest") <= width).withColumn("key", F.xxhash64(*keys))
    found = digit.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("last")).filter("size > 1")
    groups = scratch.save(found.withColumn("next", F.monotonically_increasing_id()), "groups")
    share = n // max(1, min(HOT_GROUPS, HOT_BYTES // width))
    # more than a share of the rows each: HOT_GROUPS of them and HOT_BYTES at most
    hot = F.broadcast(groups.filter(F.col("size") > share))
    maybe, alone = split_by_ids(digit, groups.select(F.xxhash64(*keys).alias("key")), "key")
    parts = [
        alone.withColumns({"size": F.lit(None).cast("long"), "last": F.lit(None).cast("long"), "next": F.lit(None).cast("long")}),
        maybe.join(hot, keys).select(*digit.columns, "size", "last", "next"),
        maybe.join(hot.select(*keys), keys, "left_anti").join(groups.filter(F.col("size") <= share), keys, "left").select(*digit.columns, "size", "last", "next"),
    ]
    done = F.col("size").isNull() | F.col("ended")
    # on the first level, where rest is the whole text, the digest is computed here, once a row
    digest = F.col("text_sha256") if "text_sha256" in rows.columns else F.sha2("rest", 256)
    return union_all(parts).select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("last")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        digest.alias("text_sha256"),
        done.alias("done"),
        F.when(~done, F.col("next")).alias("grp"),
        F.when(~done, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
    )


def _normalised() -> Column:
    return ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")


def exact_duplicates(docs: DataFrame, first_digit: int = FIRST_DIGIT, wider: int = WIDER, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Texts are compared after lower-casing A-Z alone; null counts as empty, so null and empty texts form one group. The row
    with the largest doc_id stays; null ids lose to any other. Rows repeated under one doc_id and text count each in
    group_size, and are kept or dropped together. An empty table gives no rows; only doc_id and text are read, so other
    columns may have any name. The digest is a column of the result and decides nothing.
    """
    scratch = scratch or Scratch(docs.sparkSession, "radix")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("grp"), _normalised().alias("rest"))
    done, width, previous, n = [], first_digit, None, docs.count()
    while True:
        path = scratch.write(_split(rows, width, n, scratch), "level", partition=["done"])
        level = scratch.read(path, _LEVEL)
        done.append(level.filter("done"))
        rows = level.filter("not done").select("doc_id", "grp", "rest", "text_sha256")
        if previous:
            scratch.drop(f"{previous}/done=false")
        previous = path
        n = rows.count()
        if not n:
            break
        width *= wider
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return union_all([d.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256") for d in done])


def keep_one(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """``docs`` with one row for each text (as compared by ``exact_duplicates``): one of those with the largest doc_id.

    Rows with a null doc_id stay where no row with an id has their text. Columns may have any name.
    """
    scratch = scratch or Scratch(docs.sparkSession, "radix")
    groups = exact_duplicates(docs, scratch=scratch, **options).filter("group_size > 1").groupBy(F.col("text_sha256").alias("of")).agg(F.max("keep_id").alias("keep_id"))
    groups = scratch.save(groups, "kept")
    # the rows' own columns lie in a struct, so that no name of theirs meets one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.sha2(_normalised(), 256).alias("sha"))
    likely, rest = split_by_ids(rows, groups.select(F.col("of").alias("sha")), "sha")
    placed = likely.join(groups, F.col("sha") == F.col("of"), "left").filter("of is null or id <=> keep_id")
    one = placed.filter("of is not null").dropDuplicates(["sha"]).select("row")
    return placed.filter("of is null").select("row").unionByName(one).unionByName(rest.select("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
