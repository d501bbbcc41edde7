"""Byte-level BPE encoding and decoding with DuckDB recursive queries in every partition.

A text is split by the tokenizer's pattern into pieces; distinct pieces are encoded once. Each piece's bytes are rows
(piece, position, token). A recursive query joins adjacent rows with the merge table and contracts each piece's leftmost
pair of least rank, until no piece has a pair left. Decoding joins the ids with the vocabulary and aggregates the bytes in
order of position.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_between_tasks, releasing, strings, with_ids

TYPES = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Encoded pieces that a worker remembers, and their bytes; pieces that one recursive query encodes; bytes above which a piece is long.
REMEMBERED, REMEMBERED_BYTES, PIECES, LONG = 400_000, 1 << 25, 20_000, 64
#: Rows that one recursive query over a long piece keeps, about.
KEPT = 1 << 21
#: Characters of the texts that are handled together; ids that one query decodes. Both bound memory.
CHARACTERS, IDS = 1 << 19, 1 << 17
MEMORY = "256MB"

# Rows are keyed by a byte address g; pieces are a byte apart, so that a row's right neighbour stands at g + len.
_SHORT = """
WITH RECURSIVE t(w, g, len, tok, depth) AS (
  SELECT w, g, len, tok, 0 FROM start
  UNION ALL
  SELECT t.w, t.g, CASE WHEN t.g = b.cut THEN b.len ELSE t.len END, CASE WHEN t.g = b.cut THEN b.tok ELSE t.tok END, t.depth + 1
  FROM t JOIN (
    SELECT w, CAST(min(key) & 4294967295 AS INT) AS cut, CAST(min(key) >> 32 AS INT) AS tok, arg_min(gone, key) AS gone, arg_min(len, key) AS len
    FROM (SELECT x.w, (CAST(m.tok AS BIGINT) << 32) | x.g AS key, y.g AS gone, x.len + y.len AS len
          FROM t x JOIN t y ON x.g + x.len = y.g JOIN merges m ON m.pair = CAST(x.tok AS BIGINT) * 4294967296 + y.tok) p
    GROUP BY w) b ON t.w = b.w
  WHERE t.g <> b.gone)
SELECT t.w AS w, t.tok AS tok FROM t JOIN (SELECT w, max(depth) AS depth FROM t GROUP BY w) d ON t.w = d.w AND t.depth = d.depth
ORDER BY t.g
"""

# For long pieces a step of the recursion contracts more: all pairs of least rank, in runs of overlapping ones every other from
# the left. One by one from the left is the rule, and a contraction may give a pair of still lower rank with the token on its left
# (as it is by then) or right (as it still is); the step ends with the first such. ``deep`` steps are made at a time, as every
# step's rows are kept until the query ends.
_LONG = """
WITH RECURSIVE t(w, g, len, tok, depth) AS (
  SELECT w, g, len, tok, 0 FROM start
  UNION ALL
  (WITH p AS (SELECT x.w, x.g, y.g AS gone, x.len + y.len AS len, m.tok
              FROM t x JOIN t y ON x.g + x.len = y.g JOIN merges m ON m.pair = CAST(x.tok AS BIGINT) * 4294967296 + y.tok),
        b AS (SELECT w, min(tok) AS tok FROM p GROUP BY w),
        c AS (SELECT p.*, lag(gone) OVER (PARTITION BY p.w ORDER BY g) AS before, row_number() OVER (PARTITION BY p.w ORDER BY g) AS nth
              FROM p JOIN b ON p.w = b.w AND p.tok = b.tok),
        r AS (SELECT c.*, max(CASE WHEN before IS NULL OR before <> g THEN nth END) OVER (PARTITION BY w ORDER BY g) AS head FROM c),
        e AS (SELECT w, g, gone, len, tok, lag(g + len) OVER (PARTITION BY w ORDER BY g) AS touch FROM r WHERE (nth - head) % 2 = 0),
        v AS (SELECT e.*, (ml.tok < e.tok) IS TRUE OR (mr.tok < e.tok) IS TRUE AS stops
              FROM e LEFT JOIN t u ON u.g + u.len = e.g LEFT JOIN t z ON z.g = e.g + e.len
              LEFT JOIN merges ml ON ml.pair = CAST(CASE WHEN touch = e.g THEN e.tok ELSE u.tok END AS BIGINT) * 4294967296 + e.tok
              LEFT JOIN merges mr ON mr.pair = CAST(e.tok AS BIGINT) * 4294967296 + z.tok),
        k AS (SELECT v.g, v.gone, v.len, v.tok FROM v LEFT JOIN (SELECT w, min(g) AS g FROM v WHERE stops GROUP BY w) f ON v.w = f.w
              WHERE f.g IS NULL OR v.g <= f.g)
   SELECT t.w, t.g, coalesce(k.len, t.len), coalesce(k.tok, t.tok), t.depth + 1
   FROM t JOIN b ON t.w = b.w LEFT JOIN k ON t.g = k.g LEFT JOIN k d ON t.g = d.gone WHERE d.gone IS NULL AND t.depth < {deep}))
SELECT w, g, len, tok, depth FROM t WHERE depth = (SELECT max(depth) FROM t) ORDER BY g
"""

_DECODE = "SELECT i.d AS d, string_agg(v.hex, '' ORDER BY i.at) AS hex FROM ids i JOIN vocabulary v ON v.tok = i.tok GROUP BY i.d"


class Coder:
    """A worker's tokenizer: merge and vocabulary tables in DuckDB, and the pieces encoded so far.

    A merge is any two tokens whose bytes joined are a token; its rank is that token's id.
    """

    _kept: dict[tuple[str, str], Coder] = keep_between_tasks({})

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
        found = ((left, right, rank) for word, rank in ranks.items() for i in range(1, len(word)) if (left := ranks.get(word[:i])) is not None and (right := ranks.get(word[i:])) is not None)
        merges = np.fromiter(itertools.chain.from_iterable(found), np.int64).reshape(-1, 3)
        left, right, rank = merges.T
        self.pattern, self.ranks, self.pieces = regex.compile(pattern), ranks, {}
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.held = 0
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute("SET temp_directory = ''")  # the queries' sizes are bounded, so nothing is spilled
        self.db.execute(f"SET memory_limit = '{MEMORY}'")
        self._table("loaded", pair=left * 2**32 + right, tok=rank.astype(np.int32))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM loaded")
        words = sorted(ranks.items(), key=lambda x: x[1])
        self._table("loaded", tok=np.array([r for _, r in words], np.int32), hex=[w.hex() for w, _ in words])
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM loaded")
        self.db.unregister("loaded")

    @classmethod
    def of(cls, path: str, pattern: str) -> Coder:
        if (path, pattern) not in cls._kept:
            cls._kept[path, pattern] = cls(path, pattern)
        return cls._kept[path, pattern]

    def _table(self, name: str, **columns) -> None:
        self.db.register(name, pa.table(columns))

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that aren't remembered: whole tokens by look-up, the others by contraction."""
        raw = [piece.encode() for piece in pieces]
        rest = []
        for piece, word in zip(pieces, raw, strict=True):
            rank = self.ranks.get(word)
            if rank is None:
                rest.append((piece, word))
            else:
                self.pieces[piece] = rank.to_bytes(4, "little")
        short = [x for x in rest if len(x[1]) <= LONG]
        for at in range(0, len(short), PIECES):
            self._contract(short[at : at + PIECES], self._recursive)
        for x in rest:
            if len(x[1]) > LONG:
                self._contract([x], self._recursive_long)

    def _contract(self, words: list[tuple[str, bytes]], how) -> None:
        lengths = np.array([len(word) for _, word in words])
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        tokens = self.bytes[np.frombuffer(b"".join(word for _, word in words), np.uint8)]
        self._table("start", w=w, g=np.arange(len(w), dtype=np.int32) + w, len=np.ones(len(w), np.int32), tok=tokens)
        found = how()
        ids, sizes = np.asarray(found["tok"]).astype("<u4"), np.bincount(np.asarray(found["w"]), minlength=len(words))
        ends = np.cumsum(sizes)
        joined = ids.tobytes()
        for (piece, word), end, size in zip(words, ends.tolist(), sizes.tolist(), strict=True):
            self.pieces[piece] = joined[4 * (end - size) : 4 * end]
            self.held += 5 * len(word)

    def _recursive(self) -> dict:
        return self.db.execute(_SHORT).fetchnumpy()

    def _recursive_long(self) -> dict:
        """The recursion over one long piece, some steps at a time, until a query makes fewer steps than it may."""
        n = self.db.execute("SELECT count(*) FROM start").fetchone()[0]
        while True:
            deep = max(8, KEPT // max(1, n))
            found = self.db.execute(_LONG.format(deep=deep)).fetchnumpy()
            n = len(found["w"])
            if found["depth"][0] < deep:
                return found
            self._table("start", **{c: np.asarray(found[c]) for c in ("w", "g", "len", "tok")})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(text) for text in texts]
        wanted = {piece for pieces in split for piece in pieces}
        if len(self.pieces) + len(wanted) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.pieces, self.held = {}, 0
        self._learn([piece for piece in wanted if piece not in self.pieces])
        return [b"".join(map(self.pieces.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(text's place, bytes) in order of the texts; a long text comes in parts."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        owner = np.repeat(np.arange(len(ids), dtype=np.int64), [len(x) // 4 for x in ids])
        for at in range(0, len(flat), IDS):
            part = slice(at, at + IDS)
            self._table("ids", d=owner[part], at=np.arange(at, at + len(flat[part]), dtype=np.int64), tok=flat[part].astype(np.int32))
            found = self.db.execute(_DECODE).fetchnumpy()
            for k in np.argsort(found["d"]).tolist():
                yield int(found["d"][k]), bytes.fromhex(found["hex"][k])


def chunks(texts: Iterable[str], most: int = CHARACTERS) -> Iterator[list[str]]:
    """Texts in runs of about ``most`` characters."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_and_decode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    ``vocabulary`` is a rank file present on every machine, ``pattern`` its split pattern; there are no special tokens. Null
    texts count as empty: no tokens, the digests of nothing. Repeated rows each give their row; an empty table gives none;
    columns other than doc_id and text are ignored. One map over the rows: no shuffle; texts pass through a worker in runs of
    bounded size.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(vocabulary, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for run in chunks(text or "" for text in strings(batch.column("text"))):
                ids = coder.encode(run)
                digests = [hashlib.sha256() for _ in run]
                for place, part in coder.decode(ids):
                    digests[place].update(part)
                rows += [(len(x) // 4, hashlib.sha256(x).hexdigest(), d.hexdigest()) for x, d in zip(ids, digests, strict=True)]
            yield with_ids(batch, rows, TYPES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(work, keeps=True), SCHEMA)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and the ids themselves, as an array; null texts give an empty one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(vocabulary, pattern)
        for batch in batches:
            ids = [x for run in chunks(text or "" for text in strings(batch.column("text"))) for x in coder.encode(run)]
            yield with_ids(batch, [(np.frombuffer(x, "<u4").astype(np.int32),) for x in ids], {"ids": pa.list_(pa.int32())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(work, keeps=True), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of ``ids``; null or empty ids give no bytes, ids that aren't tokens are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(vocabulary, pattern)
        for batch in batches:
            ids = [np.array(x or [], "<u4").tobytes() for x in batch.column("ids").to_pylist()]
            parts: list[list[bytes]] = [[] for _ in ids]
            for place, part in coder.decode(ids):
                parts[place].append(part)
            yield with_ids(batch, [(b"".join(x),) for x in parts], {"bytes": pa.binary()})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(releasing(work, keeps=True), "doc_id long, bytes binary")
