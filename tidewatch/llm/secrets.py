"""Secret scans: fixed patterns, plus random-looking strings found by token efficiency.

A vocabulary trained on prose and code spends few characters per token on strings it has never seen. Candidates that
are digests, UUIDs, dates or numbers by their form and short plain words are excluded first; what then averages too few
characters per token is a span.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings, with_ids

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The longest runs of 32 and more are those of any length that reach 32.
HEX = re.compile(r"[0-9a-f]{32,}")
#: = is padding at the end only: before a string it parts a value from its name.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,}={0,2}(?![A-Za-z0-9+/_-])")
#: Forms that are known not to be secrets: digests by their length, UUIDs, dates, numbers. All else is left to the ratio.
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[0-9]{4}-?[0-9]{2}-?[0-9]{2}T[0-9-]+Z?|[0-9_/+-]+)={0,2}"
)
#: Letters written as a word is are tried from this length: in shorter ones rare words and random letters spend alike.
WORD, WORD_LENGTH = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), 16
KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}
#: Characters per token below which a candidate counts as random.
RATIO = 2.0
TYPES = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_random": pa.int64()}
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """A tiktoken encoding from a rank file on this machine; one per worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, kind:start:end) of the fixed patterns' matches, in code points."""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, coder, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """Strings whose characters per token fall below ``ratio``, after the exclusions."""
    found = []
    for m in CANDIDATE.finditer(text):
        word = m.group()
        if len(word) < WORD_LENGTH and WORD.fullmatch(word) or KNOWN.fullmatch(word):
            continue
        if len(word) < ratio * len(coder.encode_ordinary(word)):
            found.append((m.start(), 3, f"random:{m.start()}:{m.end()}"))
    return found


def scan_secrets(docs: DataFrame, vocabulary: str, pattern: str, ratio: float = RATIO) -> DataFrame:
    """Spans of secrets in every whole text.

    ``vocabulary`` is a tiktoken rank file present on every machine, ``pattern`` its split pattern. Null texts count as
    empty: no spans, the digest of the empty string. Repeated rows each give their row; an empty table gives none; columns
    other than doc_id and text are ignored. One map over the rows: no shuffle, memory of one Arrow batch.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary, pattern)
        for batch in batches:
            rows = []
            for text in strings(batch.column("text")):
                text = text or ""
                base = base_spans(text)
                more = random_spans(text, coder, ratio)
                kinds = [place for _, place, _ in base]
                joined = ",".join(span for *_, span in base)
                every = ",".join(span for *_, span in sorted(base + more))
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined.encode()).hexdigest(), every, len(more)))
            yield with_ids(batch, rows, TYPES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)
