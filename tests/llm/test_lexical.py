"""Ranked lexical search against a plain scan, on odd tables, small blocks and small bundles."""

import math
import random
import re
from collections import Counter

import pytest

from tidewatch.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top):
    own = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, size = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, words in asked.items():
        found = []
        for i, c in own:
            m = 50 + (50 * sum(c.values()) * n) // size
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(30 * n)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(n)]
    odd = ["", None, "...", "Straße É日本 x-Y_z", "w1 " * 5000, "a" * 20000, "W1 w1, W2", "W1 w1, W2"]
    return docs + [(n + i, t) for i, t in enumerate(odd)] + [(3, "w1 w2 w3"), (3, "w1 w2 w3"), (3, "w9"), (None, "w2 w1"), (None, "w2 w1")]


def items(seed, n):
    r = random.Random(seed)
    return [(i, " ".join(f"w{int(r.paretovariate(0.6))}" for _ in range(r.randint(1, 12)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "nowhere"), (0, "w1 straße"), (None, "w1"), (1, "w2"), (1, "w2")]


def frames(spark, docs, asked):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, `item.id` string"), spark.createDataFrame([(i, t, 1) for i, t in asked], "item_id long, text string, term int")


@pytest.mark.parametrize(("block", "bundle", "vocabulary"), [(4096, 64, 1 << 18), (16, 3, 1 << 18), (50, 4, 0)])
def test_equals_a_plain_scan(spark, monkeypatch, block, bundle, vocabulary):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "BUNDLE", bundle)
    monkeypatch.setattr(lexical, "VOCABULARY", vocabulary)  # 0: no term is broadcast
    docs, asked = corpus(1, 300), items(2, 9)
    d, i = frames(spark, docs, asked)
    assert rows(lexical.search(d.repartition(5), i, top=7)) == plain(docs, asked, 7)


def test_ties_go_by_doc_id_and_floors_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 8)
    docs = [(i, "same words here" if i % 3 else f"rare{i % 40} same words") for i in range(240)] + [(i, "other filler text") for i in range(240, 1500)]
    asked = [(0, "same words here"), (1, "rare3 rare6 same filler"), (2, "other text rare9")]
    d, i = frames(spark, docs, asked)
    assert rows(lexical.search(d.repartition(6), i, top=10)) == plain(docs, asked, 10)


def test_empty_tables(spark):
    d, i = frames(spark, corpus(1, 5), items(2, 2))
    assert lexical.search(d.limit(0), i).collect() == []
    assert lexical.search(d, i.limit(0)).collect() == []
