"""Phrases against a plain count, on odd tables; chunks hold every phrase once."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tidewatch.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest, top):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            f["und" if lang is None else lang].update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        frequent = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in frequent.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and frequent[p[i:j]] <= a}
        found = []
        for p, a in frequent.items():
            if p not in inside:
                score, k = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.8))}" for _ in range(40 * n)]
    passage = " ".join(r.choice(words) for _ in range(120))
    texts = [(" ".join(r.choice(words) + r.choice(["", "", "", ".", ", ", "\n", "\t"]) for _ in range(r.randint(0, 80))), r.choice(["en", "de", None, "und", ""])) for _ in range(n)]
    texts += [(passage if i % 2 else f"Start {passage} {i}", "en") for i in range(n // 4)]
    odd = [None, "", " \t ", ".,;:!?", "a " * 3000, "a. " * 50, "É é É é É é \U0001f600 \x1f x\x85y W1 w1", "x" * 9000, "w1\rw2\x0bw1\x0cw2 w1 w2", "Same row here", "Same row here"]
    return texts + [(t, lang) for t in odd for lang in ("en", None)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, lang, 1) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string, `chunk.word` int")


@pytest.mark.parametrize(("least", "longest", "top", "spacing"), [(6, 5, 2000, 64), (3, 5, 40, 4), (2, 3, 2000, 1), (2, 2, 2000, 8)])
def test_equals_a_plain_count(spark, monkeypatch, least, longest, top, spacing):
    monkeypatch.setattr(collocations, "PHRASES", 500)
    monkeypatch.setattr(collocations, "TOKENS", 300)
    monkeypatch.setattr(collocations, "WORDS", 50)
    texts = corpus(least, 160)
    got = rows(collocations.collocations(frame(spark, texts).repartition(5), least, longest, top, spacing))
    assert got and got == plain(texts, least, longest, top)


def test_a_full_filter_lets_through_and_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    texts = corpus(9, 60)
    assert rows(collocations.collocations(frame(spark, texts), 4)) == plain(texts, 4, 5, 2000)


def test_products_beyond_64_bits(spark):
    level = spark.createDataFrame([(1, "en", "a b", 4 * 10**15, [5 * 10**15], [6 * 10**15], 9 * 10**15)], "id long, lang string, phrase string, a long, begins array<long>, ends array<long>, total long")
    r = collocations._scored(level, 2).first()
    assert (r.l, r.r, r.score) == (5 * 10**15, 6 * 10**15, 1000 * 4 * 9 // 30)


def test_equal_passages_are_cut_alike():
    r = random.Random(3)
    passage = [b"%d" % r.randrange(300) for _ in range(600)]
    known = [set(collocations.chunks([b"x%d" % k] * k + passage, 4, 16)) for k in (1, 7, 30)]
    assert all(len(known[0] & other) > 0.9 * len(known[0]) - 2 for other in known[1:])
    for spacing in (1, 16, 10**9):
        whole = [w for c in collocations.chunks(passage, 4, spacing) for w in c.split()[4:]]
        assert whole == passage


def test_empty_tables(spark):
    assert collocations.collocations(frame(spark, [("a b", "en")]).limit(0)).collect() == []
    assert collocations.collocations(frame(spark, [(None, None), ("", "en")])).collect() == []
