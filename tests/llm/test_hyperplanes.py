"""Near-dedup of embeddings against all pairs, on odd tables and in small blocks."""

import math
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import hyperplanes

SCHEMA = "vec_id long, embedding array<float>, label int, keys int, `a.b` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) if v is not None else None for v in x] if x is not None else None, label, 1, "x") for i, x, label in rows], SCHEMA)


def plain(rows, cosine=0.98):
    """n_links, component_id of every row, by all pairs."""
    fine = [x is not None and len(x) > 0 and label is not None and all(v is not None and math.isfinite(v) for v in x) and any(x) for _, x, label in rows]
    x = [np.float32(v).astype(np.float64) if ok else None for ok, (_, v, _) in zip(fine, rows, strict=True)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if fine[a] and fine[b] and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]):
                p, q = x[a] / np.abs(x[a]).max(), x[b] / np.abs(x[b]).max()
                if (x[a] == x[b]).all() or p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, links[a], c := least.get(find(a)), i == c) for a, (i, _, _) in enumerate(rows)]


def vectors(seed, n=400, dim=16):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, dim))
    rows = [(i, base[i], i % 3) for i in range(n)]
    for k in range(0, n, 9):  # copies, scaled copies and near ones, some in another label
        rows += [(n + 10 * k, base[k], k % 3), (n + 10 * k + 1, base[k] * 3, k % 3), (n + 10 * k + 2, base[k], (k + 1) % 3)]
        rows += [(n + 10 * k + 3 + j, base[k] + 0.06 * r.standard_normal(dim), k % 3) for j in range(4)]
    centre = r.standard_normal(dim)  # one large group of near copies
    rows += [(100_000 + j, centre + 0.03 * r.standard_normal(dim), 1) for j in range(150)]
    odd = [(None, base[0], 0), (None, base[0], 0), (None, None, 1), (1, base[1], 1), (1, base[1], 1), (1, base[2], 2), (7, None, 1), (7, [0.0] * dim, 1), (8, [math.nan] * dim, 1)]
    odd += [(9, [], 1), (10, [None] * dim, 1), (11, [math.inf] * dim, 1), (12, base[3], None), (13, base[3], None), (14, base[3][:4], 0), (15, base[3][:4], 0), (16, base[4] * 1e30, 1), (17, base[4] * 1e-30, 1)]
    return rows + odd


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize(("block", "small"), [(512, 32), (24, 4)])
def test_equals_all_pairs(spark, monkeypatch, block, small):
    monkeypatch.setattr(hyperplanes, "BLOCK", block)
    monkeypatch.setattr(hyperplanes, "SMALL", small)
    rows = vectors(5)
    got = result(hyperplanes.near_duplicates(frame(spark, rows).repartition(5), miss=1e-9))
    want = sorted([(i, n, c, (i == c) if i is not None or c is not None else True) for i, n, c, _ in plain(rows)], key=str)
    assert got == want


def test_recall_with_production_parameters(spark):
    rows = vectors(6)
    got, want = Counter(), Counter()
    for counts, found in ((got, result(hyperplanes.near_duplicates(frame(spark, rows)))), (want, plain(rows))):
        for i, n, _, _ in found:
            counts[i] += n
    assert got <= want
    assert sum(got.values()) >= 0.98 * sum(want.values())


def test_more_vectors_get_longer_hashes_and_more_tables():
    known = [hyperplanes.tables(n) for n in (1, 10_000, 10**6, 10**9)]
    assert known == sorted(known)
    for bits, n in known:
        assert (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** n <= 0.005


def test_empty_tables(spark):
    assert hyperplanes.near_duplicates(frame(spark, vectors(5, 9)).limit(0)).collect() == []
    assert result(hyperplanes.near_duplicates(frame(spark, [(1, None, 1), (None, [0.0], 2)]))) == [(1, 0, 1, True), (None, 0, None, True)]
