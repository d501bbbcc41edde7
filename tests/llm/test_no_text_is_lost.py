"""No distinct text is lost where ids are shared, missing or repeated; a hot row doesn't fill a shard."""

from collections import Counter

from tests.llm.test_odd_tables import clashing
from tidewatch.llm import exact_dedup, line_dedup, mixing, ngram_join, sharding

W = " ".join(f"w{i}" for i in range(40))
U = " ".join(f"u{i}" for i in range(40))


def texts(df):
    return sorted(str((r.doc_id, r.text)) for r in df.select("doc_id", "text").collect())


def test_near_copies_go_text_by_text(spark):
    rows = [(3, W), (5, W), (5, U), (6, U + " more"), (3, W), (None, W), (None, U), (7, ""), (7, None), (8, W + " x")]
    d = clashing(spark, [(i, t, "en", "s") for i, t in rows])
    kept = ngram_join.keep_one(d)
    assert kept.columns == d.columns
    assert texts(kept) == texts(spark.createDataFrame([(3, W), (5, U), (None, W), (None, U), (7, ""), (7, None)], "doc_id long, text string"))


def test_one_document_with_several_texts_is_one_component(spark):
    rows = [(3, W), (5, W), (5, U), (6, U + " more"), (9, "alone in the world with five words"), (5, "")]
    found = {(r.doc_id, r.component_id) for r in ngram_join.ngram_join(clashing(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert found == {(3, 3), (5, 3), (6, 3), (9, 9)}


def test_rows_without_an_id_are_mixed(spark):
    rows = [(None, f"a{i} b c d", "en", "s") for i in range(60)] + [(i, f"e{i} f g", "en", "t") for i in range(60)] + [(1, "other words here", "en", "t")] * 4
    d = clashing(spark, rows)
    taken = mixing.mix(d).agg({"copies": "sum"}).first()[0]
    got = Counter((r.doc_id, r.text) for r in mixing.repeat(d).collect())
    assert sum(got.values()) == taken and sum(n for (i, _), n in got.items() if i is None) > 30
    assert all(n <= 3 * rows.count((*k, "en", "s")) + 3 * rows.count((*k, "en", "t")) for k, n in got.items())


def test_exact_copies_without_an_id(spark):
    rows = [(None, "one"), (None, "two"), (None, "TWO"), (4, "one"), (4, "three"), (4, "three"), (9, "Three"), (5, None), (6, "")]
    kept = exact_dedup.keep_one(clashing(spark, [(i, t, "en", "s") for i, t in rows]))
    found = [(r.doc_id, (r.text or "").lower()) for r in kept.collect()]
    assert sorted(found, key=str) == sorted([(4, "one"), (None, "two"), (9, "three"), (6, "")], key=str)


def test_bytes_stay_near_equal_when_half_of_the_rows_are_one_row(spark):
    rows = [(7, "t" * 17, "en", "s")] * 1000 + [(i, "t" * 17, "en", "s") for i in range(1000, 2000)]
    for parts in (1, 8):
        loads = Counter()
        for r in sharding.shard_documents(clashing(spark, rows).repartition(parts)).collect():
            loads[r.shard] += r["size"]
        assert len(loads) == 40 and max(loads.values()) - min(loads.values()) <= 3 * 33
    # a second derivation of the first map: largest slots first, each to the lightest shard
    totals = [(s, (s * 7919) % 301) for s in range(256)]
    want, load = {}, [0] * 7
    for s, b in sorted(totals, key=lambda x: (-x[1], x[0])):
        want[s] = load.index(min(load))
        load[want[s]] += b
    got = sharding.first_map(spark.createDataFrame(totals, "virtual_slot int, bytes long"), 7)
    assert {r.virtual_slot: r.shard for r in got.collect()} == want


def test_the_line_stage_keeps_other_columns(spark):
    import corpus_pipeline

    d = spark.createDataFrame([(1, "x\ny\nz\nown", 5, 6), (2, "x\ny\nz\nother", 7, 8)], "doc_id long, text string, n_lines int, n_removed int")
    got = corpus_pipeline.drop_repeated_lines(spark, d, "")
    assert got.columns == d.columns and sorted(map(tuple, got.collect())) == [(1, "x\ny\nz\nown", 5, 6), (2, "other", 7, 8)]
    assert sorted(r.n_lines for r in line_dedup.dedup_lines(d).collect()) == [4, 4]
