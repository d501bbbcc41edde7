"""Every corpus operator on odd tables: clashing columns, repeated rows, ties, very long texts, null ids, empty tables; stored maps; the pipeline against plain Python."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tidewatch.llm import ann, bpe, exact_dedup, langid, line_dedup, mixing, ngram_join, secrets, sharding, toxicity

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: Names that operators use inside.
CLASH = ["size", "key", "grp", "digit", "rest", "_starts", "starts", "line", "w", "a", "b", "cls", "n", "part", "virtual_slot", "shard", "slot", "copies", "rows", "words", "row", "id", "of", "source_size", "score", "lang_pred", "spans", "count", "max", "key.with.dots"]
LONG = " ".join(f"word{i % 977} \n" if i % 9 == 0 else f"word{i * 31 % 7919}" for i in range(60_000))


def clashing(spark, rows):
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], schema)


ROWS = [(1, "x\ny\nz", "en", "s"), (1, "x\ny\nz", "en", "s"), (2, LONG, "de", "s"), (3, LONG, "de", None), (4, None, None, None), (None, "x\ny\nz", "en", "t"), (None, "", "en", "t"), (5, "", "en", "s"), (6, "a b c d e f g", "en", "t")]


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(7)] + [(1, None), (None, 1)], "doc_id long, toxic int")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)),
    "clean": lambda s, d: toxicity.keep_clean(d, labels(s)),
    "ngrams": lambda s, d: ngram_join.ngram_join(d),
    "ngrams kept": lambda s, d: ngram_join.keep_one(d),
    "exact": lambda s, d: exact_dedup.exact_duplicates(d),
    "shards": lambda s, d: sharding.shard_documents(d),
    "bpe": lambda s, d: bpe.encode_and_decode(d, PATH, PATTERN),
    "mix": lambda s, d: mixing.mix(d),
    "repeat": lambda s, d: mixing.repeat(d),
    "language": lambda s, d: langid.identify(d),
    "secrets": lambda s, d: secrets.scan_secrets(d, PATH, PATTERN),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_columns(spark, name):
    got = OPERATORS[name](spark, clashing(spark, ROWS)).collect()
    if name not in ("clean", "ngrams kept", "repeat"):
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert OPERATORS[name](spark, clashing(spark, [])).count() == 0


def test_equal_rows_get_equal_results(spark):
    d = clashing(spark, ROWS)
    for name in ("toxicity", "ngrams", "exact", "bpe", "language", "secrets", "lines"):
        by = collections.defaultdict(set)
        for r in OPERATORS[name](spark, d).filter("doc_id = 1").collect():
            by[r.doc_id].add(str(r))
        assert len(by[1]) == 1, name


def test_lines_of_different_texts_under_one_id(spark):
    rows = [(0, "x\ny\nz", "", ""), (1, "a\nb\nc\nd", "", ""), (1, "x\ny\nz", "", "")]
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(clashing(spark, rows)).collect())
    assert got == [(0, "x\ny\nz"), (1, ""), (1, "a\nb\nc\nd")]


def test_lines_of_a_hot_window(spark):
    rows = [(i, f"u{i}\nx\ny\nz\nv{i}", "", "") for i in range(1500)] + [(5000 + i, f"p{i % 2}\nq\nr\ns{i % 2}\n{i}", "", "") for i in range(4)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(clashing(spark, rows)).collect()}
    assert got[0].n_removed == 0 and all(got[i].text == f"u{i}\nv{i}" for i in range(1, 1500))
    assert [got[5000 + i].n_removed for i in range(4)] == [0, 0, 4, 4]


def test_exact_groups_cold_and_hot(spark):
    head = "h" * 60
    texts = ["hot"] * 900 + [head + "x" * 500] * 600 + [head + "x" * 499] * 2 + [head + str(i) for i in range(300)] + [head + "Y", head + "y"]
    random.Random(1).shuffle(texts)
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t.lower()].append(i)
    for r in exact_dedup.exact_duplicates(clashing(spark, [(i, t, "", "") for i, t in enumerate(texts)])).collect():
        own = groups[texts[r.doc_id].lower()]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(own), len(own), r.doc_id == max(own), hashlib.sha256(texts[r.doc_id].lower().encode()).hexdigest())


def test_stored_map_grows_and_rebalances(spark, tmp_path):
    rows = [(i, "t" * (i % 90), "", "") for i in range(4000)]
    path = f"file://{tmp_path}/map"
    first = {r.doc_id: r for r in sharding.shard_documents(clashing(spark, rows), 8, 512, map_path=path).collect()}
    assert sharding.load_map(spark, path, 1).count() == sharding.load_map(spark, path).count() == 512 and sharding.load_map(spark, path).first().version == 2
    # the stored first version places the same rows alike, whatever else has come
    more = rows + [(10_000 + i, "u" * 50, "", "") for i in range(500)]
    again = {r.doc_id: r for r in sharding.shard_documents(clashing(spark, more), 8, 512, slot_map=sharding.load_map(spark, path, 1)).collect()}
    assert all(again[i].shard == first[i].shard for i in first)
    # skewed loads: shard 0 holds three times its part, nothing else moves but into shards below the mean
    held = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    totals = spark.createDataFrame([(s, 300 if shard == 0 else 100) for s, shard in held.items()], "virtual_slot int, bytes long")
    after = {r.virtual_slot: r for r in sharding.rebalance(sharding.load_map(spark, path, 1), totals, 8).collect()}
    load = collections.Counter()
    for s, r in after.items():
        load[r.shard] += 300 if held[s] == 0 else 100
        assert r.version == 2 and (r.shard == held[s] or held[s] == 0)
    assert len(after) == 512 and max(load.values()) - min(load.values()) <= 900
    with pytest.raises(ValueError):
        sharding.shard_documents(clashing(spark, rows), 8, 256, slot_map=sharding.load_map(spark, path, 1))


def test_sharding_numbers_a_hot_row_gaplessly(spark):
    got = sharding.shard_documents(clashing(spark, [(7, "same", "", "")] * 3000 + [(None, f"n{i}", "", "") for i in range(500)]).repartition(5)).collect()
    places = collections.defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert len(got) == 3500 and all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) > 20


def test_huge_components_keep_their_neighbours(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 8)) * np.where(np.arange(60) % 2, 1e100, 1.0)[:, None]
    d = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for x in ann.nearest(d, query_every=20, k=5).orderBy("query_id", "rank").collect():
        got[x.query_id].append(x.vec_id)
    for q in (0, 20, 40):
        s = v @ v[q]
        assert got[q] == [i for i in np.lexsort((np.arange(60), -s)) if i != q][:5]


def test_long_pieces_go_by_the_recursive_query():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, r = bpe.Coder(PATH, PATTERN), random.Random(2)
    pieces = ["a" * 300_000, "".join(r.choice("abcdefgh") for _ in range(3000)), "é" * 2000, "".join(r.choice("etaoin") for _ in range(2500)), "ab" * 33]
    assert coder.encode(pieces) == [np.array(library.encode_ordinary(p), "<u4").tobytes() for p in pieces]
    assert coder.held > 0 and coder.db.execute("select current_setting('temp_directory')").fetchone()[0] == ""


def test_digest_clashes_are_told_apart(spark):
    sets = spark.createDataFrame([(1, 10, 5), (2, 10, 6), (3, 10, 5), (4, 11, 7), (5, None, None)], "doc_id long, cls long, chk long")
    moved = ngram_join._moved(sets)
    assert list(moved) == [(10, 6)] and moved[10, 6] != 10 and ngram_join._moved(sets.filter("doc_id <> 2")) == {}


def test_sketches_bound_differences_at_either_width():
    r = np.random.default_rng(3)
    for n, more in ((100, 40), (130, 120), (1000, 900), (20_000, 500)):
        a = r.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n - 10], r.integers(0, 2**63, more).astype(np.uint64)])
        found = ngram_join._Sketches([ngram_join.sketch(a), ngram_join.sketch(b)]).apart(np.array([0, 1]), np.array([1, 0]))
        assert found[0] == found[1] <= 10 + more and ngram_join._Sketches([ngram_join.sketch(a)] * 2).apart(np.array([0]), np.array([1]))[0] == 0


def test_many_languages_stay_bounded(spark):
    rows = [(i, f"{'abcdefghij'[i % 10] * 3} text {i}", f"l{i % 50}", "s") for i in range(1000)]
    model = langid.fit(clashing(spark, rows), fit_rows=4)
    assert len(model.families) == 50 and len(model.machines) == 50


def test_secrets_against_a_plain_scanner(spark):
    r = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    planted = ["".join(r.choice(alphabet) for _ in range(24)) for _ in range(200)]
    rows = [(i, f"the quick brown fox {p} jumps over it", "", "") for i, p in enumerate(planted)]
    rows += [(1000 + i, r.choice(['password="', "API_KEY: ", "token='", "secret=", "passwd : "]) + "x" * r.randint(5, 12) + " AKIA" + "Z" * r.randint(8, 14) + " " + "a1" * r.randint(10, 20), "", "") for i in range(200)]
    got = {x.doc_id: x for x in secrets.scan_secrets(clashing(spark, rows), PATH, PATTERN).collect()}
    assert sum(got[i].n_random == 1 for i in range(200)) >= 190

    def scan(text):
        spans, low = [], text.lower()
        for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            at = low.find(word)
            if at >= 0:
                end = at + len(word) + (text[at + len(word)] in "\"'")
                while text[end] == " ":
                    end += 1
                if text[end] in ":=":
                    end += 1
                    while text[end] == " ":
                        end += 1
                    end += text[end] in "\"'"
                    stop = end
                    while stop < len(text) and (text[stop].isalnum() or text[stop] in "+/_.=-"):
                        stop += 1
                    if stop - end >= 8:
                        spans.append((at, f"assign:{at}:{stop}"))
        at = text.find("AKIA")
        stop = text.find(" ", at)
        if stop - at >= 16:
            spans.append((at, f"access:{at}:{stop}"))
        if len(text) - stop - 1 >= 32:
            spans.append((stop + 1, f"hex:{stop + 1}:{len(text)}"))
        return ",".join(s for _, s in sorted(spans))

    for i, text, *_ in rows[200:]:
        assert got[i].base_sha256 == hashlib.sha256(scan(text).encode()).hexdigest(), text


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(i, prose(60) + (" vilescum rottenoaf foulcretin" * 3 if i % 5 == 0 else ""), "en", f"s{i % 2}", 1) for i in range(600)]
    passage = "\n".join(prose(20) for _ in range(4))
    rows += [(1000 + i, f"{prose(30)}\n{passage}\n{prose(30)}", "en", "s0", 1) for i in range(5)]
    base = prose(200).split()
    rows += [(2000 + i, " ".join(base[:100] + [f"edit{i}"] + base[101:]), "en", "s1", 1) for i in range(5)] + [(None, None, None, None, None), (3000, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, stage(spark, d, str(tmp_path))
        kept[name] = d.collect()
        assert name == "byte_bpe" or d.columns == before.columns
    toxic = {r_.doc_id for r_ in kept["toxicity"]}
    assert len([i for i in range(600) if i % 5 == 0 and i in toxic]) <= 6 and len([i for i in range(600) if i % 5 and i in toxic]) >= 475 and {None, 3000, 1000, 2000} <= toxic
    lines = {r_.doc_id: r_.text for r_ in kept["line_dedup"]}
    assert passage in lines[1000] and all(passage.split("\n")[1] not in lines[1000 + i] for i in range(1, 5))
    near = {r_.doc_id for r_ in kept["ngram_join"]}
    assert near & set(range(2000, 2005)) == {2000} and near & set(range(1000, 1005)) == set(range(1000, 1005))
    counts = collections.Counter(r_.doc_id for r_ in kept["mixing"])
    assert counts <= collections.Counter({i: 3 for i in near}) and sum(counts.values()) == len(kept["byte_bpe"])
    texts = {r_.doc_id: r_.text for r_ in kept["mixing"]}
    assert all(r_.decoded_sha256 == hashlib.sha256((texts[r_.doc_id] or "").encode()).hexdigest() for r_ in kept["byte_bpe"])


def test_scratch_is_closed_and_needs_a_shared_folder(spark):
    from tidewatch.llm.common import Scratch

    scratch = Scratch(spark, "x")
    path = scratch.write(spark.range(3), "t")
    scratch.close()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scratch.read(path).count()
