"""The corpus operators on small tables: brute force, exact round trips, held-out accuracy, and odd rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidewatch.llm import ann, bpe, exact_dedup, langid, line_dedup, mixing, ngram_join, secrets, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Null, empty, blank and repeated texts, null ids, odd characters.
ODD = ["", None, " ", "\n\n\n\n", "a", "a", "A", "Straße É 日本 \U0001f600", "x" * 5000, "one two", "\x1f \x85  tab\tend", "<|endoftext|>"]


def docs(spark, texts, ids=None):
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], len(t or ""), "x") for i, t in enumerate(texts)]
    if ids:
        rows = [(ids[i], *r[1:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, words=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, words))) for _ in range(n)]


def edited(text, seed, edits):
    r = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# exact dedup


def test_exact_dedup_against_groups(spark):
    texts = ODD + prose(1, 30) + prose(1, 30) + ["p" * 300 + s for s in ("a", "b", "B", "", "a")] + ["q" * 200000] * 2
    got = exact_dedup.exact_duplicates(docs(spark, texts)).collect()
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower(t)].append(i)
    assert len(got) == len(texts)
    for r in got:
        own = groups[lower(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256(lower(texts[r.doc_id]).encode()).hexdigest()


def test_exact_dedup_odd_ids_and_empty_table(spark):
    got = exact_dedup.exact_duplicates(docs(spark, ["x", "x", "x", "y", "y"], [None, 5, 5, None, None])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == [(-1, -1, 2, True), (-1, -1, 2, True), (-1, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True)]
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.keep_one(docs(spark, ["x", "X", "y"])).collect()) == [1, 2]


# n-gram join


def components(texts, k, num, den):
    sets = [frozenset(ngram_join.shingle_hashes(t, k).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 60)])
def test_ngram_join_against_all_pairs(spark, k, num):
    base = prose(2, 12, 150) + prose(3, 25, 12)
    texts = ODD + base + [edited(t, i, 1 + i % 3) for i, t in enumerate(base) if len(t.split()) > 3] + [edited(base[0], 100 + i, i % 6) for i in range(60)] + base[:5]
    got = {r.doc_id: r for r in ngram_join.ngram_join(docs(spark, texts), k, num, 100).collect()}
    assert [got[i].component_id for i in range(len(texts))] == components(texts, k, num, 100)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(ngram_join.shingle_hashes(t, k)) for t in texts]


def test_shingles_follow_the_contract():
    assert len(ngram_join.shingle_hashes("A b\tC\x0bd", 3)) == 2
    assert ngram_join.shingle_hashes("A b", 3).tolist() == ngram_join.shingle_hashes("a B", 3).tolist() != ngram_join.shingle_hashes("a c", 3).tolist()
    assert len(ngram_join.shingle_hashes("x\xa0y z", 3)) == 1 and not len(ngram_join.shingle_hashes(" \n", 3)) and not len(ngram_join.shingle_hashes(None, 3))


@pytest.mark.parametrize("seed", range(3))
def test_similar_sets_share_an_index_entry(seed):
    r = np.random.default_rng(seed)
    universe = r.integers(0, 2**63, 400).astype(np.uint64)
    counts = dict(zip(universe.tolist(), r.choice([0, 5, 50, 5000], 400), strict=True))
    for _ in range(300):
        a = set(r.choice(universe, r.integers(1, 200), replace=False).tolist())
        b = set(a)
        for x in r.choice(list(a), r.integers(0, max(1, len(a) // 12) + 1)):
            b.discard(x)
        b |= set(r.choice(universe, r.integers(0, 4)).tolist())
        if b and 10 * len(a & b) >= 8 * len(a | b):
            found = [ngram_join.entries(t := np.array(sorted(s), np.uint64), np.array([counts[x] for x in t.tolist()]), 1000, 80, 100) for s in (a, b)]
            assert set(found[0].tolist()) & set(found[1].tolist())


@pytest.mark.parametrize("n", [127, 130, 500, 515, 1000, 2100, 9000])
def test_entries_of_very_frequent_tokens_stay_in_proportion(n):
    r = np.random.default_rng(n)
    for num in (80, 90):
        a = r.integers(0, 2**63, n).astype(np.uint64)
        t = ngram_join.losses(n, num, 100)
        b, longer = a[t:], np.concatenate([a, r.integers(0, 2**63, n * (100 - num) // num).astype(np.uint64)])
        found = [set(ngram_join.entries(np.sort(s), np.full(len(s), 5000), 1000, num, 100).tolist()) for s in (a, b, longer)]
        assert found[0] & found[1] and found[0] & found[2]
        assert max(map(len, found)) <= 100 * len(longer)


def test_ngram_join_hot_copies_of_a_long_text(spark):
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(1500))
    texts = [long] * 1010 + [edited(long, i, 20) for i in range(4)] + [edited(long, 9, 900)]
    got = {r.doc_id: r for r in ngram_join.ngram_join(docs(spark, texts), 5, 80, 100).collect()}
    assert [got[i].component_id for i in range(len(texts))] == [0] * 1014 + [1014]


def test_ngram_join_odd_ids(spark):
    t = prose(4, 1, 60)[0]
    got = ngram_join.ngram_join(docs(spark, [t, t, t, ""], [7, None, 7, 9])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (7, 7), (7, 7), (9, 9)]
    assert ngram_join.ngram_join(docs(spark, [])).count() == 0


# toxicity


def segments_by_definition(scores):
    """Ruzzo and Tompa's definition: split at the segment of greatest sum, both sides again."""
    if not len(scores) or max(scores) <= 0:
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    best = max(((sums[b] - sums[a], -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), key=lambda x: (round(x[0], 9), x[1], -x[2]))
    _, _, a, b = best
    return [*segments_by_definition(scores[:a]), (a, b), *[(x + b, y + b) for x, y in segments_by_definition(scores[b:])]]


@pytest.mark.parametrize("seed", range(20))
def test_maximal_segments(seed):
    r = np.random.default_rng(seed)
    scores = r.normal(-0.2, 1, r.integers(0, 40))
    assert [(a, b) for a, b, _ in toxicity.maximal_segments(scores)] == segments_by_definition(scores)


def test_toxicity_held_out(spark):
    r, texts, marks = random.Random(5), [], []
    for i, t in enumerate(prose(6, 1500, 60)):
        words = t.split()
        marks.append(i % 5 == 0)
        if marks[-1]:
            for _ in range(4):
                words.insert(r.randint(0, len(words)), r.choice(["vilescum", "rottenoaf", "foulcretin"]))
        texts.append(" ".join(words))
    d = docs(spark, texts + ODD)
    labels = spark.createDataFrame([(i, int(m)) for i, m in enumerate(marks)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(d, labels).collect()}
    assert len(got) == len(texts) + len(ODD)
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(len(texts)))
    assert sum(got[i].predicted == marks[i] for i in held) / len(held) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got.values())


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_toxicity(docs(spark, ODD), labels).collect()} == {0}


# sharding


def test_sharding_laws(spark):
    texts = ODD + prose(7, 3000)
    got = sharding.shard_documents(docs(spark, texts)).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"bytes"}
    load, places = collections.Counter(), collections.defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len(load) == 40 and max(load.values()) - min(load.values()) <= max(len((t or "").encode()) for t in texts) + 16
    # growing moves slots into the new shard alone
    assert all(r.next_shard in (r.shard, 40) for r in got) and any(r.next_shard == 40 for r in got)
    assert len({(r.virtual_slot, r.shard) for r in got}) == len({r.virtual_slot for r in got})


def test_sharding_empty_and_repeated(spark):
    assert sharding.shard_documents(docs(spark, [])).count() == 0
    got = sharding.shard_documents(docs(spark, ["x"] * 6, [1, 1, None, None, 2, 2])).collect()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


# BPE


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_library_and_round_trips(spark, library):
    texts = ODD + prose(8, 50) + ["ab" * 400, "aaaab" * 50, "=" * 200, "".join(random.Random(1).choice("ab") for _ in range(300)), "\n" * 100 + " x"]
    got = {r.doc_id: r for r in bpe.encode_and_decode(docs(spark, texts), PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode(docs(spark, texts), PATH, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(encoded, PATH, public_tokenizers.PATTERN).collect()}
    assert [back[i] for i in range(len(texts))] == [(t or "").encode() for t in texts]
    assert bpe.encode_and_decode(docs(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


# mixing


def brute_targets(sizes, cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = {s: w[s] for s in names if s not in capped}
        share = (total - sum(capped.values())) / sum(left.values()) if left else 0
        over = [s for s in left if w[s] * share > cap * sizes[s]]
        if not over:
            return {s: capped.get(s, w[s] * share) for s in names}
        capped |= {s: cap * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    r = random.Random(9)
    rows = [(i, "w " * r.choice([0, 1, 5, 50, 200]), "en", r.choice(["a", "b", "c", "d", None]) if i % 50 else "tiny", 1, "") for i in range(3000)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(d, group_rows=100).collect()
    assert len(got) == 3000 and all(0 <= x.taken <= 3 * x.size for x in got)
    sizes, taken = collections.Counter(), collections.Counter()
    for x in got:
        sizes[x.source] += x.size
        taken[x.source] += x.taken
    want = brute_targets(sizes)
    goals = {x.source: x.target for x in got}
    assert all(abs(goals[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert all(abs(taken[s] - want[s]) <= 200 for s in want)
    again = {x.doc_id: x.taken for x in mixing.mix(d.repartition(7), group_rows=100).collect()}
    assert again == {x.doc_id: x.taken for x in got}
    copies = collections.Counter(x.doc_id for x in mixing.repeat(d, group_rows=100).collect())
    assert copies == {x.doc_id: x.copies for x in got if x.copies}


def test_mix_odd_tables(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    got = mixing.mix(docs(spark, ODD + ["one"], [1, 1, None, *range(len(ODD) - 2)])).collect()
    assert len(got) == len(ODD) + 1 and all(x.size == len(re.findall(r"[^\x20\x09-\x0D]+", "z")) or x.size >= 0 for x in got)


# language


def test_language_held_out(spark):
    r = random.Random(10)
    vocabulary = {"en": "the and of thing ing wh er", "de": "der und ung keit sch ein", "fr": "le et eau oux ent ai", "es": "el y cion ado os ar"}
    rows = [(i, " ".join("".join(r.sample(vocabulary[lang].split(), 2)) for _ in range(30)), lang, "s", 1, "") for i in range(800) for lang in [list(vocabulary)[i % 4]]]
    d = spark.createDataFrame(rows, SCHEMA)
    got = langid.identify(d).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    held = [x for x in got if x.held_out]
    assert sum(x.lang_pred == rows[x.doc_id][2] for x in held) / len(held) > 0.97


def test_language_odd_rows(spark):
    got = {x.doc_id: x for x in langid.identify(docs(spark, ODD + ["123 — !", "٣٤"] + prose(11, 20))).collect()}
    und = {i for i, t in enumerate(ODD) if not any(c.isalpha() for c in t or "")} | {len(ODD), len(ODD) + 1}
    assert {i for i, x in got.items() if x.lang_pred == "und"} == und
    assert langid.identify(docs(spark, [])).count() == 0


# secrets


def test_secret_spans(spark):
    texts = [
        'Password = "hunter2hunter2" and token:short', "AKIAABCDEFGHIJKL12 AKIA1", "f" * 31 + " " + "a0" * 16, "api_key:=x", "ſecret: abcdefghij", None, "",
        "é api-key secret='Zq8vK2pL9xT4' x", "key Zx9Qw7Lp2Vb8Nm4Kt6Rj1Hs3 here", "some_long_identifier_name_in_snake_case 550e8400-e29b-41d4-a716-446655440000",
    ]
    got = {r.doc_id: r for r in secrets.scan_secrets(docs(spark, texts), PATH, public_tokenizers.PATTERN).collect()}
    assert [(got[i].n_assign, got[i].n_access, got[i].n_hex) for i in range(len(texts))] == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (1, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert got[0].base_sha256 == hashlib.sha256(b"assign:0:26").hexdigest() and got[6].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[8].spans == "random:4:28" and got[9].spans == ""


def test_secret_values_after_equals(spark):
    key = "Zx9Qw7Lp2Vb8Nm4Kt6Rj1Hs3"
    texts = [f"client_key={key}", f"GET /x?sig={key}&b=1", f"AWS_KEY={key}==", f"{key}=1", f"a={key}=b={key}", f"x=='{key}='"]
    got = {r.doc_id: r for r in secrets.scan_secrets(docs(spark, texts), PATH, public_tokenizers.PATTERN).collect()}
    assert [got[i].spans for i in range(len(texts))] == ["random:11:35", "random:11:35", "random:8:34", "random:0:24", "random:2:26,random:29:53", "random:4:29"]
    assert [got[i].n_random for i in range(len(texts))] == [1, 1, 1, 1, 2, 1]


def test_ratio_decides_on_short_and_letter_only_strings(spark):
    keys = ["Zx9Qw7Lp2Vb8Nm4Kt6R", "qZxKvWpLmRtYbNcHdGfJsQwP", "qzxk7vwp3lmrt9ybnc2hdgf", "qzxkvwplmrtybnchdgfjswp", "Zx9Qw7Lp", "qZxKvWpL", "QZXK-VWPL-MRTY"]
    known = ["getElementById", "2024-01-02T10-00-00Z", "12345678-9012/3456", "550e8400-e29b-41d4-a716-446655440000", "dc/java/util/concurrent/Future", "Verantwortung", "da39A3ee5e6b4b0d3255bfef95601890"]
    got = {r.doc_id: r for r in secrets.scan_secrets(docs(spark, keys + known), PATH, public_tokenizers.PATTERN).collect()}
    assert [got[i].spans for i in range(len(keys))] == [f"random:0:{len(k)}" for k in keys]
    assert [got[i].spans for i in range(len(keys), len(keys + known))] == [""] * len(known)


# lines


def brute_lines(texts):
    seen, out = set(), []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(x.strip(" ") for x in w):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup_against_a_scan(spark):
    r = random.Random(12)
    texts = ODD + ["\n".join(r.choice(["a", "b", "c", "", "d e"]) for _ in range(r.randint(1, 12))) for _ in range(80)] + ["x\nx\nx\nx\nx"]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs(spark, texts).withColumnRenamed("extra", "n_lines")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


# nearest neighbours


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(13)
    v = r.normal(size=(400, 16)).astype(np.float32)
    v[50:150] = v[50]
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)]
    rows += [(400, None), (420, [0.0] * 16), (440, [float("nan")] * 16), (460, [1.0, None] + [0.0] * 14), (480, []), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (None, [1.0] * 16), (40, rows[40][1])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for x in ann.nearest(d, query_rows=5, candidate_rows=100).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    w = v.astype(np.float64)
    for q in range(0, 400, 20):
        s = w @ w[q]
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        near = [x[1] for x in got[q]]
        assert [x[0] for x in got[q]] == list(range(1, 21)) and np.allclose([x[2] for x in got[q]], s[near])
        assert near == want or np.allclose(s[near], s[want], atol=1e-12)
    assert [x[1] for x in got[500]] == [501] and set(got) == {*range(0, 400, 20), 500}
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    base = prose(14, 60, 80)
    texts = base + [edited(t, 1, 1) for t in base[:10] if len(t.split()) > 40] + base[:5] + ODD
    docs(spark, texts).drop("extra").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 7 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = d.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == columns, name
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0
