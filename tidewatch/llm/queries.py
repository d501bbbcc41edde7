"""The registered queries of the corpus operators, with production parameters, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import ann, bpe, collocations, exact_dedup, hyperplanes, langid, lexical, line_dedup, mixing, ngram_join, secrets, sharding, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def op4_block_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP10_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
     p AS (SELECT doc_id, len(ls) AS n, unnest(range(1, len(ls) - 1)) AS i, ls FROM l WHERE len(ls) >= 3),
     w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS w FROM p
           WHERE trim(ls[i]) <> '' OR trim(ls[i + 1]) <> '' OR trim(ls[i + 2]) <> ''),
     later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM w) x WHERE r > 1),
     gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM later),
     lines AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM l),
     kept AS (SELECT lines.doc_id, any_value(lines.n) AS n_lines, count(gone.i) AS n_removed,
                     coalesce(string_agg(lines.line, chr(10) ORDER BY lines.i) FILTER (gone.i IS NULL), '') AS t
              FROM lines LEFT JOIN gone ON lines.doc_id = gone.doc_id AND lines.i = gone.i GROUP BY lines.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, n_removed, CAST(strlen(t) AS BIGINT) AS n_bytes, sha256(t) AS text_sha256 FROM kept
"""


def op11_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
     lens AS (SELECT doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
     c AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM lens),
     words AS (SELECT doc_id, n, unnest(ts) AS term FROM lens),
     tf AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM words GROUP BY doc_id, term),
     df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
     q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     p AS (SELECT q.item_id, tf.doc_id, CAST(floor(1000 * ln((2 * c.nd + 2) / (2 * df.df + 1))) AS BIGINT) * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * tf.n * c.nd) // c.l))) AS s
           FROM q JOIN df USING (term) JOIN tf USING (term), c),
     s AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM p GROUP BY item_id, doc_id HAVING sum(s) > 0),
     r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def op12_sign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplanes.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
     place AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
     g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM place, (SELECT unnest([1, 2, 3, 4, 5]) AS k) x WHERE i + k - 1 <= len(ws) GROUP BY ALL),
     n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
     c AS (SELECT lang, k, phrase, f AS a FROM g WHERE k >= 2 AND f >= 100),
     cut AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS j FROM c),
     part AS (SELECT *, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS lp, array_to_string(string_split(phrase, ' ')[j + 1:k], ' ') AS rp FROM cut),
     s AS (SELECT part.lang, part.phrase, part.k, part.a, part.j, x.f AS l, y.f AS r, n.n, CAST((1000::HUGEINT * part.a * n.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
           FROM part JOIN g x ON x.lang = part.lang AND x.phrase = part.lp JOIN g y ON y.lang = part.lang AND y.phrase = part.rp JOIN n ON n.lang = part.lang),
     b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM s) t WHERE o = 1),
     kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND c.a >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
     r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_segment_toxicity": op1_segment_toxicity,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_block_matrix": op4_block_matrix,
    "op5_virtual_slots": op5_virtual_slots,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_pivotal_mix": op7_pivotal_mix,
    "op8_family_svm": op8_family_svm,
    "op9_secret_scan": op9_secret_scan,
    "op10_line_windows": op10_line_windows,
    "op11_term_pipeline": op11_term_pipeline,
    "op12_sign_hashes": op12_sign_hashes,
    "op13_prefix_free": op13_prefix_free,
    "pipeline": pipeline,
}
ORACLES = {"op3_exact_dedup": OP3_SQL, "op10_line_windows": OP10_SQL, "op11_term_pipeline": OP11_SQL, "op13_prefix_free": OP13_SQL}
