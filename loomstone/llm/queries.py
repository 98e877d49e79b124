"""The numbered queries: each operator with its production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontam, html, jaccard, langid, lattice, media, mixing, phrases, quality, simhash, tokens, toxicity
from .common import crc_mod, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact byte-level BPE counts of whole texts. Null: 0 bytes, 0 tokens; repeated rows and null ids each give a row; other columns do not matter."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as stored images and what is read back from them. Null: one row of 64 zeros; repeated rows and null ids each give a row."""
    return media.media_digests(table(spark, sf_dir, "documents"), form="pgm")


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of whole pages. Null or empty html: "" and 0; repeated rows each give a row."""
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document. Null text: size 0; null sources are one source, last; equal rows tie, either may be cut."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3.0).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole texts by a model of the labels out of the held-out fold. Null or empty text: one empty passage; null ids are not held out and
    not learned from; repeated rows each give a row."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole texts by a lexicon learned out of the held-out fold. Null or empty text: 0.02; null ids are not held out and not learned from;
    repeated rows each give a row."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of whole texts by profiles learned out of the held-out fold. Null text or no letter: und, 0; null ids are not held out and not
    learned from; ties go to the first language by name; repeated rows each give a row."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify_language(docs, langid.fit_profiles(docs))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole texts and their components. Null text: as empty, fingerprint 0, linked like any other; rows that share an id are told
    apart by fingerprint; null ids name no component that has another id."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), bits=4)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of whole texts. Null text: only the end; null ids are not held out and not learned from; repeated rows each count and each
    give a row."""
    return lattice.lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in whole texts. Null text: no words; null item ids hit words but are not counted or listed; repeated rows each give a row."""
    return decontam.leak_digest(decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 finite components; other vectors, null ones too, have no row. Repeated rows each count and each give a row;
    null ids start last; ties go to the smaller cluster; a distance beyond 64 bits is null."""
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed="3")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of each language. Null or empty text: no words; null lang: und; repeated rows each count; ties by count, then by the phrase's bytes."""
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=5, least=100, top=2000, share=100)


def op13_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle sets of whole texts and their components. Null or empty text: 0 shingles, its own id; rows that share an id are told apart by their
    sets; null ids name no component that has another id; repeated rows each give a row."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), share=85, width=4)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of corpus_pipeline.run."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_media_columns, op3_html_main_text, op4_source_mix, op5_quality, op6_toxicity, op7_language, op8_near_duplicates, op9_lm_scores, op10_decontamination, op11_centroid_clusters, op12_phrases, op13_similar_documents, pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _kmeans_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds written one after the other; each assigns all vectors to centroids a<r>, and makes centroids c<r+1>."""
    parts = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
             f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS j, e AS c FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})"]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT id, vec_id, e, j, list_sum([(e[i] - c[i]) * (e[i] - c[i]) FOR i IN range(1, 65)]) AS d FROM v, c{r})")
        parts.append(f"a{r} AS MATERIALIZED (SELECT id, any_value(vec_id) AS vec_id, any_value(e) AS e, arg_min(j, d * {k} + j) AS j, min(d) AS d FROM d{r} GROUP BY id)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT j, i, sum(x) AS t, count(*) AS n FROM (SELECT j, unnest(e) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY j, i)")
            parts.append(f"f{r} AS (SELECT j, list(CAST((t - ((t % n) + n) % n) // n AS HUGEINT) ORDER BY i) AS m FROM s{r} GROUP BY j)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m, c) AS c FROM c{r} LEFT JOIN f{r} USING (j))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"""


_PHRASES = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
lens AS (SELECT unnest(range(1, 6)) AS m),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM (SELECT lang, m, array_to_string(list_slice(w, q, q + m - 1), ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS q FROM w, lens WHERE len(w) >= m))
  GROUP BY lang, m, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
cuts AS (SELECT lang, m, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS x, array_to_string(list_slice(w, k + 1, m), ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (SELECT c.lang, c.m, c.phrase, a, k, l.f AS l, r.f AS r, n.n, CAST(1000 AS HUGEINT) * a * n.n // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = x JOIN f r ON r.lang = c.lang AND r.phrase = y JOIN n ON n.lang = c.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored),
inside AS (SELECT lang, array_to_string(list_slice(w, q, q + u - 1), ' ') AS phrase, a FROM (SELECT *, unnest(range(1, m - u + 2)) AS q FROM (SELECT *, unnest(range(2, m)) AS u FROM cand))),
kept AS (SELECT * FROM lowest s WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.a >= 100 * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""

_SIMILAR = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT id, array_to_string(list_slice(w, q, q + 3), ' ') AS t FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS q FROM d WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
meet AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM s a JOIN s b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id),
links AS MATERIALIZED (SELECT a, b FROM meet JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM d UNION SELECT reach.a, sides.b FROM reach JOIN sides ON sides.a = reach.b),
least AS (SELECT reach.a AS id, min(doc_id) AS component_id FROM reach JOIN d ON d.id = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CASE WHEN n.n > 0 THEN component_id ELSE doc_id END AS component_id FROM d JOIN least USING (id) LEFT JOIN n USING (id)"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = {
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bp AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k FROM bp),
lens AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n),
dw AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k FROM dp),
m AS (SELECT dw.doc_id, dw.n, dw.p, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
pos AS (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM pos GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op11_centroid_clusters": _kmeans_sql(),
    "op12_phrases": _PHRASES,
    "op13_similar_documents": _SIMILAR,
}
