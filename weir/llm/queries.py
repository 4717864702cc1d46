"""The registered queries of this folder: each applies its operator to the whole of its table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import work_dir
from . import decontaminate, jaccard, labelled, line_dedup, pieces, quality, secrets, suffix_dedup, token_files, toxicity
from .exact_dedup import DigestIndex, buckets_for, dedup_in_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(_table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return token_files.documents(spark, folder)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("line_count").cast("long").alias("n_lines"),
        F.aggregate("line_runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_removed"),
        F.size("line_runs").cast("long").alias("n_spans"),
        F.sha2("line_kept", 256).alias("kept_sha256"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        "kept_sha256",
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model")).drop("text")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]),
        F.sha2(secrets.written("secret_spans", secrets.KINDS[:3]), 256).alias("base_sha256"),
        secrets.written("secret_spans").alias("spans"),
        count("entropy").alias("n_entropy"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two batches of ascending ids, so that the second one meets a filled index."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n, middle = docs.agg(F.count("*"), F.percentile_approx("doc_id", 0.5)).first()
    index = DigestIndex(spark, f"{work_dir(spark)}/digest-index-{uuid.uuid4().hex}", buckets_for(spark, n))
    first = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    found = dedup_in_batches(index, [docs.where(first), docs.where(~first)])
    index.close()
    return found


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("bench_words").alias("n_words"),
        F.col("bench_hits").alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"),
        (F.col("bench_hits") > 0).alias("contaminated"),
    )


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_line_dedup": op2_line_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_secrets": op5_secrets,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_jaccard": op10_jaccard,
}

ORACLES = {
    "op2_line_dedup": r"""
        WITH raw AS (
            SELECT doc_id, i, lines[i] AS line, regexp_replace(lines[i], '^[\x09\x0B-\x0D\x20]+|[\x09\x0B-\x0D\x20]+$', '', 'g') AS unit
            FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
        units AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS u FROM raw WHERE unit <> ''),
        pairs AS (
            SELECT a.doc_id, a.u, min((a.doc_id, a.u)) OVER (PARTITION BY a.unit, b.unit) AS first
            FROM units a JOIN units b ON a.doc_id = b.doc_id AND b.u = a.u + 1),
        gone AS (
            SELECT DISTINCT doc_id, unnest([u, u + 1]) AS u FROM pairs WHERE (doc_id, u) <> first),
        counted AS (
            SELECT doc_id, count(*) AS n_lines, count(g.u) AS n_removed FROM units LEFT JOIN gone g USING (doc_id, u) GROUP BY doc_id),
        spans AS (
            SELECT doc_id, count(*) AS n_spans FROM gone g
            WHERE NOT EXISTS (SELECT 1 FROM gone h WHERE h.doc_id = g.doc_id AND h.u = g.u - 1) GROUP BY doc_id),
        kept AS (
            SELECT raw.doc_id, string_agg(raw.line, chr(10) ORDER BY raw.i) FILTER (WHERE g.u IS NULL) AS text
            FROM raw LEFT JOIN units USING (doc_id, i) LEFT JOIN gone g ON g.doc_id = raw.doc_id AND g.u = units.u GROUP BY raw.doc_id)
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(CASE WHEN n_removed = n_lines THEN '' ELSE coalesce(text, '') END) AS kept_sha256
        FROM kept LEFT JOIN counted USING (doc_id) LEFT JOIN spans USING (doc_id)""",
    "op10_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
        FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op3_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        places AS (
            SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS place
            FROM (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM d))),
        repeats AS (
            SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS apart FROM places WHERE place > 1),
        spans AS (
            SELECT doc_id, min(s) AS a, max(s) + 100 AS b
            FROM (SELECT doc_id, s, sum(apart) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM repeats) GROUP BY doc_id, g),
        gaps AS (
            SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS p
            FROM (SELECT * FROM spans UNION ALL SELECT doc_id, n, n FROM d)),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, d.n AS n_bytes, d.n - len(kept.h) // 2 AS n_removed, (SELECT count(*) FROM spans WHERE spans.doc_id = d.doc_id) AS n_spans,
               sha256(unhex(kept.h)) AS kept_sha256
        FROM d JOIN kept USING (doc_id)""",
    "op7_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)""",
    "op9_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row_id, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        i AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        item_windows AS (
            SELECT DISTINCT item_id, k, list_slice(w, s, s + k - 1) AS words
            FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s
                  FROM i WHERE len(w) > 0)),
        lengths AS (SELECT DISTINCT k FROM item_windows),
        doc_windows AS (
            SELECT row_id, k, s, list_slice(w, s, s + k - 1) AS words
            FROM (SELECT row_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, lengths WHERE len(w) >= k)),
        hits AS (SELECT row_id, s, k, item_id FROM doc_windows JOIN item_windows USING (k, words)),
        places AS (
            SELECT row_id, count(DISTINCT p) AS n_hit
            FROM (SELECT row_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY row_id),
        items AS (
            SELECT row_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
            FROM hits GROUP BY row_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN places USING (row_id) LEFT JOIN items USING (row_id)""",
}
