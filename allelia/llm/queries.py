"""The registered queries opN_<name> of the training-data operators, over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses
from .common import table


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_tree import merge, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    return read_back(*merge(turns.unionByName(added))).drop("n_intervals")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(table(spark, sf_dir, "documents"), n=3, percent=90)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    found = identify(docs, fit(docs, remainder != 2))
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import grades, learn, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, grades(table(spark, sf_dir, "labels"))))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import roundtrip

    return roundtrip(table(spark, sf_dir, "pages")).drop("archive", "record_offset")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import learn, scan

    docs = table(spark, sf_dir, "documents")
    return scan(docs, learn(docs))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    from .pipeline import TOKENIZER

    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_tree": op1_chat_tree,
    "op2_topk": op2_topk,
    "op3_ngram_join": op3_ngram_join,
    "op4_langid": op4_langid,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_secrets": op8_secrets,
    "op9_licenses": op9_licenses,
    "op10_packing": op10_packing,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op1_chat_tree": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, x.n, x.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(n, role)
        ),
        e AS (SELECT *, length('<|turn|>' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') || chr(10)
                       || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') || '<|end|>') AS formatted FROM t)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(formatted)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op2_topk": """
        WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(e, lambda c: floor(256 * c)) AS v FROM x WHERE len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
              FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op3_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * k >= 90 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
        FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes < 100 OR first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN payload_bytes < 100 OR first_id IS NULL OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM m
    """,
    "op9_licenses": licenses.oracle(),
}
