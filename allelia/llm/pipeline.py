"""Documents to packed training sequences: STAGES in order, each over all that its predecessor kept.

language: the documents whose language is rejected go. Models are learned from the labelled documents themselves.
near_copies: one row of each component of near copies stays, of those of the smallest doc_id that of the least text hash;
    rows are told apart by id and text, so that other texts of an id are judged by themselves. A text without words is
    in no component and stays once for each id and text. Of rows that are equal in id and text the first in the order of
    their other columns stays (maps and other columns without an order don't count). Five words and a similarity of 0.8.
decontaminated: documents with a benchmark leak go.
secrets: secrets are masked in the texts.
packed: sequences of tokens; one row per piece.

Documents of null id pass the second stage as they are. Null and empty texts have no letters, so the first stage rejects
them. An empty table gives an empty one at every stage. Further columns, whatever their names, are kept up to the last.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import decontaminate, langid, ngram_join, packing, secrets
from .common import among, fresh, materialize, scratch, table, without

WORDS, PERCENT = 5, 80
#: The vocabulary file for packing; a parameter of the operator.
TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs, langid.fit(docs))


def _has_order(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_has_order(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_order(kind.elementType)
    return not isinstance(kind, T.MapType | T.VariantType | T.NullType)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text, number = fresh(docs.columns, 2)
    named = docs.withColumn(text, F.xxhash64(F.col("text").cast("string")))
    key = lambda df: df.select(F.col("doc_id").alias("_i"), F.col(text).alias("_t"))
    with scratch(spark, "gone", "repeated"):
        gone = materialize(key(ngram_join.copies(docs, WORDS, PERCENT).withColumnRenamed("text_hash", text)).distinct(), "gone")
        ids = without(named.where("doc_id IS NOT NULL").select("doc_id", text), gone, ["doc_id", text])
        repeated = materialize(key(ids.groupBy("doc_id", text).count().where("count > 1")), "repeated")
    left = without(named, gone, ["doc_id", text])
    if repeated.isEmpty():
        return left.select(docs.columns)
    order = [f.name for f in docs.schema.fields if f.name != "text" and _has_order(f.dataType)]
    once = among(left, repeated, ["doc_id", text]).withColumn(
        number, F.row_number().over(Window.partitionBy("doc_id", text).orderBy(*order))
    ).where(F.col(number) == 1)
    return once.select(docs.columns).unionByName(without(left, repeated, ["doc_id", text]).select(docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with scratch(spark, "leaks"):
        return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.learn(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminated", decontaminated),
    ("secrets", masked),
    ("packed", packed),
]

#: SQL can't express the models; the stages are held against brute force in the tests instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's tables and broadcasts go once the next one's input is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark, name):
            docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
