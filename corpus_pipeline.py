"""A corpus pipeline: every stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from matchflow.llm import language, minhash, packing, quality
from matchflow.llm.common import keyed, stored, with_hint
from matchflow.plans.views import table
from matchflow.session import apply_settings

#: Documents whose language is less certain than that go.
LEAST_CERTAIN = 0.5


def parted(docs: DataFrame) -> DataFrame:
    """(row, text): all other columns lie in ``row``, so that none can clash with a column of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")


def whole(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The documents of ``parted`` again."""
    return rows.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter or with an uncertain language go.

    Null and empty texts have no letter. Repeated rows share their fate; very long texts are read whole; an empty table
    stays empty. Columns of any name stay as they are.
    """
    apply_settings(spark)
    found = language.predicted(parted(docs), language.fit(docs))
    return whole(found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN)), docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, as the labels mark it; the others go.

    Null and empty texts are scored by features of zero. Repeated rows share their fate; very long texts are read whole;
    an empty table stays empty; without any labelled document all stay. Columns of any name stay as they are.
    """
    apply_settings(spark)
    vectors = quality.word_vectors(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    net = quality.fit_documents(docs, vectors, table(spark, sf_dir, "labels"))
    return whole(quality.scored_documents(parted(docs), vectors, net).where("predicted = 1"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, rows without an id last.

    Rows are told apart by their place, so ids may be repeated or null. Rows that share id and text are one, so null and
    empty texts, which are copies of nothing, stay once for each id. An empty table stays empty; columns of any name stay.
    """
    apply_settings(spark)
    key = "place" + "_" * max(map(len, docs.columns))
    rows = keyed(docs, key)
    groups = minhash.near_copies(rows.select(key, "text"), words=5, id_col=key).select(key, "component_id")
    ranked = stored(groups.join(rows.select(key, "doc_id", F.xxhash64("text").alias("digest")), key), "ranked")
    # Of a component, and of rows with one id and text, the first row.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", key)
    kept = ranked.groupBy("component_id").agg(F.min(order).alias("first"), F.min_by("digest", order).alias("digest"))
    kept = kept.groupBy("first.no_id", "first.doc_id", "digest").agg(F.min(f"first.{key}").alias(key)).select(key)
    gone = stored(ranked.select(key).join(kept, key, "left_anti"), "gone")
    # Most texts stay, and a text that is surely not gone need not move to a join.
    hint = key + "hint"
    hinted = with_hint(rows, key, gone, key, hint)
    stay = hinted.where(f"NOT {hint}").unionByName(hinted.where(hint).join(gone, key, "left_anti"))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces in sequences of at most 4096 tokens."""
    apply_settings(spark)
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("minhash near-dedup", drop_near_copies),
    ("best-fit packing", pack),
]
#: No stage can be said in SQL: two trained models, minhash groups and packing. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
