"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import table
from . import conversations, forest, language, language_model, licences, minhash, near_vectors, packing, pieces, quality, sharding, tokens, whitening
from .common import shared_path, stored


@query()
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents, starting from an empty cache."""
    return tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                               shared_path(spark, "token-cache"))


@query()
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    packed = packing.packed_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query()
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded with begin and end ids, and decoded again."""
    return pieces.digests(pieces.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


@query()
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents."""
    docs = table(spark, folder, "documents")
    model = language.fit(docs)
    return language.predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(language.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query()
def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are alike to 80 percent."""
    return minhash.near_copies(table(spark, folder, "documents"), words=4)


@query()
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    vectors = quality.word_vectors(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    rows = stored(quality.featured(docs, vectors).select("doc_id", "features"), "features")
    net = quality.fit(rows, table(spark, folder, "labels"))
    return quality.scored(rows, net).select(
        "doc_id", F.coalesce(language.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query()
def op4_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight runs of a Hilbert curve."""
    return sharding.shards(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "cell")


@query()
def op8_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    vectors = table(spark, folder, "embeddings")
    return forest.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query()
def op3_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors with a cosine of at least 0.9."""
    return near_vectors.near_vectors(table(spark, folder, "embeddings"))


@query()
def op11_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a model of nine tenths of them."""
    return language_model.corpus_scores(table(spark, folder, "documents"), held_out=language.fold("doc_id", 10) == 0)


@query()
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All usable vectors on the first eight principal directions, with unit covariance."""
    return whitening.whitened(table(spark, folder, "embeddings"))


@query()
def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Damage to all conversations, and its cheapest repair."""
    return conversations.repaired(conversations.damaged(table(spark, folder, "conversations")), present_col="present")


_NOTICES = ", ".join(f"('{k}', '{v}')" for k, v in sorted(licences.NOTICES.items()))
_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_SHINGLES = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))"


@query(f"""
WITH notice AS (SELECT license_id, list_distinct({_SHINGLES}) AS wanted
                FROM (SELECT license_id, {_WORDS} AS w FROM (VALUES {_NOTICES}) AS t(license_id, text)) WHERE len(w) >= 5),
     wanted AS (SELECT license_id, len(wanted) AS t, CAST(greatest(1, power(2, ceil(log2(len(wanted) / 2.0)))) AS BIGINT) AS block,
                       unnest(wanted) AS shingle FROM notice),
     sh AS (SELECT doc_id, unnest({_SHINGLES}) AS shingle, unnest(range(0, len(w) - 4)) AS pos
            FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 5),
     hit AS (SELECT doc_id, license_id, t, shingle, (pos // block - back) * block AS position
             FROM sh JOIN wanted USING (shingle), (VALUES (0), (1), (2)) AS b(back) WHERE pos // block >= back),
     win AS (SELECT doc_id, license_id, position, count(DISTINCT shingle) / any_value(t) AS containment FROM hit GROUP BY ALL)
SELECT doc_id, license_id, max(containment) AS containment,
       arg_min(position, (-containment, position)) AS position
FROM win WHERE containment >= 0.8 GROUP BY doc_id, license_id
""")
def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices in all documents."""
    return licences.matches(table(spark, folder, "documents"), licences.notices(spark))


_SHORT = ", ".join(f"('{k}', '{v}')" for k, v in sorted(licences.SHORT_NOTICES.items()))


@query(f"""
WITH notice AS (SELECT license_id, w, len(w) AS width FROM (SELECT license_id, {_WORDS} AS w FROM (VALUES {_SHORT}) AS t(license_id, text))),
     doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     spot AS (SELECT doc_id, w, unnest(range(0, len(w))) AS position FROM doc)
SELECT doc_id, license_id, CAST(1 AS DOUBLE) AS containment, min(greatest(position - 2, 0)) AS position
FROM spot JOIN notice ON spot.w[position + 1] = notice.w[1] AND spot.w[position + 1:position + width] = notice.w
GROUP BY doc_id, license_id
""")
def op7_short_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices of fewer than five words in all documents."""
    return licences.matches(table(spark, folder, "documents"), licences.short_notices(spark))
