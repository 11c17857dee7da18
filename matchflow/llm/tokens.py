"""Token counts through a digest cache.

A count is stored under the digest of the normalised content and the digest of the tokenizer version.
Documents are joined to the stored counts; only distinct contents without a count are encoded, and their
counts are appended to the cache.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_and_texts, process_memo, stored

CACHE_SCHEMA = "digest BINARY, n_tokens BIGINT"


def tokenizer_digest(data: bytes, kind: str) -> str:
    """Digest of the vocabulary file, the library's version and the way it is called."""
    if kind == "model":
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(data + f"|{kind}|{library.__version__}|plain".encode()).hexdigest()


def counter(data: bytes, kind: str):
    """text -> number of tokens, without begin, end or added tokens."""
    if kind == "model":
        import sentencepiece
        processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda text: len(processor.encode(text))
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def content_digest(text, kind: str):
    """SHA-256 of the normalised content.

    SentencePiece writes a blank as U+2581 before it looks at a text, so both spellings of one content
    share a digest; other tokenizers take the text as it is.
    """
    return F.unhex(F.sha2(F.replace(text, F.lit(" "), F.lit("▁")) if kind == "model" else text, 256))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n_tokens), one row per digest also if two jobs have stored it; empty where there is no cache yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, model_path: str, cache_path: str, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``.

    * null text: counted as the empty text (0 bytes, 0 tokens); null id: kept as a row with a null id
    * repeated rows: one row each; equal contents are encoded once
    * empty table: no rows, nothing is appended; other columns of ``docs`` are not looked at
    * very long texts are encoded whole, one at a time

    ``cache_path`` must be a folder all executors reach; it holds one subfolder per tokenizer version and
    is only ever appended to. Only digests and one id per missing digest move before the texts do; a text
    meets its missing digest under (digest, id), so a content with many copies spreads over the tasks and
    is encoded for one of its ids.
    """
    spark = docs.sparkSession
    data = open(model_path, "rb").read()
    kind = model_path.rsplit(".", 1)[-1]
    version = tokenizer_digest(data, kind)
    place = f"{cache_path}/tokenizer={version}"

    rows = ids_and_texts(docs, id_col, text_col).withColumn("digest", content_digest(F.col("text"), kind))
    keys = stored(rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    missing = (keys.groupBy("digest").agg(F.min("id").alias("first_id"))
               .join(read_cache(spark, place), "digest", "left_anti"))
    texts = rows.join(
        missing.withColumnRenamed("digest", "missing_digest"),
        (F.col("digest") == F.col("missing_digest")) & F.col("id").eqNullSafe(F.col("first_id")))

    def encode(batches):
        memo = process_memo("counter")
        count = memo.get(version) or memo.setdefault(version, counter(data, kind))
        last, n = None, 0
        for batch in batches:
            out = []
            digests = batch.column("digest")
            for digest, text in zip(digests.to_pylist(), batch.column("text")):
                if digest != last:  # repeated rows arrive together
                    last, n = digest, count(text.as_py())
                out.append(n)
            yield pa.RecordBatch.from_arrays([digests, pa.array(out, pa.int64())], ["digest", "n_tokens"])

    found = texts.select("digest", "text").mapInArrow(encode, CACHE_SCHEMA)
    found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).write.mode("append").parquet(place)
    counts = read_cache(spark, place)
    return keys.join(counts, "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
