"""Token counts through a cache that is keyed by digests of content and tokenizer.

The cache is a Parquet table (tokenizer, digest, n_tokens). Digests are joined to it; of each one that it lacks, one row is
marked, and the marked texts are encoded where they lie and appended. So only digests are shuffled, copies are encoded once
however many there are, and counts are joined back with the digests of many copies spread. The marks reach the texts as a
filter of bounded size: a row that it lets through by chance, or that another job appends at the same time, is an equal
row of the cache, which readers drop. An append that fails leaves no part of it behind, so the next one counts it again.

Null texts count as empty, which have 0 tokens. Texts of any length are encoded whole. Repeated rows and ties each get their
count. Keys may be of any type, null too. Only key, n_bytes, n_tokens and over_limit are returned, so names of other columns
do no harm. An empty table gives no rows and appends nothing.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import Stages, filter_of, is_set, join_back, map_rows, quoted, table
from tessera.llm.tokenizing import ByteCounts, tokenizer_path

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
CACHE_DDL = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(path: str, version: str, bits):
    """Counts of the marked rows of a slice, each content once."""

    def make():
        counter = ByteCounts(path)

        def run(batch: pa.RecordBatch) -> dict[str, list] | None:
            marked = batch.filter(pa.array(is_set(bits.value, batch.column("_bit").to_numpy(zero_copy_only=False))))
            new = dict(zip(marked.column("digest").to_pylist(), marked.column("_text").to_pylist(), strict=True))
            return {"tokenizer": [version] * len(new), "digest": list(new), "n_tokens": counter.counts([t or "" for t in new.values()])} if new else None

        return run

    return make


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def _known(spark: SparkSession, cache: str, version: str) -> DataFrame:
    return spark.read.schema(CACHE_DDL).parquet(cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, cache: str, tokenizer: str, text: str = "text", key: str | None = None) -> None:
    """Appends the counts of the texts that the cache lacks. key: tells copies apart; without one, each slice that has a copy encodes it."""
    spark, version, stages = docs.sparkSession, tokenizer_digest(tokenizer), Stages(docs.sparkSession, "misses")
    content = F.coalesce(F.col(quoted(text)), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    # of the copies of a text, the one of the least mark is encoded
    rows = docs.select(content.alias("_text"), digest.alias("digest"), F.xxhash64(digest, F.lit(0) if key is None else F.col(quoted(key))).alias("mark"))
    missing = rows.groupBy("digest").agg(F.min("mark").alias("mark"))
    if _exists(spark, cache):
        missing = missing.join(_known(spark, cache, version).select("digest"), "digest", "left_anti")
    missing, size = stages.measured(missing.select("mark"), "marks")
    if size["n"] or not _exists(spark, cache):
        bits, n = filter_of(missing, "mark", size["n"])
        marked = rows.select("_text", "digest", F.pmod(F.xxhash64("mark"), F.lit(n)).alias("_bit"))
        map_rows(marked, _encode(tokenizer, version, bits), CACHE_DDL, sized="_text").write.mode("append").parquet(cache)
        bits.destroy()
    stages.drop()


def token_counts(docs: DataFrame, cache: str, tokenizer: str | None = None, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of each document; fills the cache first."""
    tokenizer, stages = tokenizer or tokenizer_path(TOKENIZER), Stages(docs.sparkSession, "counts")
    fill_cache(docs, cache, tokenizer, text, key)
    content = F.coalesce(F.col(quoted(text)), F.lit(""))
    rows = docs.select(F.col(quoted(key)).alias("_key"), F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"))
    rows = stages.write(rows, "rows")
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies")).join(_known(docs.sparkSession, cache, tokenizer_digest(tokenizer)), "digest")
    found = join_back(rows, stages.keyed(copies, "copies", "digest", "copies"), "digest", "copies", "n_tokens")
    return found.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is filled with half of the documents first, as an earlier job would; then all are counted through it."""
    docs, cache = table(spark, sf_dir, "documents").select("doc_id", "text"), f"{Stages(spark, 'tokens').folder}/cache"
    fill_cache(docs.filter(F.pmod(F.xxhash64("text"), F.lit(2)) == 0), cache, tokenizer_path(TOKENIZER), key="doc_id")
    return token_counts(docs, cache)
