"""A corpus pipeline: toxicity, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. Rows with null ids, texts or sources pass every stage like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import bpe, jaccard_join, mixing, pii, toxicity
from trajspark.session import scratch_path

ORACLE_SQL = None       # learned weights and token merges are beyond SQL; tests/llm holds the stages against brute force


def free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text, and n_chars to match."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    score = free_name(docs, "score")
    scored = toxicity.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), out=score)
    return scored.filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    return jaccard_join.keep_one_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span replaced by its kind."""
    return with_text(docs, pii.redact(F.col("text"), pii.train(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; where a source's budget ends, the last copy is cut to the words that are left."""
    mark = free_name(docs, "mix_")
    mixed = mixing.mix(docs, prefix=mark)
    size, taken = F.col(mark + "size"), F.col(mark + "taken")
    copies = mixed.filter(taken > 0).withColumn(mark, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(taken / size))))
    left = F.least(size, taken - (F.col(mark) - 1) * size)
    start = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"([\\x20\\x09-\\x0D]*{mixing.WORD})")), 1, left.cast("int")), "")
    return with_text(copies, F.when(left < size, start).otherwise(F.col("text"))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, token_ids, restored) of every row; ``restored``: the tokens decode to the text."""
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    return bpe.encode_documents(rows, bpe.vocabulary(), decoded="decoded").select(
        "doc_id", "source", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", (F.col("decoded") == F.col("text")).alias("restored"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("pii", redact_personal_data),
          ("mixing", mix_sources), ("bpe", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
