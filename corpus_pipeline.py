"""From documents to token ids: quality, near copies, repeated strings, benchmark passages, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns what the next one works on; its result is written and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, jaccard, quality, repeats
from factloom.llm.common import compact, discard, materialize, tokenizer_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own(*names: str) -> list[str]:
    """Column names that no input has."""
    return [f"_{uuid.uuid4().hex}_{n}" for n in names]


def _key() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def _counted(docs: DataFrame, text: Column) -> DataFrame:
    """The documents with another text, and ``n_chars`` with it."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _compact(out: DataFrame, docs: DataFrame) -> DataFrame:
    """What a stage made of ``docs`` by a shuffle, in files of some MB where the shuffle has more partitions than that."""
    return compact(out, size=docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.7 or more; it is fitted on labelled rows among those given.

    Null and empty texts get the score of a text without words; very long texts are scored whole; rows that repeat stay or go alike; an empty table gives an
    empty result. Columns of any name stay as they are.
    """
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")), keep=True)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that with the smallest id (rows without id come last), then the smallest SHA-256 of its text.

    Rows that repeat both id and text become one, that with the smallest hash of all its columns. Null, empty and blank texts are in no group: such rows stay, those
    that repeat an id as one. Very long texts are compared whole; an empty table gives an empty result; columns of any name stay as they are.
    """
    key, wid, wkey, of = _own("key", "id", "wkey", "of")
    groups = materialize(jaccard.similar(docs, with_groups=True).select("doc_id", "key", "group"), "groups")
    best = groups.where("group is not null").groupBy("group").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "key")).alias("of"))
    best = best.select(F.col("of.doc_id").alias(wid), F.col("of.key").alias(wkey)).unionByName(groups.where("group is null").select(F.col("doc_id").alias(wid), F.col("key").alias(wkey)).distinct())
    best = materialize(best, "best")
    keyed = docs.withColumn(key, _key())
    kept = keyed.join(best, F.col("doc_id").cast("long").eqNullSafe(F.col(wid)) & (F.col(key) == F.col(wkey)), "left_semi")
    rows = docs.select("doc_id", _key().alias(key))
    if rows.groupBy("doc_id", key).count().where("count > 1").take(1):
        columns = [F.col(f"`{c}`") for c in docs.columns]
        least = F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(of)
        kept = kept.groupBy("doc_id", key).agg(least).select(*[F.col(f"{of}.`{c}`").alias(c) for c in docs.columns])
    return _compact(kept.select(*[f"`{c}`" for c in docs.columns]), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 200-byte strings; a character cut apart goes as a whole.

    Null texts, empty ones and those of under 200 bytes stay as they are; very long texts are treated whole; rows that repeat a text have it emptied
    all alike; an empty table gives an empty result; columns of any name stay as they are.
    """
    key, fkey, whole, kept = _own("key", "fkey", "whole", "kept")
    found = repeats.find_repeats(docs).select(F.col("key").alias(fkey), F.col("whole").alias(whole), F.col("kept_text").alias(kept))
    joined = docs.withColumn(key, _key()).join(found, F.col(key) == F.col(fkey), "left")
    new = F.when(F.col(whole), F.lit("")).when(F.col(kept).isNotNull(), F.col(kept)).otherwise(F.col("text"))
    return _compact(_counted(joined, new).select(*[f"`{c}`" for c in docs.columns]), docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that the benchmark has; rows, nulls, order of columns and all else as ``decontaminate.decontaminate`` says."""
    out = decontaminate.decontaminate(docs, _read(spark, sf_dir, "benchmark"))
    return _counted(out, F.col("text"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to; nulls, repeats and long texts as ``bpe.encode`` says. Other columns of the input are left behind."""
    return bpe.encode(docs, tokenizer_path("byte_bpe_50k.json"), chunk=1 << 20, memo=16 << 20).drop("decoded")


STAGES = [("quality classifier", keep_quality), ("n-gram Jaccard join", keep_one), ("suffix-array dedup", cut_repeats), ("benchmark decontamination", cut_benchmark), ("BPE encoding and decoding", to_tokens)]

#: No stage but the last can be told in SQL that runs on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
