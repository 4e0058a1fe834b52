"""Many terms in many texts, as substrings, in one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of all terms that one automaton holds, some hundred bytes each; beyond that, texts and terms meet by GRAM characters.
AUTOMATON, GRAM = 1_000_000, 3


def term_hits(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str, most: int = AUTOMATON) -> DataFrame:
    """``key, term``: the texts that contain a term, in any place, each pair once; empty terms, nulls and case as they are (lower both for any case).

    Up to ``most`` characters of terms, every task runs one Aho-Corasick automaton over its texts: only hits are shuffled, and the time doesn't depend on the number of terms. Their
    size is checked first. Beyond, a term is looked up by the rarest of its runs of three characters among all terms, and what it meets is checked; shorter terms, of which
    there can only be few, go by the automaton still.
    """
    own = terms.select(F.col(term).alias("term")).where("term <> ''").distinct()
    rows = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null")
    size = own.agg(F.sum(F.length("term"))).first()[0] or 0
    if size <= most:
        return _automaton(rows, own).distinct().toDF(key, "term")
    short, long = own.where(F.length("term") < GRAM), own.where(F.length("term") >= GRAM)
    if (short.agg(F.sum(F.length("term"))).first()[0] or 0) > most:
        raise ValueError("too many terms of one or two characters")
    return _automaton(rows, short).distinct().unionByName(_by_grams(rows, long)).toDF(key, "term")


def _automaton(rows: DataFrame, terms: DataFrame) -> DataFrame:
    words = [r.term for r in terms.collect()]  # their size is checked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        for w in words:
            tree.add_word(w, w)
        tree.make_automaton()
        for batch in batches:
            keys, found = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = sorted({w for _, w in tree.iter(t)}) if words else []
                keys += [k] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(found, pa.string())], names=["_key", "term"])

    return rows.mapInArrow(run, rows.select("_key", F.lit("").alias("term")).schema)


def _grams(c: str):
    """The distinct runs of GRAM characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (GRAM - 1)), lambda i: F.substring(F.col(c), i, F.lit(GRAM))))


def _by_grams(rows: DataFrame, terms: DataFrame) -> DataFrame:
    each = terms.select("term", F.explode(_grams("term")).alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = each.join(often, "gram").groupBy("term").agg(F.min(F.struct("n", "gram")).alias("m")).select("term", F.col("m.gram").alias("gram"))
    wanted = rows.where(F.length("_text") >= GRAM).withColumn("_id", F.xxhash64("_key", "_text"))
    met = wanted.select("_key", "_id", F.explode(_grams("_text")).alias("gram")).join(rarest, "gram").select("_key", "_id", "term").distinct()
    again = wanted.select(F.col("_id").alias("_own"), F.col("_key").alias("_of"), "_text")
    checked = met.join(again, (F.col("_id") == F.col("_own")) & F.col("_key").eqNullSafe(F.col("_of"))).where(F.contains("_text", "term"))
    return checked.select("_key", "term").distinct()
