"""How sources of one language differ in their words: smoothed shares, a distance of each pair of sources, and the terms each has too many of.

Plain relational, DataFrame functions only: regular-expression matches are exploded and counted by group; each group meets the kept vocabulary of its language, so
that terms it doesn't have count as zeros; the dense table is joined with itself on language and term; sums and ranks by window follow. All arithmetic
is in integers and decimals.

Occurrences are summed in the tasks that cut them out before anything is shuffled, so a source with a third of all rows is no hot key. The dense table's join has
one row for each source of a language at each key, none of which is hot. The dense table and its pairs grow with sources x terms and sources x sources x terms of a
language, as the method has it; both are summed in the tasks that make them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import discard, materialize

#: What stands between terms: the terms are the longest matches of the other characters. Cutting at it gives the same strings as extracting them, for a third of the time.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000
#: Parts of a language's vocabulary that its groups are joined to.
SALT = 64


def _ascii_lower(c: Column) -> Column:
    """Only A-Z lower-cased; ``lower`` is the quick way where there is nothing else."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", between: str = BETWEEN) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and rows that have the term. Nulls are read as empty strings; groups without terms have no row."""
    plain = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    cut = plain.select("lang", "source", F.split(_ascii_lower(F.col("text")), between).alias("terms"))
    # one pass: all occurrences, and each document's distinct terms
    both = cut.select("lang", "source", F.explode(F.array(F.struct(F.lit(0).alias("once"), "terms"), F.struct(F.lit(1).alias("once"), F.array_distinct("terms").alias("terms")))).alias("b"))
    each = both.select("lang", "source", "b.once", F.explode("b.terms").alias("term")).where("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum(F.col("once").cast("long")).alias("docs"))


def share(count: Column, total: Column, vocabulary: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + 1) / (total + vocabulary)), exact for counts of 20 digits; longs where they hold the product, else decimals."""
    top = (count.cast("decimal(20,0)") + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)")
    wide = F.call_function("div", top, (total + vocabulary).cast("decimal(20,0)"))
    return 1 + F.when(count < (1 << 62) // scale, F.call_function("div", (count + 1) * F.lit(scale), total + vocabulary)).otherwise(wide)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 1 + SCALE, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", between: str = BETWEEN) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: for each two sources of a language, the sum of ``distance`` over the kept terms, all ranks. Part ``term``: a source's terms with a share above the
    language's, to rank ``top``. Kept are the terms in at least ``min_docs`` rows of the language.

    Null text, language and source are read as empty strings, and a group without terms takes part with zeros; a language without kept terms has distances of 0. Rows that
    repeat are documents of their own. Ties in value go by the item in UTF-8. A single text is held whole by one task, with its matches. An empty table
    gives an empty result; columns of any other name, the id among them, are ignored.
    """
    counts = materialize(term_counts(docs, text_col, lang_col, source_col, between), "term-counts")
    read = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    # groups and kept terms get numbers, which are fixed once the tables are written; what is large is keyed by them
    groups = materialize(docs.select(read(lang_col).alias("lang"), read(source_col).alias("source")).distinct().withColumn("g", F.monotonically_increasing_id()), "groups")

    all_terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    vocabulary = all_terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("of_lang"))
    kept = all_terms.join(vocabulary, "lang").select("lang", "term", "v", share(F.col("n"), F.col("of_lang"), F.col("v")).alias("q"))
    kept = materialize(kept.withColumn("t", F.monotonically_increasing_id()), "kept-terms")

    own = materialize(counts.join(kept, ["lang", "term"]).join(groups, ["lang", "source"]).select("g", "t", "term", "n", "v", "q"), "own-terms")
    discard(counts)
    totals = own.groupBy("g").agg(F.sum("n").alias("total"))
    sized = groups.join(totals, "g", "left").select("g", "lang", F.coalesce("total", F.lit(0).cast("long")).alias("total"))
    # a language's groups meet its vocabulary in SALT parts, so that no task makes all of it
    salted = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    cells = kept.select("t", "lang", "v", F.pmod(F.xxhash64("t"), F.lit(SALT)).cast("int").alias("salt")).join(salted, ["lang", "salt"]).select("t", "g", "total", "v")
    n = F.coalesce("n", F.lit(0).cast("long"))
    dense = materialize(cells.join(own.select("t", "g", "n"), ["t", "g"], "left").select("t", "g", share(n, F.col("total"), F.col("v")).alias("p")), "dense-shares")
    discard(kept)

    left = dense.repartition("t")  # both sides of the join read this one shuffle
    right = left.select("t", F.col("g").alias("h"), F.col("p").alias("other"))
    # each two sources meet once at a term, for both directions; a sum of 8e9 terms and more, whose distances a long might not hold, is an error
    both = left.join(right, "t").where("g < h").groupBy("g", "h").agg(F.sum(distance(F.col("p"), F.col("other"))).alias("there"), F.sum(distance(F.col("other"), F.col("p"))).alias("back"))
    ways = F.array(F.struct("g", "h", F.col("there").alias("value")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), F.col("back").alias("value")))
    apart = both.select(F.explode(ways).alias("w")).select("w.*")
    pairs = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h")), "lang").where("g <> h").join(apart, ["g", "h"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    spread = own.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(SALT)).cast("int"))  # a source may hold a third of all
    over = spread.join(salted.drop("lang"), ["g", "salt"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).where("p > q").select("g", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    first = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item"))
    over = over.withColumn("rank", first).where(F.col("rank") <= top).join(groups, "g").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(over)
