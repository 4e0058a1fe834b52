"""Facts: blocks to fields, staged extraction with refusals, derived values, locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import text as T


def key_values(blocks: DataFrame) -> DataFrame:
    """``doc_id, key, value, confidence, page`` from OCR blocks: key to value by reference, both to their words in order.

    ``blocks(doc_id, id, kind, entity, txt, confidence, page, relations array<struct<type, ids>>)``.
    """
    refs = blocks.select("doc_id", "id", F.posexplode("relations").alias("rel", "r")).select("doc_id", "id", "rel", F.col("r.type").alias("type"), F.posexplode("r.ids").alias("pos", "ref"))
    words = blocks.where("kind in ('WORD', 'SELECTION_ELEMENT')").select("doc_id", F.col("id").alias("ref"), F.when(F.col("kind") == "WORD", F.col("txt")).when(F.col("txt") == "SELECTED", "[X]").otherwise("").alias("w"))
    texts = refs.where("type = 'CHILD'").join(words, ["doc_id", "ref"]).groupBy("doc_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel", "pos", "w"))), lambda x: x["w"]), " ").alias("t"))
    sets = blocks.where("kind = 'KEY_VALUE_SET'").select("doc_id", "id", "entity", "confidence", "page")
    keys = sets.where("entity = 'KEY'").join(texts, ["doc_id", "id"], "left").select("doc_id", "id", F.col("t").alias("key"), F.col("confidence").alias("kc"), "page")
    values = sets.where("entity = 'VALUE'").join(texts, ["doc_id", "id"], "left").select("doc_id", F.col("id").alias("ref"), F.col("t").alias("value"), F.col("confidence").alias("vc"))
    link = refs.where("type = 'VALUE'").select("doc_id", "id", "ref")
    return keys.join(link, ["doc_id", "id"], "left").join(values, ["doc_id", "ref"], "left").select("doc_id", "key", F.coalesce("value", F.lit("")).alias("value"), F.least("kc", "vc").alias("confidence"), "page")


def row_key_values(documents: DataFrame) -> DataFrame:
    """``key_values`` of ``documents(doc_id, blocks array<struct<id, kind, entity, txt, confidence, page, relations>>)``, a row for each document, as OCR gives it.

    References are followed in the row, so nothing is shuffled. Ids are unique in a document. For short documents: a reference looks through all words, so 1,001 blocks took four times as long as flat blocks in ``key_values``, 10,010 twenty-three times.
    """
    word = lambda b: F.when(b["kind"] == "WORD", b["txt"]).when(b["txt"] == "SELECTED", "[X]").otherwise("")
    words = F.transform(F.filter("blocks", lambda b: b["kind"].isin("WORD", "SELECTION_ELEMENT")), lambda b: F.named_struct(F.lit("id"), b["id"], F.lit("w"), word(b)))
    sets = lambda entity: F.filter("blocks", lambda b: (b["kind"] == "KEY_VALUE_SET") & (b["entity"] == entity))
    refs = lambda s, kind: F.flatten(F.filter(s["relations"], lambda r: (r["type"] == kind) & r["ids"].isNotNull())["ids"])
    keys = documents.select("doc_id", words.alias("words"), sets("VALUE").alias("values"), F.explode(sets("KEY")).alias("k"))
    links = keys.select("doc_id", "k", F.col("words.id").alias("ids"), F.col("words.w").alias("w"), "values", F.explode_outer(refs(F.col("k"), "VALUE")).alias("link"))
    pairs = links.select("doc_id", "k", "ids", "w", F.get("values", F.array_position("values.id", F.col("link")) - 1).alias("v"))
    told = lambda c: F.array_join(F.transform(c, lambda ref: F.get("w", F.array_position("ids", ref) - 1)), " ")
    text = lambda s: F.when(F.arrays_overlap(refs(s, "CHILD"), "ids"), told(refs(s, "CHILD")))
    return pairs.select("doc_id", text(F.col("k")).alias("key"), F.coalesce(text(F.col("v")), F.lit("")).alias("value"), F.least("k.confidence", "v.confidence").alias("confidence"), F.col("k.page").alias("page"))


def staged(candidates: DataFrame) -> DataFrame:
    """One value for each document and name from ``doc_id, name, stage, rank, value, refused``.

    Stages go in order, candidates by rank. A refusal other than ``blank`` ends the search for that fact; a blank one passes on.
    """
    own = candidates.where("refused is null or refused <> 'blank'")
    first = own.groupBy("doc_id", "name").agg(F.min(F.struct("stage", "rank", "refused", "value")).alias("m"))
    return first.select("doc_id", "name", F.when(F.col("m.refused").isNull(), F.col("m.value")).alias("value"), F.col("m.stage").alias("stage"), F.col("m.refused").alias("refused"))


def derived(flow: Column, bedrooms: Column, scale: Column, digits: int) -> Column:
    """System scale from the flow, where the page has none, and flow for each bedroom."""
    return F.struct(F.coalesce(scale, F.when(flow < 2500, "small").when(flow >= 2500, "large")).alias("scale"), F.when(bedrooms > 0, F.round(flow / bedrooms, digits)).alias("per_bedroom"))


def point(lat: Column, lon: Column, geo: Column, box: tuple[float, float, float, float]) -> Column:
    """A location from two columns, cross-checked with the geocoded text, or from that; errors are values."""
    a, b, g = N.parse_coordinate(lat), N.parse_coordinate(lon), N.geocoded(geo)
    own = a.isNotNull() & b.isNotNull()
    y, x = F.when(own, a).otherwise(g["lat"]), F.when(own, b).otherwise(g["lon"])
    differs = own & g.isNotNull() & ((F.abs(g["lat"] - a) > 1e-5) | (F.abs(g["lon"] - b) > 1e-5))
    outside = ~(x.between(box[0], box[2]) & y.between(box[1], box[3]))
    error = F.when(y.isNull(), "no location").when(differs, "columns disagree").when(outside, "outside the box")
    return F.struct(F.when(error.isNull(), y).alias("lat"), F.when(error.isNull(), x).alias("lon"), F.when(error.isNull(), F.when(own, "columns").otherwise("geocoded")).alias("source"), (error.isNull() & own & g.isNotNull()).alias("cross_checked"), error.alias("error"))


def stated_location(c: Column) -> Column:
    """Last latitude and longitude that a text states."""
    last = lambda p: F.try_element_at(F.regexp_extract_all(c, F.lit(p), 1), F.lit(-1)).try_cast("double")
    return F.struct(last(r"(?i)\blat(?:itude)?[:\s]+(-?\d+\.\d+)").alias("lat"), last(r"(?i)\blon(?:g|gitude)?[:\s]+(-?\d+\.\d+)").alias("lon"))


def packet_coordinates(pages: DataFrame) -> DataFrame:
    """``subject, lat, lon`` that the pages of a document state, the last of each in the order of pages; subjects that don't state both have no row.

    ``pages(subject, page, txt)``. A number has three decimals at least, after a point or a comma; repeated pages are taken by their text's order.
    """
    last = lambda label: F.try_element_at(F.regexp_extract_all("txt", F.lit(rf"(?i){label}\s*:?\s*(-?\d{{1,3}}[.,]\d{{3,}})"), 1), F.lit(-1))
    stated = pages.where(F.lower("txt").contains("itude")).select("subject", F.struct("page", "txt").alias("_at"), last("latitude").alias("lat"), last("longitude").alias("lon"))
    newest = lambda c: F.replace(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))), F.lit(","), F.lit(".")).try_cast("double").alias(c)
    return stated.groupBy("subject").agg(newest("lat"), newest("lon")).dropna()


def located(records: DataFrame, pages: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """``subject, lat, lon, origin, error``: where each record is, by its own columns (``record``), else by what its document states (``document``), else nowhere, with the record's error.

    ``records(subject, lat, lon, geo)`` as ``point`` reads them, ``pages`` as ``packet_coordinates`` does; documents without a record have a row as well. What is stated outside of the box counts as not stated.
    """
    own = records.select("subject", point(F.col("lat"), F.col("lon"), F.col("geo"), box).alias("_p"))
    inside = F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])
    stated = packet_coordinates(pages).where(inside).select("subject", F.struct("lat", "lon").alias("_s"))
    both = own.join(stated, "subject", "full_outer")
    mine = F.col("_p.lat").isNotNull()
    origin = F.when(mine, "record").when(F.col("_s").isNotNull(), "document")
    return both.select("subject", *[F.when(mine, F.col(f"_p.{c}")).otherwise(F.col(f"_s.{c}")).alias(c) for c in ("lat", "lon")], origin.alias("origin"), F.when(origin.isNull(), F.col("_p.error")).alias("error"))


#: Fixed value: a line that begins a section.
SECTION = r"^\s*(\d{1,2}(?:\.\d{1,3}){0,4})\s+(?=[A-Z(\"'])"


def section_passages(lines: DataFrame, headers: list[str] = (), units_needed: bool = True) -> DataFrame:
    """Sentences that state a number, with the section they stand in: ``doc_id, page, block, section, pos, quote, units, numbers, obligation, setback``.

    ``lines(doc_id, page, line, txt)``. Blank lines and those with a running header's words are left out; lines are put together by the heading they follow, so that a sentence
    that wraps stays whole; a section goes on over the page until the next heading; what comes before any heading is front matter.
    """
    from pyspark.sql import Window

    own = lines.select("doc_id", "page", "line", T.squeeze(T.demojibake(F.col("txt"))).alias("txt")).where("txt <> ''")
    for h in headers:
        own = own.where(~F.col("txt").contains(h))
    heading = F.nullif(F.regexp_extract("txt", SECTION, 1), F.lit(""))
    by_doc, by_page = Window.partitionBy("doc_id").orderBy("page", "line"), Window.partitionBy("doc_id", "page").orderBy("line")
    own = own.withColumn("heading", heading).withColumns({"section": F.coalesce(F.last("heading", ignorenulls=True).over(by_doc), F.lit("front matter")), "block": F.count("heading").over(by_page)})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "txt"))), lambda x: x["txt"]), " ")
    blocks = own.groupBy("doc_id", "page", "block").agg(F.min_by("section", "line").alias("section"), text.alias("text"))
    found = blocks.select("doc_id", "page", "block", "section", F.posexplode(T.sentences(T.dehyphenate(F.col("text")))).alias("pos", "quote")).where(F.col("quote").rlike(r"\d"))
    found = found.withColumns({"numbers": F.slice(T.numbers_in(F.col("quote")), 1, 24), "units": T.units_in(F.col("quote"))}).where("size(numbers) > 0")
    found = found.where("size(units) > 0") if units_needed else found
    return found.withColumns({"obligation": T.has_obligation(F.col("quote")), "setback": T.has_setback(F.col("quote"))})


def passages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences with a unit and an obligation or a setback, with units and score; ``section_passages`` also looks at numbers and sections."""
    s = docs.select(key, F.posexplode(T.sentences(T.dehyphenate(T.squeeze(F.col(text))))).alias("pos", "quote"))
    own = s.withColumns({"units": T.units_in(F.col("quote")), "score": T.passage_score(F.col("quote"))})
    return own.where("size(units) > 0 and score > 0")


def select_permits(rows: DataFrame, key: str, ord_col: str, status: str, statuses: list[str] | None, dates: list[str], year_min: int, keep_undated: bool = False) -> DataFrame:
    """Status filter, then the first row of each key, then the year; in this order, for they don't commute."""
    own = rows
    if statuses and statuses != ["ALL"]:
        own = own.where(F.lower(F.trim(status)).isin([s.strip().lower() for s in statuses]))
    n = F.row_number().over(Window.partitionBy(key).orderBy(ord_col))
    own = own.withColumn("_n", n).where("_n = 1").drop("_n").withColumn("year", N.first_year(*[F.col(d) for d in dates]))
    return own.where((F.col("year") >= year_min) | (F.col("year").isNull() if keep_undated else F.lit(False)))


def selection_stats(rows: DataFrame, key: str, ord_col: str, status: str, statuses: list[str], dates: list[str], year_min: int) -> DataFrame:
    """Counts at each step of the selection."""
    matched = rows.where(F.lower(F.trim(status)).isin([s.strip().lower() for s in statuses]))
    n = F.row_number().over(Window.partitionBy(key).orderBy(ord_col))
    first = matched.withColumn("_n", n).where("_n = 1").withColumn("year", N.first_year(*[F.col(d) for d in dates]))
    kept = first.agg(F.count("*").alias("unique_keys"), F.count_if(F.col("year").isNull()).alias("no_year"), F.count_if(F.col("year") < year_min).alias("too_old"), F.count_if(F.col("year") >= year_min).alias("kept"))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.lower(F.trim(status)).isin([s.lower() for s in statuses])).alias("matched")).crossJoin(kept)


def agreement(obs: DataFrame, attempts: int | None = None) -> DataFrame:
    """Outcome of repeated observations: two equal counts in a row settle it.

    ``obs(detail_id, attempt, kind, doc_count, grid_present)``. A failed fetch forgets the count before it, an exception keeps it. Only attempts 1 to ``attempts`` count, where that is given.
    """
    if attempts is not None:
        obs = obs.where(F.col("attempt").between(1, attempts))
    kept = obs.where("kind <> 'exception'")
    w = Window.partitionBy("detail_id").orderBy("attempt")
    pairs = kept.withColumns({"prev_kind": F.lag("kind").over(w), "prev": F.lag("doc_count").over(w)})
    settled = pairs.where("kind = 'ok' and prev_kind = 'ok' and prev = doc_count").groupBy("detail_id").agg(F.min_by("doc_count", "attempt").alias("settled"))
    ok = F.col("kind") == "ok"
    every = obs.groupBy("detail_id").agg(F.max(F.when(ok, F.col("doc_count"))).alias("most"), F.countDistinct(F.when(ok, F.col("doc_count"))).alias("kinds"), F.bool_or(ok & F.col("grid_present")).alias("grid"), F.bool_or(F.col("kind") == "exception").alias("raised"))
    outcome = (
        F.when(F.col("settled") > 0, "PARSED_DOCS")
        .when(F.col("settled") == 0, "PARSED_ZERO_DOCS")
        .when(F.col("most").isNull(), F.when(F.col("raised"), "PARSE_ERROR").otherwise("FETCH_FAILED"))
        .when(F.col("kinds") > 1, "UNSTABLE")
        .when(F.col("most") > 0, "PARSED_DOCS")
        .when(F.col("grid"), "PARSED_ZERO_DOCS")
        .otherwise("GRID_ABSENT")
    )
    return every.join(settled, "detail_id", "left").select("detail_id", outcome.alias("outcome"), F.coalesce("settled", "most", F.lit(0)).alias("doc_count"))


def repair(records: DataFrame, key: str, size: Column, stamp: str, ord_col: str) -> DataFrame:
    """Best record of each key: most documents, then the latest, then the first; with what was recovered by it."""
    own = records.where(F.col(key).isNotNull()).withColumn("_size", size)
    w = Window.partitionBy(key)
    ranked = own.withColumns({"_n": F.row_number().over(w.orderBy(F.desc("_size"), F.desc(stamp), ord_col)), "_f": F.first("_size").over(w.orderBy(ord_col)), "_c": F.count("*").over(w)})
    return ranked.where("_n = 1").select(*records.columns, (F.col("_c") - 1).alias("duplicates"), (F.col("_size") - F.col("_f")).alias("recovered"))
