"""Scalar functions: text, numbers, urls."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import text as T
from factloom.functions import urls as U
from factloom.registry import Source, on, pick

C = F.col
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
NUM = r"'^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$'"


def _list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _array(words: list[str]) -> str:
    return "[" + _list(words)[1:-1] + "]"


NUMBERS = Source("part", k="p_partkey", raw=pick("p_partkey", ["10", "1,250 gallons", "min. 5 ft", "0.5", "36 inches", "", "illegible", "n/a", "none", "not provided", "13-014.00-039", "-5", " Unknown ", "1.080", "2,475", None, "$3.75 each", "+8 lbs"]))


@on("f1_coerce_number", NUMBERS, rf"""
SELECT k, raw, CASE WHEN lower({STRIP.format('raw')}) NOT IN {_list(N.NO_NUMBER)} AND NOT regexp_matches(replace(lower(raw), ',', ''), '\d+[-.]\d+[-.]\d+')
  THEN TRY_CAST(regexp_extract(replace(lower({STRIP.format('raw')}), ',', ''), '[-+]?\d*\.?\d+') AS DOUBLE) END AS num FROM src""")
def f1(d):
    return d.withColumn("num", N.coerce_number(C("raw")))


DATES = Source("orders", k="o_orderkey", raw=pick("o_orderkey", ["03/14/2019", "2020-01-05", "20140101", "n/d", "May 7, 1998 (rev 2001)", "1899", "12/31/99", None, "2101-01-01"]), other="CAST(o_orderdate AS STRING)")


@on("f2_parse_year", DATES, r"""
SELECT k, raw, CASE WHEN y BETWEEN 1900 AND 2100 THEN y END AS y FROM (SELECT k, raw, TRY_CAST(regexp_extract_all(raw, '\d{4}')[-1] AS INT) AS y FROM src)""")
def f2(d):
    return d.select("k", "raw", N.parse_year(C("raw")).alias("y"))


@on("f3_year_suffix", DATES, "SELECT k, raw, CASE WHEN length(raw) >= 4 THEN right(raw, 4) ELSE 'unknown' END AS y FROM src")
def f3(d):
    return d.select("k", "raw", N.year_suffix(C("raw")).alias("y"))


@on("p4_first_year", DATES, r"""
SELECT k, CASE WHEN a BETWEEN 1900 AND 2100 THEN a WHEN b BETWEEN 1900 AND 2100 THEN b END AS y FROM (
  SELECT k, TRY_CAST(regexp_extract_all(raw, '\d{4}')[-1] AS INT) AS a, TRY_CAST(regexp_extract_all(left(other, 10), '\d{4}')[-1] AS INT) AS b FROM src)""")
def p4(d):
    return d.select("k", N.first_year(C("raw"), F.left("other", F.lit(10))).alias("y"))


COORD = Source("customer", k="c_custkey", raw=pick("c_custkey", ["38,658307", "-75,574018", "38.72009", "39", "abc", "", "nan", None, " 39,813601 ", "1,2", "5d", "-75.1"]), geo=pick("c_custkey", ["(38.658307, -75.574018)", "38.6 -75.5", "(bad)", None, "( 39 , -75.25 )"]))


@on("f4_parse_coordinate", COORD, rf"""
SELECT k, raw, CASE WHEN lower(t) IN ('', 'nan', 'none', 'null') THEN NULL WHEN regexp_matches(t, '^-?\d{{1,3}},\d{{2,}}$') THEN CAST(replace(t, ',', '.') AS DOUBLE)
  WHEN regexp_matches(t, {NUM}) THEN CAST(t AS DOUBLE) END AS x FROM (SELECT *, {STRIP.format('raw')} AS t FROM src)""")
def f4(d):
    return d.select("k", "raw", N.parse_coordinate(C("raw")).alias("x"))


@on("f5_geocoded", COORD, r"""
SELECT k, geo, TRY_CAST(regexp_extract(geo, '^\(\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)\s*\)$', 1) AS DOUBLE) AS lat, TRY_CAST(regexp_extract(geo, '^\(\s*(-?\d+\.?\d*)\s*,\s*(-?\d+\.?\d*)\s*\)$', 2) AS DOUBLE) AS lon FROM src""")
def f5(d):
    return d.select("k", "geo", N.geocoded(C("geo")).alias("g")).select("k", "geo", "g.lat", "g.lon")


FLOWS = Source("supplier", k="s_suppkey", raw=pick("s_suppkey", ["480", "1.080", "2.475", "1,080", "240", "1.5", None, "", "nan", "NaN", "not a number", "12.3456"]))


@on("f8_parse_flow", FLOWS, rf"""
SELECT k, raw, CASE WHEN lower(t) IN ('', 'nan') THEN NULL WHEN regexp_matches(t, '^\d{{1,3}}\.\d{{3}}$') THEN CAST(replace(t, '.', '') AS DOUBLE) WHEN regexp_matches(t, {NUM}) THEN CAST(t AS DOUBLE) END AS flow
FROM (SELECT *, replace(raw, ',', '') AS t FROM src)""")
def f8(d):
    return d.select("k", "raw", N.parse_flow(C("raw")).alias("flow"))


@on("f9_parse_number", FLOWS, rf"SELECT k, raw, CASE WHEN regexp_matches(replace(raw, ',', ''), {NUM}) THEN CAST(replace(raw, ',', '') AS DOUBLE) END AS num FROM src")
def f9(d):
    return d.select("k", "raw", N.parse_number(C("raw")).alias("num"))


USES = Source("orders", k="o_orderkey", use=pick("o_orderkey", ["3-bedroom", "4 Bedroom house", "Other", None, "bedroom", "12bedroom"]), kind=pick("o_orderkey", ["Gravity", "Elevated Mound", "unheard of", "Peat", "pressure dose"]))
KINDS = {"gravity": "gravity", "low pressure pipe": "low pressure pipe", "elevated mound": "sand mound", "alternative elevated sand mound": "sand mound", "pressure dose": "pressure dosed", "peat": "peat", "irrigation": "drip", "holding tank": "holding tank"}


@on("f10_use_and_kind", USES, rf"""
SELECT k, TRY_CAST(regexp_extract(use, '(?i)^(\d+)\s*-?\s*bedroom', 1) AS INT) AS bedrooms, CASE WHEN regexp_matches(use, '(?i)^\d+\s*-?\s*bedroom') THEN 'residential' END AS use_type,
  CASE lower(trim(kind)) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} END AS system_type FROM src""")
def f10(d):
    n = F.regexp_extract("use", r"(?i)^(\d+)\s*-?\s*bedroom", 1).try_cast("int")
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return d.select("k", n.alias("bedrooms"), F.when(n.isNotNull(), "residential").alias("use_type"), kinds[F.lower(F.trim("kind"))].alias("system_type"))


DOC_URLS = Source("orders", k="o_orderkey", url=pick("o_orderkey", ["https://docs.example/1/ab/%3CI%3EPermit%3C/I%3E%3CR%3EWell%3C/R%3E 204 %3CG%3ESite at 13-014.00-039%3C/G%3E -FOIA: Open", "https://docs.example/2/cd/<I>Report -</I><R>-</R><G>no parcel</G>", "https://docs.example/only", "not a url", None, "https://docs.example/3/ef/%3CI%3ESupport&amp;Info%3C/I%3E%3CR%3EA+B%3C/R%3EK-7%3CG%3Elot 3-31-01.00-0012.06%3C/G%3E-FOIA: Closed"]))


@on("f11_document_url", DOC_URLS, r"""
WITH a AS (SELECT k, url_decode(replace(regexp_extract(replace(replace(replace(url, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '+', '%2B')) AS path FROM src),
b AS (SELECT k, path, list_filter(string_split(path, '/'), s -> s <> '') AS parts FROM a),
c AS (SELECT k, len(parts) < 3 AS short, CASE WHEN len(parts) < 3 THEN path ELSE array_to_string(parts[3:], '/') END AS tail FROM b),
d AS (SELECT *, trim(regexp_extract(tail, '<I>(.*?)</I>', 1)) AS i, trim(regexp_extract(tail, '<R>(.*?)</R>', 1)) AS r, trim(regexp_extract(tail, '</R>(.*?)<G>', 1)) AS n, trim(regexp_extract(tail, '<G>(.*?)</G>', 1)) AS g, trim(regexp_extract(tail, '</G>\s*(.*?)\s*$', 1)) AS f FROM c)
SELECT k, CASE WHEN NOT short THEN nullif(trim(regexp_replace(i, '^-+|-+$', '', 'g')), '') END AS doc_type, CASE WHEN NOT short AND trim(r, '- ') <> '' THEN r END AS program, CASE WHEN NOT short THEN nullif(n, '') END AS permit_number,
  CASE WHEN NOT short THEN nullif(g, '') END AS description, CASE WHEN NOT short THEN nullif(regexp_extract(g, '([A-Z]{2}-\d{2}-\d{3}\.\d{2}-\d{2}-\d{2}\.\d{2}\.\d{3}|\d{1,2}-\d{2,3}(?:-\d{2})?\.\d+(?:[.\-]\d+)*)\s*$', 1), '') END AS parcel_id,
  CASE WHEN NOT short THEN nullif(trim(ltrim(f, '-')), '') END AS foia, tail AS title_raw FROM d""")
def f11(d):
    return d.select("k", U.document_fields(C("url")).alias("f")).select("k", "f.*")


CELLS = Source("orders", k="o_orderkey", html=pick("o_orderkey", ["<td><a href='x'>Site%20plan</a> &amp; more</td>", "plain   text", "<b>A</b>&lt;I&gt;B&lt;/I&gt;", ""]))


@on("f12_clean_text", CELLS, r"""
SELECT k, trim(regexp_replace(regexp_replace(url_decode(regexp_replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '<[^>]*>', ' ', 'g')), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS txt FROM src""")
def f12(d):
    return d.select("k", U.clean_text(C("html")).alias("txt"))


SLUGS = Source("part", k="p_partkey", n="p_size", raw=pick("p_partkey", [" A b/c ", "--x--", None, "Ünïcode name", "ok_name-1.pdf", "???"]), st="p_type")
_SLUG = r"CASE WHEN {0} = '' THEN 'unknown' ELSE {0} END".format(r"regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g'), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')")


@on("f13_slug_and_key", SLUGS, f"""
SELECT k, left({_SLUG.format('raw')}, 60) AS slug, 'pdfs/status=' || left({_SLUG.format('st')}, 40) || '/' || CAST(k AS STRING) || '_' || left({_SLUG.format('raw')}, 30) || '/' || lpad(CAST(n AS STRING), 2, '0') || '_' || left({_SLUG.format('st')}, 30) || '.pdf' AS obj FROM src""")
def f13(d):
    return d.select("k", T.slug(C("raw")).alias("slug"), T.object_key("pdfs", C("k"), C("raw"), C("st"), C("n"), C("st")).alias("obj"))


NAMES = Source("part", k="p_partkey", raw="p_name || ' of the ' || p_type || '-x'")
_TOK = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' +'), t -> t <> '')"


@on("f14_tokens", NAMES, f"SELECT k, array_to_string({_TOK.format('raw')}, '|') AS toks FROM src")
def f14(d):
    return d.select("k", F.array_join(T.tokens(C("raw")), "|").alias("toks"))


@on("f15_significant", NAMES, f"SELECT k, array_to_string(list_sort(list_distinct(list_filter({_TOK.format('raw')}, t -> t NOT IN {_list(T.STOPWORDS)} AND length(t) > 1))), '|') AS toks FROM src")
def f15(d):
    return d.select("k", F.array_join(F.array_sort(T.significant(T.tokens(C("raw")))), "|").alias("toks"))


LABELS = Source("orders", k="o_orderkey", label=pick("o_orderkey", ["N", "SCALE:", "Distance to Well", "PROP WELL", "Existing Well", "Avg. Percolation Rate:", "Property line abandoned", "LIMITING ZONE =", "Desired capacity of the well", "well", "Isolation distance to nearest well", "A copy of this page must be submitted with both septic system and well construction report(s)", "Disposal Area to Well", "separation distance well", ""]))
WELL = ["distance to well", "well setback", "disposal area to well"]
RATE = ["percolation rate", "perc rate", "limiting zone"]


def _score_sql(candidates: list[str], distance: bool) -> str:
    import re

    parts = []
    for c in candidates:
        every = re.sub("[^a-z0-9 ]", " ", c).split()
        need = sorted({t for t in every if t not in T.STOPWORDS and len(t) > 1})
        left = f"len(list_filter(sig, t -> t NOT IN {_list(need)}))"
        cond = f"list_has_all(toks, {_array(need)}) AND {left} <= 2" + (" AND len(toks) > 1" if len(every) > 1 else "")
        if distance:
            cond += f" AND (list_has_any(toks, {_array(T.DISTANCE_WORDS)}) OR {left} = 0)"
        parts.append(f"CASE WHEN {cond} THEN {10 + len(need)} - {left} ELSE 0 END")
    ok = f"length(label) <= 48 AND len(toks) BETWEEN 1 AND 8 AND len(list_filter(sig, t -> t NOT IN {_list(T.WEAK)})) > 0" + (f" AND NOT list_has_any(toks, {_array(T.NOT_A_DISTANCE)})" if distance else "")
    return f"CASE WHEN {ok} THEN greatest({', '.join(parts)}) ELSE 0 END"


@on("f16_label_score", LABELS, f"""
WITH t AS (SELECT *, {_TOK.format('label')} AS toks FROM src), s AS (SELECT *, list_distinct(list_filter(toks, t -> t NOT IN {_list(T.STOPWORDS)} AND length(t) > 1)) AS sig FROM t)
SELECT k, label, CAST({_score_sql(WELL, True)} AS INT) AS well, CAST({_score_sql(RATE, False)} AS INT) AS rate FROM s""")
def f16(d):
    return d.select("k", "label", T.label_score(C("label"), WELL, True).alias("well"), T.label_score(C("label"), RATE, False).alias("rate"))


VALUES = Source("orders", k="o_orderkey", raw=pick("o_orderkey", ["60", "8 of 20", "Aug 23", "6 gpm", "8.003 ACRES", "2 BEDROOM HOUSE", "1-2%", "5'' in 3''", "125 ft", "approx. 1,250 feet", "35 -", "~ 40 ft.", "100 (feet)", None, "Section 5.3.31", "12 long words here"]))
_EXP = T.UNITS["feet"]
_WRONG = [u for us in [*T.UNITS.values(), T.OTHER_UNITS] for u in us if u not in _EXP]
_MEAS = r"'(?is)^\s*(?:(?:min|max|approx|approximately|about|avg|average|est)\.?\s+|[<>~=+]\s*)*([-+]?\d{1,4}(?:,\d{3})?(?:\.\d+)?)\s*(.*)$'"


@on("f17_measurement", VALUES, rf"""
WITH a AS (SELECT k, raw, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t FROM src), b AS (SELECT *, regexp_extract(t, {_MEAS}, 1) AS num, trim(regexp_extract(t, {_MEAS}, 2)) AS rest FROM a),
c AS (SELECT *, list_filter(string_split_regex(lower(rest), '[\s,;:()/]+'), x -> regexp_matches(x, '[a-z0-9%''"]')) AS parts FROM b),
d AS (SELECT *, list_distinct(list_concat(list_transform(parts, x -> regexp_replace(x, '^\.+|\.+$', '', 'g')), parts)) AS bare FROM c),
e AS (SELECT *, CASE WHEN t IS NULL OR NOT regexp_matches(t, {_MEAS}) THEN 'prose' WHEN regexp_matches(rest, '\d') THEN 'several numbers' WHEN len(parts) > 2 THEN 'phrase'
  WHEN list_has_any(bare, {_array(_WRONG)}) THEN 'other unit' WHEN len(parts) > 0 AND NOT list_has_any(bare, {_array(_EXP)}) THEN 'not a unit' END AS refused FROM d)
SELECT k, raw, CASE WHEN refused IS NULL THEN TRY_CAST(replace(num, ',', '') AS DOUBLE) END AS num, refused FROM e""")
def f17(d):
    return d.select("k", "raw", T.measurement(C("raw"), "feet").alias("m")).select("k", "raw", C("m.value").alias("num"), "m.refused")


@on("f18_first_number", VALUES, r"SELECT k, TRY_CAST(replace(regexp_extract(raw, '\d{1,4}(?:,\d{3})?(?:\.\d+)?'), ',', '') AS DOUBLE) AS num FROM src")
def f18(d):
    return d.select("k", N.first_number(C("raw")).alias("num"))


TEXTS = Source("documents", k="doc_id", txt="text")
PROSE = Source("documents", k="doc_id", txt="text || ' " + "The well shall be at least 100 feet from a dwelling; see Section 5.3.12. The separation must not exceed 1,250 gallons per day. Depth is 20 inches. Call 302-555-0100 or a.b@example.com, notes a, c. Exhibit C-1 and \"disposal area\" means a field." + "'")


@on("f19_squeeze", TEXTS, r"SELECT k, md5(trim(regexp_replace(txt, '\s+', ' ', 'g'))) AS h FROM src")
def f19(d):
    return d.select("k", F.md5(T.squeeze(C("txt")).cast("binary")).alias("h"))


@on("f20_demojibake", TEXTS, "SELECT k, md5(translate(txt, '" + "".join(T.CURLY) + "', '" + "".join(T.CURLY.values()).replace("'", "''") + "')) AS h FROM src")
def f20(d):
    return d.select("k", F.md5(T.demojibake(C("txt")).cast("binary")).alias("h"))


@on("f20_nfkc", Source("documents", k="doc_id", txt="text || ' ﬁne ½ Ａ'"), None)
def f20b(d):
    return d.select("k", F.md5(T.nfkc(C("txt")).cast("binary")).alias("h"))


@on("f21_dehyphenate", Source("documents", k="doc_id", txt="replace(text, 'th', 't- h')"), r"SELECT k, md5(regexp_replace(txt, '([0-9A-Za-z_])-\s+([0-9A-Za-z_])', '\1\2', 'g')) AS h FROM src")
def f21(d):
    return d.select("k", F.md5(T.dehyphenate(C("txt")).cast("binary")).alias("h"))


@on("f22_sentences", PROSE, r"""
SELECT k, len(s) AS n, md5(array_to_string(s, '|')) AS h FROM (SELECT k, string_split(regexp_replace(txt, '([.;:])\s+([A-Z("''])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM src)""")
def f22(d):
    s = T.sentences(C("txt"))
    return d.select("k", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|").cast("binary")).alias("h"))


SMALL = Source("orders", k="o_orderkey", txt=pick("o_orderkey", ["at least 100 feet, see 5.3.12 and 1,250 gallons", "no numbers", "3.5 inches or 12", "1.2.3", "exactly 7"]))


@on("f23_numbers_in", SMALL, r"""
SELECT k, CASE CAST(k % 5 AS INT) WHEN 0 THEN '100|1,250' WHEN 1 THEN '' WHEN 2 THEN '3.5|12' WHEN 3 THEN '' ELSE '7' END AS nums FROM src""")
def f23(d):
    return d.select("k", F.array_join(T.numbers_in(C("txt")), "|").alias("nums"))


@on("f24_units_in", PROSE, "SELECT k, concat_ws('|', " + ", ".join(f"CASE WHEN regexp_matches(txt, '(?i){p}') THEN '{n}' END" for n, p in T.UNIT_FAMILIES) + ") AS units FROM src")
def f24(d):
    return d.select("k", F.array_join(T.units_in(C("txt")), "|").alias("units"))


@on("f25_obligation", PROSE, f"""
SELECT k, regexp_matches(txt, '(?i){T.OBLIGATION_WIDE}') AS wide, regexp_matches(txt, '(?i){T.OBLIGATION}') AS narrow, regexp_matches(txt, '(?i){T.SETBACK}') AS setback,
  CAST(regexp_matches(txt, '(?i){T.OBLIGATION_WIDE}') AS INT) * 2 + CAST(regexp_matches(txt, '(?i){T.SETBACK}') AS INT) AS score FROM src""")
def f25(d):
    return d.select("k", T.has_obligation(C("txt")).alias("wide"), T.has_obligation(C("txt"), False).alias("narrow"), T.has_setback(C("txt")).alias("setback"), T.passage_score(C("txt")).alias("score"))


DOTTED = Source("orders", k="o_orderkey", num="CAST(o_orderkey % 7 AS STRING) || '.' || CAST(o_orderkey % 13 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '.4' ELSE '' END")


@on("f26_section_parent", DOTTED, r"SELECT k, num, regexp_replace(num, '\.[^.]+$', '') AS parent, CAST(len(string_split(num, '.')) AS INT) AS depth FROM src")
def f26(d):
    return d.select("k", "num", T.section_parent(C("num")).alias("parent"), T.section_depth(C("num")).alias("depth"))


@on("f27_references", PROSE, f"SELECT k, array_to_string(list_sort(list_distinct(regexp_extract_all(txt, '{T.XREF}', 1))), '|') AS secs, array_to_string(list_sort(list_distinct(regexp_extract_all(txt, '{T.EXHIBIT}', 1))), '|') AS exhibits FROM src")
def f27(d):
    return d.select("k", F.array_join(F.array_sort(T.section_refs(C("txt"))), "|").alias("secs"), F.array_join(F.array_sort(T.exhibit_refs(C("txt"))), "|").alias("exhibits"))


@on("f28_definitions", PROSE, f"SELECT k, array_to_string(regexp_extract_all(txt, '{T.DEFINITION}', 1), '|') AS terms FROM src")
def f28(d):
    return d.select("k", F.array_join(T.definitions(C("txt")), "|").alias("terms"))


@on("f29_title_page", Source("documents", k="doc_id", txt="text", title=pick("doc_id", ["the of and", "that with from", "ciones", "und der"])), f"""
WITH w AS (SELECT k, txt, list_filter({_TOK.format('title')}, t -> t NOT IN {_list(T.STOPWORDS)} AND length(t) > 1) AS words FROM src)
SELECT k, len(list_filter(words, w -> NOT contains(lower(txt), w))) = 0 AS located FROM w""")
def f29(d):
    words = T.significant(T.tokens(C("title")))
    return d.select("k", F.forall(words, lambda w: F.contains(F.lower("txt"), w)).alias("located"))


CITES = Source("part", k="p_partkey", raw=pick("p_partkey", ["5.3.12.1.3", "Exhibit C", "exhibit b2-1", "TBD", "", None, " 4.1 "]))


@on("f30_citation_node", CITES, rf"""
SELECT k, CASE WHEN t IS NULL OR t IN ('', 'TBD') THEN NULL WHEN regexp_matches(t, '(?i)^Exhibit\s+([A-Z][A-Z0-9]?(?:-\d+)?)$') THEN 'exhibit:' || upper(regexp_extract(t, '(?i)^Exhibit\s+([A-Z][A-Z0-9]?(?:-\d+)?)$', 1)) ELSE 'section:' || t END AS node
FROM (SELECT k, {STRIP.format('raw')} AS t FROM src)""")
def f30(d):
    return d.select("k", T.citation_node(C("raw")).alias("node"))


QUOTES = Source("documents", k="doc_id", txt="text", quote=pick("doc_id", ["the  of", "that was", "shall be at least", "de la"]))


@on("f31_quote_verified", QUOTES, r"SELECT k, contains(trim(regexp_replace(txt, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS verified FROM src")
def f31(d):
    return d.select("k", F.contains(T.squeeze(C("txt")), T.squeeze(C("quote"))).alias("verified"))


@on("f35_redact", PROSE, rf"""
SELECT k, md5(regexp_replace(regexp_replace(txt, '{T.EMAIL}', '[email redacted]', 'g'), '{T.PHONE}', '[phone redacted]', 'g')) AS redacted, md5({STRIP.format("regexp_replace(txt, '" + T.NOTES + "', '', 'g')")}) AS without_notes FROM src""")
def f35(d):
    return d.select("k", F.md5(T.redact(C("txt")).cast("binary")).alias("redacted"), F.md5(T.strip_notes(C("txt")).cast("binary")).alias("without_notes"))


PAIRS = Source("part", k="p_partkey", a="p_brand", b=pick("p_partkey", ["nan", "", "steel", None]), c="p_size")


@on("f36_summary", PAIRS, "SELECT k, concat_ws('; ', 'brand ' || a, CASE WHEN lower(trim(b)) NOT IN ('', 'nan') THEN 'kind ' || b END, 'size ' || CAST(c AS STRING)) AS txt FROM src")
def f36(d):
    return d.select("k", T.summary([("brand", C("a")), ("kind", C("b")), ("size", C("c"))]).alias("txt"))


@on("f38_general_format", Source("lineitem", k="l_orderkey", n="l_linenumber", p="l_partkey", x="l_quantity * 4 / 8"), r"SELECT k, n, p, regexp_replace(regexp_replace(printf('%.4f', x), '0+$', ''), '\.$', '') AS g FROM src")
def f38(d):
    return d.select("k", "n", "p", N.general(C("x")).alias("g"))


@on("f39_truncate", TEXTS, "SELECT k, md5(left(txt, 500)) AS a, md5(left(txt, 2000)) AS b FROM src")
def f39(d):
    return d.select("k", F.md5(F.left("txt", F.lit(500)).cast("binary")).alias("a"), F.md5(F.left("txt", F.lit(2000)).cast("binary")).alias("b"))


@on("f39_wrap", Source("benchmark", k="item_id", txt="text"), None)
def f39b(d):
    return d.select("k", F.posexplode(T.wrap_lines(C("txt"), 80)).alias("line", "txt"))


@on("f40_cypher_literal", Source("part", k="p_partkey", raw=pick("p_partkey", ["it''s", "plain", "a" + chr(92) + "b"])), r"SELECT k, '''' || replace(replace(raw, '\', '\\'), '''', '\''') || '''' AS lit FROM src")
def f40(d):
    return d.select("k", T.cypher_literal(C("raw")).alias("lit"))


@on("f41_duration", Source("orders", k="o_orderkey", s="CAST(floor(o_totalprice / 20) AS BIGINT)"), "SELECT k, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS STRING), 2, '0') || 's' ELSE (s // 3600) || 'h ' || lpad(CAST((s % 3600) // 60 AS STRING), 2, '0') || 'm' END AS txt FROM src")
def f41(d):
    return d.select("k", T.duration(C("s")).alias("txt"))


@on("f42_detail_id", Source("pages", k="page_id", url="url || '&id=' || CAST(page_id AS STRING)"), "SELECT k, nullif(regexp_extract(url, '(?i)[?&]id=(\\d+)', 1), '') AS id, 'https://permits.example/detail?id=' || CAST(k AS STRING) AS back FROM src")
def f42(d):
    return d.select("k", U.detail_id(C("url")).alias("id"), U.detail_url("https://permits.example/detail?id=", C("k")).alias("back"))


@on("f43_safe_name", Source("customer", k="c_custkey", raw="c_name || ' (' || c_mktsegment || ').pdf'"), "SELECT k, regexp_replace(raw, '[^A-Za-z0-9_-]+', '_', 'g') AS name FROM src")
def f43(d):
    return d.select("k", T.safe_name(C("raw")).alias("name"))


@on("f44_provenance", Source("orders", k="o_orderkey", source=pick("o_orderkey", ["checkbox", "form_field", "text_pattern", "derived"]), page="CAST(o_orderkey % 9 AS INT)", conf="CAST(o_orderkey % 100 AS INT)"), """
SELECT k, CASE source WHEN 'checkbox' THEN 'a ticked box' WHEN 'form_field' THEN 'a form field' WHEN 'text_pattern' THEN 'the page text' ELSE 'other facts' END || ', page ' || page || ' (' || conf || '%)' AS txt FROM src""")
def f44(d):
    kind = F.when(C("source") == "checkbox", "a ticked box").when(C("source") == "form_field", "a form field").when(C("source") == "text_pattern", "the page text").otherwise("other facts")
    return d.select("k", F.concat(kind, F.lit(", page "), C("page").cast("string"), F.lit(" ("), F.format_string("%.0f%%", C("conf").cast("double")), F.lit(")")).alias("txt"))


@on("f45_query_text", PAIRS, "SELECT k, concat_ws('; ', 'system ' || a, CASE WHEN lower(trim(b)) NOT IN ('', 'nan') THEN 'use ' || b END) AS txt FROM src")
def f45(d):
    return d.select("k", T.summary([("system", C("a")), ("use", C("b"))]).alias("txt"))


@on("f46_threshold_text", Source("part", k="p_partkey", t=pick("p_partkey", ["100", None, "20"]), u=pick("p_partkey", ["feet", None, None, "percent"])), "SELECT k, CASE WHEN t IS NULL THEN 'presence check' ELSE concat_ws(' ', t, u) END AS txt FROM src")
def f46(d):
    return d.select("k", F.when(C("t").isNull(), "presence check").otherwise(F.concat_ws(" ", "t", "u")).alias("txt"))


@on("f47_gate_text", Source("part", k="p_partkey", a="p_brand", b="p_type", n="p_size"), "SELECT k, CASE WHEN n % 3 = 0 THEN 'always' ELSE 'brand = ' || a || '; type = ' || b || ', any' END AS txt FROM src")
def f47(d):
    gates = F.array(F.struct(F.lit("brand").alias("key"), F.array("a").alias("allowed")), F.struct(F.lit("type").alias("key"), F.array(C("b"), F.lit("any")).alias("allowed")))
    text = F.array_join(F.transform(gates, lambda g: F.concat(g["key"], F.lit(" = "), F.array_join(g["allowed"], ", "))), "; ")
    return d.select("k", F.when(C("n") % 3 == 0, "always").otherwise(text).alias("txt"))


@on("f49_short_label", Source("part", k="p_partkey", raw="'ISO-' || CAST(p_size AS STRING) || '-' || p_brand"), "SELECT k, array_to_string(string_split(raw, '-')[1:2], '-') AS short FROM src")
def f49(d):
    return d.select("k", F.substring_index("raw", "-", 2).alias("short"))


@on("f50_tile_key", Source("customer", k="c_custkey", lat="38.5 + (c_custkey % 1000) / 2000.0", lon="-75.5 + (c_custkey % 777) / 2000.0"), "SELECT k, printf('%.4f_%.4f', CAST(lat AS DOUBLE), CAST(lon AS DOUBLE)) AS tile FROM src")
def f50(d):
    return d.select("k", F.format_string("%.4f_%.4f", C("lat").cast("double"), C("lon").cast("double")).alias("tile"))


@on("f51_throttled", Source("orders", k="o_orderkey", err=pick("o_orderkey", ["ThrottlingException", "Rate exceeded", "not found", "Read timeout"])), "SELECT k, regexp_matches(lower(err), 'throttl|too many requests|rate exceeded|serviceunavailable|timeout') AS retry FROM src")
def f51(d):
    return d.select("k", T.is_throttled(C("err")).alias("retry"))


@on("p15_blocked_topics", Source("conversations", k="conv_id", t="turn", txt="text || ' ' || " + pick("turn", ["can I get a variance", "how far is the well", "was it DENIED"])), f"SELECT k, t, regexp_matches(lower(txt), '{'|'.join(T.BLOCKED_TOPICS)}') AS blocked FROM src")
def p15(d):
    return d.select("k", "t", T.is_blocked(C("txt")).alias("blocked"))


@on("p17_fetch_outcome", Source("pages", k="page_id", ok="page_id % 7 <> 0", html="CASE WHEN page_id % 5 = 0 THEN '' ELSE html END"), r"""
SELECT k, CASE WHEN NOT ok THEN 'FETCH_FAILED' WHEN len(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"'']*)["'']', 1)) > 0 THEN 'PARSED_DOCS' WHEN contains(html, 'example') THEN 'PARSED_ZERO_DOCS' ELSE 'GRID_ABSENT' END AS outcome FROM src""")
def p17(d):
    return d.select("k", U.fetch_outcome(C("ok"), F.size(U.links(C("html"))), C("html"), "example").alias("outcome"))


@on("s14_html_links", Source("pages", k="page_id", html="html"), r"""
WITH l AS (SELECT k, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"'']*)["'']', 1)) AS url, generate_subscripts(regexp_extract_all(html, '(?i)<a\s[^>]*href=["'']([^"'']*)["'']', 1), 1) AS pos FROM src)
SELECT k, url, CAST(min(pos) - 1 AS INT) AS pos FROM l GROUP BY k, url""")
def s14(d):
    return d.select("k", F.posexplode(U.links(C("html"))).alias("pos", "url")).groupBy("k", "url").agg(F.min("pos").alias("pos"))
