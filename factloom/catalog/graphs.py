"""The section graph: built from driver tables as dotted numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import graph as G
from factloom.registry import query, read

C = F.col
# region r -> r+1, nation -> region.nation, customer -> region.nation.customer; text from documents by key
_NODES = """n AS (
SELECT CAST(r_regionkey + 1 AS STRING) AS number, r_name AS title, CAST('' AS STRING) AS text FROM region
UNION ALL SELECT CAST(n_regionkey + 1 AS STRING) || '.' || CAST(n_nationkey AS STRING), n_name || ' must comply with at least this', CASE WHEN n_nationkey % 2 = 0 THEN 'See Section ' || CAST(1 + n_nationkey % 5 AS STRING) || '.' || CAST((n_nationkey * 7) % 25 AS STRING) || ' unless exempted from it. Exhibit C shall apply.' ELSE '' END FROM nation
UNION ALL SELECT CAST(n_regionkey + 1 AS STRING) || '.' || CAST(n_nationkey AS STRING) || '.' || CAST(c_custkey AS STRING), c_name, CASE c_custkey % 3 WHEN 0 THEN 'refer to Section ' || CAST(n_regionkey + 1 AS STRING) || '.' || CAST(n_nationkey AS STRING) || ' and it shall hold' WHEN 1 THEN '"' || lower(c_mktsegment) || '" means a kind' ELSE '' END FROM customer JOIN nation ON n_nationkey = c_nationkey),
nodes AS (SELECT 'section:' || number AS id, 'Section' AS type, number, title, text FROM n UNION ALL SELECT 'exhibit:C', 'Exhibit', NULL, 'Exhibit C', ''),
rules AS (SELECT 'R' || CAST(n_nationkey AS STRING) AS rule_id, CASE WHEN n_nationkey % 4 = 0 THEN 'Exhibit C' WHEN n_nationkey % 4 = 1 THEN 'TBD' ELSE CAST(n_regionkey + 1 AS STRING) || '.' || CAST(n_nationkey AS STRING) END AS section FROM nation)"""
_EDGES = f"""{_NODES},
refs AS (SELECT DISTINCT id, unnest(regexp_extract_all(left(text, 2000), '{T.XREF}', 1)) AS r, regexp_matches(left(text, 2000), '(?i){T.EXCEPTION}') AS exc FROM nodes WHERE type = 'Section'),
defs AS (SELECT id, unnest(regexp_extract_all(left(text, 2000), '{T.DEFINITION}', 1)) AS term FROM nodes WHERE type = 'Section'),
exc AS (SELECT id, 'section:' || regexp_replace(number, '\\.[^.]+$', '') AS parent FROM nodes WHERE type = 'Section' AND contains(number, '.') AND regexp_matches(left(text, 2000), '(?i){T.EXCEPTION}')),
linked AS (SELECT id FROM refs WHERE exc AND id <> 'section:' || r AND 'section:' || r IN (SELECT id FROM nodes)),
terms AS (SELECT DISTINCT 'term:' || lower(regexp_replace(term, '\\s+', '_', 'g')) AS dst, lower(trim(term)) AS term FROM defs WHERE length(trim(term)) >= 3),
e AS (SELECT 'section:' || regexp_replace(number, '\\.[^.]+$', '') AS src, id AS dst, 0 AS pr FROM nodes WHERE type = 'Section' AND contains(number, '.')
 UNION ALL SELECT id, 'section:' || r, 1 FROM refs UNION ALL SELECT id, 'section:' || r, 4 FROM refs WHERE exc
 UNION ALL SELECT id, 'exhibit:' || unnest(regexp_extract_all(left(text, 2000), '{T.EXHIBIT}', 1)), 1 FROM nodes WHERE type = 'Section'
 UNION ALL SELECT id, 'term:' || lower(regexp_replace(term, '\\s+', '_', 'g')), 2 FROM defs
 UNION ALL SELECT id, parent, 4 FROM exc WHERE id NOT IN (SELECT id FROM linked)
 UNION ALL SELECT n.id, t.dst, 3 FROM nodes n JOIN terms t ON contains(lower(n.title || ' ' || left(n.text, 2000)), t.term) WHERE n.type = 'Section' AND NOT starts_with(n.number, '2')
 UNION ALL SELECT 'rule:' || rule_id, CASE WHEN section = 'Exhibit C' THEN 'exhibit:C' ELSE 'section:' || section END, 5 FROM rules WHERE section <> 'TBD'),
known AS (SELECT id FROM nodes UNION SELECT 'term:' || lower(regexp_replace(term, '\\s+', '_', 'g')) FROM defs),
edges AS (SELECT src, dst, ['CONTAINS', 'REFERENCES', 'DEFINES', 'USES_TERM', 'EXCEPTION', 'CITES'][max(pr) + 1] AS type FROM e WHERE src <> dst AND dst IN (SELECT id FROM known) GROUP BY 1, 2)"""

#: Parts of the contexts of sections, by two ways: up from each section and down to it.
_ITEMS = """, up(id, top) AS (SELECT dst, src FROM edges WHERE type = 'CONTAINS' UNION SELECT up.id, e.src FROM up JOIN edges e ON e.dst = up.top AND e.type = 'CONTAINS'),
down(top, id) AS (SELECT id, id FROM nodes WHERE type = 'Section' UNION SELECT down.top, e.dst FROM down JOIN edges e ON e.src = down.id AND e.type = 'CONTAINS'),
sec AS (SELECT id, number FROM nodes WHERE type = 'Section'),
links AS (SELECT e.src AS id, 'references' AS part, e.dst AS item FROM edges e JOIN sec ON sec.id = e.src WHERE e.type = 'REFERENCES'
 UNION ALL SELECT e.src, 'definitions', t.term FROM edges e JOIN terms t USING (dst) WHERE e.type = 'USES_TERM'
 UNION ALL SELECT e.dst, 'exceptions', a.number FROM edges e JOIN sec a ON a.id = e.src JOIN sec b ON b.id = e.dst WHERE e.type = 'EXCEPTION'),
items AS (SELECT up.id, 'ancestors' AS part, sec.number AS item FROM up JOIN sec ON sec.id = up.top UNION ALL SELECT * FROM links),
twin_items AS (SELECT down.id, 'ancestors' AS part, sec.number AS item FROM down JOIN sec ON sec.id = down.top WHERE down.id <> down.top UNION ALL SELECT * FROM links)"""


def tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    for t in ("region", "nation", "customer"):
        read(spark, sf, t).createOrReplaceTempView(f"factloom_{t}")
    text = _NODES.replace("CAST('' AS STRING)", "''")
    for t in ("region", "nation", "customer"):
        text = text.replace(f"FROM {t}", f"FROM factloom_{t}").replace(f"JOIN {t} ", f"JOIN factloom_{t} ")
    return spark.sql(f"WITH {text} SELECT * FROM nodes"), spark.sql(f"WITH {text} SELECT * FROM rules")


def graph(spark: SparkSession, sf: str, chars: int | None = 2000) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; the SQL here looks at the first 2000 characters of texts."""
    nodes, rules = tables(spark, sf)
    return nodes, G.build_edges(nodes, rules, chars)


def q(name: str, sql: str):
    return query(name, f"WITH RECURSIVE {_EDGES}{sql}")


@q("r3_edges", " SELECT src, dst, type FROM edges")
def r3(spark, sf):
    return graph(spark, sf)[1].select("src", "dst", "type")


@q("d17_edge_precedence", " SELECT type, count(*) AS n FROM edges GROUP BY 1")
def d17(spark, sf):
    return graph(spark, sf)[1].groupBy("type").agg(F.count("*").alias("n"))


@q("r4_ancestors", ", up(node, ancestor, distance) AS (SELECT dst, src, 1 FROM edges WHERE type = 'CONTAINS' UNION ALL SELECT up.node, e.src, distance + 1 FROM up JOIN edges e ON e.dst = up.ancestor AND e.type = 'CONTAINS') SELECT * FROM up")
def r4(spark, sf):
    return G.ancestors(G.containment(tables(spark, sf)[0]))


@query("r4_context")
def r4b(spark, sf):
    return G.context(*graph(spark, sf))


@q("r4_context_items", _ITEMS + " SELECT id, part, item FROM items")
def r4_items(spark, sf):
    return G.context_items(G.context(*graph(spark, sf)))


@q("r5_unresolved_reach", ", walk(start, node) AS (SELECT 'rule:' || rule_id, 'rule:' || rule_id FROM rules UNION SELECT walk.start, e.dst FROM walk JOIN edges e ON e.src = walk.node AND e.type IN ('CITES', 'REFERENCES')) SELECT start, node FROM walk JOIN nodes ON id = node WHERE trim(text) = '' AND NOT (type = 'Section' AND len(string_split_regex(trim(title), '\\s+')) >= 4)")
def r5(spark, sf):
    return r5_discoveries(spark, sf).select("start", "node")


@query("r5_discoveries")
def r5_discoveries(spark, sf):
    """r5 with the kind of edge that each unread node is reached by, and the number of its discoveries."""
    nodes, edges = graph(spark, sf)
    starts = tables(spark, sf)[1].select(F.concat(F.lit("rule:"), "rule_id").alias("start"))
    got = G.reach(starts, edges, ["CITES", "REFERENCES"])
    unread = nodes.where(~G.readable(C("type"), C("title"), C("text"))).select(C("id").alias("node"))
    return got.join(unread, "node", "left_semi").select("start", "node", "hops", "reached_via", "discoveries")


@q("r6_readable", " SELECT id, trim(text) <> '' OR (type = 'Section' AND len(string_split_regex(trim(title), '\\s+')) >= 4) AS readable FROM nodes")
def r6(spark, sf):
    return graph(spark, sf)[0].select("id", G.readable(C("type"), C("title"), C("text")).alias("readable"))


@q("r7_orphans", f" SELECT id, number, left(text, 150) AS preview FROM nodes WHERE type = 'Section' AND regexp_matches(title || ' ' || text, '(?i){T.OBLIGATION}') AND id NOT IN (SELECT dst FROM edges WHERE type = 'CITES')")
def r7(spark, sf):
    nodes, rules = tables(spark, sf)
    return G.orphans(nodes, G.citations(nodes, rules)).orderBy("key").drop("key")


@q("r8_summary", " SELECT 'node' AS what, coalesce(type, 'all') AS type, count(*) AS n FROM nodes GROUP BY ROLLUP (type) UNION ALL SELECT 'edge', coalesce(type, 'all'), count(*) FROM edges GROUP BY ROLLUP (type)")
def r8(spark, sf):
    return G.summary(*graph(spark, sf))


@q("a12_graph_summary", " SELECT type, count(*) AS n FROM nodes GROUP BY 1")
def a12(spark, sf):
    return graph(spark, sf)[0].groupBy("type").agg(F.count("*").alias("n"))


@q("r9_rule_neighbourhood", " SELECT a.src AS rule, a.dst AS node, 1 AS hops FROM edges a WHERE a.type = 'CITES' UNION SELECT a.src, b.dst, 2 FROM edges a JOIN edges b ON b.src = a.dst AND b.type IN ('REFERENCES', 'CONTAINS') WHERE a.type = 'CITES'")
def r9(spark, sf):
    e = graph(spark, sf)[1]
    one = e.where("type = 'CITES'").select(C("src").alias("rule"), C("dst").alias("node"))
    two = one.join(e.where("type in ('REFERENCES', 'CONTAINS')").select(C("src").alias("node"), "dst"), "node").select("rule", C("dst").alias("node"))
    return one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2))).distinct()


@q("r10_bounded_path", ", walk(start, node, hops) AS (SELECT src, dst, 1 FROM edges WHERE type = 'CITES' UNION SELECT walk.start, e.dst, hops + 1 FROM walk JOIN edges e ON e.src = walk.node AND e.type = 'REFERENCES' WHERE hops < 5) SELECT DISTINCT start, node FROM walk")
def r10(spark, sf):
    nodes, edges = graph(spark, sf)
    starts = tables(spark, sf)[1].select(F.concat(F.lit("rule:"), "rule_id").alias("start"))
    return G.reach(starts, edges, ["CITES", "REFERENCES"], 5).select("start", "node")


@q(
    "r11_backend_parity",
    _ITEMS
    + f""", walk(start, node) AS (SELECT 'rule:' || rule_id, 'rule:' || rule_id FROM rules UNION SELECT walk.start, e.dst FROM walk JOIN edges e ON e.src = walk.node AND e.type IN ('CITES', 'REFERENCES')),
five(start, node, hops) AS (SELECT 'rule:' || rule_id, 'rule:' || rule_id, 0 FROM rules UNION SELECT five.start, e.dst, hops + 1 FROM five JOIN edges e ON e.src = five.node AND e.type IN ('CITES', 'REFERENCES') WHERE hops < 5),
a AS (SELECT 'unresolved' AS what, start AS subject, node AS item FROM walk JOIN nodes ON id = node WHERE trim(text) = '' AND NOT (type = 'Section' AND len(string_split_regex(trim(title), '\\s+')) >= 4)
 UNION SELECT 'orphans', id, number FROM nodes WHERE type = 'Section' AND regexp_matches(title || ' ' || text, '(?i){T.OBLIGATION}') AND id NOT IN (SELECT dst FROM edges WHERE type = 'CITES') UNION SELECT part, id, item FROM items),
b AS (SELECT 'unresolved' AS what, start AS subject, node AS item FROM five JOIN nodes ON id = node WHERE trim(text) = '' AND NOT (type = 'Section' AND len(string_split(title, ' ')) >= 4)
 UNION SELECT 'orphans', id, number FROM nodes WHERE type = 'Section' AND (regexp_full_match(text, '{G.TWIN_OBLIGATION[:4] + G.TWIN_OBLIGATION[6:-2]}') OR regexp_full_match(title, '{G.TWIN_OBLIGATION[:4] + G.TWIN_OBLIGATION[6:-2]}')) AND id NOT IN (SELECT dst FROM edges WHERE type = 'CITES') UNION SELECT part, id, item FROM twin_items)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS differences""",
)
def r11(spark, sf):
    starts = tables(spark, sf)[1].select(F.concat(F.lit("rule:"), "rule_id").alias("start"))
    return G.backend_differences(starts, *graph(spark, sf)).agg(F.count("*").alias("differences"))


@q("r12_prefix_invariant", " SELECT count(*) AS bad FROM edges WHERE type = 'CONTAINS' AND NOT starts_with(dst, src || '.')")
def r12(spark, sf):
    return graph(spark, sf)[1].where((C("type") == "CONTAINS") & ~F.startswith("dst", F.concat("src", F.lit(".")))).agg(F.count("*").alias("bad"))


@q("j11_rule_citations", " SELECT rule_id, CASE WHEN section = 'Exhibit C' THEN 'exhibit:C' WHEN section <> 'TBD' THEN 'section:' || section END AS node FROM rules")
def j11(spark, sf):
    return tables(spark, sf)[1].select("rule_id", T.citation_node(C("section")).alias("node"))


@q("s18_cypher_export", " SELECT 'MATCH (a {id: ''' || src || '''}), (b {id: ''' || dst || '''}) MERGE (a)-[:' || type || ']->(b)' AS statement FROM edges")
def s18(spark, sf):
    e = graph(spark, sf)[1]
    lit = lambda c: T.cypher_literal(C(c))
    return e.select(F.concat(F.lit("MATCH (a {id: "), lit("src"), F.lit("}), (b {id: "), lit("dst"), F.lit("}) MERGE (a)-[:"), "type", F.lit("]->(b)")).alias("statement"))


@query("c24_rule_checklist")
def c24(spark, sf):
    nodes, edges = graph(spark, sf)
    rules = tables(spark, sf)[1]
    return G.checklist(rules, nodes, G.context(nodes, edges, rules.select(T.citation_node(C("section")).alias("id"))))


@q(
    "c24_checklist_sizes",
    _ITEMS + """, cited AS (SELECT rule_id, CASE WHEN section = 'Exhibit C' THEN 'exhibit:C' WHEN section <> 'TBD' THEN 'section:' || section END AS id FROM rules),
sizes AS (SELECT id, count(*) FILTER (part = 'references') AS refs, count(*) FILTER (part = 'definitions') AS defs, count(*) FILTER (part = 'exceptions') AS exceptions FROM items GROUP BY 1)
SELECT rule_id, n.id AS cited, least(coalesce(refs, 0), 6) AS refs, least(coalesce(defs, 0), 8) AS defs, least(coalesce(exceptions, 0), 4) AS exceptions FROM cited LEFT JOIN nodes n USING (id) LEFT JOIN sizes USING (id)""",
)
def c24_sizes(spark, sf):
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return c24(spark, sf).select("rule_id", "cited", size(C("references")).alias("refs"), size(C("definitions")).alias("defs"), size(C("exceptions")).alias("exceptions"))


@q("c16_coverage_report", f", s AS (SELECT id, regexp_matches(title || ' ' || text, '(?i){T.OBLIGATION}') AS ob, id IN (SELECT dst FROM edges WHERE type = 'CITES') AS cited FROM nodes WHERE type = 'Section') SELECT count(*) AS sections, count(*) FILTER (ob) AS obligations, count(*) FILTER (ob AND cited) AS cited, count(*) FILTER (ob AND NOT cited) AS uncited FROM s")
def c16(spark, sf):
    nodes, rules = tables(spark, sf)
    edges = G.citations(nodes, rules)
    s = nodes.where("type = 'Section'").select("id", T.has_obligation(F.concat_ws(" ", "title", "text"), False).alias("ob"))
    s = s.join(edges.where("type = 'CITES'").select(C("dst").alias("id"), F.lit(True).alias("cited")).distinct(), "id", "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    return s.agg(F.count("*").alias("sections"), F.count_if("ob").alias("obligations"), F.count_if(C("ob") & C("cited")).alias("cited"), F.count_if(C("ob") & ~C("cited")).alias("uncited"))


LINES = "SELECT doc_id AS page, CAST(i AS INT) AS line, string_split(text, chr(10))[i] AS txt FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"


def lines(spark, sf):
    """Lines of documents; some are turned into numbered headings."""
    d = read(spark, sf, "documents").select(C("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "txt")).withColumn("line", C("i") + 1).drop("i")
    number = F.concat(((C("page") % 9) + 1).cast("string"), F.when(C("line") > 1, F.concat(F.lit("."), C("line").cast("string"))).otherwise(""))
    return d.withColumn("txt", F.when((C("line") <= 3) & (C("page") % 3 == 0), F.concat(number, F.lit(" "), F.lit("Heading of page "), C("page").cast("string"))).otherwise(C("txt")))


_LINES = f"raw AS ({LINES}), l AS (SELECT page, line, CASE WHEN line <= 3 AND page % 3 = 0 THEN CAST(page % 9 + 1 AS STRING) || CASE WHEN line > 1 THEN '.' || line ELSE '' END || ' Heading of page ' || page ELSE txt END AS txt FROM raw)"
_HEADS = _LINES + r""", h AS (SELECT page, line, regexp_extract(txt, '^(\d{1,2}(?:\.\d{1,3}){0,6})\s+(.+)', 1) AS number, trim(regexp_extract(txt, '^(\d{1,2}(?:\.\d{1,3}){0,6})\s+(.+)', 2)) AS title FROM l), c AS (SELECT *, count(*) OVER (PARTITION BY number) AS seen, row_number() OVER (PARTITION BY number ORDER BY page, line) AS nth FROM h WHERE number <> '' AND regexp_matches(title, '^[A-Z]') AND length(title) <= 120),
k AS (SELECT * FROM c WHERE seen <= 3 AND nth = 1), ok AS (SELECT * FROM k WHERE NOT contains(number, '.') UNION ALL SELECT k.* FROM k JOIN ok ON ok.number = regexp_replace(k.number, '\.[^.]+$', '') WHERE contains(k.number, '.'))"""


@query("r1_headings", f"WITH RECURSIVE {_HEADS} SELECT page, line, number, title FROM ok")
def r1(spark, sf):
    return G.headings(lines(spark, sf)).select("page", "line", "number", "title")


@query("r2_section_bodies", f"WITH RECURSIVE {_HEADS}, m AS (SELECT l.page, l.line, l.txt, ok.number FROM l LEFT JOIN ok USING (page, line)), s AS (SELECT *, last_value(number IGNORE NULLS) OVER (PARTITION BY page ORDER BY line ROWS UNBOUNDED PRECEDING) AS sec FROM m) SELECT sec AS number, md5(string_agg(txt, chr(10) ORDER BY page, line)) AS h FROM s WHERE sec IS NOT NULL AND number IS NULL GROUP BY 1")
def r2(spark, sf):
    own = lines(spark, sf)
    return G.bodies(own, G.headings(own)).select("number", F.md5(C("text").cast("binary")).alias("h"))
