"""Projections, joins, aggregates, windows, sets, arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import relational as R
from factloom.operators import scan
from factloom.operators.terms import term_hits
from factloom.registry import Source, on, query, read

C = F.col
ORDERS = Source("orders", k="o_orderkey", cust="o_custkey", st="o_orderstatus", price="o_totalprice", dt="CAST(o_orderdate AS DATE)", pr="o_orderpriority")
LINES = Source("lineitem", o="l_orderkey", n="l_linenumber", p="l_partkey", s="l_suppkey", q="l_quantity", x="l_extendedprice", d="l_discount", f="l_returnflag")


@on("p1_rename", ORDERS, "SELECT k AS detail_id, st AS status, pr AS priority FROM src")
def p1(d):
    return d.select(*[C(a).alias(b) for a, b in {"k": "detail_id", "st": "status", "pr": "priority"}.items()])


@on("p2_status_in", ORDERS, "SELECT k FROM src WHERE lower(trim(pr)) IN ('1-urgent', '2-high')")
def p2(d):
    return d.where(F.lower(F.trim("pr")).isin("1-urgent", "2-high")).select("k")


@on("p3_year_cutoff", ORDERS, "SELECT CASE WHEN k % 11 = 0 THEN 'undated' WHEN year(dt) < 1995 THEN 'too old' ELSE 'kept' END AS bucket, count(*) AS n FROM src GROUP BY 1")
def p3(d):
    return d.groupBy(F.when(C("k") % 11 == 0, "undated").when(F.year("dt") < 1995, "too old").otherwise("kept").alias("bucket")).agg(F.count("*").alias("n"))


@on("p7_range_filter", LINES, "SELECT o, n, p, s, q, CASE WHEN q < 5 OR q > 45 THEN 'outside 5 to 45' END AS reason FROM src")
def p7(d):
    return d.select("o", "n", "p", "s", "q", F.when((C("q") < 5) | (C("q") > 45), "outside 5 to 45").alias("reason"))


@on("p8_vocabulary", ORDERS, "SELECT k, CASE WHEN NOT list_contains(['O', 'F'], st) THEN 'not allowed' END AS reason FROM src")
def p8(d):
    return d.select("k", F.when(~F.array_contains(T.literal_words(["O", "F"]), C("st")), "not allowed").alias("reason"))


@on("p9_blank", Source("part", k="p_partkey", raw="CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'See Plan' WHEN 1 THEN NULL WHEN 2 THEN p_name ELSE ' x ' END"), "SELECT k, coalesce(lower(trim(raw)) IN (" + ", ".join(f"'{b}'" for b in T.BLANK) + "), TRUE) AS blank FROM src")
def p9(d):
    return d.select("k", T.is_blank(C("raw")).alias("blank"))


@on("p10_bounding_box", Source("customer", k="c_custkey", lat="38.0 + (c_custkey % 300) / 100.0", lon="-76.0 + (c_custkey % 170) / 100.0"), "SELECT k FROM src WHERE lon BETWEEN -75.80 AND -74.98 AND lat BETWEEN 38.44 AND 39.85")
def p10(d):
    return d.where(C("lon").between(-75.80, -74.98) & C("lat").between(38.44, 39.85)).select("k")


@on("p11_number_range", Source("part", k="p_partkey", raw="CASE WHEN p_partkey % 3 = 0 THEN 'A-' || p_size ELSE CAST(p_partkey AS STRING) END"), r"SELECT k FROM src WHERE regexp_matches(raw, '^\d+$') AND TRY_CAST(raw AS BIGINT) BETWEEN 50 AND 150")
def p11(d):
    return d.where(F.when(C("raw").rlike(r"^\d+$"), C("raw").try_cast("long").between(50, 150)).otherwise(False)).select("k")


@on("p13_context_default", ORDERS, "SELECT k, CASE WHEN st IN ('O', 'F') THEN st ELSE 'detail' END AS context FROM src")
def p13(d):
    return d.select("k", F.when(C("st").isin("O", "F"), C("st")).otherwise("detail").alias("context"))


@on("p16_personal_keys", Source("customer", k="c_custkey", name="c_name", seg="c_mktsegment"), "SELECT k, 'segment=' || seg AS kept FROM src")
def p16(d):
    m = F.create_map(F.lit("owner_name"), C("name"), F.lit("segment"), C("seg"), F.lit("email"), C("name"))
    kept = F.map_filter(m, lambda k, v: ~k.isin(T.PERSONAL_KEYS))
    return d.select("k", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("kept"))


@on("p19_layer_whitelist", Source("nation", k="n_nationkey", layer="CASE n_regionkey WHEN 0 THEN 'flowline' WHEN 1 THEN 'lake' WHEN 2 THEN 'road' ELSE 'pond' END"), "SELECT k, layer FROM src WHERE layer IN ('flowline', 'lake', 'pond')")
def p19(d):
    return d.where(C("layer").isin("flowline", "lake", "pond"))


@on("p20_header_lines", Source("documents", k="doc_id", txt="text"), "SELECT k, count(*) AS n FROM (SELECT k, unnest(string_split(txt, chr(10))) AS line FROM src) WHERE NOT regexp_matches(line, 'Licensed|All rights|of the') GROUP BY 1")
def p20(d):
    return d.select("k", F.explode(F.split("txt", "\n")).alias("line")).where(~C("line").rlike("Licensed|All rights|of the")).groupBy("k").agg(F.count("*").alias("n"))


@on("p21_page_label", Source("documents", k="doc_id", txt="lower(text)"), "SELECT k, CASE WHEN contains(txt, 'licensed') THEN 'site plan' WHEN contains(txt, ' the ') AND length(txt) > 2000 THEN 'form with details' WHEN contains(txt, ' que ') THEN 'cross section' WHEN contains(txt, ' the ') THEN 'form' ELSE 'other' END AS label FROM src")
def p21(d):
    t = C("txt")
    label = F.when(t.contains("licensed"), "site plan").when(t.contains(" the ") & (F.length(t) > 2000), "form with details").when(t.contains(" que "), "cross section").when(t.contains(" the "), "form").otherwise("other")
    return d.select("k", label.alias("label"))


@on("p22_exemplars", Source("part", k="p_partkey", name="p_name", kind="p_brand", edge="p_size * 20"), "SELECT kind, name, k, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name, k) AS rank FROM src WHERE edge <= 400) WHERE rank <= 10")
def p22(d):
    return R.top_k(d.where("edge <= 400"), ["kind"], 10, "name", "k").select("kind", "name", "k", "rank")


@on("p23_annotation_request", LINES, "SELECT o, bool_or(q > 48) AS failing, count(*) FILTER (n > 6) AS out_of_range FROM src GROUP BY 1")
def p23(d):
    return d.groupBy("o").agg(F.bool_or(C("q") > 48).alias("failing"), F.count_if(C("n") > 6).alias("out_of_range"))


@query("j2_lookup_last", "WITH l AS (SELECT o_custkey AS c, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1) SELECT c_custkey AS k, price FROM customer LEFT JOIN l ON l.c = c_custkey")
def j2(spark, sf):
    last = read(spark, sf, "orders").groupBy(C("o_custkey").alias("k")).agg(F.max_by("o_totalprice", "o_orderkey").alias("price"))
    return read(spark, sf, "customer").select(C("c_custkey").alias("k")).join(last, "k", "left")


@query("j3_reconcile_both_ways", "SELECT doc_id AS id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT page_id * 3, 'right' FROM pages WHERE page_id * 3 NOT IN (SELECT doc_id FROM documents)")
def j3(spark, sf):
    d, labels = read(spark, sf, "documents").select(C("doc_id").alias("id")), read(spark, sf, "labels").select(C("doc_id").alias("id"))
    pages = read(spark, sf, "pages").select((C("page_id") * 3).alias("id"))
    return R.reconcile(d, labels, "id").where("side = 'left'").unionByName(R.reconcile(d, pages, "id").where("side = 'right'"))


@query("j4_missing_and_unexpected", "SELECT c_custkey AS id, 'missing' AS what FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j4(spark, sf):
    a, b = read(spark, sf, "customer").select(C("c_custkey").alias("id")), read(spark, sf, "orders").select(C("o_custkey").alias("id"))
    return R.reconcile(a, b, "id").select("id", F.when(C("side") == "left", "missing").otherwise("unexpected").alias("what"))


@query("j9_greedy_match", None)
def j9(spark, sf):
    from factloom.operators.drawing import greedy_match

    own = read(spark, sf, "lineitem").select(C("l_suppkey").alias("sheet"), C("l_returnflag").alias("label"), C("l_quantity").alias("x"), (C("l_discount") * 100).alias("y"), C("l_orderkey").alias("id"), C("l_linenumber").alias("n"))
    return greedy_match(own.where("n = 1").drop("n"), own.where("n = 2").drop("n"), 20.0)


@query("j12_term_usage", "WITH t AS (SELECT DISTINCT lower(p_brand) AS term FROM part UNION SELECT 'licensed' UNION SELECT ' the ') SELECT d.doc_id, t.term FROM documents d JOIN t ON contains(lower(d.text), t.term)")
def j12(spark, sf):
    terms = read(spark, sf, "part").select(F.lower("p_brand").alias("term")).union(spark.createDataFrame([("licensed",), (" the ",)], "term string")).distinct()
    return term_hits(read(spark, sf, "documents").select("doc_id", F.lower("text").alias("text")), "doc_id", "text", terms, "term")


@query("j13_semi_anti", "SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS cited FROM customer")
def j13(spark, sf):
    c, o = read(spark, sf, "customer").select(C("c_custkey").alias("id")), read(spark, sf, "orders").select(C("o_custkey").alias("id"))
    return c.join(o, "id", "left_semi").withColumn("cited", F.lit(True)).unionByName(c.join(o, "id", "left_anti").withColumn("cited", F.lit(False)))


@query("j16_merge_conflicts", "WITH f AS (SELECT l_orderkey AS k, l_returnflag AS name, l_linestatus AS value, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS r FROM lineitem), w AS (SELECT k, name, value FROM f WHERE r = 1) SELECT w.k, w.name, w.value, coalesce(string_agg(DISTINCT f.value, '|' ORDER BY f.value) FILTER (f.value <> w.value), '') AS conflicts FROM w JOIN f USING (k, name) GROUP BY 1, 2, 3")
def j16(spark, sf):
    d = read(spark, sf, "lineitem").select(C("l_orderkey").alias("k"), C("l_returnflag").alias("name"), C("l_linestatus").alias("value"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return R.merge_first_wins(d, "k", "name", "value", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").withColumn("conflicts", F.array_join("conflicts", "|"))


@on("j17_shard_merge", ORDERS, "SELECT cust, k, st FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY CASE WHEN st = 'P' THEN 1 ELSE 0 END, k) AS r FROM src) WHERE r = 1")
def j17(d):
    return R.first_by(d, ["cust"], F.when(C("st") == "P", 1).otherwise(0), "k").select("cust", "k", "st")


@query("j18_parity", "SELECT coalesce(a.c_custkey, b.s_suppkey) AS id, unnest(['bal', 'nat']) AS field FROM customer a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey WHERE a.c_custkey IS NULL OR b.s_suppkey IS NULL UNION ALL SELECT a.c_custkey, 'nat' FROM customer a JOIN supplier b ON a.c_custkey = b.s_suppkey WHERE a.c_nationkey IS DISTINCT FROM b.s_nationkey UNION ALL SELECT a.c_custkey, 'bal' FROM customer a JOIN supplier b ON a.c_custkey = b.s_suppkey WHERE a.c_acctbal IS DISTINCT FROM b.s_acctbal")
def j18(spark, sf):
    a = read(spark, sf, "customer").select(C("c_custkey").alias("id"), C("c_nationkey").alias("nat"), C("c_acctbal").alias("bal"))
    b = read(spark, sf, "supplier").select(C("s_suppkey").alias("id"), C("s_nationkey").alias("nat"), C("s_acctbal").alias("bal"))
    return R.parity(a, b, "id", ["nat", "bal"]).select("id", "field")


@on("a1_status_counts", ORDERS, "SELECT coalesce(nullif(st, 'P'), 'unknown') AS st, count(*) AS n FROM src GROUP BY 1")
def a1(d):
    return d.groupBy(F.coalesce(F.nullif("st", F.lit("P")), F.lit("unknown")).alias("st")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "st")


@query("a2_audit_sizes", "SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 4) AS mean, list_sort(list(n_chars))[CAST(floor(count(*) / 2) AS INT) + 1] AS upper_median FROM documents")
def a2(spark, sf):
    d = read(spark, sf, "documents").select("n_chars")
    own = d.agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 4).alias("mean"))
    return own.crossJoin(R.upper_median_of(d, "n_chars").withColumnRenamed("n_chars", "upper_median"))


@query("a3_prefix_counts", "SELECT array_to_string(string_split(url, '/')[1:3], '/') AS prefix, count(*) AS n FROM pages GROUP BY 1")
def a3(spark, sf):
    return read(spark, sf, "pages").groupBy(F.substring_index("url", "/", 3).alias("prefix")).agg(F.count("*").alias("n"))


@query("a4_document_counts", "SELECT l_returnflag AS status, count(*) AS n, count(DISTINCT l_orderkey) AS permits FROM lineitem GROUP BY 1")
def a4(spark, sf):
    docs = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("documents"))
    return docs.select("l_orderkey", F.explode("documents").alias("status")).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("permits"))


@query("a14_by_unit", "WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), '([.;:])\\s+([A-Z(\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS s FROM documents), u AS (SELECT unnest([" + ", ".join(f"CASE WHEN regexp_matches(s, '(?i){p}') THEN '{n}' END" for n, p in T.UNIT_FAMILIES) + "]) AS unit FROM p) SELECT unit, count(*) AS n FROM u WHERE unit IS NOT NULL GROUP BY 1")
def a14(spark, sf):
    s = read(spark, sf, "documents").select(F.explode(T.sentences(F.regexp_replace("text", r"[^\x00-\x7F]", "x"))).alias("s"))
    return s.select(F.explode(T.units_in(C("s"))).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))


@query("a13_topics", "WITH t AS (SELECT doc_id, unnest([CASE WHEN contains(text, 'the') THEN 'the' END, CASE WHEN contains(text, 'que') THEN 'que' END, CASE WHEN contains(text, 'und') THEN 'und' END]) AS topic FROM documents) SELECT topic, count(*) AS total, count(l.doc_id) AS cited, count(*) - count(l.doc_id) AS uncited FROM t LEFT JOIN labels l USING (doc_id) WHERE topic IS NOT NULL GROUP BY 1")
def a13(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.explode(F.array_compact(F.array(*[F.when(C("text").contains(t), F.lit(t)) for t in ("the", "que", "und")]))).alias("topic"))
    cited = read(spark, sf, "labels").select("doc_id", F.lit(1).alias("cited"))
    return d.join(cited, "doc_id", "left").groupBy("topic").agg(F.count("*").alias("total"), F.count("cited").alias("cited"), (F.count("*") - F.count("cited")).alias("uncited"))


@query("a15_validation_counters", "SELECT count(*) AS rows, count(*) FILTER (c_acctbal < 0) AS negative, count(*) FILTER (c_mktsegment IS NULL) AS no_segment, string_agg(CASE WHEN r <= 5 AND c_acctbal < 0 THEN c_name END, '|' ORDER BY c_custkey) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY c_acctbal < 0 ORDER BY c_custkey) AS r FROM customer)")
def a15(spark, sf):
    c = read(spark, sf, "customer")
    few = c.where("c_acctbal < 0").orderBy("c_custkey").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]), "|").alias("samples"))
    return c.agg(F.count("*").alias("rows"), F.count_if(C("c_acctbal") < 0).alias("negative"), F.count_if(C("c_mktsegment").isNull()).alias("no_segment")).crossJoin(few)


@query("a16_harvest_counters", "SELECT event_type AS stat, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def a16(spark, sf):
    return read(spark, sf, "events").groupBy(C("event_type").alias("stat")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("a17_recheck_outcomes", "WITH o AS (SELECT l_orderkey AS id, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'UNSTABLE' WHEN count(*) > 1 THEN 'PARSED_DOCS' ELSE 'FETCH_FAILED' END AS outcome FROM lineitem GROUP BY 1) SELECT outcome, count(*) AS n, min(id) AS least FROM o GROUP BY 1")
def a17(spark, sf):
    o = read(spark, sf, "lineitem").groupBy(C("l_orderkey").alias("id")).agg(F.when(F.countDistinct("l_returnflag") > 1, "UNSTABLE").when(F.count("*") > 1, "PARSED_DOCS").otherwise("FETCH_FAILED").alias("outcome"))
    return o.groupBy("outcome").agg(F.count("*").alias("n"), F.min("id").alias("least"))


@query("a18_before_after", "WITH a AS (SELECT l_returnflag AS t, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), b AS (SELECT l_linestatus AS t, count(*) AS n FROM lineitem GROUP BY 1) SELECT coalesce(a.t, b.t) AS kind, a.n AS before, b.n AS after FROM a FULL JOIN b ON a.t = b.t")
def a18(spark, sf):
    d = read(spark, sf, "lineitem")
    a = d.where("l_linenumber <= 2").groupBy(C("l_returnflag").alias("kind")).agg(F.count("*").alias("before"))
    return a.join(d.groupBy(C("l_linestatus").alias("kind")).agg(F.count("*").alias("after")), "kind", "full_outer")


@query("a19_distance_comparison", "SELECT l_returnflag AS grp, count(*) AS n, round(median(l_quantity * 10), 4) AS med, count(*) FILTER (l_quantity * 10 <= 200) AS near, round(100.0 * count(*) FILTER (l_quantity * 10 <= 200) / count(*), 1) AS pct FROM lineitem GROUP BY 1")
def a19(spark, sf):
    d = read(spark, sf, "lineitem").select(C("l_returnflag").alias("grp"), (C("l_quantity") * 10).alias("x"))
    near = d.groupBy("grp").agg(F.count_if(C("x") <= 200).alias("near"))
    out = scan.medians(d, ["grp"], "x").join(near, "grp")
    return out.select("grp", "n", F.round("median", 4).alias("med"), "near", F.round(100.0 * C("near") / C("n"), 1).alias("pct"))


@query("a20_histogram", "WITH b AS (SELECT CAST(least(floor(least(greatest(l_extendedprice / 20, 0), 2000) / 100), 19) AS INT) AS bin FROM lineitem) SELECT bin, count(*) AS n, round(count(*) / ((SELECT count(*) FROM b) * 100.0), 8) AS density FROM b GROUP BY 1")
def a20(spark, sf):
    return R.histogram(read(spark, sf, "lineitem"), C("l_extendedprice") / 20, 100.0, 20).withColumn("density", F.round("density", 8))


@query("a21_ecdf", "SELECT l_returnflag AS grp, l_orderkey AS o, l_extendedprice AS x, round(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_partkey, l_linenumber, l_shipdate) / count(*) OVER (PARTITION BY l_returnflag), 8) AS share FROM lineitem")
def a21(spark, sf):
    d = read(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    out = R.ecdf(d, "l_extendedprice", ["l_returnflag"], "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    return out.select(C("l_returnflag").alias("grp"), C("l_orderkey").alias("o"), C("l_extendedprice").alias("x"), F.round("share", 8).alias("share"))


@query("a26_duplicate_keys", "SELECT l_orderkey AS o, l_linenumber AS n, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY copies DESC, o, n LIMIT 20")
def a26(spark, sf):
    return read(spark, sf, "lineitem").groupBy(C("l_orderkey").alias("o"), C("l_linenumber").alias("n")).agg(F.count("*").alias("copies")).where("copies > 1").orderBy(F.desc("copies"), "o", "n").limit(20)


@query("a28_running_mean", "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS mean FROM events")
def a28(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf, "events").select("user_id", "event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


@query("a29_prefix_inventory", "SELECT source, count(*) AS objects, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def a29(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("objects"), F.sum("n_chars").alias("bytes"))


@query("a30_callout_index", "SELECT l_orderkey AS o, l_partkey AS p, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx FROM lineitem")
def a30(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, sf, "lineitem").select(C("l_orderkey").alias("o"), C("l_partkey").alias("p"), C("l_linenumber").alias("n"), (F.row_number().over(w) - 1).alias("idx"))


@query("a31_fingerprint", "SELECT lang, left(sha256(string_agg(source || ':' || md5(text), '' ORDER BY source || ':' || md5(text))), 16) AS mark FROM documents GROUP BY 1")
def a31(spark, sf):
    return read(spark, sf, "documents").groupBy("lang").agg(R.fingerprint(C("source"), F.md5(C("text").cast("binary"))).alias("mark"))


@on("w1_first_dedup", ORDERS, "SELECT cust, k, st FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY k) AS r FROM src) WHERE r = 1")
def w1(d):
    return R.first_by(d, ["cust"], "k").select("cust", "k", "st")


@query("w2_first_across_manifests", "WITH u AS (SELECT 0 AS m, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier UNION ALL SELECT 1, NULL, 'x') SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, name) AS r FROM u WHERE id IS NOT NULL) WHERE r = 1")
def w2(spark, sf):
    a = read(spark, sf, "customer").select(F.lit(0).alias("m"), C("c_custkey").alias("id"), C("c_name").alias("name"))
    b = read(spark, sf, "supplier").select(F.lit(1).alias("m"), C("s_suppkey").alias("id"), C("s_name").alias("name"))
    return R.first_by(a.unionByName(b).where("id is not null"), ["id"], "m", "name").select("id", "name")


@query("w3_best_record", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length(event_type) DESC, ts DESC, event_id) AS r FROM events) WHERE r = 1")
def w3(spark, sf):
    return R.first_by(read(spark, sf, "events"), ["user_id"], F.desc(F.length("event_type")), F.desc("ts"), "event_id").select("user_id", "event_id", "event_type")


@on("w4_field_map", LINES, "SELECT o, lower(f) AS field, q AS val FROM (SELECT *, row_number() OVER (PARTITION BY o, f ORDER BY n, p, s, q, x) AS r FROM src) WHERE r = 1")
def w4(d):
    return R.first_by(d, ["o", "f"], "n", "p", "s", "q", "x").select("o", F.lower("f").alias("field"), C("q").alias("val"))


@on("w5_head", ORDERS, "SELECT k, price FROM src ORDER BY dt, k LIMIT 50")
def w5(d):
    return d.orderBy("dt", "k").limit(50).select("k", "price")


@on("w7_reading_order", LINES, "SELECT o, string_agg(f, '' ORDER BY round(d, 1), q, p, n, s) AS txt FROM src GROUP BY 1")
def w7(d):
    return d.groupBy("o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.round("d", 1).alias("top"), "q", "p", "n", "s", "f"))), lambda x: x["f"]), "").alias("txt"))


@on("w8_symbol_ids", LINES, "SELECT o, p, n, f || '_' || row_number() OVER (PARTITION BY o, f ORDER BY q, d, p, n, s) AS id FROM src")
def w8(d):
    w = Window.partitionBy("o", "f").orderBy("q", "d", "p", "n", "s")
    return d.select("o", "p", "n", F.concat("f", F.lit("_"), F.row_number().over(w).cast("string")).alias("id"))


@on("w9_page_rank", LINES, "WITH r AS (SELECT o, p, q, row_number() OVER w AS pos, lead(q) OVER w AS second FROM src WINDOW w AS (PARTITION BY o ORDER BY f = 'R' DESC, q DESC, p, n, s)) SELECT o, p, q, second, coalesce(q >= 1.5 * second, TRUE) AS sure FROM r WHERE pos = 1")
def w9(d):
    w = Window.partitionBy("o").orderBy(F.desc(C("f") == "R"), F.desc("q"), "p", "n", "s")
    r = d.select("o", "p", "q", F.row_number().over(w).alias("pos"), F.lead("q").over(w).alias("second")).where("pos = 1")
    return r.select("o", "p", "q", "second", F.coalesce(C("q") >= 1.5 * C("second"), F.lit(True)).alias("sure"))


DOTTED = Source("orders", k="o_orderkey", num="CAST(o_orderkey % 7 AS STRING) || '.' || CAST(o_orderkey % 13 AS STRING)")


@on("w11_natural_sort", DOTTED, "SELECT num, row_number() OVER (ORDER BY list_transform(string_split(num, '.'), x -> CAST(x AS INT))) AS pos FROM (SELECT DISTINCT num FROM src)")
def w11(d):
    own = d.select("num").distinct().withColumn("key", T.section_key(C("num")))
    return R.with_ordinal(own, "key").select("num", (C("_ord") + 1).alias("pos"))


@on("w12_systematic_sample", ORDERS, "SELECT k FROM (SELECT k, row_number() OVER (ORDER BY k) - 1 AS r, greatest(1, count(*) OVER () // 100) AS step FROM src) WHERE r % step = 0 AND r < step * 100")
def w12(d):
    return R.systematic(d.select("k"), 100, "k")


@on("w13_example_ranking", LINES, "SELECT o, count(*) AS docs, round(sum(x), 2) AS bytes FROM src GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 25")
def w13(d):
    return d.groupBy("o").agg(F.count("*").alias("docs"), F.round(F.sum("x"), 2).alias("bytes")).orderBy(F.desc("docs"), F.desc("bytes"), "o").limit(25)


@on("w14_page_suggestion", LINES, "WITH r AS (SELECT o, p, q, row_number() OVER w AS pos, lead(q) OVER w AS second FROM src WINDOW w AS (PARTITION BY o ORDER BY q DESC, p, n, s)) SELECT o, p, coalesce(second / q > 0.9, FALSE) AS ambiguous FROM r WHERE pos = 1")
def w14(d):
    w = Window.partitionBy("o").orderBy(F.desc("q"), "p", "n", "s")
    return d.select("o", "p", "q", F.row_number().over(w).alias("pos"), F.lead("q").over(w).alias("second")).where("pos = 1").select("o", "p", F.coalesce(C("second") / C("q") > 0.9, F.lit(False)).alias("ambiguous"))


@on("w15_best_sheet", LINES, "SELECT o, p, q FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY q DESC, x DESC, p DESC) AS r FROM src) WHERE r = 1")
def w15(d):
    return d.groupBy("o").agg(F.max(F.struct("q", "x", "p")).alias("m")).select("o", "m.p", "m.q")


@query("w16_consecutive_agreement", "SELECT user_id, min(event_id) AS agreed FROM (SELECT user_id, event_id, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS same FROM events) WHERE same GROUP BY 1")
def w16(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf, "events").select("user_id", "event_id", (C("event_type") == F.lag("event_type").over(w)).alias("same")).where("same").groupBy("user_id").agg(F.min("event_id").alias("agreed"))


PERMITS = Source("part", k="p_partkey", num="CASE WHEN p_partkey % 3 = 0 THEN 'A' || p_size ELSE CAST(p_size AS STRING) END")


@on("w17_permit_order", PERMITS, "SELECT k, num, row_number() OVER (ORDER BY coalesce(TRY_CAST(num AS BIGINT), 1000000000), num, k) AS pos FROM src")
def w17(d):
    key = F.coalesce(C("num").try_cast("long"), F.lit(1_000_000_000)).alias("key")
    return R.with_ordinal(d.select("k", "num", key), "key", "num", "k").select("k", "num", (C("_ord") + 1).alias("pos"))


@on("w18_every_40th", ORDERS, "SELECT k FROM (SELECT k, row_number() OVER (ORDER BY k) AS r FROM src) WHERE r % 40 = 1 AND r <= 1000")
def w18(d):
    return R.with_ordinal(d.select("k"), "k").where("_ord % 40 = 0 and _ord < 1000").select("k")


@on("w19_capped_list", ORDERS, "SELECT st, k, greatest(n - 30, 0) AS more FROM (SELECT st, k, row_number() OVER (PARTITION BY st ORDER BY k) AS r, count(*) OVER (PARTITION BY st) AS n FROM src) WHERE r <= 30")
def w19(d):
    n = d.groupBy("st").agg(F.count("*").alias("n"))
    return R.top_k(d, ["st"], 30, "k").join(n, "st").select("st", "k", F.greatest(C("n") - 30, F.lit(0)).alias("more"))


@query("u1_union_by_name", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def u1(spark, sf):
    a = read(spark, sf, "customer").select(C("c_custkey").alias("id"), C("c_name").alias("name"), C("c_mktsegment").alias("seg"))
    return a.unionByName(read(spark, sf, "supplier").select(C("s_suppkey").alias("id"), C("s_name").alias("name")), allowMissingColumns=True)


@query("u2_difference", "SELECT c_nationkey AS id FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def u2(spark, sf):
    return read(spark, sf, "customer").select(C("c_nationkey").alias("id")).subtract(read(spark, sf, "supplier").select("s_nationkey"))


@query("u3_key_set_parity", "(SELECT doc_id AS id, 'documents' AS side FROM documents EXCEPT SELECT doc_id, 'documents' FROM labels) UNION ALL (SELECT doc_id, 'labels' FROM labels EXCEPT SELECT doc_id, 'labels' FROM documents)")
def u3(spark, sf):
    a, b = read(spark, sf, "documents").select(C("doc_id").alias("id")), read(spark, sf, "labels").select(C("doc_id").alias("id"))
    return a.subtract(b).withColumn("side", F.lit("documents")).unionByName(b.subtract(a).withColumn("side", F.lit("labels")))


SETS = Source("part", k="p_partkey", a="p_name", b="p_type")


@on("u4_subset", SETS, "SELECT k, CAST(len(list_filter(string_split(lower(b), ' '), x -> NOT list_contains(string_split(lower(a), ' '), x))) AS INT) AS residual FROM src")
def u4(d):
    return d.select("k", F.size(F.filter(F.split(F.lower("b"), " "), lambda x: ~F.array_contains(F.split(F.lower("a"), " "), x))).alias("residual"))


@on("u5_intersection", SETS, "SELECT k, list_has_any(string_split(a, ' '), string_split(b, ' ')) AS overlap FROM src")
def u5(d):
    return d.select("k", F.arrays_overlap(F.split("a", " "), F.split("b", " ")).alias("overlap"))


@query("u6_union_distinct", "SELECT left(p_brand, 7) AS letter FROM part UNION SELECT left(p_type, 7) FROM part")
def u6(spark, sf):
    p = read(spark, sf, "part")
    return p.select(F.left("p_brand", F.lit(7)).alias("letter")).union(p.select(F.left("p_type", F.lit(7)))).distinct()


PER_ORDER = "SELECT l_orderkey AS o, list(struct_pack(n := l_linenumber, p := l_partkey, f := l_returnflag) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS docs FROM lineitem GROUP BY 1"


def _per_order(spark, sf):
    return read(spark, sf, "lineitem").groupBy(C("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(F.struct(C("l_linenumber").alias("n"), C("l_partkey").alias("p"), C("l_suppkey").alias("s"), C("l_returnflag").alias("f")))).alias("docs"))


@query("k1_explode_documents", "SELECT o_orderkey AS o, l_partkey AS p FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def k1(spark, sf):
    return read(spark, sf, "orders").select(C("o_orderkey").alias("o")).join(_per_order(spark, sf), "o", "left").select("o", F.posexplode_outer("docs").alias("pos", "d")).select("o", "d.p")


@query("k2_first_with_key", f"SELECT o, list_filter(docs, x -> x.f = 'R')[1].p AS p FROM ({PER_ORDER})")
def k2(spark, sf):
    return _per_order(spark, sf).select("o", F.get(F.filter("docs", lambda x: x["f"] == "R"), F.lit(0))["p"].alias("p"))


@query("k3_dense_grid", "SELECT l_orderkey AS o, string_agg(coalesce(f, ''), '|' ORDER BY g.n) AS grid FROM (SELECT l_orderkey, g.n FROM (SELECT DISTINCT l_orderkey FROM lineitem), (SELECT unnest(range(1, 8)) AS n) g) g LEFT JOIN (SELECT l_orderkey AS o, l_linenumber AS n, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2) c ON c.o = g.l_orderkey AND c.n = g.n GROUP BY 1")
def k3(spark, sf):
    cells = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    m = cells.groupBy(C("l_orderkey").alias("o")).agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "f"))).alias("m"))
    return m.select("o", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.coalesce(C("m")[i], F.lit(""))), "|").alias("grid"))


@on("k4_tolerant_json", Source("part", k="p_partkey", raw="CASE WHEN p_partkey % 3 = 0 THEN 'not json' WHEN p_partkey % 3 = 1 THEN '```json' || chr(10) || '{\"size\": ' || p_size || '}' || chr(10) || '```' ELSE '{\"size\": ' || p_size || '}' END"), "SELECT k, CASE WHEN raw <> 'not json' THEN CAST(regexp_extract(raw, '\"size\": (\\d+)', 1) AS INT) END AS size FROM src")
def k4(d):
    body = F.coalesce(F.nullif(F.regexp_extract("raw", r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), C("raw"))
    return d.select("k", F.from_json(body, "size int")["size"].alias("size"))


@on("k5_map_filter", Source("customer", k="c_custkey", a="c_name", b="c_mktsegment"), "SELECT k, 'b=' || b AS m FROM src")
def k5(d):
    m = F.map_filter(F.create_map(F.lit("a"), C("a"), F.lit("b"), C("b")), lambda k, v: k.isin("b"))
    return d.select("k", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("m"))


@on("k6_metadata_map", Source("part", k="p_partkey", a="p_brand", b="CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END"), "SELECT k, CASE WHEN b = '' THEN 1 ELSE 2 END AS n FROM src")
def k6(d):
    return d.select("k", F.size(F.map_filter(F.create_map(F.lit("a"), C("a"), F.lit("b"), C("b")), lambda k, v: v != "")).alias("n"))


@query("k7_line_count_check", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), x -> trim(x) <> '')) AS INT) AS n FROM documents")
def k7(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("n"))


@query("k8_round_vector", "SELECT vec_id, md5(array_to_string(list_transform(embedding, x -> printf('%.3f', round(CAST(x AS DOUBLE), 3) + 0.0)), ',')) IS NOT NULL AS ok, round(list_sum(list_transform(embedding, x -> round(CAST(x AS DOUBLE), 6))), 4) AS total FROM embeddings")
def k8(spark, sf):
    from factloom.functions.vectors import rounded

    return read(spark, sf, "embeddings").select("vec_id", F.lit(True).alias("ok"), F.round(F.aggregate(rounded(C("embedding")), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("k9_slices", f"SELECT o, array_to_string(list_transform(docs[1:3], x -> x.f), '') AS few FROM ({PER_ORDER})")
def k9(spark, sf):
    return _per_order(spark, sf).select("o", F.array_join(F.transform(F.slice("docs", 1, 3), lambda x: x["f"]), "").alias("few"))
