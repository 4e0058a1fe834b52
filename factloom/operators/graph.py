"""A graph of sections, exhibits, terms and rules in two tables: nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.terms import term_hits
from factloom.sources.files import checkpoint_dir

#: Later kinds replace earlier ones between the same two nodes.
PRECEDENCE = ["CONTAINS", "REFERENCES", "DEFINES", "USES_TERM", "EXCEPTION", "CITES"]


def one_edge(edges: DataFrame) -> DataFrame:
    """One edge between two nodes: the kind that was added last."""
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(PRECEDENCE) for x in (F.lit(k), F.lit(i))]), F.col("type"))
    return edges.groupBy("src", "dst").agg(F.max_by("type", rank).alias("type"))


def headings(lines: DataFrame) -> DataFrame:
    """Heading lines from ``page, line, txt``: a dotted number and a title that isn't a sentence or a table row.

    A number seen more than three times is a list, and the first occurrence of a number counts.
    A heading below the first level needs its parent among the accepted ones, which is decided level by level.
    """
    number, title = F.regexp_extract("txt", r"^(\d{1,2}(?:\.\d{1,3}){0,6})\s+(.+)", 1), F.trim(F.regexp_extract("txt", r"^(\d{1,2}(?:\.\d{1,3}){0,6})\s+(.+)", 2))
    own = lines.withColumns({"number": number, "title": title}).where("number <> '' and title rlike '^[A-Z]' and length(title) <= 120")
    w = Window.partitionBy("number")
    own = own.withColumns({"seen": F.count("*").over(w), "nth": F.row_number().over(w.orderBy("page", "line"))}).where("seen <= 3 and nth = 1").drop("seen", "nth")
    accepted = own.where(~F.col("number").contains("."))
    done = accepted
    for depth in range(2, 8):
        level = own.where(T.section_depth(F.col("number")) == depth).withColumn("parent", T.section_parent(F.col("number")))
        accepted = level.join(accepted.select(F.col("number").alias("parent")), "parent", "left_semi").select(*own.columns)
        done = done.unionByName(accepted)
    return done


def bodies(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Text between headings of a page; lines before a page's first heading belong to none; repeated numbers append."""
    w = Window.partitionBy("page").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.join(heads.select("page", "line", "number"), ["page", "line"], "left")
    own = marked.withColumn("section", F.last("number", ignorenulls=True).over(w)).where("section is not null and number is null")
    return own.groupBy(F.col("section").alias("number")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "txt"))), lambda x: x["txt"]), "\n").alias("text"))


def text_of(chars: int | None) -> Column:
    """The text, or its first ``chars`` characters where a caller's SQL looks at no more."""
    body = F.coalesce("text", F.lit(""))
    return body if chars is None else F.left(body, F.lit(chars))


def build_edges(nodes: DataFrame, rules: DataFrame, chars: int | None = None) -> DataFrame:
    """All edges of ``id, type, number, title, text`` and ``rule_id, section``, one for each pair, from all of a text or its first ``chars`` characters.

    Sections whose number begins with 2 are the definitions and use no terms. An exception without a cross-reference
    to a known section is one to the parent.
    """
    sections = nodes.where("type = 'Section'").select("id", "number", "title", text_of(chars).alias("text"))
    contains = sections.where(F.col("number").contains(".")).select(F.concat(F.lit("section:"), T.section_parent(F.col("number"))).alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"))
    refs = sections.select(F.col("id").alias("src"), F.explode(T.section_refs(F.col("text"))).alias("r"), "text").select("src", F.concat(F.lit("section:"), F.col("r")).alias("dst"), F.lit("REFERENCES").alias("type"), "text")
    exhibits = sections.select(F.col("id").alias("src"), F.explode(T.exhibit_refs(F.col("text"))).alias("r")).select("src", F.concat(F.lit("exhibit:"), F.col("r")).alias("dst"), F.lit("REFERENCES").alias("type"))
    exception = F.col("text").rlike("(?i)" + T.EXCEPTION)
    excepted = refs.where(exception).select("src", "dst", F.lit("EXCEPTION").alias("type"))
    linked = excepted.where("src <> dst").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src")
    to_parent = sections.where(exception & F.col("number").contains(".")).select(F.col("id").alias("src"), F.concat(F.lit("section:"), T.section_parent(F.col("number"))).alias("dst"), F.lit("EXCEPTION").alias("type")).join(linked, "src", "left_anti").select("src", "dst", "type")
    defined = sections.select(F.col("id").alias("src"), F.explode(T.definitions(F.col("text"))).alias("term"), "text")
    term_id = F.concat(F.lit("term:"), F.lower(F.regexp_replace("term", r"\s+", "_")))
    defines = defined.select("src", term_id.alias("dst"), F.lit("DEFINES").alias("type"))
    uses = term_uses(sections.where(~F.startswith("number", F.lit("2"))), defined.select(term_id.alias("dst"), F.lower(F.trim("term")).alias("term")))
    cites = rules.select(F.concat(F.lit("rule:"), F.col("rule_id")).alias("src"), T.citation_node(F.col("section")).alias("dst"), F.lit("CITES").alias("type")).where("dst is not null")
    every = contains.unionByName(refs.select("src", "dst", "type")).unionByName(exhibits).unionByName(excepted).unionByName(to_parent).unionByName(defines).unionByName(uses).unionByName(cites)
    known = nodes.select(F.col("id").alias("dst")).unionByName(defines.select("dst")).distinct()
    return one_edge(every.where("src <> dst").join(known, "dst", "left_semi").select("src", "dst", "type"))


def term_uses(sections: DataFrame, terms: DataFrame) -> DataFrame:
    """USES_TERM edges: titles and texts that contain a term of ``dst, term``, whatever the case."""
    terms = terms.where("length(term) >= 3").distinct()
    full = sections.select(F.col("id").alias("src"), F.lower(F.concat_ws(" ", "title", "text")).alias("full"))
    return term_hits(full, "src", "full", terms, "term").join(terms, "term").select("src", "dst", F.lit("USES_TERM").alias("type"))


def citations(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """The CITES edges alone: no later kind replaces one, so the others needn't be built to know them."""
    cites = rules.select(F.concat(F.lit("rule:"), F.col("rule_id")).alias("src"), T.citation_node(F.col("section")).alias("dst"), F.lit("CITES").alias("type")).where("dst is not null")
    return cites.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "type").distinct()


def containment(nodes: DataFrame) -> DataFrame:
    """The CONTAINS edges alone: of the later kinds, only a cross-reference can go from a section to one right below it and replace one."""
    sections = nodes.where("type = 'Section'").select("id", "number", F.left(F.coalesce("text", F.lit("")), F.lit(2000)).alias("text"))
    contains = sections.where(F.col("number").contains(".")).select(F.concat(F.lit("section:"), T.section_parent(F.col("number"))).alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"))
    refs = sections.select(F.col("id").alias("src"), F.explode(T.section_refs(F.col("text"))).alias("r")).select("src", F.concat(F.lit("section:"), F.col("r")).alias("dst"))
    return contains.join(refs, ["src", "dst"], "left_anti").select("src", "dst", "type").distinct()


def ancestors(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """``node, ancestor, distance`` along CONTAINS edges, up to the root, or to ``depth`` levels where the caller gives one.

    A section's number holds the numbers of all above it, so it meets the edges into each of them in one join; what is kept is the unbroken run from the section up.
    """
    up = _cut(edges.where("type = 'CONTAINS'").select("src", "dst"))  # read twice
    parts = F.split("dst", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda d: F.struct(d.alias("nth"), F.array_join(F.slice(parts, 1, F.size(parts) - d + 1), ".").alias("at")))
    steps = up.select(F.col("dst").alias("node"), F.explode(prefixes).alias("p")).select("node", "p.*")
    met = steps.join(up.select(F.col("dst").alias("at"), F.col("src").alias("ancestor")), "at")
    run = F.row_number().over(Window.partitionBy("node").orderBy("nth"))  # at most seven rows
    out = met.withColumn("distance", run).where("distance = nth").select("node", "ancestor", "distance")
    return out if depth is None else out.where(F.col("distance") <= depth)


def reach(starts: DataFrame, edges: DataFrame, kinds: list[str], rounds: int | None = None) -> DataFrame:
    """``start, node, hops, reached_via, discoveries``: all nodes that can be reached, each once, by the fewest hops.

    With ``rounds``, all nodes within so many hops; without, the walk ends when no node is new. Cycles end at nodes already seen.
    Nodes are taken by hops, then by id: a node's discoveries are its edges from nodes taken before it,
    and the first of them gives ``reached_via``.
    """
    along = _cut(edges.where(F.col("type").isin(kinds)).select(F.col("src").alias("node"), F.col("dst").alias("next"), "type"))
    seen = front = _cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct())
    k = 0
    while rounds is None or k < rounds:
        k += 1
        front = _cut(front.join(along, "node").select("start", F.col("next").alias("node")).distinct().join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(k)))
        if not front.take(1):
            break
        seen = seen.unionByName(front)
        if k % 16 == 0:  # so that a long walk isn't a union of as many tables
            seen = _cut(seen.repartition("start", "node"))
    taken = seen if rounds is None else seen.where(F.col("hops") < rounds)
    found = taken.withColumnsRenamed({"hops": "k"}).join(along, "node").select("start", F.struct("k", "node").alias("by"), F.col("next").alias("node"), "type").join(seen, ["start", "node"])
    found = found.where((F.col("hops") > 0) & (F.col("by") < F.struct(F.col("hops").alias("k"), "node")))
    return found.groupBy("start", "node", "hops").agg(F.min_by("type", "by").alias("reached_via"), F.count("*").alias("discoveries"))


def _cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and without the plan behind them, which would double with each round; below ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def terms_of(nodes: DataFrame, chars: int | None = 2000) -> DataFrame:
    """``id, term, defined_in, first`` of each defined term: the last definition in a section that begins with 2, or else the first one anywhere; ``first`` sorts terms by their first definition."""
    own = nodes.where("type = 'Section'").select("number", F.posexplode(T.definitions(text_of(chars))).alias("at", "term"))
    own = own.select(F.concat(F.lit("term:"), F.lower(F.regexp_replace("term", r"\s+", "_"))).alias("id"), F.trim("term").alias("term"), "number", F.struct((~F.startswith("number", F.lit("2"))).alias("other"), T.section_key(F.col("number")).alias("key"), "at").alias("k"))
    told = F.struct("term", F.col("number").alias("defined_in"))
    got = own.groupBy("id").agg(F.min("k").alias("first"), F.min_by(told, "k").alias("a"), F.max_by(told, F.when(~F.col("k.other"), F.col("k"))).alias("b"))
    return got.select("id", F.coalesce("b", "a").alias("t"), "first").select("id", "t.*", "first")


def context(nodes: DataFrame, edges: DataFrame, of: DataFrame | None = None, chars: int | None = 2000) -> DataFrame:
    """Per section, or only for the ids of ``of``: ``id, number, title, text, ancestors, references, definitions, exceptions``.

    Ancestors go from the root down; references follow the text, sections before exhibits, with 500 characters of text each; definitions
    are the terms used, in the order of their definitions; exceptions are the sections that modify this one, with 300 characters each. ``chars`` as in ``build_edges``.
    """
    nodes, edges = _cut(nodes), _cut(edges)  # the parts read both, and the edges' plan is long
    body = lambda n: F.left(F.coalesce("text", F.lit("")), F.lit(n))
    sections = nodes.where("type = 'Section'").select("id", "number", "title", text_of(chars).alias("text"))
    wanted = sections if of is None else sections.join(of.select("id").distinct(), "id", "left_semi")
    ids = wanted.select("id")
    listed = lambda df, key, item, name: (df if of is None else df.join(ids, "id", "left_semi")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), item.alias("v")))), lambda x: x["v"]).alias(name))
    title = F.struct("number", "title")
    up = ancestors(edges).select(F.col("node").alias("id"), F.col("ancestor").alias("node"), F.col("distance").alias("hops")).join(sections.select(F.col("id").alias("node"), "number", "title"), "node")
    refs = edges.where("type = 'REFERENCES'").join(sections.select(F.col("id").alias("src"), F.col("text").alias("own")), "src").select(F.col("src").alias("id"), "dst", "own")
    refs = refs.join(nodes.select(F.col("id").alias("dst"), "type", F.coalesce("number", F.regexp_extract("id", "^exhibit:(.*)", 1)).alias("number"), "title", body(500).alias("text")), "dst")
    place = F.struct((F.col("type") != "Section").alias("exhibit"), F.when(F.col("type") == "Section", F.array_position(T.section_refs(F.col("own")), F.col("number"))).otherwise(F.array_position(T.exhibit_refs(F.col("own")), F.col("number"))).alias("at"), "dst")
    used = edges.where("type = 'USES_TERM'").select(F.col("src").alias("id"), "dst").join(terms_of(nodes, chars).withColumnRenamed("id", "dst"), "dst")
    exceptions = edges.where("type = 'EXCEPTION'").select(F.col("dst").alias("id"), "src").join(nodes.select(F.col("id").alias("src"), "number", "title", body(300).alias("text")), "src")
    out = wanted
    for part in (
        listed(up, -F.col("hops"), title, "ancestors"),
        listed(refs, place, F.struct(F.col("dst").alias("id"), "type", "number", "title", "text"), "references"),
        listed(used, F.struct("first", "dst"), F.struct("term", "defined_in"), "definitions"),
        listed(exceptions, F.struct(T.section_key(F.col("number")).alias("key"), "src"), F.struct("number", "title", "text"), "exceptions"),
    ):
        name = part.columns[1]
        out = out.join(part, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


def checklist(rules: DataFrame, nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each rule with the context of what it cites, as much of it as a reviewer reads: 900 characters of the section (or 44 lines of the exhibit), 6 references, 8 terms, 4 exceptions."""
    flat = lambda c, n: F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(n))
    shown = contexts.select(
        F.col("id").alias("cited"),
        F.array_join(F.transform("ancestors", lambda a: F.trim(F.concat_ws(" ", a["number"], F.left(a["title"], F.lit(40))))), " > ").alias("trail"),
        flat("text", 900).alias("body"),
        F.transform(F.slice("references", 1, 6), lambda r: F.struct(F.concat_ws(" ", r["type"], r["number"]).alias("label"), F.left(r["title"], F.lit(70)).alias("title"), flat(r["text"], 320).alias("text"))).alias("references"),
        F.slice("definitions", 1, 8).alias("definitions"),
        F.transform(F.slice("exceptions", 1, 4), lambda e: F.struct(e["number"].alias("number"), flat(e["text"], 300).alias("text"))).alias("exceptions"),
    )
    exhibits = nodes.where("type = 'Exhibit'").select(F.col("id").alias("cited"), F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 44), "\n").alias("body"))
    return rules.select("rule_id", T.citation_node(F.col("section")).alias("cited")).join(shown.unionByName(exhibits, allowMissingColumns=True), "cited", "left").select("rule_id", *shown.columns)


def readable(node_type: Column, title: Column, text: Column) -> Column:
    return (F.trim(F.coalesce(text, F.lit(""))) != "") | ((node_type == "Section") & (F.size(F.split(F.trim(title), r"\s+")) >= 4))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sections with obligations that no rule cites, in natural order."""
    cited = edges.where("type = 'CITES'").select(F.col("dst").alias("id"))
    both = F.concat_ws(" ", "title", "text")
    own = nodes.where((F.col("type") == "Section") & T.has_obligation(both, False)).join(cited, "id", "left_anti")
    return own.select("id", "number", F.left(F.coalesce("text", F.lit("")), F.lit(150)).alias("preview"), T.section_key(F.col("number")).alias("key"))


#: The twin's words: fewer than T.OBLIGATION, inside of words too, and only in a text without line breaks.
TWIN_OBLIGATION = r"(?i)\A.*(shall|must|may\s+not|minimum|maximum|no\s+less\s+than|no\s+more\s+than|at\s+least|not\s+exceed|prohibited).*\z"


def twin_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``orphans`` as the openCypher twin has it: ``id, number``, in lexical order of ``number``."""
    cited = edges.where("type = 'CITES'").select(F.col("dst").alias("id"))
    says = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(TWIN_OBLIGATION)
    return nodes.where((F.col("type") == "Section") & (says("text") | says("title"))).join(cited, "id", "left_anti").select("id", "number")


def unresolved(starts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``start, node``: unread nodes that a rule depends on, however far."""
    unread = nodes.where(~readable(F.col("type"), F.col("title"), F.col("text"))).select(F.col("id").alias("node"))
    return reach(starts, edges, ["CITES", "REFERENCES"]).join(unread, "node", "left_semi").select("start", "node")


def twin_unresolved(starts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``unresolved`` as the twin has it: within five hops, and a title's words are cut at single blanks."""
    long = (F.col("type") == "Section") & (F.size(F.split(F.coalesce("title", F.lit("")), " ")) >= 4)
    unread = nodes.where((F.trim(F.coalesce("text", F.lit(""))) == "") & ~long).select(F.col("id").alias("node"))
    return reach(starts, edges, ["CITES", "REFERENCES"], 5).join(unread, "node", "left_semi").select("start", "node")


def context_items(contexts: DataFrame) -> DataFrame:
    """``id, part, item`` of ``context``, by the fields that a comparison of contexts looks at."""
    part = lambda name, field: contexts.select("id", F.lit(name).alias("part"), F.explode(name).alias("x")).select("id", "part", F.col(f"x.{field}").alias("item"))
    return part("ancestors", "number").unionByName(part("references", "id")).unionByName(part("definitions", "term")).unionByName(part("exceptions", "number"))


def twin_context_items(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``context_items`` by the twin's patterns: paths of CONTAINS from each section down, and single edges."""
    sections = nodes.where("type = 'Section'").select("id", "number")
    down = reach(sections.select(F.col("id").alias("start")), edges, ["CONTAINS"]).join(sections.select(F.col("id").alias("start"), "number"), "start")
    row = lambda df, i, name, item: df.select(F.col(i).alias("id"), F.lit(name).alias("part"), F.col(item).alias("item"))
    from_section = edges.join(sections.select(F.col("id").alias("src")), "src", "left_semi")
    used = from_section.where("type = 'USES_TERM'").join(terms_of(nodes).select(F.col("id").alias("dst"), "term"), "dst")
    said = edges.where("type = 'EXCEPTION'").join(sections.select(F.col("id").alias("src"), "number"), "src").join(sections.select(F.col("id").alias("dst")), "dst", "left_semi")
    return row(down, "node", "ancestors", "number").unionByName(row(from_section.where("type = 'REFERENCES'"), "src", "references", "dst")).unionByName(row(used, "src", "definitions", "term")).unionByName(row(said, "dst", "exceptions", "number")).distinct()


def backend_differences(starts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``what, subject, item, side``: what only the in-process functions or only the twin says of rules and sections."""
    nodes, edges = _cut(nodes), _cut(edges)
    form = lambda df, what, subject, item: df.select(F.lit(what).alias("what"), F.col(subject).alias("subject"), F.col(item).alias("item"))
    parts = lambda df: df.select(F.concat(F.lit("context "), "part").alias("what"), F.col("id").alias("subject"), "item")
    a = form(unresolved(starts, nodes, edges), "unresolved", "start", "node").unionByName(form(orphans(nodes, edges), "orphans", "id", "number")).unionByName(parts(context_items(context(nodes, edges))))
    b = form(twin_unresolved(starts, nodes, edges), "unresolved", "start", "node").unionByName(form(twin_orphans(nodes, edges), "orphans", "id", "number")).unionByName(parts(twin_context_items(nodes, edges)))
    both = a.distinct().withColumn("a", F.lit(1)).unionByName(b.distinct().withColumn("a", F.lit(-1))).groupBy("what", "subject", "item").agg(F.sum("a").alias("a"))
    return both.where("a <> 0").select("what", "subject", "item", F.when(F.col("a") > 0, "in-process").otherwise("twin").alias("side"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by kind, and totals."""
    count = lambda d, what: d.rollup("type").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.coalesce("type", F.lit("all")).alias("type"), "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))
