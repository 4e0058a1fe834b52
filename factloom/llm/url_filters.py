"""URL filters: host and path rules, then a path-template tree, all in DataFrame functions.

For each host the paths form a tree. Segments with digits are wildcards at once; a level whose
segments are nearly all different becomes a wildcard too; and branches that are statistically similar to their siblings are
merged: by their share of blocked labels where both have some, and by what follows below them where a branch has
too few labels. So labels reach urls without one. A template is
rejected when its labels, smoothed towards a prior, are nearly all blocked ones. A url's label is its rule's verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialize

#: Levels after which it is asked before each further one whether any prefix is still shared.
SURE = 4
#: A level is variable with this many different segments, and this share of them by urls.
VARIABLE, SHARE = 20, 0.5
#: Labels a branch and its siblings need to be compared; the normal quantile of the test.
LEAST, Z = 5, 1.96
#: Distance up to which two branches' distributions of what follows are alike, besides what chance explains.
APART = 0.1
#: Prior share of blocked labels, its weight in labels, and the purity from which a template is rejected.
PRIOR, WEIGHT, REJECT = 0.1, 2.0, 0.8

#: The rules of the query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _segments(path: Column) -> Column:
    """Segments, those with digits as wildcards that keep an extension."""
    raw = F.filter(F.split(path, "/"), lambda s: s != "")
    shaped = F.transform(raw, lambda s: F.when(s == "*", F.lit("%*")).when(s.rlike("[0-9]") | (F.length(s) > 40), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[a-z]{1,5})?\z", 1))).otherwise(s))
    return F.transform(shaped, lambda s: F.when(s.isin("+", "**"), F.concat(F.lit("%"), s)).otherwise(s))  # a segment that looks like a wildcard isn't one


def templates(urls: DataFrame) -> DataFrame:
    """From ``host, path, verdict`` (null: no label): ``host, shape, template, n_labels, n_blocked, purity, rejected``.

    ``shape`` is the path with digit segments as wildcards; several shapes can share a template.
    The tree goes as deep as LEAST urls of a host share a prefix; what is below that can't be merged with anything.
    Empty paths have the empty template; urls that repeat count each time; hosts and paths are never null; no rows give no templates.
    """
    shape = F.array_join(_segments(F.col("path")), "/")
    tree = (
        urls.groupBy("host", shape.alias("shape"))
        .agg(F.count("*").alias("n"), F.count("verdict").alias("labels"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"))
        .withColumns({"rest": F.filter(F.split("shape", "/"), lambda s: s != ""), "done": F.array().cast("array<string>")})
    )
    tree = materialize(tree, "templates")
    for depth in range(tree.agg(F.max(F.size("rest"))).first()[0] or 0):
        if depth >= SURE and not tree.where(F.size("rest") > 0).groupBy("host", F.array_join("done", "/")).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).take(1):
            break
        level = tree.withColumns({"prefix": F.array_join("done", "/"), "segment": F.get("rest", F.lit(0))})
        child = level.where("segment is not null").groupBy("host", "prefix", "segment").agg(F.sum("n").alias("n"), F.sum("labels").alias("labels"), F.sum("blocked").alias("blocked"))
        parent = child.groupBy("host", "prefix").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), F.sum("labels").alias("all_labels"), F.sum("blocked").alias("all_blocked"))
        others, share = F.col("all_labels") - F.col("labels"), F.col("all_blocked") / F.col("all_labels")
        gap = F.abs(F.col("blocked") / F.col("labels") - (F.col("all_blocked") - F.col("blocked")) / others)
        # what follows: the share of the branch's urls that would have to move to look like its siblings
        below = level.where("segment is not null").groupBy("host", "prefix", "segment", F.array_join(F.slice("rest", 2, F.size("rest")), "/").alias("tail")).agg(F.sum("n").alias("m"))
        tails = below.groupBy("host", "prefix", "tail").agg(F.sum("m").alias("m_all"))
        kinds = tails.groupBy("host", "prefix").agg(F.count("*").alias("tail_kinds"))
        moved = F.greatest(F.lit(0.0), F.col("m") / F.col("n") - (F.col("m_all") - F.col("m")) / (F.col("all") - F.col("n")))
        moved = below.join(tails, ["host", "prefix", "tail"]).join(child.select("host", "prefix", "segment", "n"), ["host", "prefix", "segment"]).join(parent.select("host", "prefix", "all"), ["host", "prefix"]).where("all > n").groupBy("host", "prefix", "segment").agg(F.sum(moved).alias("moved"))
        similar = (F.col("labels") < LEAST) & (others >= LEAST) & (F.col("n") >= LEAST) & (F.col("moved") <= APART + F.sqrt(F.col("tail_kinds") / F.col("n")) / 2)
        alike = (F.col("labels") >= LEAST) & (others >= LEAST) & (gap <= Z * F.sqrt(share * (1 - share) * (1 / F.col("labels") + 1 / others)))
        variable = (F.col("kinds") >= VARIABLE) & (F.col("kinds") >= SHARE * F.col("all"))
        decided = child.join(parent, ["host", "prefix"]).join(kinds, ["host", "prefix"]).join(moved, ["host", "prefix", "segment"], "left").select("host", "prefix", "segment", F.when(variable, F.lit("*")).when(alike | similar, F.lit("+")).alias("as")).where("as is not null")
        tree = level.join(decided, ["host", "prefix", "segment"], "left").select(
            "host",
            "shape",
            "n",
            "labels",
            "blocked",
            F.when(F.size("rest") > 0, F.slice("rest", 2, F.size("rest"))).otherwise(F.col("rest")).alias("rest"),
            F.when(F.col("segment").isNotNull(), F.concat("done", F.array(F.coalesce("as", "segment")))).otherwise(F.col("done")).alias("done"),
        )
        tree = materialize(tree, "templates")
    tree = tree.select("host", "shape", "labels", "blocked", F.array_join(F.concat("done", "rest"), "/").alias("template"))
    total = tree.groupBy("host", "template").agg(F.sum("labels").alias("n_labels"), F.sum("blocked").alias("n_blocked"))
    total = total.withColumn("purity", (F.col("n_blocked") + PRIOR * WEIGHT) / (F.col("n_labels") + WEIGHT))
    return tree.select("host", "shape", "template").join(total.withColumn("rejected", F.col("purity") >= REJECT), ["host", "template"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: ``page_id, host, path, rule, verdict, template_rejected``.

    The longest fitting rule decides; else a rejected template blocks; else the url is allowed. A null url, or one without ``://``, has
    an empty host and path, fits no rule and is judged by the template of empty paths, which has no labels: allowed.
    Repeated rows repeat; very long urls are taken whole, and are levels of the tree only as far as others share them; columns of any name may be there; an empty table gives an empty result.
    """
    host, path = parts(pages[url_col])
    rows = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict})
    rejected = templates(rows.select("host", "path", F.col("by_rule").alias("verdict"))).where("rejected").select("host", "shape", F.lit(True).alias("rejected"))
    rows = rows.withColumn("shape", F.array_join(_segments(F.col("path")), "/")).join(rejected, ["host", "shape"], "left")
    return rows.select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("rejected", F.lit(False)).alias("template_rejected"),
    )
