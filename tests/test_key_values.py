"""Fields of a document's blocks: followed in its row and by joins, against plain loops."""

import random

from factloom.catalog import domain
from factloom.operators import facts as X
from pyspark.sql import functions as F

BLOCK = "struct<id: string, kind: string, entity: string, txt: string, confidence: double, page: int, relations: array<struct<type: string, ids: array<string>>>>"


def some_document(rng):
    words = [(f"w{i}", "WORD", None, rng.choice(["a", "b", "", None]), 50.0, 1, rng.choice([None, []])) for i in range(6)]
    ticks = [(f"x{i}", "SELECTION_ELEMENT", None, rng.choice(["SELECTED", "NOT_SELECTED", None]), 50.0, 1, None) for i in range(2)]
    line = [("l0", "LINE", None, "a b", 50.0, 1, [("CHILD", ["w0", "w1"])])]
    child = lambda: ("CHILD", rng.choice([None, [], rng.sample(["w0", "w1", "w2", "w3", "w4", "w5", "x0", "x1", "l0", "gone"], rng.randint(1, 4))]))
    value = lambda: ("VALUE", rng.choice([None, [], rng.sample(["v0", "v1", "k0", "w0", "gone"], rng.randint(1, 2))]))
    related = lambda *makers: rng.choice([None, [m() for m in makers if rng.random() < 0.8], [m() for m in makers]])
    keys = [(f"k{i}", "KEY_VALUE_SET", "KEY", None, rng.choice([90.0, 40.0, None]), i, related(child, value, child)) for i in range(3)]
    values = [(f"v{i}", "KEY_VALUE_SET", "VALUE", None, rng.choice([80.0, None]), 1, related(child, child)) for i in range(2)]
    blocks = words + ticks + line + keys + values
    rng.shuffle(blocks)
    return blocks


def fields(blocks):
    by_id = {b[0]: b for b in blocks}
    of = lambda b, kind: [i for r in b[6] or [] if r[0] == kind for i in r[1] or []]

    def text(b):
        found = [by_id[i] for i in of(b, "CHILD") if i in by_id and by_id[i][1] in ("WORD", "SELECTION_ELEMENT")]
        said = [w[3] if w[1] == "WORD" else "[X]" if w[3] == "SELECTED" else "" for w in found]
        return " ".join(w for w in said if w is not None) if found else None

    for k in blocks:
        if k[2] == "KEY":
            for link in of(k, "VALUE") or [None]:
                v = by_id.get(link)
                v = v if v and v[2] == "VALUE" else None
                sure = [c for c in (k[4], v and v[4]) if c is not None]
                yield text(k), (text(v) if v else None) or "", min(sure, default=None), k[5]


def test_in_the_row_and_by_joins(spark):
    rng = random.Random(5)
    docs = [(d, some_document(rng)) for d in range(120)] + [(900, []), (901, None)]
    frame = spark.createDataFrame(docs, f"doc_id long, blocks array<{BLOCK}>")
    want = sorted(((d, *f) for d, blocks in docs for f in fields(blocks or [])), key=str)
    rows = lambda df: sorted(((r.doc_id, r.key, r.value, r.confidence, r.page) for r in df.collect()), key=str)
    assert rows(X.row_key_values(frame)) == want and len(want) > 360
    assert rows(X.key_values(frame.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*"))) == want


def test_equal_lines_are_two_documents_and_nothing_is_shuffled(spark, tmp_path):
    """By joins two equal lines had each other's words, and each line took 700 bytes of shuffle."""
    line = "1L AS l_orderkey, 5L AS l_partkey, 7L AS l_suppkey, 1 AS l_linenumber, 3.0D AS l_quantity, 9.0D AS l_extendedprice, timestamp'1995-01-01' AS l_shipdate"
    spark.sql(f"SELECT {line}, 'N' AS l_returnflag UNION ALL SELECT {line}, 'N' UNION ALL SELECT {line}, 'R'").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = domain.j7(spark, str(tmp_path))
    assert sorted((r.key, r.value) for r in got.collect()) == [("Item 5", "[X]"), ("Item 5", "qty 3"), ("Item 5", "qty 3")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_only_counts_of_an_order_are_shuffled(spark, tmp_path):
    line = "5L AS l_partkey, 7L AS l_suppkey, 1 AS l_linenumber, 3.0D AS l_quantity, 9.0D AS l_extendedprice, timestamp'1995-01-01' AS l_shipdate"
    spark.sql(f"SELECT 1L AS l_orderkey, {line}, 'N' AS l_returnflag UNION ALL SELECT 1L, {line}, 'N' UNION ALL SELECT 2L, {line}, 'R'").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = domain.c2(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 0), (2, 1, 1)]
    assert got._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
