"""Each stage of the pipeline against brute force, on rows with clashing columns, nulls, repeats and a text of over a megabyte."""

import hashlib
import random
from collections import Counter

import pytest
from test_operators import BENCH, ROWS, cut, multi, sets_of

from factloom.llm import quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
R = random.Random(9)
LONG = " ".join("".join(R.choice("abcdefgh") for _ in range(R.randint(2, 9))) for _ in range(200_000))
RUN = "".join(R.choice("xyzé") for _ in range(300_000))  # no blank
NAMES = ["key", "kept", "group", "whole", "of", "count", "block", "spans", "row", "node", "text2", "a.b"]
SCHEMA = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)


def row(i, t, mark="x"):
    return (i, t, "en", len(t or ""), *[f"{mark}{n}" for n in NAMES])


GIVEN = [row(i, t) for i, t in ROWS] + [row(900, LONG), row(901, LONG + " more"), row(902, RUN), row(6, ROWS[5][1]), row(903, None, "y"), row(903, None, "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(GIVEN, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(GIVEN, SCHEMA).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i, *_ in GIVEN if i is not None], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def stage(name):
    return next(f for n, f in corpus_pipeline.STAGES if n == name)


def test_quality_keeps_what_scores(spark, docs, sf):
    machine = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = [r for r in GIVEN if machine.score([r[1] or ""])[0] >= quality.THRESHOLD]
    got = stage("quality classifier")(spark, docs, sf)
    assert got.columns == docs.columns and multi(got.collect()) == multi(want)


def test_one_of_each_group_stays(spark, docs, sf):
    sets = [sets_of(r[1]) for r in GIVEN]
    top = list(range(len(GIVEN)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, s in enumerate(sets):
        for b in range(a):
            if s and 100 * len(s & sets[b]) >= 80 * len(s | sets[b]):
                top[find(a)] = find(b)
    sha = lambda t: hashlib.sha256((t or "").encode()).digest()
    want = Counter()
    groups = {}
    for k, r in enumerate(GIVEN):
        groups.setdefault(find(k) if sets[k] else ("blank", r[0], r[1] or ""), []).append(r)
    for rows in groups.values():
        best = min(rows, key=lambda r: (r[0] is None, r[0] or 0, sha(r[1])))
        want[best[0], best[1] or ""] += 1
    got = stage("n-gram Jaccard join")(spark, docs, sf)
    rows = got.collect()
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in rows) == want
    assert not multi(rows) - multi(GIVEN)


def test_repeats_are_cut(spark, docs, sf):
    texts = [(r[1] or "").encode() for r in GIVEN]
    seen = Counter(x[k : k + 200] for x in texts for k in range(len(x) - 199))
    want = []
    for r, x in zip(GIVEN, texts):
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        t = bytes(b for b, g in zip(x, gone) if not g).decode("utf-8", errors="ignore") if any(gone) else r[1]
        want.append((r[0], t, r[2], len(t) if t is not None else None, *r[4:]))
    got = stage("suffix-array dedup")(spark, docs, sf)
    assert got.columns == docs.columns and multi(got.collect()) == multi(want)


def test_benchmark_is_cut(spark, docs, sf):
    want = [(r[0], cut(r[1]), r[2], None if r[1] is None else len(cut(r[1])), *r[4:]) for r in GIVEN]
    got = stage("benchmark decontamination")(spark, docs, sf)
    assert got.columns == docs.columns and multi(got.collect()) == multi(want)


def test_tokens(spark, docs, sf):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = multi((r[0], np.array(tok.encode(r[1] or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in GIVEN)
    assert multi((r.doc_id, bytes(r.ids)) for r in stage("BPE encoding and decoding")(spark, docs, sf).collect()) == want


def test_run_and_empty_table(spark, docs, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, given.where("false"), sf).count() == 0
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) > 0 and {r.doc_id for r in out} <= {r[0] for r in GIVEN}
