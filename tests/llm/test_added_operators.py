"""Fill-in-the-middle, BPE on matrices and the audit of sources against plain loops."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from factloom.llm import divergence, fill_in_middle, matrix_bpe

R = random.Random(11)
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LINES = ["", "\n", "a\n", "é　ü\r\n", "word " * 9 + "\n", "<P", "S>\n", "x" * 40, "中文\n", "\x00\n"]
TEXTS = ["", None, "\n", "\n\n\n", "one line", "one\n", "a\nb", "<P>\n a", "a <M> b", "<\n<S", "é" * 3000 + "\n" + "z" * 5000, "x\n" * 4000, *["".join(R.choice(LINES) for _ in range(R.randint(1, 60))) for _ in range(80)]]
SCHEMA = "doc_id long, text string, lang string, source string, n int, term string, form string, p int, q int, c0 string, value string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, so, 1, "x", "y", 2, 3, "z", "v") for i, t, la, so in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return [(k, t, "en", "s") for k, t in enumerate(TEXTS)] + [(3, TEXTS[20], "en", "s"), (3, TEXTS[20], "en", "s"), (None, "a\nb\nc", None, None)]


def in_lines(doc_id, text, fim=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return doc_id, n, "plain", None, None, text
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "fim"), [(1, 100), (7, 60), (1 << 14, 100)])
def test_fill_in_middle(spark, rows, chunk, fim):
    got = fill_in_middle.transform(table(spark, rows).repartition(3), chunk=chunk, fim_percent=fim).collect()
    want = [in_lines(i, t, fim) for i, t, _, _ in rows]
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter(want)
    texts = Counter((i, sha(t or "")) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.restored_sha256) for r in got) == texts
    assert all(r.output_sha256 == sha(r.output) for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_other_units(spark, rows):
    for unit, count in (("character", len), ("word", lambda t: 0 if not t else 1 + len(re.findall(r"(?<=[\t\n\r ])[^\t\n\r ]", t)))):
        got = fill_in_middle.transform(table(spark, rows), unit=unit, chunk=5).collect()
        assert Counter((r.doc_id, r.n) for r in got) == Counter((i, count(t or "")) for i, t, _, _ in rows)
        assert Counter((r.doc_id, r.restored_sha256) for r in got) == Counter((i, sha(t or "")) for i, t, _, _ in rows)


def test_fill_in_middle_only_scans_owners_again(monkeypatch):
    text = "".join(R.choice("ab\n") for _ in range(5000)).encode()
    found = fill_in_middle.Chunks(np.frombuffer(text, np.uint8), np.array([0, 2000, 2000, 5000]), "line", 100)
    seen, flags = [], found._flags
    monkeypatch.setattr(found, "_flags", lambda a, b: seen.append((a, b)) or flags(a, b))
    ends = [m.end() for m in re.finditer(rb"\n", text[2000:])]
    for k in (1, len(ends) // 2, len(ends) - 1):
        assert found.place(2, k) == 2000 + ends[k - 1]
    assert len(seen) == 3 and all(b - a <= 100 for a, b in seen)


def test_fill_in_middle_of_nothing(spark):
    assert fill_in_middle.transform(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.transform(spark.createDataFrame([], SCHEMA), sentinels=("<a", "<a<", "<b"))


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(library):
    tokens = [library.decode_single_token_bytes(i) for i in range(0, 50000, 7)]
    anywhere = lambda: chr(R.choice([R.randint(0, 127), R.randint(128, 0x7FF), R.randint(0x800, 0xD7FF), R.randint(0x10000, 0x1FFFF)]))
    for _ in range(60):
        yield "".join(anywhere() for _ in range(R.randint(0, 90)))
        yield "".join(R.choice("abcdeiou") for _ in range(R.randint(1, 500)))
        yield b"".join(R.choice(tokens) for _ in range(R.randint(1, 90))).decode("utf8", "replace")
        yield R.choice(["a", "0", " é", "中-", "  ", "ab"]) * R.randint(1, 400)
        yield " ".join("".join(R.choice("abcdefghijklmnop'éß\n0 ") for _ in range(R.randint(1, 12))) for _ in range(40))


def test_matrix_bpe(spark, library):
    texts = ["", None, " ", "don't  'll\t\tz　q é\x1cb", "<|endoftext|>", "\U00018fec뒔", "a" * 3000, "\U00011dd4 뤺", *fuzz(library)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(5, "x y", "", ""), (5, "x y", "", ""), (None, "null id", None, None)]
    got = matrix_bpe.encode(table(spark, rows).repartition(3), RANKS, chunk=2000, memo=20000).collect()
    want = Counter()
    for i, t, _, _ in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want[i, len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert matrix_bpe.encode(spark.createDataFrame([], SCHEMA), RANKS).count() == 0


def test_long_rows_merge_as_short_ones_do(library):
    bpe = matrix_bpe.MatrixBPE(RANKS, public_tokenizers.PATTERN)
    words = ["".join(R.choice(a) for _ in range(R.randint(2, 120))).encode() for a in ("ab", "aei", "abcdefghijklmnopqrstuvwxyz", "éaü") for _ in range(200)]
    ids = dict(bpe._matrix(words))
    assert [ids[k] for k in range(len(words))] == [bpe._single(w) for w in words]


def test_pair_table_finds_all_and_nothing_else():
    keys = {(R.randint(0, 300), R.randint(0, 300)): k for k in range(5000)}
    a, b, v = (np.array(x, np.int32) for x in zip(*[(*k, v) for k, v in keys.items()], strict=True))
    table = matrix_bpe.PairTable(a, b, v)
    asked = [(x, y) for x in range(-1, 302, 3) for y in range(-1, 302)]
    got = table(*(np.array(c, np.int32) for c in zip(*asked, strict=True)))
    assert got.tolist() == [keys.get(k, int(matrix_bpe.NONE)) for k in asked]


def plain_audit(rows, min_docs, top):
    rows = [(la or "", so or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for _, t, la, so in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(w for r in own for w in set(r[2]))
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        counts = {s: Counter(w for r in own if r[1] == s for w in r[2]) for s in {r[1] for r in own}}
        counts[None] = sum(counts.values(), Counter())
        total = {s: sum(c[w] for w in kept) for s, c in counts.items()}
        p = {s: {w: 1 + 10**9 * (c[w] + 1) // (total[s] + len(kept)) for w in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts.keys() - {None}:
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in counts.keys() - {None, s}]
            terms = [(f(p[s][w], p[None][w]), w) for w in kept if counts[s][w] and p[s][w] > p[None][w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])}
    return out


@pytest.mark.parametrize(("min_docs", "top"), [(3, 200), (1, 4), (50, 10)])
def test_source_divergence(spark, min_docs, top):
    vocabulary = ["Ab", "ab", "é", "É", "x9y", "zeta", "BETA", "beta", "中文", "\U0001f600", "q"]
    rows = [(k, " ".join(R.choice(vocabulary) for _ in range(R.randint(0, 30))), R.choice(["en", "de", "", None]), R.choice(["a", "a", "a", "b", "c", None, ""])) for k in range(120)]
    rows += [(200, None, "en", "silent"), (201, "12 34", "xx", "one"), (202, "", "xx", "two"), (203, "lonely", "yy", "only"), (5, "ab ab", "en", "a"), (5, "ab ab", "en", "a"), (None, "no id ab", "en", "b"), (204, "long " * 30000, "en", "c")]
    got = divergence.audit(table(spark, rows).repartition(3), min_docs, top).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain_audit(rows, min_docs, top)
    assert divergence.audit(spark.createDataFrame([], SCHEMA), min_docs).count() == 0


def test_shares_are_exact_beyond_longs(spark):
    from pyspark.sql import functions as F

    n, total = 9_000_000_000_000_000_000, 9_100_000_000_000_000_000
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(7))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (total + 7)
