"""Operators against brute force on a small table with nulls, empty, long, tied and repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factloom.llm import bpe, components, decontaminate, jaccard, media, quality, repeats, sharding, token_counts, token_files, url_filters

R = random.Random(5)
VOCAB = ["".join(R.choice("abcdeé") for _ in range(R.randint(1, 6))) for _ in range(300)]
words = lambda n: " ".join(R.choice(VOCAB) for _ in range(n))
PASSAGE = words(60)
BASE = words(120)


def edited(text, n):
    w = text.split(" ")
    for k in R.sample(range(len(w)), n):
        w[k] = "edited" + str(R.random())
    return " ".join(w)


ROWS = [
    (0, ""), (1, None), (2, "  \n\t "), (3, "one two"), (4, "One  TWO"), (5, words(4000)), (6, BASE), (7, BASE), (8, edited(BASE, 2)), (9, edited(BASE, 2)), (10, edited(BASE, 40)),
    (11, words(30) + " " + PASSAGE + " " + words(20)), (12, words(50) + " " + PASSAGE), (13, "x" * 700), (14, "<|endoftext|> a<|endoftext|>"), (15, "don't  'll\t\tz\u3000q é\x1cb"), (16, BASE), (16, BASE), (17, "\n"), (18, "é" * 300),
    *[(20 + k, words(R.randint(1, 90))) for k in range(40)], *[(100 + k, edited(BASE, 3)) for k in range(12)], (None, words(70)), (None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, a string, n int, row int, block string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), None, 1, "x", None, 2, "b") for i, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def multi(rows):
    return Counter(tuple(r) for r in rows)


def test_sharding(docs, none):
    got = sharding.shard(docs, 4).collect()
    assert multi((r.doc_id, r.size, r.text_crc32) for r in got) == multi((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    for k in range(4):
        own = sorted(r.slot for r in got if r.shard == k)
        assert own == list(range(len(own)))
    by_text = {}
    for r in got:
        by_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert sharding.shard(none, 4).count() == 0


def test_smallest_capacity_is_minimax():
    for _ in range(30):
        sizes, k = np.array([R.randint(0, 20) for _ in range(R.randint(1, 9))]), R.randint(1, 4)
        best = {0: 0} | dict.fromkeys(range(1, len(sizes) + 1), float("inf"))
        for _ in range(k):
            best = {j: min(max(best[i], int(sizes[i:j].sum())) for i in range(j + 1)) for j in best}
        assert sharding.smallest_capacity(sizes, k) == best[len(sizes)]
        cut = sharding.cuts(sizes, k)
        assert len(cut) == k + 1 and cut == sorted(cut) and max(int(sizes[a:b].sum()) for a, b in zip(cut, cut[1:])) == best[len(sizes)]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("small", [False, True])
def test_token_files(docs, none, monkeypatch, small):
    if small:  # several parts, and several files in a part
        monkeypatch.setattr(token_files, "PART_BYTES", 9000)
        monkeypatch.setattr(token_files, "FILE_IDS", 100)
    files, width = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"))
    got = token_files.read_token_files(files, width).collect()
    tok = library("word_bpe_49k.json")
    want = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [1]
    assert multi((r.doc_id, r.ids) for r in got) == multi((i, np.array(want(t), "<u4").tobytes()) for i, t in ROWS)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    files, width = token_files.write_token_files(none, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read_token_files(files, width).count() == 0


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 24])
def test_packing_round_trip(width):
    x = np.array([R.randrange(1 << width) for _ in range(40_001)], np.uint32)
    body = token_files.pack(x, width)
    blocks = np.append(np.arange(0, -(-len(x) // token_files.BLOCK)) * token_files.block_bytes(width), len(body))
    for a, n in ((0, 1), (16_383, 2), (20_000, 20_001), (0, 40_001), (5, 0)):
        assert (token_files.read_ids(body, blocks, a, n, width) == x[a : a + n]).all()


@pytest.mark.parametrize(("name", "head"), [("byte_bpe_50k.json", 200_000), ("byte_bpe_50k.json", 5), ("piece_bpe_32k.model", 5)])
def test_token_counts(docs, none, monkeypatch, name, head):
    monkeypatch.setattr(token_counts, "HEAD", head)
    if head == 5:
        monkeypatch.setattr(token_counts, "HELD", 5000)
    got = token_counts.token_counts(docs, public_tokenizers.path(name)).collect()
    if name.endswith(".json"):
        count = lambda t: len(library(name).encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        count = lambda t: len(sp.encode(t))
    want = {t: count(t or "") for _, t in ROWS}
    assert multi(got) == multi((i, len((t or "").encode()), want[t], want[t] > 512) for i, t in ROWS)
    assert token_counts.token_counts(none, public_tokenizers.path(name)).count() == 0


def test_bpe(docs, none):
    tok = library("byte_bpe_50k.json")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = bpe.encode(docs, path).collect()
    want = []
    for i, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)))
    assert multi((r.doc_id, r.ids, r.decoded) for r in got) == multi(want)
    assert all(r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.n_tokens * 4 == len(r.ids) for r in got)
    assert bpe.encode(none, path).count() == 0


def test_repeats(docs, none):
    texts = [(t or "").encode() for _, t in ROWS]
    seen = Counter(x[k : k + 200] for x in texts for k in range(len(x) - 199))
    want = []
    for (i, _), x in zip(ROWS, texts):
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(x, gone) if not g)
        want.append((i, len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    assert sum(w[2] for w in want) > 2000
    assert multi(repeats.repeats(docs).collect()) == multi(want)
    assert repeats.repeats(none).count() == 0


def sets_of(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(rows):
    """doc_id, size of the set and smallest id reachable, for rows of any ids and texts; rows without id link too."""
    rows = [(i, t, sets_of(t)) for i, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, (_, _, s) in enumerate(rows):
        for b in range(a):
            t = rows[b][2]
            if s and 100 * len(s & t) >= 80 * len(s | t):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    named = lambda k: min((i for i in least[find(k)] if i is not None), default=None)
    return multi((i, len(s), named(k) if s else i) for k, (i, _, s) in enumerate(rows))


@pytest.mark.parametrize("hot", [None, 2])
def test_jaccard(docs, none, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(jaccard, "HOT", hot)
        monkeypatch.setattr(jaccard, "UNIT", 3)
        monkeypatch.setattr(jaccard, "SMALL", 2)
    assert multi(jaccard.similar(docs).collect()) == classes(ROWS)
    assert jaccard.similar(none).count() == 0


def test_jaccard_of_repeated_ids(spark):
    """One id with two texts, each of them with a near copy of its own."""
    a, b = words(60), words(60)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (1, b), (None, a)]
    assert multi(jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == classes(rows)


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_of_many_near_copies(spark, monkeypatch, seed):
    """Chains of small changes and texts just above and below the threshold; the second round has to find links, in blocks."""
    monkeypatch.setattr(jaccard, "OFFSETS", ())
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "UNIT", 5)
    monkeypatch.setattr(jaccard, "HOT", [1000, 4][seed])
    r, rows = random.Random(seed), []
    for g in range(4):
        base = [f"w{g}x{k}" for k in range(r.choice([8, 25, 60]))]
        for k in range(40):
            own = list(base if r.random() < 0.6 or not rows else rows[-1][1].split(" "))
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = f"e{r.random()}"
            if r.random() < 0.3:
                own = own[: max(1, int(len(own) * r.choice([0.8, 0.9])))]
            rows.append((1000 * g + k, " ".join(own)))
    r.shuffle(rows)
    assert multi(jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == classes(rows)


def test_components(spark):
    pairs = [(k, k + 1) for k in range(300)] + [(1000, 900), (7, 7), (None, 3), (900, 950), (1000, 900)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(301), 0) | dict.fromkeys((900, 950, 1000), 900)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_media(docs, none):
    got = media.media(docs).collect()
    for r, payload in ((r, media.from_wav(r.media)) for r in got):
        assert r.payload_bytes == len(payload) and len(payload) % 576 == 0 and len(payload) > 0
        assert hashlib.sha256(payload).hexdigest() == r.payload_sha256 and zlib.crc32(payload[-32:]) == r.tail_crc32
        assert payload[r.n_bytes :] == b"\xff" * (r.payload_bytes - r.n_bytes)
    assert multi((r.doc_id, media.from_wav(r.media)[: r.n_bytes]) for r in got) == multi((i, (t or "").encode()) for i, t in ROWS)
    same = {}
    for r in got:
        same.setdefault(r.payload_sha256, set()).add(r.feature)
    assert all(len(s) == 1 for s in same.values())
    import pyarrow as pa

    table = pa.ipc.open_stream(got[0].tensors).read_all()
    assert table.schema.field("tensor").type.shape == [media.TENSOR, media.MELS]
    assert media.media(none).count() == 0


def test_tone_is_found():
    quiet, t = np.full(16_000, 128), np.arange(16_000) / 16_000
    loud = 128 + 60 * np.sin(2 * np.pi * 1000 * t)
    samples = np.concatenate([quiet, quiet, loud, quiet]).astype(np.uint8).tobytes()
    _, _, active, _ = media.features(samples)
    assert len(active) == 1 and abs(active[0][0] - 2) < 0.05 and abs(active[0][1] - 3) < 0.05


def test_url_filters(spark):
    urls = [None, "no scheme", "HTTP://WWW.Example.com/en/1?x", "http://a.example.com/en/2#t", "http://b.net/es/9", "http://b.net/fr", "http://b.net/fr/", "http://x.org", "http://x.org?q", "ftp://example.community/en/", "a://b://c/d", *[f"http://spam.net/es/{k}" for k in range(30)], *[f"http://spam.net/page{k}/es/" for k in range(9)]]
    pages = spark.createDataFrame([(k, u, None, "z") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filters.judge(pages).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0].lower()
            path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        fits = [(h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, best[0])
        assert got[k].verdict in ("allow", "block") and (best[1] is None or got[k].verdict == best[1])
    assert url_filters.judge(pages.where("false")).count() == 0


def test_template_is_rejected_by_its_labels(spark):
    rows = [(f"/ad/{k}", "block") for k in range(30)] + [("/ad/77", None), ("/news/5", None)] + [(f"/news/{k}", "allow") for k in range(30)]
    urls = spark.createDataFrame([("h", p, v) for p, v in rows], "host string, path string, verdict string")
    got = {r["shape"]: r.rejected for r in url_filters.templates(urls).collect()}
    assert got == {"ad/*": True, "news/*": False}


def test_labels_reach_branches_without_any(spark):
    """/de/ has no label and the same pages below it as the blocked /es/; /about and /static/ look different; on host g the labelled branches are allowed."""
    rows = [("h", f"/es/{k}", "block") for k in range(30)] + [("h", f"/fr/{k}.html", "block") for k in range(30)] + [("h", f"/de/{k}", None) for k in range(20)] + [("h", f"/de/{k}.html", None) for k in range(20)]
    rows += [("h", "/about", None)] * 8 + [("h", f"/static/css/{k}/x", None) for k in range(12)]
    rows += [("g", f"/es/{k}", "allow") for k in range(30)] + [("g", f"/de/{k}", None) for k in range(20)] + [("k", "/a/*/+", None), ("k", "/**/b", None), (" ", "", None)]
    got = {(r.host, r["shape"]): r.rejected for r in url_filters.templates(spark.createDataFrame(rows, "host string, path string, verdict string")).collect()}
    assert all(got["h", x] for x in ("es/*", "fr/*.html", "de/*", "de/*.html"))
    assert not any(got[x] for x in got if x[0] != "h" or x[1] == "about" or x[1].startswith("static"))
    assert {x[1] for x in got if x[0] == "k"} == {"a/%*/%+", "%**/b"}


def test_resampling_and_mel_against_plain_sums():
    x = np.random.default_rng(3).standard_normal(2000).astype("f4")
    phases, bank, window = media._filters()
    y = media.resample(x)
    padded = np.concatenate([np.zeros(media.TAPS // 2, "f4"), x, np.zeros(media.TAPS, "f4")])
    for k in R.sample(range(len(y)), 50):
        at = k * media.DOWN // media.UP
        assert abs(y[k] - sum(float(padded[at + j]) * float(phases[k * media.DOWN % media.UP][j]) for j in range(media.TAPS))) < 1e-4
    t = np.arange(16_000) / 16_000  # a tone passes with its height, and one beyond the new limit goes
    assert 0.9 < np.abs(media.resample(np.sin(2 * np.pi * 1000 * t).astype("f4"))[500:-500]).max() < 1.1
    assert np.abs(media.resample(np.sin(2 * np.pi * 7800 * t).astype("f4"))[500:-500]).max() < 0.15
    mels, energy = media.log_mel(y)
    for f in (0, 3, len(mels) - 1):
        frame = y[f * media.HOP : f * media.HOP + media.FRAME]
        bins = np.arange(media.FFT // 2 + 1)
        power = np.abs(np.exp(-2j * np.pi * np.outer(bins, np.arange(media.FRAME)) / media.FFT) @ (frame * window)) ** 2
        assert np.allclose(mels[f], np.log(np.maximum(power @ bank, 1e-6)), atol=1e-2)
        assert abs(energy[f] - 10 * np.log10(np.maximum((frame.astype("f8") ** 2).mean(), 1e-9))) < 1e-2


def test_hysteresis_against_a_loop():
    e = np.random.default_rng(4).standard_normal(400) * 3
    middle, on, want = np.median(e), False, []
    for k, v in enumerate(e):
        if not on and v > middle + media.ON:
            on, begun = True, k
        elif on and v < middle + media.OFF:
            on = False
            want.append((begun, k))
    assert media.segments(e) == want + [(begun, len(e))] * on


def test_shards_are_near_equal_in_bytes(docs):
    got = sharding.shard(docs, 4).collect()
    by_text = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        by_text.setdefault((r.text_crc32, r.size), []).append(r)
    sums = [sum(r.size for r in got if r.shard == k) for k in range(4)]
    largest = max(sum(r.size for r in rows) for rows in by_text.values())
    assert max(sums) <= max(largest, sum(sums) / 4 + largest)


def test_quality(spark, docs, none):
    good, bad = [words(60) for _ in range(150)], ["".join(w + R.choice(["$$$", "%%%"]) + " " for w in words(40).split()) for _ in range(150)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 150), 0) for k in range(300)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    machine = quality.fit(table, labels)
    got = quality.score(table, machine).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id < 150) for r in held) >= 0.95 * len(held)
    mixed = quality.score(docs, machine).collect()
    assert len(mixed) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in mixed)
    assert quality.score(docs, machine, keep=True).columns == docs.columns
    assert quality.score(none, machine).count() == 0
    assert quality.score(docs, quality.fit(none, labels)).count() == len(ROWS)


def test_interactions_in_linear_time():
    m = quality.Machine(0.3, np.random.default_rng(1).standard_normal(quality.BUCKETS + quality.N_STATS).astype("f4"), np.random.default_rng(2).standard_normal((quality.BUCKETS + quality.N_STATS, 4)).astype("f4") * 0.1, np.zeros(quality.N_STATS, "f4"), np.ones(quality.N_STATS, "f4"))
    doc, bucket, value, stats = quality.featurize([PASSAGE])
    x = np.zeros(quality.BUCKETS + quality.N_STATS)
    x[bucket] = value
    x[quality.BUCKETS :] = m.rows(stats)[0]
    at = np.flatnonzero(x)
    slow = m.bias + m.weights @ x + sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for k, i in enumerate(at) for j in at[k + 1 :])
    assert abs(slow - m.raw(doc, bucket, value, stats)[0][0]) < 1e-2


BENCH = [(1, " ".join(PASSAGE.split()[10:40])), (2, "one, TWO!"), (3, None), (4, "..."), (None, BASE), (10, words(12)), (5, " ".join(BASE.split()[:10]))]


def found(t):
    split = lambda s: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    w = split(t)
    hit, items = [False] * len(w), set()
    for i, b in BENCH:
        own = split(b)
        for win in {tuple(own[k : k + 10]) for k in range(max(len(own) - 10, 0) + 1)} if own else ():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    items |= set() if i is None else {str(i)}
                    hit[k : k + len(win)] = [True] * len(win)
    return len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), any(hit)


def cut(t):
    """The text without stretches of hit words."""
    if not t:
        return t
    data, out, last = t.encode(), [], None
    places = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))]
    w, hit = [data[a:b].lower() if data[a:b].isascii() else data[a:b].translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for a, b in places], [False] * len(places)
    for _, b in BENCH:
        own = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (b or "").encode().lower())
        for win in {tuple(own[k : k + 10]) for k in range(max(len(own) - 10, 0) + 1)} if own else ():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit[k : k + len(win)] = [True] * len(win)
    gone = bytearray(len(data))
    for k, (a, b) in enumerate(places):
        if hit[k]:
            a = places[k - 1][1] if k and hit[k - 1] else a
            gone[a:b] = b"\1" * (b - a)
    return bytes(x for x, g in zip(data, gone) if not g).decode()


@pytest.mark.parametrize("block", [500_000, 40])
def test_contamination(spark, docs, none, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "SHARD", 1000)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert multi(decontaminate.contamination(docs, bench).collect()) == multi((i, *found(t)) for i, t in ROWS)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and multi(clean.select("doc_id", "text").collect()) == multi((i, cut(t)) for i, t in ROWS)
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_suffix_array():
    for _ in range(40):
        s = np.array([R.randrange(4) for _ in range(R.randint(1, 60))], np.int64)
        assert decontaminate.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())


def test_names_do_not_depend_on_segments(monkeypatch):
    raw = np.frombuffer(R.randbytes(5000), np.uint8)
    at = np.arange(0, 4700, 7)
    want = [hash(raw[a : a + 144].tobytes()) for a in at]
    monkeypatch.setattr(repeats, "SEGMENT", 512)
    got = repeats.names(np.concatenate([raw, raw]), np.concatenate([at, at + 5000]), 144)
    assert (got[: len(at)] == got[len(at) :]).all() and len(set(got.tolist())) == len(set(want))


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, t in ROWS if i is not None], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name.split()[0]))
        docs = spark.read.parquet(str(tmp_path / name.split()[0]))
    kept = {r.doc_id for r in docs.collect()}
    assert {6, 10, 11, 12} <= kept and not kept & {7, 8, 9, 16}
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    end = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in end} == kept
