"""Hot groups, very long and damaged inputs, other scripts, and independent versions of what the operators compute."""

import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_operators import JSON, RANKS, shingles, union_find

from windowflow.llm import bpe, editing, graph, html, matroska, neardup, packing, quality, secrets, train_html


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


# --- near-duplicates


def test_strays_in_buckets_of_several_blocks(spark, monkeypatch):
    """A large component with strays, and a crowd that shares much of its text without being linked, in small blocks and parts."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "PART", 2000)
    r = random.Random(13)
    base, template, texts = [f"w{i}" for i in range(80)], [f"t{i}" for i in range(60)], []
    for _ in range(250):
        w = base.copy()
        for _ in range(r.choice((0, 1, 1, 2, 2, 3, 4))):
            w[r.randrange(80)] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(template + [f"u{i}x{k}" for k in range(r.choice((14, 20, 40)))]) for i in range(120)]
    r.shuffle(texts)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union_find(links, sets)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert 3 < len(set(want.values())) < len(texts)
    assert got == want


def test_hubs_are_split(spark, monkeypatch):
    """The join of a round of components is one that Spark splits at run time: both of its sides are plain shuffles."""
    plans, write = [], graph.durable

    def keep(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(graph, "durable", keep)
    skew = "spark.sql.adaptive.skewJoin.skewedPartition"
    low = {
        f"{skew}ThresholdInBytes": "1k", f"{skew}Factor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        edges = spark.range(1, 60_000, numPartitions=6).select(F.lit(0).cast("long").alias("x"), F.col("id").alias("y"))
        got = graph.components(edges, "x", "y").agg(F.count("*"), F.max("component")).first()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert tuple(got) == (60_000, 0)
    assert any("skew=true" in p for p in plans)


def test_words_of_long_texts_are_read_in_parts(monkeypatch):
    r = random.Random(0)
    text = "".join("".join(r.choices("abcdeé中", k=r.randint(1, 9))) + r.choice((" ", "\n", " \x0b")) for _ in range(5000))
    whole = neardup.shingles(text, neardup._Hashes())
    monkeypatch.setattr(neardup, "CHUNK", 100)
    assert (neardup.shingles(text, neardup._Hashes()) == whole).all() and len(whole) == len(shingles(text))


# --- tokens

LONG_SPACE = {"spaces": " " * 3_000_000, "newlines": "a\n" + "\n" * 3_000_000 + "b", "mixed": "x" + " \n" * 700_000 + "\t<|endoftext|>  y"}


@pytest.mark.parametrize("name", sorted(LONG_SPACE))
def test_long_white_space_is_encoded(name, encoding):
    """Millions of white space characters, on which the compiled pattern would run out of stack."""
    from tokenizers import Tokenizer

    text = LONG_SPACE[name]
    assert packing.load_encoder(JSON)(text) == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids
    ids = bpe.encoder(RANKS).encode(text)
    assert bpe.encoder(RANKS).library.decode_bytes(ids).decode() == text
    short = re.sub(r"\s{200000,}", lambda m: m[0][:200_000], text)
    assert bpe.encoder(RANKS).encode(short) == encoding.encode_ordinary(short)
    tree = editing.EditableCount(text, lambda t: len(bpe.encoder(RANKS).encode(t)))
    assert tree.total == len(ids)
    assert secrets.all_spans(text, bpe.encoder(RANKS).tokens, 2.2) == []


def test_chunks_have_the_pretokens_of_the_whole(encoding):
    r = random.Random(21)
    letters = list("abstmdrevl '̀'\"' \n\t 　é1٣9²!?.😀_ß中文\r\x00\x85\x1c")
    for _ in range(300):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 400)))
        parts = list(bpe.chunks(text, r.choice((1, 5, 30))))
        assert "".join(parts) == text
        assert [i for p in parts for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)
        for p in bpe.cuts(text).tolist():
            assert encoding.encode_ordinary(text[:p]) + encoding.encode_ordinary(text[p:]) == encoding.encode_ordinary(text)


def test_long_texts_are_scanned_in_parts(monkeypatch, encoding):
    r = random.Random(22)
    text = "".join(r.choice(("don't", " we'll", "  ", "\n", " a", "x", " 123", "!?", " 中文", "'s", "　")) for _ in range(3000))
    monkeypatch.setattr(bpe, "SCAN", 200)
    merged = bpe.Merges(bpe.load_ranks(RANKS))
    (found, where), (other, _) = bpe.pieces([text, "a b"])
    assert np.frombuffer(b"".join(map(merged.__getitem__, found)), "<u4").tolist() == encoding.encode_ordinary(text)
    assert [text.encode()[s : s + len(p)] for s, p in zip(where.tolist(), found, strict=True)] == found and other == [b"a", b" b"]


@pytest.mark.parametrize("letters", ["abcdefghij", "абвгдежзик", "的一是不了人我在有他", "नमस्तेकखगघ"])
def test_edits_stay_local_in_every_script(letters, encoding):
    r = random.Random(14)
    gap = "，" if letters[0] == "的" else " "
    text = gap.join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(14_000))
    tree = editing.EditableCount(text, lambda t: len(encoding.encode_ordinary(t)))
    for _ in range(5):
        tree.encoded, at = 0, r.randrange(len(text))
        new = "".join(r.choices(letters, k=5))
        text = text[:at] + new + text[at + 3 :]
        assert tree.edit(at, 3, new) == len(encoding.encode_ordinary(text))
        assert tree.encoded < 2000


# --- outliers


def numpy_mcd(x, share=0.75):
    """The smallest determinant from the same kinds of starts, with real subsets of the nearest documents and no grid."""
    floors = np.array(quality.FLOORS)
    h = int(np.ceil(share * len(x)))
    m = np.median(x, axis=0)
    d = np.maximum(np.subtract(*np.quantile(x, (0.75, 0.25), axis=0)) / 1.349, floors)
    z = (x - m) / d
    sign = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    flat = np.cov(np.tanh(z).T, bias=True)
    around = flat / np.sqrt(np.maximum(np.outer(flat.diagonal(), flat.diagonal()), 1e-300))
    np.fill_diagonal(around, 1)
    covs = [np.diag(d**2), np.outer(d, d) * around, np.outer(d, d) * (sign.T @ sign / len(x)) * 4, np.cov(x.T, bias=True)]
    found = []
    for k, c in enumerate(covs):
        centre, c = (x.mean(axis=0) if k == 3 else m), c + np.diag(floors**2)
        for _ in range(100):
            q = x - centre
            own = x[np.argsort((q @ np.linalg.inv(c) * q).sum(axis=1), kind="stable")[:h]]
            centre, c = own.mean(axis=0), np.cov(own.T, bias=True) * quality.consistency(share) + np.diag(floors**2)
        found.append((np.linalg.slogdet(c)[1], centre, c))
    return min(found, key=lambda f: f[0])


def test_estimates_lean_on_all_documents(spark):
    r = np.random.default_rng(4)
    own, whole = (np.cov(r.normal(size=(4, 40)) * 0.3) + np.diag(np.square(quality.FLOORS)) for _ in range(2))
    centres = r.normal(size=(2, 4))

    def row(g, centre, cov):
        low = np.linalg.cholesky(cov)
        return (g, *centre.tolist(), *[float(low[i, j]) for i, j in quality._PAIRS], float(np.linalg.slogdet(cov)[1]))

    estimates = spark.createDataFrame([row("a", centres[0], own), row("b", centres[0], own), row("", centres[1], whole)], ["g", *quality._ESTIMATE])
    got = {x.g: x for x in quality.regularised(estimates, spark.createDataFrame([("a", 3), ("b", 10**6)], "g string, n long")).collect()}
    assert set(got) == {"a", "b"}
    for g, n in (("a", 3), ("b", 10**6)):
        cov = (n * own + 50 * whole) / (n + 50)
        assert np.allclose([got[g][f"m{i}"] for i in range(4)], (n * centres[0] + 5 * centres[1]) / (n + 5))
        assert np.allclose([got[g][f"l{i}{j}"] for i, j in quality._PAIRS], [np.linalg.cholesky(cov)[i, j] for i, j in quality._PAIRS])


def test_small_groups_are_judged_like_large_ones(spark):
    r = random.Random(21)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(3000)]
    sizes = {"one": 1, "few": 6, "below": 49, "above": 51, "many": 400}
    made, planted = [], set()
    for source, n in sizes.items():
        for k in range(n):
            words = r.choices(vocabulary, k=r.randint(60, 200))
            if k % 20 == 5:
                words = [w + "#|" for w in words]
                planted.add(len(made))
            made.append((len(made), " ".join(words), "en", source))
    rows = quality.robust_outliers(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).collect()
    assert {x.doc_id for x in rows if not x.kept} == planted


def test_least_determinant_is_that_of_numpy(spark):
    rng = np.random.default_rng(17)
    groups, rows = {}, []
    for g, n in (("a", 4000), ("b", 900)):
        mix = rng.normal(0, 0.35, (4, 4)) + np.eye(4) * 0.5
        x = rng.normal(size=(n, 4)) @ mix + rng.normal(size=4)
        bad = rng.random(n) < 0.15
        x[bad] = rng.normal(size=(int(bad.sum()), 4)) * 0.3 + 6
        groups[g] = x
        rows += [(g, i % quality.SALTS, *map(float, v)) for i, v in enumerate(x)]
    schema = "g string, salt int, " + ", ".join(f"{f} double" for f in quality.FEATURES)
    got = {r.g: r for r in quality.least_determinant(spark.createDataFrame(rows, schema)).collect()}
    for g, x in groups.items():
        det, centre, cov = numpy_mcd(x)
        r = got[g]
        low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        own = np.array([r[f"m{i}"] for i in range(4)])
        assert abs(r.det - det) < 0.05
        assert own == pytest.approx(centre, abs=0.05)
        assert low @ low.T == pytest.approx(cov, abs=0.08 * np.abs(cov).max())
        near = lambda m, c: ((x - m) @ np.linalg.inv(c) * (x - m)).sum(axis=1) <= quality.CHI_SQUARE
        assert (near(own, low @ low.T) == near(centre, cov)).mean() > 0.998
    assert quality.consistency(0.75) == pytest.approx(1.4865, abs=1e-3)


# --- pages


def test_labels_are_those_of_plain_loops(monkeypatch):
    """The network written out one block, one gate at a time; long pages in stretches give the same."""
    w, page = html.model(), train_html.sample(31)[0] + train_html.sample(32)[0]
    n, hidden = len(page), html.HIDDEN

    def features(i, b):
        x = [float(b.path >> k & 1) for k in range(html.PATH_DIMS)] + [0.0] * html.WORD_DIMS
        words = b.text.lower().split()
        for word in words:
            x[html.PATH_DIMS + zlib.crc32(word.strip(".,;:!?()\"'").encode()) % html.WORD_DIMS] += 1 / len(words)
        size = len(b.text)
        return np.array([*x, np.log1p(size) / 5, min(1, b.link_chars / size), sum(c in ".,;!?" for c in b.text) * 10 / size, i / n, 1 / n, size < 30])

    def walk(order, names, v):
        h, c, out = np.zeros(hidden), np.zeros(hidden), {}
        for i in order:
            z = features(i, page[i]) @ w[names[0]] + h @ w[names[1]] + w[names[2]]
            take, forget, give = (1 / (1 + np.exp(-z[k * hidden : (k + 1) * hidden])) for k in range(3))
            c = forget * c + take * np.tanh(z[3 * hidden :])
            h = give * np.tanh(c)
            out[i] = h @ v
        return out

    one, other = walk(range(n), ("wf", "uf", "bf"), w["v"][:hidden]), walk(range(n - 1, -1, -1), ("wb", "ub", "bb"), w["v"][hidden:])
    want = np.array([one[i] + other[i] + w["c"] for i in range(n)])
    own = lambda pages, whole: html._scores(pages, whole, w, True)[0] + html._scores(pages, whole, w, False)[0][::-1] + w["c"]
    assert own([page], None) == pytest.approx(want, abs=1e-3)
    assert own([page], [html.encode(page)]) == pytest.approx(want, abs=1e-3)
    monkeypatch.setattr(html, "STRETCH", 6)
    assert own([page, page[:2]], None) == pytest.approx(want, abs=1e-3)


def test_labeller_reads_every_word():
    a, b = (html.encode([html.Block(0, "same " * 100 + last, 0)]) for last in ("one", "two"))
    assert (a[:, html.PATH_DIMS : html.PATH_DIMS + html.WORD_DIMS] != b[:, html.PATH_DIMS : html.PATH_DIMS + html.WORD_DIMS]).any()


def test_deep_and_long_pages():
    tracemalloc.start()
    deep = html.extract(["<div class='a b c'>" * 100_000 + "<article><p>A text that is long enough to be read.</p>" + "</p></div>" * 100_000])
    assert tracemalloc.get_traced_memory()[1] < 60e6 and len(deep) == 1
    tracemalloc.stop()
    many = html.extract(["<article>" + "<p>Some words of a paragraph, that go on for a while.</p>" * 20_000 + "</article>"])
    assert many[0].count("Some words") == 20_000


HAND = (
    (
        "<body><header><a href=/>Site</a></header><div id=main><h2>One title</h2><p>The first paragraph says a few things, as first ones do.</p>"
        "<div class='share-buttons'><a href=#>Tweet</a></div><p>The second one goes on about them, and then it ends.</p></div>"
        "<section class=related><h3>Related posts</h3><ul><li><a href=/x>Another title</a></li></ul></section></body>",
        ["One title", "The first paragraph says a few things, as first ones do.", "The second one goes on about them, and then it ends."],
    ),
    (
        "<nav><a href=/a>Home</a> <a href=/b>About</a></nav><main><article><h1>T</h1><p>Words, words and more words stand here in a row.</p><ul><li>a point</li>"
        "<li>another point</li></ul></article></main><form class=newsletter><label>Email</label><input><button>Subscribe</button></form><footer><p>Copyright 2020</p></footer>",
        ["T", "Words, words and more words stand here in a row.", "a point", "another point"],
    ),
)


@pytest.mark.parametrize(("page", "want"), HAND)
def test_hand_labelled_pages(page, want):
    assert html.extract([page])[0].split("\n\n") == want


# --- media


def elements(data, at, end):
    """A plain reader of EBML elements of known sizes: (id, body's start, body's end)."""
    out = []
    while at < end:
        k = 9 - data[at].bit_length()
        ident, at = int.from_bytes(data[at : at + k], "big"), at + k
        k = 9 - data[at].bit_length()
        size, at = int.from_bytes(data[at : at + k], "big") & (1 << 7 * k) - 1, at + k
        out.append((ident, at, at + size))
        at += size
    return out


@pytest.mark.parametrize("n", [64, 1024, 1088, 8192, 50_048])
def test_stored_form_by_a_plain_reader(n):
    payload = random.Random(n).randbytes(n)
    data = matroska.write(payload)
    assert data[:4].hex() == "1a45dfa3" and b"matroska" in data[:50]
    _, s, e = next(x for x in elements(data, 0, len(data)) if x[0] == 0x18538067)
    got, frames, clusters = b"", 0, 0
    for ident, a, b in elements(data, s, e):
        if ident != 0x1F43B675:
            continue
        clusters += 1
        for kind, x, y in elements(data, a, b):
            if kind != 0xA3:
                continue
            flags = data[x + 3]
            if not flags & 6:
                got, frames = got + data[x + 4 : y], frames + 1
                continue
            count, at = data[x + 4] + 1, x + 5
            frames += count
            for _ in range(count - 1 if flags & 6 == 6 else 0):  # the sizes of an EBML lace; its frames lie end to end behind them
                at += 9 - data[at].bit_length()
            got += data[at:y]
    assert got == payload and frames == -(-n // 1024)
    said = dict(x.split("=") for x in matroska.features(payload, matroska.read(data)).split(";"))
    share = np.array([c / n for c in Counter(payload).values()])
    assert [int(said[k]) for k in ("packets", "clusters", "cues", "ms")] == [frames, clusters, clusters, round(n / 8)]
    assert float(said["mean"]) == pytest.approx(sum(payload) / n, abs=1e-3) and float(said["entropy"]) == pytest.approx(-(share * np.log2(share)).sum(), abs=1e-3)


def test_times_and_floats_of_other_writers():
    e, u = matroska._element, matroska._uint

    def track(n, codec, *more):
        return e(matroska.TRACK_ENTRY, u(matroska.TRACK_NUMBER, n) + u(matroska.TRACK_TYPE, 2) + e(matroska.CODEC, codec) + b"".join(more))

    audio = e(matroska.AUDIO, e(matroska.RATE, struct.pack(">f", 1000.0)) + u(matroska.CHANNELS, 2) + u(matroska.DEPTH, 16))
    tracks = track(1, b"A_OPUS", u(matroska.DEFAULT_DURATION, 25_000_000)) + track(2, b"A_OPUS") + track(3, b"A_PCM/INT/LIT", audio)
    lace = lambda n, at: struct.pack(">BhBB", 0x80 | n, at, 0x04, 1) + b"x" * 80
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, lace(2, 20)) + u(matroska.BLOCK_DURATION, 300))
    info = e(matroska.INFO, u(matroska.TIMESTAMP_SCALE, 100_000) + e(matroska.DURATION, struct.pack(">f", 5000.0)))
    cluster = e(matroska.CLUSTER, u(matroska.TIMESTAMP, 5000) + e(matroska.SIMPLE_BLOCK, lace(1, 0)) + group + e(matroska.SIMPLE_BLOCK, lace(3, 100)))
    media = matroska.read(matroska._HEADER + e(matroska.SEGMENT, info + e(matroska.TRACKS, tracks) + cluster))
    assert media.duration == 500 and media.tracks == [(1, 2, "A_OPUS"), (2, 2, "A_OPUS"), (3, 2, "A_PCM/INT/LIT")]
    # ticks of 0.1 ms; a default duration of 25 ms; a block of 30 ms; 40 bytes at 4 bytes a ms
    assert [(p.track, p.timestamp) for p in media.packets] == [(1, 500), (1, 525), (2, 502), (2, 517), (3, 510), (3, 520)]


def test_damaged_media_dont_end_the_job(spark):
    whole = matroska.write(b"abcd" * 1000)
    bad = [whole[:-3], whole[: len(whole) // 2], b"", b"\x00", b"\x1a", whole[:60]]
    r = random.Random(3)
    for _ in range(200):
        x = bytearray(whole)
        x[r.randrange(len(x))] ^= 1 << r.randrange(8)
        bad.append(bytes(x))
    stored = spark.createDataFrame([(i, b if b is None else bytearray(b), "k") for i, b in enumerate([whole, None, *bad])], "doc_id long, media binary, packet string")
    got = matroska.read_media(stored).collect()
    assert len(got) == len(bad) + 2 and bytes(got[0].payload) == b"abcd" * 1000 and (got[1].payload, got[1].feature) == (None, None)
    assert all((x.payload is None) == x.feature.startswith("damaged: ") for x in got[2:])
    assert got[2].feature.startswith("damaged: ") and bytes(got[4].payload) == b""
    assert 0 in {p.doc_id for p in matroska.packet_table(stored).collect()}
