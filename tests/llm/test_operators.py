"""Every corpus operator against brute force on edge cases: nulls, empty and long texts, ties, repeated rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from windowflow.llm import bpe, editing, html, languages, lines, matroska, neardup, packing, quality, queries, secrets, train_html
from windowflow.llm.graph import components

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(docs, rows, empty):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union_find(links, sets)
    assert len(links) > 5
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_large_group(spark):
    """Copies with many random edits: chains of links, strays, and buckets of more than one tile."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(700):
        w = base.copy()
        for _ in range(r.choice((0, 1, 1, 2, 3, 5))):
            w[r.randrange(60)] = f"e{r.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union_find(links, sets)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(set(want.values())) > 20
    assert got == want


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        errors = []
        for _ in range(40):
            h = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
            k = int(len(h) * share)
            a, b = np.sort(h[: (len(h) + k) // 2]), np.sort(h[(len(h) - k) // 2 :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            equal = (neardup.sketch(a) == neardup.sketch(b)).mean()
            errors.append(neardup.estimate(equal, len(a), len(b)) - true)
        assert abs(np.mean(errors)) < 0.03
    assert neardup.estimate(np.array(1.0), 5.0, 5.0) == 1


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 500 + i) for i in range(1, 300)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(150)]
    nodes = {x for e in edges for x in e}
    want = union_find(edges, nodes)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {n: c for n, c in want.items() if sum(c == d for d in want.values()) > 1}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    got = packing.pack_documents(docs.repartition(3), JSON).collect()
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t, *_ in rows}
    want = Counter((i, len(ids[t])) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    by_doc, by_sequence = defaultdict(Counter), defaultdict(list)
    text_of = {i: t for i, t, *_ in rows if i is not None}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        by_sequence[r.sequence_id].append(r)
        if r.doc_id is not None:
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[text_of[r.doc_id]][r.start : r.start + r.length]
            by_doc[r.doc_id].update(range(r.start, r.start + r.length))
    copies = Counter(i for i, *_ in rows)
    for i, t in text_of.items():
        assert by_doc[i] == {k: copies[i] for k in range(len(ids[t]))}
    waste = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        waste += 0 if at & (at - 1) == 0 else 1024 - at
        assert pieces[0].padding == (0 if at & (at - 1) == 0 else 1024 - at)
    assert waste <= 3 * 1023
    assert packing.pack_documents(empty, JSON).count() == 0


def test_packing_matches_added_tokens_as_the_library_does(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  ", "<|endoftext> <|ENDOFTEXT|> <|end<|endoftext|>", "it's\n<|endoftext|>\n\n we'll", ""]
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = packing.pack_documents(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), JSON).collect()
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    have = defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        have[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert have == want and all(r.doc_tokens == len(want[r.doc_id]) for r in got)


def test_packing_fills_windows_and_balances_steps():
    r = random.Random(2)
    pieces = [packing.Piece(i, 0, np.zeros(r.randint(1, 1023), "<u4"), 0) for i in range(3000)]
    total = sum(len(p.ids) for p in pieces)
    windows = packing.pack_block(pieces)
    used = [(tier, sum(len(p.ids) for p in row)) for tier, row in windows]
    assert sum(n for _, n in used) == total
    assert sum(n < tier for tier, n in used) <= 1
    costs = defaultdict(list)
    for row in packing._Writer(0).rows(windows):
        costs[row[8], row[10]].append(row[2])
    sums = [sum(v) for (tier, _), v in costs.items() if tier == 1024]
    assert max(sums) - min(sums) <= 1024


def base_of(text):
    w = WORD.findall(text or "")
    counts = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {k for i in range(len(w) - 2) if counts[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    ls = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(hit)


def test_quality(spark, docs, rows, empty):
    got = quality.robust_outliers(docs).collect()
    assert len(got) == len(rows)
    seen = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            want = base_of(seen[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
            assert r.base_failed == failed and not (failed and r.kept)
    assert quality.robust_outliers(empty).count() == 0


def test_outliers_are_found_in_every_group(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(4000)]
    made = []
    for i in range(900):
        words = [r.choice(vocabulary) for _ in range(r.randint(60, 300))]
        if i % 25 == 7:
            words = [w + r.choice(("###", "$$$", "|||")) for w in words]
        made.append((i, " ".join(words), "en" if i % 2 else None, "hot" if i < 600 else f"s{i % 3}"))
    rows = quality.robust_outliers(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in rows if not r.kept} == {i for i in range(900) if i % 25 == 7}


def test_outliers_of_every_statistic(spark):
    r = random.Random(12)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(4000)]

    def lines_of(n, words=9):
        return [" ".join(r.choices(vocabulary, k=words)) for _ in range(n)]

    plants = {
        "repeats": lambda: " ".join([*(once := r.choices(vocabulary, k=45)), *r.choices(vocabulary, k=110), *once]),  # 45 % of 200 words
        "dup_lines": lambda: "\n".join(x for line in lines_of(18) for x in ([line, "Read more"] if r.random() < 0.7 else [line])),  # about 40 %
        "word_length": lambda: " ".join(x + "abcde" for x in r.choices(vocabulary, k=200)),
        "symbols": lambda: " ".join(x + "#" * (k % 8 == 0) for k, x in enumerate(r.choices(vocabulary, k=200))),
        # clean: a line twice in a short text
        "": lambda: "\n".join([*(few := lines_of(8)), few[2]]),
    }
    made, planted = [], {}
    for i in range(600):
        name = [*plants][i // 30 % 5] if i % 30 == 7 else None
        made.append((i, plants[name]() if name is not None else "\n".join(lines_of(r.randint(8, 40)))))
        planted[i] = name
    rows = quality.robust_outliers(spark.createDataFrame(made, "doc_id long, text string").withColumn("lang", F.lit("en"))).collect()
    assert not any(r.base_failed for r in rows)
    assert Counter(planted[x.doc_id] for x in rows if not x.kept) == Counter(n for n in planted.values() if n)


def test_html():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
        '<div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>First   paragraph with <b>bold</b> words, and more of them to read.<br>'
        "<p>Second&nbsp;one, which goes on for a while as such things do.<script>var x = '</p>';</script></p></article><aside class=sidebar><p>Related</p></aside>"
        '<div id="comments"><div class="comment"><p>Nice one!</p></div></div><footer>&copy; 2020</footer>'
    )
    text = html.extract([page, None, "", "<", "plain"])
    assert text[0] == "A & B\n\nFirst paragraph with bold words, and more of them to read.\n\nSecond one, which goes on for a while as such things do."
    assert text[1] == text[2] == ""


def test_html_on_pages_held_out_from_training():
    pages = [train_html.sample(s) for s in range(700_000, 700_200)]
    wrong = sum(int((got != (y > 0)).sum()) for (_, y), got in zip(pages, html.label([b for b, _ in pages]), strict=True))
    assert wrong <= 0.005 * sum(len(y) for _, y in pages)


def test_html_frame(spark):
    rows = [(1, "u", "<article><p>Some text that is long enough to be read as text.</p></article>", "x"), (None, None, None, "y"), (1, "u", "", "z")]
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", 49), (None, None, 0), (1, "u", 0)]
    assert html.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_gradients_of_the_labeller():
    """Back-propagation against finite differences."""
    rng = np.random.default_rng(0)
    x, u = rng.normal(size=(2, 5, html.INPUT)), rng.normal(0, 0.2, (html.HIDDEN, 4 * html.HIDDEN))
    w, b, d = rng.normal(0, 0.1, (html.INPUT, 4 * html.HIDDEN)), np.zeros(4 * html.HIDDEN), rng.normal(size=(2, 5, html.HIDDEN))
    _, save = train_html._forward(x, w, u, b)
    gw, gu, gb = train_html._backward(d, save, u)
    for array, grad, at in ((w, gw, (3, 7)), (u, gu, (2, 50)), (b, gb, (11,))):
        array[at] += 1e-5
        up = (train_html._forward(x, w, u, b)[0] * d).sum()
        array[at] -= 2e-5
        down = (train_html._forward(x, w, u, b)[0] * d).sum()
        array[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(grad[at], rel=1e-4, abs=1e-7)


def test_edits(spark, docs, rows, empty, encoding):
    count = lambda t: len(encoding.encode_ordinary(t))
    r = random.Random(4)
    parts = ["don't", " we'll", "  ", "\n", " a", "x", " 123", "!?", " 中文", "'s", " the quick brown fox", "　"]
    for k in range(60):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 300)))
        tree = editing.EditableCount(text, count, leaf=r.choice((8, 20, 64)))
        assert tree.total == count(text)
        for _ in range(25):
            at, gone, new = r.randint(0, len(text)), r.choice((0, 0, 1, 5, 40)), "".join(r.choice(parts) for _ in range(r.randint(0, 4)))
            text = text[:at] + new + text[at + gone :]
            assert tree.edit(at, gone, new) == count(text)
            assert tree.text() == text and tree.length == len(text)
    with_edits = docs.withColumn("edits", editing.sample_edits())
    got = editing.edited_counts(with_edits, RANKS).collect()
    assert len(got) == len(rows)
    for x, (_, t, *_) in zip(got, rows, strict=True):
        t = t or ""
        after, n = t, len(t)
        for at, gone, new in ((n // 4, 0, " (see the note)"), (n // 2, 24, ""), (n * 3 // 4, 7, "isn't 2,048")):
            at = min(at, len(after))
            after = after[:at] + new + after[at + gone :]
        assert (x.n_tokens, x.edited_tokens, x.edited_chars) == (count(t), count(after), len(after))
    long = next(x for x in got if x.n_chars > 100_000)
    assert long.encoded_chars < 10_000
    nulls = docs.withColumn("edits", F.lit(None).cast("array<struct<at:int,deleted:int,inserted:string>>"))
    assert all(x.n_tokens == x.edited_tokens and x.n_edits == 0 for x in editing.edited_counts(nulls, RANKS).collect())
    assert editing.edited_counts(empty.withColumn("edits", editing.sample_edits()), RANKS).count() == 0


def test_bpe(docs, rows, empty, encoding):
    r = random.Random(1)
    letters = list("abstmdrevl '''   \n\t 　é1٣9²!?.😀_ß中文́\r\x00\x85")
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(3000)]
    merged = bpe.Merges(bpe.load_ranks(RANKS))
    for t, (found, where) in zip(texts, bpe.pieces(texts), strict=True):
        assert np.frombuffer(b"".join(map(merged.__getitem__, found)), "<u4").tolist() == encoding.encode_ordinary(t)
        assert [t.encode()[s : s + len(p)] for s, p in zip(where.tolist(), found, strict=True)] == found
    got = bpe.decode_documents(bpe.encode_documents(docs, RANKS), RANKS).collect()
    for x, (i, t, *_) in zip(got, rows, strict=True):
        assert x.doc_id == i and x.decoded.decode() == (t or "")
        assert np.frombuffer(x.ids, "<u4").tolist() == encoding.encode_ordinary(t or "")
    assert bpe.encode_documents(empty, RANKS).count() == 0


def test_scan_is_the_plain_walk():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 5000, 300_000):
        f = rng.integers(0, 256, n, dtype=np.uint8)
        s, want = 0, []
        for c in f.tolist():
            s = c >> 2 * s & 3
            want.append(s)
        assert bpe.scan(f).tolist() == want


def test_matroska(docs, rows, empty):
    stored = matroska.store_media(docs)
    got = matroska.read_media(stored).collect()
    for x, (i, t, *_) in zip(got, rows, strict=True):
        raw = (t or "").encode()
        assert x.doc_id == i and x.n_bytes == len(raw)
        assert x.payload == raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    table = matroska.packet_table(stored.filter("n_bytes > 50000")).collect()
    one = [p for p in table if p.doc_id == table[0].doc_id]
    assert [p.timestamp for p in one] == [128 * k for k in range(len(one))]
    assert matroska.read_media(matroska.store_media(empty)).count() == 0


def test_matroska_lacing_unknown_sizes_and_damage():
    e = matroska._element
    frames = [b"a" * 300, b"b" * 5, b"c" * 700]
    xiph = struct.pack(">BhB", 0x82, 7, 0x02) + bytes([2, 255, 45, 5]) + b"".join(frames)
    fixed = struct.pack(">BhB", 0x81, -2, 0x04) + bytes([1]) + b"xxyy"
    cluster = e(matroska.TIMESTAMP, b"\x64") + e(matroska.BLOCK_GROUP, e(matroska.BLOCK, xiph)) + e(matroska.SIMPLE_BLOCK, fixed) + e(0xEC, b"void")
    head = matroska._HEADER + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7  # unknown size
    body = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + cluster  # unknown size again
    data = head + body + e(matroska.CLUSTER, e(matroska.TIMESTAMP, b"\xc8") + matroska._block(0, frames))
    media = matroska.read(data)
    parts = [(p.track, p.timestamp, data[p.start : p.start + p.length], p.lacing) for p in media.packets]
    assert parts == [(2, 107, f, 1) for f in frames] + [(1, 98, b"xx", 2), (1, 98, b"yy", 2)] + [(1, 200, f, 3) for f in frames]
    whole = matroska.write(bytes(range(256)) * 200)
    assert len(matroska.read(whole).cues) == 2
    for bad in (whole[:-3], whole[:40] + b"\x00" + whole[41:]):
        with pytest.raises(ValueError):
            matroska.read(bad)


def test_languages(spark, docs, rows, empty):
    r = random.Random(6)
    tongues = {"aa": "ka lo mi ne tu sa ri po".split(), "bb": "sch ung ein ver ach tz ung".split(), "cc": "été eau oui ais ère ux".split()}
    made = [(i, " ".join("".join(r.choices(tongues[k], k=r.randint(1, 3))) for _ in range(r.randint(5, 60))), k) for i, k in enumerate(sorted(tongues) * 60)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = languages.learn(df.filter("doc_id % 2 = 0"))
    got = languages.identify(df.filter("doc_id % 2 = 1"), model).collect()
    assert sum(x.lang == x.lang_pred for x in got) >= 0.98 * len(got)
    edge = languages.identify(docs, model).collect()
    assert len(edge) == len(rows)
    for x, (i, t, *_) in zip(edge, rows, strict=True):
        assert x.doc_id == i and 0 <= x.score <= 1
        assert (x.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert all(x.lang_pred == "und" for x in languages.identify(docs, {}).collect())
    assert languages.learn(empty) == {} and languages.identify(empty, model).count() == 0
    text = made[0][1]
    at, n = languages.counts(text)
    assert languages.vector(text) == pytest.approx(plain_vector(text))
    assert n.sum() == len(" ".join(text.split())) and len(at) == len(n)
    sums = defaultdict(lambda: np.zeros(languages.DIMENSIONS))
    for i, t, k in made:
        if i % 2 == 0:
            sums[k] += plain_vector(t)
    for k, v in model.items():
        assert v == pytest.approx(sums[k] / np.linalg.norm(sums[k]), abs=1e-9)
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for x in got:
        assert x.lang_pred == max(sorted(model), key=lambda k: cosine(model[k], plain_vector(x.text)))


def plain_vector(text):
    """Trigram by trigram over the letters and the gaps between words."""
    cells = [0] + [ord(c.lower()[0]) for c in " ".join("".join(c if c.isalpha() else " " for c in text).split()).replace(" ", "\0")] + [0]
    out = np.zeros(languages.DIMENSIONS)
    for a, b, c in zip(cells, cells[1:], cells[2:], strict=False):
        out += np.roll(languages.item(a).astype(float), 2) * np.roll(languages.item(b), 1) * languages.item(c)
    return out


def test_languages_of_one_other_script(spark):
    """Two languages that differ in Cyrillic letters alone, and one in Chinese; more letters than are held."""
    r = random.Random(7)
    tongues = {"bg": "ъще аз бях тук щом".split(), "ru": "ыне эти ёлк был тут".split(), "zh": list("的一是不了人我在有他这为之大来以个中上们")}
    made = [(i, " ".join("".join(r.choices(tongues[k], k=2)) for _ in range(30)), k) for i, k in enumerate(sorted(tongues) * 30)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = languages.identify(df.filter("doc_id % 2 = 1"), languages.learn(df.filter("doc_id % 2 = 0"))).collect()
    assert all(x.lang == x.lang_pred for x in got)
    many = "".join(map(chr, range(0x4E00, 0x9000)))
    assert languages.vector(many) == pytest.approx(plain_vector(many))
    assert languages._items().n <= languages.HELD
    assert languages.vector("ba") == pytest.approx(plain_vector("ba"))


def dedup(rows, least=10):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    first, holders = {}, defaultdict(set)
    last = 1 << 63
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                first[key(x)] = min(first.get(key(x), last), last if i is None else i)
                holders[key(x)].add(i)
    out = []
    for i, t, *_ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < least or len(holders[key(x)]) < 2 or first[key(x)] == (last if i is None else i)]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return Counter(out)


def test_lines(docs, rows, empty):
    got = Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(docs).collect())
    assert got == dedup(rows)
    assert sum(d for *_, d in got) > 3
    assert lines.dedup_lines(empty).count() == 0
    three = lines.dedup_lines(docs, min_docs=1000).collect()
    assert all(r.n_dropped == 0 for r in three)


def test_secrets(docs, rows, empty):
    got = secrets.scan_secrets(docs, RANKS).collect()
    for x, (i, t, *_) in zip(got, rows, strict=True):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        own = [(s.start, secrets.KINDS.index(s.kind), s.end) for s in x.spans]
        assert x.doc_id == i and [s for s in own if s[1] < 3] == sorted(want) and own == sorted(own)
    added = [rows[k][1][s.start : s.end] for k, x in enumerate(got) for s in x.spans if s.kind == "random"]
    assert "aGVsbG8gd29ybGQ0NTY3ODkwMTIzNDU2Nzg5MDEy" in added
    assert not any("426614174000" in a or "d41d8cd9" in a for a in added)
    clean = secrets.redact_secrets(docs, RANKS)
    assert clean.columns == docs.columns
    text = [r.text for r in clean.collect()]
    assert text[5] is None and text[0] == rows[0][1] and "hunter2" not in text[17] and "AKIA" not in text[17]
    assert secrets.scan_secrets(empty, RANKS).count() == 0
    assert secrets._redacted("ab SECRETS cd", [(3, 0, 8), (5, 1, 10)], "#") == "ab # cd"


def test_random_keys_are_found_and_words_left_alone():
    r = random.Random(8)
    small, tokens_of = "abcdefghijklmnopqrstuvwxyz", bpe.encoder(RANKS).tokens

    def share(alphabet, n, frame="{}"):
        hit = 0
        for _ in range(300):
            key = "".join(r.choices(alphabet, k=n))
            text = frame.format(key)
            spans = secrets.random_spans(text, tokens_of, 2.2)
            hit += any(s <= text.index(key) + 1 and e >= text.index(key) + n - 1 for s, _, e in spans)
        return hit / 300

    base36, base62 = small + "0123456789", small + small.upper() + "0123456789"
    assert min(share(base36, n) for n in (16, 20, 24, 32, 64)) >= 0.95
    assert min(share(small, 24), share(small, 32), share(small + small.upper(), 20), share(small.upper(), 24)) >= 0.9
    path = "see /usr/local/share/application/configuration/{}/settings/production/database/connection for it"
    assert min(share(base36, 24, path), share(base62, 24, path)) >= 0.95
    # its own separators may cut a key to pieces
    assert share(base62 + "_-", 40, path) >= 0.8
    names = """getElementByIdAndClass2 user_account_settings_v2 org/apache/commons/lang3/StringUtils kubernetes-deployment-7d4b9c
        linux-x86_64-gnu-gcc12 AbstractSingletonProxyFactoryBean to-be-or-not-to-be-that-is backup-2024-01-01-12-30-00-v2 internationalization2
        2024-01-01T00-00-00-000000Z 20240101T000000Z 2024-01-01_12-30-00 1999/12/31T23-59-59+0100 rechtsschutzversicherungsgesellschaften covid19_cases_2020_2021 ACGTACCTGATTACAGGTCA 2994256256331784
        data/objects/d41d8cd98f00b204e9800998ecf8427e 123e4567-e89b-12d3-a456-426614174000""".split()
    assert [x for x in names if secrets.random_spans(x, tokens_of, 2.2)] == ["data/objects/d41d8cd98f00b204e9800998ecf8427e"]  # as a whole, as before


def test_queries_return_the_contracts_columns(spark):
    want = {
        "op1": "component_id doc_id kept n_shingles", "op2": "doc_id doc_tokens ids_crc32 length offset sequence_id start",
        "op3": "base_failed doc_id kept n_dup_lines n_repeat_words n_symbols n_words word_chars", "op4": "n_chars page_id text url", "op5": "doc_id n_tokens",
        "op6": "decoded_sha256 doc_id ids_sha256 n_tokens", "op7": "doc_id feature media_bytes media_sha256 n_bytes payload_bytes payload_sha256 tail_crc32",
        "op8": "doc_id held_out lang_pred score", "op9": "doc_id kept_sha256 n_dropped n_lines", "op10": "base_sha256 doc_id n_access n_assign n_hex spans",
    }
    for name, f in queries.queries().items():
        if name.startswith("op"):
            df = f(spark, "/root/testdata/sf0.001")
            assert set(want[name.split("_")[0]].split()) <= set(df.columns), name


def test_digests(spark, encoding):
    path = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op6_byte_level_bpe(spark, path).collect():
        ids = encoding.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text[r.doc_id].encode()))
    for r in queries.op7_matroska_media(spark, path).collect():
        raw = text[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        media = matroska.write(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), sha(media)) and r.feature
    for r in queries.op10_secret_scans(spark, path).collect():
        base = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in secrets.base_spans(text[r.doc_id]))
        assert r.base_sha256 == sha(base.encode())
    held = {r.doc_id: r.held_out for r in queries.op8_language_id(spark, path).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in text}


def test_vocabulary_of_the_json_file():
    assert bpe.load_vocabulary(JSON) == bpe.load_ranks(RANKS)
