"""Near duplicates, top-k search, packing, WARC and the codecs against brute force and round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brickwork.llm import near_dup, packing, piece_bpe, token_codec, topk_search, warc, word_ids
from brickwork.llm.components import components

DOCS = "doc_id long, text string, n int, bands string, id int"
ODD = ["", " ", "  a  b ", "a   b", "\n\n x", "▁▁a ▁", "漢字かな😀 é́", "aaaa" * 9, "\u0000​ x", "<s> <|endoftext|> z", "don't  stop", "x\t y \n z"]


def brute_groups(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(near_dup.LOWER).split()
        sets.setdefault(i, set()).update([tuple(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    texts = family(rng, 60, 120, 9) + family(rng, 20, 40, 5) + [None, "", "  ", "one two", "One  TWO", "one two three", "the same text here again"] * 2
    texts += [texts[0]] * 5 + [f"only {i} of its kind in here" for i in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, width=4, percent=80, block=16).collect()}
    assert got == brute_groups(rows, 4, 80)


def test_near_duplicates_among_look_alikes(spark):
    """More than 3,000 documents that share bands but are mostly not linked, against all pairs."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for i in range(3100):
        w = list(base)
        for at in rng.sample(range(90), 4):
            w[at] = f"x{rng.randrange(10**7)}"
        texts.append(" ".join(w))
    for i in range(60):  # these have links
        w = texts[i].split()
        w[rng.randrange(90)] = "y"
        texts.append(" ".join(w))
    sets = [near_dup.shingle_set(t, 4, near_dup._WordHashes()) for t in texts]
    common, count = np.unique(np.concatenate(sets), return_counts=True)
    common = common[count > 1]
    has = np.stack([np.isin(common, s) for s in sets]).astype(np.float32)
    both, n = has @ has.T, np.array([len(s) for s in sets])
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in np.argwhere(100 * both >= 80 * (n[:, None] + n[None] - both)).tolist():
        if a < b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, width=4, percent=80, block=200).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and 2000 < len(set(got.values())) < len(texts)


def test_near_duplicates_by_shuffled_join(spark):
    rows = [(i, t) for i, t in enumerate(family(random.Random(5), 12, 60, 4))]
    df = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, width=5, broadcast_rows=0).collect()}
    assert got == brute_groups(rows, 5, 80)


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e f", 0, "", 1), (None, "a b c d e f", 0, "", 1), (7, "a b c d e f", 0, "", 1), (7, "a b c d e f", 0, "", 1), (9, None, 0, "", 1)]
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(-1, None, True), (-1, None, True), (7, 7, True), (7, 7, True), (9, 9, True)]
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_bitmap_bound_never_loses_a_link():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)]))
        bits = [np.unpackbits(np.frombuffer(near_dup.bitmap(x), np.uint8)) for x in (a, b)]
        assert (bits[0] != bits[1]).sum() <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (200, 199), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 199: 199, 200: 199}


def brute_top_k(rows, k, every):
    vectors = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in vectors:
        if q % every == 0:
            scored = sorted((-max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in vectors if i != q and len(b) == len(a))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("bins,block,tile", [(4, 100, 3), (1024, 32 << 20, 4)])
def test_top_k_equals_brute_force(spark, bins, block, tile):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(90)]
    rows += [(200 + i, [1.0, 0.0, 0.5, 0.0]) for i in range(60)]  # ties
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan"), 0.0, 0.0, 1.0]), (304, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (320, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")
    got = sorted(map(tuple, topk_search.top_k(df, k=7, bins=bins, block_bytes=block, tile=tile, step=32).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top_k(rows, 7, 20)


@pytest.mark.parametrize("size", [1e5, 3e6, 2e7, 4e9, 1e25, 3e38])
def test_top_k_of_large_components(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(30)]
    rows += [(40 + i, [float(np.float32(size * x)) for x in rng.normal(size=8)]) for i in range(12)] + [(60, [0.0] * 7 + [float(np.float32(size))]), (61, [0.0] * 8), (80, [float(np.float32(-size))] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk_search.top_k(df, k=6, step=16).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top_k(rows, 6, 20)


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk_search.top_k(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(20, [1.0]), (1, [2.0]), (20, [3.0])], schema)
    assert sorted(map(tuple, topk_search.top_k(few).select("query_id", "rank", "vec_id", "score").collect())) == [(20, 1, 1, 8192), (20, 1, 1, 24576)]


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma,", "delta\n"]) for _ in range(rng.choice([3, 50, 200, 900, 3000]))) for _ in range(60)] + ODD + [None, "same", "same"]
    df = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in enumerate(texts)], DOCS).repartition(5)
    packed = packing.pack_documents(df, path, with_ids=True)
    rows = packed.collect()
    tokenizer = Tokenizer.from_file(path)
    total, got = 0, {(r.doc_id, r.piece): r for r in rows}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        pieces = [got[i, k] for k in range(-(-len(ids) // 1024))]
        assert [x for p in pieces for x in np.frombuffer(p.ids, "<u4").tolist()] == ids
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1].tolist()]
        assert all(p.length == 1024 for p in pieces[1:]) and all(p.ids_crc32 == zlib.crc32(p.ids) for p in pieces)
    assert len(got) == len(rows)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for s in whole.values():
        parts = sorted((r.offset, r.length, bytes(r.ids)) for r in rows if r.sequence_id == s.sequence_id)
        assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1].tolist()]
        assert s.length == sum(p[1] for p in parts) <= 1024 and b"".join(p[2] for p in parts) == bytes(s.ids)
    assert len(whole) <= -(-total // 1024) + 2
    assert packing.pack_documents(spark.createDataFrame([], DOCS), path).count() == 0


def test_best_fit_keeps_sizes():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1025, 3000)
    where, offset, fill = packing.best_fit(sizes, 1024)
    assert np.bincount(where, sizes).tolist() == fill and max(fill) <= 1024 and len(fill) <= 1.03 * sizes.sum() / 1024


def test_word_ids_equal_the_tokenizer():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeE  \n\t.,'12é漢　 \x1c\x0b😀Σσ-×ñ\u0338=<|>_\u0301’") for _ in range(rng.randrange(50))) for _ in range(3000)] + ODD
    words = ["foo", "it's", "x.", "<|endoftext|>", "<|startoftext|>", "Ñandú,", "\n", "\n\n", "  ", "'s", "é's", "K9$", ".\n", "’", "\u00a0", "\u0085", "\u2009", "ß!", "×.", "Ω.", "12,3", "ÀÉÞ"]
    texts += ["".join(rng.choice(words) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        got = [np.frombuffer(b, "<u4").tolist() for b in word_ids.WordIds(path, most=500).encode(texts)]
        assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.PieceBPE(path)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdethisnoa  \n.▁é漢1") for _ in range(rng.randrange(60))) for _ in range(2000)] + ODD + ["ab" * 5000]
    assert [np.frombuffer(a, "<i4").tolist() for a, _ in own.encode(texts)] == library.encode(texts)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 260), rng.randrange(32000), rng.randrange(3)]) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(ids, int)) == library.decode(ids)
    df = spark.createDataFrame([(1, None, 0, "x", 1), (2, "Hello  world", 0, "x", 1), (None, "", 0, "x", 1)], DOCS)
    rows = {r.doc_id: r for r in piece_bpe.encode_decode(df, path, with_ids=True).collect()}
    ids = library.encode("Hello  world")
    assert rows[2].ids == ids and rows[2].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert rows[2].decoded == "Hello  world" and rows[1].n_tokens == rows[None].n_tokens == 0
    assert piece_bpe.encode_decode(spark.createDataFrame([], DOCS), path).count() == 0


def test_merging_one_place_a_round_gives_the_same():
    own = piece_bpe.PieceBPE(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["▁the", "▁internationalisation", "▁aaaaaaa", "xyz", "▁▁▁▁▁", "▁Zürich"]
    at = np.cumsum([0] + [len(w) for w in words[:-1]])
    symbols = own.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
    own._fresh = symbols
    for a, b in zip(own.merge(symbols.copy(), at), own.merge(symbols.copy(), at, True)):
        assert (a == b).all()


@pytest.mark.parametrize("n", [0, 1, 2, 255, 513, 70_001])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    for ids, alphabet in ((np.minimum(rng.zipf(1.4, n), 49407).astype(np.int32), 49408), (rng.integers(0, 5, n).astype(np.int32), 5), (rng.integers(0, 200_000, n).astype(np.int32), 200_000), (np.zeros(n, np.int32), 1)):
        data = token_codec.encode_block(ids, alphabet)
        assert (token_codec.decode_block(data, n, alphabet) == ids).all() and token_codec.encode_block(ids, alphabet) == data


def test_codec_bits_a_token():
    """Each order has to help: a skewed draw comes near its entropy, chains of order 1 and 2 well below that of their ids alone."""
    rng = np.random.default_rng(0)
    n, size = 200_000, 64

    def bits(ids):
        return 8 * len(token_codec.encode_block(ids.astype(np.int32), size)) / n

    p = 1 / np.arange(1, size + 1)
    p /= p.sum()
    draw, noise = rng.choice(size, n, p=p), rng.random(n) < 0.1
    one, two = draw.copy(), draw.copy()
    for i in range(2, n):
        if not noise[i]:
            one[i] = (one[i - 1] * 5 + 3) % size
            two[i] = (two[i - 1] * 7 + two[i - 2] * 3 + 1) % size
    entropy = -(p * np.log2(p)).sum()
    assert entropy < bits(draw) < entropy + 0.5
    assert bits(one) < 2.2 and bits(two) < 2.2


def test_codec_compresses_and_checks():
    ids = np.tile(np.arange(50, dtype=np.int32), 80)
    data = token_codec.pack_file([1, None], np.array([1000, 3000]), ids, 1024)
    assert len(data) < len(ids)
    keys, counts, back = token_codec.unpack_file(data)
    assert keys == [1, None] and counts.tolist() == [1000, 3000] and (back == ids).all()
    blocks = [token_codec.encode_block(ids[at : at + 1024], 50) for at in range(0, 4000, 1024)]
    assert data.endswith(b"".join(blocks))  # a block does not depend on its neighbours
    for at in (-200, -1, -sum(map(len, blocks)) + 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_codec.unpack_file(bytes(broken))
    with pytest.raises(ValueError):
        token_codec.unpack_file(data[:-300])


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Alpha", "beta", "it's", "9x"]) for _ in range(rng.randrange(60))), 0, "x", 1) for i in rng.sample(range(1000), 70)]
    rows += [(2000 + i, t, 0, "x", 1) for i, t in enumerate(ODD)] + [(None, "null id", 0, "x", 1), (3000, None, 0, "x", 1), (3001, "b", 0, "x", 1), (3001, "a", 0, "x", 1)]
    got = token_codec.write_and_read(spark.createDataFrame(rows, DOCS).repartition(3), path, block_tokens=64, file_tokens=500).orderBy("start").collect()
    tokenizer, at = Tokenizer.from_file(path), 0
    for (i, t, *_), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0], x[1] or "")), got):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(rows)
    assert token_codec.write_and_read(spark.createDataFrame([], DOCS), path).count() == 0


def test_token_files_of_one_id(spark):
    """Thousands of rows of one id, of none, and equal ones: each file has its share, and nothing is lost."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(7, f"text {i % 50} {i}") for i in range(2000)] + [(None, f"no id {i}") for i in range(1500)] + [(9, "same")] * 1500 + [(3, "long " * 60_000), (11, None)]
    df = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], DOCS).repartition(4)
    files, folder = token_codec.write_tokens(df, path, "doc_id", "text", files=8)
    by_part = {r.part: r.documents for r in files.groupBy("part").sum("documents").withColumnRenamed("sum(documents)", "documents").collect()}
    assert sum(by_part.values()) == len(rows) and max(by_part.values()) < len(rows) / 4
    got = token_codec.read_tokens(files, folder).orderBy("start").collect()
    assert [r.id for r in got] == [None] * 1500 + [3] + [7] * 2000 + [9] * 1500 + [11]
    tokenizer = Tokenizer.from_file(path)
    crc = lambda t: zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.id, r.ids_crc32) for r in got), key=key) == sorted(((i, crc(t)) for i, t in rows), key=key)
    ends = [0, *np.cumsum([r.n_tokens for r in got]).tolist()]
    assert [r.start for r in got] == ends[:-1]


PAGES = "page_id long, url string, html string, file string, key string"


@pytest.mark.parametrize("few", [200_000, 0])
def test_warc_round_trip(spark, few):
    big = "é" * 600
    rows = [(1, "http://www.Example.com/a?b=1", big), (2, "http://example.com/a?b=1", big), (3, "https://x.org:8080/", "small"), (4, None, "small"), (5, "ftp://[bad", None), (9, "http://example.com/ä b", big + "x"), (2, "http://example.com/a?b=1", big), (None, "http://q", big)]
    pages = spark.createDataFrame([(*r, "f", "k") for r in rows], PAGES)
    captures = warc.write_archives(pages, broadcast_rows=few)
    index = warc.CaptureIndex.build(captures, block_lines=2, files=3)
    keys = pages.select(warc.capture_key(pages.url, pages.page_id).alias("key"))
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in warc.read_records(index.lookup(keys), index.folder, True).collect())
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and i != 2
        expected.append((i or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None, None if revisit else data))
    assert got == sorted(expected)
    whole = spark.createDataFrame([(warc.url_key("http://www.example.com/a?b=1"),), ("none)/",)], "key string")
    assert index.lookup(whole).count() == 3


def test_warc_edges(spark):
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0
    assert warc.url_key("http://www.Example.com:80/A b?x") == "com,example)/A%20b?x"
    assert warc.id_key(-5) < warc.id_key(0) < warc.id_key(2**62) and warc.id_key(None) < warc.id_key(-(2**63))
    with pytest.raises(ValueError):
        warc.parse_record(b"no")


def test_very_long_texts(spark):
    """Near copies of 200,000 words, a page of several megabytes, one word of a million letters."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    other = [w if rng.random() < 0.99 else "x" for w in words]
    far = [w if rng.random() < 0.5 else f"y{rng.randrange(10**6)}" for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far)), (4, "short")]
    df = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], DOCS)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dup.near_duplicates(df, width=4, percent=80).collect()}
    expected = brute_groups(rows, 4, 80)
    assert got == {i: (e[1], e[0]) for i, e in expected.items()} and got[2][0] == 1 and got[3][0] == 3

    html = "<p>é</p>" * 600_000
    pages = spark.createDataFrame([(1, "http://a.example/x", html, "f", "k"), (2, "http://a.example/y", html, "f", "k")], PAGES)
    read = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(pages).collect()}
    digest = hashlib.sha1(html.encode()).hexdigest()
    assert read == {1: (len(html.encode()), digest, "revisit", 2), 2: (len(html.encode()), digest, "response", None)}

    word = "".join(rng.choice("abcdefghij") for _ in range(1_000_000))
    path = public_tokenizers.path("piece_bpe_32k.model")
    (row,) = piece_bpe.encode_decode(spark.createDataFrame([(1, word, 0, "x", 1)], DOCS), path).collect()
    ids = sentencepiece.SentencePieceProcessor(model_file=path).encode(word)
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(word.encode()).hexdigest()
