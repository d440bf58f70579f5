"""Lexical search, main text and clustering against brute force and hand-made pages."""

import hashlib
import html
import math
import random
import re

import numpy as np
import pytest

from brickwork.llm import centroids, lexical_search, main_text

DOCS = "doc_id long, text string, score double, rank int, q long"
ITEMS = "item_id long, text string, doc_id long, score int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranking(docs, items, k=10):
    known = [(i, words(t)) for i, t in docs if words(t)]
    n_docs, length = len(known), sum(len(w) for _, w in known)
    df = {}
    for _, w in known:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, w in known:
            m = 10 + 90 * len(w) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in set(words(text)) if t in df)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)] + ["Straße", "ÉTÉ", "日本語", "x-y", "A1", "don't"]
    docs = [(i * 3 % 997, " ".join(rng.choices(vocabulary, [1 / (1 + k) for k in range(len(vocabulary))], k=rng.randrange(0, 40)))) for i in range(500)]
    docs += [(5000 + i, "same text of many copies w1") for i in range(60)] + [(None, "w1 w2 w3"), (7, None), (7, ""), (8, "w59 " * 3000), (9, "!?")]
    items = [(n, " ".join(rng.choices(vocabulary, k=8))) for n in range(12)] + [(20, None), (21, "..."), (22, "copies of W1 w1"), (22, "copies of W1 w1"), (None, "日本語 straße"), (23, "nowhere")]
    return docs, items


@pytest.mark.parametrize("window, most", [(16384, 1 << 22), (8, 1 << 22), (64, 50)])
def test_ranking_equals_brute_force(spark, corpus, window, most):
    docs, items = corpus
    d = spark.createDataFrame([(i, t, 0.5, 1, 2) for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(i, t, 3, 4) for i, t in items], ITEMS)
    got = [tuple(r) for r in lexical_search.rank_documents(d, q, window=window, most=most).collect()]
    assert sorted(got, key=repr) == sorted(brute_ranking(docs, items), key=repr)


def test_ranking_in_blocks_and_of_nothing(spark, corpus):
    docs, items = corpus
    d, q = spark.createDataFrame([(i, t, 0.5, 1, 2) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 3, 4) for i, t in items], ITEMS)
    got = [tuple(r) for r in lexical_search.rank_documents(d, q, block_bytes=100).collect()]
    assert sorted(got, key=repr) == sorted(brute_ranking(docs, items), key=repr)
    assert lexical_search.rank_documents(d.limit(0), q).count() == 0 and lexical_search.rank_documents(d, q.limit(0)).count() == 0


def test_terms_of_a_long_text_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    text = "abc déf  Ghi-jkl mnopqrstuvwxyz 0  x"
    assert [w.decode() for part in lexical_search.term_lists(text.encode()) for w in part] == words(text)


def brute_lloyd(rows, k=8, rounds=10, scale=1024, dims=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    now = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now)) for _, v in kept]

    for _ in range(rounds):
        mine = assign()
        members = [[v for (_, v), (_, n) in zip(kept, mine) if n == c] for c in range(len(now))]
        now = [[sum(col) // len(m) for col in zip(*m)] if m else c for m, c in zip(members, now)]
    mine, most = assign(), 2**63 - 1
    of = [sum(d for d, n in mine if n == c) for c in range(len(now))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(i, n, min(d, most), min(of[n], most), min(sum(of), most), sha[n]) for (i, _), (d, n) in zip(kept, mine)]


VECTORS = "vec_id long, embedding array<float>, cluster string, id int"


@pytest.mark.parametrize("outliers", [[], [3e38, -1e30], [2.0**18, 2.0**18 + 1, 1e5]])
def test_clusters_equal_brute_force(spark, outliers):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(i % 5, 0.7, 64)]) for i in range(120)]
    rows += [(200 + n, [float(np.float32(x))] + [0.0] * 63) for n, x in enumerate(outliers)]
    rows += [rows[3], rows[3], (None, [0.5] * 64), (300, None), (301, [1.0] * 63), (302, [1.0] * 63 + [None]), (303, [1.0] * 63 + [float("nan")]), (304, [float("inf")] * 64), (305, [])]
    got = centroids.cluster_vectors(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_lloyd(rows))


def test_clusters_of_few_and_equal_vectors(spark):
    same = [(i, [0.25] * 64) for i in range(5)] + [(9, [1.0] * 64)]
    frame = lambda rows: spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)
    assert sorted(map(tuple, centroids.cluster_vectors(frame(same)).collect())) == sorted(brute_lloyd(same))
    assert centroids.cluster_vectors(frame([])).count() == 0
    many = [(7, [float(k)] * 64) for k in range(12)]  # one id for all
    assert sorted(map(tuple, centroids.cluster_vectors(frame(many)).collect())) == sorted(brute_lloyd(many))


PAGES = "page_id long, url string, html string, text string, row int, blocks string"
AROUND = "<nav><a href=/>Home</a><a href=/n>News</a></nav>"


def alone(page):
    return "\n".join(b.text for b in main_text.candidates(main_text.page_blocks(page)))


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain text & more", "plain text & more"),
        (f"<html><head><title>T</title><style>p>b{{}}</style></head><body>{AROUND}<article><h1>Head</h1><p>One&nbsp;two \n three<p>Four <b>fi</b>ve.<br>six</article><footer>&copy; x</footer>", "Head\nOne two three\nFour five. six"),
        ("<article><p>a</p><script>var t='</p>';</script><p>b</p><!-- <p>c</p> --><p>d &lt;p&gt; &#233; &#x27; &amp;amp; &am</p></article>", "a\nb\nd <p> é ' &amp; &am"),
        ("<header><a href=/>Site</a></header><main><h1>Title</h1><p>Body text.</p><aside>See also</aside><section class='comments'><p>Great post!</p></section></main>", "Title\nBody text."),
        ("<div id=page><div class='top-menu'>Menu</div><div class=content><h2>Head</h2><p>Words.</p><div class='share-buttons'>Share</div></div><div id=sidebar><p>Side</p></div><div class=cookie-notice>We use cookies.</div></div>", "Head\nWords."),
        ("<article><header><h1>Head</h1></header><p>Body</p><form><label>Mail</label><input><button>Go</button></form><footer>Tags</footer></article><article class=comment><p>First!</p></article>", "Head\nBody"),
        ("<body class='has-sidebar'><div class='wrap with-menu'><article><p>Body</p></article></div></body>", "Body"),
        ("<form id=aspnet><div class=menu>M</div><main><p>Body</p></main></form>", "Body"),
        ("<article><p>1 < 2 and 3 > 2</p><p title='a > b'>ok</p><p>x<span class=ad>buy</span>y</p><p style='display: none'>no</p><p hidden>no</p></article>", "1 < 2 and 3 > 2\nok\nxy"),
        ("<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><p>The story of a <a href=3>link</a> in a long text.</p>", "The story of a link in a long text."),
        ("<article><ul><li>one<ul><li>inner</ul><li>two</ul><table><tr><td>a<td>b</table><pre>x\n  y</pre></article>", "one\ninner\ntwo\na\nb\nx y"),
        ("<div class=header>Site</div><main><div class='header big'><h1>Head</h1></div><div class=advert>Buy</div><p>Body</p><p class=notice>Mind</p><div id=reader-comments>Hm</div></main>", "Head\nBody"),
        ("<article><p>cut <a href='x", "cut"),
        ("<article><p>open <!-- comment never ends", "open"),
        ("<ARTICLE><P>Upper</P></ARTICLE></div></p><p>after", "Upper"),
    ],
)
def test_text_by_markup(page, text):
    assert alone(page) == text


def brute_repeats(pages, depth):
    """By comparing all windows of all pages of a host."""
    seen = {}
    for host, stream, content in pages:
        for k in range(len(stream) - depth + 1):
            seen.setdefault((host, tuple(stream[k : k + depth])), set()).add(content)
    return {w for w, contents in seen.items() if len(contents) > 1}


def test_suffix_keys_tell_repeated_windows_apart():
    rng = random.Random(4)
    pages = [(rng.randrange(3), [rng.choice("abcd") for _ in range(rng.randrange(0, 30))], n) for n in range(40)]
    seen, known = {}, {}
    for host, stream, content in pages:
        if len(stream) >= 6:
            for k, key in enumerate(main_text.suffix_keys(stream, 6, host, known).tolist()):
                seen.setdefault(key, []).append(((host, tuple(stream[k : k + 6])), content))
    assert all(len({w for w, _ in v}) == 1 for v in seen.values())
    assert {v[0][0] for v in seen.values() if len({c for _, c in v}) > 1} == brute_repeats(pages, 6)


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def extracted(spark, pages, **options):
    rows = [(i, u, h, "x", 1, "y") for i, u, h in pages]
    return {r.page_id: r.text for r in main_text.extract_main_text(spark.createDataFrame(rows, PAGES).repartition(3), **options).collect()}


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_runs_that_a_host_repeats_go(spark, broadcast_rows):
    rng = random.Random(6)
    menu, notice = "Home News Sport Weather Travel Money", prose(rng, 60)
    texts = [(prose(rng, 50), prose(rng, 12)) for _ in range(12)]
    page = lambda a, b, host, more="": (f"http://{host}/x", f"<div>{menu}</div><div>{notice}</div><div>{a}</div><div>{b}</div>{more}<div>Copyright of the whole site since 1999</div>")
    pages = [(n, *page(*t, "h.example")) for n, t in enumerate(texts)]
    pages += [(50 + n, *page(*texts[0], "h.example")) for n in range(3)]  # copies of a page
    pages.append((60, *page(texts[1][0], prose(rng, 9), "h.example")))  # shares a long passage with another
    pages.append((70, *page(*texts[2], "alone.example")))  # nothing else of this host
    got = extracted(spark, pages, broadcast_rows=broadcast_rows)
    for n, t in enumerate(texts):
        assert got[n] == "\n".join(t)
    assert got[50] == got[51] == got[0]
    assert got[60].startswith(texts[1][0] + "\n") and len(got[60].split("\n")) == 2
    assert got[70].split("\n") == [menu, notice, *texts[2], "Copyright of the whole site since 1999"]


def test_articles_lose_only_what_nearly_all_articles_of_the_host_have(spark):
    rng = random.Random(7)
    plea, shared = "Please support our work with a small gift today", prose(rng, 60)
    bodies = [[prose(rng, 30), *([shared] if n % 3 == 0 else [])] for n in range(12)]
    pages = [(n, "//H.example:80/p", "<article>" + "".join(f"<p>{p}</p>" for p in [b[0], plea, *b[1:]]) + "</article>") for n, b in enumerate(bodies)]
    pages += [(100 + n, None, f"<article><p>{shared}</p></article>") for n in range(9)] + [(200, None, None), (201, "", "<p></p>")]
    got = extracted(spark, pages)
    assert all(got[n] == "\n".join(b) for n, b in enumerate(bodies))
    assert all(got[100 + n] == shared for n in range(9)) and got[200] == got[201] == ""


def test_main_text_edges(spark):
    frame = spark.createDataFrame([(None, None, None, "a", 1, "b"), (4, "u", "<p>twice</p>", "a", 1, "b"), (4, "u", "<p>twice</p>", "a", 1, "b"), (5, "u", "<p>" + "long " * 400_000 + "</p>", None, None, None)], PAGES)
    got = sorted((r.page_id or -1, r.n_chars) for r in main_text.extract_main_text(frame).collect())
    assert got == [(-1, 0), (4, 5), (4, 5), (5, 5 * 400_000 - 1)]
    assert main_text.extract_main_text(frame.limit(0)).count() == 0


def test_pages_of_the_tables(spark):
    """The article of the given pages, cut out by its tags."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in main_text.extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.sub(r"</?b>", "", r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]).replace("<br>", " ")
        blocks = (" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        text = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (text, len(text))
