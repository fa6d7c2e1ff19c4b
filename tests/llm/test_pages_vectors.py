"""Main text, archives, neighbours and the quality classifier."""

import hashlib
import math
import random
from html.parser import HTMLParser

import numpy as np
import pytest

from studyweave.llm import html_text, neighbours, quality, warc

MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
PROSE = "a long plain sentence that goes on for quite some time about rivers and mills and the people near them"
PAGES = [
    (0, "https://a.example.org/x", f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{MENU}<div class='ad'>Buy {PROSE}</div><article><h1>Head &amp; line</h1><p>One<br>two  <b>three</b></p><p>{PROSE}</p></article><footer>&copy; us {PROSE}</footer></body></html>", "Head & line\nOne two three\n" + PROSE),
    (1, "https://b.example.org/", f"<body><header>Top</header><main><p>{PROSE}<p>{PROSE} again</main><section id='comments'><p>{PROSE}</p></section>", f"{PROSE}\n{PROSE} again"),
    (2, None, None, ""),
    (3, "u", "", ""),
    (4, "u", "<nav>only menu</nav>", ""),
    (5, "u", f"<article><p>{PROSE} &#233;&lt;b&gt;</p><form><label>Name</label></form></article>", f"{PROSE} é<b>"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h, _ in PAGES], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    for i, _, _, want in PAGES:
        assert got[i].text == want and got[i].n_chars == len(want)
    assert html_text.extract(df.limit(0)).count() == 0


def _table(pages):
    rows = [html_text.blocks(p, marked=True) for p in pages]
    return np.concatenate([html_text.features(p) for p in rows]), np.array([r[6] for p in rows for r in p])


def test_tree_on_held_out_pages():
    """Trained on half of the labelled pages, right on the other half's blocks."""
    from studyweave.llm.html_examples import labelled_pages

    pages = labelled_pages()
    tree = html_text.grow(*_table(pages[::2]))
    x, y = _table(pages[1::2])
    assert (html_text.decide(tree, x) == y).mean() > 0.98


def _splits(tree):
    return set() if isinstance(tree, int) else {html_text.FEATURES[tree[0]]} | _splits(tree[2]) | _splits(tree[3])


def test_neighbours_decide_on_neutral_pages():
    assert {"words_after", "links_before", "links_after"} <= _splits(html_text.trained())
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>go {k}</a></li>" for k in range(5)) + "</ul>"
    page = f"<body><div>My site</div>{menu}<h1>A heading</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><h3>See also</h3>{menu}<div>Run by nobody</div></body>"
    assert html_text.main_text(page).split("\n") == ["A heading", PROSE, "Short.", PROSE]


def test_named_containers_decide():
    """Whatever the sizes and links, a body's blocks stay and a frame's go."""
    rng = np.random.default_rng(3)
    x = np.zeros((20_000, len(html_text.FEATURES)))
    for k in (0, 2, 4):
        x[:, k] = rng.integers(1, 120, len(x))
    for k in (1, 3, 5):
        x[:, k] = np.where(rng.random(len(x)) < 0.5, 0, rng.random(len(x)))
    x[:, 6], x[:, 8] = 1, rng.random(len(x)) < 0.2
    tree = html_text.trained()
    assert html_text.decide(tree, x).all()
    x[:, 7] = 1
    assert not html_text.decide(tree, x).any()
    x[:, 6] = 0
    assert not html_text.decide(tree, x).any()


class PlainReading(HTMLParser):
    """A second reading of the driver's pages: what an article holds, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.lines, self.parts = 0, [], []

    def flush(self):
        if line := " ".join("".join(self.parts).split()):
            self.lines.append(line)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        if tag == "br":
            self.parts.append(" ")
        elif tag not in ("a", "b", "i", "em", "span", "strong"):
            self.flush()

    def handle_endtag(self, tag):
        if tag not in ("a", "b", "i", "em", "span", "strong"):
            self.flush()
        if tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_main_text_of_the_tables(spark):
    from compare import SF

    pages = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        plain = PlainReading()
        plain.feed(r.html or "")
        plain.close()
        plain.flush()
        assert got[r.page_id] == "\n".join(plain.lines)


def test_odd_pages(spark):
    long = " ".join(f"word{k}" for k in range(200_000))
    rows = [(None, None, f"<article><p data-keep='yes'>{PROSE}</p></article>"), (7, "u", f"<main><p>{long}</p></main>"), (7, "v", f"<p data-keep>{PROSE}"), (8, "", "<article" + " a" * 50_000), (9, "w", "<article><p>&#0;&#x110000;&bogus; &amp;amp;</p></article>")]
    got = {(r.page_id, r.url): r.text for r in html_text.extract(spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, words int, label int")).collect()}
    assert len(got) == 5 and got[None, None] == PROSE and got[7, "u"] == long and got[7, "v"] == PROSE and got[9, "w"].endswith("&bogus; &amp;")


def test_odd_markup_ends():
    rng = random.Random(9)
    for _ in range(300):
        html_text.main_text("".join(rng.choice(["<p>", "</div>", "<a href='", '"', "<", ">", "text ", "<!--", "-->", "<script>", "&amp;", "</p", "<article>"]) for _ in range(rng.randint(0, 60))))


@pytest.mark.parametrize("quote", ['"', "'"])
def test_long_attributes(quote):
    other = "'" if quote == '"' else '"'
    value = (f"{{{other}html{other}: {other}<p class=main>{PROSE}</p> a > b{other}}} " * 250)[:25_000]
    assert len(value) == 25_000 and "<" in value and ">" in value
    for at in (value, value * 40):
        page = f"<body><aside data-props={quote}{at}{quote}><p>{PROSE}</p></aside><article data-props={quote}{at}{quote} class='post'><p>{PROSE} kept</p></article></body>"
        assert html_text.main_text(page) == f"{PROSE} kept"
        assert [(r[0], r[3], r[4]) for r in html_text.blocks(page)] == [(PROSE, 0, 1), (f"{PROSE} kept", 1, 0)]


def test_open_quotes_are_linear():
    import time

    start = time.process_time()
    for unit in ("<a \"'", "<a '\"", "<a \"", "<a ''\"", "<a x='\"\" ", "a"):
        html_text.blocks("<p " + unit * 200_000)
        html_text.blocks("<" + "a" * 200_000 + unit * 50_000)
    html_text.blocks("<p " + "a" * 400_000 + ">x")
    assert time.process_time() - start < 30


def plain_warc(rows):
    best = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            best[raw] = max(best.get(raw, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = best.get(raw)
        revisit = to is not None and to != i
        out.append((i is not None, i or 0, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_warc(spark):
    big = "<p>" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "https://a.org/1", big), (2, "https://a.org/1", big), (9, "http://b.org/ä b?q#f", big), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", "no id"), (7, "https://www.a.org:80/z", "é" * 600), (7, "https://www.a.org:80/z", "é" * 600)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, n string")
    got = warc.capture_histories(df)
    shown = sorted(((r.page_id is not None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str)
    assert shown == plain_warc(rows)
    assert warc.capture_histories(df.limit(0)).count() == 0


@pytest.mark.parametrize("run_rows,range_rows", [(warc.RUN_ROWS, warc.RANGE_ROWS), (700, 90)])
def test_warc_global_order(spark, monkeypatch, run_rows, range_rows):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(i if i % 5 else 1, f"https://h{i % 37}.org/{i % 11}" if i % 3 else "https://hot.org/", "t" * (i % 90)) for i in range(6000)] + [(9000, "https://big.org/", "é" * 1_500_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    merged = warc.merge_index(warc.read_archives(spark, warc.write_archives(pages)), run_rows, range_rows)
    got = merged.orderBy("range", "place").collect()
    keys = [(r.urlkey, r.stamp, r.page_id) for r in got]
    assert len(keys) == len(rows) and keys == sorted(keys)
    largest = max(np.bincount([r.range for r in got]))
    assert largest < 10 * range_rows and len({r.range for r in got}) > 1


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 50), j) for _ in range(rng.randint(0, 9))) for j in range(k)]
        merged = [x for x in warc.LoserTree([iter([((v,), v) for v, _ in r]) for r in runs])]
        assert [m[1] for m in merged] == sorted(v for r in runs for v, _ in r)


@pytest.mark.parametrize("tile", [4096, 16])
def test_neighbours(spark, monkeypatch, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (304, rows[0][1]), (305, [2 * x for x in rows[0][1]]), (306, [1e-200] * 8), (400, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], "vec_id long, embedding array<double>, rank int, v int, class int, query_id int")
    got = neighbours.nearest(df.where("vec_id % 50 = 0"), df, 5).collect()
    ok = {i: v for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}

    def cos(a, b):
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))

    for q in (i for i in ok if i % 50 == 0):
        want = sorted(((-round(cos(ok[q], v), 12), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == [i for _, i in want]
        assert all(abs(m[2] + w[0]) < 1e-9 for m, w in zip(mine, want))
    assert {r.query_id for r in got} <= set(ok)


_PROSE = " ".join(["prose about the river and the mill"] * 6)
_ARTICLE = f"<h1>The title here</h1><p>{_PROSE}</p>"


@pytest.mark.parametrize("page,paragraphs", [
    (f"<div id='content' class='no-sidebar'>{_ARTICLE}</div>", 1),
    (f"<div class='has-sidebar main'>{_ARTICLE}</div>", 1),
    (f"<div class='comments-open post'>{_ARTICLE}</div>", 1),
    (f"<form id='page'><article>{_ARTICLE}</article></form>", 1),
    (f"<article><header class='entry-header'><h1>The title here</h1></header><p>{_PROSE}</p></article>", 1),
    (f"<main><div class='post-header'><h1>The title here</h1></div><p>{_PROSE}</p></main>", 1),
    (f"<article>{_ARTICLE}<section class='discussion'><p>{_PROSE}</p></section></article>", 2),
    (f"<article>{_ARTICLE}<section class='side-effects'><p>{_PROSE}</p></section></article>", 2),
    (f"<article>{_ARTICLE}<div class='comments'><p>{_PROSE}</p></div><aside><article><p>{_PROSE}</p></article></aside></article>", 1),
    (f"<article>{_ARTICLE}<form><p>{_PROSE}</p></form><div class='side-bar'><p>{_PROSE}</p></div></article>", 1),
])
def test_names_that_say_nothing(page, paragraphs):
    """States and parts of an article are no frames; comments, cards and forms in one still are."""
    links = "<nav><ul><li><a href='/'>Home</a></li></ul></nav>"
    got = html_text.main_text(f"<html><body>{links}{page}<footer>&copy; example</footer></body></html>")
    assert got.split("\n") == ["The title here"] + [_PROSE] * paragraphs


def test_quality_held_out(spark):
    """Trained on half of the labels, right on at least nine tenths of the others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit, held = labels.where("xxhash64(doc_id) % 2 = 0"), labels.where("xxhash64(doc_id) % 2 <> 0")
    scored = quality.score(docs, quality.train(docs, fit)).join(held, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality > 0) for r in scored) / len(scored) >= 0.9


def test_quality_hands_over_the_surest(spark):
    """Over all tasks and rows, each view hands over those of which it is surest, and none twice."""
    import numpy as np

    rng = np.random.default_rng(5)
    t, m = rng.normal(size=(900, quality.TEXT_FEATURES)), np.stack([rng.integers(0, 8, 900), rng.integers(8, 40, 900), rng.integers(40, 52, 900)], 1)
    y = (t[:, 0] + (m[:, 0] > 3) * 4 - 2 > 0).astype(float)
    models = [quality.Logistic.fit(t[:300], y[:300], 0.1), quality.Logistic.fit(quality.one_hot(m[:300]), y[:300], 0.1)]
    pool = spark.createDataFrame([(k, t[k].tolist(), m[k].tolist()) for k in range(900)], "row long, t array<double>, m array<int>").repartition(7)
    taken, most = [np.arange(0, 900, 3), np.arange(0, 900, 5)], {1.0: 40, 0.0: 25}
    got = quality._handed(pool, models, taken, most).to_pylist()
    for v, x in ((0, t), (1, quality.one_hot(m))):
        p = 1 / (1 + np.exp(-models[v].odds(x)))
        for label, sure in ((1.0, p), (0.0, 1 - p)):
            free = [k for k in range(900) if sure[k] >= quality.SURE and k not in set(taken[1 - v].tolist())]
            assert {r["row"] for r in got if (r["view"], r["label"]) == (v, label)} == set(sorted(free, key=lambda k: (-sure[k], k))[: most[label]])
    assert got


def test_quality_cases(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, none)).where("kept").count() == len(rows)
    one = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (999_999, 0, 0), (None, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, quality.train(docs, one)).count() == len(rows)
    mixed = spark.createDataFrame([(3 * k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, mixed)
    out = quality.score(docs, model)
    assert out.count() == len(rows) and quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(empty, model).count() == 0
    bare = docs.select("doc_id", "text")
    assert quality.score(bare, model).count() == len(rows) and quality.keep_good(bare, quality.train(bare, mixed)).columns == ["doc_id", "text"]


def test_one_large_page_does_not_decide_the_files(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://x.example.org/"), F.col("id")).alias("url"), F.when(F.col("id") == 77, F.repeat(F.concat(F.col("id").cast("string"), F.lit("01234567")), 3_000_000)).otherwise(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 320)).alias("html"))
    path = warc.write_archives(pages.repartition(3), str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("part-*"))) <= 8
    found = warc.capture_histories(pages)
    assert found.count() == 2000 and found.where("page_id = 77").first().payload_bytes == 30_000_000 and path
