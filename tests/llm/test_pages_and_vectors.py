"""Archives, page texts and nearest neighbours."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from logdistill.llm import ann, markup, page_text, warc
from logdistill.llm.common import new_path


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def odd_pages(spark):
    same = "<p>" + "z" * 200
    rows = [
        (5, "http://a.b/x y\n", same, 1), (3, None, same, 1), (None, "http://a.b/", same, 1), (3, None, same, 1),
        (9, "::bad::[", None, 1), (10, "http://a.b/", "é" * 3, 1), (11, "http://a.b/", "é" * 3, 1),
        (12, "http://[::1/", "", 1), (13, "https://u@h.example:8080/p?q#f", "<p>" + "lang " * 50_000, 1),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, key int")


def test_archives_come_back(spark, pages, odd_pages):
    for frame in (pages, odd_pages):
        rows = frame.collect()
        groups = defaultdict(list)
        for r in rows:
            raw = (r.html or "").encode()
            if len(raw) >= 100 and r.page_id is not None:
                groups[raw].append(r.page_id)
        want = []
        for r in rows:
            raw = (r.html or "").encode()
            first = min(groups[raw]) if groups.get(raw) else None
            again = first is not None and r.page_id != first
            want.append((r.page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
        got = [tuple(r) for r in warc.archived_pages(frame).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.archived_pages(pages.where("false")).count() == 0


def test_index_finds_single_captures(spark, pages):
    path = new_path(spark, "test")
    warc.write_archives(pages.repartition(3), path)
    blocks, directory = warc.build_index(spark, path, lines=7)
    assert len(directory) >= pages.count() // 7 and directory == sorted(directory)
    some = pages.where("page_id % 9 = 0")
    rows = warc.read_ranges(warc.lookup(warc.capture_keys(some), blocks, directory)).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in rows if r.record_type == "response"} <= {
        (r.page_id, r.html) for r in some.collect()
    }
    assert len(rows) == some.count()
    missing = spark.createDataFrame([(b"com,nowhere)/ 1",), (b"",), (b"~",)], "key binary")
    assert warc.lookup(missing, blocks, directory).count() == 0


def test_record_format():
    data = warc.record("7", "http://x.y/\r\nX: 1", b"<p>\xff", "d" * 64, None) + b"\n"
    head, begin, end = warc.parse_head(gzip.decompress(gzip.compress(data)))
    assert head["WARC-Target-URI"] == "http://x.y/%0D%0AX:%201" and data[end:] == warc.END
    assert data[begin:end].endswith(b"\r\n\r\n<p>\xff") and head["WARC-Type"] == "response"
    assert warc.reversed_host("https://Blog.Example.com:81/a?b#c") == "com,example,blog:81)/a?b#c"


def test_alignment_is_longest():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(40))]
        b = [rng.randrange(4) for _ in range(rng.randrange(40))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        places = markup.common_lines(a, b)
        left = iter(b)
        assert len(set(places)) == t[-1][-1] and all(a[p] in left for p in places)


def test_page_texts(spark, pages, odd_pages):
    body = "<div>{site}</div><p>{own} &amp;&nbsp;more<br>text</p><ul><li>x{own}</li></ul><div>All rights</div>"
    rows = [
        (1, "http://a.b/x/1", body.format(site="Name", own="one")),
        (2, "http://a.b/x/2", body.format(site="Name", own="two")),
        (3, "http://c.d/x/2", body.format(site="Name", own="two")),
        (4, "http://a.b/y", """<title>t</title><nav><a>menu</a></nav><main><h1>Head</h1><p>Body
            <script>var a="</p>"</script> text<div class="side-bar ad">buy</div><p>Name</p>
            <section id="comments"><article><p>reader</p></article></section></main>
            <aside>more</aside><form>f</form><div class="cookie-notice">ok</div><footer>end</footer>"""),
        (5, "http://a.b/z", "<nav>never closed<ul><li>m<article><p>Kept"), (6, None, None), (7, None, ""),
    ]
    got = {r.page_id: r for r in page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "one & more text\n\nxone" and got[2].text == "two & more text\n\nxtwo"
    assert got[3].text == "Name\n\ntwo & more text\n\nxtwo\n\nAll rights"
    assert got[4].text == "Head\n\nBody text\n\nName" and got[5].text == "Kept"
    assert got[6].text == got[7].text == "" and got[1].n_chars == len(got[1].text)
    assert page_text.main_texts(odd_pages).count() == odd_pages.count()
    whole = page_text.main_texts(pages)
    assert whole.where("n_chars = 0").count() == 0 and whole.count() == pages.count()
    assert page_text.main_texts(pages.where("false")).count() == 0


def test_marks_of_layout_titles_and_whole_pages(spark):
    """Marks that wrap a page, lay it out or head an article do not empty it; no article element here but one."""
    site = "<p>Name</p>{}<p>All rights</p>"
    own = "<h1>Head {0}</h1><p>Own {0} text</p>"
    wrap = {
        "layout": '<div class="layout has-sidebar no-menu">{}</div>', "form": "<form>{}</form>",
        "wide": '<div class="widget">{}<div class="comments"><p>reader</p></div></div>', "plain": "<div>{}</div>",
    }
    rows, want = [], {}
    for i, (name, around) in enumerate(wrap.items()):
        for j in range(3):
            page = 10 * i + j
            rows.append((page, f"http://{name}.b/p/{j}", around.format(site.format(own.format(page)))))
            want[page] = f"Head {page}\n\nOwn {page} text"
    rows.append((90, "http://e.b/", """<article><div class="post-header"><h1>Title</h1></div><p>Body</p>
        <section class="related-work"><p>Earlier</p></section><div class="related-posts"><p>Ad</p></div></article>"""))
    want[90] = "Title\n\nBody\n\nEarlier"
    # Long pages of many shared lines, with and without broadcast differences.
    many = "".join(f"<p>line {i}</p>" for i in range(3000))
    rows += [(100 + j, f"http://long.b/{j}", many + f"<p>own {j}</p>" + many) for j in range(2)]
    want |= {100: "own 0", 101: "own 1"}
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (page_text.DIFFERENCE_BYTES, -1):
        page_text.DIFFERENCE_BYTES, kept = limit, page_text.DIFFERENCE_BYTES
        try:
            assert {r.page_id: r.text for r in page_text.main_texts(table).collect()} == want
        finally:
            page_text.DIFFERENCE_BYTES = kept


def test_page_texts_against_brute_force(spark):
    """Pages without marks: the lines that no longest common subsequence with the nearest page holds."""
    rng = np.random.default_rng(5)
    rows, lines = [], {}
    for host in range(3):
        for page in range(12):
            # Each host has a fixed head and foot, each page words of its own between.
            body = [f"own{host}x{page}x{k}" for k in range(int(rng.integers(0, 5)))]
            lines[(host, page)] = body
            shown = [f"head{host}", *body, f"foot{host}"]
            rows.append((100 * host + page, f"http://h{host}.b/d/{page:02d}", "".join(f"<p>{x}</p>" for x in shown)))
    got = page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {100 * h + p: "\n\n".join(x) for (h, p), x in lines.items()}


def test_differencing_decides_lines_beside_an_article(spark):
    """What only one page has beside its article is its own text; what both have is the site's."""
    page = "<div>Name</div><article><h1>Head {0}</h1><p>Quoted</p></article><p>Part two of {0}</p><div>All rights</div>"
    rows = [(i, f"http://a.b/{i}", page.format(i)) for i in range(3)] + [(9, "http://c.d/9", page.format(9))]
    rows.append((8, "http://a.b/8", page.format(8) + '<nav><p>Menu 8</p></nav><div class="comments"><p>reader</p></div>'))
    got = page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {i: f"Head {i}\n\nQuoted\n\nPart two of {i}" for i in (0, 1, 2, 8)} | {9: "Head 9\n\nQuoted"}
    assert {r.page_id: r.text for r in got} == want


def test_copies_of_pages_are_not_paired(spark):
    body = "<div>Name</div><p>{0} text</p><div>All rights</div>"
    rows = [
        (1, "http://a.b/x/1", body.format("one")), (2, "http://a.b/x/1", body.format("one")),
        (3, "http://a.b/x/1?ref=q", body.format("one")), (4, "http://a.b/x/2", body.format("two")),
        (5, "http://c.d/", body.format("one")), (6, "http://c.d/", body.format("one")), (6, "http://c.d/", body.format("one")),
    ]
    got = page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    whole = "Name\n\none text\n\nAll rights"
    assert sorted((r.page_id, r.text) for r in got) == [
        (1, "one text"), (2, "one text"), (3, "one text"), (4, "two text"), (5, whole), (6, whole), (6, whole),
    ]


def nearest_brute(rows, queries, k=10):
    seen = {(r.vec_id, tuple(r.embedding)) for r in rows}
    ids = np.array([i for i, _ in seen])
    x = np.array([v for _, v in seen])
    out = {}
    for i, v in seen:
        if queries(i):
            d = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


@pytest.mark.parametrize("slice_rows", [16_384, 40])
def test_forest_recall(spark, slice_rows):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = F.col("vec_id") % 25 == 0
    got = ann.nearest(vectors, asked, slice_rows=slice_rows).collect()
    want = nearest_brute(vectors.collect(), lambda i: i % 25 == 0)
    mine = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        mine[r.query_id].append((r.vec_id, r.score))
    assert set(mine) == set(want) and all(len(v) == 10 for v in mine.values())
    hits = sum(len({i for i, _ in mine[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    for q, rows in mine.items():
        assert rows == sorted(rows, key=lambda r: (r[1], r[0]))


def test_forest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, []),
        (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (100, [1.0, 2.0, 3.0]),
        (200, [1.0, 0.1]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = [tuple(r) for r in ann.nearest_hundredth(frame).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [
        (0, 1, 1), (0, 2, 2), (0, 3, 200), (0, 4, 3), (200, 1, 0), (200, 2, 1), (200, 3, 2), (200, 4, 3),
    ]
    assert got[3][3] == pytest.approx(5**0.5)
    assert ann.nearest_hundredth(frame.where("false")).count() == 0
