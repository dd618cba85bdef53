"""Archives, extraction and embeddings against plain code."""

import gzip
import html
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from courtflow.llm import pivots, styletree, warc
from courtflow.llm.queries import ORACLES, QUERIES
from tests.compare import differences, duck

PAGE = "page_id long, url string, html string, host string, salt int"


def test_op2_matches_oracle(spark, sf):
    assert differences(QUERIES["op2_warc"](spark, sf), duck(sf), ORACLES["op2_warc"]) == ""


def test_warc_odd_rows(spark):
    rows = [(1, "http://a/\r\nX: y", "same"), (5, None, "same"), (5, None, "same"), (None, "u", "same"), (None, "u", None)]
    rows += [(2, "http://b", ""), (3, "http://c", "é\r\n\r\nWARC/1.1\r\n"), (4, "", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], PAGE)
    got = warc.round_trip(pages, payloads=True).collect()
    assert len(got) == len(rows)
    none = -1
    said = sorted((r.page_id or none, r.record_type, r.refers_to or none, r.payload_bytes) for r in got)
    assert said == sorted(
        [
            (1, "revisit", 5, 4),
            (5, "response", none, 4),
            (5, "response", none, 4),
            (none, "revisit", 5, 4),
            (none, "revisit", 2, 0),
            (2, "response", none, 0),
            (3, "response", none, 16),
            (4, "response", none, 300_000),
        ]
    )
    bodies = {r.page_id: bytes(r.payload) for r in got if r.payload is not None}
    assert bodies[3] == "é\r\n\r\nWARC/1.1\r\n".encode() and bodies[2] == b""
    assert sorted(r.url or "-" for r in got) == sorted(r[1] or "-" for r in rows)
    assert {r.url for r in got if r.page_id == 4} == {""} and {r.url for r in got if r.page_id == 5} == {None}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_ranges_cover_selected_records(spark, tmp_path):
    pages = spark.range(200).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(cast(id as string), 50) as html")
    index = warc.write(pages.coalesce(1), f"file://{tmp_path}/w", roll=4000)
    assert index.select("archive").distinct().count() > 1
    some = index.where("page_id % 3 = 0")
    got = warc.read(some, f"file://{tmp_path}/w").collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: str(i) * 50 for i in range(0, 200, 3)}
    one = index.orderBy("page_id").first()
    raw = (tmp_path / "w" / one.archive).read_bytes()[one.offset : one.offset + one.length]
    assert warc.parse(gzip.decompress(raw))[0]["x-page-id"] == "0"
    assert warc.ranges(index, gap=0, span=1 << 30).count() == index.select("archive").distinct().count()


def test_warc_keeps_urls_and_deals_reads(spark, tmp_path):
    urls = ["http://h/a  b", " lead", "tab\tand\nline", "é中\u2028x", "", "plain", "q\"uote\\", None]
    rows = [(i, u, str(i) * 30_000) for i, u in enumerate(urls * 12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    index = warc.write(pages, folder)
    read = warc.read(index, folder, task=1000)
    assert read.rdd.getNumPartitions() > 4
    assert {r.page_id: r.url for r in read.collect()} == {i: u for i, u, _ in rows}


def article(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_op7_all_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op7_html_extraction"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain &copy; text", "plain © text"),
        ("<p>a<p>b &amp;lt; c&nbsp; d<br>e", "a\nb &lt; c d e"),
        ('<div class="content"><h1>T</h1><p>x <b>y</b>z</p><div id="comments">no</div><form>f</form></div>', "T\nx yz"),
        ("<header>H</header><main><header><h1>T</h1></header><p>t<span class=ad>buy</span> u</p></main>", "T\nt u"),
        ("<script>var a='<p>x</p>'</script><style>p{}</style><p>y", "y"),
        ("<article><p>one</p></article><article class='comment'>two</article>", "one"),
        ("<ul><li>1<li>2</ul><table><tr><td>a<td>b</table>", "1\n2\na\nb"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<p>cut <a href='x", "cut <a href='x"),
        ("<p>a<span class=ad>b<span>c</span>d</span>e", "a e"),
        ("<!-- open comment <p>x", ""),
        ('<body class="has-sidebar"><article><p>one</p></article></body>', "one"),
        ('<body class="no-sidebar"><p>one</p></body>', "one"),
        ('<main class="with-sidebar"><p>one</p></main>', "one"),
        ('<article class="post related-to-x"><p>one</p></article>', "one"),
        ('<div id="main" class="search results"><p>one</p></div><div class="search">no</div>', "one"),
        ('<div class="post">main story</div><article class="teaser">more</article>', "main story"),
        ('<div class="page sidebar-layout"><main>a b c</main></div><div class="comments">no</div>', "a b c"),
        ('<article>s</article><div class="comments">long long long</div>', "s"),
        ('<p class="x>one', "one"),
        ("<p title=it's>don't</p>x", "don't\nx"),
        ("<p>a < b and <3", "a < b and <3"),
    ],
)
def test_extract(page, text):
    assert styletree.extract(page) == text


@pytest.mark.parametrize(
    "part", ['<p title="', "<a ", "<p title='x", "<!", "<!--", '<div class="a', "<script ", '<p a="x>y</p>', "</", "a='<b c=\"", "<"]
)
def test_a_megabyte_of_what_is_left_open(part):
    page = part * (1_000_000 // len(part)) + "<p>x"
    start = time.perf_counter()
    styletree.extract(page)
    styletree.branches(page)
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("depth", [190, 250, 30_000])
def test_extract_below_a_deep_nest(depth):
    nest = "<div>" * depth
    page = f"<body><div><article>{nest}<p>x</p><nav>menu</nav><form>f</form><p>y</p>{nest.replace('<', '</')}<p>conclusion</p></article>after</div>"
    assert styletree.extract(page) == "x\ny\nconclusion"
    assert len(styletree.branches(page)) == depth + 1


def test_branches_read_alike_for_alike_blocks():
    one, two, three = (
        {p: c for p, _, c in styletree.branches(f"<div class=a>{x}</div>")}
        for x in ("<div>b</div>c", "b<div>c</div>", "<div>bc</div>")
    )
    top = styletree._path("", "div.a")
    assert one[top] == two[top] != three[top]


def test_importance_against_plain_counts(spark):
    rng = random.Random(2)
    rows = [(h, p, rng.randrange(3) if p else 0, rng.randrange(9)) for h in "ab" for p in range(4) for _ in range(rng.randrange(1, 30))]
    given = spark.createDataFrame([(h, str(p), s, c) for h, p, s, c in rows], "host string, path string, shape long, content long")
    got = {(r.host, r.path): r.importance for r in styletree.importance(given).collect()}

    def entropy(values):
        n = len(values)
        return -sum(k / n * math.log(k / n, n) for k in Counter(values).values()) if n > 1 else 1.0

    for h, p in {r[:2] for r in rows}:
        shapes, contents = ([r[k] for r in rows if r[:2] == (h, p)] for k in (2, 3))
        part = 0.9 ** len(set(shapes))
        assert got[h, str(p)] == pytest.approx((1 - part) * entropy(shapes) + part * entropy(contents))


def test_the_tree_decides_where_names_say_nothing(spark):
    def page(host, i):
        same = "".join(f"<div class=x{k}>{host} block {k}<a href=/{k}>go {k}</a></div>" for k in range(4))
        return f"<body>{same}<div class=y><p>story {i} of {host}</p><p>more {i * i}</p></div><div class=z>the end of {host}</div></body>"

    rows = [(100 * h + i, f"http://host{h}/{i}", page(f"host{h}", i)) for h in range(3) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in styletree.main_text(pages).collect()}
    assert all(got[100 * h + i] == f"story {i} of host{h}\nmore {i * i}" for h in range(3) for i in range(20))
    without = {i: styletree.extract(html) for i, _, html in rows}
    assert all("the end of" in without[i] != got[i] for i in got)


def test_style_tree_removes_what_a_host_repeats(spark):
    rows = [
        (i, f"https://u@Host.example:80/{i}", f"<div class=strap>Daily news<br>for all</div><div class=text>story {i} of many</div>")
        for i in range(12)
    ]
    rows += [(20 + i, "http://other.example/", "<div class=strap>Daily news</div>") for i in range(3)]
    rows += [(30, None, "<div>x</div>"), (31, "nonsense", None), (None, "http://host.example/", "<div class=strap>only</div>")]
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], PAGE)
    got = {r.page_id: r.text for r in styletree.main_text(pages).collect()}
    assert all(got[i] == f"story {i} of many" for i in range(12))
    assert got[20] == "Daily news" and got[30] == "x" and got[31] == "" and got[None] == "only"
    assert styletree.main_text(pages.limit(0)).count() == 0


def brute(ids, vectors, cosine=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n, label = [0] * len(ids), list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if ok[a] and ok[b] and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    n[a] += 1
                    n[b] += 1
                    label[find(a)] = find(b)
    least = {}
    for i, own in enumerate(ids):
        least[find(i)] = min(least.get(find(i), own), own)
    return [(own, n[i], least[find(i)], least[find(i)] == own) for i, own in enumerate(ids)]


@pytest.mark.parametrize("most", [20_000, 16])
def test_near_vectors_find_all_links(spark, most):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 64))
    rows = [base[i % 30] + 0.28 * rng.normal(size=64) for i in range(150)] + [base[0] + 0.1 * rng.normal(size=64) for _ in range(60)]
    rows += [base[0] * 3, base[0] * 3, base[0] * 1e-150]
    data = [(i, [float(x) for x in v], 1) for i, v in enumerate(rows)]
    got = pivots.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, n int"), most=most)
    want = brute([r[0] for r in data], [r[1] for r in data])
    found, links = sorted(map(tuple, got.collect())), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(found, want, strict=True))
    assert sum(g[1] for g in found) >= 0.98 * links and links > 300


def test_near_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0])]
    rows += [(8, [None, 1.0]), (9, [1.0, 0.1]), (10, [-1.0, 0.0]), (2, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = pivots.near_vectors(table)
    want = brute([r[0] for r in rows], [r[1] for r in rows])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert pivots.near_vectors(table.limit(0)).count() == 0
    assert pivots.near_vectors(table.where("vec_id = 5")).collect()[0].kept


def test_op8_all_vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = QUERIES["op8_embedding_dedup"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(brute([r.vec_id for r in rows], [r.embedding for r in rows]))
