"""Embeddings, archives and pages."""

import hashlib
import math
import random

import pytest

from tessera.llm import html, vectors, warc
from tessera.llm.components import components


def test_components(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 50), (200, 201), (201, 200), (300, 300)] + [(400, i) for i in range(401, 440)] + [(None, 1), (1, None)]
    r.shuffle(edges)
    found = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in [*range(61), 100]) and found[201] == 200 and found[300] == 300
    assert all(found[i] == 400 for i in range(400, 440)) and len(found) == 61 + 1 + 2 + 1 + 40
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [512, 3])
def test_vectors(spark, block):
    r = random.Random(4)
    center = [[r.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [[x + r.gauss(0, 0.1) for x in center[i % 12]] for i in range(150)] + [center[0]] * 40 + [[x * 3 for x in center[0]], [0.0] * 16, None, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0], []]
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")

    def linked(a, b):
        ok = [v and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in (a, b)]
        if not all(ok) or len(a) != len(b):
            return False
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b) >= 0.95

    n = [sum(i != j and linked(a, b) for j, b in enumerate(rows)) for i, a in enumerate(rows)]
    label = list(range(len(rows)))
    for _ in range(6):
        label = [min([label[i], *(label[j] for j, b in enumerate(rows) if linked(a, b))]) for i, a in enumerate(rows)]
    found = {x["id"]: x for x in vectors.near_duplicates(table, block=block).collect()}
    links = sum(found[i]["n_links"] for i in found)
    assert links <= sum(n) and links >= 0.99 * sum(n)
    assert [found[i]["component_id"] for i in range(len(rows))] == label
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_different_vectors_of_one_id_are_apart(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (8, [0.0, 1.0, 0.01])]
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("id", "n_links", "component_id").collect()
    assert sorted(map(tuple, found)) == [(2, 1, 2), (5, 1, 2), (5, 1, 5), (8, 1, 5)]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; more</h1><p>First&nbsp;one<br>goes
 on<p>Second <b>bold</b>ly<!-- no --><form><input></form><div class="comments"><p>I say</div><aside>See also</aside><ul><li>a<li>b</ul></article><footer>&copy;</footer></body>"""


def test_main_text(spark):
    assert html.extracted(PAGE, []) == "Head & more\nFirst one goes on\nSecond boldly\na\nb"
    # without an article, what a host's pages have in common is no text of theirs
    body = "<html><body><div><span>Daily News</span></div><div><p>{}</p><p>{}</p></div><div>Imprint</div></body></html>"
    rows = [(i, f"http://h.example/{i}", body.format(f"Story {i}", f"More {i}")) for i in range(6)]
    rows += [(6, "http://h.example/6", rows[0][2]), (7, None, None), (8, "http://h.example/8", ""), (None, "x", "<p>a < b &lt;"), (9, "http://other.example", rows[0][2]), (10, "u", "<p " * 1000), (11, "u", "<!-- <p>a")]
    found = {x["id"]: x for x in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[2]["text"] == "Story 2\nMore 2" and found[6]["text"] == found[0]["text"] == "Story 0\nMore 0"
    assert found[7]["text"] == found[8]["text"] == "" and found[None]["text"] == "a < b <" and found[2]["n_chars"] == len(found[2]["text"])
    assert found[9]["text"] == "Daily News\nStory 0\nMore 0\nImprint" and len(found) == len(rows)


def test_classes_match_in_order_only():
    assert html.matched([5, 1, 2, 9, 3, 1], [[1, 2, 3], [9, 5], [5, 9], [7, 8]]) == {1, 2, 3, 5, 9}
    assert html.matched([2, 1], [[1, 2]]) == set() and html.matched([], [[1, 2]]) == set()


def test_a_class_out_of_order_stays_on_its_page(spark):
    """Two lines that all pages have belong to the template, but not on the page that turns them round."""
    body = "<html><body><div><p>{}</p><h2>{}</h2></div><div><h3>Story {}</h3></div></body></html>"
    rows = [(i, f"http://h.example/{i}", body.format("Alpha", "Beta", i)) for i in range(8)]
    rows.append((8, "http://h.example/8", "<html><body><div><h2>Beta</h2><p>Alpha</p></div><div><h3>Story 8</h3></div></body></html>"))
    found = {x["id"]: x["text"] for x in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Story {i}" for i in range(8)) and found[8] == "Beta\nAlpha\nStory 8"


def test_a_template_names_text_inside_articles(spark):
    """What a host repeats inside its articles is the template's; articles that are copies are not."""
    body = "<html><body><script>{0}</script><nav>Menu</nav><article><h1>Story {1}</h1><p>More {1}</p><div>Read us daily</div></article><footer>F</footer></body></html>"
    rows = [(i, f"http://h.example/{i}", body.format(i, i)) for i in range(6)]
    rows += [(10 + i, f"http://copies.example/{i}", body.format(i, 0)) for i in range(6)]
    rows += [(20 + i, f"http://few.example/{i}", body.format(i, i)) for i in range(2)]
    rows += [(30 + i, f"http://same.example/{i}", f"<html><body><article><p>Same</p></article><p>{i}</p></body></html>".replace("<article>", "<article>" + " " * i)) for i in range(4)]
    found = {x["id"]: x["text"] for x in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Story {i}\nMore {i}" for i in range(6))
    assert all(found[10 + i] == "Story 0\nMore 0\nRead us daily" for i in range(6))
    assert all(found[20 + i] == f"Story {i}\nMore {i}\nRead us daily" for i in range(2)) and all(found[30 + i] == "Same" for i in range(4))


@pytest.mark.parametrize("wrapper", ['div class="content has-sidebar"', 'div class="no-comments"', 'div id="ad-free"', 'div class="sidebar wide"', "form action=x"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_a_wrapper_does_not_empty_a_page(wrapper, inner):
    page = f"<body><nav>Menu</nav><{wrapper}><{inner}><p>Story</p></{inner}></{wrapper.split()[0]}><footer>F</footer></body>"
    assert html.extracted(page, []) == "Story"


def test_marks_choose_among_slots(spark):
    assert html.extracted('<main><p>Story</p><div class="comments"><article>I say</article></div></main><div class="related"><article>Other</article></div>', []) == "Story"
    assert html.extracted('<div>A long story</div><div class="ad">Buy</div><form><p>Search</form>', []) == "A long story"
    assert html.extracted("<h1>Site</h1><form><p>A story of some length</p></form>", []) == "Site\nA story of some length"
    assert html.extracted('<div style="display:none"><article>No</article></div><aside>No</aside>', []) == ""
    body = '<html><body><div class="sidebar wide"><p>Story {0}</p><p>Share</p></div><p>Imprint</p></body></html>'
    rows = [(i, f"http://h.example/{i}", body.format(i)) for i in range(6)]
    found = {x["id"]: x["text"] for x in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Story {i}" for i in range(6))


def test_warc_round_trip(spark, tmp_path):
    long, tricky = "<p>" + "x" * 200, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5
    rows = [(1, "u", long), (2, "u", long), (3, None, None), (4, "a\r\nb", ""), (5, "é", "é" * 60), (6, "é", "é" * 60), (7, "t", tricky), (8, "t", tricky), (9, "s", "short"), (10, "s", "short"), (11, "l", "y" * 300_000), (2, "u", long), (None, "u", long)]
    path = f"file://{tmp_path}/archive"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.round_trip(pages, path).collect()
    first = {}
    for i, _, x in rows:
        first.setdefault(x, i)
    expected = []
    for i, _, x in rows:
        raw = (x or "").encode()
        again = len(raw) >= 100 and i != first[x]
        expected.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[x] if again else None))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == stored.select("digest").distinct().count() == len({x or "" for _, _, x in rows})
    raw = {bytes(r["header"]): bytes(r["payload"]) for r in warc.read_files(spark, f"{path}/warc").collect()}
    assert tricky.encode() in raw.values() and any(b"WARC-Target-URI: a%0D%0Ab" in h for h in raw)
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_damage_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc.store(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").selectExpr("digest", "cast('abd' as binary) as payload").write.parquet(f"{path}/bad")
    (tmp_path / "archive/payloads").rename(tmp_path / "archive/good")
    (tmp_path / "archive/bad").rename(tmp_path / "archive/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.records(spark, path).collect()
