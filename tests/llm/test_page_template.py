from creditloom.llm import page_template as pt


def page(body, extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>x</p>';</script></head><body><nav><ul><li><a href='/a>b'>Menu</a></ul></nav>"
        f"<!-- <p>note</p> --><div class=\"ad box\">Buy</div>{extra}<article><h1>Head &amp; tail&quot;</h1>{body}</article>"
        "<div id=comments><p>Reader</p></div><footer>&copy; me</footer></body></html>"
    )


def test_article_text_of_odd_markup():
    text = lambda p: pt.main_text(p)
    assert text(page("<p><b>One  \n two<br>three<p>Four</p>")) == 'Head & tail" One two three Four'
    assert text(page("<p>A<b>B</b>C &#233;&am")) == 'Head & tail" ABC é&am'
    assert text(page("<p>x<aside>side</aside>y</p><form>f</form><p>z")) == 'Head & tail" x y z'
    assert text(page("<p>a < b and <3</p>")) == 'Head & tail" a < b and <3'
    assert text("") == "" and text("<nav>only</nav>") == "" and text("plain") == "plain"
    assert text("<p>unclosed <b>bold") == "unclosed bold"


def test_hosts_without_article_are_read_by_their_template(spark):
    rows = [
        (i, f"http://h.example/{i}", f"<html><body><div class=top>Always here</div><div class=story><p>Text of page {i} is long enough to count as content "
         f"{'word ' * (i + 3)}</p></div><div class=low>Links {i}</div><p>Same end</p></body></html>")
        for i in range(8)
    ]
    rows += [(100, None, None), (101, "http://h.example/x", ""), (102, "http://lone.example/", "<p>Lone</p>"), (0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame([(*r, "") for r in rows], "page_id long, url string, html string, text string")
    found = {r.page_id: r for r in pt.extract(frame).collect()}
    for i in range(8):
        assert found[i].text == f"Text of page {i} is long enough to count as content {'word ' * (i + 3)}".strip()
        assert found[i].n_chars == len(found[i].text)
    assert found[100].text == "" and found[101].text == "" and found[102].text == "Lone"
    assert pt.extract(frame).count() == len(rows) and pt.extract(frame.limit(0)).collect() == []


def test_given_pages_give_their_articles(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in pt.extract(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        runs = [re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b)) for b in re.split(r"</?(?:p|h1)>", article)]
        want = " ".join(" ".join(html.unescape(r).split()) for r in runs if r.split())
        assert found[row.page_id] == want


def extracted(spark, pages):
    rows = [(i, f"http://{host}/{i}", f"<html><body>{body}</body></html>") for i, (host, body) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in pt.extract(frame).orderBy("page_id").collect()]


def test_the_template_decides_where_teasers_are_articles_and_pages_are_copies(spark):
    story = lambda i: f"Story {i} of some length " + f"word{i} " * 60
    teasers = "".join(f"<article><p>Teaser {k}</p></article>" for k in range(3))
    pages = [("t.example", f"<main><div class=story><p>{story(i)}</p></div>{teasers}</main>") for i in range(6)]
    # Half of a host's pages hold the same story.
    copied = [0, 0, 0, 0, 1, 2, 3]
    pages += [("c.example", f"<div class=top>Always here</div><div class=story><p>{story(i)}</p></div>") for i in copied]
    # Without a node for it the body is the content node, and what all pages hold at one place is no content.
    pages += [("b.example", f"<p>Always here</p><p>{story(i)}</p>") for i in range(6)]
    found = extracted(spark, pages)
    assert found == [story(i).strip() for i in [*range(6), *copied, *range(6)]]


def optional_furniture():
    """Pages whose furniture has no telling name, stands at the edges of the story, and is on some pages only.

    Two pieces are on equally many, but not the same pages, in either order.
    """
    one, two = "<div class=qx><p>Piece one says so</p></div>", "<section class=zz><p>Piece two says so</p></section>"
    pages = []
    for i in range(12):
        first = one if i < 8 else ""
        second = two if i >= 4 else ""
        edges = second + first if i % 2 else first + second
        pages.append(("f.example", f"<div class=kk>Top {i}</div><div class=uu>{edges}<p>Story {i} {f'word{i} ' * 90}</p></div>"))
    return pages, [f"Story {i} {f'word{i} ' * 90}".strip() for i in range(12)]


def test_occurrence_vectors_find_optional_furniture_without_telling_names(spark, monkeypatch):
    pages, want = optional_furniture()
    assert extracted(spark, pages) == want
    # Without their vectors all tokens are one class, which the pages contradict: there is no such template.
    monkeypatch.setattr(pt, "MODULUS", 1)
    assert extracted(spark, pages) != want


def test_classes_are_ordered_and_nested(spark):
    rows = [(i, f"http://n.example/{i}", f"<body><ul>{f'<li><i>x</i>{i}</li>' * (i + 1)}</ul><div class=s><h2>Part</h2>{i}<h3>End</h3></div></body>") for i in range(5)]
    found = pt.classes(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    # body, ul, div, h2 and h3 with their ends and wordings are one class, the list items one in the gap behind its ul.
    by_class = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by_class.setdefault(r["class"], []).append(r)
    assert [len(by_class[k]) for k in sorted(by_class)] == [12, 2]
    assert {(r.around, r.gap) for r in by_class[0]} == {(-1, -1)} and {(r.around, r.gap) for r in by_class[1]} == {(0, 1)}


def test_faults_of_classes():
    known = {1: (0, 0), 2: (0, 1), 3: (0, 2), 7: (1, 0), 8: (1, 1)}
    assert pt.faults([1, 2, 9, 3], known) == (set(), set(), {0: {(-1, -1)}})
    assert pt.faults([1, 7, 8, 2, 7, 8, 3], known) == (set(), set(), {0: {(-1, -1)}, 1: {(0, 0), (0, 1)}})
    # A token out of order leaves; classes that cross lose the weaker; instances that overlap or miss a token are none.
    assert pt.faults([2, 3, 1], known)[0] == {1}
    assert pt.faults([1, 2, 7, 3, 8], known)[1] == {1} and pt.faults([7, 1, 8, 2, 3], known)[1] == {1}
    assert pt.faults([7, 7, 8, 8], known)[1] == {1} and pt.faults([1, 2], known)[1] == set()
    assert pt.faults([1, 1, 2, 3], known)[1] == {0}


def test_longest_ascending_part():
    from itertools import combinations, permutations

    for places in permutations(range(5)):
        left = [p for i, p in enumerate(places) if i not in pt.out_of_order(list(places))]
        best = max(k for k in range(6) for c in combinations(places, k) if list(c) == sorted(c))
        assert left == sorted(left) and len(left) == best


def test_hostile_pages_take_linear_time():
    import time
    import tracemalloc

    n = 50_000
    hostile = ['<a "' * 250_000, "<div>x" * n, "<b>" * n + "<div></div>" * n, "<div>" * n + "</i>" * n, "<" * 1_000_000, "<p>" + "<script>" * n, "&" * 500_000]
    for page in hostile:
        start = time.perf_counter()
        pt.main_text(page)
        assert time.perf_counter() - start < 5
    tracemalloc.start()
    pt.events(hostile[1])
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_text_beside_an_inline_advert_stays():
    assert pt.main_text("<p>one <span class=ad>Buy</span> two</p>") == "one two"
