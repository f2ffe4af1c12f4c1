import pytest

from corpusloom.llm import html


def text_of(page, menus=(), constants=()):
    root, stats = html.parse(page), []
    html.skeleton(root, [0], stats)
    return html.content(root, list(range(len(stats))), set(menus), set(constants))


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain <b>te</b>xt &lt;y &amp;am &copy 2", "plain text <y &am © 2"),
    ("<p>one<p>two<b>x<p>three", "one\ntwox\nthree"), ("<p>a\n \t b&nbsp;c<br>d</p>", "a b c d"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"), ("x<div>y</div>z", "x\ny\nz"),
    ("<article><header><h1>T</h1><p>by me</p></header><p>body</p></article><footer>f</footer>", "T\nbody"),
    ("<body><header><h1>Site</h1></header><nav>n</nav><div id='side-bar' class=sidebar>s</div><main><p>m</p></main></body>", "m"),
    ("<p>keep</p><div class='cookie-notice'>c</div><form>f</form><aside>a</aside><section id=comments><p>First!</p></section>", "keep"),
    ("<p>a<script>var x = '<p>no</p>'</script>b<style>p{}</style></p><!-- <p>no</p> --><p>c", "a b\nc"),
    ("<script>never closed <p>x", ""), ("<p title='a > b'>t</p><p hidden>h</p><p style='display: none'>h</p>", "t"),
    ("<html><head><title>T</title></head><body><p>b <a href=x>link</a> e</p></body></html>", "b link e"), ("<p>cut<p", "cut"), ("a < b", "a < b"),
    ("<div class='has-sidebar'><article>a</article></div><div class=sidebar>s</div>", "a"), ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after", "deep\nafter"),
    ("<article class='comment'>c</article><article>a1</article><article>a2</article>", "a1\na2"),
])
def test_content_of_a_page(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize("block", ["<section id=related-work><p>x</p></section>", "<div class=legal>x</div>", "<p class=notice>x</p>", "<div class=share-price>x</div>",
                                   "<table><tr><td class=social>x</td></tr></table>", "<h2 class=section-header>x</h2>", "<div class='search-method'>x</div>",
                                   "<p class='comment'>x</p>", "<div id=reply-to-critics>x</div>", "<div class=navigation-history>x</div>"])
def test_names_inside_an_article_keep_its_text(block):
    assert text_of(f"<body><article><h1>T</h1><p>a</p>{block}<p>b</p></article></body>") == "T\na\nx\nb"


@pytest.mark.parametrize("block", ["<section class=comments><p>x</p></section>", "<div class='ad'>x</div>", "<p class=advert>x</p>", "<div class='related-posts'>x</div>",
                                   "<div class='social-share'>x</div>", "<div id=newsletterSignup>x</div>", "<ul class='share-buttons'><li>x</ul>", "<form>x</form>",
                                   "<div class='comment-list'>x</div>", "<span class=sponsored>x</span>", "<nav>x</nav>", "<div role=complementary>x</div>", "<div class='cookie-notice'>x</div>"])
def test_furniture_inside_an_article_goes(block):
    assert text_of(f"<body><article><h1>T</h1><p>a</p>{block}<p>b</p></article></body>") == "T\na\nb"


def tree(tag, *children):
    return [tag, "", list(children)]


def test_simple_tree_matching_counts_the_largest_match():
    a = tree("a", tree("b", tree("d"), tree("e")), tree("c", tree("f")), tree("e"))
    b = tree("a", tree("b", tree("e"), tree("d")), tree("g"), tree("c", tree("h"), tree("f")))
    # a, b with one of d and e, c with f; equal (empty) classes add a half each
    assert html.matched(a, b, {}) == 5 * 1.5
    assert html.matched(tree("a"), tree("b"), {}) == 0


def test_templates_hold_both_trees():
    a, b = tree("a", tree("x"), tree("y")), tree("a", tree("x"), tree("z"), tree("y", tree("w")))
    template = html.merge(a, b)
    assert template == tree("a", tree("x"), tree("z"), tree("y", tree("w")))
    assert html.slots(a, template) == [0, 1, 3] and html.slots(b, template) == [0, 1, 2, 3, 4]
    assert html.slots(tree("a", tree("q")), template) == [0, -1]


def page(i, extra=""):
    return (f"<body><div class=x><a href=1>Home {i}</a> <a href=2>News {i}</a></div><div class=y><h1>Title {i}</h1><p>Body of page number {i}.</p>"
            f"<p>Read our terms of use.</p>{extra}</div></body>")


def extracted(spark, rows):
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return {r.page_id: r.text for r in out}


def test_constant_nodes_and_menus_are_template(spark):
    rows = [(i, f"http://h.example/{i}", page(i, "<div>extra</div>" if i == 3 else "")) for i in range(6)] + [(9, "http://one.example/", page(9))]
    got = extracted(spark, rows)
    assert got[0] == "Title 0\nBody of page number 0." and got[3] == "Title 3\nBody of page number 3.\nextra"
    assert got[9] == "Title 9\nBody of page number 9.\nRead our terms of use."  # a single page has no constant text


def test_a_link_in_a_wrapper_keeps_what_it_wraps(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><div class=page><a href=#c>Skip to content</a><article><h1>T{i}</h1><p>Body of {i}.</p></article></div></body>")
            for i in range(6)]
    rows += [(100 + i, f"http://b.example/{i}", f"<body><div class=col><a href=/{i}>Permalink {i}</a><p>Text of {i}.</p></div></body>") for i in range(6)]
    got = extracted(spark, rows)
    assert all(got[i] == f"T{i}\nBody of {i}." and got[100 + i] == f"Text of {i}." for i in range(6))


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://h.example/same", "<article><h1>T</h1><p>All of it.</p></article>") for i in range(40)]
    rows += [(100 + i, "http://h.example/o", f"<article><h1>U{i}</h1><p>p{i}</p></article>") for i in range(5)]
    got = extracted(spark, rows)
    assert got[0] == "T\nAll of it." and got[101] == "U1\np1"


@pytest.mark.parametrize("inside,around", [("", "<div class=x>Buy thing {i}</div>"), ("", "<section class=comments><p>I say {i}</p></section>"),
                                           ("<p>{i} May</p>", ""), ("<p>{i} May</p>", "<div class=x>Buy thing {i}</div>")])
def test_near_copies_of_an_article_are_no_template(spark, inside, around):
    body = [f"Paragraph {k} of the article that many pages hold, long enough to be told from a date." for k in range(3)]
    article = "<article><h1>Title</h1>" + inside + "".join(f"<p>{b}</p>" for b in body) + "</article>"
    rows = [(i, f"http://h.example/{i}", f"<body><div class=y>Our terms.</div>{article}{around}</body>".replace("{i}", str(i))) for i in range(30)]
    rows += [(100 + i, f"http://h.example/o{i}", f"<body><div class=y>Our terms.</div><article><h1>U{i}</h1><p>p{i}</p><p>Read on.</p></article></body>") for i in range(6)]
    got = extracted(spark, rows)
    assert all(set(["Title", *body]) <= set(got[i].split("\n")) for i in range(30))
    assert all(got[100 + i] == f"U{i}\np{i}" for i in range(6))


def test_edges(spark):
    rows = [(1, None, None), (2, None, "<p>x</p>"), (None, "u", ""), (3, "http://h/", None), (3, "http://h/", "<p>" + "long text " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html.extract(df).collect()
    assert sorted((r.page_id or -1, len(r.text)) for r in out) == [(-1, 0), (1, 0), (2, 1), (3, 0), (3, 499_999)]
    assert html.extract(df.where("false")).count() == 0


def test_table(spark, sf):
    out = html.op5_html_extraction(spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/pages.parquet").count()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in out:
        assert r.n_chars == len(r.text) and "</" not in r.text and (not r.text or "<article" in pages[r.page_id])
