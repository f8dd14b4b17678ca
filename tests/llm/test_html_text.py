from __future__ import annotations

import random
from collections import defaultdict

import pytest
from shopsight.llm import html_text


def one(page, template=()):
    root = html_text.parse(page)
    return html_text.article_text(root, html_text._mains(root), set(template))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<article><h1>T</h1><p>a<b>b</b> c&nbsp;d\n &lt;x&gt;</p></article>", "T ab c d <x>"),
        ("<body><nav>n</nav><main><article><p>one<p>two<br>three</article></main><footer>f</footer>", "one two three"),
        ("<article><p><b>open.<br><p>next</p><aside>no</aside><ul><li>x<li>y</ul></article>", "open. next x y"),
        ('<div><p>a</p><div class="page-sidebar">s</div><div id="comments"><p>c</p></div><form>f</form>tail</div>', "a tail"),
        ('<script>var t="</p><article>";</script><article>a<!-- b --><style>p{}</style></article>', "a"),
        ('<article>x<div style="display:none">h</div><div role="complementary">r</div><p>1 < 2 and 3 > 2</p></article>', "x 1 < 2 and 3 > 2"),
        ('<main class="header-page"><p>kept</p><article class="comment"><p>no</p></article></main>', "kept"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<article>a<article>b</article></article><article>c</article>", "a b c"),
        ("<article class='post no-sidebar'><p>kept</p></article><p>rest</p>", "kept"),
        ("<article class='has-comments'><p>kept</p><ol class='comment-list'><li>c</li></ol></article>", "kept"),
        ("<article><div class='entry-header'><h1>T</h1></div><p>a</p></article>", "T a"),
        ("<article><div class='header'><h1>T</h1></div><p>a</p></article>", "T a"),
        ("<body><div class='site-header'>s</div><div id='masthead'>m</div><p>a</p></body>", "a"),
        ("<article><p class='social'>a</p><div class='share-price'>b</div><h2 class='related'>c</h2></article>", "a b c"),
        ("<article><p>a</p><p class='ad'>x</p><div class='ad-slot-3 wide'>y</div><div class='social-links'>z</div></article>", "a"),
        ("<body><div class='sidebar'><article class='related'>only</article></div></body>", "only"),
    ],
)
def test_rules(page, text):
    assert one(page) == text


def test_deep_nesting_ends():
    assert one("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert one("<b>" * 20_000 + "<p>y") == "y"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_host_template_goes_and_copies_make_none(spark, docs_of):
    body = lambda i, more="": f"<body><div class='top'>Welcome to us</div><div>{more}<p>story {i} text</p></div><div><p>Read {i % 2} on</p></div></body>"
    rows = [(i, f"https://a.example/p{i}", body(i)) for i in range(12)]
    rows += [(100 + i, "http://b.example/", body(7)) for i in range(9)]
    rows += [(200, None, None), (201, "https://a.example:8080/x", ""), (202, "HTTPS://A.EXAMPLE/y", body(99))]
    out = {r["page_id"]: r for r in html_text.extracted(pages(spark, rows)).collect()}
    assert len(out) == len(rows)
    for i in [*range(12), 202]:
        n = 99 if i == 202 else i
        assert out[i]["text"] == f"story {n} text"  # the greeting and the two kinds of links stand on many pages
    assert out[100]["text"] == "Welcome to us story 7 text Read 1 on"  # one article, however often
    assert out[200]["text"] == "" and out[201]["text"] == "" and out[200]["n_chars"] == 0


def test_repeated_paragraphs_of_articles_stay(spark, docs_of):
    rows = [(i, "https://a.example/", f"<article><p>Same line.</p><p>own {i}</p><div class='x'>Follow us</div></article>") for i in range(8)]
    out = html_text.extracted(pages(spark, rows)).collect()
    assert {r["text"] for r in out} == {f"Same line. own {i}" for i in range(8)}
    assert html_text.extracted(pages(spark, [])).count() == 0


def test_section_menus_of_a_large_host_go(spark, docs_of):
    page = lambda i: f"<body><div>Section {i % 5} menu</div><div><p>story {i}</p></div></body>"
    rows = [(i, "https://a.example/", page(i)) for i in range(200)]
    out = html_text.extracted(pages(spark, rows)).collect()
    assert {(r["page_id"], r["text"]) for r in out} == {(i, f"story {i}") for i in range(200)}


def test_templates_against_brute_force(spark, docs_of):
    rng = random.Random(4)

    def page():
        parts = [f"<{rng.choice(['div', 'p', 'section'])}>{rng.choice('abcdef')} {rng.randint(0, 9) if rng.random() < 0.5 else ''}" for _ in range(rng.randint(1, 5))]
        body = "".join(parts) + f"<b>{rng.randint(0, 60)}"
        return f"<body>{body}</body>" if rng.random() < 0.5 else f"<body><div>{rng.choice('xyz')}</div><article>{body}</article></body>"

    rows = [(i, f"https://{rng.choice('ab')}.example/{i}", page()) for i in range(150)]
    trees = {i: html_text.parse(html) for i, _, html in rows}
    seen, articles = defaultdict(set), defaultdict(set)
    for i, url, _ in rows:
        mains = html_text._mains(trees[i])
        article = html_text.article_text(trees[i], mains, set())
        articles[url[8]].add(article)
        for node, inside in html_text._candidates(trees[i], mains):
            seen[url[8], node.digest, inside].add(article)
    expected = {}
    for i, url, _ in rows:
        mains, host = html_text._mains(trees[i]), url[8]
        gone = set()
        for node, inside in html_text._candidates(trees[i], mains):
            n = len(seen[host, node.digest, inside])
            if n >= html_text.MIN_PAGES and (not inside or n >= html_text.MIN_SHARE * len(articles[host])) and (inside or mains == [trees[i]]):
                gone.add(node.digest)
        expected[i] = html_text.article_text(trees[i], mains, gone)
    out = html_text.extracted(pages(spark, rows)).collect()
    assert {r["page_id"]: r["text"] for r in out} == expected
    assert any(expected[i] != html_text.article_text(trees[i], html_text._mains(trees[i]), set()) for i in expected)


def test_columns_with_clashing_names(spark, docs_of):
    rows = [(i, "https://a.example/", f"<div>menu</div><p>own {i}</p>", "h", "t", 1) for i in range(5)]
    clashing = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, template string, page int")
    assert {r["text"] for r in html_text.extracted(clashing).collect()} == {f"own {i}" for i in range(5)}
