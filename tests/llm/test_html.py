"""Main text of pages: parsing, furniture, site templates against plain counts, edge cases."""

from __future__ import annotations

import html
import random
from collections import defaultdict

import pytest

pytest.importorskip("tagloom.llm")

from tagloom.llm.html_text import blocks, extract_text, main_element, measure, named_furniture, parse, without  # noqa: E402


def read(source: str):
    every = parse(source)
    measure(every)
    main = main_element(every)
    return main is not every[0], main.hash, *blocks(main)


def text(source: str) -> str:
    return "\n\n".join(read(source)[2])


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>one<p>two <b>bold<br>x</b>", "one\n\ntwo bold x"),
        ("<article><h1>T &amp; x &am</h1><p><b>lead.<br><p>next</p></article><footer>f</footer>", "T & x &am\n\nlead.\n\nnext"),
        ("<nav>n</nav><header>h</header><main><p>a</p><aside>s</aside><div class='cookie-notice'>c</div><form>f</form></main>", "a"),
        ("<article><p>a</p><section id='comments'><article class='comment'><p>nice</p></article></section></article>", "a"),
        ("<script>var t = '</p>';</script><style>p{}</style><!-- <p>no</p> --><div>x<ul><li>a<li>b</ul></div>", "x\n\na\n\nb"),
        ("a &lt;b&gt; &#233; &nbsp; c", "a <b> é c"),
        ("", ""), ("   ", ""), ("<", "<"), ("<p", ""), ("<p>x</p", "x"), ("</p></div>x", "x"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<div role='navigation'>n</div><div hidden>h</div><p>t</p>", "t"),
        # names of parts of an article that only look like furniture, and its own header
        (
            "<article><header><h1>Title</h1></header><div class='side-effects'>s</div><p class='notice'>n</p>"
            "<section class='comments-on-the-law'>c</section><div class='ad-slot'>ad</div><div class='share'>sh</div></article>",
            "Title\n\ns\n\nn\n\nc",
        ),
        # a teaser article is not the main text
        ("<main><p>" + "long " * 50 + "</p><article class='card'>t</article></main>", " ".join(["long"] * 50) + "\n\nt"),
    ],
)
def test_blocks(source, want):
    assert text(source) == want


def test_names():
    assert all(named_furniture(n) for n in ("ad", "site-header", "x comment_list", "Cookie-Notice", "related-posts"))
    assert not any(named_furniture(n) for n in ("", "side-effects", "header-image", "no-sidebar", "main-content", "adage", "post"))


@pytest.mark.parametrize("opening", ["<div>", "<b>", "<p><i>", "<article><div>", "<table><tr><td>", "<ul><li>"])
def test_deep_trees(opening):
    assert text(opening * 100_000 + "deep" + "</i></span>" * 100_000 + "</div>" * 100_000) == "deep"


def plain(rows, min_pages, min_share):
    """Texts after removal, from counts in dictionaries."""
    parts = [(i, host, *read(source or "")) for i, host, source in rows]
    seen = defaultdict(dict)
    for _, host, marked, content, texts, spans in parts:
        seen[host][content] = {h for h, a, b in spans if not marked or sum(map(len, texts[a:b])) >= 20}
    out = []
    for i, host, marked, _, texts, spans in parts:
        many = defaultdict(int)
        for own in seen[host].values():
            for h in own:
                many[h] += 1
        gone = {h for h, n in many.items() if n >= min_pages and 100 * n >= min_share * len(seen[host])}
        cut = {j for h, a, b in spans if h in gone for j in range(a, b)}
        left = [t for j, t in enumerate(texts) if j not in cut]
        out.append((i, "\n\n".join(texts if marked and 2 * sum(map(len, left)) < sum(map(len, texts)) else left)))
    return out


def test_templates_equal_plain_counts(spark):
    r = random.Random(5)
    words = "tree house river stone cloud light paper glass wind night road hill".split()

    def sentence(n):
        return " ".join(r.choice(words) for _ in range(n))

    rows = []
    for host in range(4):
        shared = [f"<div><p>{sentence(8)}</p><ul><li>{sentence(5)}</ul></div>" for _ in range(3)]
        for i in range(25):
            body = "".join(f"<p>{sentence(r.randint(2, 30))}</p>" for _ in range(r.randint(1, 4)))
            body += "".join(x for x in shared if r.random() < (0.1, 0.3, 0.9, 1.0)[host])
            if r.random() < 0.7:
                body = f"<article>{body}</article><div>outside {host}</div>"
            rows += [(host * 100 + i, f"h{host}", body)] * r.choice((1, 1, 2))
    df = spark.createDataFrame([(i, f"http://{h}/p/{i}", b) for i, h, b in rows], "page_id bigint, url string, html string").repartition(3)
    got = sorted((x.page_id, x.text) for x in extract_text(df).collect())
    want = sorted(plain(rows, 5, 20))
    assert got == want
    whole = {i: "\n\n".join(read(b)[2]) for i, _, b in rows}
    assert 10 < sum(t != whole[i] for i, t in want) < len(want)


def test_site_templates_go_and_articles_stay(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><div><p>Subscribe to our letter now</p></div><div><p>story {i} of the day</p></div></body>") for i in range(20)]
    # copies of one page are one content: nothing recurs on them
    rows += [(100 + i, f"https://b.example/{i}", "<body><p>the same page</p></body>") for i in range(20)]
    # most of the article recurs: it is no template
    rows += [(200 + i, f"https://c.example/{i}", f"<body><article><p>{'same words ' * 9}</p><p>{i}</p></article><div>box</div>{i}</body>") for i in range(20)]
    # a notice without a name inside the article
    own = "<article><p>news number {} from the river and the hills today</p><div>Read this in our app for a better view</div></article>"
    rows += [(400 + i, f"https://d.example/{i}", own.format(i)) for i in range(20)]
    rows += [(300, None, None), (301, "odd", ""), (None, "http://a.example/x", "<p>null id</p>"), (300, None, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, text string, gone string")
    got = [(r.page_id, r.text, r.n_chars) for r in extract_text(df).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    by = {i: t for i, t, _ in got}
    assert all(by[i] == f"story {i} of the day" for i in range(20))
    assert all(by[100 + i] == "the same page" and by[200 + i] == ("same words " * 9).strip() + f"\n\n{i}" for i in range(20))
    assert all(by[400 + i] == f"news number {i} from the river and the hills today" for i in range(20))
    assert by[300] == "" and by[301] == "" and by[None] == "null id"
    assert extract_text(df.limit(0)).count() == 0
    assert without("a\n\nb", False, frozenset({7}), [(7, 0, 1)]) == "b"


def test_long_pages(spark):
    body = "".join(f"<p>{html.escape(w)} & more</p>" for w in ("x" * 1000,) * 300)
    df = spark.createDataFrame([(1, "http://a/", f"<html><nav><a href='/'>m</a></nav><article>{body}</article></html>")], "page_id bigint, url string, html string")
    assert len(extract_text(df).first().text.split("\n\n")) == 300
