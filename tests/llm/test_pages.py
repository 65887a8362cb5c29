"""Main text of pages."""

import html
import re

import pytest

from agoralytics.llm import html_paths


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<p>a<p>b <b>c", "a\n\nb c"),
        ("x &amp y &lt; 3 < 4 <scr", "x & y < 3 < 4"),
        ("<main><h1>T</h1><p>one\n  two&nbsp;three<br>four</p><aside>no</aside></main><footer>f</footer>", "T\n\none two three four"),
        ("<div class=post><p>text of the post</p><div class='comment-list'>c c c</div><ul><li>a<li>b</ul></div>", "text of the post\n\na\n\nb"),
        ("<article><p>long enough text</p><script>var a = '<p>no</p>'</script><form>no</form><style>p{}</style></article>", "long enough text"),
        ("<article>a text</article><article class='comment'>a much longer text by some reader of it</article>", "a text"),
        ("<div id=sidebar>no no no no no</div><div>yes yes</div><div role='navigation'>no</div>", "yes yes"),
        ("<body><p>a &#65;&eacute; b</p><!-- <p>no</p> --></body>", "a Aé b"),
        ("<div class=post><h1>T</h1><div class=intro>lead text</div><div class=body><p>one long text<p>and more</div></div>", "T\n\nlead text\n\none long text\n\nand more"),
        ("<article><div class=a>one part here</div><div class=b>another part here</div></article>", "one part here\n\nanother part here"),
        ("<article><h1>T</h1><div><div>some text</div></div></article>", "T\n\nsome text"),
        ("<article><header><h1>T</h1><nav>no</nav><p>by no one</p></header><p>some text</p></article><header><h2>no</h2></header>", "T\n\nsome text"),
        ("<article><p>a longer text</p><p class='related-work'>kept</p><p class=advert>no</p></article>", "a longer text\n\nkept"),
        ("<body><div id=page><div class=top><a href=x>one</a> <a href=y>two</a></div><div class=b><h1>T</h1><p>text of it</p></div></div>", "T\n\ntext of it"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ],
)
def test_extract(page, text):
    assert html_paths.extract(page, []) == text


def test_host_decides(spark):
    """A page whose own best container is another one is read by the path that won on its host."""
    usual = "<div class='a1'>{}</div><div class='b7'>{}</div>"
    rows = [(i, "http://h.x/p", usual.format("article text " * 9, "short")) for i in range(9)]
    rows += [(9, "https://H.x:80/q", usual.format("brief", "a long notice " * 20)), (10, "http://other.x/", usual.format("brief", "a long text " * 20))]
    got = {r.page_id: r.text for r in html_paths.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief" and got[10].startswith("a long text") and got[0].startswith("article text")


def test_on_table(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")

    def plain(page):
        inner = re.search("<article>(.*)</article>", page, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", inner.replace("<br>", " ")))
        return "\n\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)

    got = {r.page_id: (r.text, r.n_chars) for r in html_paths.main_text(pages).collect()}
    assert got == {r.page_id: (plain(r.html), len(plain(r.html))) for r in pages.collect()}


def test_templates(rng):
    """Articles put into templates come out whole: wrappers, split bodies, titles apart, noise around and between."""
    def words(n):
        return " ".join(rng.choice(["word", "text", "line", "other"]) + str(rng.randint(0, 99)) for _ in range(n))

    for _ in range(300):
        title, parts = words(4), [words(rng.randint(20, 60)) for _ in range(rng.randint(1, 6))]
        noise = [f"<div class='{rng.choice(['sidebar', 'comment-list', 'ad', 'newsletter'])}'><p>{words(rng.randint(1, 80))}</div>", "<nav><a>x</a></nav>", ""]
        body = [f"<p>{x}</p>" + rng.choice(noise) for x in parts]
        cut = rng.randint(0, len(body))
        inner = rng.choice([
            "".join(body),
            f"<div class=body>{''.join(body)}</div>",
            f"<div><div class=c1>{''.join(body)}</div></div>",
        ])
        split = f"<div class=one>{''.join(body[:cut])}</div><div class=two>{''.join(body[cut:])}</div>"
        page = rng.choice([
            f"<article><h1>{title}</h1>{inner}</article>",
            f"<article><header><h1>{title}</h1></header>{split}</article>",
            f"<main><article><h1>{title}</h1>{split}</article></main>",
            f"<div class=post><h1>{title}</h1>{inner}</div>",
        ])
        page = f"<body><header><h1>site</h1></header>{rng.choice(noise)}{page}{rng.choice(noise)}<footer>{words(30)}</footer></body>"
        assert html_paths.extract(page, []) == "\n\n".join([title, *parts]), page


def test_odd(spark):
    rows = [(1, None, None), (None, "u", "<p>x"), (None, "u", "<p>x"), (2, "//h", "<div>" * 5000 + "deep"), (3, "http://h", "w " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", html_paths.F.lit("other"))
    got = sorted((str(r.page_id), r.n_chars) for r in html_paths.main_text(pages).collect())
    assert got == [("1", 0), ("2", 4), ("3", 199_999), ("None", 1), ("None", 1)]
    assert html_paths.main_text(pages.limit(0)).count() == 0
