import pytest
from pyspark.sql import functions as F

from tieout.llm.htmltext import extract, main_text

CASES = {
    "<html><body><nav><a href=a>Home</a></nav><article><h1>T &amp; U</h1><p>one\n <b>two</b>three<p>four<ul><li>a<li>b</ul>"
    "</article><footer>f</footer></body></html>": "T & U one twothree four a b",
    "<body><main><p>kept text</p><section class='reader-comments'><article>never</article></section></main></body>": "kept text",
    "<body><div id=sidebar>s s s</div><div class=post><p>kept one.</p><p>kept two.</p></div><form>f</form></body>":
        "kept one. kept two.",
    "<body><article>a<script>var x='</p><p>no';</script>b<style>p{}</style> c<!-- d --></article></body>": "ab c",
    "<article><p>x&nbsp;&#8211;&lt;b&gt;</p><p hidden>no</p><aside>no</aside><p>y</article>": "x –<b> y",
    "plain words": "plain words", "": "", "<p>one<p>two": "one two", "<div class='ad'>only adverts</div>": "",
    "<article class='has-sidebar'><p>kept</p></article>": "kept",
    "<article><table><tr><td>a<td>b<tr><td>c</table>after</article>": "a b c after",
}


@pytest.mark.parametrize("source", CASES)
def test_main_text(source):
    assert main_text(source) == CASES[source]


def test_broken_and_huge_markup_ends():
    assert main_text("<div" * 5000 + ">" + "text") != ""
    assert main_text("<div>" * 50_000 + "deep") == "deep"
    assert main_text("<article>" + "<p>word word</p>" * 20_000 + "</article>").count("word") == 40_000
    assert main_text('<article><a href="x>unclosed</a>') is not None


def test_pages_keep_rows_and_columns(spark):
    rows = [(1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t"), (2, None, None, "t"), (None, "v", "", "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract(pages, ["page_id", "url"], "html").orderBy(F.col("page_id").asc_nulls_first(), "url").collect()
    assert [tuple(r) for r in got] == [(None, "v", "", 0), (1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0)]
    assert extract(pages.limit(0), ["page_id", "url"], "html").count() == 0


def _section(name, count, tag="div"):
    body = "".join(f"<p>{name}{k} " + "word " * 73 + "</p>" for k in range(count))
    return f"<{tag}><h2>{name} heading of a part</h2>{body}</{tag}>"


@pytest.mark.parametrize("sizes", [(3, 3), (1, 3), (3, 1), (1, 3, 5), (5, 2, 1), (4, 4, 4)])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_all_sibling_sections_are_the_article(sizes, tag):
    parts = [_section(f"part{i}x", n, tag) for i, n in enumerate(sizes)]
    links = "<div><p>" + " ".join(f"<a href=/{i}>elsewhere number {i} on this site</a>" for i in range(12)) + "</p></div>"
    teaser = "<div><h3>teasertitle</h3><p>teasertext short</p></div>"
    source = f"<html><body><div>{''.join(parts)}</div>{links}{teaser}</body></html>"
    got = main_text(source)
    for i, n in enumerate(sizes):
        assert f"part{i}x heading of a part" in got
        assert all(f"part{i}x{k} word" in got for k in range(n))
    assert "elsewhere" not in got and "teaser" not in got
    nested = f"<body><div>{parts[0]}<div>{''.join(parts[1:])}</div>{links}</div></body>"
    assert all(f"part{i}x{n - 1} word" in main_text(nested) for i, n in enumerate(sizes))
