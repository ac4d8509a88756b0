import numpy as np
import pytest

from agora.llm.extraction import extract, main_text, smoothed, two_means

LONG = "A paragraph of the article that has a good number of words in it, as articles do."


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style><script>var a='<p>x</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain words", "plain words"),
        (page(f"<nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{LONG}<p>Yes.<p><b>{LONG}</article><footer>f</footer>"), f"Head\n{LONG}\nYes.\n{LONG}"),
        (page(f"<article><p>a &amp; b &lt;c&gt; &#8364;\n  {LONG}</p></article>"), f"a & b <c> € {LONG}"),
        (page(f"<header><h1>Site</h1></header><main><header><h1>Head</h1></header><p>{LONG}</p></main>"), f"Head\n{LONG}"),
        (page(f"<div class='cookie-notice'>{LONG}</div><div id=post><p>{LONG}</p><p>Ok</p></div><div class=sidebar><p>{LONG}</p></div>"), f"{LONG}\nOk"),
        (page(f"<article><p>{LONG}</p><form>Name <input> {LONG}</form><section id=comments><p>{LONG}</p></section></article>"), LONG),
        (page(f"<article><p>{LONG}</p><div class='ad'>{LONG}</div><aside>{LONG}</aside><p hidden>x</p><p>End</p></article>"), f"{LONG}\nEnd"),
        (page(f"<article><p>One<br>two</p><ul><li>{LONG}<li>three</ul></article>"), f"One two\n{LONG}\nthree"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_without_a_named_article_the_densest_place_is_taken():
    links = "".join(f"<li><a href=/{k}>link {k}</a></li>" for k in range(20))
    html = page(f"<div><ul>{links}</ul></div><div><div><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div></div><div><p>About us</p></div>")
    assert main_text(html) == f"Head\n{LONG}\nShort.\n{LONG}"


def test_very_long_pages():
    html = page("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")
    assert main_text(html) == "\n".join([LONG] * 20_000)


def test_ratios():
    assert smoothed(np.array([5.0])).tolist() == [5.0]
    assert 2 < two_means(np.array([1.0, 1.5, 9.0, 10.0])) < 9


def test_tables_keep_rows_and_columns(spark):
    schema = "page_id long, url string, html string, n_chars string"
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>"), "x"), (1, "u", None, None), (None, None, "", "y")]
    found = extract(spark.createDataFrame(rows, schema))
    assert found.columns == ["page_id", "url", "n_chars", "text"]
    assert sorted((str(r.page_id), r.text) for r in found.collect()) == [("1", ""), ("1", LONG), ("None", "")]
    assert extract(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        extract(spark.createDataFrame(rows, schema), out="URL")
