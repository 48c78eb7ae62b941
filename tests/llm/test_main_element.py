"""Main text of pages with a main element."""

from matlink.llm import html_text


def text_of(page):
    return html_text.walk(page)[1]


def test_templates_inside_main(spark):
    box = "<div>box of the site</div>"
    rows = [(i, f"http://h/{i}", f"<body><main>{box}<div><p>page {i} has words</p></div></main></body>") for i in range(8)]
    rows += [(10 + i, f"http://h/{10 + i}", f"<body><main>{box}<div><article><p>text {i}</p><p>licence</p></article></div></main></body>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (1 << 20, 0):
        got = {r.page_id: r.text for r in html_text.main_text(pages, broadcast_limit=limit).collect()}
        assert got == {i: f"page {i} has words" for i in range(8)} | {10 + i: f"text {i} licence" for i in range(8)}


def test_article_or_main():
    long = "many words of the page itself"
    assert text_of(f"<main><p>{long}</p></main><article>teaser</article>") == long
    assert text_of(f"<main><p>{long}</p><article>teaser</article></main>") == f"{long} teaser"
    assert text_of(f"<main><p>by me</p><article>{long}</article></main>") == long
    assert text_of(f"<article>{long}</article><main>short</main>") == long
    assert text_of(f"<article><main>{long}</main></article>") == long
    assert text_of("<main></main><p>body") == "body" and text_of("<article></article><main>m</main>") == "m"
