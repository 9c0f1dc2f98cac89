"""Pages of which nothing that belongs to the article may be lost."""

from geotrail.llm import html

LONG = "Long text, with commas, and more of it, on and on; it goes on for a while, as texts do. " * 6
LONG = LONG.strip()


def test_all_content_is_in_the_article():
    got = html.extract(f"<article><div class=body><p>{LONG}</p><p>{LONG}</p></div><p>A closing paragraph, with some words, at last.</p></article>")
    assert got == f"{LONG} {LONG} A closing paragraph, with some words, at last."
    parts = "".join(f"<div><p>{LONG}</p><p>{LONG}</p></div>" for _ in range(6)) + f"<section><p>{LONG}</p></section>"
    assert html.extract(f"<body><div>{parts}</div></body>") == " ".join([LONG] * 13)


def test_lists_of_links_belong_to_the_article():
    links = "<ul><li><a href=1>First source</a><li><a href=2>Second source</a></ul>"
    assert html.extract(f"<nav>{links}</nav><article><p>{LONG}</p>{links}</article>") == f"{LONG} First source Second source"
    assert html.extract(f"<body>{links}<p>{LONG}</p>{links}<p>{LONG}</p></body>") == f"{LONG} First source Second source {LONG}"


def test_names_dont_empty_a_page():
    side = '<div class="sidebar"><p>Side text, too.</p></div>'
    assert html.extract(f'<body><div class="layout has-sidebar"><div><p>{LONG}</p></div>{side}</div></body>') == LONG
    assert html.extract(f'<div class="widget"><p>{LONG}</p></div><div class="widget"><p>{LONG}</p></div>') == f"{LONG} {LONG}"
    assert html.extract(f'<div id="content"><p>{LONG}</p></div><div class="comments"><p>{LONG}</p><p>{LONG}</p></div>') == LONG
    assert html.extract('<div class="menu"><a href=1>Home</a></div>') == ""
    assert html.extract(f'<main><h1>Title</h1><div class="layout has-sidebar"><p>{LONG}</p></div></main>') == f"Title {LONG}"
    assert html.extract(f'<article><p>Short text, here.</p></article><div class="ad">{LONG}</div>') == "Short text, here."


def test_words_that_only_look_like_names():
    related = '<div class="related-work"><p>Long related work, told at length, with all that others did before; it was much.</p></div>'
    shared = '<div class="story-share"><p>Share price rose on Monday, by a third, after the news.</p></div>'
    got = html.extract(f"<main><h1>Title</h1><p>{LONG}</p>{related}{shared}<p>{LONG}</p></main>")
    assert got == f"Title {LONG} Long related work, told at length, with all that others did before; it was much. Share price rose on Monday, by a third, after the news. {LONG}"
    assert html.extract(f'<article><p>{LONG}</p><div class="notice"><p>{LONG}</p></div></article>') == f"{LONG} {LONG}"  # a weak name, the score of an article


def test_scores_drop_what_no_word_names():
    notice, said = "<div><p>Cookies help us, ok?</p></div>", "<div><p>Great read, thanks!</p></div>"
    assert html.extract(f"<body>{notice}<div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div>{said}</body>") == f"Head {LONG} {LONG}"
    assert html.extract(f"<body>{notice}<article><h1>Title</h1><p>{LONG}</p></article>{said}</body>") == f"Title {LONG}"
    assert html.extract(f"<body><div>{notice}<main><p>{LONG}</p></main></div><div><ul><li>One<li>Two</ul></div></body>") == LONG


def test_results_rest_on_the_scores(monkeypatch, spark):
    """With scores that tell nothing, notices, comments and the adverts of the given pages come out."""
    page = f'<body><div><p>Cookies help us, ok?</p></div><div><p>{LONG}</p></div><div class="ad">Buy now.</div></body>'
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    before = [html.extract(x) for x in [page, *pages]]
    assert before[0] == LONG
    monkeypatch.setattr(html, "path_scores", lambda texts: {path: 1.0 for path, *_ in texts})
    after = [html.extract(x) for x in [page, *pages]]
    assert after[0] == f"Cookies help us, ok? {LONG} Buy now." and sum(a != b for a, b in zip(before, after)) > len(pages) / 2


def test_odd_pages(spark):
    rows = [(1, "u", None, 0), (2, None, "", 0), (None, "u", f"<p>{LONG}</p>", 0), (None, "u", f"<p>{LONG}</p>", 0), (3, "u", f"<article><p>{LONG * 3000}</p></article>", 0), (4, "u", "<div><p>same, same.</p></div><div><p>same, same.</p></div>", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").withColumnRenamed("text", "n_chars")
    got = sorted((str(r.page_id), r.text) for r in html.extract_pages(df).collect())
    assert got == [("1", ""), ("2", ""), ("3", " ".join((LONG * 3000).split())), ("4", "same, same. same, same."), ("None", LONG), ("None", LONG)]
    assert html.extract_pages(df.limit(0)).collect() == []


def test_articles_that_are_no_articles():
    comment = f'<article class="comment-body"><p>{LONG}</p></article>'
    assert html.extract(f"<body><article><p>{LONG} One.</p></article>{comment}</body>") == f"{LONG} One."
    assert html.extract(f'<body><article><p>{LONG} One.</p></article><div id="comments">{comment}{comment}</div></body>') == f"{LONG} One."
    assert html.extract(comment) == LONG  # all there is
    for state in ("hidden", 'aria-hidden="true"', 'style="color: red; display: none"', 'role="dialog"'):
        for tag in ("article", "main", "div"):
            assert html.extract(f"<body><{tag} {state}><p>{LONG} {LONG}</p></{tag}><div><p>{LONG}</p></div></body>") == LONG, (state, tag)


def test_titles_and_several_articles():
    for tag in ("article", "main"):
        for head in ('<div class="header"><h1>Title</h1></div>', "<header><h1>Title</h1></header>", '<div class="page-header"><h1>Title</h1></div>'):
            assert html.extract(f"<{tag}>{head}<p>{LONG}</p></{tag}>") == f"Title {LONG}", head
    assert html.extract(f'<body><div class="header"><h1>Site</h1></div><article><p>{LONG}</p></article></body>') == LONG
    assert html.extract(f"<body><article><p>{LONG}</p></article><article><p>Short, too.</p></article></body>") == f"{LONG} Short, too."
    assert html.extract(f'<body><article><p>{LONG}</p></article><article class="related"><p>Short, too.</p></article><aside><article>Aside.</article></aside></body>') == LONG


def test_smoothing_decides(monkeypatch):
    """A short path inside the text's own container is carried by it, one as long elsewhere isn't."""
    text = ("Some words, here; " * 10).strip()
    near, far = "<div><div><p>Near words, here; and more, here.</p></div></div>", "<div><p>Far words, here; and more, here;</p></div>"
    page = f"<body><div><p>Top, here;</p>{near}<div><p>{text}</p></div></div>{far}</body>"
    assert html.extract(page) == f"Top, here; Near words, here; and more, here. {text}"
    monkeypatch.setattr(html, "SAME", 0)
    monkeypatch.setattr(html, "NEAR", 0)
    assert html.extract(page) == text
