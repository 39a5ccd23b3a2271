"""Text, rows and matches that earlier versions of the operators lost."""

import re

from varlake.llm import mainhtml


def test_html_short_parts_beside_long_ones():
    items = "".join(f"<li>{c}</li>" for c in "ABC")
    share, long = f"<ul class=share>{items}</ul>", "x" * 100_000
    assert mainhtml.main_text(f"<article><h1>Title</h1>{share}<p>{long}</p>{share}<p>End.</p></article>") == f"Title\n{long}\nEnd."
    assert mainhtml.main_text(f"<div><h1>Title</h1>{share}<p>{long}</p>{share}<p>End.</p></div>") == f"Title\n{long}\nEnd."
    linked = "".join(f"<li><a>{c}</a></li>" for c in "ABCD")
    assert mainhtml.main_text(f"<article><h1>Title</h1><ul>{linked}</ul><p>{long}</p></article>") == f"Title\nA\nB\nC\nD\n{long}"
    early = "A first part of the text that is much shorter."
    assert mainhtml.main_text(f"<p>{early}</p><ul>{linked}</ul><p>{long}</p>") == f"{early}\nA\nB\nC\nD\n{long}"
    assert mainhtml.main_text(f"<p>My site</p><ul>{linked}</ul><p>{long}</p><ul>{linked}</ul>") == long


def test_html_names_of_wrappers_and_text():
    body = "<h1>Title</h1><p>The first paragraph of it.</p><p>The second one.</p>"
    want = "Title\nThe first paragraph of it.\nThe second one."
    for name in ("content has-sidebar", "layout-no-sidebar", "elementor-widget-container", "page header-fixed", "page widget", "hasSidebar"):
        for inner in (body, f"<article>{body}</article>"):
            for page in (f"<div class='{name}'>{inner}</div>", f"<div id={name.split()[-1]}>{inner}</div>"):
                assert mainhtml.main_text(page + "<div class='footer'>imprint</div>") == want
    apart = "".join(f"<div class='elementor-widget-container'>{b}</div>" for b in ("<h1>Title</h1>", "<p>The first paragraph of it.</p>", "<p>The second one.</p>"))
    assert mainhtml.main_text(apart) == mainhtml.main_text(apart.replace("-container", "")) == want
    assert mainhtml.main_text("<article><h2 class='section-header'>Part</h2><p class='alert'>Mind this.</p><div class='my-ad'>Buy</div><p>And the rest of it.</p></article>") == "Part\nMind this.\nAnd the rest of it."
    formula = "<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><xmp><b>raw</b> &amp;</xmp><p>End.</p></article>"
    assert mainhtml.main_text(formula) == "So x=1 holds.\n<b>raw</b> &amp;\nEnd."


def test_html_names_still_tell_furniture():
    talk = "<div id=comments>" + "<article class=comment><p>I disagree with every single word of this article.</p></article>" * 20 + "</div>"
    assert mainhtml.main_text(f"<article><p>The article.</p></article>{talk}") == "The article."
    assert mainhtml.main_text(f"<div class='page wrap-widget'><article><p>The article.</p></article>{talk}</div>") == "The article."
    text = "A long paragraph of the text of this page. " * 20
    aside = "<div class='sidebar'><article>A teaser of another page.</article></div>"
    assert mainhtml.main_text(f"<div><p>{text}</p></div>{aside}<div class='related-posts'><p>More of it</p></div>") == text.strip()
    assert mainhtml.main_text("<div class=widget>" * 20000 + "<p>x</p>" * 20000) == "\n".join("x" * 20000)


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (7, c), (None, d), (None, d), (None, a), (9, None), (9, None), (10, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(3, a), (5, b), (7, c), (None, d), (9, None), (9, None), (10, "")], key=repr)


LONG = "A long paragraph with many words about the matter at hand, as articles have them. " * 4
MENU = "<ul>" + "".join(f"<li><a href=/{i}>Part {i} of the site</a></li>" for i in range(6)) + "</ul>"
# Pages without article markup or telling names: markup, and the main text that a reader would mark.
PLAIN_PAGES = [
    (f"<div>My site</div>{MENU}<div><h1>The title</h1><p>{LONG}</p><p>It ends here.</p></div>{MENU}<div>&copy; 2020 My site. All rights reserved.</div>", ["The title", LONG, "It ends here."]),
    (f"<div>{MENU}</div><div>Accept what we store.</div><div><h1>The title</h1><div>By A. Writer</div><p>{LONG}</p></div><div>{MENU}</div>", ["The title", "By A. Writer", LONG]),
    (f"<p>{LONG}</p>{MENU}<p>A short last paragraph.</p>", [LONG, *(f"Part {i} of the site" for i in range(6)), "A short last paragraph."]),
    (f"<table><tr><td>{MENU}</td><td><b>Heading</b><br>{LONG}</td></tr><tr><td>Imprint</td></tr></table>", ["Heading " + LONG]),
    (f"<div><a href=/>Home</a></div><div><a href=/b>Shop</a></div><div><a href=/c>Help</a></div><div>{LONG}</div><div>{LONG}</div><div><a href=/d>Next page</a></div>", [LONG, LONG]),
    ("<div>Weather</div><div>Sport</div><div>News</div><div>Cars</div>" + MENU + f"<div>{LONG}</div>" + MENU + "<div>Jobs</div><div>Terms</div>", [LONG]),
]


def wanted(parts):
    return "\n".join(" ".join(p.split()) for p in parts)


def test_html_pages_without_marks():
    for page, parts in PLAIN_PAGES:
        assert mainhtml.main_text(page) in (wanted(parts), wanted(parts) + "\nImprint"), page


def test_html_result_depends_on_the_window_step(monkeypatch):
    """Without surge and dive every one of the plain pages, and a page that marks its article, would come out otherwise."""
    marked = (f"<div>{LONG}</div><article><header><h1>Title</h1></header><p>{LONG}</p>{MENU}<p>End.</p></article><div>{LONG}</div>", ["Title", LONG, *(f"Part {i} of the site" for i in range(6)), "End."])
    pages = [p for i, p in enumerate(PLAIN_PAGES) if i != 2] + [marked]
    assert mainhtml.main_text(marked[0]) == wanted(marked[1])
    monkeypatch.setattr(mainhtml, "surge_and_dive", lambda own: (0, len(own) - 1))
    assert sum(mainhtml.main_text(p) != wanted(parts) for p, parts in pages) >= len(PLAIN_PAGES) - 1


def test_html_comments_and_headers():
    talk = "<article class='comment'><p>I disagree strongly.</p></article>"
    assert mainhtml.main_text(f"{talk}<div><p>{LONG}</p></div>{talk}") == wanted([LONG])
    assert mainhtml.main_text(f"<main><article><p>{LONG}</p></article>{talk * 30}</main>") == wanted([LONG])
    assert mainhtml.main_text(f"<article><header><h1>T</h1></header><p>{LONG}</p><section class=comments><article><p>reader</p></article></section></article>") == wanted(["T", LONG])
    assert mainhtml.main_text(f"<header>Site</header><div class='post-header'><h1>T</h1></div><div><p>{LONG}</p></div>") == wanted(["T", LONG])
    assert mainhtml.main_text(f"<div class='share-holders'><p>Text on the holders.</p></div><p>{LONG}</p>") == wanted(["Text on the holders.", LONG])


def test_html_many_empty_graphics_take_linear_time(spark):
    import time

    began = time.process_time()
    assert mainhtml.main_text("<svg/>" * 100_000 + "<p>The text.</p>") == "The text."
    assert time.process_time() - began < 5
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert mainhtml.extract(empty).count() == 0


def test_html_takes_linear_time():
    """A million characters of what used to be scanned again from every place."""
    import time

    for page in ("<script" * 140_000, "<" + "a" * 10**6, "<a title=\"x" * 90_000, "<script>" + "</script " * 120_000, "<p" * 500_000, "<!--" * 250_000, "<textarea>" + "</textarea" * 100_000):
        began = time.perf_counter()
        mainhtml.main_text(page)
        assert time.perf_counter() - began < 10


def test_html_notices_of_paragraphs():
    long = "A long paragraph of the text of this page, which says what it has to say. " * 3
    notices = "".join(f"<p class={c}>Buy this now, and tell all of your friends about it.</p>" for c in ("notice", "newsletter", "cookie-notice", "ad", "share"))
    assert mainhtml.main_text(f"<article><h1>Title</h1><p>{long}</p>{notices}<p class=alert>Mind this.</p><p class=intro>{long}</p></article>") == "\n".join(["Title", long.strip(), "Mind this.", long.strip()])


def bare(page):
    """A page without anything that names a part of it: elements of furniture are divisions, and no attributes are left."""
    page = re.sub(r"<(/?)(nav|header|footer|aside|article|main|section|form|menu|dialog)\b", r"<\1div", page, flags=re.I)
    return re.sub(r"\s(class|id|role|itemprop|aria-\w+|hidden|style)(=(\"[^\"]*\"|'[^']*'|[^\s>]+))?", "", page, flags=re.I)


def test_html_lines_decide_on_the_given_pages(spark):
    """Without any names the window step still finds the text of nearly all given pages, and without that step of none."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r["html"]]
    assert len(pages) > 100
    want = [mainhtml.main_text(p) for p in pages]
    found = [mainhtml.main_text(bare(p)) for p in pages]
    joined = ["\n".join(line[0] for line in mainhtml.lines(bare(p)) if not line[1]) for p in pages]
    right = lambda got: sum(g == w for g, w in zip(got, want)) / len(pages)
    assert right(found) >= 0.9 and right(joined) <= 0.1
