"""Templates that the reference page of a host doesn't show."""

from codexmill.llm import html

BODY = "<p>Body {0} alpha beta gamma delta epsilon zeta</p><p>More {0} eta theta iota kappa lambda</p>"


def texts(spark, pages):
    rows = [(i, f"http://h.example/{i}", x) for i, x in enumerate(pages)]
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def with_reference(spark, make, others):
    """One page more, `make(k)`, that has the smallest hash and so is the reference."""
    rows = spark.createDataFrame([(0, x) for x in others] + [(k, make(k)) for k in range(1, 2000)], "k int, html string")
    k = rows.selectExpr("min_by(k, xxhash64(html)) AS k").first().k
    assert k
    return [*others, make(k)]


def test_line_that_the_reference_lacks(spark):
    others = [f"<article><h1>T{i}</h1><section>Share this story</section>{BODY.format(i)}</article>" for i in range(12)]
    pages = with_reference(spark, lambda k: f"<article><h1>R{k}</h1>{BODY.format(-k)}</article>", others)
    got = texts(spark, pages)
    assert not any("Share" in x for x in got.values()) and all(f"T{i}\nBody {i} " in got[i] and f"More {i} " in got[i] for i in range(12))


def test_two_layouts(spark):
    a = [f"<main><h1>A{i}</h1><p>Read in the app today</p>{BODY.format(i)}</main>" for i in range(10)]
    b = [f"<main><div class='story s{i}'><h2>B{i}</h2><p>Follow our channel now</p><p>Text {i} mu nu xi omicron pi rho</p></div></main>" for i in range(10)]
    got = texts(spark, a + b)
    assert not any("Read in" in x or "Follow" in x for x in got.values())
    assert all(f"Body {i} " in got[i] and f"Text {i} " in got[10 + i] for i in range(10))


def test_short_reference_leaves_the_template(spark):
    standing = "<p>A standing text that is longer than a title and line</p>"
    others = [f"<article><h1>T{i}</h1>{standing}{BODY.format(i)}</article>" for i in range(12)]
    got = texts(spark, with_reference(spark, lambda k: f"<article><h1>R{k}</h1>{standing}<p>x</p></article>", others))
    assert not any("standing" in x for x in got.values()) and all(f"More {i} " in got[i] for i in range(12))


def test_adverts_that_rotate(spark):
    """No advert stands on most pages, but each on several that differ otherwise; the article's last words are its own."""
    page = "<body><div class=a>Buy number {1} now</div><div class=b><h1>T{0}</h1>" + BODY + "<p>The end of {0}</p></div><div class=c>Terms {2} apply here</div></body>"
    got = texts(spark, [page.format(i, i % 6, i % 4) for i in range(48)])
    assert all(x == f"T{i}\nBody {i} alpha beta gamma delta epsilon zeta\nMore {i} eta theta iota kappa lambda\nThe end of {i}" for i, x in got.items())


def test_passages_that_repeat_inside_of_articles_stay(spark):
    """A passage in a quarter of the articles of a host isn't template."""
    got = texts(spark, [f"<article><h1>T{i}</h1>{BODY.format(i)}{'<p>A passage that many share, word for word, in their midst</p>' if i % 4 == 0 else ''}<p>End {i}</p></article>" for i in range(40)])
    assert all(("A passage that" in x) == (i % 4 == 0) and f"End {i}" in x for i, x in got.items())


def test_copies_of_an_article_stay(spark):
    """A third of a host's pages are copies of one article among different menus."""
    copy = "<p>Copied words that fill the longest block of all of these pages, to the end</p><p>And some more copied words</p>"
    rows = [f"<nav>Menu {i}</nav><div class=ad>Ad {i % 5}</div><article><h1>C</h1>{copy}</article>" for i in range(20)] + [f"<div class=ad>Ad {i % 5}</div><article><h1>T{i}</h1>{BODY.format(i)}</article>" for i in range(40)]
    got = texts(spark, rows)
    assert all("Copied words" in got[i] and "And some more" in got[i] for i in range(20)) and all("Ad" not in x for x in got.values())


def test_deep_elements_keep_their_role():
    alone = lambda x: html.Reference("").extract(x)
    deep = "<div>" * 2000 + "in<nav>menu<ul><li>x</ul></nav><aside>buy <b>now</b></aside>" + "</div>" * 2000
    assert alone(f"<div><article><p>before</p>{deep}<p>after</p></article></div><p>outside</p>") == "before\nin\nafter"
    assert html.text_of(html.parse("<div>" * 300 + "<div>a</div><div>b</div>" + "</div>" * 300 + "c")).split() == ["a", "b", "c"]
    assert alone("out" + "<div>" * 2000 + "<article><div>in</div></article>" + "</div>" * 2000) == "in"
    assert html.text_of(html.parse("<article>" * 5000 + "deep" + "</article>" * 5000)) == "deep"
    assert html.text_of(html.parse("<div>" * 160 + "one<nav>MENU</nav>two" + "</div>" * 160)) == "one\ntwo"
    assert len(list(html.Reference("<div>" * 5000 + "x").place(html.parse("<div>" * 4000 + "y")))) == 1
