"""Main-text extraction and host votes."""

from rasterloom.llm import pages
from rasterloom.llm.common import ship

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header>
<nav><ul><li><a href="/a">a</a></ul></nav><div class="wrap-12"><div class="cookie-notice">We use</div>
<article class="post-%d"><header><h1>Ti&amp;tle</h1></header><p>First <b>bold</b>
 par&nbsp;a.<p>Second<br>line <a href='x>y'>link</a><ul><li>one<li>two</ul><!-- no --><script>if (a<b) "</p>"</script>
<aside>side</aside><form>f</form><div class="comments"><p>a very long reader comment, longer than the article, really</p></div></article>
</div><footer>&copy; foot</footer>"""
TEXT = "Ti&tle\nFirst bold par a.\nSecond line link\none\ntwo"


def test_extract():
    assert pages.extract(PAGE % 7, None) == TEXT
    assert pages.vote(PAGE % 7)[0] == "body>div.wrap-#>article.post-#"
    assert pages.extract(PAGE % 7, "body>div.wrap-#>article.post-#") == TEXT
    assert pages.extract(PAGE % 7, "body>main") == TEXT
    assert pages.extract("", None) == pages.extract("<nav>only</nav>", None) == ""
    assert pages.extract("plain 3 < 4 text", None) == "plain 3 < 4 text"
    assert pages.extract("<p>a<p>b</p></p>c<!-- open", None) == "a\nb\nc"
    assert pages.extract("<div><p>x<script>1</script>y</div><textarea>q", None) == "xy"
    long = "<article>" + "<p>" + "word " * 50_000 + "</article>"
    assert len(pages.extract(long, None)) == 249_999


BODY = "<p>" + "A sentence of the article. " * 8 + "<p>" + "Another one of it. " * 8
WHOLE = "\n".join((("A sentence of the article. " * 8).strip(), ("Another one of it. " * 8).strip()))
SIDE = "<div class='sidebar'><p>Side text</p></div><nav>n</nav>"


def test_wrappers_are_no_furniture():
    """Layout wrappers with names of furniture, and forms around the page, lose nothing of what they hold."""
    for page in (
        f"<div class='content-sidebar-wrap'><main>{BODY}</main>{SIDE}</div>",
        f"<div class='site-content has-sidebar'><article>{BODY}</article>{SIDE}</div>",
        f"<form id='aspnetForm'><div class='page'>{BODY}</div>{SIDE}<input><button>go</button></form>",
        f"<form><div class='widget-area'><div id='search-main'>{BODY}</div>{SIDE}</div></form>",
        f"<div role='form'><div>{BODY}</div></div>",
        f"<main id='has-sidebar'>{BODY}</main>{SIDE}",
        f"<main><div class='main-sidebar-layout'><div>{BODY}</div>{SIDE}</div></main><div id='comments'>{'long reply. ' * 90}</div>",
        f"<div class='comments-open single'><div>{BODY}</div></div>",
    ):
        page = f"<body>{page}</body>"
        assert pages.extract(page, None) == WHOLE, page
        assert pages.extract(page, pages.vote(page)[0]) == WHOLE, page


def test_furniture_stays_out():
    """Comments longer than their article, teasers and side columns are still left out."""
    talk = "<li class='comment'><article id='c-1' class='comment-body'><p>" + "a long reply. " * 60 + "</article>"
    card = "<article class='card'><p>A teaser</article>"
    for page in (
        f"<article>{BODY}</article><div id='comments'><ol class='commentlist'>{talk * 3}</ol></div>",
        f"<div class='post'>{BODY}</div><div id='comments'><ol>{talk}</ol></div>",
        f"<div class='post'>{BODY}<div class='related-posts'>{card * 3}</div></div>{SIDE}",
        f"<div class='post'>{BODY}<form><p>Write to us</form></div><aside>{card * 9}</aside>",
    ):
        assert pages.extract(f"<body>{page}</body>", None) == WHOLE, page


def test_wrapped_hosts(spark):
    ship(spark)
    page = f"<body><div class='logo'>Site</div><form id='aspnetForm'><div class='content-sidebar-wrap'><article>{BODY}</article>{SIDE}</div></form></body>"
    rows = [(i, f"http://w.example/{i}", page) for i in range(4)]
    out = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in out] == [WHOLE] * 4


def test_hosts_vote(spark):
    ship(spark)
    own = "<body><div class='main-1'><p>" + "good text here. " * 5 + "</p></div><div class='odd'>%s</div></body>"
    rows = [(i, f"http://h.example/{i}", own % "short") for i in range(5)]
    # by itself this page would take its odd container
    rows.append((5, "https://H.example:80/x", own % ("padding " * 60)))
    rows += [(6, "http://other.example/", PAGE % 3), (7, None, None), (8, "no host", ""), (6, "http://other.example/", PAGE % 3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = pages.main_text(frame).collect()
    texts = {r.page_id: r.text for r in out}
    assert len(out) == len(rows)
    good = ("good text here. " * 5).strip()
    assert [texts[i] for i in range(6)] == [good] * 6
    assert texts[6] == TEXT and texts[7] == texts[8] == ""
    from pyspark.sql import functions as F

    wide = frame.withColumns({c: F.lit(1) for c in ("host", "path", "text", "votes", "score", "best", "_pages")})
    assert sorted(map(tuple, pages.main_text(wide).collect()), key=str) == sorted(map(tuple, out), key=str)
    assert pages.main_text(frame.limit(0)).collect() == []
