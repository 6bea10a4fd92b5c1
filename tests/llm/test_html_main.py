import html as entities

from penmark.llm.html_main import extract, main_text

ARTICLE = ["Heading one", "First paragraph with a good many words & signs < in it, as articles have.", "Second one, also long enough to be content; it has a link inside.", "End."]


def page(before="", after="", wrap="article", closed=True):
    p = "</p>" if closed else ""
    body = f"<h1>{ARTICLE[0]}</h1><p>{entities.escape(ARTICLE[1])}{p}<p>Second one, also\n long&nbsp;enough <b>to be</b> content; it <a href='/x'>has a link</a> inside.{p}<p>{ARTICLE[3]}{p}"
    return f"<!DOCTYPE html><html><head><title>Title of it</title><style>p{{}}</style><script>var x='</p>';</script></head><body>{before}<{wrap}>{body}</{wrap.split()[0]}>{after}</body></html>"


NAV = "<nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></nav><!-- a comment -->"
AD = '<div class="ad">Buy this very good thing now, it has many words to say about itself.</div>'
FOOT = "<footer>&copy; host, all rights are reserved by those who made this page with many words.</footer>"
ASIDE = "<aside><p>Side matter that is quite long and has no place in the text.</p></aside>"
NOTICE = '<div id="cookie-notice"><p>We use cookies to make this site better for you and us.</p></div>'
FORM = "<form><label>Your mail</label><input name='m'><button>Send</button></form>"
TALK = '<section class="comments"><p>I liked this article a lot and want to say so at length.</p><p>Me too.</p></section>'


def test_articles():
    expected = "\n".join(ARTICLE)
    for wrap in ("article", "main", 'div class="post"'):
        for closed in (True, False):
            assert main_text(page(NAV + AD, FOOT, wrap, closed)) == expected
            assert main_text(page(NAV + NOTICE + AD + ASIDE, TALK + FORM + FOOT, wrap, closed)) == expected
    inner = page(NAV, FOOT).replace("</article>", ASIDE + AD + FORM + TALK + "</article>")
    assert main_text(inner) == expected


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<!-- x") == ""
    assert main_text("plain words") == "plain words"
    assert main_text("<p>one<p>two<br>three &amp; &#233;&eacute; four</b></p></div>") == "one\ntwo\nthree & éé four"
    long = "<article>" + "<p>some words of a long page here</p>" * 20_000 + "</article>"
    assert main_text(long).count("\n") == 19_999
    assert main_text("<div>" * 3000 + "deep words in it" + "</div>" * 3000) == "deep words in it"


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_all_regions_are_kept():
    body = "".join(f"<p>{words(20, 20 * i)}</p>" for i in range(10))
    texts = [words(20, 20 * i) for i in range(10)]
    post = f"<div class=post><h1>Title of three</h1><p>{words(10, 900)}</p><div class=body>{body}</div></div>"
    for html in (post, f"<body>{NAV}{post}{FOOT}</body>"):
        assert main_text(html) == "\n".join(["Title of three", words(10, 900), *texts])
    items = "".join(f"<li>{words(20, 20 * i)}</li>" for i in range(10))
    listed = f"<body>{NAV}<div><h1>Ten things to know</h1><p>{words(6, 900)}</p><ul>{items}</ul><p>{words(5, 950)}</p></div>{FOOT}</body>"
    assert main_text(listed) == "\n".join(["Ten things to know", words(6, 900), *texts, words(5, 950)])
    two = f"<body>{NAV}<main><article>{body}</article><article><p>{words(60, 500)}</p><p>{words(60, 600)}</p></article></main>{FOOT}</body>"
    assert main_text(two) == "\n".join([*texts, words(60, 500), words(60, 600)])
    nested = f"<body><article><p>{words(40, 500)}</p><article>{body}</article><p>{words(40, 600)}</p></article></body>"
    assert main_text(nested) == "\n".join([words(40, 500), *texts, words(40, 600)])
    many = f"<body><div><div>{'<p>' + words(20) + '</p>'}{body * 95}</div><section>{body * 5}</section></div></body>"
    assert main_text(many).count("\n") == 1000


def test_names_that_say_nothing():
    body = "".join(f"<p>{words(20, 20 * i)}</p>" for i in range(10))
    texts = [words(20, 20 * i) for i in range(10)]
    for wrap in ("content has-sidebar", "no-sidebar", "with-comments", "hasSidebar", "page sidebar", "comments-open"):
        assert main_text(f'<body>{NAV}<div class="{wrap}">{body}</div>{FOOT}</body>') == "\n".join(texts)
    inner = f'<h2 id="related-work">Related work</h2>{body}<h2 id="search">Search</h2><p class="byline">By one of us</p><h3 id="menu-design">Menus</h3>'
    inner += f'<section id="sharing-results"><p>{words(18, 500)}</p><p>{words(18, 600)}</p></section>'
    expected = ["Related work", *texts, "Search", "By one of us", "Menus", words(18, 500), words(18, 600)]
    assert main_text(f"<body>{NAV}<article>{inner}</article>{FOOT}</body>") == "\n".join(expected)
    boxes = '<div class="related"><ul><li><a href="/a">Another one to read</a></li><li><a href="/b">And one more</a></li></ul></div>'
    boxes += '<div class="share-this"><span>Share</span><b>now</b></div><ul id="menu"><li><a href="/c">Home</a></li></ul>'
    assert main_text(f"<body><article>{body}{boxes}</article></body>") == "\n".join(texts)
    assert main_text(f"<body><article>{body}{AD}{NOTICE}{TALK}</article></body>") == "\n".join(texts)


def test_frame(spark, same):
    rows = [(1, "u", page(NAV, FOOT)), (1, "u", page(NAV, FOOT)), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    text = "\n".join(ARTICLE)
    first = {"page_id": 1, "url": "u", "text": text, "n_chars": len(text)}
    same(extract(df), [first, first, {"page_id": 2, "url": None, "text": "", "n_chars": 0}, {"page_id": None, "url": "v", "text": "", "n_chars": 0}])
    assert extract(df.limit(0)).count() == 0
