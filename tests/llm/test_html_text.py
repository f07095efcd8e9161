import pytest

from siftwork.llm import html_text as H

LONG = " ".join(["Content words that go on for a while and say something."] * 6)
CASES = [
    # an article among menu, advert, and footer; short blocks inside it stay
    (f"""<html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
     <nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav><div class="ad">Buy this now, really.</div>
     <article><h1>Head &amp; line</h1><p><b>{LONG}<br><p>Be.</p><p>{LONG}</p></article>
     <footer>&copy; 2020 &middot; imprint text of the footer</footer></body></html>""",
     ["Head & line", LONG, "Be.", LONG]),
    # no article element: the run of text lines between boilerplate
    (f"""<div id="header">Site name and a slogan that is rather long for a header</div><div class="sidebar"><p>{LONG}</p></div>
     <div class="post"><h2>Title</h2><p>{LONG}</p><p>Short.</p><ul><li>one</li><li>two</li></ul></div>
     <div class="comments"><p>{LONG}</p></div>""", ["Title", LONG, "Short.", "one", "two"]),
    # unclosed elements, references without semicolon and numbers, white space
    (f"<main><p>a&ampb  &#8217;s\n\t x &copy 1<p>{LONG}<div>deep<span> er</span></div>", ["a&b ’s x © 1", LONG, "deep er"]),
    # reader comments as nested articles
    (f"<article><p>{LONG}</p><section class=comments><article><p>{LONG} reader</p></article></section></article>", [LONG]),
    # forms, notices, hidden parts inside the article
    (f"""<article><p>{LONG}</p><form><p>Your name</p><input><button>Send</button></form><div class="cookie-notice">We use
     cookies.</div><p hidden>no</p><p style="display: none">no</p><noscript>no</noscript><p>End</p></article>""", [LONG, "End"]),
    # an article's own header keeps its headline; a wrapper named after a sidebar is none
    (f"""<div class="layout with-sidebar"><header><h1>Site</h1></header><article><header class="entry-header"><h1>Headline</h1>
     <p>By someone, yesterday</p></header><p>{LONG}</p><footer>tags</footer></article></div>""", ["Headline", LONG]),
    # a menu that is only links, no article element
    (f"<div><a href=a>One link</a> <a href=b>Another link</a></div><div><p>{LONG}</p><p>Short end.</p></div>"
     "<div><a href=c>Last link of all</a></div>", [LONG, "Short end."]),
    (None, []), ("", []), ("   ", []), ("<p></p><!-- only --> <script>x</script>", []),
    ("plain text without any tag", ["plain text without any tag"]),
    ("<body><nav>menu</nav></body>", []),
    (f"<article><p>{LONG}</p><p>cut off in the midd", [LONG, "cut off in the midd"]),
]


@pytest.mark.parametrize("html,want", CASES)
def test_cases(html, want):
    assert H.main_text(html or "") == "\n".join(want)


WHOLE = [
    # headline and standfirst of a main section around its only article
    (f"<main><h1>Headline</h1><p>Standfirst</p><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article></main>",
     ["Headline", "Standfirst", LONG, LONG, LONG]),
    # a shorter article goes on with the text; a teaser does not
    (f"<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><h2>Part two</h2><p>{LONG}</p></article>"
     f"<article><h2><a href=x>Other story</a></h2><p>{LONG[:200]}</p></article>",
     [LONG, LONG, LONG, "Part two", LONG]),
    (f"<main><h1>Headline</h1><p>{LONG}</p><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><article><p>{LONG}</p>"
     "<p><a href=x>Read more</a></p></article></main>", ["Headline", LONG, LONG, LONG, LONG]),
    # ids that have a word of boilerplate among others; headings
    (f"""<article><h2 id="related-work">Related work</h2><p>{LONG}</p><section id="search-results"><p>{LONG}</p></section>
     <div id="notice-period"><p>Notice.</p></div><h3 class="section-header" id="discussion">Discussion</h3><p>{LONG}</p>
     <div id="cookie-banner">We use cookies.</div><div id="commentsSection"><p>{LONG} reader</p></div></article>""",
     ["Related work", LONG, LONG, "Notice.", "Discussion", LONG]),
    # links between content lines, no article element
    (f"<div id=main-nav><p>Menu of the site</p></div><div><p>{LONG}</p><p>{LONG}</p><ul><li><a href=a>A linked item</a></li></ul>"
     f"<p>{LONG}</p><p>{LONG}</p></div><div><a href=c>One</a> <a href=d>Last</a></div><div><a href=e>Other</a></div>",
     [LONG, LONG, "A linked item", LONG, LONG]),
]


PARAGRAPH = f"<p>{LONG}</p>"
WHOLE += [
    # wrappers named after what they also hold, and forms around the page, hold the text
    (f'<div class="layout has-sidebar"><div class="content">{PARAGRAPH}{PARAGRAPH}</div><div class="sidebar"><p>Side.</p></div></div>',
     [LONG, LONG]),
    (f'<form id="aspnetForm"><nav>menu</nav><article><h1>T</h1>{PARAGRAPH}</article><form><input><p>Name</p></form></form>', ["T", LONG]),
    (f'<form id="aspnetForm"><div id="page">{PARAGRAPH}{PARAGRAPH}</div><div class="cookie-notice">We use cookies.</div></form>',
     [LONG, LONG]),
    (f'<div class="promo-layout"><div class="sidebar-wrapper">{PARAGRAPH}{PARAGRAPH}</div></div>', [LONG, LONG]),
    # readers' comments and hidden parts stay out, however long
    (f'<div class="post">{PARAGRAPH}</div><div class="comments">{PARAGRAPH * 9}</div><div hidden>{PARAGRAPH * 9}</div>', [LONG]),
    # class words inside an article that are no names of boilerplate
    (f"""<article>{PARAGRAPH}<section class="discussion"><h2>Discussion</h2>{PARAGRAPH}</section><div class="related-work"><h2>Work</h2>
     <p>Others.</p></div><p class="share-price">Price 3</p><div class="related-posts"><p>no</p></div><div class="share-buttons">no</div>
     <p>End</p></article>""", [LONG, "Discussion", LONG, "Work", "Others.", "Price 3", "End"]),
    # one linked item, no article element, and what comes after it
    (f"<div>{PARAGRAPH}{PARAGRAPH}<ul><li><a href=a>Linked item</a></li></ul><p>Closing words.</p></div>",
     [LONG, LONG, "Linked item", "Closing words."]),
    # a form field in a sentence
    (f"<article><p>Choose <select><option>a<option>b</select> one. {LONG}</p></article>", [f"Choose one. {LONG}"]),
]


@pytest.mark.parametrize("html,want", WHOLE)
def test_nothing_of_the_text_is_dropped(html, want):
    assert H.main_text(html) == "\n".join(want)


def test_deep_and_long_pages_end():
    deep = "<div>" * 20_000 + LONG + "</div>" * 20_000
    assert H.main_text(deep) == LONG
    many = "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>"
    assert H.main_text(many) == "\n".join([LONG] * 3000)


def test_table(spark):
    rows = [(i, None if i == 3 else f"u{i}", h, "clash", i) for i, (h, _) in enumerate(CASES)] + [(None, None, "x y", "c", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = H.extract_main_text(df).collect()
    want = sorted([(i, "\n".join(w)) for i, (_, w) in enumerate(CASES)] + [(-1, "x y")])
    assert sorted((-1 if r.page_id is None else r.page_id, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert H.extract_main_text(df.limit(0)).count() == 0


def page(rng):
    """A generated page: its blocks of text, in random wrappers among random boilerplate."""
    sentence = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n)).capitalize() + "."
    blocks, inside = [], []
    for _ in range(rng.randint(3, 9)):
        text = sentence(rng.randint(25, 70))
        blocks.append(text)
        inside.append(f"<p>{text}</p>")
        if rng.random() < 0.3:
            head = sentence(3)[:-1]
            blocks.append(head)
            level = rng.randint(2, 4)
            inside.append(f'<h{level} id="related-{level}">{head}</h{level}>')
            last = sentence(40)
            blocks.append(last)
            inside.append(f"<p>{last}</p>")
    links = "".join(f"<li><a href=/{i}>{sentence(2)}</a></li>" for i in range(rng.randint(4, 9)))
    around = {"top": [f"<nav><ul>{links}</ul></nav>", f'<header class="site-header"><p>{sentence(6)}</p></header>', f"<div id=cookie-banner>{sentence(9)}</div>"],
              "end": [f"<footer><p>{sentence(8)}</p></footer>", f'<div class="comments"><p>{sentence(30)}</p></div>', f'<div class="ad">{sentence(9)}</div>',
                      f"<form><p>{sentence(4)}</p><input></form>", f"<aside><p>{sentence(20)}</p></aside>"]}
    body = "".join(inside)
    for wrap in rng.sample(['<div class="layout has-sidebar">{}</div>', "<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>',
                            '<form id="aspnetForm">{}</form>'], rng.randint(1, 3)):
        body = wrap.format(body)
    top, end = (rng.sample(x, rng.randint(1, len(x))) for x in around.values())
    return f"<html><body>{''.join(top)}{body}{''.join(end)}</body></html>", blocks


def test_recall_and_precision_on_generated_pages():
    import random

    rng = random.Random(17)
    found = wanted = right = 0
    for _ in range(400):
        html, blocks = page(rng)
        got = H.main_text(html).split("\n")
        assert got != [""]
        found, wanted, right = found + len(got), wanted + len(blocks), right + len(set(got) & set(blocks))
    assert right / wanted > 0.995 and right / found > 0.99, (right / wanted, right / found)
