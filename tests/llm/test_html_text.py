import html
import math
import random
import re
import statistics
import time

import pytest

from rankloom.llm import html_text as ht
from rankloom.llm.html_text import main_text, page_texts

SF = "/root/testdata/sf0.01"

PAGE = """<!DOCTYPE html><html><head><title>T &lt;x&gt;</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body>
<header><h1>Site name, with words.</h1></header><nav><a href=/a>One</a><a href=/b>Two</a></nav><div class="cookie-notice">We use cookies, as all do.</div>
<div id=content><div class=post><h2>A   heading</h2><p>First &amp; long paragraph, with <b>bold</b>&nbsp;words, and more. It goes on, and on; indeed it does.
<p>Second para&shy;graph: unclosed, but fine. It has <a href="x>y">a link</a>, and several sentences. Yes.</p><ul><li>item one<li>item two</ul><p>Short.</p>
<blockquote>Quoted text, which is part of it.</blockquote></div><div class="comments"><h3>Comments</h3><p>I like this, really. A long reader comment, with much to say about it.</p></div></div>
<aside><p>Sidebar text, not part of the article, though it has commas, and stops.</p></aside><form><label>Mail</label><input name=q></form><div class="ad">Buy, buy, buy now.</div><footer>&copy; Site</footer></body></html>"""


def test_article_alone_is_kept():
    assert main_text(PAGE).split("\n") == [
        "A heading", "First & long paragraph, with bold words, and more. It goes on, and on; indeed it does.", "Second para­graph: unclosed, but fine. It has a link, and several sentences. Yes.",
        "item one", "item two", "Short.", "Quoted text, which is part of it.",
    ]


def test_frames_with_telling_names_and_hidden_blocks():
    page = """<body><div class="content-sidebar-wrap"><header class="entry-header"><h1>Headline of it</h1></header><p>Some text, with a comma. And more of it.</p><p hidden>unseen, words.</p>
    <p style="display: none">gone, words.</p><table><tr><td>cell one<td>cell two</table></div><div id="sidebar"><p>Side text, that is long. It goes on, and on.</p></div>
    <ol class="comment-list"><li><article><p>A reader says this, and that.</p></article></ol></body>"""
    assert main_text(page).split("\n") == ["Headline of it", "Some text, with a comma. And more of it.", "cell one", "cell two"]
    assert main_text("<main><div role='navigation'><p>Menu, long text.</p></div><p>Body text, here.</p></main>") == "Body text, here."


def test_articles_of_whole_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = page_texts(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>Only text, here.</p>"), (4, "u", "no markup at all, just words."), (5, "u", "<div><p>Open <b>tags, everywhere"), (6, "u", "<script>never closed, text."), (7, "u", "<!-- never closed <p>x</p>"),
            (8, "u", "<p>a < b, and c > d.</p>"), (9, "u", "<p>" + "long text, with a stop. " * 50000 + "</p>"), (9, "u", "<ul>" + "<li><a href=x>link</a>" * 20 + "</ul>"), (10, "u", "<p>&#0;&#xD800;&bogus;&amp;amp;</p>")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, N_CHARS int")
    got = [(r.page_id, r.text) for r in page_texts(df).collect()]
    assert len(got) == len(rows)
    text = dict(got[:8])
    assert text[1] == text[2] == text[6] == text[7] == "" and text[None] == "Only text, here." and text[4] == "no markup at all, just words." and text[5] == "Open tags, everywhere"
    assert text[8] == "a < b, and c > d."
    assert len(got[8][1]) == 24 * 50000 - 1 and got[9][1] == ""
    assert page_texts(df.limit(0)).count() == 0


PARAGRAPH = "A sentence of the article, with a comma. Another one, longer than the first; it goes on, and on."
PLAIN = [  # pages without article elements or telling names
    f"<body><div>Home</div><div>News of all kinds</div><table><tr><td><p>{PARAGRAPH}</p><h3>A heading</h3><p>{PARAGRAPH}</p><ul><li>an item<li>another</ul><p>{PARAGRAPH}</p></td></tr></table><div>All rights reserved</div></body>",
    f"<body><div>Today</div><p>{PARAGRAPH}</p><div>Read more here</div><p>{PARAGRAPH}</p><div>Print this page</div><p>{PARAGRAPH}</p></body>",
    f"<div><h1>Headline</h1></div><div><ul><li><a href=/>One</a><li><a href=/>Two</a></ul><p>{PARAGRAPH}</p><p><a href=/>A paragraph that is a link.</a></p><p>{PARAGRAPH}</p></div><div>Log out</div>",
]


def test_ratios_decide_on_pages_without_telling_names(monkeypatch):
    kept = [ht.main_text(p).split("\n") for p in PLAIN]
    assert kept[0] == [PARAGRAPH, "A heading", PARAGRAPH, "an item", "another", PARAGRAPH]
    assert kept[1] == [PARAGRAPH] * 3
    assert kept[2] == ["Headline", PARAGRAPH, "A paragraph that is a link.", PARAGRAPH]
    monkeypatch.setattr(ht, "path_ratios", lambda nodes: dict.fromkeys({n.path for n in nodes}, 1.0))
    assert all(ht.main_text(p).split("\n") != k for p, k in zip(PLAIN, kept, strict=True))


def test_blocks_of_the_article_stay_and_inline_elements_count():
    page = f"""<article><p>{PARAGRAPH}</p><div class=legal><p>A law, and its text.</p></div><div class=related-work><p>Others did this, too.</p></div>
    <p>foo<wbr>bar <img src=x> and <span class=advert>buy now</span><span hidden>unseen</span> more, text.</p><ul><li><a href=a>x</a><li><a href=b>y</a></ul>
    <table><tr><td>1</td><td>2</td></tr></table><div class=comments><p>{PARAGRAPH}</p></div></article>"""
    assert ht.main_text(page).split("\n") == [PARAGRAPH, "A law, and its text.", "Others did this, too.", "foobar and more, text.", "1", "2"]
    assert ht.main_text(f"<main><p>{PARAGRAPH}</p></main><div class=notice><p>Please note, that this is a notice.</p></div><div class=cookie-banner>We use them, too.</div>") == PARAGRAPH
    assert ht.main_text(f"<article><p>{PARAGRAPH}</p></article><article><p>{PARAGRAPH}</p></article>").split("\n") == [PARAGRAPH] * 2


def test_deep_and_unclosed_pages_are_linear():
    for page in ("<div>text, " * 5000, "<div><p><h2>text " * 5000, "<b><i>text, " * 20000 + "</i>" * 20000, "<span hidden>" * 5000 + "x"):
        began = time.process_time()
        ht.main_text(page)
        assert time.process_time() - began < 5


def brute_select(page):
    """The rules of the module's docstring, each node from scratch."""
    def above(e):
        return [e, *above(page.parents[e])] if e >= 0 else []

    nodes, tags = page.nodes, page.tags
    outside = [len(n.words) - min(n.linked, len(n.words)) for n in nodes]
    factor = [min(page.priors[e] for e in above(n.element)) for n in nodes]

    def ratio(path):
        mine = [k for k, n in enumerate(nodes) if n.path == path]
        return math.sqrt(sum(outside[k] for k in mine) / len(mine) * (1 + sum(c in ".,;:!?…。、，！？" for k in mine for c in nodes[k].words) / len(mine)))

    own = [ratio(n.path) * f for n, f in zip(nodes, factor, strict=True)]
    padded = [own[0], *own, own[-1]] if own else []
    mixed = [math.sqrt(own[k] * (padded[k] + 2 * padded[k + 1] + padded[k + 2]) / 4) for k in range(len(own))]
    fused = [statistics.mean(m for m, o in zip(mixed, nodes, strict=True) if o.path == n.path) for n in nodes]
    chars = [c * f for c, f in zip(outside, factor, strict=True)]
    mean = sum(a * b for a, b in zip(fused, chars, strict=True)) / sum(chars) if sum(chars) else 0
    if not mean:
        return []
    good = [f >= 0.35 * mean - 1e-12 for f in fused]
    held = lambda e: sum(c for n, c, g in zip(nodes, chars, good, strict=True) if g and e in above(n.element))
    named = [e for e in range(len(tags)) if tags[e] in ("article", "main") and held(e) and held(e) >= 0.2 * held(0) - 1e-9]
    if named:
        best = sorted(named, key=lambda e: (-held(e), -len(above(e)), e))[0]
        roots = [e for e in named if page.parents[e] == page.parents[best]]
    else:
        roots = [sorted((e for e in range(len(tags)) if held(e) >= 0.8 * held(0) - 1e-9 and (tags[e] not in ht.GROUPS or tags[e] == "td")), key=lambda e: (-len(above(e)), e))[0]]
    container = lambda e: next(x for x in above(e) if tags[x] not in ht.GROUPS)
    keep = []
    for n, f, g in zip(nodes, fused, good, strict=True):
        root = next((e for e in above(n.element) if e in roots), None)
        between = above(n.element)[: above(n.element).index(root)] if root is not None else []
        if root is not None and not any(page.priors[e] == ht.STRONGLY for e in between):
            company = named or tags[n.element] in ht.SHORT_BLOCKS and any(x and container(m.element) == container(n.element) for m, x in zip(nodes, good, strict=True))
            keep.append(g or bool(company) and f >= min(0.004 * mean, 0.5))
        else:
            keep.append(f >= 0.8 * mean)
    if any(keep) and not any(k and tags[n.element] == "h1" for k, n in zip(keep, nodes, strict=True)):
        first = keep.index(True)
        for k in reversed(range(max(0, first - 3), first)):
            if tags[nodes[k].element] == "h1" and factor[k] == 1 and outside[k]:
                keep[k] = True
                break
    return [n.words for n, k in zip(nodes, keep, strict=True) if k]


def random_page(seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(rnd.randrange(3, 60)):
        tag = rnd.choice(["div", "p", "p", "ul", "li", "h1", "h2", "section", "table", "td", "article", "main", "/div", "/div", "/p", "/section", "/article", "/main", "/ul", "blockquote"])
        name = rnd.choice(["", "", "", "", " class=comments", " class=legal", " id=a", " class='x sidebar'"]) if "/" not in tag else ""
        words = rnd.choice(["", "word", "Some words, and more.", PARAGRAPH, "<a href=x>a link</a>", "text <a href=x>linked, text</a> text"])
        out.append(f"<{tag}{name}>{words}")
    return "".join(out)


@pytest.mark.parametrize("seed", range(150))
def test_selection_against_brute_force(seed):
    page = ht.parse(random_page(seed))
    assert ht.select_content(page) == brute_select(page)


def test_a_form_around_the_page_is_its_frame():
    article = f"<h1>Head</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH} Twice.</p>"
    assert ht.main_text(f"<body><form action=x>{article}<select><option>a</select><input></form></body>").split("\n") == ["Head", PARAGRAPH, PARAGRAPH + " Twice."]
    assert ht.main_text(f"<body><form><div>{article}<form><p>Your name, please.</p></form></div></form></body>").split("\n")[:3] == ["Head", PARAGRAPH, PARAGRAPH + " Twice."]
    small = f"<body><article>{article}</article><form><p>Your name, please. Send it.</p></form></body>"
    assert ht.main_text(small).split("\n") == ["Head", PARAGRAPH, PARAGRAPH + " Twice."]


def test_elements_in_a_line_do_not_end_it():
    for inner in ("<button>Go</button>", "<svg><g><title>x</title><path d='1'/></g></svg>", "<select><option>a<option>b</select>", "<button><div>Go</div></button>", "<object><p>no</object>"):
        assert ht.main_text(f"<article><p>Press {inner} now, {PARAGRAPH}</p></article>") == f"Press now, {PARAGRAPH}"
    assert ht.main_text(f"<article><p>Press <button>Go now, {PARAGRAPH}</p><p>{PARAGRAPH}</p></article>").split("\n") == ["Press", PARAGRAPH]


def test_inline_names_count_alone():
    page = f"<article><p>Use <span class=social>networks</span> well. {PARAGRAPH}</p><p>{PARAGRAPH}</p><p><span class=share>Share this.</span></p></article>"
    assert ht.main_text(page).split("\n") == [f"Use networks well. {PARAGRAPH}", PARAGRAPH]


@pytest.mark.parametrize("piece", ["<p class='", "<a ", "<a \">\" \"<b \" ", "<p class='>", "<svg>", "<button>", "<!-", "<a '\"", "<a \"'>"])
def test_broken_tags_take_linear_time(piece):
    import time

    start = time.time()
    ht.main_text(piece * 20_000)
    assert time.time() - start < 2
