import html
import re

import pytest

from marquee.llm import page_text as H

LONG = "It is the longer text of the article, and it has a lot of the words that are in the list of stop words, so that it is kept, as it is long enough for that."
PAGE = f"""<!doctype html><html lang=en><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header class="site-header"><a href=/>Home</a> Site name of the day</header>
<nav><ul><li><a href=1>one</a><li><a href=2>two</a></ul></nav><div class="cookie-notice">{LONG}</div>
<main><article><header><h1>The &eacute;t&eacute; of a &lt;thing&gt;</h1></header><p>Short   one.</p><p>{LONG}</p><div class="ad-slot">{LONG}</div><p>Another <a href=x>link</a> in <b>bold</b><br>line. <span class="ad">Promo!</span></p>
<ul><li>item a</li><li>item b</li></ul><form><label>Name</label><input name=x><button>Send</button></form><aside>{LONG}</aside><section id="comments"><h2>Comments</h2><div class="comment"><p>{LONG}</p></div></section></article></main>
<div class="sidebar"><p>{LONG}</p></div><footer>&copy; 2020 the site</footer><script>if(a<b){{document.write("<p>no</p>")}}</script></body></html>"""


def test_article_without_boilerplate():
    assert H.main_text(PAGE) == f"The été of a <thing>\nShort one.\n{LONG}\nAnother link in bold line.\nitem a\nitem b"


def test_unmarked_page():
    page = f"<div id=top><a href=1>Home</a> | <a href=2>News</a></div><div><h2>Headline</h2><p>{LONG}</p><p>Short bit.</p><p>{LONG}</p></div><div>All rights reserved</div>"
    assert H.main_text(page) == f"Headline\n{LONG}\nShort bit.\n{LONG}"


@pytest.mark.parametrize("wrapper", ["form action=x method=post", "fieldset", 'div role="form"', 'div class="content-sidebar-wrap"', 'div class="page-with-sidebar"', 'div id="main_sidebar_container"', 'div class="layout-right-sidebar"'])
def test_page_inside_a_wrapper(wrapper):
    tag = wrapper.split()[0]
    rest = f"<nav><article>{LONG}</article></nav><aside><article>{LONG}</article></aside><footer><article>{LONG}</article></footer><div class=comment-list><article>{LONG}</article></div>"
    for mark in ("article", "main", "div class=entry-content", "div role=main", "div itemprop=articleBody"):
        assert H.main_text(f"<body><{wrapper}>{rest}<{mark}><h1>Headline</h1><p>{LONG}</p><p>Short one.</p></{mark.split()[0]}></{tag}></body>") == f"Headline\n{LONG}\nShort one."
    # no mark: the wrapper holds the running text
    assert H.main_text(f"<body><{wrapper}><a href=1>Home</a><div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div></{tag}></body>") == f"{LONG}\nShort one.\n{LONG}"


def test_wrappers_beside_the_text():
    beside = f"<form><p>{LONG}</p></form><div class=sidebar-wrap><article>{LONG}</article></div><div class=page-sidebar><article>{LONG}</article></div>"
    assert H.main_text(f"<article><p>Short one.</p>{beside}</article>{beside}") == "Short one."


RUSSIAN = "Город стоит на берегу большой реки, и каждое утро над водой поднимается туман, который медленно уходит в сторону старого моста и дальних холмов за ним."
POLISH = "Miasto leży nad brzegiem dużej rzeki, a każdego ranka nad wodą unosi się mgła, która powoli odpływa w stronę starego mostu oraz odległych wzgórz za nim."
CHINESE = "这座城市位于一条大河的岸边，每天早晨水面上都会升起薄雾，慢慢地飘向古老的桥和远处的山丘，人们在河边散步聊天。"
JAPANESE = "この町は大きな川のほとりにあり、毎朝、水面に霧が立ちのぼり、古い橋と遠くの丘のほうへゆっくりと流れていきます。"
ENDS = "<div id=top><a href=1>Home</a> | <a href=2>News</a></div>", "<div><a href=3>Imprint and contact of the site</a></div>"


@pytest.mark.parametrize("text", [RUSSIAN, POLISH, CHINESE, JAPANESE, RUSSIAN[:61], POLISH[:90], CHINESE[:25]])
def test_unmarked_page_in_other_languages(text):
    assert H.main_text(f"{ENDS[0]}<div><p>{text}</p><p>{text}</p><p>{text}</p></div>{ENDS[1]}") == "\n".join([text] * 3)


def test_mixed_language_page():
    assert H.main_text(f"{ENDS[0]}<p>{RUSSIAN}</p><p>{RUSSIAN}</p><p>It is said in English that this is so.</p><p>{RUSSIAN}</p>{ENDS[1]}") == f"{RUSSIAN}\n{RUSSIAN}\nIt is said in English that this is so.\n{RUSSIAN}"


def test_blocks_without_stop_words_between_paragraphs():
    code = "total = 0 for row in rows: total += row.price * row.amount print(total)"
    names = "Alice Smith, Robert Brown, Carla Jones, David Miller, Erika Wilson, Frank Moore, Gina Taylor"
    page = f"<p>{LONG}</p><pre>{code}</pre><p>{LONG}</p><table><tr><td>{names}</td></tr></table><p>{LONG}</p><pre><code>{code}</code></pre>"
    want = f"{LONG}\n{code}\n{LONG}\n{names}\n{LONG}\n{code}"
    assert H.main_text(f"{ENDS[0]}<div>{page}</div>{ENDS[1]}") == want
    # beside links such a block is none of the text
    assert H.main_text(f"{ENDS[0]}<div>{names}</div>{ENDS[0]}<div>{page}</div>{ENDS[1]}<div>{names}</div>{ENDS[1]}") == want


def test_unmarked_page_of_short_paragraphs():
    assert H.main_text(f"{ENDS[0]}<h2>Headline</h2><p>{LONG[:90]}</p><p>{LONG[:70]}</p>{ENDS[1]}") == f"Headline\n{LONG[:90].strip()}\n{LONG[:70].strip()}"


MENU = "Products and services of the house, prices, places"


@pytest.mark.parametrize("teasers", [1, 2, 9])
def test_story_outside_of_marked_teasers(teasers):
    cards = f"<article class=card><h3>Teaser</h3><p>{LONG}</p></article>" * teasers
    story = f"<div class=entry><h1>Headline</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div>"
    kept = H.main_text(f"{ENDS[0]}{story}{cards}{ENDS[1]}")
    assert kept.startswith(f"Headline\n{LONG}\nShort one.\n{LONG}") and kept.count(LONG) == 2 + teasers


@pytest.mark.parametrize("menu", ["div class='nav main'", "nav class=main", "ul class='main menu'", "div class='main navbar'", "div class='story'", "div class='main'"])
def test_menu_with_a_main_name(menu):
    tag = menu.split()[0]
    kept = H.main_text(f"<{menu}><p>{MENU}</p></{tag}><div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div>")
    assert kept.endswith(f"{LONG}\nShort one.\n{LONG}")
    if menu not in ("div class='story'", "div class='main'"):
        assert MENU not in kept


@pytest.mark.parametrize("mark", ["div class=main", "div class='main content-sidebar-wrap'", "div class='main right-sidebar'", "div id=main", "form class=main", "article"])
def test_mark_with_the_larger_part(mark):
    tag = mark.split()[0]
    beside = f"<div class=unknown><p>{LONG}</p></div>"
    assert H.main_text(f"{beside}<{mark}><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></{tag}>") == f"{LONG}\nShort one.\n{LONG}"


def test_short_marked_text_beside_longer_text():
    kept = H.main_text(f"{ENDS[0]}<article><p>{LONG[:90]}</p></article>{ENDS[1]}<div><p>{LONG}</p></div>{ENDS[1]}")
    assert kept == f"{LONG[:90].strip()}\n{LONG}"


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<!-- x", "<script>", "<p>&nbsp;</p>", "<a title='x>y'>z</a>", "</p></div>", "<p " + "'" * 999, "<" * 999, "<div>" * 3000])
def test_odd_pages(page):
    assert isinstance(H.main_text(page), str)


def test_options_without_end_tags():
    for box in ("<select><option>one<option>two</select>", "<select><optgroup label=x><option>one</optgroup><option>two</select>", "<select><option>one<option>two", "<datalist><option value=1>one<option>two</datalist>"):
        assert H.main_text(f"<article><p>{LONG}</p>{box}<p>Short one.</p><p>{LONG}</p></article>") == f"{LONG}\nShort one.\n{LONG}", box
        assert H.main_text(f"<div><p>{LONG}</p><form>{box}</form><p>{LONG}</p></div>") == f"{LONG}\n{LONG}", box


@pytest.mark.parametrize("names", ["post category-legal comments-open", "post-12 post type-post tag-share tag-newsletter", "story legal", "category-comments", "hentry social"])
def test_article_keeps_its_text_whatever_its_topics(names):
    for tag in ("article", "div"):
        if tag == "article" or "-" in names.split()[-1]:
            assert H.main_text(f"{ENDS[0]}<{tag} class='{names}'><h1>Headline</h1><p>{LONG}</p></{tag}>{ENDS[1]}") == f"Headline\n{LONG}"


@pytest.mark.parametrize("name", ["comment", "comment-body odd", "teaser", "promo"])
def test_articles_that_are_no_article(name):
    assert H.main_text(f"<main><p>{LONG}</p><article class='{name}'><p>{LONG}</p></article></main>") == LONG


@pytest.mark.parametrize("name", ["legal-news", "social-science-article", "share-price-story", "search-for-a-cure", "alert-levels"])
def test_a_word_within_a_name_is_overruled_by_the_larger_part(name):
    story = f"<div class='{name}'><h1>Headline</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div>"
    assert H.main_text(f"{ENDS[0]}{story}{ENDS[1]}") == f"Headline\n{LONG}\nShort one.\n{LONG}"
    # beside a longer text it is what it says
    assert H.main_text(f"{ENDS[0]}<div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>{story}") == "\n".join([LONG] * 3)
    assert H.main_text(f"<article><p>{LONG}</p></article>{story}") == LONG


@pytest.mark.parametrize("name", ["comment-list", "user-comments", "cookie-wall", "page-footer", "related comments"])
def test_sure_words_are_never_overruled(name):
    thread = f"<div class='{name}'>" + f"<p>{LONG}</p>" * 5 + "</div>"
    assert H.main_text(f"<div><p>{LONG}</p></div>{thread}") == LONG


@pytest.mark.parametrize("page", ["<b>x" * 250_000, "<div>" * 90_000 + "</section>" * 60_000, "<object>x" * 100_000, "<svg>" * 150_000, "<i><p>" + "<b>" * 100_000 + "</i>" * 100_000,
                                  "<select><option>" * 60_000, "<p>a<b>b" * 100_000, "</p>" * 200_000])
def test_linear_time(page):
    import time

    start = time.process_time()
    H.main_text(page)
    assert time.process_time() - start < 6


def test_extract_over_the_table(spark):
    """Held against the article element of the test pages."""
    from marquee.llm import queries
    from marquee.sources.tables import read_table

    sf = "/root/testdata/sf0.001"
    rows = {r.page_id: r for r in queries.op2_html_text(spark, sf).collect()}
    pages = read_table(spark, sf, "pages").collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|h2|div|li|ul)\b[^>]*>", article)]
        assert rows[p.page_id].text == "\n".join(x for x in parts if x)
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text) and rows[p.page_id].url == p.url


def test_extract_edges(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (None, None, None, None), (1, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    rows = H.extract(df).collect()
    assert sorted(r.n_chars for r in rows)[0] == 0 and len(rows) == 3 and H.extract(df.limit(0)).count() == 0
