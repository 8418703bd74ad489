"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  First pass, every block on
its own: one in a container that is named as boilerplate (menu, header,
footer, sidebar, notice, advert, form, comments), or with mostly link text,
is dropped; a form or a container named after its layout (content and sidebar
together) is a mere wrapper, which marked text inside it or the larger part
of the running text overrules; a container with a boilerplate word within a
longer name (share-price-story) is overruled when it alone holds the larger
part of the running text; one that is long and rich in stop words is kept; the others stay
open (``short``, or ``near`` when they lean towards text).  On a page whose
stop words are not known length alone decides.  Second pass: an
open block takes the label of the decided neighbours, nearest first, within
the container of the main text where the page marks one; a heading follows
what comes after it.  A mark counts when one marked container holds at least
as much running text as all that is outside of them.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select
    summary table tbody td tfoot th thead title tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript textarea title template svg math iframe object canvas noframes noembed xmp select datalist".split())
LIST_BOXES = frozenset("select optgroup option".split())     # end where any other block begins
BOILER_TAGS = frozenset("nav header footer aside form menu button select option fieldset dialog search label input head".split())
ONE_BY_ONE = frozenset("li dt dd td th tr option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset("article main".split())
UNNAMED_TAGS = frozenset("html body main".split())      # their class names speak of the whole page
WRAPPER_TAGS = frozenset("form fieldset".split())        # may hold a whole page
WRAPPER_ENDS = frozenset("wrap wrapper wrapping container inner outer holder row area group".split())
LAYOUT_WORDS = frozenset("layout template columns".split())
CONTENT_WORDS = frozenset("content main article post primary body text story entry center centre".split())
SIDE_WORDS = frozenset("sidebar sidebars rail widget widgets header banner ad ads".split())    # what a layout has beside its content
MODIFIERS = ("has-", "with-", "no-", "is-", "not-")
TOPICS = ("category-", "cat-", "tag-", "topic-", "term-", "type-", "status-", "format-", "comments-open", "comments-closed")    # names that classify the text
SURE_WORDS = frozenset("""comment comments comentarios commentaires kommentare disqus cookie cookies consent gdpr footer breadcrumb breadcrumbs menu nav
    navbar navigation navi pager pagination sidebar sidebars adslot adsense adsbygoogle advert advertisement advertising outbrain taboola""".split())
HEADER_WORDS = frozenset("header head masthead banner".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILER_WORDS = frozenset("""ad ads advert advertisement advertising adslot adsense adsbygoogle banner bottombar breadcrumb breadcrumbs byline-links
    comment comments comentarios commentaires kommentare disqus respond replies reply cookie cookies consent gdpr copyright
    footer foot header head-bar masthead menu nav navbar navigation navi toolbar pagination pager popup modal overlay newsletter
    notice notices notification alert promo promoted promotion sponsor sponsored sponsors related recommended recommendations
    share sharing shares social sidebar sidebars side-bar rail widget widgets skip subscribe subscription signup login
    search tags taglist tagcloud toc disclaimer legal outbrain taboola teaser teasers""".split())
MAIN_WORDS = frozenset("article articlebody article-body article-content content-body entry-content main main-content maincontent post-body post-content story story-body".split())
STOP_WORDS = frozenset("""a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its
    just like more most my no not of on one only or other our out over she so some such than that the their them then there these they this to up
    was we were what when which who will with would you your
    der die das den dem des ein eine einer eines einem einen und oder aber nicht ist sind war waren wird werden wurde hat haben hatte mit von vom
    zu zum zur im am an auf aus bei bis durch für gegen ohne um unter über vor wie wenn dass daß als auch er es sie ihr ihre sein seine wir man
    noch nur schon sehr sich so was wer wo
    le la les un une des du de et ou mais ne pas est sont était ont a avec pour par dans sur sous en au aux ce cet cette ces qui que quoi dont où
    il elle ils elles on nous vous je tu se sa son ses leur leurs plus moins très comme si être avoir fait
    el los las una unos unas del y o pero no es son era fue ha han con para por sin sobre entre al lo su sus se que quien cual como cuando donde
    más muy ya también este esta estos estas ese esa eso yo él ella ellos nosotros mi me te si hay ser estar""".split())
LONG, SOME = 140, 40             # code points: a block is long, a block is more than a scrap
STOP_HIGH, STOP_LOW = 0.20, 0.08
LINKS_MOST = 0.4
SENTENCE_ENDS = ".!?…。！？।॥؟۔」』\"'”»"
HEADING_REACH = 400              # code points between a heading and the text it belongs to

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_NAME_PART = re.compile(r"[a-z]+")
_WIDE = re.compile("[\u2e80-\ud7ff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]")
WIDE = 3                         # letters that a character of the East Asian scripts counts for
_STRIP = re.compile(r"^\W+|\W+$")
KEEP, DROP, SHORT, NEAR = "keep", "drop", "short", "near"
WRAPPER, SOFT, FIRM = 1, 2, 3    # strengths of a boilerplate flag; SOFT: by a word within a longer name


@dataclass
class Block:
    text: str
    links: int                   # code points inside links
    tag: str
    main: int                    # number of the container of the main text that it is in, or 0
    boiler: int                  # inside a container named as boilerplate: WRAPPER, SOFT, FIRM or 0
    soft: int = 0                # number of the outermost container flagged SOFT
    label: str = ""


def _named(name: str, inside: bool) -> int:
    """Strength of the boilerplate flag that a class name or id gives."""
    parts = _NAME_PART.findall(name)
    for k, part in enumerate(parts[1:], 1):
        if part + "-" in MODIFIERS or part == "without":     # page-with-sidebar: what follows is beside the text
            parts, name = parts[:k], "-".join(parts[:k])
            break
    found = {name, *parts} & BOILER_WORDS
    if inside:
        found -= HEADER_WORDS
    if not found:
        return 0
    layout = LAYOUT_WORDS.intersection(parts) or (parts[0] not in BOILER_WORDS and parts[-1] in WRAPPER_ENDS and CONTENT_WORDS.intersection(parts))
    if layout and found <= SIDE_WORDS:
        return WRAPPER
    return FIRM if name in BOILER_WORDS or found & SURE_WORDS else SOFT


def _hints(tag: str, attributes: str, inside: bool) -> tuple[int, bool]:
    """(strength of the boilerplate flag, named as main text) for an element;
    ``inside``: within the main text, where a header holds the headline."""
    boiler = 0
    if tag in BOILER_TAGS and not (inside and tag == "header"):
        boiler = WRAPPER if tag in WRAPPER_TAGS else FIRM
    firm = boiler == FIRM                        # by more than a name like right-sidebar, which may say what is beside
    main = named_main = tag in MAIN_TAGS
    class_main = False                           # the bare class name says little: main menu, main header
    if attributes and "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "").lower()
            if key == "role":
                if value in BOILER_ROLES:
                    boiler = max(boiler, WRAPPER if value == "form" else FIRM)
                    firm |= value != "form"
                named_main |= value in ("main", "article")
            elif key in ("class", "id"):
                first = value.replace("_", "-").split()[:1]
                first = first[0] if first else ""
                for name in value.replace("_", "-").split():
                    if name == "main" and key == "class":
                        class_main = True
                    elif name in MAIN_WORDS:
                        named_main = True
                    elif tag == "article":       # only its first name says what it is
                        if name == first and not name.startswith(TOPICS) and (name in BOILER_WORDS or name.startswith(("comment", "div-comment"))):
                            boiler = FIRM
                    elif tag not in UNNAMED_TAGS and not name.startswith(MODIFIERS + TOPICS):
                        named = _named(name, inside)
                        boiler = max(boiler, named)
                        firm |= named >= SOFT and (name in BOILER_WORDS or "sidebar" not in name)
            elif key == "itemprop":
                named_main |= value == "articlebody"
            elif (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                boiler, firm = FIRM, True
    if tag != "article" and (named_main or (class_main and not firm)):
        boiler = 0
    return boiler, main or named_main or (class_main and not boiler)


class Open:
    """The open elements, as (tag, boilerplate, main text, soft container),
    with where each tag and the block-level ones stand, so that no step looks
    through all of them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int, int]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, element: tuple[str, int, int, int]) -> None:
        self.at.setdefault(element[0], []).append(len(self.stack))
        if element[0] in BLOCK_TAGS:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def pop(self) -> None:
        name = self.stack.pop()[0]
        self.at[name].pop()
        if name in BLOCK_TAGS:
            self.blocks.pop()

    def close(self, name: str) -> None:
        """End tag; one without a start, or of an inline element around the
        open block, closes nothing."""
        where = self.at.get(name)
        if not where or (name not in BLOCK_TAGS and self.blocks and self.blocks[-1] > where[-1]):
            return
        for _ in range(len(self.stack) - where[-1]):
            self.pop()

    def block(self) -> tuple[str, int, int, int]:
        return self.stack[self.blocks[-1]] if self.blocks else ("body", 0, 0, 0)


def _ends(open_tag: str, name: str) -> bool:
    """The start of block ``name`` ends the open element: inline elements,
    paragraphs and items, and list boxes that were never closed."""
    if open_tag in LIST_BOXES:
        return name not in LIST_BOXES or open_tag == name
    return open_tag not in BLOCK_TAGS or open_tag == "p" or (name == open_tag and name in ONE_BY_ONE)


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    opened = Open()
    stack = opened.stack
    parts: list[str] = []
    endless: set[str] = set()                    # raw tags without an end tag from here on
    links, in_link, n_main, n_soft = 0, False, 0, 0
    tag, boiler, main, soft, cut = "body", 0, 0, 0, False    # of the open block; cut: in an inline element named as boilerplate

    def finish() -> None:
        nonlocal links
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, links, tag, main, boiler, soft))
        parts.clear()
        links = 0

    def words(raw: str) -> None:
        nonlocal links
        if raw and not cut:
            parts.append(raw)
            if in_link:
                links += len(entities.unescape(raw).strip())

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            words(page[at:])
            break
        words(page[at:lt])
        m = _TOKEN.match(page, lt) or _LOOSE_TAG.match(page, lt)
        if not m:
            words("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:                             # comment, declaration
            continue
        close, name, attributes = bool(m[1]), m[2].lower(), m[3]
        block = name in BLOCK_TAGS
        if name == "br":
            parts.append("\n")
            continue
        if name in RAW_TAGS and not close:
            if block:
                finish()
            if not attributes.endswith("/"):
                end = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                    continue
                endless.add(name)
                if name in ("script", "style", "textarea", "title"):
                    at = n
            if name != "select":
                continue
            block = True                         # a list box without an end: up to the next other block
        if name in VOID_TAGS:
            if name == "hr":
                finish()
            continue
        if block:
            finish()
        if close:
            in_link = in_link and not block and name != "a"
            opened.close(name)
        else:
            in_link = in_link or name == "a"
            while block and stack and _ends(stack[-1][0], name):
                opened.pop()
            _, up_boiler, up_main, up_soft = stack[-1] if stack else ("", 0, 0, 0)
            hints = _hints(name, attributes, up_main > 0)
            if hints[1] and up_boiler == WRAPPER:            # marked text inside a mere wrapper
                up_boiler = 0
            if hints[1] and not up_main:
                n_main += 1
                up_main = n_main
            flag = FIRM if hints[0] == SOFT and name == "a" else hints[0]
            if flag == SOFT and not up_soft:
                n_soft += 1
                up_soft = n_soft
            opened.push((name, max(up_boiler, flag), up_main, up_soft))
        tag, boiler, main, soft = opened.block()
        cut = bool(stack) and stack[-1][1] == FIRM > boiler
    finish()
    return out


def first_pass(found: list[Block]) -> None:
    rich = poor = 0                              # text with and without known stop words
    loose: list[tuple[Block, int]] = []          # blocks of few links without known stop words
    for b in found:
        size = len(b.text)
        if b.boiler == FIRM or b.links > LINKS_MOST * size or b.text.startswith("©"):
            b.label = DROP
            continue
        if not b.text.isascii():
            size += (WIDE - 1) * len(_WIDE.findall(b.text))
        tokens = b.text.lower().split()
        density = sum(t in STOP_WORDS or _STRIP.sub("", t) in STOP_WORDS for t in tokens) / len(tokens)
        if size < SOME or b.tag in HEADINGS:
            b.label = SHORT
        elif density >= STOP_LOW:
            b.label = KEEP if size >= LONG and density >= STOP_HIGH else NEAR
            rich += size
        else:
            b.label = NEAR if b.tag == "pre" else SHORT
            poor += size
            loose.append((b, size))
    if poor > rich:                              # the page's language has other stop words, or none
        for b, size in loose:
            b.label = KEEP if size >= LONG else NEAR
    if not any(b.label == KEEP for b in found):  # no long paragraph: the shorter ones are the text
        for b in found:
            if b.label == NEAR:
                b.label = KEEP
    # a container with a boilerplate word in a longer name drops its text
    # unless it alone holds the larger part of what runs
    soft = [b for b in found if b.boiler == SOFT]
    if soft:
        held: Counter[int] = Counter()
        for b in found:
            if b.label in (KEEP, NEAR):
                held[b.soft if b.boiler == SOFT else 0] += len(b.text)
        largest = max((k for k in held if k), key=lambda k: (held[k], -k), default=0)
        marked = any(b.main and not b.boiler and b.label != DROP and b.tag not in HEADINGS for b in found)
        for b in soft:
            if b.soft == largest and not marked and 2 * held[largest] > held.total():
                b.boiler = 0
            else:
                b.label = DROP
    # a wrapper drops its text unless that is the larger part of what runs
    wrapped = [b for b in found if b.boiler == WRAPPER]
    if wrapped:
        inside, outside = (sum(len(b.text) for b in found if b.label in (KEEP, NEAR) and bool(b.boiler) == x) for x in (True, False))
        marked = any(b.main and not b.boiler and b.label != DROP and b.tag not in HEADINGS for b in found)
        if marked or inside <= outside:
            for b in wrapped:
                b.label = DROP


def second_pass(found: list[Block]) -> list[Block]:
    """Open blocks inherit; returns the kept ones in page order."""
    sizes: Counter[int] = Counter()              # running text of each marked container, and outside (0)
    for b in found:
        if b.label in (KEEP, NEAR):
            sizes[b.main] += len(b.text)
    outside = sizes.pop(0, 0)
    marked = any(b.main and b.label != DROP for b in found) and max(sizes.values(), default=0) >= outside
    if marked:                                   # the page says where its text is
        for b in found:
            if not b.main:
                b.label = DROP
    else:                                        # a mark that is not trusted still speaks for its own text
        for b in found:
            if b.main and b.label == NEAR:
                b.label = KEEP
    # labels that others inherit; within marked text a block dropped by its
    # name says nothing about the paragraphs around it
    n = len(found)
    decided = [(KEEP if b.label == NEAR else None if not b.main or b.boiler else b.label) if marked else b.label for b in found]
    before: list[str | None] = [None] * n
    after: list[str | None] = [None] * n
    near_text = [False] * n                      # a heading with text soon after it
    last = None
    for i in range(n):
        before[i] = last
        if decided[i] in (KEEP, DROP):
            last = decided[i]
    last, reach = None, 0
    for i in range(n - 1, -1, -1):
        after[i] = last
        near_text[i] = last == KEEP and reach <= HEADING_REACH
        if decided[i] in (KEEP, DROP):
            last, reach = decided[i], 0
        else:
            reach += len(found[i].text)
    for i, b in enumerate(found):
        if b.label not in (SHORT, NEAR):
            continue
        sides = {x for x in (before[i], after[i]) if x}
        sentence = b.text[-1] in SENTENCE_ENDS
        if marked:                               # dropped only between dropped ones
            scrap = len(b.text) < SOME and b.tag not in HEADINGS and not sentence
            b.label = DROP if scrap and before[i] == after[i] == DROP else KEEP
        elif not sides:                          # nothing on the page is decided
            b.label = KEEP
        elif b.tag in HEADINGS:
            b.label = KEEP if near_text[i] else DROP
        elif b.label == NEAR:
            b.label = KEEP if KEEP in sides else DROP
        elif before[i] and after[i]:
            b.label = KEEP if sides == {KEEP} else DROP
        else:                                    # at an end of the page
            b.label = KEEP if sides == {KEEP} and sentence else DROP
    return [b for b in found if b.label == KEEP]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    first_pass(found)
    return "\n".join(b.text for b in second_pass(found))


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without the html, with its main text in column ``out`` and
    its code points in ``n_chars``.  Null or empty html gives an empty text;
    repeated rows stay; columns of the two names are replaced; an empty table
    stays empty.  One scan, no shuffle."""
    fields = [f for f in pages.schema.fields if f.name not in (html, out, "n_chars")]
    names = [f.name for f in fields]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + f"`{out}` string, n_chars bigint"

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*names, out, "n_chars"])

    return pages.mapInArrow(run, schema)
