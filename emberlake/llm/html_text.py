"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. First pass: a block in a container that
holds menus, headers of a site, footers, sidebars, notices, adverts, forms or comments is
boilerplate; otherwise its link density, its length and its density of stop words decide
between text, boilerplate and undecided. Second pass: undecided blocks take the label of the
nearest decided neighbours outside such containers; where the two sides differ, the nearer
one counts and text wins a tie. A long block that is not made of links doesn't become
boilerplate because links stand beside it.

Stop words are listed for four languages. A page whose long blocks hold few of them is in
another language; there, the short words that recur in these blocks count as stop words,
and a block without any stays undecided. Ideographs and kana are words of their own and
weigh as much as ``WIDE`` letters in all lengths.

A word in class, id or role marks a container only where the container doesn't hold most of
the text in article and main elements, nor, with no text in such elements beside it, most of
what the rules on single blocks call text and a long block's worth of it: themes name a sidebar or comments in the wrapper
of the whole page. Such a wrapper is judged by its blocks.

An article that holds at least half of the long text is a prior in both passes. Inside it a
block is boilerplate by itself only if links and stop words both say so, or in a run of
links; outside it a block is text by itself only if it is long and full of stop words. An
undecided block follows the article unless the decided neighbours of its own kind on both
sides speak against it.

Scripts, styles, markup and comments of the source never become text. Character references
are decoded, white space inside a block becomes one space, blocks are joined in page order
by one space. Nothing is cut off: texts of any length come out whole. A tag that the end of
the page cuts off is dropped.

Null and empty html give an empty text and no blocks. Repeated rows are extracted each.
Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import small_batches

# Names of HTML elements.
BLOCKS = frozenset("""address article aside blockquote body br button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav object ol optgroup option p pre section select summary table tbody td textarea
tfoot th thead title tr ul video""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not text.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button head title".split())
TEXT_ONLY = frozenset("script style textarea title noscript iframe".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
#: A closing tag ends elements of its name, and an opening one of these ends an open one of the same kind.
SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Opening tags that end an open paragraph.
ENDS_P = frozenset("""address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table
ul""".split())
#: Words in class, id or role of an element that mark boilerplate, matched whole between separators.
BOILERPLATE_WORDS = frozenset("""ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies
disqus disclaimer footer footnav gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommendation
recommendations recommended related reply replies respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription tags toolbar widget widgets
complementary""".split())
ARTICLE_WORDS = frozenset("article content entry main maincontent post story".split())
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset("""a an and are as at be been but by can for from had has have he her his if in is it its not of on or she that the their there they this to was we were
which will with would you au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou par pas plus pour qu que qui sa se ses
son sont sur un une vous aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich
sie sind so und vom von vor war wie wir wird zu zum zur al como con del desde donde el ella ellos era es esta este fue ha hay las lo los más mi muy no nos o para pero por
porque qué si sin sobre su sus también todo un una uno y ya yo""".split())

#: Rules of the first pass: link density, characters of a short and a long block, stop words per word.
MAX_LINKS, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.4, 70, 200, 0.10, 0.22
#: Link-only blocks in a row that make a menu inside an article.
MENU = 3
#: A marked wrapper has so many times the text of the articles beside it, or it isn't the page's layout.
BESIDE = 4
#: Letters that a character of a script without spaces stands for, and letters of a short word.
WIDE, SHORT_WORD = 3, 4
TEXT, BOILERPLATE, UNDECIDED = "text", "boilerplate", "undecided"
#: Elements that keep an end tag from being implied in what lies around them.
BARRIERS = frozenset("table ul ol dl article section div main".split())

_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_SHUT = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in TEXT_ONLY}
_QUOTE = re.compile(r"=\s*([\"'])")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_SEPARATORS = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")
_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_TOKEN = re.compile("[\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]|[^\\s\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]+")


def _tags(source: str):
    """(start, end, closing, name, attributes) of every tag; name is empty for comments and declarations.

    One pass: what is looked for and not found once is not looked for again.
    """
    size, at = len(source), 0
    missing: set[str] = set()

    def find(what: str, start: int) -> int:
        k = -1 if what in missing else source.find(what, start)
        if k < 0:
            missing.add(what)
        return k

    while (start := find("<", at)) >= 0:
        if source.startswith("<!--", start):
            k = find("-->", start + 4)
            at = size if k < 0 else k + 3
            yield start, at, False, "", ""
        elif source.startswith("<![CDATA[", start):
            k = find("]]>", start)
            at = size if k < 0 else k + 3
            yield start, at, False, "", ""
        elif m := _NAME.match(source, start + 1):
            at = find(">", m.end())
            seek = m.end()
            while at >= 0 and (q := _QUOTE.search(source, seek, at)):
                k = find(q[1], q.end())
                if k < 0:  # a quote that never ends doesn't hide the rest of the page
                    break
                seek = k + 1
                if k > at:
                    at = find(">", seek)
            if at < 0:  # cut off by the end of the page
                yield start, size, False, "", ""
                return
            name, attributes = m[2].lower(), source[m.end() : at]
            at += 1
            if name in TEXT_ONLY and not m[1]:  # up to its own closing tag nothing is markup
                shut = None if name in missing else _SHUT[name].search(source, at)
                if not shut:
                    missing.add(name)
                at = shut.end() if shut else size
                name = ""
            yield start, at, bool(m[1]), name, attributes
        elif source[start + 1 : start + 2] in ("!", "?", "/"):
            k = find(">", start)
            at = size if k < 0 else k + 1
            yield start, at, False, "", ""
        else:  # an ordinary character
            at = start + 1


class Block(NamedTuple):
    text: str
    links: int  # characters inside links
    article: bool
    outside: bool  # inside a container that holds no main text
    barred: bool = False  # ... whatever words in class, id or role say


class Wrapper(NamedTuple):
    """A container that only a word in its class, id or role marks, by the blocks and articles opened and closed inside it."""

    start: int  # of its tag in the source
    block: int
    article: int
    block_end: int
    article_end: int


def _role(name: str, attributes: str, in_article: bool) -> tuple[str | None, str | None]:
    """What an opening tag says about its content, and what it says without the words that mark boilerplate."""
    if name in RAW:
        return "raw", "raw"
    if name in BOILERPLATE_TAGS or (name == "header" and not in_article):
        return BOILERPLATE, BOILERPLATE
    if name in ("html", "body"):
        return None, None
    plain = "article" if name in ARTICLE_TAGS else None
    if attributes:
        if _HIDDEN.search(attributes):
            return BOILERPLATE, BOILERPLATE
        words = {w for m in _MARKS.finditer(attributes) for w in _SEPARATORS.split((m[1] or m[2] or m[3] or "").lower())}
        marks = words & BOILERPLATE_WORDS
        if in_article or words & ARTICLE_WORDS:
            marks -= {"header"}  # the heading of an article, not of the site
            plain = "article" if words & ARTICLE_WORDS else plain
        if name not in ARTICLE_TAGS and marks:
            return BOILERPLATE, plain
    return plain, plain


def blocks(source: str) -> list[Block]:
    """Blocks of a page in order, without empty ones."""
    found, homes, wrappers = _parse(source, frozenset())
    wrong = _layout(found, homes, wrappers) if wrappers else frozenset()
    return _parse(source, wrong)[0] if wrong else found


def _layout(found: list[Block], homes: list[int], wrappers: list[Wrapper]) -> frozenset[int]:
    """Tags of marked wrappers that hold most of the text in article and main elements, or most of the page's text by the rules on blocks.

    A word there tells of the page's layout. ``homes`` are the articles of blocks, -1 without one.
    """
    n = max([*homes, *(w.article_end - 1 for w in wrappers), -1]) + 1
    articles, text, homed, all_homed = np.zeros(n + 1, np.int64), *np.zeros((3, len(found) + 1), np.int64)
    for i, (b, home) in enumerate(zip(found, homes)):
        text[i + 1] = len(b.text) if dealt_label(b) == TEXT and not b.barred else 0
        if home >= 0 and not b.barred:
            articles[home + 1] += len(b.text)
            homed[i + 1], all_homed[i + 1] = text[i + 1], len(b.text)
    articles, text, homed, all_homed = np.cumsum(articles), np.cumsum(text), np.cumsum(homed), np.cumsum(all_homed)
    out = set()
    for w in wrappers:
        held = 2 * (articles[w.article_end] - articles[w.article]) > articles[-1]
        own, apart, short = (x[w.block_end] - x[w.block] for x in (text, homed, all_homed))
        # An article beside it has text of its own, by the rules or by its share.
        elsewhere = homed[-1] > apart or BESIDE * (all_homed[-1] - short) > own
        if held or (own >= LONG and 2 * own > text[-1] and not elsewhere):
            out.add(w.start)
    return frozenset(out)


def _parse(source: str, layout: frozenset[int]) -> tuple[list[Block], list[int], list[Wrapper]]:
    """Blocks, their innermost article or main elements, and marked wrappers; at the tags ``layout`` marking words don't count."""
    out: list[Block] = []
    homes: list[int] = []
    wrappers: list[Wrapper] = []
    inside: list[int] = []  # open article and main elements
    articles = 0
    parts: list[str] = []
    linked: list[str] = []
    open_: list[tuple[str, str | None, Wrapper | None, bool]] = []
    places: dict[str, list[int]] = {}  # of the open elements of a name
    barriers: list[int] = []
    count = {"article": 0, BOILERPLATE: 0, "raw": 0, "a": 0, "marked": 0}

    def end() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            links = len(_SPACE.sub(" ", html.unescape("".join(linked))).strip())
            out.append(Block(text, links, count["article"] > 0, count[BOILERPLATE] > 0, count[BOILERPLATE] > count["marked"]))
            homes.append(inside[-1] if inside else -1)
        parts.clear()
        linked.clear()

    def close(k: int) -> None:
        while len(open_) > k:
            name, role, wrapper, own = open_.pop()
            places[name].pop()
            if name in BARRIERS:
                barriers.pop()
            if role:
                count[role] -= 1
            if wrapper:
                count["marked"] -= 1
                wrappers.append(wrapper._replace(block_end=len(out), article_end=articles))
            if own:
                inside.pop()
            if name == "a":
                count["a"] -= 1

    def add(piece: str) -> None:
        if piece and not count["raw"]:
            parts.append(piece)
            if count["a"]:
                linked.append(piece)

    at = 0
    for start, stop, closing, name, attributes in _tags(source):
        add(source[at:start])
        at = stop
        if not name:
            continue
        if name in BLOCKS:
            end()
        if closing:
            if places.get(name):
                close(places[name][-1])
            continue
        if name in VOID or attributes.endswith("/") and name in ("path", "rect", "circle", "use"):
            continue
        ended = SELF_CLOSING.get(name, ())
        if name in ENDS_P:
            ended = (*ended, "p")
        k = max((places[n][-1] for n in ended if places.get(n)), default=-1)
        if k >= 0 and k > (barriers[-1] if barriers else -1):
            end()
            close(k)
        if name == "body":  # a head that was never closed ends here
            close(0)
        role, plain = _role(name, attributes, count["article"] > 0)
        wrapper = None
        if start in layout:
            role = plain
        elif role != plain:
            wrapper = Wrapper(start, len(out), articles, 0, 0)
            count["marked"] += 1
        own = name in ARTICLE_TAGS and role == "article"
        if own:
            inside.append(articles)
            articles += 1
        places.setdefault(name, []).append(len(open_))
        if name in BARRIERS:
            barriers.append(len(open_))
        open_.append((name, role, wrapper, own))
        if role:
            count[role] += 1
        if name == "a":
            count["a"] += 1
    add(source[at:])
    end()
    close(0)
    return out, homes, wrappers


class Language(NamedTuple):
    """Stop words of a page, and whether they are those of a listed language."""

    words: frozenset[str]
    listed: bool


LISTED = Language(STOP_WORDS, True)


def words_of(text: str) -> list[str]:
    return [w.strip(".,;:!?()\"'").lower() for w in (_TOKEN.findall(text) if _WIDE.search(text) else text.split())]


def size(text: str) -> int:
    """Length in letters."""
    return len(text) if text.isascii() else len(text) + (WIDE - 1) * len(_WIDE.findall(text))


def language_of(found: list[Block]) -> Language:
    long = [b.text for b in found if not b.outside and size(b.text) >= SHORT and b.links <= MAX_LINKS * len(b.text)]
    words = " ".join(long).lower().split()
    if sum(map(STOP_WORDS.__contains__, words)) >= FEW_STOPS * len(words):
        return LISTED
    counts = Counter(w for text in long for w in words_of(text))
    return Language(STOP_WORDS | {w for w, n in counts.items() if n > 1 and w.isalpha() and len(w) <= SHORT_WORD}, False)


def dealt_label(block: Block, language: Language = LISTED) -> str:
    """Link density, length and stop words of one block alone."""
    if block.links > MAX_LINKS * len(block.text) or "©" in block.text[:3]:
        return BOILERPLATE
    length = size(block.text)
    if length < SHORT:
        return UNDECIDED
    stops = stop_share(block, language)
    if stops >= MANY_STOPS or (stops >= FEW_STOPS and length >= LONG):
        return TEXT
    return UNDECIDED if stops >= FEW_STOPS or length >= LONG or not language.listed else BOILERPLATE


def stop_share(block: Block, language: Language = LISTED) -> float:
    words = words_of(block.text)
    return sum(w in language.words for w in words) / len(words)


def first_label(block: Block, has_article: bool, language: Language = LISTED) -> str:
    """Rules on one block; what speaks against the page's article has to be stronger than either alone."""
    if block.outside:
        return BOILERPLATE
    label = dealt_label(block, language)
    if not has_article:
        return label
    if block.article:
        linked = size(block.text) >= SHORT and block.links > MAX_LINKS * len(block.text) and stop_share(block, language) < FEW_STOPS
        return UNDECIDED if label == BOILERPLATE and not linked else label
    strong = label == TEXT and size(block.text) >= LONG and stop_share(block, language) >= MANY_STOPS
    return UNDECIDED if label == TEXT and not strong else label


def article_holds(found: list[Block]) -> bool:
    """Whether the page has an article that counts: one with at least half of the long text."""
    inner = [b for b in found if not b.outside]
    long = [b for b in inner if size(b.text) >= SHORT and b.links <= MAX_LINKS * len(b.text)]
    return any(b.article for b in inner) and 2 * sum(len(b.text) for b in long if b.article) >= sum(len(b.text) for b in long)


def labels(found: list[Block]) -> list[str]:
    """Both passes over a page."""
    has_article, language = article_holds(found), language_of(found)
    first = [first_label(b, has_article, language) for b in found]
    # A run of blocks that are links and nothing else is a menu, inside an article too.
    run: list[int] = []
    for i, b in enumerate([*found, None]):
        if b and has_article and b.article and b.links >= 0.9 * len(b.text):
            run.append(i)
            continue
        if len(run) >= MENU:
            for k in run:
                first[k] = BOILERPLATE
        run = []
    out = list(first)
    # With an article, blocks inside and outside of it have neighbours of their own kind only.
    for kind in (True, False) if has_article else (None,):
        own = [i for i, b in enumerate(found) if kind is None or b.article == kind]
        decided = [i for i in own if first[i] != UNDECIDED and not found[i].outside]
        k = 0  # decided[k] is the next decided block
        for i in own:
            while k < len(decided) and decided[k] < i:
                k += 1
            if first[i] != UNDECIDED:
                continue
            sides = [(abs(i - j), first[j] != TEXT, first[j]) for j in decided[max(0, k - 1) : k + 1]]
            if kind is None:
                if size(found[i].text) >= LONG:
                    sides = [s for s, j in zip(sides, decided[max(0, k - 1) : k + 1]) if found[j].links <= MAX_LINKS * len(found[j].text)]
                # Without a decided neighbour there is nothing to tell the block from.
                out[i] = min(sides)[2] if sides else TEXT
            else:  # the article's word holds unless both sides speak against it
                prior, other = (TEXT, BOILERPLATE) if kind else (BOILERPLATE, TEXT)
                against = 0 < k < len(decided) and all(label == other for _, _, label in sides)
                out[i] = other if against else prior
    return out


def main_text(source: str) -> str:
    found = blocks(source)
    return " ".join(b.text for b, label in zip(found, labels(found)) if label == TEXT)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text_of(sources: pd.Series) -> pd.Series:
        return sources.map(lambda s: main_text(s) if s else "")

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(F.col(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op9_html": op9_html}
