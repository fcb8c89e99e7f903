"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides a block by where it stands (menus, headers, footers,
sidebars, notices, adverts, forms and comments are out), its link density, its length and its stop-word density. Short or
middling blocks stay undecided; the second pass gives them the label of the nearest decided neighbours. Every block of
the whole page is judged; nothing is cut off.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import each, without

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """the of and to in is that it for was on are as with his they at be this have from or by not but what all were we when
    your can there an which their if will has had who its a i you he she
    le la les de des du et un une est que qui dans pour pas sur au avec ce il elle ne se par plus sont ou mais nous vous
    der die das und ist von zu den mit sich auf für nicht ein eine als auch es an dem im werden aus er hat dass sie nach bei
    el los las y en del se por con para como más su al lo pero sus le ya o este sí porque esta entre cuando muy sin sobre
    """.split()
)
# Elements that never hold article text; words in class, id or role that mark such parts; words that say
# nothing beside them.
OUT = frozenset("nav aside footer form button select option dialog menu svg math canvas object audio video map label fieldset".split())
MARKS = frozenset(
    """nav navbar navigation menu masthead footer sidebar aside ad ads adv advert adverts advertisement adsense sponsor sponsored
    promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login
    comment comments respond disqus reply replies share sharing social related recommended recommendations breadcrumb breadcrumbs
    pagination pager search widget toolbar skip copyright legal disclaimer complementary contentinfo alert""".split()
)
SOFT = frozenset("search legal share sharing related alert banner promotion disclaimer copyright skip subscription".split())
HAVING = frozenset("with without has have no non not hide show enable enabled disable disabled plus".split())
FILLER = frozenset(
    """site page main top bottom left right first last primary secondary global box bar area section block wrap wrapper container
    inner outer list item items link links content panel slot unit row col column module group body form field input button
    buttons icon icons post posts article articles thread title text js ui the to in a is has header results""".split()
)
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td
    tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FOREIGN = frozenset("svg math".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
IN_HEAD = frozenset("html head title meta link script style base noscript template".split())
WALLS = frozenset("article main table".split())  # end tags inside close nothing outside, but for these and:
THROUGH = frozenset("body html main article div section".split())

HIGH, LOW, LONG, SHORT = 0.15, 0.06, 200, 70  # stop-word densities; lengths in characters
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""[\s/]*+(?:(?P<end>>)|(?P<name>[^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:(?P<quote>["'])|(?P<bare>[^\s>"'][^\s>]*+)?))?|=)""")
_COMMENT_END = re.compile(r"--!?>")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_WORD = re.compile(r"[^\W\d_]+")


class _Scanner:
    """The tokens of a page, in one pass over it: (text, None, None), ("", name, attributes) for a start tag and ("/", name, None)
    for an end tag; the attribute "/" tells that a tag closes itself. Attribute values have any length; a quote without its partner ends with the tag."""

    def __init__(self, page: str):
        self.page = page
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.unclosed: set[str] = set()

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        found: dict[str, str] = {}
        page = self.page
        while True:
            m = _ATTR.match(page, at)
            if m is None or m["end"]:
                if m and page[m.end() - 2] == "/":
                    found["/"] = ""
                return found, m.end() if m else len(page)
            at = m.end()
            value = m["bare"] or ""
            if m["quote"]:
                q = m["quote"]
                stop = page.find(q, at) if at <= self.quotes[q] else -1
                if stop < 0:
                    stop = page.find(">", at)
                    return found, stop + 1 if stop >= 0 else len(page)
                value, at = page[at:stop], stop + 1
            if m["name"]:
                found.setdefault(m["name"].lower(), value)

    def skipped(self, name: str, at: int) -> int:
        """The end of a raw element; without an end tag, scripts and styles run to the end of the page, other ones are empty."""
        if name not in self.unclosed:
            if m := _CLOSE[name].search(self.page, at):
                stop = self.page.find(">", m.end())
                return stop + 1 if stop >= 0 else len(self.page)
            self.unclosed.add(name)
        return len(self.page) if name in ("script", "style") else at

    def tokens(self) -> Iterator[tuple[str, str | None, dict[str, str] | None]]:
        page, at, begin, size = self.page, 0, 0, len(self.page)
        while at < size:
            at = page.find("<", at)
            if at < 0:
                break
            mark = page[at + 1 : at + 2]
            m = _NAME.match(page, at) if mark == "/" or mark.isascii() and mark.isalpha() else None
            if m is None and mark not in ("!", "?", "/") or mark == "/" and m is None and page[at + 2 : at + 3] in ("", " "):
                at += 1  # a lone sign
                continue
            if at > begin:
                yield page[begin:at], None, None
            if m is None:
                if page.startswith("<!--", at):
                    found = _COMMENT_END.search(page, at + 2)
                    at = found.end() if found else size
                elif page.startswith("<![CDATA[", at):
                    stop = page.find("]]>", at)
                    yield html.escape(page[at + 9 : stop if stop >= 0 else size], quote=False), None, None
                    at = stop + 3 if stop >= 0 else size
                else:
                    stop = page.find(">", at)
                    at = stop + 1 if stop >= 0 else size
            else:
                name = m[2].lower()
                attrs, at = self.attributes(m.end())
                if m[1]:
                    yield "/", name, None
                else:
                    if name in RAW:
                        at = self.skipped(name, at)
                    yield "", name, attrs
            begin = at
        if begin < size:
            yield page[begin:], None, None


@dataclass
class Block:
    text: str
    out: bool  # stands in a part that is no article
    soft: bool  # stands in a part whose name alone does not decide that
    article: int  # number of the article or main element around it, 0 if none
    heading: bool
    linked: int  # characters inside links
    label: str = ""
    link_like: bool = False
    stops: int = 0
    words: int = 0


@dataclass
class _Open:
    name: str
    out: bool = False
    soft: bool = False
    article: int = 0
    link: bool = False
    heading: bool = False
    header: bool = False
    paragraph: int = 0  # place of the open paragraph that a block would end, 0 if none
    wall: int = 0  # place of the nearest element that end tags do not reach beyond
    block: int = 0  # place of the nearest block


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    articles: int = 0
    nested: int = 0  # open articles
    stack: list[_Open] = field(default_factory=lambda: [_Open("")])
    where: dict[str, list[int]] = field(default_factory=dict)

    def text(self, raw: str) -> None:
        if self.stack[-1].out and not self.around().out:
            return  # an inline part that is no article text, within a block that may be
        self.parts.append(raw)
        if self.stack[-1].link:
            self.linked += len("".join(html.unescape(raw).split()))

    def around(self) -> _Open:
        """The nearest open block. It tells what its text is, whatever inline elements were left open."""
        return self.stack[self.stack[-1].block]

    def cut(self) -> None:
        if self.parts:
            top, text = self.around(), " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append(Block(text, top.out or (top.header and not top.heading), top.soft, top.article, top.heading, self.linked))
            self.parts.clear()
        self.linked = 0

    def open(self, element: _Open) -> None:
        self.where.setdefault(element.name, []).append(len(self.stack))
        self.nested += element.name == "article"
        self.stack.append(element)

    def close(self, place: int) -> None:
        """Close the element at a place of the stack with all inside it."""
        while len(self.stack) > place:
            gone = self.stack.pop()
            self.where[gone.name].pop()
            self.nested -= gone.name == "article"

    def end(self, name: str) -> None:
        """An end tag closes the nearest element of its name, if no wall stands between."""
        if places := self.where.get(name):
            if name in THROUGH or places[-1] >= self.stack[-1].wall:
                self.close(places[-1])


def _marks(words: list[str]) -> tuple[bool, bool]:
    """Whether the words of a class, an id or a role mark an element, and whether they only may.

    Words of one letter say nothing. A name is a mark if all its words are marks or say nothing, or if the last word that says something is
    one: reader-comments are comments; but a part that has or is without something (with-sidebar) is not that. A mark that other words
    follow (newsletter-archive) may be one; the density of the text decides."""
    said = [w for w in words if len(w) > 1 and w not in FILLER]
    found = [w for w in said if w in MARKS]
    if not found or any(w in HAVING for w in words):
        return False, False
    hard = any(w not in SOFT for w in found)
    if len(found) == len(said):
        return hard, not hard
    if said[-1] in MARKS:
        return said[-1] not in SOFT, said[-1] in SOFT
    return False, said[0] in MARKS and said[0] not in SOFT


def _marked(name: str, attrs: dict[str, str], inside: bool) -> tuple[bool, bool, bool]:
    """Whether class, id, role or hiding marks the element as no article text, does so by a word that may mean something else,
    or marks it as a header."""
    if "hidden" in attrs and attrs["hidden"].lower() != "until-found" or attrs.get("aria-hidden", "").lower() == "true" or _HIDES.search(attrs.get("style", "")):
        return True, False, False
    hard = soft = header = False
    if name not in ("html", "body", "main", "article"):
        for value in (x for key in ("class", "id", "role") for x in attrs.get(key, "").split()):
            words = [x.lower() for x in _PART.findall(value)]
            header = header or (bool(words) and "header" in words and all(w in FILLER for w in words))
            sure, may = _marks(words)
            hard, soft = hard or sure or may and not inside and all(w in MARKS or w in FILLER for w in words), soft or may
    return hard or (header and not inside), soft, header


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, each with its final label, good or bad."""
    state = _Page()
    in_head = False
    for mark, name, attrs in _Scanner(page or "").tokens():
        if name is None:
            if in_head and mark.strip():
                in_head = False
            if not in_head:
                state.text(mark)
            continue
        if name == "head":
            in_head = mark == ""
            continue
        if in_head:
            if name in IN_HEAD:
                continue
            in_head = False
        if name in RAW:
            continue
        if name in BLOCKS or name == "body":
            state.cut()
        elif name == "br":
            state.parts.append(" ")
        if mark == "/":
            state.end(name)
            continue
        if name in BLOCKS and state.stack[-1].paragraph:  # a new block ends an open paragraph
            state.close(state.stack[-1].paragraph)
        for other in CLOSES.get(name, ()):
            if state.stack[-1].name == other:
                state.close(len(state.stack) - 1)
        if name == "a" and (places := state.where.get("a")) and places[-1] > state.stack[-1].block:
            state.close(places[-1])  # links do not nest
        if name in VOID or "/" in attrs and (name in FOREIGN or any(state.where.get(x) for x in FOREIGN)):
            continue
        top, place = state.stack[-1], len(state.stack)
        marked, soft, is_header = _marked(name, attrs, bool(top.article)) if attrs else (False, False, False)
        article, header = top.article, top.header or (is_header and bool(top.article))
        if name == "header":
            header, marked = header or bool(article), marked or not article
        if name in ("article", "main") or attrs.get("role", "").lower() == "main":
            if name == "article" and state.nested:
                marked = True  # an article within an article is a comment on it
            else:
                state.articles += 1
                article = state.articles
        block = name in BLOCKS
        state.open(
            _Open(
                name,
                top.out or marked or name in OUT,
                top.soft or soft,
                article,
                top.link or name == "a",
                top.heading or (len(name) == 2 and name[0] == "h" and name[1] in "123456"),
                header,
                place if name == "p" else 0 if block else top.paragraph,
                place if name in WALLS else top.wall,
                place if block else top.block,
            )
        )
    state.cut()
    _label(state.blocks)
    return state.blocks


def _label(found: list[Block]) -> None:
    for b in found:
        words = _WORD.findall(b.text.lower())
        b.words, b.stops = len(words), sum(map(STOP_WORDS.__contains__, words))
        b.link_like = b.linked > 0.6 * len("".join(b.text.split()))
    total = sum(b.words for b in found)
    known = sum(b.stops for b in found) >= 0.02 * total  # a language of the list; else length and links decide
    size: dict[int, int] = {}
    for b in found:
        if not b.out:
            size[b.article] = size.get(b.article, 0) + len(b.text)
    inside = sum(n for a, n in size.items() if a)
    whole = inside >= 0.25 * max(1, sum(size.values()))  # the page marks its article, and most of its text stands there
    for i, b in enumerate(found):
        n, density = len(b.text), b.stops / max(1, b.words)
        plain = len("".join(b.text.split()))
        links = b.linked / max(1, plain)
        if b.out or (whole and not b.article):
            b.label = "bad"
        elif b.soft:  # a name such as search or legal: long plain prose may be article text after all
            b.label = "near" if n >= LONG and links < 0.1 and (not known or density >= HIGH) else "bad"
        elif links > (0.6 if b.article else 0.3):
            among = any(x.article == b.article and x.link_like for x in found[max(0, i - 1) : i] + found[i + 1 : i + 2])
            b.label = "near" if b.article and not among else "bad"
        elif b.heading:
            b.label = "near"
        elif n < SHORT:
            b.label = "bad" if b.linked and not b.article else "near"
        elif not known or density >= HIGH:
            b.label = "good" if n >= LONG or b.article else "near"
        elif density >= LOW or b.article:
            b.label = "near"
        else:
            b.label = "bad"
    _inherit(found, whole)


def _inherit(found: list[Block], whole: bool) -> None:
    """Undecided blocks take the label of the nearest decided one; inside a marked article only its own blocks count."""
    n = len(found)
    before: list[tuple[int, str]] = []
    last: tuple[int, str] = (-1, "")
    for i, b in enumerate(found):
        if i and found[i - 1].article != b.article:
            last = (-1, "")
        if b.label in ("good", "bad") and not (whole and b.out):
            last = (i, b.label)
        before.append(last)
    last = (-1, "")
    for i in range(n - 1, -1, -1):
        b = found[i]
        if i + 1 < n and found[i + 1].article != b.article:
            last = (-1, "")
        if b.label in ("good", "bad") and not (whole and b.out):
            last = (i, b.label)
            continue
        if b.label != "near":
            continue
        (p, left), (q, right) = before[i], last
        if not left and not right:
            label = "good" if b.article or not b.heading and b.stops else "bad"
        elif not left or not right:
            label = left or right
            if not b.article and not b.heading and b.words < 3:
                label = "bad"
        elif left == right:
            label = left
        else:
            label = left if i - p < q - i else right if q - i < i - p else "good" if b.article or b.heading else "bad"
        b.label = "kept" if label == "good" else "dropped"
    for b in found:
        b.label = "good" if b.label in ("good", "kept") else "bad"
    # at the end of the text, a claim of copyright outside articles and a lone link are none
    for b in reversed(found):
        if b.label == "good" and not b.link_like and (b.article or not b.text.startswith(("©", "Copyright ©"))):
            break
        b.label = "bad"


def main_text(page: str | None) -> str:
    """The good blocks of a page, one line each."""
    return "\n".join(b.text for b in blocks(page) if b.label == "good")


def _text_column(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in each(pages)], pa.string())


def _block_column(pages: pa.Array) -> pa.Array:
    rows = [[{"text": b.text, "good": b.label == "good", "heading": b.heading} for b in blocks(p)] for p in each(pages)]
    kind = pa.list_(pa.struct([("text", pa.string()), ("good", pa.bool_()), ("heading", pa.bool_())]))
    return pa.array(rows, kind)


def extracted(pages: DataFrame, *, html_col: str = "html", with_blocks: bool = False) -> DataFrame:
    """pages with text (good blocks in page order, joined by one newline) and n_chars, its code points; with blocks, if asked.

    A null or empty page, or one without article text, gives an empty text. White space in a block becomes one space;
    character references are decoded. Markup may be broken or end early. Input columns named like an added one are
    replaced; repeated rows are each extracted; an empty table gives an empty result.
    """
    added = ("text", "n_chars", "blocks") if with_blocks else ("text", "n_chars")
    source = F.col(f"`{html_col}`").cast("string")
    names = [F.col(f"`{c}`") for c in without(pages, *added).columns]
    made = [F.arrow_udf(_text_column, "string")(source).alias("text")]
    if with_blocks:
        made.append(F.arrow_udf(_block_column, "array<struct<text:string,good:boolean,heading:boolean>>")(source).alias("blocks"))
    return pages.select(*names, *made).withColumn("n_chars", F.length("text").cast("long"))
