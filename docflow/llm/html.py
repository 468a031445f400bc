"""Main text of web pages by two passes over text blocks.

First pass: a block is judged alone, by its link density, its length and its share of stop words; its place (menus,
footers, adverts and the like; article containers) shifts that.  Second pass: what stays undecided takes the label of its
nearest decided neighbours.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docflow.llm.common import without

# Names of HTML elements and common function words.
_RAW = "script style noscript template textarea title iframe xmp svg math object canvas select".split()
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
_ONE_OPEN = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ASIDE = set("nav footer aside form button dialog menu head fieldset".split())
_CONTENT = {"article", "main"}
_HEADINGS = "h1 h2 h3 h4 h5 h6".split()
_ASIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
_ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment "
    "comments reply replies disqus respond related recommended recommendations widget pagination pager toolbar skip".split()
)
_CONTENT_WORDS = set("article content post entry story main body text maintext".split())
_MODIFIERS = set("no not non has with without free enabled disabled layout".split())
_HEAD_TAGS = set("head title base link meta style script noscript template object".split())
_STOP = {
    "en": "the of and to a in is that for it was on with be as by he at from his not are but this have had an they which or were you we there been has when who will more if no out so said what up its about into than them can only".split(),
    "de": "der die das und in zu den von mit ist des sich auf für ein nicht im dem eine als auch es an er hat aus bei wie nach am war oder wird sind noch über einen so zum haben nur aber einer".split(),
    "fr": "le la les de des et un une du en que dans pour il est au qui ce ne pas sur plus par se avec je son sont ou mais nous lui cette ont aux été".split(),
    "es": "el la los las de que y en un una por con no para su se al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre".split(),
}
_STOP_SETS = [frozenset(words) for words in _STOP.values()]

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^<>"']*+(?:(?:"[^"<]*+"|'[^'<]*+')[^<>"']*+)*+>|[^>]*+(?:>|\Z))""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in _RAW}


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass, in characters and shares."""

    short: int = 70
    long: int = 200
    link_density: float = 0.2
    content_link_density: float = 0.6
    stop_low: float = 0.10


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    aside: bool = False
    content: bool = False
    hinted: bool = False
    heading: bool = False

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _hint(tag: str, attrs: str, in_content: bool) -> str:
    """What an element says about its content: "aside", "content", "hint" (a class name for content) or nothing.

    Names that only say what a layout has or lacks (`banner-free`, `no-sidebar`) say nothing.
    """
    if tag in _ASIDE or tag == "header" and not in_content:
        return "aside"
    found = "content" if tag in _CONTENT else ""
    if len(attrs) < 4:
        return found
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in _ASIDE_ROLES:
            return "aside"
        if key == "role" and value.lower() == "main":
            found = "content"
        if key in ("class", "id") and tag not in ("html", "body"):
            names = [{w.lower() for w in _NAME.findall(name)} for name in value.split()]
            names = [words for words in names if words and not words & _MODIFIERS]
            words = set().union(*names)
            if words & _ASIDE_WORDS and not (tag in _CONTENT or in_content and words & {"header", "text", "body"} and not words & (_ASIDE_WORDS - {"header"})):
                return "aside"
            if not found and any(name <= _CONTENT_WORDS for name in names):
                found = "hint"
    return found


class _Open:
    """The open elements, with counts so that no question about them takes longer on deeply nested pages."""

    def __init__(self):
        self.stack: list[tuple[str, str]] = []
        self.tags: Counter[str] = Counter()
        self.hints: Counter[str] = Counter()

    def push(self, tag: str, hint: str) -> None:
        self.stack.append((tag, hint))
        self.tags[tag] += 1
        self.hints[hint] += 1

    def pop(self) -> tuple[str, str]:
        tag, hint = self.stack.pop()
        self.tags[tag] -= 1
        self.hints[hint] -= 1
        return tag, hint

    def heading(self) -> bool:
        return any(self.tags[t] for t in _HEADINGS)

    def end(self, tag: str) -> bool:
        """Close the innermost element of this name and all inside it; whether a block or an aside ended."""
        broke = tag not in _INLINE
        while self.tags[tag]:
            name, hint = self.pop()
            broke = broke or name not in _INLINE or hint == "aside"
            if name == tag:
                break
        return broke

    def imply(self, names: set[str]) -> None:
        """Close elements that a new block ends without saying so."""
        while any(self.tags[t] for t in names):
            depth = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] not in _INLINE), None)
            if depth is None or self.stack[depth][0] not in names:
                return
            while len(self.stack) > depth:
                self.pop()


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order.  Inline elements stay inside their block; broken markup is read as browsers do."""
    out = [Block()]
    opened = _Open()
    place = 0

    def begin() -> None:
        if out[-1].parts:
            out.append(Block())
        out[-1].aside = opened.hints["aside"] > 0
        out[-1].content = opened.hints["content"] > 0
        out[-1].hinted = opened.hints["hint"] > 0
        out[-1].heading = opened.heading()

    def add(raw: str) -> None:
        # Text of an inline advert or notice inside a block of other text is left out.
        if raw and (out[-1].aside or not opened.hints["aside"]):
            text = entities.unescape(raw)
            out[-1].parts.append(text)
            if opened.tags["a"]:
                out[-1].linked += len("".join(text.split()))

    while True:
        m = _TOKEN.search(page, place)
        add(page[place : m.start()] if m else page[place:])
        if not m:
            return [b for b in out if b.text]
        place = m.end()
        if m["tag"] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3])
            continue
        tag = m["tag"].lower()
        if opened.tags["head"] and tag not in _HEAD_TAGS and not m["end"]:
            opened.end("head")
            begin()
        if m["end"]:
            if opened.end(tag):
                begin()
            continue
        if tag in _RAW_END:
            closing = _RAW_END[tag].search(page, place)
            place = closing.end() if closing else len(page)
            continue
        if tag in _VOID:
            add(" ")
            if tag == "hr":
                begin()
            continue
        if tag not in _INLINE:
            opened.imply(_ONE_OPEN.get(tag, set()) | {"p"})
        opened.push(tag, _hint(tag, m["attrs"], opened.hints["content"] + opened.hints["hint"] > 0))
        if tag not in _INLINE:
            begin()


def stop_share(text: str) -> float:
    words = re.findall(r"\w+", text.lower())
    return max((sum(w in stop for w in words) for stop in _STOP_SETS), default=0) / len(words) if words else 0.0


#: Marks of the first pass, rising; those in the middle are undecided.
BAD, SHORT, NEAR, GOOD = range(4)


def _alone(block: Block, text: str, density: float, rules: Rules) -> int:
    """What a block is by link density, length and stop words."""
    if block.aside or text[0] in "©®" or density > rules.link_density or not any(c.isalnum() for c in text):
        return BAD
    if len(text) < rules.short:
        return BAD if block.linked else SHORT
    if stop_share(text) >= rules.stop_low:
        return GOOD if len(text) >= rules.long else NEAR
    return NEAR if len(text) >= rules.long else SHORT


def _first_pass(page_blocks: list[Block], rules: Rules) -> list[int]:
    """Marks of all blocks.

    An article container lifts what is inside to good, unless nearly all of it is links, and lowers what is outside to
    bad, if it holds at least as much text as is good outside by itself.  Otherwise it counts like a class name that says
    content: it lifts an undecided block by one.
    """
    texts = [b.text for b in page_blocks]
    density = [b.linked / len("".join(t.split())) for b, t in zip(page_blocks, texts, strict=True)]
    alone = [_alone(b, t, d, rules) for b, t, d in zip(page_blocks, texts, density, strict=True)]
    inside = sum(len(t) for b, t in zip(page_blocks, texts, strict=True) if b.content and not b.aside)
    outside = sum(len(t) for b, t, mark in zip(page_blocks, texts, alone, strict=True) if mark == GOOD and not b.content)
    trusted = 0 < inside >= outside
    out = []
    for block, text, links, mark in zip(page_blocks, texts, density, alone, strict=True):
        if block.aside or text[0] in "©®" or trusted and not block.content:
            mark = BAD
        elif trusted:
            mark = BAD if links > rules.content_link_density and not block.heading else GOOD
        elif mark != BAD and (block.content or block.hinted):
            mark = min(mark + 1, GOOD)
        out.append(mark)
    return out


def labels(page_blocks: list[Block], rules: Rules = Rules()) -> list[bool]:  # noqa: B008
    """Whether each block is main text.

    An undecided block between two good ones is good; between a good and a bad one it is good if nearly good, or if the
    good one is nearer, counted in blocks, or if it is a heading before a good one.  Without good blocks the nearly good
    count as such, and without those the short ones.
    """
    first = _first_pass(page_blocks, rules)
    for weaker in (NEAR, SHORT):
        if GOOD not in first:
            first = [GOOD if x == weaker else x for x in first]
    n = len(first)
    before, after, seen = [(n + 1, False)] * n, [(n + 1, False)] * n, None
    for i in range(n):
        if first[i] in (GOOD, BAD):
            seen = i
        elif seen is not None:
            before[i] = (i - seen, first[seen] == GOOD)
    seen = None
    for i in range(n - 1, -1, -1):
        if first[i] in (GOOD, BAD):
            seen = i
        elif seen is not None:
            after[i] = (seen - i, first[seen] == GOOD)
    out = []
    for i in range(n):
        if first[i] in (GOOD, BAD):
            out.append(first[i] == GOOD)
            continue
        (d0, good0), (d1, good1) = before[i], after[i]
        if good0 == good1:
            out.append(good0)
        else:
            nearer = good0 and d0 < d1 or good1 and d1 < d0
            out.append(nearer or first[i] == NEAR or page_blocks[i].heading and good1)
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:  # noqa: B008
    found = blocks(page or "")
    return " ".join(b.text for b, good in zip(found, labels(found, rules), strict=True) if good)


def extract(pages: DataFrame, html: str = "html", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Add text, the page's main text (empty if it has none, or the page is null), and n_chars, its code points.

    Input columns of these names are replaced.
    """

    @F.arrow_udf(StringType())
    def text(page: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py(), rules) for x in page], pa.string())

    kept = without(pages, "text", "n_chars") if html.lower() not in ("text", "n_chars") else pages
    return kept.withColumn("text", text(F.col(html))).withColumn("n_chars", F.length("text").cast("long"))
