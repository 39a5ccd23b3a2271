"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element, and every line gets a weight: the length of its text outside
links, LINE code points at most, a quarter of it where it does not read as a sentence or heading. Markup changes weights
only: lines of elements that are page furniture by their name, role or class weigh nothing and are never kept, and where a
page marks its article the lines inside weigh LINE and all others nothing. The weights are summed over a sliding window of
lines. The main text starts at the surge, where the sum first passes a share of the page's peak (CUT code points at most),
and ends at the dive, after which it falls below that for good. Everything between them is kept, lines of links too unless
they stand outside a marked article; start and end are widened over neighbouring lines that also have weight. Without
a marked article, text ahead of the only title is left out if it weighs less than what follows.

A class or id tells by the last word of one of its names (sidebar, not has-sidebar or sidebar-container), and only of
elements that do not themselves write text, such as headings; of a paragraph it tells adverts, notices and offers, of an article readers' comments only.
The header of an article is part of it. A name does not count for elements that hold, alone or all of one name, most of the
marked article, or most of the text of a page without one; comments of readers are no part of either.

Defined results: a null or empty page has an empty text; text outside any element counts; unclosed elements end with
their parents, unclosed comments and scripts with the page; formulas are text, annotations of them are not; repeated rows are repeated; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

WINDOW, SURGE, LINE, CUT = 3, 0.1, 100, 20
# Elements of HTML by what they do to text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul xmp".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg annotation annotation-xml textarea noframes noembed canvas audio video head".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button select label fieldset search".split())
P_ENDS = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption option optgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog status".split())
# Elements that a page writes its text in: their names tell how it looks, not that it is furniture.
TEXTS = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote caption thead tr th span b i em strong code cite mark sub sup q kbd samp var u s tt font abbr time xmp".split())
TALK = r"comments?|commentlist|disqus|replies|reply|respond|responses|discussion"
# The last word of a name, or all of it; a number and a word for its place or parts may follow.
LAST = r"(?:^|[_-])(?:{})(?:[_-]?\d+|[_-](?:left|right|top|bottom|links?|lists?|items?|buttons?|posts|articles))*$"
NAMES = re.compile(LAST.format(
    r"ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notices?|notifications?|alert|newsletter|subscribe"
    r"|signup|login|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|" + TALK + r"|share|sharing|social"
    r"|related|recommended|popup|modal|overlay|widget|pagination|pager|toolbar|copyright|disclaimer|skip-link"), re.I)
# What even a paragraph is not text by.
OFFERS = re.compile(LAST.format(r"ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notices?|newsletter|subscribe|signup|share|sharing"), re.I)
TALKS = re.compile(LAST.format(TALK), re.I)
NOT = re.compile(r"(?:^|[_-])(?:has|have|no|not|non|with|without)[_-]|(?:^|[_-])(?:post|article|entry|story|content|section|chapter|blog|news|title)[_-]header$", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 title caption legend summary dt th".split())
SENTENCE = re.compile(r"[.!?:;\u2026\u3002\uff01\uff1f\u061f\u06d4\u0964][\"'\u201d\u2019\u00bb)\]]*$")
LEGAL = re.compile(r"^\s*(?:\u00a9|\(c\) |copyright\b)|\ball rights reserved\b|\balle rechte vorbehalten\b|\btodos los derechos reservados\b|\btous droits r\u00e9serv\u00e9s\b", re.I)
ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("title", "xmp")}
CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|itemprop|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@lru_cache(1 << 14)
def _named(value: str) -> str:
    """The first name in a class or id that says page furniture, one of readers' talk before others."""
    names = [n for n in CAMEL.sub("-", value).split() if NAMES.search(n) and not NOT.search(n)]
    return next((n for n in names if TALKS.search(n)), names[0] if names else "")


def _marks(name: str, attributes: str) -> tuple[bool, bool, str]:
    """(page furniture, main article, the name that says furniture) by element name and attributes."""
    furniture, main, named = name in FURNITURE, name in ("article", "main"), ""
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                furniture |= value.lower() in ROLES
                main |= value.lower() in ("main", "article")
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                furniture = True
            elif key == "style":
                furniture |= "display:none" in value.replace(" ", "").lower()
            elif key == "itemprop":
                main |= value == "articleBody"
            elif name not in ("html", "body") and (name not in TEXTS or name == "p"):
                other = _named(value)
                if name in ("article", "main") and not TALKS.search(other) or name == "p" and not OFFERS.search(other):
                    continue
                named = other if other and (not named or TALKS.search(other)) else named
    return furniture, main, named


def _by_names(found: list[tuple[str, bool, bool, int, int, int]], around: list[int], names: list[str]) -> list[bool]:
    """Whether each named element is page furniture, by itself or with one around it. It is not if it, or all elements of
    its name together, holds most of the article, or of the text of a page that marks none; and none with text is if else
    nothing would be left."""
    talk: list[bool] = []
    for k, outer in enumerate(around):
        talk.append(bool(TALKS.search(names[k])) or (outer >= 0 and talk[outer]))
    spoken = lambda at: at >= 0 and talk[at]
    said = [(inside, at, len(text)) for text, furniture, inside, at, plain, _ in found if not furniture and (inside or plain)]
    said = [x for x in said if not spoken(x[1])] or said
    article = [x for x in said if x[0]]
    # articles inside named elements alone, of less than a quarter of the text, are teasers
    if any(at < 0 for _, at, _ in article) or 4 * sum(n for _, _, n in article) >= sum(n for _, _, n in said):
        said = article or said
    holds, of_name = [0] * len(around), Counter()
    for _, at, n in said:
        if at >= 0:
            holds[at] += n
            of_name[names[at]] += n
    for k in range(len(around) - 1, -1, -1):
        if around[k] >= 0:
            holds[around[k]] += holds[k]
    holds = [max(n, of_name[name]) for n, name in zip(holds, names)]
    total = sum(n for _, _, n in said)

    def out(kept: Callable[[int], bool]) -> list[bool]:
        gone = [not kept(n) for n in holds]
        for k, outer in enumerate(around):
            gone[k] = gone[k] or (outer >= 0 and gone[outer])
        return gone

    gone = out(lambda n: 2 * n > total)
    return out(lambda n: n > 0) if said and all(at >= 0 and gone[at] for _, at, _ in said) else gone


def lines(page: str) -> list[tuple[str, bool, bool, int, int]]:
    """(text, furniture, inside an article, length outside links, whether a heading, 2 for a title) for each block of the page that has text."""
    found: list[tuple[str, bool, bool, int, int, int]] = []  # the same, with the innermost named element before the length
    stack: list[tuple[str, bool, bool, int, bool]] = []  # name, the marks of it and all around it, whether inside a link
    around: list[int] = []  # of each named element the named one around it, or -1
    names: list[str] = []
    opened: Counter = Counter()  # names on the stack
    held: list[str] = []
    plain: list[str] = []  # what of it is not inside a link
    state = (False, False, -1)
    heading = 0  # 2: the page's title

    def close_line() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                found.append((text, *state, len(" ".join("".join(plain).split())), heading))
            held.clear()
            plain.clear()

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    def now() -> tuple[bool, bool, int]:
        return stack[-1][1:4] if stack else (False, False, -1)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            held.append(html.unescape(page[at:start]))
            if not (stack and stack[-1][4]):
                plain.append(held[-1])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                held.append(m[0][9:].removesuffix("]]>"))
                plain.append(held[-1])
            continue
        if m[1] or m[4]:  # an end tag
            if name == "p" or opened[name]:
                if name in BLOCKS:
                    close_line()
                    heading = 0
                while opened[name] and pop() != name:
                    pass
                if now() != state:
                    close_line()
                    state = now()
            continue
        if name in RAW:
            if name != "svg" or not (m[3] or m[6] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
                if name == "head" and not end:
                    end = re.compile(r"(?=<body[\s>])", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "title":  # outside a head
            end = ENDS[name].search(page, at)
            at = end.start() if end else n
            continue
        if name in P_ENDS and opened["p"]:
            while pop() != "p":
                pass
        elif name in ("li", "dd", "dt", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            pop()
        if name in BLOCKS:
            close_line()
            heading = 2 if name == "h1" else int(name in HEADINGS)
        elif name == "br":
            held.append(" ")
        if name in VOID:
            continue
        furniture, main, named = _marks(name, m[3] or m[6] or "")
        if name == "header" and now()[1]:
            furniture = False
        inner = (furniture or now()[0], main or now()[1], now()[2])
        if named:
            around.append(inner[2])
            names.append(named)
            inner = (*inner[:2], len(around) - 1)
        if inner != state:
            close_line()
        opened[name] += 1
        stack.append((name, *inner, name == "a" or bool(stack and stack[-1][4])))
        state = inner
        if name == "xmp":  # its content is text as it stands
            end = ENDS[name].search(page, at)
            held.append(page[at:end.start() if end else n])
            plain.append(held[-1])
            at = end.start() if end else n
    close_line()
    gone = _by_names(found, around, names)
    return [(text, furniture or (at >= 0 and gone[at]), inside, plain, head) for text, furniture, inside, at, plain, head in found]


def weights(found: list[tuple[str, bool, bool, int, int]]) -> list[int]:
    """Of lines that are no furniture, in quarters of a code point."""
    if any(inside for _, _, inside, _, _ in found):
        return [4 * LINE if inside else 0 for _, _, inside, _, _ in found]
    return [0 if LEGAL.search(text[-200:] if n > LINE else text) and n <= 2 * LINE else min(n, LINE) * (4 if head or n >= LINE or SENTENCE.search(text) else 1) for text, _, _, n, head in found]


def surge_and_dive(own: list[int]) -> tuple[int, int]:
    """The first and the last line of the main text; weights are not all zero."""
    sums = [sum(own[i:i + WINDOW]) for i in range(len(own))]
    least = min(SURGE * max(sums), 4 * CUT)
    first = next(i for i, s in enumerate(sums) if s >= least)
    while not own[first]:
        first += 1
    last = max(i for i in range(len(own)) if sum(own[max(0, i - WINDOW + 1):i + 1]) >= least)
    while not own[last]:
        last -= 1
    while first and any(own[max(0, first - WINDOW):first]):
        first -= 1
    while last + 1 < len(own) and any(own[last + 1:last + 1 + WINDOW]):
        last += 1
    while not own[first]:
        first += 1
    while not own[last]:
        last -= 1
    return first, last


def main_text(page: str | None) -> str:
    found = [line for line in lines(page or "") if not line[1]]
    own = weights(found)
    if not any(own):
        return ""
    first, last = surge_and_dive(own)
    marked = any(inside for _, _, inside, _, _ in found)
    titles = [i for i in range(first, last + 1) if found[i][4] == 2 and own[i]]
    if not marked and len(titles) == 1 and sum(own[first:titles[0]]) < sum(own[titles[0]:last + 1]):
        first = titles[0]  # the text begins with the page's one title
    return "\n".join(text for text, _, inside, _, _ in found[first:last + 1] if inside or not marked)


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
