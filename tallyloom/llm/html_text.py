"""Main text of web pages by the distribution of text over lines.

Markup is stripped: every block element ends a line, inline elements and line breaks are white space,
and scripts, styles, forms and other elements that never hold article text leave an empty line.
The weight of a line is its text without links. Over windows of WINDOW lines the weights are summed:
where the sum reaches SURGE the text surges, where it falls back to the weight of an empty window it dives,
and the lines between are kept, on every page. If nothing surges, the lines with weight are kept.

Names only change weights, and only while other lines have more to say:
* Lines with text inside an article or main element weigh SURGE / 2 more, unless the lines outside have more text than
  those inside: then the element is a teaser and adds nothing.
* Lines inside an element one of whose classes, ids or roles as a whole means menu, header, footer, sidebar, notice,
  advert or reader comments weigh nothing, unless such lines have four fifths of the text and no article or main element
  has text besides: then the name is that of a wrapper. A name that only holds such a word (`has-sidebar`, `entry-header`) means nothing.

Null or empty html, and pages without such a line, give an empty text. Character references are decoded once,
also those without a semicolon that HTML knows. White space inside a block becomes one space. Unclosed
elements end where the page or the element around them ends. Any length is read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import whole

WINDOW, SURGE = 3, 60
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|object|select)\b(?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>|<[!?][^>]*+>",
    re.S | re.I,
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("nav footer aside form head menu button dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a paragraph left open.
CONTENT = frozenset(("article", "main"))
MARK = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notification alert popup modal newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies discussion pagination pager search toolbar contentinfo complementary".split()
)
#: Words that may stand beside those without changing what they mean.
BESIDE = frozenset("site global top bottom left right primary secondary area box wrapper wrap container list section block inner bar links item items".split())
PARTS = re.compile(r"[a-z]+")
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


def _marked(name: str, attributes: str) -> bool:
    """Whether one of the names of an element as a whole, word by word, says that it is no article text."""
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for kind, value in MARK.findall(attributes):
        plain = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
        for token in [plain] if kind.lower() == "aria-label" else plain.split():
            words = set(PARTS.findall(token))
            if words & OTHER and words <= OTHER | BESIDE:
                return True
    return False


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """Of each line: its text, how much of it is no link, whether it is inside an article or main element, and inside a marked one."""
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    plain = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements that matter, whether they are dropped and whether marked
    held: Counter[str] = Counter()  # how many of each name are on the stack
    dropped = content = marks = links = 0

    def end() -> None:
        nonlocal plain
        text = " ".join(html.unescape("".join(parts)).split())
        out.append((text, plain, content > 0, marks > 0))
        parts.clear()
        plain = 0

    def leave(i: int) -> None:
        nonlocal dropped, content, marks
        for gone, was, mark in stack[i:]:
            dropped -= was
            marks -= mark
            content -= gone in CONTENT
            held[gone] -= 1
        del stack[i:]

    def close(name: str) -> None:
        """Leave the innermost open element of this name, with all inside it."""
        if held[name]:
            leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))

    at = 0
    for m in TOKEN.finditer(page):
        if not dropped and m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if not links:
                plain += len(text.strip())
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        opens = not m[2] and name not in VOID and not m[4].endswith("/")
        mark = opens and _marked(name, m[4])
        if name not in BLOCKS and name not in NEVER and not mark:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                links = 0 if m[2] else 1
            elif not m[2] or not held[name]:
                continue
            elif stack[-1][0] == name and not stack[-1][1] and not stack[-1][2]:
                close(name)
                continue
            if name in ("br", "a"):
                continue
        if not dropped:
            end()
        links = 0
        if m[2]:
            close(name)
        elif opens:
            while stack and stack[-1][0] in CLOSED_BY.get(name, ()):
                leave(len(stack) - 1)
            drop = name in NEVER or (name == "header" and not content)
            if drop or mark or name != "p":
                stack.append((name, drop, mark))
                held[name] += 1
                dropped += drop
                marks += mark
                content += name in CONTENT
    if not dropped:
        parts.append(page[at:])
        plain += len(page[at:].strip()) if not links else 0
        end()
    return out


def main_text(page: str) -> str:
    told = lines(page)
    weigh = lambda wanted: sum(line[1] for line in told if wanted(line))
    total = weigh(lambda line: True)
    trusted = 5 * weigh(lambda line: line[3]) <= 4 * total or weigh(lambda line: line[2] and not line[3]) > 0
    inside_weight = weigh(lambda line: line[2] and not (trusted and line[3]))
    more = SURGE // 2 if 2 * inside_weight >= weigh(lambda line: not (trusted and line[3])) else 0
    weights = [0 if trusted and marked else weight + more * (inside and text != "") for text, weight, inside, marked in told]
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    keep, inside = [], False
    for i, size in enumerate(sums):
        if not inside and size >= SURGE and weights[i]:
            inside = True  # surge
        elif inside and not size:
            inside = False  # dive: nothing but empty lines or links ahead
        if inside and told[i][0] and weights[i]:
            keep.append(told[i][0])
    return "\n".join(keep or [line[0] for line, weight in zip(told, weights, strict=True) if line[0] and weight])


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(main_text)

    rows = pages.select("page_id", "url", F.pandas_udf(run, "string")(whole(F.col("html"))).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
