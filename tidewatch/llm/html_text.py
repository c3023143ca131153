"""Main text of web pages by line-block distribution.

The markup is stripped to lines, one for each block element's text. A line's weight is its text's
length; lines in menus, headers, footers and other parts that are named as such weigh nothing, and
text in links counts for none. Weights are summed over a sliding window of lines; a surge is where
the sum rises over a threshold, a dive where it falls to nothing. The text between surges and
their dives is the main text, as far as it is heavy for the page. Where a page marks articles,
their lines weigh more and no window spans a mark's bounds. The distribution says which articles
and which parts outside stay; of an article that stays, every line does, however short.

Pages are read once from front to back: tags are found by their first character, attributes are
scanned forwards only, and open elements are kept by name, so that odd pages cost no more than others.
"""

from __future__ import annotations

import html
import re
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_map, table

#: Lines in a window; the sum that a surge needs; times that a marked line's text counts; a part with
#: less than one HEAVY-th of the heaviest one's weight is dropped.
WINDOW, SURGE, MARKED, HEAVY = 3, 60, 4, 5
# HTML's elements by what they mean for the lines.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "select", "annotation", "annotation-xml"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Parts that never belong to the main text, by element and by words in class, id or role.
PARTS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head"}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adbox|sponsor(?:ed)?|banner|promo(?:tion)?|cookies?|consent|notices?|alert|popup|modal|overlay|"
    r"nav(?:bar|igation)?|menu|breadcrumbs?|side-?bar|aside|foot(?:er)?|"
    r"comments?(?:-?list)?|disqus|respon(?:d|ses)|replies|share|sharing|social|related|recommend(?:ed|ations)?|newsletter|subscri(?:be|ption)|"
    r"login|signup|search|widget|contentinfo|complementary|skip(?:-?link)?|pagination|pager|tags|copyright|legal|disclaimer|gdpr|paywall)(?:$|[\s_-])",
    re.I,
)
HEADERS = re.compile(r"(?:^|[\s_-])(?:masthead|top-?bar|header)(?:$|[\s_-])", re.I)  # outside an article
#: Within an article a class, id or role is a part's name only if all its words are names of parts or of what holds them.
HOLDERS = {"area", "articles", "bar", "block", "box", "buttons", "container", "form", "inner", "item", "items", "links", "list", "posts", "section", "slot", "stories", "unit", "wrap", "wrapper"}
HUMP = re.compile("([a-z0-9])([A-Z])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: One attribute: name and value; what a missing end quote leaves is read as a name.
ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)?+""")
#: What an article element is called if it is none of the page's own.
NOT_THE_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|respon(?:se|ses|d)|ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|related|recommend(?:ed|ations)?|teaser)(?:$|[\s_-])", re.I)
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
MAIN = re.compile(r"(?:^|\s)(?:main|main-content|content-main|post-content|entry-content|article-body|article)(?:$|\s)", re.I)
#: Elements that a new one of the same kind ends, unless one of the others stands between.
ENDS = {"p": ({"p"}, None), "li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, None)}
CLOSES_P = BLOCKS - {"br", "body", "html", "head", "button"}


class Tags:
    """The tags of a page from front to back, each with where it starts and ends.

    A tag ends at the first ``>`` outside of its quoted values. If no ``>`` follows at all, it ends
    before the next ``<``. If the quotes of a tag never close, quotes mean nothing from there on."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def attributes(self, at: int, out: dict[str, str]) -> int:
        """Puts the attributes from ``at`` on into ``out`` (names in lower case; of repeated ones the
        first, as browsers do); where the ``>`` stands, or -1."""
        page, end = self.page, len(self.page)
        if not self.quotes:
            end = page.find(">", at)
            if end < 0:
                return -1
        while at < end:
            m = ATTRIBUTE.match(page, at, end)
            at = m.end()
            if m[1]:
                out.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
            elif at < end:  # it stands at a >
                return at
        return -1 if self.quotes else end

    def next(self, at: int) -> tuple[int, int, str, bool, dict[str, str], bool] | None:
        """Start, end, name ("" for comments and declarations), end tag, attributes, and whether
        ``/>`` ends it, of the first tag from ``at`` on."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            sign = page[start + 1 : start + 2]
            if sign in ("!", "?"):
                long = page.startswith("<!--", start)
                end = page.find("-->" if long else ">", start + (4 if long else 2))
                return start, len(page) if end < 0 else end + (3 if long else 1), "", False, {}, False
            closing = sign == "/"
            m = NAME.match(page, start + 1 + closing)
            if not m:
                if not sign or closing and start + 2 == len(page):
                    return start, len(page), "", False, {}, False
                at = start + 1
                continue
            found: dict[str, str] = {}
            name = m[0].lower()
            if start > self.last:
                end = page.find("<", start + 1)
                return start, len(page) if end < 0 else end, "", False, found, False
            end = m.end() if page.startswith(">", m.end()) else self.attributes(m.end(), found)
            if end < 0:
                self.quotes, found = False, {}
                end = self.attributes(m.end(), found)
            if end < 0:
                return start, len(page), "", False, found, False
            return start, end + 1, name, closing, found, page[end - 1] == "/"
        return None


class Open:
    """The open elements of a page, also by name, and the blocks among them."""

    def __init__(self) -> None:
        self.stack: list[tuple] = [("", False, 0, 0, False)]  # name, in a part, in main (1) or an article (2), which one, in a link
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def at(self, *names: str) -> int:
        """Where the innermost of the named ones stands (0: none is open)."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def push(self, *entry) -> None:
        self.places.setdefault(entry[0], []).append(len(self.stack))
        if entry[0] in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(entry)

    def cut(self, to: int) -> None:
        """Closes the element at ``to`` and all within."""
        while len(self.stack) > to:
            name = self.stack.pop()[0]
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()

    def end(self, name: str) -> None:
        """An end tag: closes the innermost of its name; an inline one does not reach out of a block."""
        k = self.at(name)
        if k and (name in BLOCKS or k > self.blocks[-1]):
            self.cut(k)

    def begin(self, name: str) -> None:
        """Closes what a start tag ends by itself."""
        if name in CLOSES_P and self.at("p") == self.blocks[-1] > 0:
            self.cut(self.blocks[-1])
        if name in ENDS:
            kinds, walls = ENDS[name]
            k = self.at(*kinds)
            if k and (k == len(self.stack) - 1 if walls is None else k > self.at(*walls)):
                self.cut(k)


def named(marks: str) -> bool:
    """Whether one of the words of ``marks`` (class, id and role) as a whole names a part."""
    for token in marks.split():
        if NAMED.fullmatch(token):
            return True
        words = re.split("[_-]+", token.strip("_-").lower())
        if len(words) > 1 and all(w in HOLDERS or NAMED.fullmatch(w) for w in words) and not all(w in HOLDERS for w in words):
            return True
    return False


def hidden(at: dict[str, str]) -> bool:
    return at.get("hidden", "false").lower() != "false" or at.get("aria-hidden", "").lower() == "true" or bool(UNSEEN.search(at.get("style", "")))


class Line:
    __slots__ = ("boiler", "links", "marked", "text", "which")

    def __init__(self, text: str, links: int, boiler: bool, marked: int, which: int) -> None:
        self.text, self.links, self.boiler, self.marked, self.which = text, links, boiler, marked, which


def lines_of(page: str) -> list[Line]:
    """The page's lines in order. Raw elements have no text; unclosed elements end with what
    they stand in."""
    out: list[Line] = []
    tags, elements, marks_seen = Tags(page), Open(), 0
    run: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(Line(text, linked, *elements.stack[-1][1:4]))
        run.clear()
        linked = 0

    def text(until: int) -> None:
        nonlocal linked
        if until > at:
            run.append(page[at:until])
            linked += (until - at) * elements.stack[-1][4]

    while tag := tags.next(at):
        start, end, name, closing, at_of, empty = tag
        text(start)
        at = end
        if not name:
            continue
        if name in RAW and not closing:
            if not empty:
                last = re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = last.end() if last else len(page)
            if name == "title":
                flush()
            continue
        if name in BLOCKS:
            flush()
        if name in VOID:
            if name in CLOSES_P:
                elements.begin(name)
            continue
        if closing:
            elements.end(name)
            continue
        elements.begin(name)
        if empty and name not in BLOCKS:
            continue
        _, part, article, which, link = elements.stack[-1]
        marks = HUMP.sub(r"\1-\2", " ".join(at_of.get(k, "") for k in ("class", "id", "role"))).strip()
        own = name in ("article", "main")
        part = part or name in PARTS or name == "header" and not article or hidden(at_of)
        if name not in ("html", "body") and marks:
            part = part or (bool(NOT_THE_ARTICLE.search(marks)) if own else named(marks) if article else bool(NAMED.search(marks) or HEADERS.search(marks)))
        if not part:
            level = 2 if name == "article" or "articleBody" in at_of.get("itemprop", "") else 1 if name == "main" or MAIN.search(marks) else 0
            if level > article:
                marks_seen += 1
                article, which = level, marks_seen
        elements.push(name, part, article, which, link or name == "a")
    text(len(page))
    flush()
    return out


def weights(lines: list[Line]) -> tuple[list[int], int]:
    """What each line adds to the distribution; how strongly the page marks articles (0: not)."""
    level = max((x.marked for x in lines if not x.boiler), default=0)

    def weight(x: Line) -> int:
        if x.boiler:
            return 0
        if level and x.marked == level:
            return MARKED * len(x.text)
        return max(0, len(x.text) - 2 * min(x.links, len(x.text)))

    return [weight(x) for x in lines], level


def parts(weight: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """The first lines of all parts between a surge and a dive and the lines after them.

    The sum at a line is over it and the ``window - 1`` after it. A part starts at the first
    line with a weight whose sum reaches ``surge`` and ends where the sum has fallen to 0. If no
    sum reaches ``surge``, what lies from the first to the last weight is the part."""
    n, out, start = len(weight), [], None
    last = max((i + 1 for i in range(n) if weight[i]), default=0)
    total = sum(weight[:window])
    for i in range(n):
        if start is None and total >= surge and weight[i]:
            start = i
        elif start is not None and total == 0:
            out.append((start, i))
            start = None
        total += (weight[i + window] if i + window < n else 0) - weight[i]
    if start is not None:
        out.append((start, last))
    some = [i for i in range(n) if weight[i]]
    return out or ([(some[0], last)] if some else [])


def main_text(page: str | None, marks: bool = True) -> str:
    """The lines of the parts that are heavy for the page, without those that are boilerplate or
    nothing but a link.

    A distribution of its own is taken of each run of lines of one marked article or of none.
    What it finds in an article counts as one part, however many advertisements cut it, and if
    that is heavy the whole article stays; outside, each part counts alone. Without ``marks``
    articles are not told from their surroundings."""
    lines = lines_of(page or "")
    if not marks:
        for x in lines:
            x.marked = 0
    weight, level = weights(lines)
    inside = [x.which if level and x.marked == level else 0 for x in lines]
    edges = [0, *(i for i in range(1, len(lines)) if inside[i] != inside[i - 1]), len(lines)]
    runs = list(pairwise(edges)) if lines else []
    found = [[(a + p, a + q) for p, q in parts(weight[a:b])] for a, b in runs]
    articles: dict[int, int] = {}
    for (a, _), spans in zip(runs, found, strict=True):
        if inside[a]:
            articles[inside[a]] = articles.get(inside[a], 0) + sum(sum(weight[slice(*p)]) for p in spans)
    heaviest = max([*articles.values(), *(sum(weight[slice(*p)]) for (a, _), spans in zip(runs, found, strict=True) if not inside[a] for p in spans)], default=0)
    kept: list[str] = []
    for (a, b), spans in zip(runs, found, strict=True):
        if inside[a]:
            if HEAVY * articles[inside[a]] >= heaviest:
                kept += [x.text for x in lines[a:b] if not x.boiler]
            continue
        for p, q in spans:
            if HEAVY * sum(weight[p:q]) >= heaviest:
                kept += [lines[i].text for i in range(p, q) if not lines[i].boiler and (weight[i] or lines[i].links < len(lines[i].text))]
    return " ".join(kept)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    Nulls: a null html is an empty page with empty text; null ids and urls are carried along.
    Repeated rows are extracted one by one; an empty table gives an empty result; pages of any
    length are read whole; other columns are not read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), work, SCHEMA)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op6_html_extraction": op6_html_extraction}
ORACLE_SQL: dict = {}
