"""Main text of web pages by tag-path ratios.

A page is read once into text blocks, each at the end of a path of tags from the root to its
leaf. Per path, the length of text outside links and the number of punctuation marks are
summed and divided by the number of blocks: articles repeat one path with long, punctuated
blocks, menus repeat one with short bare ones. The two ratios are smoothed along the page's
blocks (a Gaussian over neighbours), fused by their product and thresholded; paths over the
threshold are content paths. The content's root is the innermost element that holds nearly
all the text of these paths, widened to the article or main element around it and to a
heading of the first rank before it. All text inside the root is kept, so headings, short
paragraphs and linked ones stay, except for elements that can be no part of an article:
those that HTML defines so (menus, asides, forms and the like) and those whose whole class,
id or role names boilerplate (``_NAMED``; never for an element that holds an
article or main element or nearly all text), and lists of nothing but links that stand before
or after all content blocks.

Defined results: NULL or empty html, or html without text, gives an empty text;
unclosed and stray tags are taken as browsers do in the plain cases; tags cut off at the
end of a page are dropped; pages of any depth and length are read whole, in linear time;
other columns are ignored, whatever their names; repeated rows give repeated rows; an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>|<[a-zA-Z][^>]*(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/]|$))""", re.I)
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？]")

#: HTML's own sets of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: The end tags of these, in any case of A-Z and in no other letters (a dotted capital I is no I).
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary"
    " table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never the article's.
DROP = set(
    "script style noscript template head title nav aside footer form button select option textarea input iframe svg"
    " object canvas audio video dialog menu noembed noframes xmp search".split()
)
ROLES = set("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar".split())
#: Whole names of classes and ids of boilerplate: a family, with a place before it and a kind after it at most.
_PLACE = "site|page|main|global|top|bottom|left|right|side|sub|primary|secondary|user|reader|post|article|entry|email|google|social|mobile"
_KIND = (
    "area|list|section|sections|box|block|bar|banner|slot|container|wrapper|wrap|widget|widgets|form|item|items|link|links|button|buttons|icons|post|posts"
    "|article|articles|stories|notice|consent|message|popup|modal|overlay|unit|inner|body|content|text|signup|thread|left|right|top|bottom|primary|secondary|[0-9]+"
)
_FAMILY = (
    "ads?|adverts?|advertisements?|advertising|sponsor|sponsors|sponsored|promo|promos|promotion|banner|navs?|navbar|navigation|menu|breadcrumbs?"
    "|side-?bar|rail|footer|masthead|toolbar|topbar|cookies?|cookie-consent|cookie-notice|gdpr|consent|notices?|alerts?|popup|modal|overlay|newsletter"
    "|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|widgets?|pagination|pager|copyright|searchform|search"
    "|toc|skip-link|aside"
)
_COMMENTS = "comments?|commentlist|comment-list|respond|disqus|disqus_thread|repl(?:y|ies)|discussion"
_NAMED = re.compile(rf"(?:(?:{_PLACE})[-_]?)?(?:{_FAMILY})(?:[-_]?(?:{_KIND}))?")
_HEADER = re.compile(r"(?:(?:site|page|global|top|main)[-_]?)?header")  # outside an article only
_NAMED_COMMENTS = re.compile(rf"(?:(?:{_PLACE})[-_]?)?(?:{_COMMENTS})(?:[-_]?(?:{_KIND}))?")
#: A tag that starts closes an open one of these, unless an element of the second set lies between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
SCOPE = {"html", "body", "table", "td", "th", "div", "article", "section", "main", "li", "blockquote", "aside", "nav", "header", "footer", "form", "caption"}
KEEP, NAMED, COMMENTS, OUT = 0, 1, 2, 3  # what an element says of itself


def _says(tag: str, attrs: str, inside: bool) -> int:
    """What an element's tag and attributes say; ``inside``: within an article or main element."""
    if tag in DROP or (tag == "header" and not inside):
        return OUT
    said = KEEP
    if attrs and tag not in ("html", "body", "main"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return OUT
            if name == "role":
                said = max(said, NAMED if tag != "article" and value in ROLES else KEEP)
            elif name in ("class", "id"):
                for word in value.split():
                    if _NAMED_COMMENTS.fullmatch(word):
                        said = COMMENTS
                    elif tag != "article" and (_NAMED.fullmatch(word) or not inside and _HEADER.fullmatch(word)):
                        said = max(said, NAMED)
    if said and tag not in BLOCK:  # a part of a line; an element of a page's own making may hold anything
        return KEEP if "-" in tag else OUT
    return said


class Page:
    """Elements in order of their start, and text blocks in order, each at its innermost block element.

    Element 0 stands for the page. ``last[e]`` is the last element inside e.
    """

    def __init__(self, page: str):
        self.tag, self.parent, self.path, self.says, self.last = [""], [0], [0], [KEEP], [0]
        self.text: list[str] = []
        self.leaf: list[int] = []
        self.links: list[float] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._read(page)

    def _start(self, tag: str, says: int, parent: int) -> int:
        """A new element; only block elements lengthen the path."""
        e = len(self.tag)
        above = self.path[parent]
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(self._paths.setdefault((above, tag), len(self._paths) + 1) if tag in BLOCK else above)
        self.says.append(says)
        self.last.append(e)
        return e

    def _read(self, page: str) -> None:
        stack = [0]  # open elements
        open_tags: Counter = Counter()
        parts: list[str] = []
        linked = out = inside = 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    k = len(stack) - 1
                    while k and self.tag[stack[k]] not in BLOCK:
                        k -= 1
                    self.text.append(text)
                    self.leaf.append(stack[k])
                    self.links.append(min(1.0, linked / len(text)))
                parts.clear()
            linked = 0

        def pop(k: int) -> None:
            """Close everything from place k of the stack."""
            nonlocal out, inside
            if any(self.tag[e] in BLOCK for e in stack[k:]):
                flush()
            for e in stack[k:]:
                open_tags[self.tag[e]] -= 1
                out -= self.says[e] == OUT
                inside -= self.tag[e] in ("article", "main")
                self.last[e] = len(self.tag) - 1
            del stack[k:]

        def nearest(wanted, bound) -> int:
            """Place of the innermost open element of ``wanted`` that no element of ``bound`` hides, or 0."""
            if not any(open_tags[t] for t in wanted):
                return 0
            for k in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[k]]
                if tag in wanted:
                    return k
                if tag in bound:
                    return 0
            return 0

        def text(raw: str) -> None:
            nonlocal linked
            if raw and not out:
                plain = html.unescape(raw) if "&" in raw else raw
                parts.append(plain)
                if open_tags["a"]:
                    linked += len(" ".join(plain.split()))

        at, end = 0, len(page)
        while at < end:
            m = _TOKEN.search(page, at)
            if not m:
                text(page[at:])
                break
            text(page[at : m.start()])
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                k = nearest({tag}, () if tag in BLOCK else SCOPE)
                if k:
                    pop(k)
            elif m[2]:
                tag, attrs = m[2].lower(), m[3]
                if tag == "br":
                    text(" ")
                    continue
                if tag in BLOCK:
                    k = nearest({"p"}, SCOPE)
                    if k:
                        pop(k)
                    if tag in CLOSES:
                        k = nearest(*CLOSES[tag])
                        if k:
                            pop(k)
                    flush()
                if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
                    continue
                if tag == "a":
                    k = nearest({"a"}, ())
                    if k:
                        pop(k)
                if tag in RAW:  # its content is no markup
                    close = _CLOSE[tag].search(page, at)
                    at = close.start() if close else end
                says = _says(tag, attrs, inside > 0)
                if says and tag not in BLOCK:
                    parts.append(" ")
                stack.append(self._start(tag, says, stack[-1]))
                open_tags[tag] += 1
                out += says == OUT
                inside += tag in ("article", "main")
        flush()
        pop(1)
        self.last[0] = len(self.tag) - 1

    def holds(self, e: int, leaf: int) -> bool:
        return e <= leaf <= self.last[e]


def _smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    kernel = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-2, 3)]
    out = []
    for i in range(len(values)):
        pairs = [(values[i + d], w) for d, w in zip(range(-2, 3), kernel, strict=True) if 0 <= i + d < len(values)]
        out.append(sum(v * w for v, w in pairs) / sum(w for _, w in pairs))
    return out


def content_paths(page: Page, among: list[int]) -> set[int]:
    """Paths of the given blocks whose smoothed, fused ratio of text and punctuation is over the threshold."""
    length, marks, number = defaultdict(float), defaultdict(float), defaultdict(int)
    paths = [page.path[page.leaf[i]] for i in among]
    for i, p in zip(among, paths, strict=True):
        length[p] += len(page.text[i]) * (1 - page.links[i])
        marks[p] += len(_PUNCT.findall(page.text[i])) * (1 - page.links[i])
        number[p] += 1
    by_length = _smooth([length[p] / number[p] for p in paths])
    by_marks = _smooth([marks[p] / number[p] for p in paths])
    fused: dict[int, list[float]] = defaultdict(list)
    for p, x, y in zip(paths, by_length, by_marks, strict=True):
        fused[p].append(math.sqrt(x * (y + 0.1)))
    score = {p: sum(v) / len(v) * min(1.0, length[p]) for p, v in fused.items()}
    if not score:
        return set()
    mean = sum(score.values()) / len(score)
    spread = math.sqrt(sum((v - mean) ** 2 for v in score.values()) / len(score))
    threshold = min(spread, max(score.values())) if spread else 0.0
    return {p for p, v in score.items() if v >= threshold}


SHARE = 0.9  # of the text on content paths that the content's root must hold
MOST = 0.8  # of the text outside links, over which an element is no boilerplate, whatever its name
LITTLE = 40  # characters outside links beside comments, under which these are the page


def _sums(page: Page, weight: dict[int, float]) -> list[float]:
    """For each element, the weight of all leaves inside it."""
    total = [0.0] * len(page.tag)
    for leaf, w in weight.items():
        total[leaf] += w
    for e in range(len(total) - 1, 0, -1):
        total[page.parent[e]] += total[e]
    return total


def _weights(page: Page, among: list[int], paths: set[int]) -> dict[int, float]:
    weight: dict[int, float] = defaultdict(float)
    for i in among:
        if page.path[page.leaf[i]] in paths:
            weight[page.leaf[i]] += len(page.text[i]) * (1 - page.links[i])
    return weight


def _dropped(page: Page) -> list[bool]:
    """For each element, whether it or one around it is boilerplate by name."""
    gone = [False] * len(page.tag)
    if NAMED not in page.says and COMMENTS not in page.says:
        return gone
    weight: dict[int, float] = defaultdict(float)
    for i, leaf in enumerate(page.leaf):
        weight[leaf] += len(page.text[i]) * (1 - page.links[i])
    total = _sums(page, weight)
    around = [False] * len(page.tag)  # holds an article or main element that is no comment
    for e in range(len(page.tag) - 1, 0, -1):
        around[page.parent[e]] |= around[e] or (page.tag[e] in ("article", "main") and page.says[e] != COMMENTS)
    for e in range(1, len(page.tag)):
        if page.says[e] == NAMED:
            gone[e] = not around[e] and total[e] <= MOST * total[0]
        elif page.says[e] == COMMENTS:
            gone[e] = total[0] - total[e] >= LITTLE
        gone[e] |= gone[page.parent[e]]
    return gone


def _root(page: Page, left: list[int], paths: set[int]) -> int:
    """The innermost element that holds nearly all content, widened to its article and its title."""
    total = _sums(page, _weights(page, left, paths))
    root, e = 0, 0
    kids: dict[int, list[int]] = defaultdict(list)
    for k in range(1, len(page.tag)):
        kids[page.parent[k]].append(k)
    while total[0] > 0:
        e = next((k for k in kids[e] if total[k] >= SHARE * total[0]), 0)
        if not e:
            break
        root = e
    leaves = {page.leaf[i] for i in left}
    if root in leaves and page.tag[root] not in ("body", "article", "main", "section", "div"):
        root = page.parent[root]  # one paragraph: what stands beside it belongs to it
    e = root
    while e and page.tag[e] not in ("article", "main"):
        e = page.parent[e]
    root = e or root
    titles = [i for i in left if page.tag[page.leaf[i]] == "h1" and page.leaf[i] < root]
    if titles and not any(page.tag[page.leaf[i]] == "h1" and page.holds(root, page.leaf[i]) for i in left):
        e = root
        while not page.holds(e, page.leaf[titles[-1]]):
            e = page.parent[e]
        if page.tag[e] not in ("", "html", "body"):
            root = e
    return root


def main_text(page: str | None) -> str:
    """The article's text of a page: one line per block."""
    if not page:
        return ""
    page = Page(page)
    gone = _dropped(page)
    left = [i for i in range(len(page.text)) if not gone[page.leaf[i]]]
    paths = content_paths(page, left)
    root = _root(page, left, paths)
    inside = [i for i in left if page.holds(root, page.leaf[i])]
    title = [i for i in left if page.tag[page.leaf[i]] == "h1" and page.leaf[i] < root]
    if title and not any(page.tag[page.leaf[i]] == "h1" for i in inside):
        inside = [title[-1], *inside]
    content = [i for i in inside if page.path[page.leaf[i]] in paths and page.links[i] < 1]
    menus = _menus(page, [i for i in inside if content and not content[0] <= i <= content[-1]])
    return "\n".join(page.text[i] for i in inside if i not in menus)


def _menus(page: Page, beside: list[int]) -> set[int]:
    """Of the blocks beside the content, those of lists that are nothing but links."""
    lists: dict[int, list[int]] = defaultdict(list)
    for i in beside:
        e = page.leaf[i]
        while e and page.tag[e] not in ("ul", "ol"):
            e = page.parent[e]
        if e:
            lists[e].append(i)
    return {i for blocks in lists.values() if len(blocks) > 1 and all(page.links[k] > 0.9 for k in blocks) for i in blocks}


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns plus text and n_chars (code points), one row per page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.column(0)]
            rest = [batch.column(i + 1) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*[f"k{i}" for i in range(len(keep))], "text", "n_chars"],
            )

    slim = pages.select(F.col(html_col).cast("string").alias("h"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = ", ".join(f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = slim.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
