"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser sends events; a page becomes lines, one for each block element, with the characters outside
links and the tags of each. The ratio of characters to tags of each line, as a logarithm so that one long block can't lift the
threshold over the others, is smoothed by a Gaussian; lines above the standard deviation of the smoothed ratios, and above 0.8
of their mean, form clusters. The content region is the innermost container that holds more than half of the clusters' weight,
with the whole article or main element around it if there is one, and the headings right before it; where no container is
narrower than the page, it runs from the first to the last line of the clusters, without closing copyright lines. All lines of
the region that have text are blocks of the result, however short, with two exceptions. Outside article and main, runs of three
lines or more that are links only are no blocks. And sections inside the region (elements that only divide) are no blocks

- if no line of theirs is in a cluster, and links or tags make up most of them (share bars, related links, adverts), or
- if they hold two or more sections of one kind, each with a byline (a linked or timed line of few characters, no
  heading) and a text: threads of reader comments.

Subtrees that are no content by their element, role or class (fixed lists below) give tags but no characters, as ratios alone
can't tell a long notice inside an article from the article. Of a class name of several words the unwanted word counts
(``article-comments``), unless it says that something has or lacks it, or the element has another name that is all content.

White space inside a block is one space (a line break element too); blocks are joined by two line feeds. Malformed markup is
read as browsers do, marked sections as comments. Null, empty and textless pages give the empty text. Repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template head title iframe svg canvas object audio video map".split())
DROPPED = set("nav footer aside form button select textarea option dialog menu".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
LEAVES = HEADINGS | set("p pre li dt dd hr caption figcaption legend summary address".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
CLOSES |= {x: {"p"} for x in BLOCKS - set(CLOSES) - {"html", "body", "caption", "tbody", "thead", "tfoot"}}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOISE = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments disqus replies respond share sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar widget masthead hidden".split()
)
CONTENT = set("content article post main entry story body text page wrapper container layout hentry".split())
SCOPES = {"article", "main"}
DIVIDERS = set("div section ul ol".split())
UNCLOSED = re.compile(r"<[!?].*", re.S)
SAYS_SO = {"has", "no", "with", "without"}
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved\b)", re.I)
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Lines of a page, and the containers they lie in.

    A line is (text, characters outside links, tags, container, whether it is a heading, whether it has a time); a container is
    (element, parent)."""

    def __init__(self, veto: bool = True):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, bool]] = []
        self.containers: list[tuple[str, int]] = [("", 0)]
        self.parts: list[str] = []
        self.tags, self.plain, self.veto = 0, 0, veto
        self.open: list[tuple[str, bool, int]] = []  # element, whether it is dropped, its container
        self.heading = self.timed = False

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text or self.tags:
            self.lines.append((text, self.plain, self.tags, self.open[-1][2] if self.open else 0, self.heading, self.timed))
        self.parts, self.tags, self.plain, self.heading, self.timed = [], 0, 0, False, False

    def noise(self, tag: str, attrs: list[tuple[str, str | None]], container: int) -> bool:
        if tag in UNSEEN:
            return True
        if not self.veto:
            return False
        if tag in DROPPED or tag == "header" and not self.inside(container, SCOPES):
            return True
        if tag in SCOPES or tag in ("html", "body"):
            return False
        given = {k: (v or "").lower() for k, v in attrs}
        if "hidden" in given or given.get("aria-hidden") == "true" or given.get("role") in ROLES or re.search(r"display\s*:\s*none", given.get("style", "")):
            return True
        names = [set(re.split(r"[^a-z0-9]+", x)) - {""} for x in (given.get("class", "") + " " + given.get("id", "")).split()]
        return any(x & NOISE and not x & SAYS_SO for x in names) and not any(x and x <= CONTENT for x in names)

    def above(self, container: int) -> list[int]:
        """The container and all that it lies in, innermost first."""
        out = [container]
        while container:
            container = self.containers[container][1]
            out.append(container)
        return out

    def inside(self, container: int, names: set[str]) -> bool:
        return any(self.containers[c][0] in names for c in self.above(container))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            self.heading = tag in HEADINGS
        self.tags += 1
        self.timed |= tag == "time"
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        while self.open and self.open[-1][0] in CLOSES.get(tag, ()):
            self.open.pop()
        dropped, container = (self.open[-1][1], self.open[-1][2]) if self.open else (False, 0)
        dropped = dropped or self.noise(tag, attrs, container)
        if tag in BLOCKS and tag not in LEAVES:
            self.containers.append((tag, container))
            container = len(self.containers) - 1
        self.open.append((tag, dropped, container))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.open and self.open[-1][1]:
            return
        self.parts.append(data)
        if not any(x[0] == "a" for x in self.open[-4:]):
            self.plain += len(data.strip())

    def parse_html_declaration(self, i):
        # a marked section is a comment to browsers; the base class refuses those it does not know
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return np.convolve(ratios, kernel)[reach:-reach] / weight


def main_region(page: Lines, curve: np.ndarray, chosen: np.ndarray) -> list[int]:
    """The lines of the region that the chosen ones (by the weight of their smoothed ratio) select."""
    lines, n = page.lines, len(page.containers)
    if not curve[chosen].any():  # all weigh nothing: the page is its own region
        return [i for i in range(len(lines)) if i >= chosen[0]]
    weight, end = np.zeros(n), np.arange(1, n + 1)  # containers are numbered in page order: what one holds follows it
    np.add.at(weight, [lines[i][3] for i in chosen], curve[chosen])
    for c in range(n - 1, 0, -1):
        parent = page.containers[c][1]
        weight[parent] += weight[c]
        end[parent] = max(end[parent], end[c])
    best = max(c for c in range(n) if weight[c] > weight[0] / 2)  # those with over half lie in one another
    chain = page.above(best)
    for name in ("article", "main"):
        found = [c for c in chain if page.containers[c][0] == name]
        if found:
            best = found[-1]
            break
    own = [i for i, line in enumerate(lines) if best <= line[3] < end[best]]
    if page.containers[best][0] in ("", "html", "body"):
        own = list(range(chosen[0], chosen[-1] + 1))
        while len(own) > 1 and (not lines[own[-1]][0] or COPYRIGHT.match(lines[own[-1]][0])):
            own.pop()
    out = other_sections(page, best, end, chosen)
    own = [i for i in own if lines[i][3] not in out] or own
    first = own[0]
    while first and (lines[first - 1][4] or not lines[first - 1][0]):  # headings right before the region
        first -= 1
    return [*range(first, own[0]), *own]


def other_sections(page: Lines, region: int, end: np.ndarray, chosen: np.ndarray) -> set[int]:
    """Containers inside a region that hold links, adverts or reader comments, by their ratios and their structure. Sums over a
    container's lines, which follow one another, are differences of running sums, so nesting costs nothing."""
    lines = [x for x in page.lines if x[0]]
    numbers = [i for i, x in enumerate(page.lines) if x[0]]
    in_cluster = np.isin(numbers, chosen)
    sums = {name: np.concatenate([[0], np.cumsum(v)]) for name, v in (("text", [len(x[0]) for x in lines]), ("plain", [x[1] for x in lines]), ("heads", [x[4] for x in lines]), ("chosen", in_cluster))}
    tags = np.concatenate([[0], np.cumsum([x[2] for x in page.lines])])
    low, high = np.full(len(page.containers), len(lines)), np.zeros(len(page.containers), int)
    for k, x in enumerate(lines):
        low[x[3]], high[x[3]] = min(low[x[3]], k), k + 1
    for c in range(len(page.containers) - 1, region, -1):
        parent = page.containers[c][1]
        low[parent], high[parent] = min(low[parent], low[c]), max(high[parent], high[c])
    total = lambda name, c: sums[name][high[c]] - sums[name][low[c]]
    below: dict[int, list[int]] = {}
    kept: set[int] = {region}  # no table, figure or quotation around them
    inner = [c for c in range(region + 1, end[region]) if low[c] < high[c]]
    for c in inner:
        parent = page.containers[c][1]
        below.setdefault(parent, []).append(c)
        if parent in kept and page.containers[c][0] not in ("table", "figure", "blockquote"):
            kept.add(c)

    def comment(c: int) -> bool:
        """A byline and a text."""
        head, rest = lines[low[c]], lines[low[c] + 1 : high[c]]
        return bool(rest) and not total("heads", c) and len(head[0]) <= 80 and (head[5] or head[1] * 2 < len(head[0])) and any(x[1] * 2 > len(x[0]) for x in rest)

    found = []
    for c in inner:
        if c not in kept or page.containers[c][0] not in DIVIDERS:
            continue
        parts, text = below.get(c, []), total("text", c)
        n_tags = tags[numbers[high[c] - 1] + 1] - tags[numbers[low[c]]]
        links = page.containers[c][0] in ("div", "section") and not total("chosen", c) and (total("plain", c) * 2 < text or n_tags * 4 > text)
        thread = len(parts) > 1 and len({page.containers[x][0] for x in parts}) == 1 and all(map(comment, parts))
        if links or thread:
            found.append(c)
    out: set[int] = set()
    for c in found:
        if c not in out:
            out |= set(range(c, end[c]))
    left = np.concatenate([[0], np.cumsum([x[3] not in out for x in lines])])
    heads = np.concatenate([[0], np.cumsum([x[3] not in out and x[4] for x in lines])])
    for c in inner:  # headings of threads
        n = left[high[c]] - left[low[c]]
        if c not in out and c in kept and n < high[c] - low[c] and page.containers[c][0] in DIVIDERS and heads[high[c]] - heads[low[c]] == n:
            out |= set(range(c, end[c]))
    return out


def main_text(html: str, sigma: float = 1.0, factor: float = 1.0, veto: bool = True) -> str:
    """The main text of one page; ``veto`` False does without the lists of elements, roles and classes that are no content."""
    page = Lines(veto)
    # what follows the last closed tag is text: the parser would look for the end of each tag in it anew
    at = html.rfind(">") + 1
    page.feed(html[:at])
    page.close()
    page.handle_data(unescape(UNCLOSED.sub("", html[at:])))
    page.flush()
    lines = page.lines
    ratios = np.array([plain / max(1, tags) for _, plain, tags, *_ in lines])
    if not any(line[0] for line in lines):
        return ""
    curve = smooth(np.log1p(ratios), sigma)
    least = factor * max(curve.std(), 0.8 * curve.mean())
    chosen = np.flatnonzero((curve > least) & (ratios > 0))
    if not len(chosen):
        chosen = np.flatnonzero(ratios == ratios.max())
    texts = [i for i in main_region(page, curve, chosen) if lines[i][0]]
    linked = np.array([lines[i][1] * 10 < len(lines[i][0]) for i in texts], np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], linked, [0]])))
    runs = [range(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= 3]
    scoped = [False] * len(page.containers)
    for c, (name, parent) in enumerate(page.containers):
        scoped[c] = name in SCOPES or scoped[parent]
    menus = {k for run in runs if not any(scoped[lines[texts[k]][3]] for k in run) for k in run}
    return "\n\n".join(lines[i][0] for k, i in enumerate(texts) if k not in menus)


def extract_batches(batches):
    for batch in batches:
        html = batch.column(2).to_pylist()
        for i in range(0, len(html), 200):
            texts = [main_text(x) for x in html[i : i + 200]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), batch.column(1).slice(i, len(texts)), pa.array(texts), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")
