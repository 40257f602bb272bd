"""Main text of web pages: parser events, text-to-tag ratio, smoothing, clustering.

Standard-library parser events are read as a stream.  Block elements cut the
page into lines; a line knows its characters, its tags, its link characters
and whether it stands in boilerplate (navigation, page header or footer,
sidebar, form, advert, comments) or in the page's article.  Tags and names
propose boilerplate; what an element holds of the page's text decides.  The text-to-tag
ratios of the lines are smoothed with a Gaussian and split into two clusters;
the lines of the upper cluster make the content region, on every page.  The
lines of article elements have a bonus on their ratio, and the other lines a
malus, both as large as the articles' share of the page's own text.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rivulet.llm.common import fresh, read_table

# HTML element names, by what they mean for a page's text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template head title svg iframe object canvas audio video select button textarea input label option datalist map".split())
IN_HEAD = frozenset("title meta link style script base noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(("article", "main"))
#: Boilerplate that an element is by its tag, whatever it weighs.
FRAME = frozenset("nav footer aside menu dialog".split())
#: Words of class, id, role or label that name boilerplate; those of a title only outside articles.
_NOISE = re.compile(
    r"(?:ads?|advert\w*|adverts?|banner|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|sidebar|side|widget|footer|header|masthead|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter"
    r"|subscribe|signup|login|share|sharing|social|related|recommended|comments?|disqus|replies|respond|pagination|pager|toolbar|skip)"
)
_COMMENT = re.compile(r"comments?|disqus|replies|respond")
#: Of these, what a compound names is made of links, or it is no boilerplate.
_LINKED = re.compile(r"nav\w*|menus?|breadcrumbs?|share|sharing|social|related|recommended|pagination|pager|skip")
_TITLE = re.compile(r"(?:^|(?<=[\s_-]))(?:header|masthead|banner)(?=$|[\s_-])", re.I)
#: Words for a part of a page, whatever it holds: behind a name, they leave its meaning as it is.
_PART = frozenset(
    "area author aside bar block body bottom box button buttons card cell col column container content count desktop div element feed field form frame grid group head holder icon icons image img inner"
    " input item items label layer left line link links list logo main meta mobile module outer page panel parent part popup pane placeholder policy position post posts reply right root row section site slot"
    " small stack strip tab tabs tag tags text thread title toggle top unit user view wrap wrapper zone".split()
)
#: Tokens that say what a layout has or how it is, not what the element is.
_LAYOUT = re.compile(r"(?<!\S)(?:(?:has|have|with|without|no)[_-]\S+|\S+[_-](?:open|closed|on|off|enabled|disabled|layout))(?!\S)", re.I)
#: Why an element may be boilerplate: a name or a form, in an article a whole token or another name, comments, its tag.
LOOSE, WHOLE, DENSE, COMMENTS, HARD = range(5)
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def named(names: str) -> tuple[bool, bool, bool, bool]:
    """Whether names call an element comments, boilerplate by a whole name, by the head of a name, or by any word of one.

    The head of a compound is its last word that is no mere part of a page:
    ``share-buttons`` and ``site-footer`` are boilerplate, while in
    ``side-effects`` or ``header-files`` the word only says which effects or
    files are meant.
    """
    comments = whole = loose = any_ = False
    for name in names.lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        if not any(_NOISE.fullmatch(w) for w in words):
            continue
        any_ = True
        rest = [w for w in words if not w.isdigit()]
        while len(rest) > 1 and rest[-1] in _PART and not _NOISE.fullmatch(rest[-1]):
            rest.pop()
        head = rest[-1]
        if _NOISE.fullmatch(head):
            comments |= bool(_COMMENT.fullmatch(head))
            whole |= len(words) == 1
            loose |= len(words) == 1 or not _LINKED.fullmatch(head)
    return comments, whole, loose, any_


class _Lines(HTMLParser):
    """Collects ``(text parts, tags, link characters, whether in an article)`` of each line.

    ``named`` lists ``[reason, first line, end line]`` of the elements that may
    be boilerplate, in the order they open, and ``articles`` the line ranges of
    the articles; what they are is known when the page is read (``boilerplate``).
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[str], int, int, bool]] = []
        self.stack: list[tuple[str, bool, list[list[int]]]] = []  # open elements, whether they are silent, their ranges
        self.open: Counter[str] = Counter()  # how many elements of a tag are open
        self.parts: list[str] = []
        self.named: list[list[int]] = []
        self.articles: list[list[int]] = []
        self.tags = self.linked = self.links = self.silent = self.article = self.main = 0

    def _cut(self) -> None:
        if self.parts:
            self.lines.append((self.parts, self.tags, self.linked, self.article + self.main > 0))
            self.parts = []
        self.tags = self.linked = 0

    def _reason(self, tag: str, attrs) -> int | None:
        names = _LAYOUT.sub("", " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label")))
        inside = self.article + self.main > 0
        if tag in ARTICLE:
            # An article inside comments is a comment.
            return COMMENTS if named(names)[0] else None
        if tag in FRAME or (tag == "header" and not inside):
            return HARD
        if names and tag not in ("html", "body"):
            comments, whole, loose, any_ = named(_TITLE.sub("", names) if inside else names)
            if comments:
                return COMMENTS
            if any_:
                return (WHOLE if whole else DENSE) if self.article else LOOSE if loose else DENSE
        return LOOSE if tag in ("form", "fieldset") else None

    def _open(self, tag: str, attrs) -> None:
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v, re.I) for k, v in attrs)
        silent, ranges = tag in SILENT or hidden, []
        if not silent:
            first, reason = len(self.lines) + bool(self.parts), self._reason(tag, attrs)
            if reason is not None:
                ranges.append([reason, first, first])
                self.named.append(ranges[-1])
            if tag in ARTICLE:
                ranges.append([-1, first, first])
                self.articles.append(ranges[-1])
                self.article += tag == "article"
                self.main += tag == "main"
        self.silent += silent
        self.links += tag == "a"
        self.stack.append((tag, silent, ranges))
        self.open[tag] += 1

    def _close(self) -> str:
        tag, silent, ranges = self.stack.pop()
        self.open[tag] -= 1
        self.silent -= silent
        self.links -= tag == "a"
        for x in ranges:
            x[2] = max(x[1], len(self.lines))
        if not silent:
            self.article -= tag == "article"
            self.main -= tag == "main"
        return tag

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self._cut()
        self.tags += 1
        if self.stack and self.stack[-1][0] == "head" and tag not in IN_HEAD:
            # The head ends where the body begins, with or without its tag.
            self._close()
        if tag in VOID:
            return
        for closed in _CLOSED_BY.get(tag, ()):
            if self.stack and self.stack[-1][0] == closed:
                self._close()
        self._open(tag, attrs)

    def handle_startendtag(self, tag, attrs) -> None:
        # "<div/>" opens a div, as browsers read it.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag) -> None:
        if tag in BLOCKS:
            self._cut()
        self.tags += 1
        if self.open[tag]:
            while self._close() != tag:
                pass

    def handle_data(self, data) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._cut()
        while self.stack:
            self._close()


def boilerplate(named: list[list[int]], articles: list[list[int]], own: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Which lines are boilerplate: ``own`` and ``linked`` are the lines' characters outside and inside links.

    A name is judged by what the element holds.  One that holds the article, or
    most of the page's text with no such article beside it, frames the page
    and is no boilerplate itself.  An article counts that has a fifth of the
    text that nothing named holds.  In an article a whole token names small or
    link-dense blocks, another name only link-dense ones.
    """
    n = len(own)
    spans = np.array([x[1:] for x in articles if x[1] < x[2]], int).reshape(-1, 2)
    # Steps up and down where a named element begins and ends; what they sum to is kept until one of them changes.
    covered, commented, noise = np.zeros(n + 1, int), np.zeros(n + 1, int), np.zeros(n, bool)
    for reason, a, b in named:
        for steps in (covered, commented) if reason == COMMENTS else (covered,):
            steps[a] += a < b
            steps[b] -= a < b
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    plain, links = sums(own), sums(linked)
    comments = total = free = most = None
    for reason, a, b in named:
        if a >= b or noise[a]:
            continue
        if comments is None:
            comments = np.cumsum(commented[:n])
            total, most = sums(np.where(comments == 0, own, 0)), (0, 0, 0)
            if len(spans):
                sizes = total[spans[:, 1]] - total[spans[:, 0]]
                most = (sizes.max(), *spans[sizes.argmax()].tolist())
        if reason == COMMENTS:
            # A thread has many articles or is less than the rest; its own comments are named too.
            held, end = 0, a
            if plain[b] - plain[a] > total[n]:
                for x, y in spans[np.searchsorted(spans[:, 0], a) :].tolist():
                    if x >= b or held > 1:
                        break
                    if end <= x and y <= b and comments[x:y].min() == 1:
                        held, end = held + 1, y
            frames = held == 1
        else:
            here = total[b] - total[a]
            if reason in (WHOLE, DENSE):
                dense = links[b] - links[a] > plain[b] - plain[a]
                small = 4 * here <= total[n] or (here <= 200 and 2 * here <= total[n])
                frames = not (dense or (reason == WHOLE and small))
            else:
                if free is None:
                    free = sums(np.where((np.cumsum(covered[:n]) == 0) & (comments == 0), own, 0))
                sure = most[0] > 0 and 4 * most[0] >= free[n] - (free[most[2]] - free[most[1]])
                beside = sure and (most[2] <= a or b <= most[1]) and 4 * most[0] >= here
                frames = sure and a <= most[1] and most[2] <= b or reason == LOOSE and 2 * here > total[n] and not beside
        if frames:
            covered[a] -= 1
            covered[b] += 1
            free = None
            if reason == COMMENTS:
                commented[a] -= 1
                commented[b] += 1
                comments = None
        else:
            noise[a:b] = True
    return noise


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing, the kernel cut at three sigma and renormalised at the ends."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[reach : reach + len(values)] / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """The border between the two clusters of values (2-means from the extremes)."""
    low, high = values.min(), values.max()
    for _ in range(50):
        border = (low + high) / 2
        up = values > border
        if not up.any() or up.all():
            return border
        new = values[~up].mean(), values[up].mean()
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The blocks of the content region, white space collapsed, joined by a line feed; no content: empty."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    lines = [(" ".join("".join(parts).split()), tags, linked, article) for parts, tags, linked, article in parser.lines]
    if not lines:
        return ""
    text, links = np.array([(max(0, len(t) - linked), min(len(t), linked)) for t, _, linked, _ in lines]).T
    noise = boilerplate(parser.named, parser.articles, text, links)
    kept = np.array([bool(x[0]) for x in lines])
    if not kept.any():
        return ""
    lines, noise = [x for x in lines if x[0]], noise[kept]
    article = np.array([x[3] for x in lines]) & ~noise
    text = np.where(noise, 0, text[kept])
    # A line whose text is all links has none of its own; in an article it is a source or a list.
    given = (text > 0) | article
    if not given.any():
        return ""
    ratio = text / [max(1, tags) for _, tags, _, _ in lines]
    # A teaser's article says little about the page, one that holds most of the text nearly all.
    share = text[article].sum() / text.sum() if text.any() else 1.0
    weight = np.where(article, 1.0, 1.0 - share)
    ratio = np.where(article, ratio + share * max(1.0, ratio.max()), ratio * weight)
    own, level = np.log1p(ratio), np.log1p(smooth(ratio) * weight)
    # A page without boilerplate has a lower cluster too: no text at all.
    border = min(threshold(np.append(own, 0.0)), threshold(np.append(level, 0.0)))
    # A lone line outside an article needs dense neighbours or much text.
    near = given & (np.where(article, np.maximum(own, level), level) > border)
    if not near.any():
        return ""
    # Lines between the first and the last of the upper cluster are inside the region.
    first, last = np.flatnonzero(near)[[0, -1]]
    return "\n".join(x[0] for i, x in enumerate(lines) if given[i] and first <= i <= last)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (underscores before a name that is taken).

    A null or empty html has an empty text.  A line break element is white
    space inside its block.  Rows are read one by one: repeated rows get equal
    results, and an empty table an empty result.
    """

    @arrow_udf("string")
    def text_of(pages_: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in pages_], pa.string())

    text = fresh(pages, "text")
    return pages.withColumn(text, text_of(F.col(html_col))).withColumn(fresh(pages, "n_chars"), F.length(text).cast("long"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
