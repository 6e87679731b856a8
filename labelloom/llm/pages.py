"""Main text of web pages from parser events and smoothed text-to-tag ratios.

The standard library's parser streams its events. Block tags cut the page into
lines; a line's ratio is its characters over the tags around it. The ratios are
smoothed with a Gaussian, and a threshold between the means of the two clusters
they fall into (two-means) tells content from the rest; where the clusters are
alike, all lines are content. All lines of every region (outermost article or
main, or other sectioning element outside these) that holds a content line (not
one that only its neighbours lift) or is an article or main are the text, so that a short paragraph between long ones
stays. Elements that never hold an article (menus,
headers, footers, asides, scripts, adverts, notices, comments) are left out, and so are forms, but one outside
articles that holds an article, main, nav or footer, as server pages do. A class or id names one when all its hyphenated
parts do (holders such as container or section at the end do not matter), so ``has-sidebar`` and ``related-work`` do not.

Defined cases: a null or empty page and one without content have the empty
text; an unclosed p, li, dt, dd,
cell or row ends where HTML ends it, other unclosed and stray tags are tolerated; pages are read whole whatever
their length; repeated rows give repeated results; other columns are carried along,
a column named as the result is replaced.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

SLICE = 1 << 16  # characters fed to the parser at a time
SIGMA = 1.5  # of the Gaussian, in lines
LIFTED = 0.25  # a line whose own ratio is below this share of the threshold was lifted over it by its neighbours
ALIKE = 0.5  # clusters whose means differ by less than this factor are one
# fixed values: element names and class words
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
REGIONS = frozenset("article main section div td body".split())
NEVER = frozenset(
    "nav footer aside script style noscript template button select option textarea input label iframe object "
    "svg canvas head title dialog menu audio video map annotation annotation-xml datalist fieldset".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo cookie cookies consent notice alert "
    "popup modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer masthead "
    "comment comments disqus respond replies related share sharing social widget toolbar pagination skip".split()
)
PLACES = frozenset(
    "site top bottom left right box bar list links buttons slot unit block area main user reader global primary secondary".split()
)  # say nothing alone
HOLDERS = frozenset("section container wrapper wrap inner outer holder panel thread".split())  # nor do these, as the last part
REMARKS = frozenset("comment comments disqus respond replies reply ad ads advert advertisement sponsored".split())  # of an article
SERVED = frozenset("article main nav footer".split())  # a form that holds one is the page's own
ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split()
)
# fixed values: what ends an unclosed element, and the elements beyond which it is not looked for
_CELL, _ROW, _GROUP = ("td", "th"), ("td", "th", "tr"), ("td", "th", "tr", "tbody", "thead", "tfoot", "caption")
_ENDS_P = (
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li dt dd main menu nav ol p pre section table tbody td tfoot th thead tr ul"
).split()
_LIST_WALLS = ("ul", "ol", "menu", "table", "td", "th", "section", "article", "main", "blockquote", "nav", "aside", "form")
ENDS: dict[str, list[tuple[tuple[str, ...], frozenset[str]]]] = {
    tag: [(("p",), frozenset(("td", "th", "caption", "table", "object", "template", "button")))] for tag in _ENDS_P
}
ENDS["li"].append((("li",), frozenset(_LIST_WALLS)))
for _tag in ("dt", "dd"):
    ENDS[_tag].append((("dt", "dd"), frozenset(("dl", *_LIST_WALLS))))
for _tag, _ended in {"td": _CELL, "th": _CELL, "tr": _ROW, "tbody": _GROUP, "thead": _GROUP, "tfoot": _GROUP}.items():
    ENDS[_tag].append((_ended, frozenset(("table", "template"))))


def names_boilerplate(name: str, words: frozenset[str] = WORDS) -> bool:
    """Whether a class or id is one of the words, or made of them and of words for places and holders."""
    parts = [p for p in name.replace("_", "-").split("-") if p]
    while len(parts) > 1 and parts[-1] in HOLDERS:
        parts.pop()
    return not words.isdisjoint(parts) and words | WORDS | PLACES >= set(parts)


def is_boilerplate(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> bool:
    if tag in NEVER or (tag == "header" and not inside_article):
        return True
    if tag in ("html", "body", "main"):
        return False
    words = REMARKS if tag == "article" else WORDS
    for name, value in attrs:
        if not value:
            continue
        if name == "role" and tag != "article" and value.strip().lower() in ROLES:
            return True
        if name in ("class", "id") and any(names_boilerplate(v, words) for v in value.lower().split()):
            return True
    return tag != "article" and any(name == "hidden" for name, _ in attrs)


class Lines(HTMLParser):
    """Collects (text, tags around it, region, form) per line; form 0 is none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, boilerplate, region
        self.buffer: list[str] = []
        self.count: Counter[str] = Counter()  # open elements per tag
        self.tags, self.regions, self.articles = 0, 0, 0
        self.main_regions: set[int] = set()  # regions that are an article or main
        self.lines: list[tuple[str, int, int, int]] = []
        self.form, self.forms = 0, 0  # forms do not nest: a form inside one is no element
        self.inside = False  # whether the open form is inside an article
        self.served: set[int] = set()  # forms that hold the page

    def _here(self) -> tuple[bool, int]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (False, 0)

    def cut(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            self.lines.append((text, self.tags, self._here()[1], self.form))
            self.tags = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        self._end_unclosed(tag)
        if tag in VOID:
            if tag == "br":
                self.buffer.append(" ")
            return
        left_out, region = self._here()
        if tag == "form" and not self.form:
            self.forms += 1
            self.form, self.inside = self.forms, self.articles > 0
        elif tag in SERVED and self.form and not left_out and not self.inside:
            self.served.add(self.form)
        left_out = left_out or is_boilerplate(tag, attrs, self.articles > 0)
        if tag in REGIONS and not self.articles:
            self.regions += 1
            region = self.regions
            if tag in ("article", "main"):
                self.main_regions.add(region)
        self.articles += tag in ("article", "main")
        self.count[tag] += 1
        self.open.append((tag, left_out, region))

    def _close(self, at: int) -> None:
        for tag, _, _ in self.open[at:]:
            self.count[tag] -= 1
            self.articles -= tag in ("article", "main")
            if tag == "form" and not self.count[tag]:
                self.form = 0
        del self.open[at:]

    def _end_unclosed(self, tag: str) -> None:
        for ended, walls in ENDS.get(tag, ()):
            if not any(self.count[t] for t in ended):
                continue
            last = None
            for at in range(len(self.open) - 1, -1, -1):
                name = self.open[at][0]
                if name in ended:
                    last = at
                    if len(ended) < 3:  # of rows and row groups the outermost one ends
                        break
                elif name in walls:
                    break
            if last is not None:
                self._close(last)

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        elif tag == "br":
            self.buffer.append(" ")

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        if not self.count[tag]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                return

    def handle_data(self, data):
        if not self._here()[0]:
            self.buffer.append(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    reach = int(np.ceil(2 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """Midpoint of the two means of a two-means clustering; the least value where the means are alike."""
    low, high = float(values.min()), float(values.max())
    while low < high:
        middle = (low + high) / 2
        near = values > middle
        new = (float(values[~near].mean()), float(values[near].mean()))
        if new == (low, high):
            return float(values.min()) if low > ALIKE * high else middle
        low, high = new
    return low


def main_text(html: str | None) -> str:
    parser = Lines()
    for start in range(0, len(html or ""), SLICE):
        parser.feed(html[start : start + SLICE])
    parser.close()
    parser.cut()
    lines, skipped = [], 0
    for text, n, region, form in parser.lines:
        if form and form not in parser.served:
            skipped += n  # the tags of what is left out are around the next line
        else:
            lines.append((text, n + skipped, region))
            skipped = 0
    if not lines:
        return ""
    texts, tags, regions = zip(*lines, strict=True)
    sizes = np.array([len(t) for t in texts], dtype=float)
    own = sizes / np.maximum(1, np.array(tags))
    ratio = smoothed(own)
    least = threshold(ratio)
    content = (ratio >= least) & (own >= LIFTED * least)
    kept = parser.main_regions | {r for r, c in zip(regions, content, strict=True) if c}
    return "\n".join(t for t, r in zip(texts, regions, strict=True) if r in kept)


def texts_of(html: pd.Series) -> pd.Series:
    return pd.Series([main_text(h) for h in html], dtype=object)


def with_text(df, html: str = "html", name: str = "text"):
    """``df`` with the column ``name`` added; one of that name is replaced."""
    return df.withColumn(name, F.pandas_udf(texts_of, "string")(F.col(html)))
