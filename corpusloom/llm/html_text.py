"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines (one per block element, with the characters of its links counted apart); every container
border leaves a gap of empty lines. Text lengths are summed over sliding windows of lines. A surge is where the sum
leaves zero, a dive where it returns to zero; text between a surge and the next dive is a passage. An article or main
element, where there is one, bounds the passages that can be kept; elsewhere the main region around the large passages
does. In both, passages of links are left out, and in an article so are passages that a class name makes suspicious and
whose own distribution doesn't show the article's density. Elements that are never main text (menus, adverts, comments and the
like, by tag, class, id or role, or hidden) are stripped with the markup.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.shared import arrow_map, ddl, name

#: Elements that never hold main text, elements that end a line, containers whose borders leave a gap.
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg canvas object button select textarea menu dialog head title math audio video".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr pre blockquote figcaption caption address summary hr ul ol dl table thead tbody tfoot figure details center".split())
CONTAINERS = frozenset("body main article section div header nav footer aside form html hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in class, id or role that mark menus, adverts, sidebars and reader comments wherever they are, and
#: words that mark them outside an article, but may be part of its subject inside.
STRONG = "ads?|advert\\w*|sponsor\\w*|promo\\w*|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|share|sharing|social|breadcrumbs?|pagination|pager|nav\\w*|menu\\w*|sidebar\\w*|widget\\w*|related|recommend\\w*|comments?|commentlist|replies|reply|respond|disqus|footer|masthead|topbar|complementary|navigation|contentinfo"
WEAK = "banner|notices?|overlay|side|toolbar|search|login|alert|dialog|skip|toc|copyright|legal|disclaimer"
STRONG_WORD, WEAK_WORD = (re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.IGNORECASE) for words in (STRONG, WEAK))
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/><]*))")
DELIMITER = re.compile("[>\"']")
ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")


@dataclass
class Tag:
    """start, end: in the source, brackets included. match: index of the tag that explicitly closes or opens what this one opens or closes, or -1."""

    start: int
    end: int
    name: str
    closing: bool
    attrs: str
    match: int = -1


@dataclass
class Line:
    """links, anchors: characters in links and the number of them. weak: in an element with a suspicious class name."""

    text: str
    links: int
    article: bool
    anchors: int = 0
    weak: bool = False


@dataclass
class _Page:
    window: int
    lines: list[Line] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    links: int = 0
    anchors: int = 0

    def end(self, article: bool, weak: bool) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(Line(text, min(self.links, len(text)), article, self.anchors, weak))
        self.text, self.links, self.anchors = [], 0, 0

    def gap(self) -> None:
        if self.lines and self.lines[-1].text:
            self.lines += [Line("", 0, False)] * self.window


def tags(source: str) -> list[Tag]:
    """The tags of a page in order, comments and declarations as tags without a name, in time linear in its length.

    A tag ends at the first '>' outside quotes. Once a tag has none, quotes are ignored in the rest; a '<' without any '>'
    behind it is text. What stands in a raw element (scripts and the like) is no tag.
    """
    out: list[Tag] = []
    last = source.rfind(">")
    quotes, pos = True, 0
    while (m := OPENING.search(source, pos)) is not None and (m.start() < last or source.startswith("<!--", m.start())):
        name, at = (m[2] or "").lower(), m.end()
        if source.startswith("<!--", m.start()):
            end = source.find("-->", at)
            out.append(Tag(m.start(), end + 3 if end >= 0 else len(source), "", False, ""))
            pos = out[-1].end
            continue
        end = source.find(">", at) if not (name and quotes) else -1
        if name and quotes:
            k = at
            while (d := DELIMITER.search(source, k)) is not None:
                if d[0] == ">":
                    end = d.start()
                    break
                close = source.find(d[0], d.end())
                if close < 0:
                    break
                k = close + 1
            if end < 0:
                quotes, end = False, source.find(">", at)
        out.append(Tag(m.start(), end + 1, name, bool(m[1]), source[at:end]))
        pos = end + 1
        if name in RAW and not m[1]:
            close = re.compile(f"</{name}", re.IGNORECASE | re.ASCII).search(source, pos)
            pos = close.start() if close else len(source)
            if not close:
                out[-1].end = pos
    unmatched: dict[str, list[int]] = {}
    for i, t in enumerate(out):
        if t.closing and unmatched.get(t.name):
            t.match = unmatched[t.name].pop()
            out[t.match].match = i
        elif not t.closing and t.name and t.name not in VOID:
            unmatched.setdefault(t.name, []).append(i)
    return out


def _suspect(tag: Tag, in_article: bool) -> str:
    """'drop' for an element that is never main text, 'weak' for one in an article that its density decides on, else ''."""
    if tag.name in DROPPED or (tag.name == "header" and not in_article):
        return "drop"
    found = ""
    for m in ATTR.finditer(tag.attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id", "role"):
            # The page's own frame, and its article, may name anything that is on the page.
            if tag.name in ("body", "html", "main") or (tag.name == "article" and not in_article):
                continue
            if STRONG_WORD.search(value):
                return "drop"
            if WEAK_WORD.search(value):
                if not in_article:
                    return "drop"
                found = "weak"
        elif (key == "style" and HIDDEN.search(value)) or key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return "drop"
    return found


def _after(found: list[Tag], i: int) -> int:
    """The first tag behind element i: behind its closing tag, or, if it has none, where its parent or an article begins or ends."""
    if found[i].match >= 0:
        return found[i].match + 1
    own = found[i].name
    for k in range(i + 1, len(found)):
        t = found[k]
        if t.closing:
            if 0 <= t.match < i:
                return k
        elif t.name in ("article", "main") or (own == "p" and (t.name in BLOCKS or t.name in CONTAINERS)) or (t.name == own and own in ("li", "dt", "dd", "tr", "td", "th")):
            return k
    return len(found)


def to_lines(html: str | None, window: int = 3) -> list[Line]:
    """Lines of visible text in page order; borders of containers leave ``window`` empty lines."""
    source = html or ""
    page, found = _Page(window), tags(source)
    article, anchor, i, at = 0, False, 0, 0
    weak = 0  # the index behind the suspicious element that is open

    def take(end: int) -> None:
        if at < end:
            piece = entities.unescape(source[at:end])
            page.text.append(piece)
            if anchor:
                page.links += len(piece.strip())

    while i < len(found):
        t = found[i]
        take(t.start)
        at = t.end
        i += 1
        if not t.name:
            continue
        if weak and i > weak:
            page.end(article > 0, True)
            page.gap()
            weak = 0
        if not t.closing and t.name not in VOID:
            kind = _suspect(t, article > 0)
            if kind:
                page.end(article > 0, weak > 0)
                page.gap()
            if kind == "drop":
                if t.name in RAW or not t.attrs.rstrip().endswith("/"):
                    i = _after(found, i - 1)
                    at = found[i - 1].end if found[i - 1].closing or i == len(found) else found[i].start
                    if i == len(found) and not found[i - 1].closing:
                        at = len(source)
                continue
            if kind == "weak" and not weak:
                weak = _after(found, i - 1)
        if t.name == "a":
            anchor = not t.closing
            page.anchors += anchor
        elif t.name in ("br", "td", "th"):
            page.text.append(" ")
        elif t.name in BLOCKS or t.name in CONTAINERS:
            page.end(article > 0, weak > 0)
            anchor = False
            if t.name in ("article", "main"):
                article = max(0, article - 1) if t.closing else article + 1
            if t.name in CONTAINERS:
                page.gap()
    take(len(source))
    page.end(article > 0, weak > 0)
    return page.lines


def passages(lines: list[Line], window: int = 3) -> list[tuple[int, int, int]]:
    """(surge, dive, characters) of every run of lines over which the sliding sum of text lengths stays above zero."""
    weights = np.array([len(x.text) for x in lines], np.int64)
    if not len(weights):
        return []
    sums = np.convolve(weights, np.ones(window, np.int64))[: len(weights)]  # sum over a line and those before it
    on = np.concatenate([[False], sums > 0, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return [(int(a), int(b), int(weights[a:b].sum())) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def main_text(html: str | None, window: int = 3, share: float = 0.2, max_link_share: float = 0.5, least_anchors: int = 3) -> str:
    """Main text of a page; blocks joined by an empty line, '' if there is none.

    Inside an article every passage counts but those of mostly links (``least_anchors`` of them at least), and those with a suspicious class
    name whose largest sliding sum of characters outside links is under half of the article's mean line.
    Elsewhere the main region runs from the surge of the first to the dive of the last passage with at least ``share`` of the
    largest one's characters outside links, and on over its neighbours, however short, up to a passage with more than
    ``max_link_share`` of its characters in links; only such passages are left out of it.
    """
    lines = to_lines(html, window)
    bounded = any(x.article for x in lines)
    lines = [x if x.article or not bounded else Line("", 0, False) for x in lines]
    found = passages(lines, window)
    links = [sum(x.links for x in lines[a:b]) for a, b, _ in found]
    prose = [k <= max_link_share * p[2] for p, k in zip(found, links, strict=True)]
    if bounded:
        sure = [len(x.text) for x in lines if x.text]
        dense = 0.5 * sum(sure) / max(1, len(sure))
        kept = []
        for (a, b, _), plain in zip(found, prose, strict=True):
            if not plain and sum(x.anchors for x in lines[a:b]) >= least_anchors:
                continue
            if any(x.weak for x in lines[a:b]):
                sums = np.convolve([len(x.text) - x.links for x in lines[a:b]], np.ones(window))
                if sums.max() < dense:
                    continue
            kept.append((a, b))
    else:
        weight = [p[2] - k for p, k in zip(found, links, strict=True)]
        most = max(weight, default=0)
        large = [i for i, n in enumerate(weight) if most > 0 and prose[i] and n >= share * most]
        if not large:
            return ""
        surge, dive = large[0], large[-1] + 1
        while surge > 0 and prose[surge - 1]:
            surge -= 1
        while dive < len(found) and prose[dive]:
            dive += 1
        kept = [p[:2] for p, plain in zip(found[surge:dive], prose[surge:dive], strict=True) if plain]
    return "\n\n".join(x.text for a, b in kept for x in lines[a:b] if x.text)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row, from the whole page. Null, empty or markup-only pages give ''.

    One narrow pass: no shuffle, rows keep their order, repeated rows repeat, other columns are ignored.
    """

    def rows(ids, urls, pages):
        for i, u, h in zip(ids, urls, pages, strict=True):
            text = main_text(h)
            yield i, u, text, len(text)

    schema = pa.schema([(id_col, pa.int64()), (url_col, pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    return arrow_map(pages.select(name(id_col).cast("long"), name(url_col).cast("string"), name(html_col)), rows, f"{ddl(id_col, 'long')}, {ddl(url_col, 'string')}, text string, n_chars long", schema)
