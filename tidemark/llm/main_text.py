"""HTML extraction by minimum-cut labelling.

A page becomes a row of text blocks in page order, each with what its chain of open
elements amounts to; running sums along the chain keep that linear in the page, however
deep it is. A linear classifier with weights set by hand turns element names, class and id
words, roles, link density, length and punctuation into a cost for each label: the capacities
from the source (content) and to the sink (boilerplate). Neighbouring blocks are
joined by smoothness edges, the stronger the more of their chains they share,
and so are successive blocks of one parent. The minimum cut, found by Dinic's
maximum flow, labels all blocks together; blocks on the source side are the text.

Null or empty html gives an empty text, as does a page without content blocks.
Broken markup is read as far as it goes: unclosed elements end with their
parents, a tag that the page's end cuts off is left out. Scripts, styles,
templates, titles and form controls never give blocks. Rows are independent;
other columns pass through.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_text

SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas select option button textarea input datalist audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES_SELF = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
BAD_ELEMENTS = frozenset("nav footer aside form menu dialog".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail widget widgets related recommended recommendations more share sharing social follow footer foot "
    "header masthead topbar comment comments disqus reply replies discussion respond form search pagination pager tags copyright legal disclaimer skip toolbar teaser outbrain taboola".split()
)
GOOD_WORDS = frozenset("article articlebody content post postbody entry story main body text".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NAME, GAP, KEY, EQUALS, BARE = (re.compile(p) for p in (r"[A-Za-z][^\s/>]*", r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style")}
SMOOTH, PARENT = 0.8, 0.6


class Element:
    """An open element, with what it and those around it add up to; inline elements pass on what they stand in."""

    __slots__ = ("tag", "fence", "number", "parent", "depth", "against", "best", "seen", "skipped", "linked")

    def __init__(self, tag: str, number: int, bias: float, place: int, above: Element | None) -> None:
        self.tag = tag
        plain = tag not in INLINE
        self.fence = place if plain else above.fence if above else -1  # place of the innermost plain element
        self.number = number if plain else above.number if above else 0
        self.parent = (above.number if plain else above.parent) if above else 0  # the plain element around the innermost one
        self.depth = (above.depth if above else 0) + plain
        self.against = (above.against if above else 0.0) + (min(0.0, bias) if plain else 0.0)
        self.best = max(above.best if above else 0.0, bias if plain else 0.0)
        self.seen = (above.seen if above else 0) | (MARKED.get(tag, 0) if plain else 0)
        self.skipped = tag in SKIPPED or bool(above and above.skipped)
        # A link counts for itself and five elements inside, lest an unclosed one spoil the page.
        self.linked = 6 if tag == "a" else max(0, above.linked - 1) if above else 0


MARKED = {"p": 1, "blockquote": 1, "pre": 1, "article": 2, "h1": 4, "h2": 4, "h3": 4}
PARAGRAPH, ARTICLE, HEADING = 1, 2, 4


def _start_tag(html: str, at: int) -> tuple[str, dict[str, str | None], bool, int] | None:
    """Name, attributes, whether it closes itself, and the end of the start tag at `at`; None if the page ends inside."""
    m = NAME.match(html, at + 1)
    name, attrs, pos = m.group().lower(), {}, m.end()
    while (pos := GAP.match(html, pos).end()) < len(html):
        if html[pos] == ">":
            return name, attrs, html[pos - 1] == "/", pos + 1
        m = KEY.match(html, pos)
        key, pos = m.group().lower(), m.end()
        value = None
        if m := EQUALS.match(html, pos):
            pos = m.end()
            quote = html[pos : pos + 1]
            if quote in ('"', "'"):
                end = html.find(quote, pos + 1)
                if not quote or end < 0:
                    return None
                value, pos = html[pos + 1 : end], end + 1
            else:
                m = BARE.match(html, pos)
                value, pos = m.group(), m.end()
            value = unescape(value)
        attrs[key] = value
    return None


def markup(html: str) -> Iterator[tuple]:
    """Texts and tags of a page in one pass: no character is searched again for what its end has not shown.

    What the page's end cuts off (a tag, a comment) is left out with all that it would hold.
    """
    pos, ended = 0, True
    while pos < len(html):
        at = html.find("<", pos)
        if at < 0:
            yield "text", unescape(html[pos:])
            return
        kind = html[at + 1 : at + 2]
        letter = html[at + 2 : at + 3] if kind == "/" else kind
        tagged = letter.isascii() and letter.isalpha()
        if not tagged and kind not in ("!", "?", "/") or not kind:
            yield "text", unescape(html[pos : at + 1])
            pos = at + 1
            continue
        if at > pos:
            yield "text", unescape(html[pos:at])
        if kind == "/" or kind in ("!", "?"):
            end = -1
            if html.startswith("<!--", at) and ended:
                # A comment that nothing ends is one up to the next sign, and so are all after it.
                end = html.find(">", at) if html.startswith(("<!-->", "<!--->"), at) else html.find("-->", at + 4)
                ended = end >= 0
                end = end + 2 if html.startswith("-->", end) and ended else end
            end = html.find(">", at) if end < 0 else end
            if end < 0:
                return
            if kind == "/" and tagged:
                yield "end", NAME.match(html, at + 2).group().lower()
            pos = end + 1
            continue
        found = _start_tag(html, at)
        if found is None:
            return
        name, attrs, closed, pos = found
        yield "start", name, attrs, closed
        if name in RAW_END and not closed:
            m = RAW_END[name].search(html, pos)
            if m is None:
                return
            pos = m.start()


class _Reader:
    """Collects blocks: text, share inside links, the sums of their chain, and how much of it the block before shares."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.open: dict[str, list[int]] = {}  # places in the stack of each element name
        self.blocks: list[dict] = []
        self.parts: list[str] = []
        self.linked = 0
        self.count = 0
        self.lowest = 0  # least depth since the block before

    def read(self, html: str) -> None:
        for kind, *rest in markup(html):
            if kind == "text":
                self.handle_data(*rest)
            elif kind == "end":
                self.handle_endtag(*rest)
            else:
                name, attrs, closed = rest
                self.handle_starttag(name, attrs)
                if closed and name not in VOID:
                    self.handle_endtag(name)
        self.flush()

    def _pop(self, k: int) -> None:
        for e in self.stack[k:]:
            self.open[e.tag].pop()
        del self.stack[k:]
        self.lowest = min(self.lowest, self.stack[-1].depth if self.stack else 0)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1] if self.stack else None
            depth = top.depth if top else 0
            self.blocks.append({
                "text": text, "linked": min(1.0, self.linked / len(text)), "depth": depth, "shared": min(self.lowest, depth),
                "parent": top.parent if top else 0, "against": top.against if top else 0.0, "best": top.best if top else 0.0, "seen": top.seen if top else 0,
            })
            self.lowest = depth
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close("p", ("table", "div", "section", "article", "button"))
        if tag in CLOSES_SELF:
            self._close(tag, tuple(CLOSES_SELF[tag].split()))
        self.count += 1
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Element(tag, self.count, _bias(tag, attrs), len(self.stack), self.stack[-1] if self.stack else None))

    def _last(self, tag: str) -> int:
        """Place of the innermost open element of a name, -1 without one."""
        places = self.open.get(tag)
        return places[-1] if places else -1

    def _close(self, tag: str, fence: tuple[str, ...]) -> None:
        k = self._last(tag)
        if k >= 0 and all(self._last(f) < k for f in fence if f != tag):
            self.flush()
            self._pop(k)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        k = self._last(tag)
        # An inline element ends only inside the plain element that it stands in.
        if k >= 0 and (tag not in INLINE or self.stack[-1].fence < k):
            self._pop(k)

    def handle_data(self, data):
        top = self.stack[-1] if self.stack else None
        if top and top.skipped:
            return
        self.parts.append(data)
        if top and top.linked:
            self.linked += len(data.strip())


def _bias(tag: str, attrs: dict[str, str | None]) -> float:
    """Evidence of one open element for (above zero) or against content."""
    out = {"article": 3.0, "main": 2.0, "header": -3.0}.get(tag, -5.0 if tag in BAD_ELEMENTS else 0.0)
    if (attrs.get("role") or "").lower() in BAD_ROLES:
        out -= 5.0
    if "hidden" in attrs or "display:none" in (attrs.get("style") or "").replace(" ", ""):
        out -= 4.0
    words = {w.lower() for k in ("class", "id", "itemprop") for w in PART.findall(attrs.get(k) or "")}
    if tag not in ("html", "body") and words & BAD_WORDS:
        out -= 5.0
    elif words & GOOD_WORDS:
        out += 1.5
    return out


def cost(block: dict) -> float:
    """Evidence of a block: above zero the capacity from the source, below zero the one to the sink."""
    text, seen = block["text"], block["seen"]
    out = block["against"] + block["best"]
    out += min(1.5, len(text) / 150) - 0.4
    out += 0.4 if text[-1] in ".!?…:;\"”»" else -0.2
    out += 0.4 if seen & PARAGRAPH else 0.0
    out += 0.4 if seen & HEADING and seen & ARTICLE else 0.0
    return out - 4.0 * max(0.0, block["linked"] - 0.3)


def edges(blocks: list[dict]) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours by the share of their chains, and successive blocks of one parent."""
    out, seen = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, SMOOTH * b["shared"] / max(1, b["depth"], blocks[i - 1]["depth"])))
        if b["parent"] in seen:
            out.append((seen[b["parent"]], i, PARENT))
        seen[b["parent"]] = i
    return out


def source_side(weights: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut (Dinic's algorithm)."""
    n = len(weights)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, w in enumerate(weights):
        join(s, i, w, 0.0) if w > 0 else join(i, t, -w, 0.0)
    for a, b, w in links:
        if w > 0:
            join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                path, u = [], s
                continue
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(out[u]):
                path.append(out[u][at[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]
                at[u] += 1


def blocks_of(html: str) -> list[dict]:
    reader = _Reader()
    reader.read(html)
    return reader.blocks


def main_text(html: str | None) -> str:
    blocks = blocks_of(html) if html else []
    if not blocks:
        return ""
    keep = source_side([cost(b) for b in blocks], edges(blocks))
    return " ".join(b["text"] for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, html: str = "html", into: str = "_main") -> DataFrame:
    """pages, all rows and columns, with a struct of text and n_chars in `into`."""

    def function(texts: list[str]) -> pa.Array:
        found = [main_text(t) for t in texts]
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["text", "n_chars"])

    return map_text(pages, function, "struct<text: string, n_chars: bigint>", into, html)


def page_texts(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", F.col("_main.text").alias("text"), F.col("_main.n_chars").alias("n_chars"))
