"""Main text of web pages by minimum-cut labelling.

Method. A page is cut into blocks: runs of text between block-level tags. A logistic classifier
looks at a block's enclosing elements (landmarks, names in class and id), its length, punctuation
and links; each of these is a number from 0 to 1, so that no single one decides. Its weights are
fitted on SAMPLE_PAGES labelled pages that page_samples composes. What it would cost to call the
block content and what to call it boilerplate become its capacities to the two terminals.
Smoothness edges join blocks that follow each other, the stronger the nearer they are in the DOM,
and neighbours among the children of one element. A maximum flow separates the two sides at least
cost. Before the flow, blocks whose own costs outweigh all their smoothness edges are settled, which
leaves the minimum unchanged, so the flow runs over short stretches of undecided blocks.

Names. A token of class or id speaks against an element if all its words do or mean nothing
(`comment-list`); with other words (`comments-closed`) it says little, and after a modifier
(`no-sidebar`) nothing. Evidence against an element that holds the main element, or a heading of first rank
with sentences or much of the page's text, counts for a quarter: it tells of the page around. So do names of paragraphs and headings inside the main element.

Position. Where a page marks its main element (an article with its heading, else `main` or an article with most of the text), standing outside of it is
evidence by itself: composed pages have blocks of sentences there whose names mean nothing.

Text. Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by two newlines. Inline elements never end a block, whatever their names. Text in scripts,
styles, templates, frames, titles, lists of choices and fields of forms is no text of the page; all other text is judged, whether it is shown or not.

Scanning goes forward only and takes time in proportion to the page, whatever its markup.

Defined results: null or empty html gives the empty text, as does a page without content blocks;
unclosed comments, tags and scripts end with the page, an unclosed title or field doesn't; repeated
rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sprucelake.llm.common import few_rows_a_batch, small_batches
from sprucelake.llm.page_samples import sample_pages

#: Composed pages that the classifier is fitted on, and its L2 term.
SAMPLE_PAGES, RIDGE = 400, 0.5

#: What follows `<`: a name and all up to `>`; a value in quotes may hold `>`. Nothing is gone over twice.
TAG = re.compile(r"([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?>\"[^\"]*\"|'[^']*')?)*)>")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements whose inside is no text of the page; without an end tag those in the first set end with it.
TO_THE_END = {"script", "style", "iframe"}
RAW = TO_THE_END | {"template", "textarea", "select", "title"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark object picture q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr"
    " math mi mn mo mrow ms mtext msup msub msubsup mfrac msqrt mroot munder mover munderover mstyle semantics annotation svg g path text tspan circle rect line polygon use defs desc".split()
)
#: A start tag of the first closes an open element of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements over whose borders a missing end tag is not looked for.
SCOPES = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "div", "main", "nav", "aside", "footer", "header", "form"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN, OUT, FORM = {"article", "main"}, {"nav", "footer", "aside", "menu", "dialog"}, {"form", "button", "fieldset"}
ROLE = {"main": "main", "article": "article", "navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "dialog": "dialog", "alert": "dialog", "form": "form", "menu": "menu"}
NAMES_OUT = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner banners cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login register"
    " comment comments commentlist reply replies respond disqus discussion sidebar side widget widgets related recommended recommendations trending popular share sharing social follow breadcrumb breadcrumbs crumbs menu nav navbar navigation"
    " footer foot copyright legal masthead topbar toolbar search pagination pager paging tags tagcloud skip print hidden feedback toc".split()
)
NAMES_MILD = set("header head byline meta author date dateline caption credit timestamp info tools".split())
NAMES_IN = set("article content post entry story main body text maintext articlebody prose blog".split())
#: Words that change nothing about what a token says.
NEUTRAL = set("list box boxes wrapper wrap area section block container inner outer top bottom left right site page global primary secondary col column panel bar item items link links button btn group row slot unit title form icon icons posts articles stories news us me now policy thread mobile desktop sticky fixed large small".split())
#: A token that begins with one of these and goes on says what an element has or is filed under, not what it is.
MODIFIERS = {"has", "no", "not", "with", "without", "tag", "category", "cat", "term", "is"}
#: What an article of its own is when a whole token says so and no token says that it is content.
NAMES_ARTICLE_OUT = set("ad ads advert adverts advertisement advertising comment comments commentlist reply replies respond".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
STOP = re.compile(r"[.!?;:,…。！？](?:\s|[\"'”’»)]|$)")
#: Smoothness: blocks that follow each other, divided by their distance in the DOM; children of one element.
FOLLOW, SIBLING = 1.6, 0.6
SCALE = 1000
FEATURES = ("always", "in main", "outside of main", "landmark against", "page header", "header in main", "form", "names against", "names a little against", "mild names", "names for", "links", "length", "stops", "heading", "paragraph", "item")


def token_says(token: str) -> float:
    """How much a token of class or id speaks against its element: 1, a little, or not at all."""
    words = [w.lower() for w in WORD.findall(token)]
    if not words or len(words) > 4 or (len(words) > 1 and words[0] in MODIFIERS) or not NAMES_OUT.intersection(words):
        return 0.0
    return 1.0 if all(w in NAMES_OUT or w in NEUTRAL or w in NAMES_IN or w.isdigit() for w in words) else 0.25


class Page:
    """A page's elements (0 is the page itself, parents come before children) and its blocks, in order."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.landmark, self.against, self.mild, self.names_for = ["#page"], [-1], [""], [0.0], [0.0], [0.0]
        self.text: list[str] = []
        self.linked: list[int] = []
        self.element: list[int] = []
        self.far: list[int] = []
        self._scan(page)

    def _new(self, tag: str, attributes: str, parent: int) -> int:
        against, mild, names_for, landmark = 0.0, 0.0, 0.0, tag
        for m in ATTRIBUTE.finditer(attributes) if attributes and not attributes.isspace() else ():
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                landmark = ROLE.get(value.strip().lower(), landmark)
            elif key == "class" or (tag != "p" and tag not in HEADINGS):  # those have ids made from what they say
                tokens = value.split()[:50]
                words = {w.lower() for t in tokens for w in WORD.findall(t)}
                names_for = max(names_for, float(not words.isdisjoint(NAMES_IN)))
                mild = max(mild, float(not words.isdisjoint(NAMES_MILD)))
                said = max(map(token_says, tokens), default=0.0)
                if tag == "article" and not (words.isdisjoint(NAMES_IN) and any(NAMES_ARTICLE_OUT.issuperset(w.lower() for w in WORD.findall(t)) for t in tokens if WORD.search(t))):
                    said *= 0.25
                against = max(against, said)
        self.tag.append(tag)
        self.parent.append(parent)
        self.landmark.append(landmark)
        self.against.append(against)
        self.mild.append(mild)
        self.names_for.append(names_for)
        return len(self.tag) - 1

    def _scan(self, page: str) -> None:
        stack, at, scopes = [0], {}, [0]  # open elements; by tag where it stands open; where scopes stand
        text: list[str] = []
        linked, link, place, lowest, last_depth, size = 0, 0, 0, 1, 1, len(page)
        missing: set[str] = set()

        def flush() -> None:
            nonlocal linked, lowest, last_depth
            if text:
                words = " ".join("".join(text).split())
                if words:
                    self.text.append(words)
                    self.linked.append(min(linked, len(words)))
                    self.element.append(stack[-1])
                    self.far.append(last_depth + len(stack) - 2 * min(lowest, len(stack)))
                    lowest = last_depth = len(stack)
                text.clear()
            linked = 0

        def add(part: str) -> None:
            nonlocal linked
            part = html.unescape(part) if "&" in part else part
            text.append(part)
            if link:
                linked += len(part.strip())

        def push(tag: str, attributes: str) -> None:
            at.setdefault(tag, []).append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            stack.append(self._new(tag, attributes, stack[-1]))

        def pop(to: int) -> None:
            nonlocal lowest, link
            while len(stack) > to:
                at[self.tag[stack.pop()]].pop()
                if scopes[-1] == len(stack):
                    scopes.pop()
            lowest = min(lowest, to)
            link = link if link <= to else 0

        def where(tag: str) -> int:
            found = at.get(tag)
            return found[-1] if found else 0

        while place < size:
            m = page.find("<", place)
            if m < 0:
                add(page[place:])
                break
            if m > place:
                add(page[place:m])
            follows = page[m + 1 : m + 2]
            if follows in ("!", "?"):
                if page.startswith("--", m + 2):
                    place = m + 4 if page.startswith((">", "->"), m + 4) else page.find("-->", m + 4)
                else:
                    place = m
                place = page.find(">", place) + 1 if place >= 0 else 0
                if not place:
                    break
                continue
            close = follows == "/"
            if not (page[m + 1 + close : m + 2 + close].isascii() and page[m + 1 + close : m + 2 + close].isalpha()):
                add("<")
                place = m + 1
                continue
            found = TAG.match(page, m + 1 + close)
            if not found:
                break
            place, tag, attributes = found.end(), found[1].lower(), found[2]
            if tag in INLINE:
                if tag == "br":
                    text.append("\n")
                elif tag == "a":
                    link = 0 if close else len(stack)
                continue
            if tag in RAW and not close:
                end = None if tag in missing else RAW_END[tag].search(page, place)
                if end:
                    place = end.end()
                elif tag in TO_THE_END:
                    break
                else:
                    missing.add(tag)
                if tag not in ("script", "style", "template", "title"):
                    flush()
                continue
            flush()
            if close:
                own = where(tag)
                if own and (tag in SCOPES or own > scopes[-1]):
                    pop(own)
            elif tag not in VOID:
                if (own := where("p")) > max(scopes[-1], where("td"), where("th")):
                    pop(own)
                if tag in CLOSES and (own := max(map(where, CLOSES[tag]))) > scopes[-1]:
                    pop(own)
                if not (attributes.endswith("/") and (len(attributes) == 1 or attributes[-2] in " \t\n\"'")):
                    push(tag, attributes)
        flush()

    def features(self) -> np.ndarray:
        """A row of FEATURES for each block."""
        n = len(self.tag)
        stops = [bool(STOP.search(t)) for t in self.text]
        chars, sentences, head, marked = [0] * n, [0] * n, [t == "h1" for t in self.tag], [x in MAIN and a < 1 for x, a in zip(self.landmark, self.against, strict=True)]
        for t, e, stop in zip(self.text, self.element, stops, strict=True):
            chars[e] += len(t)
            sentences[e] += stop and len(t) > 40
        for e in range(n - 1, 0, -1):
            up = self.parent[e]
            chars[up] += chars[e]
            sentences[up] += sentences[e]
            head[up] |= head[e]
            marked[up] |= marked[e] and (self.landmark[e] == "main" or head[e])
        # Whether an element holds the main element, an article with its heading, or a heading and sentences below it.
        plain = [x in MAIN and a < 1 for x, a in zip(self.landmark, self.against, strict=True)]
        holds = [(m and x not in MAIN) or (h and (s > 1 or c > 0.3 * chars[0])) for m, x, h, s, c in zip(marked, self.landmark, head, sentences, chars, strict=True)]
        # The main element: an article with its heading and a sentence, or else with its heading, or else what is marked as main or holds most of the text.
        headed = [m and x == "article" and h for m, x, h in zip(plain, self.landmark, head, strict=True)]
        spoken = [h and s > 0 for h, s in zip(headed, sentences, strict=True)]
        strong = spoken if any(spoken) else headed if any(headed) else [m and (x == "main" or c > 0.5 * chars[0]) for m, x, c in zip(plain, self.landmark, chars, strict=True)]
        rows = np.zeros((n, 11))  # in main, against: landmark, page header, header in main, form, names, a little, mild, names for; open header; in the main element
        for e in range(1, n):
            own, up = rows[e], rows[self.parent[e]]
            own[:] = up
            mark, weight = self.landmark[e], 0.25 if holds[e] or (head[e] and self.landmark[e] in FORM) else 1.0
            own[10] = max(own[10], strong[e])
            if mark in MAIN:
                own[0] = 1
            elif mark in OUT:
                own[1] = max(own[1], weight)
            elif mark == "header":
                own[3 if own[0] else 2] = weight
            elif mark in FORM:
                own[4] = max(own[4], weight)
            inner = own[10] and (self.tag[e] == "p" or self.tag[e] in HEADINGS)
            against = self.against[e] * (0.25 if mark == "main" or self.tag[e] in ("body", "html") or inner else weight)
            if against == 1.0:
                own[5] = 1
            elif against:
                own[6] = max(own[6], against)
            own[7] = max(own[7], self.mild[e] * weight)
            own[8] = max(own[8], self.names_for[e])
        at = np.array(self.element, np.int64)
        around = rows[at] if len(at) else np.empty((0, 11))
        marks = bool(((around[:, 10] == 1) & (around[:, 1] < 1) & (around[:, 5] < 1)).any())
        size = np.array([len(t) for t in self.text], float)
        links = np.maximum(0, np.array(self.linked) / np.maximum(size, 1) - 0.4) / 0.6
        tags = [self.tag[e] for e in self.element]
        out = np.column_stack([
            np.ones(len(at)), around[:, 0], marks * (1 - around[:, 10]), around[:, 1:9], links, np.minimum(size, 200) / 200,
            stops, [t in HEADINGS for t in tags], [t == "p" for t in tags], [t in ("li", "td", "th", "dd", "dt") for t in tags],
        ])
        return out.astype(float)

    def edges(self) -> list[tuple[int, int, int]]:
        """Smoothness edges (a, b, capacity) between blocks."""
        found, last = [], {}
        for i, e in enumerate(self.element):
            if i:
                found.append((i - 1, i, int(SCALE * FOLLOW / (1 + self.far[i]))))
            parent = self.parent[e]
            if parent > 0:
                if parent in last and last[parent] != i - 1:
                    found.append((last[parent], i, int(SCALE * SIBLING)))
                last[parent] = i
        return found


@lru_cache(1)
def fitted() -> np.ndarray:
    """The classifier's weights: ridge logistic regression, by Newton's steps, on the blocks of the composed pages."""
    xs, ys = [], []
    for page, content in sample_pages(SAMPLE_PAGES):
        own = Page(page)
        xs.append(own.features())
        ys += [float(t in content) for t in own.text]
    x, y = np.concatenate(xs), np.array(ys)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * w)
        w += step
    return w


def max_flow_sides(n: int, source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each of n nodes is on the source's side of a minimum cut (undirected edges, integer capacities)."""
    s, t = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(there)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        both = min(source[i], sink[i])
        if source[i] > both:
            join(s, i, source[i] - both, 0)
        elif sink[i] > both:
            join(i, t, sink[i] - both, 0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] == 0)
                x = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[x] < len(out[x]):
                e = out[x][turn[x]]
                if cap[e] > 0 and level[to[e]] == level[x] + 1:
                    break
                turn[x] += 1
            if turn[x] < len(out[x]):
                path.append(e)
                x = to[e]
            elif x == s:
                break
            else:
                level[x] = -1
                x = to[path.pop() ^ 1]


def main_text(page: str | None, weights: np.ndarray | None = None) -> str:
    """The main text of one page."""
    own = Page(page) if page else None
    if not own or not own.text:
        return ""
    scores = np.clip(own.features() @ (fitted() if weights is None else weights), -30, 30)
    keep, drop = ((SCALE * np.log1p(np.exp(x))).astype(int).tolist() for x in (scores, -scores))  # the costs of calling it boilerplate, and content
    edges = own.edges()
    weight = [0] * len(keep)
    for a, b, c in edges:
        weight[a] += c
        weight[b] += c
    # Settled: what its neighbours could add doesn't outweigh its own costs.
    side: list[bool | None] = [k > d if abs(k - d) > w else None for k, d, w in zip(keep, drop, weight, strict=True)]
    place = {i: n for n, i in enumerate(i for i, x in enumerate(side) if x is None)}
    if place:
        source, sink = [keep[i] for i in place], [drop[i] for i in place]
        inner = []
        for a, b, c in edges:
            if a in place and b in place:
                inner.append((place[a], place[b], c))
            elif a in place or b in place:
                free, other = (a, b) if a in place else (b, a)
                (source if side[other] else sink)[place[free]] += c
        for i, content in zip(place, max_flow_sides(len(place), source, sink, inner), strict=True):
            side[i] = content
    return "\n\n".join(t for t, content in zip(own.text, side, strict=True) if content)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    few_rows_a_batch(pages.sparkSession)
    weights = fitted()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [main_text(p, weights) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")


#: The same for pages as the tables have them: one article that holds h1, p and inline elements, and references to & and ".
HTML_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*(?:>|$)', '', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d"""
