"""Main text of web pages by minimum-cut labelling.

A page is read as blocks: runs of text between block-level tags. For each block a linear classifier
gives the cost of calling it content and of calling it boilerplate; these are the
capacities to the two terminals. Neighbouring blocks and blocks of one parent are joined by
smoothness edges. The minimum cut then splits content from boilerplate, found by maximum flow.

The classifier has two parts. One judges what a block's text is like: its links, length and sentences, its words, how
many of them the rest of the page has, its neighbours. It is fitted on a bounded sample of pages, labelled by their markup: blocks
of an article element are content, blocks of marked elements (navigation, adverts and so on) aren't. It never sees that
markup, so it judges pages without any, and what it says is bounded. The other part is fixed costs for a block's place: in an article, in a marked
element, in one whose class or id only hints at it. A name in which such a word stands beside words of a subject ("cookie-recipe", "related-work")
is in doubt: there the text decides. An article clears the marks of what is around it. So a block of an article that nothing marks stays, whatever
its text is like, and in all other places but marked ones the text and its neighbours can turn it.

Part of the sample is kept apart to choose the smoothness: the edges' capacities with which the cut, on text alone, labels
the fewest of its blocks wrongly.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import add, mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import slices, staged, table
from parley.llm.ngrams import sampled
from parley.llm.toxicity import minimise

# Fixed values of HTML: elements by their part in a page's layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style head title template svg iframe object canvas select option datalist xmp noembed noframes textarea button mphantom annotation annotation-xml".split())
#: elements of formulas, which are read as part of their line
MATH = frozenset(
    "math mrow mi mo mn ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr maction semantics annotation annotation-xml".split()
)
INLINE = MATH | frozenset(
    "script style template svg iframe object canvas select option optgroup textarea button audio video picture a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
LAYOUT = frozenset("nav footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
#: elements whose content is one line of text
LINE = frozenset("p h1 h2 h3 h4 h5 h6 dt pre caption figcaption summary".split())
#: words of class and id names that mark what isn't the article
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentform commentlist commenters cookie cookies consent disqus masthead menu modal nav navbar navigation newsletter notification pagination pager popup promo promoted respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: words that only hint at it
HINTS = frozenset("footer header notice related teaser topbar".split())
#: a name that begins with one of these says what is beside the element, or isn't there
BESIDE = frozenset("has no not with without".split())
#: words that say no more than an element's part in the layout: beside these a mark or a hint means what it says
STRUCTURE = frozenset(
    "action actions after anchor area article author avatar background bar before block body bottom box btn button buttons card cards cell center close col collapse column columns container content count dialog dismiss drop dropdown element entry error field fixed flex float form frame global grid group header heading home hidden holder icon icons image img info inline inner input item items label layer layout left level line link links list loader logo main meta mini mobile module more next notice off open outer overlay page pane panel parent placeholder policy post posts prev primary region reply right root row rows search secondary section sections segment size slot small social space spacer static sticky sub submit tab table tabs text thread thumb tile title toggle top unit view wide wrap wrapper zone".split()
)
#: words of texts that aren't the article's, where no labels tell any: notices, adverts, offers
NOTICES = frozenset(
    "advertisement advertising buy click cookie cookies copyright discount download login newsletter newsletters offer password policy privacy promo register reserved rights sale shop sign signup sponsored subscribe subscribers subscription terms unsubscribe".split()
)
#: an element that ends where one of these begins
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?…。]")


class Element:
    __slots__ = ("name", "parent", "outer", "depth", "marked", "mark", "firm", "hint", "doubt", "article", "unit", "hidden", "link", "heading")

    def __init__(self, name: str, parent: Element | None, inline: bool):
        self.name, self.parent = name, parent
        #: the innermost element around it, or itself, that isn't part of a line
        self.outer: Element = parent.outer if parent and inline else self
        #: elements from there to this one
        self.depth: int = parent.depth + 1 if parent and inline else 0
        self.marked = False  # in navigation, footers, adverts and the like, as far as no article begins inside these
        self.mark: Element | None = None  # the innermost element of that kind that it is or is in, articles aside
        self.firm = False  # whether it is such an element by more than a class, an id or a form
        self.hint = False  # the same for names that only hint at it
        self.doubt = False  # the same for names in which such a word stands beside words of a subject, as in "cookie-recipe"
        self.article = False
        self.unit: Element | None = None  # the article or main element that cleared the marks around it
        self.hidden = self.link = self.heading = False


@dataclass
class Block:
    parent: Element
    text: list[str] = field(default_factory=list)
    linked: int = 0  # characters inside links
    marked: bool = False
    told: bool = False  # whether its markup says if it is content


def blocks(page: str) -> list[tuple[str, Block]]:
    """The page's text blocks in order; comments, raw elements and hidden elements give none. Linear in the page's length."""
    root = Element("", None, False)
    stack, out = [root], []
    is_open: Counter[str] = Counter()  # open elements by name: a closing tag without one is passed over
    marks: list[Element] = []
    now: Block | None = None

    def close() -> None:
        nonlocal now
        if now:
            text = " ".join(html.unescape("".join(now.text)).split())
            if text:
                out.append((text, now))
        now = None

    def text(part: str) -> None:
        nonlocal now
        top = stack[-1]
        if top.hidden or not part:
            return
        if now is None:
            if part.isspace():
                return
            now = Block(top.outer)
        now.text.append(part)
        if top.link:
            now.linked += len(part.strip())

    def cut(i: int) -> None:
        for own in stack[i:]:
            is_open[own.name] -= 1
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            text(" ")
            continue
        # what is hidden parts no line
        inline = name in INLINE or stack[-1].hidden or (name == "noscript" and (now is not None or stack[-1].outer.name in LINE))
        if m[1]:
            if not inline:
                close()
            if is_open[name]:
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                cut(i)
            continue
        if not inline:
            close()
        if name in VOID or (name in MATH and m[3].endswith("/")):
            continue
        if not inline:
            # an open paragraph ends here, and with it what was opened inside a line
            i = len(stack) - 1 - stack[-1].depth
            top = stack[i].name
            if top in CLOSED_BY and (CLOSED_BY[top] is None or name in CLOSED_BY[top]):
                cut(i)
            elif name == "p":
                cut(i + 1)
        own = element(name, m[3], stack[-1], inline)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        stack.append(own)
        is_open[name] += 1
        if own.mark is own:
            marks.append(own)
    close()
    place(out, marks)
    return out


def place(found: list[tuple[str, Block]], marks: list[Element]) -> None:
    """Sets marked and told of the page's blocks. marks: its marked elements, outer ones before inner ones.

    * A mark around an article says nothing of the article, and of what else it holds only that it may be boilerplate.
    * But where it isn't around another article with as much text, what it holds is a comment or a teaser.
    * On a page without articles a class, an id or a form around everything says nothing."""
    size: dict[int, int] = {}
    units: dict[int, Element] = {}
    for text, block in found:
        block.marked = block.parent.marked
        if unit := block.parent.unit:
            units[id(unit)] = unit
            size[id(unit)] = size.get(id(unit), 0) + (0 if block.marked else len(text))
    around = {i: unit.parent.mark for i, unit in units.items()}
    # the longest article right inside each mark, and of those outside it but inside the next ones
    longest: dict[int, int] = {}
    for i, mark in around.items():
        longest[id(mark)] = max(longest.get(id(mark), 0), size[i])
    outside: dict[int, int] = {id(None): 0}
    for mark in marks:
        outer = id(mark.parent.mark)
        outside[id(mark)] = max(outside[outer], longest.get(outer, 0))
    beside = {i for i, mark in around.items() if mark and outside[id(mark)] >= max(1, size[i])}
    wraps: set[int] = set()
    for i, mark in around.items():
        while i not in beside and mark and id(mark) not in wraps:
            wraps.add(id(mark))
            mark = mark.parent.mark
    if not units:
        holds: dict[int, int] = {}
        for _, block in found:
            holds[id(block.parent.mark)] = holds.get(id(block.parent.mark), 0) + 1
        for mark in reversed(marks):
            outer = id(mark.parent.mark)
            holds[outer] = holds.get(outer, 0) + holds.get(id(mark), 0)
        wraps = {id(mark) for mark in marks if holds.get(id(mark)) == len(found) and not mark.firm}
    for _, block in found:
        top = block.parent
        if top.unit:
            block.marked = block.marked or id(top.unit) in beside
        elif not units:
            block.marked = block.marked and id(top.mark) not in wraps
        block.told = block.marked and (top.unit is not None or id(top.mark) not in wraps) or (top.article and not top.hint and not top.doubt)


def named(value: str) -> tuple[bool, bool, bool]:
    """Whether a class or id marks an element, whether it hints at it, and whether it has such a word, but beside words that aren't of the layout."""
    marks = hints = doubt = False
    for name in value.split():
        words = _WORDS.findall(name)
        if not words or words[0] in BESIDE:
            continue
        mark, hint = not MARKS.isdisjoint(words), not HINTS.isdisjoint(words)
        if mark or hint:
            if all(w in MARKS or w in HINTS or w in STRUCTURE or len(w) < 2 for w in words):
                marks, hints = marks or mark, hints or hint
            else:
                doubt = True
    return marks, hints, doubt


def element(name: str, attributes: str, parent: Element, inline: bool) -> Element:
    own = Element(name, parent, inline)
    firm = (name in LAYOUT and name != "form") or (name == "header" and not parent.article)
    loose, hint, doubt, hidden = name == "form" or (name == "noscript" and not inline), False, False, name in HIDDEN
    if "=" in attributes or "hidden" in attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            key = key.lower()
            if key in ("class", "id") and name not in ("html", "body", "article", "main"):
                marks, hints, doubts = named(value)
                loose, hint, doubt = loose or marks, hint or hints, doubt or doubts
            elif key == "role":
                firm = firm or value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "menu")
            elif key == "hidden" or (key == "style" and "display:none" in value.replace(" ", "")):
                hidden = True
    # an article inside an article is a part of it, such as a reader's comment
    begins = name in ARTICLE and (not parent.unit or (name == "article" and parent.unit.name == "main"))
    own.marked, own.firm = firm or loose or (parent.marked and not begins), firm
    own.hint, own.doubt = hint or (parent.hint and not begins), doubt or (parent.doubt and not begins)
    own.mark = own if firm or loose else parent.mark
    own.article, own.unit = name in ARTICLE or parent.article, own if begins else parent.unit
    own.hidden, own.link = hidden or parent.hidden, name == "a" or parent.link
    own.heading = name in ("h1", "h2", "h3", "h4", "h5", "h6") or (inline and parent.heading)
    return own


#: Costs of a block's place (fixed values): in a marked element; in one with a hint; in one whose mark is in doubt; in an article; outside of
#: the page's articles; on a page without any where others are marked; on a page that is one block.
MARKED, HINTED, DOUBTED, IN_ARTICLE, OUTSIDE, UNMARKED, ALONE = -10.0, -9.0, -3.0, 5.0, -1.0, 2.5, 5.0
#: What a block's text says counts for no more than this, either way: less than an article that nothing marks, more than a mark in doubt leaves of it.
EVIDENCE = 4.0
#: Weights of text_features() that the fit starts from and is drawn to, and without labels uses (fixed values).
PRIOR = (-2.0, -4.0, 0.6, 1.0, 0.5, 2.0, 1.5, 0.5)
#: Capacities of the smoothness edges to choose from: to the next block, and to the next block of the same parent.
SMOOTH = ((0.5, 1.5), (0.0, 0.0), (0.25, 0.5), (0.5, 0.5), (1.0, 1.0), (1.0, 2.0), (2.0, 2.0))
#: words that the model knows, at the most
WORDS = 20_000


@dataclass
class Model:
    weights: tuple[float, ...] = PRIOR
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(NOTICES, -2.0))
    smooth: tuple[float, float] = SMOOTH[0]


def text_features(found: list[tuple[str, Block]], words: dict[str, float]) -> list[list[float]]:
    """Of each block of a page: one, share of links, length, has a sentence's end, is a heading, share of its words that other blocks
    of the page have too, what its words say on average, length of its neighbours. words: by word, the log-odds of content."""
    own = [set(text.lower().split()) for text, _ in found]
    has = Counter(w for ws in own for w in ws)
    length = [min(4.0, math.log1p(len(text) / 20)) for text, _ in found]
    around = [0.0, *length, 0.0]
    out = []
    for i, (text, block) in enumerate(found):
        shared = sum(1 for w in own[i] if has[w] > 1) / len(own[i])
        said = sum(words[w] for w in own[i] if w in words) / len(own[i])
        out.append([1.0, min(1.0, block.linked / len(text)), length[i], float(bool(_SENTENCE.search(text))), float(block.parent.heading), shared, said, (around[i] + around[i + 2]) / 2])
    return out


def place_costs(found: list[tuple[str, Block]]) -> list[float]:
    articles, marks = any(b.parent.article for _, b in found), any(b.marked for _, b in found)
    plain = ALONE if len(found) == 1 else OUTSIDE if articles else UNMARKED if marks else 0.0
    titled = lambda e: e.heading and e.article  # an article's own title may stand in its header
    doubts = lambda e: 0.0 if titled(e) else HINTED if e.hint else DOUBTED if e.doubt else 0.0
    return [MARKED if b.marked else doubts(b.parent) + (IN_ARTICLE if b.parent.article else plain) for _, b in found]


def is_content(block: Block) -> bool:
    """What a told block's markup says."""
    return block.parent.article and not block.marked


def word_odds(rows: list[tuple[bool, list[str]]], least: int = 5) -> dict[str, float]:
    """Log-odds of content (-3 to 3) of words in at least `least` blocks, and of the notices' words where these are in fewer."""
    content, other = Counter(), Counter()
    for label, words in rows:
        (content if label else other).update(words)
    n, m = sum(label for label, _ in rows) + 2, sum(not label for label, _ in rows) + 2
    odds = {w: max(-3.0, min(3.0, math.log((content[w] + 1) / n) - math.log((other[w] + 1) / m))) for w in content | other if content[w] + other[w] >= least}
    kept = sorted((w for w in odds if abs(odds[w]) >= 0.5), key=lambda w: (-abs(odds[w]) * (content[w] + other[w]), w))[:WORDS]
    return {w: -2.0 for w in NOTICES if w not in odds} | {w: odds[w] for w in kept}


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 60) -> tuple[float, ...]:
    """Logistic weights of text features x for labels y, with a Gaussian prior about PRIOR: without rows these are the weights."""
    prior = np.array(PRIOR)

    def loss(off: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ (prior + off)
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        return float(np.logaddexp(0, z).sum() - y @ z + penalty / 2 * (off @ off)), x.T @ error + penalty * off

    return tuple((prior + minimise(loss, np.zeros(len(prior)), steps)).tolist())


def labelled(per_page: int):
    """Text features (without what words say), label and words of up to per_page blocks of each page, evenly spread over those
    whose markup tells a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                rows = []
                for h, page in zip(part.column("h").to_pylist(), part.column("html").to_pylist(), strict=True):
                    found = blocks(page)
                    told = [(h, x, is_content(b), sorted(set(text.lower().split()))) for x, (text, b) in zip(text_features(found, {}), found, strict=True) if b.told]
                    rows += told[:: -(-len(told) // per_page) or 1]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                types = (pa.int64(), pa.list_(pa.float64()), pa.bool_(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["h", "x", "y", "words"])

    return run


TRIAL = "setting int, wrong bigint, alone bigint, turned bigint, told bigint"


def tried(model: Model):
    """For each setting of SMOOTH and page, on text alone: told blocks that are labelled wrongly with the cut and without it, those that
    the cut turns, and all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                rows = []
                for page in part.column("html").to_pylist():
                    found = blocks(page)
                    odds = text_odds(found, model)
                    told = [(i, is_content(b)) for i, (_, b) in enumerate(found) if b.told]
                    for setting, smooth in enumerate(SMOOTH):
                        cut = labels(found, odds, smooth)
                        rows.append((setting, sum(cut[i] != y for i, y in told), sum((odds[i] >= 0) != y for i, y in told), sum(cut[i] != (odds[i] >= 0) for i, _ in told), len(told)))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 4), strict=True)], [c.split()[0] for c in TRIAL.split(", ")])

    return run


def trials(pages: DataFrame, model: Model) -> list[dict]:
    """The sums of tried() over pages (html), by setting."""
    found = pages.select("html").mapInArrow(tried(model), TRIAL).groupBy("setting").agg(*(F.sum(c).alias(c) for c in ("wrong", "alone", "turned", "told")))
    return sorted((r.asDict() for r in found.collect()), key=lambda r: r["setting"])


def learn(pages: DataFrame, max_pages: int = 1000, per_page: int = 50) -> Model:
    """The classifier and the smoothness, from at most about max_pages pages (equal ones count once) and per_page blocks of each: a third
    of these pages tells the words' odds, a third the weights, a third the smoothness. Without labels all are the stated ones."""
    own = pages.select(F.coalesce("html", F.lit("")).alias("html")).withColumn("h", F.xxhash64("html"))
    total = own.count()
    if not total:
        return Model()
    # copies of a page fall together before the shuffle
    chosen = own.where(sampled(F.col("h"), F.lit(min(1.0, max_pages / total)))).groupBy("h").agg(F.first("html").alias("html"))
    chosen = staged(chosen, "sample-pages").withColumn("part", F.pmod(F.xxhash64("h", F.lit("part")), F.lit(3)))
    got = chosen.where("part < 2").select("h", "html").mapInArrow(labelled(per_page), "h bigint, x array<double>, y boolean, words array<string>")
    rows = got.withColumn("part", F.pmod(F.xxhash64("h", F.lit("part")), F.lit(3))).toArrow()
    rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("part", "h", "x", "y", "words")), strict=True))
    words = word_odds([(y, ws) for part, _, _, y, ws in rows if part == 0])
    mine = [(x[:6] + [sum(words.get(w, 0.0) for w in ws) / len(ws)] + x[7:], y) for part, _, x, y, ws in rows if part == 1]
    model = Model(fit(np.array([x for x, _ in mine]).reshape(-1, len(PRIOR)), np.array([y for _, y in mine], np.float64)), words)
    results = trials(chosen.where("part = 2"), model)
    if any(r["told"] for r in results):
        model.smooth = SMOOTH[min(results, key=lambda r: (r["wrong"], r["setting"]))["setting"]]
    return model


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut: Dinic's maximum flow.

    source and sink: capacities of the nodes to the terminals; edges work in both directions."""
    n = len(source)
    # what flows straight through a node is settled at once; the rest has one terminal each
    left = [a - b for a, b in zip(source, sink, strict=True)]
    links: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, c in edges:
        for x, y in ((a, b), (b, a)):
            links[x].append(len(to))
            to.append(y)
            room.append(c)
    tiny = 1e-12

    def levels() -> list[int]:
        level = [0 if e > tiny else -1 for e in left]
        queue = deque(i for i in range(n) if level[i] == 0)
        while queue:
            x = queue.popleft()
            for e in links[x]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        return level

    while True:
        level = levels()
        if not any(level[i] > 0 and left[i] < -tiny for i in range(n)):
            return [x >= 0 for x in level]
        tried = [0] * n
        for start in range(n):
            path: list[int] = []
            x = start
            while left[start] > tiny:
                if left[x] < -tiny and path:
                    amount = min(left[start], -left[x], *(room[e] for e in path))
                    for e in path:
                        room[e] -= amount
                        room[e ^ 1] += amount
                    left[start] -= amount
                    left[x] += amount
                    path, x = [], start
                    continue
                while tried[x] < len(links[x]):
                    e = links[x][tried[x]]
                    if room[e] > tiny and level[to[e]] == level[x] + 1:
                        break
                    tried[x] += 1
                else:
                    if not path:
                        break
                    x = to[path.pop() ^ 1]
                    tried[x] += 1
                    continue
                path.append(e)
                x = to[e]


def text_odds(found: list[tuple[str, Block]], model: Model) -> list[float]:
    """Log-odds of content by the text alone, drawn in to EVIDENCE at the most."""
    return [EVIDENCE * math.tanh(sum(map(mul, model.weights, x)) / EVIDENCE) for x in text_features(found, model.words)]


def labels(found: list[tuple[str, Block]], odds: list[float], smooth: tuple[float, float]) -> list[bool]:
    """Which blocks the minimum cut calls content."""
    after, sibling = smooth
    edges = [(i, i + 1, after) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, (_, block) in enumerate(found):
        parent = block.parent.parent or block.parent
        if (j := last.get(id(parent))) is not None:
            edges.append((j, i, sibling))
        last[id(parent)] = i
    return minimum_cut([max(0.0, o) for o in odds], [max(0.0, -o) for o in odds], edges)


def main_text(page: str, model: Model) -> str:
    """The page's content blocks, joined by an empty line."""
    found = blocks(page)
    if not found:
        return ""
    content, _ = decided(found, model)
    return "\n\n".join(text for (text, _), keep in zip(found, content, strict=True) if keep)


def decided(found: list[tuple[str, Block]], model: Model) -> tuple[list[bool], list[bool]]:
    """Which blocks are content by the cut, and by their own costs without it."""
    odds = list(map(add, text_odds(found, model), place_costs(found)))
    return labels(found, odds, model.smooth), [o >= 0 for o in odds]


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages (page_id, url, html); model as from learn().

    A null or empty page, or one without text, has the empty text; a page that is one block that nothing marks, as plain text without a tag is, is that block. Repeated rows each get a row, other columns
    are ignored, null ids and addresses stay null, an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                text = [main_text(p, model) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return own.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages))
