"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

Every element that holds text has features: the density of text, links and tags in its subtree, the words of its tag, class, id
and role, its depth, and how it stands among its siblings. The classifier says how likely it holds main text. Decoding maximises the
likelihood of all choices under one condition: what lies in a dropped element is dropped. A kept element may hold dropped ones.

The words of tags and attributes are features in two forms: each word's hash in ``TOKENS`` columns, own and next above, and how many lean for
or against main text by two lists.

The classifier learns from at most ``SAMPLE`` pages of at most ``SAMPLE_BYTES`` that mark their article or main element, those of least hash. Each is learnt as it
is, and ``VARIANTS`` times with its blocks put into other page layouts (other containers, class names, side bars, notices, forms
and comments made of other pages' sentences), as one site's marks don't tell about others. The sample is a bounded number of rows, and only these
pages move; every page is extracted from its whole html.

Tags are read in one pass: open elements are counted by name, so a close tag without an open one costs nothing, and siblings are measured once per parent.

Defined cases: null or blank html, or html without text, gives an empty text; unclosed, wrongly nested and unknown tags are
taken as they come; pages are independent of each other, so repeated rows give repeated results; a table without a marked page learns from
variants of its pages' blocks; other columns are ignored.
"""

from __future__ import annotations

import collections
import html
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import table

SAMPLE, SAMPLE_BYTES, VARIANTS, SEED = 200, 1 << 20, 4, 5
#: Columns that words of tags and attributes are hashed to.
TOKENS = 16
#: Pages whose nodes are classified together.
TOGETHER = 256

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe svg math head title textarea select option button".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i img ins del kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Words of tags and attributes that speak for and against main text.
FOR = frozenset("article content main post entry story body text paragraph".split())
AGAINST = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner nav navigation menu navbar breadcrumb breadcrumbs sidebar aside side rail footer foot header masthead top bottom bar cookie cookies consent"
    " notice alert popup modal overlay share social follow comment comments reply replies respond discussion disqus related recommended more widget toolbar"
    " newsletter subscribe signup login search form copyright legal tags pagination pager skip complementary contentinfo".split()
)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: A slash that closes the tag; one at the end of an unquoted value doesn't.
CLOSED = re.compile(r"(?:^|[\s\"'])/$")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLANK = re.compile(r"\s+")
STOPS = re.compile(r"[.,;:!?]")


class Node:
    __slots__ = ("tag", "words", "parent", "items", "depth", "size", "linked", "tags", "stops", "own", "controls", "at")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None):
        self.tag, self.words, self.parent, self.items = tag, words, parent, []
        self.depth = 0 if parent is None else parent.depth + 1
        self.size = self.linked = self.tags = self.stops = self.own = self.controls = 0
        self.at = -1


def tree(text: str) -> tuple[Node, list[Node]]:
    """The elements of a page in order, as a tree of elements and strings; contents that never show are left out."""
    root = Node("root", (), None)
    nodes, now, at = [root], root, 0
    open_names: collections.Counter[str] = collections.Counter()
    last = text.rfind(">")

    def up_to(node: Node) -> Node:
        """Closes what is open down to ``node`` and ``node`` itself."""
        one = now
        while one is not node:
            open_names[one.tag] -= 1
            one = one.parent
        open_names[node.tag] -= 1
        return node.parent

    while True:
        # No tag ends behind the last bracket.
        found = TAG.search(text, at, last + 1) if at <= last else None
        if found is None and (comment := text.find("<!--", at)) >= 0:
            found = TAG.match(text, comment)
        if (found.start() if found else len(text)) > at:
            now.items.append(text[at : found.start() if found else len(text)])
        if not found:
            return root, nodes
        at = found.end()
        close, name, attributes = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
        if name is None:
            continue
        name = name.lower()
        if close:
            if open_names[name] > 0:
                open_ = now
                while open_.tag != name:
                    open_ = open_.parent
                now = up_to(open_)
            continue
        if name in CLOSES_P and open_names["p"] > 0:
            open_ = now
            while open_.tag in INLINE:
                open_ = open_.parent
            if open_.tag == "p":
                now = up_to(open_)
        if name in SAME and any(open_names[x] > 0 for x in SAME[name]):
            open_ = now
            while open_.tag not in SAME[name] and open_.tag not in HOLDS[name]:
                open_ = open_.parent
            if open_.tag in SAME[name]:
                now = up_to(open_)
        words = tuple(w.lower() for m in ATTRIBUTE.findall(attributes) for w in PART.findall("".join(m))) if "=" in attributes else ()
        node = Node(name, words, now)
        now.items.append(node)
        nodes.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(text, at)
            at = end.end() if end else len(text)
        elif name not in VOID and not CLOSED.search(attributes):
            now = node
            open_names[name] += 1


def shown(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def _measure(nodes: list[Node]) -> None:
    """Sums of each subtree, from the last element to the first."""
    hidden = set()
    for n in nodes:
        if n.tag in SKIPPED or n.parent is not None and id(n.parent) in hidden:
            hidden.add(id(n))
    for n in reversed(nodes):
        if id(n) in hidden:
            continue
        for x in n.items:
            if x.__class__ is str and (y := x.strip()):
                n.own += len(y)
                n.stops += len(STOPS.findall(y))
        n.size += n.own
        if n.tag == "a":
            n.linked = n.size
        n.tags += 1
        n.controls += n.tag in ("input", "select", "textarea", "button", "form")
        if n.parent is not None:
            p = n.parent
            p.size += n.size
            p.linked += n.linked
            p.tags += n.tags
            p.stops += n.stops
            p.controls += n.controls


def _leaning(n: Node) -> tuple[int, int]:
    words = (n.tag, *n.words)
    return sum(w in FOR for w in words), sum(w in AGAINST for w in words)


def features(nodes: list[Node]) -> tuple[list[Node], list[list[float]]]:
    """The elements with text, and a row of features for each."""
    _measure(nodes)
    used, rows, leaning = [], [], {}
    page = max(1, nodes[0].size)
    # Of each element: how many siblings it has, its place among them, and how many are of its tag.
    kin: dict[int, tuple[int, int, int]] = {id(nodes[0]): (1, 0, 1)}
    for n in nodes:
        own = [x for x in n.items if x.__class__ is Node]
        alike = collections.Counter(x.tag for x in own)
        kin.update((id(x), (len(own), i, alike[x.tag])) for i, x in enumerate(own))
    tokens: dict[int, list[int]] = {}
    for n in nodes:
        good, bad = _leaning(n)
        up_good, up_bad = leaning.get(id(n.parent), (0, 0))
        leaning[id(n)] = (up_good + good, up_bad + bad)
        own = [0] * TOKENS
        for w in (n.tag, *n.words):
            own[zlib.crc32(w.encode()) % TOKENS] = 1
        tokens[id(n)] = own
        if not n.size:
            continue
        whole = max(1, n.parent.size) if n.parent is not None else n.size
        siblings, place, alike = kin[id(n)]
        n.at = len(used)
        used.append(n)
        rows.append([
            n.depth, math.log1p(n.size), math.log1p(n.own), n.linked / n.size, n.tags / n.size, n.stops / n.size, good, bad, min(up_good, 3), min(up_bad, 3),
            siblings, place / siblings, alike / siblings, n.size / whole, n.size / page, n.controls, n.tag in INLINE, n.tag in CLOSES_P, n.tag[0] == "h" and n.tag[1:].isdigit(),
            *own, *(tokens[id(n.parent)] if n.parent is not None else [0] * TOKENS),
        ])
    return used, rows


def _decoded(used: list[Node], p: np.ndarray) -> set[int]:
    """The elements to keep: the likeliest choice in which nothing is kept inside a dropped element."""
    keep, drop = np.log(np.clip(p, 1e-6, 1)), np.log(np.clip(1 - p, 1e-6, 1))
    dropped = drop.copy()  # of the whole subtree
    kept = keep.copy()
    for n in reversed(used):
        if n.parent is not None and n.parent.at >= 0:
            dropped[n.parent.at] += dropped[n.at]
            kept[n.parent.at] += max(kept[n.at], dropped[n.at])
    out: set[int] = set()
    for n in used:
        free = n.parent is None or n.parent.at in out
        if free and (n.parent is None or kept[n.at] >= dropped[n.at]):
            out.add(n.at)
    return out


def rendered(root: Node, kept: set[int]) -> str:
    """The kept elements' text: white space is one blank within a block, and a line ends with each block."""
    blocks, now = [], []

    def end():
        if now:
            line = BLANK.sub(" ", "".join(now)).strip()
            if line:
                blocks.append(line)
            now.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif x.__class__ is str:
            now.append(shown(x))
        elif x.tag == "br":
            now.append(" ")
        elif x.tag not in SKIPPED:
            block = x.tag not in INLINE
            if block:
                end()
                stack.append(None)
            if x.at in kept:
                stack.extend(reversed(x.items))
    end()
    return "\n".join(blocks)


def _inside(n: Node, tags: tuple[str, ...]) -> bool:
    while n is not None:
        if n.tag in tags:
            return True
        n = n.parent
    return False


MAIN, OTHER = ("article", "main"), ("nav", "footer", "header", "aside", "form")


def _texts(nodes: list[Node]) -> tuple[list[str], list[str]]:
    """A page's blocks inside and outside its marked main element."""
    marked, rest = [], []
    for n in nodes:
        if n.tag in SKIPPED or _inside(n, tuple(SKIPPED)):
            continue
        text = BLANK.sub(" ", " ".join(x for x in n.items if x.__class__ is str)).strip()
        if text:
            (marked if _inside(n, MAIN) else rest).append(text)
    return marked, rest


def _variant(rng: random.Random, main: list[str], rest: list[str], others: list[str]) -> str:
    """A page of another layout: main blocks are in an element with the attribute data-main."""
    pick = lambda *x: rng.choice(x)
    some = lambda k: [rng.choice(others) for _ in range(rng.randint(1, k))]
    short = lambda: " ".join(rng.choice(rest or others).split()[: rng.randint(1, 12)])

    def links(k):
        return "".join(f'<li><a href="/x">{" ".join(short().split()[:3])}</a></li>' for _ in range(rng.randint(2, k)))

    def against(kind):
        name = rng.choice(sorted(AGAINST)) if rng.random() < 0.3 else {"menu": pick("menu", "nav", "navbar"), "side": pick("sidebar", "widget", "related"), "ad": pick("ad", "advert", "banner", "promo"), "note": pick("cookie-notice", "notice", "consent", "alert"), "comment": pick("comments", "comment-list", "reply", "discussion"), "form": pick("newsletter", "subscribe", "search"), "foot": pick("footer", "copyright", "legal")}[kind]
        mark = f' {pick("class", "id")}="{name}"'
        if kind == "menu":
            return f"<{(t := pick('nav', 'div'))}{mark if t == 'div' else ''}><ul>{links(8)}</ul></{t}>"
        if kind == "side":
            inner = pick(f"<ul>{links(8)}</ul>", "".join(f"<p>{x}</p>" for x in some(2)))
            return f"<{(t := pick('aside', 'div'))}{mark if t == 'div' else ''}><h3>{short()}</h3>{inner}</{t}>"
        if kind == "comment":
            inner = "".join(f'<{(t := pick("li", "div", "article"))} class="{pick("comment", "reply")}"><p>{x}</p></{t}>' for x in some(4))
            return f"<{(t := pick('section', 'div', 'ol'))}{mark}>{pick('', '<h3>' + short() + '</h3>')}{inner}</{t}>"
        if kind == "form":
            return f'<form{pick("", mark)}><label>{short()}</label><input type="text"><p>{short()}</p><button>{short()[:9]}</button></form>'
        if kind == "foot":
            return f"<{(t := pick('footer', 'div'))}{mark if t == 'div' else ''}>{pick('&copy; ' + short(), '<p>' + short() + '</p>')}</{t}>"
        return f"<{(t := pick('div', 'section', 'p'))}{mark}>{pick(short(), rng.choice(others))}</{t}>"

    body = "".join(f"<{(t := 'h1' if i == 0 and rng.random() < 0.8 else pick('p', 'p', 'p', 'p', 'h2', 'blockquote', 'li'))}>{pick(x, x, '<b>' + x + '</b>')}</{t}>" + (against(pick("ad", "side", "form")) if rng.random() < 0.05 else "") for i, x in enumerate(main))
    if rng.random() < 0.2:
        body += against("comment")
    box = pick("<article data-main>", "<main data-main>", '<div data-main class="content">', '<div data-main id="post-body">', '<div data-main class="entry">', "<div data-main>", "<section data-main>")
    body = f"{box}{body}</{box[1:].split()[0].rstrip('>')}>"
    if rng.random() < 0.5:
        body = f"{(w := pick('<main>', '<div>', '<div class=wrapper>'))}{body}{against(pick('side', 'ad')) if rng.random() < 0.4 else ''}</{w[1:].split()[0].rstrip('>')}>"
    head = "".join(against(k) for k in ("note", "menu", "ad") if rng.random() < 0.6)
    if rng.random() < 0.5:
        head += f"<header><h2>{short()}</h2>{against('menu') if rng.random() < 0.5 else ''}</header>"
    tail = "".join(against(k) for k in ("side", "comment", "form", "ad", "note", "foot") if rng.random() < 0.5)
    return f"<html><head><title>{short()}</title></head><body>{head}{body}{tail}</body></html>"


def _labelled(text: str, marked: bool) -> tuple[list[list[float]], list[int]]:
    """Features and labels of a page: an element is main if main text lies in it and it is not a foreign one."""
    root, nodes = tree(text)
    used, rows = features(nodes)
    if marked:
        bearing = lambda n: n.tag in MAIN
    else:
        at = text.index("data-main")
        name = re.search(r"<(\w+) data-main", text)[1]
        order = len(re.findall(rf"<{name}\b", text[:at]))
        main = [n for n in nodes if n.tag == name][order - 1]
        bearing = lambda n: n is main
    label: dict[int, int] = {}
    for n in used:
        up = label.get(id(n.parent), 0) if n.parent is not None else 0
        if bearing(n):
            label[id(n)] = 1
        else:
            foreign = n.tag in OTHER or bool(set(n.words) & AGAINST)
            label[id(n)] = int(up == 1 and not foreign)
    for n in reversed(used):
        if label[id(n)] == 1 and n.parent is not None and label.get(id(n.parent)) == 0:
            label[id(n.parent)] = 2
        elif label[id(n)] == 2 and n.parent is not None and label.get(id(n.parent)) == 0:
            label[id(n.parent)] = 2
    return rows, [int(label[id(n)] > 0) for n in used]


def learn(pages: DataFrame) -> Boosted:
    """Fits the trees to a sample of at most ``SAMPLE`` pages, chosen by a hash of their html; the hashes are chosen first, then those pages fetched."""
    hashed = pages.select("html", F.xxhash64("html").alias("h")).where(F.octet_length("html") <= SAMPLE_BYTES)
    marks = hashed.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    for some in (marks, hashed):
        chosen = [r[0] for r in some.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
        if chosen:
            break
    texts = [r[1] for r in sorted(hashed.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("html").alias("html")).collect())] if chosen else []
    rng = random.Random(SEED)
    parts = [(t, *_texts(tree(t)[1])) for t in texts]
    pool = [x for _, main, rest in parts for x in (main or rest)] or ["A sentence of main text, as good as any other, which ends here."]
    x: list[list[float]] = []
    y: list[int] = []
    for text, main, rest in parts or [("", [], [])]:
        for k in range(1 + VARIANTS):
            if k == 0 and not main:
                continue
            page = text if k == 0 else _variant(rng, main or rng.choices(pool, k=5), rest, pool)
            rows, labels = _labelled(page, k == 0)
            x += rows
            y += labels
    return Boosted().fit(np.array(x, float), np.array(y, float))


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text of each row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(model or learn(pages))

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                trees, rows = [], []
                for text in part.column("html"):
                    root, nodes = tree(text.as_py() or "")
                    used, own = features(nodes)
                    trees.append((root, used, len(rows)))
                    rows += own
                p = model.probability(np.array(rows, float)) if rows else np.zeros(0)
                texts = [rendered(root, _decoded(used, p[first : first + len(used)])) for root, used, first in trees]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
