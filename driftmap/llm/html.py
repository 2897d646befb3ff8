"""Main text of web pages by a tree-structured graphical model.

The elements of a page are the nodes of a tree. Each has a state, content or not,
with a potential from its own features (tag, what its class and id say, links,
place beside the main element) and one from the states of it and its parent. Two
passes of messages, from the leaves up and from the root down, give the exact
marginal of every node; the blocks of nodes that are content make the text. The
potentials are the maximum of the likelihood of labelled pages: a sample of the
given pages whose main element labels them, and layouts with known labels.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages to learn from: of the given ones, and layouts with known labels.
SAMPLE_PAGES, LAYOUT_PAGES = 100, 600
ROUNDS, STEP, DECAY = 16, 0.5, 1e-3

# Names of elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())
#: No text of the page: code, the head, values of controls.
SKIPPED = RAW | set("head template select option optgroup datalist".split())
#: End at the next block, if they are left open.
NO_BLOCKS = {"button", "label", "select", "datalist"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "math semantics annotation mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mfenced".split()
)
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
              "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
HINTS = re.compile(
    r"(?P<nav>nav|menu|breadcrumb|toc\b|paginat|pager)|(?P<head>header|masthead|topbar|banner)|(?P<foot>footer|copyright|colophon|contentinfo)"
    r"|(?P<side>sidebar|aside|widget|complementary|rail)|(?P<ad>\bads?\b|advert|sponsor|promo|doubleclick|adsense)"
    r"|(?P<notice>notice|cookie|consent|gdpr|alert|popup|modal|overlay|disclaimer|message-bar)|(?P<comment>comment|disqus|repl(?:y|ies)|respond|discussion)"
    r"|(?P<form>form|search|login|signup|newsletter|subscri)|(?P<share>share|social|related|recommend|teaser|tags?\b|byline|author-bio)"
    r"|(?P<hidden>\bhidden\b|display:\s*none|visually|sr-only)|(?P<main>article|content|post\b|entry|story|main|body|text)"
)
NOISE_TAGS = {"nav", "header", "footer", "aside", "form"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|style|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\s(hidden)\b")


@dataclass
class Page:
    """Nodes in document order, so a parent comes before its children; blocks are (node, text)."""

    tags: list[str] = field(default_factory=list)
    hints: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)

    def add(self, tag: str, attributes: str, parent: int) -> int:
        said = " ".join(next(filter(None, m.groups()[1:]), "") for m in _ATTRIBUTE.finditer(attributes)) if attributes else ""
        self.tags.append(tag)
        self.hints.append(said.lower())
        self.parents.append(parent)
        self.chars.append(0)
        self.links.append(0)
        return len(self.tags) - 1


def parsed(source: str) -> Page:
    """The tree of a page, as far as it goes: end tags may be missing or too many, the end may be cut off."""
    page = Page()
    page.add("#root", "", -1)
    stack = [(0, "#root")]
    #: Places in the stack of each open tag, and of all that are no inline tags.
    where: dict[str, list[int]] = defaultdict(list)
    blocks_open = [0]
    skipped = in_link = at = 0
    run: list[str] = []
    owner = 0

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                page.blocks.append((owner, text))
            run.clear()

    def text(piece: str) -> None:
        nonlocal owner
        if not piece or skipped:
            return
        node = stack[-1][0]
        if not run:
            owner = node
        run.append(piece)
        size = len(piece.strip())
        page.chars[node] += size
        if in_link:
            page.links[node] += size

    def close(depth: int) -> None:
        nonlocal skipped, in_link
        while len(stack) > depth:
            _, name = stack.pop()
            where[name].pop()
            skipped -= name in SKIPPED and name != "title"
            in_link -= name == "a"
            if name not in INLINE:
                blocks_open.pop()
                flush()

    def push(node: int, tag: str) -> None:
        where[tag].append(len(stack))
        if tag not in INLINE:
            blocks_open.append(len(stack))
        stack.append((node, tag))

    def lowest(tags) -> int:
        return min((where[t][0] for t in tags if where.get(t)), default=0)

    while True:
        m = _TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if where.get(tag):
                close(where[tag][-1])
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            if run:
                run.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            if stack[blocks_open[-1]][1] == "p":
                close(blocks_open[-1])
            if open_control := lowest(NO_BLOCKS):
                close(open_control)
        if tag in SAME_LEVEL:
            shut, scope = SAME_LEVEL[tag]
            top = max((where[t][-1] for t in (*scope, *shut) if where.get(t)), default=0)
            if top and stack[top][1] not in scope:
                close(top)
        if tag == "body" and skipped:
            if where.get("head"):
                close(where["head"][0])
        if tag not in INLINE:
            flush()
        node = page.add(tag, m[3], stack[-1][0]) if tag not in INLINE or "class" in m[3] or "id=" in m[3] else stack[-1][0]
        if tag == "xmp":
            end = re.compile(r"(?i)</xmp\b[^>]*>?").search(source, at)
            push(node, tag)
            text(html.escape(source[at:end.start() if end else len(source)]))
            at = end.end() if end else len(source)
            close(len(stack) - 1)
            continue
        if tag in RAW and not (tag == "title" and where.get("svg")):
            end = re.compile(rf"(?i)</{re.escape(tag)}\b[^>]*>?").search(source, at)
            at = end.end() if end else len(source)
            continue
        push(node, tag)
        skipped += tag in SKIPPED and tag != "title"
        in_link += tag == "a"
    close(1)
    flush()
    return page


def node_features(page: Page) -> list[list[str]]:
    """Names of what holds for each node."""
    count = len(page.tags)
    chars, links = page.chars[:], page.links[:]
    for i in range(count - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
        links[page.parents[i]] += links[i]
    tops = {"article", "main"}
    mains = [i for i in range(count) if page.tags[i] == "article"] or [i for i in range(count) if page.tags[i] in tops]
    inside, above = [False] * count, [False] * count
    for i in mains:
        inside[i] = True
        while i >= 0 and not above[i]:
            above[i] = True
            i = page.parents[i]
    out = []
    for i in range(count):
        parent = page.parents[i]
        if parent >= 0 and inside[parent]:
            inside[i] = True
        # a form around the main element, or around most of a page without one, is only a wrapper
        wraps = page.tags[i] == "form" and (above[i] and not inside[i] if mains else 2 * chars[i] >= chars[0])
        own = ["tag:div" if wraps else "tag:" + page.tags[i]]
        own += sorted({f"hint:{m.lastgroup}" for m in HINTS.finditer(page.hints[i])})
        if mains:
            own.append("inside" if inside[i] else "above" if above[i] else "beside")
        if chars[i]:
            own.append(f"linked:{min(3, 4 * links[i] // chars[i])}")
        out.append(own)
    return out


@dataclass
class Model:
    """Potentials of the state content against not content, of features and of (parent, child) states."""

    unary: dict[str, float]
    pair: list[list[float]]


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def marginals(page: Page, features: list[list[str]], model: Model) -> tuple[list[float], list[list[float]]]:
    """Probability of content of each node, and the summed probabilities of (parent, child) states."""
    count, pair = len(features), model.pair
    own = [sum(model.unary.get(f, 0.0) for f in names) for names in features]
    up0, up1 = [0.0] * count, own[:]  # a node's potential and the messages of its children
    to0, to1 = [0.0] * count, [0.0] * count  # the message of a node to its parent
    for i in range(count - 1, 0, -1):
        to0[i] = _log_sum(pair[0][0] + up0[i], pair[0][1] + up1[i])
        to1[i] = _log_sum(pair[1][0] + up0[i], pair[1][1] + up1[i])
        p = page.parents[i]
        up0[p] += to0[i]
        up1[p] += to1[i]
    content, joint = [0.0] * count, [[0.0, 0.0], [0.0, 0.0]]
    down0, down1 = [0.0] * count, [0.0] * count
    for i in range(count):
        p = page.parents[i]
        if p >= 0:
            rest0, rest1 = down0[p] + up0[p] - to0[i], down1[p] + up1[p] - to1[i]
            logs = [rest0 + pair[0][0] + up0[i], rest0 + pair[0][1] + up1[i], rest1 + pair[1][0] + up0[i], rest1 + pair[1][1] + up1[i]]
            top = max(logs)
            weights = [math.exp(x - top) for x in logs]
            total = sum(weights)
            for k, w in enumerate(weights):
                joint[k >> 1][k & 1] += w / total
            down0[i] = _log_sum(rest0 + pair[0][0], rest1 + pair[1][0])
            down1[i] = _log_sum(rest0 + pair[0][1], rest1 + pair[1][1])
        x = down0[i] + up0[i] - down1[i] - up1[i]
        content[i] = 1 / (1 + math.exp(min(700.0, x)))
    return content, joint


def fitted(pages: list[tuple[Page, list[int]]]) -> Model:
    """Potentials of the highest likelihood (steps by gradient, scaled per potential) of labelled pages."""
    model = Model({}, [[0.0, 0.0], [0.0, 0.0]])
    squares: dict[str, float] = {}
    pair_squares = [[1e-6, 1e-6], [1e-6, 1e-6]]
    prepared = [(page, node_features(page), labels) for page, labels in pages]
    for _ in range(ROUNDS):
        for page, features, labels in prepared:
            content, joint = marginals(page, features, model)
            slope: dict[str, float] = {}
            for names, p, label in zip(features, content, labels, strict=True):
                for f in names:
                    slope[f] = slope.get(f, 0.0) + label - p
            for f, g in slope.items():
                g -= DECAY * model.unary.get(f, 0.0)
                squares[f] = squares.get(f, 1e-6) + g * g
                model.unary[f] = model.unary.get(f, 0.0) + STEP * g / math.sqrt(squares[f])
            for i in range(1, len(labels)):
                joint[labels[page.parents[i]]][labels[i]] -= 1
            for a in (0, 1):
                for b in (0, 1):
                    pair_squares[a][b] += joint[a][b] ** 2
                    model.pair[a][b] -= STEP * (joint[a][b] + DECAY * model.pair[a][b]) / math.sqrt(pair_squares[a][b])
    return model


def _below(page: Page, roots: list[bool]) -> list[bool]:
    out = roots[:]
    for i in range(1, len(out)):
        out[i] = out[i] or out[page.parents[i]]
    return out


def labelled_by_main(source: str) -> tuple[Page, list[int]] | None:
    """A page with an article: what neither leads to it nor stands in it is no content, nor what says so inside."""
    page = parsed(source)
    features = node_features(page)
    if not any("inside" in names for names in features):
        return None
    noise = [("beside" in names) or (tag in NOISE_TAGS and f"tag:{tag}" in names and "above" not in names) or tag in SKIPPED for names, tag in zip(features, page.tags, strict=True)]
    return page, [int(not x) for x in _below(page, noise)]


def layout(rng: random.Random) -> tuple[Page, list[int]]:
    """A page of a random layout; what is no content carries ``label-0`` as its first class, which is taken off."""
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("bcdfglmnprst") for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(rng.randint(3, n))) + "."
    links = lambda: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(rng.randint(2, 7)))

    def noise() -> str:
        if rng.random() < 0.04:
            return f'<button class="label-0">{word()}</button>'
        kind = rng.choice([
            ("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", ""), ("div", "sidebar"), ("div", "side-bar widget"), ("div", "ad"), ("div", "ads"),
            ("div", "advert"), ("div", "sponsored promo"), ("div", "cookie-notice"), ("div", "notice"), ("div", "consent alert"), ("section", "comments"),
            ("div", "comment-list"), ("ol", "commentlist"), ("div", "replies"), ("div", "newsletter-signup"), ("div", "share social"), ("div", "related"),
            ("ul", "menu"), ("div", "breadcrumbs"), ("div", "footer"), ("div", "header"), ("div", "nav"), ("div", "search-form"), ("div", "popup modal"),
            ("section", "user-comments"), ("ul", "pagination"), ("div", "disclaimer"), ("p", "notice"), ("p", "ad"), ("div", "comment"),
        ])
        body = rng.choice([lambda: f"<ul>{links()}</ul>", lambda: f"<p>{prose(20)}</p>" * rng.randint(1, 3), lambda: prose(15), lambda: f"<h1>{prose(4)}</h1>", lambda: f"<h1>{prose(4)}</h1><p>{prose(9)}</p>", lambda: f"<h3>{prose(4)}</h3><div><p>{prose(30)}</p></div>"])()
        if kind[0] in ("ol", "ul"):
            body = "".join(f"<li>{prose(12)}</li>" for _ in range(3))
        if kind[0] == "p":
            body = prose(12)
        how = rng.choice(["class", "id"])
        mark = f' class="label-0 {kind[1]}"' if how == "class" or not kind[1] else f' class="label-0" id="{kind[1]}"'
        return f"<{kind[0]}{mark}>{body}</{kind[0]}>"

    def content() -> str:
        kind = rng.choice(["p", "p", "p", "h2", "ul", "blockquote", "pre", "table", "figure", "div", "section", "dl", "linked"])
        return {
            "p": lambda: f"<p>{prose(40)} <b>{word()}</b></p>", "h2": lambda: f"<h2>{prose(6)}</h2>", "ul": lambda: f"<ul><li>{prose(9)}</li><li>{prose(9)}</li></ul>",
            "blockquote": lambda: f"<blockquote><p>{prose(20)}</p></blockquote>", "pre": lambda: f"<pre>{prose(9)}</pre>",
            "table": lambda: f"<table><tr><th>{word()}</th><td>{prose(4)}</td></tr></table>", "figure": lambda: f"<figure><figcaption>{prose(8)}</figcaption></figure>",
            "div": lambda: f"<div><p>{prose(30)}</p></div>", "section": lambda: f"<section><h3>{prose(5)}</h3><p>{prose(30)}</p></section>",
            "dl": lambda: f"<dl><dt>{word()}</dt><dd>{prose(6)}</dd></dl>", "linked": lambda: f'<p>{prose(12)} <a href="/x">{word()}</a> {prose(6)}</p>',
        }[kind]()

    inner = [f"<h1>{prose(7)}</h1>", *(content() for _ in range(rng.randint(1, 7)))]
    for _ in range(rng.randint(0, 2)):
        inner.insert(rng.randint(1, len(inner)), noise())
    body = "".join(inner)
    tag, mark = rng.choice([("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry-content"), ("div", "main"), ("div", ""), ("", "")])
    if tag:
        body = f'<{tag} class="{mark}">{body}</{tag}>'
    if tag == "article" and rng.random() < 0.4:
        body = f"<main>{body}</main>"
    outer = [noise() for _ in range(rng.randint(0, 3))] + [body] + [noise() for _ in range(rng.randint(0, 3))]
    if tag in ("article", "main") and rng.random() < 0.3:
        outer.insert(0, f'<div class="label-0"><p>{prose(12)}</p></div>')
    body = "".join(outer)
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(["page", "wrapper", "container"])}">{body}</div>'
    if rng.random() < 0.2:
        deep = rng.randint(2, 40)
        body = "<div>" * deep + body + "</div>" * deep
    if rng.random() < 0.1:
        body = f'<form action="/{word()}">{body}</form>'
    page = parsed(f"<html><head><title>{prose(5)}</title></head><body>{body}</body></html>" if rng.random() < 0.8 else body)
    roots = ["label-0" in h or t in SKIPPED for h, t in zip(page.hints, page.tags, strict=True)]
    page.hints = [h.replace("label-0", "").strip() for h in page.hints]
    return page, [int(not x) for x in _below(page, roots)]


def main_text(source: str | None, model: Model) -> str:
    """Blocks of content in their order, one per line; empty if there is none."""
    page = parsed(source or "")
    content, _ = marginals(page, node_features(page), model)
    return "\n".join(text for node, text in page.blocks if content[node] >= 0.5)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without content, give an empty text. Character
    references are decoded and white space within a block is one space. Repeated
    rows are read each; rows without id stay. Other columns are not read. Without
    any page to learn from, the layouts alone are. An empty table gives no rows.
    """
    # the html of a fixed number of different pages: their hashes are chosen first, so no other page goes to the driver
    hashed = pages.where("html IS NOT NULL").select("html", F.xxhash64(F.lit(10), F.col("html")).alias("h"))
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    sample = hashed.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect() if least else []
    learnt = [x for row in sample if (x := labelled_by_main(row["html"]))]
    rng = random.Random(10)
    learnt += [layout(rng) for _ in range(LAYOUT_PAGES)]
    rng.shuffle(learnt)
    held = pages.sparkSession.sparkContext.broadcast(fitted(learnt))

    def read(batches):
        model = held.value
        for batch in batches:
            texts = [main_text(x, model) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
            ], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")
