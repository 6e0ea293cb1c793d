"""Main text of web pages by sum-product inference over the page's tree.

The graph is the tree of block elements (and of inline ones that carry a class, id or role). Each node is content (it holds
some) or not. A node's
own potential comes from the words of its class, id and role and from its own text's link share; an edge's from how often a child of that kind of tag is content under content, and under the rest. Messages go up once and
down once, which on a tree gives exact marginals; text belongs to its nearest node and stays if that node's content marginal
is at least one half.

All potentials are smoothed counts over labelled pages: ``labelled_pages`` writes them, a fixed number of varied layouts whose
blocks are labelled by construction (no page of the table is looked at). Scripts, styles, templates, forms and their controls
hold no text; formulas, drawings, media and what stands in for them are judged as all else is.

Defined cases: a null or empty html, and a page without content, gives an empty text; unclosed and stray tags are closed as
browsers do for paragraphs, items and cells; repeated rows each get their row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED, SEED = 400, 11

# Fixed lists of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style head template form button select textarea input".split())
RAW = ("script", "style", "textarea", "title", "template")
BLOCK = set("html body article aside section nav header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption address details summary dialog menu hgroup fieldset center".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS_P = BLOCK - {"html", "body"}

_TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WHITE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    words: tuple[str, ...] = ()
    parent: int = -1
    block: bool = True
    text: int = 0
    linked: int = 0
    children: list[int] = field(default_factory=list)


def parse(page: str) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """Nodes in page order, and text runs as (block number, node, text). A new block number begins wherever a block opens or closes."""
    nodes, runs, block, at, n = [Node("root")], [], 0, 0, len(page)
    stack: list[tuple[str, int, bool]] = [("root", 0, False)]  # tag, node, silent
    links = 0
    opened: Counter[str] = Counter()  # so that a stray end tag needs no look at the stack

    def text(upto: int) -> None:
        if upto > at and not stack[-1][2]:
            t = entities.unescape(page[at:upto])
            if t:
                runs.append((block, stack[-1][1], t))
                size = len(t.strip())
                nodes[stack[-1][1]].text += size
                if links:
                    nodes[stack[-1][1]].linked += size

    def close(i: int) -> None:
        nonlocal block, links
        for tag, _, _ in stack[i:]:
            block += tag in BLOCK
            links -= tag == "a"
            opened[tag] -= 1
        del stack[i:]

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(n)
            break
        text(m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in ("table", "article", "body") and tag not in BLOCK:
                    break
            continue
        if tag == "br" or tag == "hr":
            if not stack[-1][2]:
                runs.append((block, stack[-1][1], " "))
            block += tag == "hr"
            continue
        if tag in VOID:
            continue
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        for i in range(len(stack) - 1 if ends else 0, 0, -1):
            if stack[i][0] in ends:
                close(i)
                if tag != "tr":
                    break
            elif stack[i][0] in BLOCK:
                break
        node = stack[-1][1]
        words = tuple(w.lower() for a in _ATTR.findall(m[3]) for w in _WORD.findall(a[1] or a[2] or a[3])) if m[3] else ()
        if tag in BLOCK or words:
            nodes.append(Node(tag, words, node, tag in BLOCK))
            nodes[node].children.append(len(nodes) - 1)
            node = len(nodes) - 1
        block += tag in BLOCK
        links += tag == "a"
        opened[tag] += 1
        stack.append((tag, node, stack[-1][2] or tag in SILENT))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            if stack[-1][2] is False:
                stack[-1] = (tag, node, True)
            at = end.start() if end else n
    return nodes, runs


def features(node: Node) -> list[str]:
    out = [f"tag={node.tag}", *(f"word={w}" for w in set(node.words))]
    if node.text:
        out.append(f"link={int(3 * node.linked / node.text)}")
    return out


@dataclass(frozen=True)
class Model:
    own: dict[str, float]  # a feature's log odds of content
    edge: dict[str, tuple[float, float]]  # by tag, P(content) under a parent that isn't, and under one that is
    default: tuple[float, float]
    root: float = 0.0  # the page's log odds of holding content

    def marginals(self, nodes: list[Node]) -> list[float]:
        n = len(nodes)
        own = [max(-12.0, min(12.0, sum(self.own.get(f, 0.0) for f in features(x)))) for x in nodes]
        own[0] += self.root
        phi = [(1.0, math.exp(v)) for v in own]
        up = [(1.0, 1.0)] * n  # from node to its parent, by the parent's state
        inside = list(phi)  # own potential times what the children say
        edges = [self.edge.get(x.tag, self.default) for x in nodes]
        for i in range(n - 1, 0, -1):  # children come after parents
            a, b = inside[i]
            q0, q1 = edges[i]
            m0, m1 = a * (1 - q0) + b * q0, a * (1 - q1) + b * q1
            up[i] = (m0 / (m0 + m1), m1 / (m0 + m1))
            p = nodes[i].parent
            x, y = inside[p][0] * up[i][0], inside[p][1] * up[i][1]
            inside[p] = (x / (x + y), y / (x + y))
        belief = [(0.0, 0.0)] * n
        belief[0] = inside[0]
        for i in range(1, n):
            x, y = belief[nodes[i].parent]
            x, y = x / max(up[i][0], 1e-300), y / max(up[i][1], 1e-300)  # the parent without what this node told it
            s = x + y
            q0, q1 = edges[i]
            a, b = inside[i][0] * (x * (1 - q0) + y * (1 - q1)) / s, inside[i][1] * (x * q0 + y * q1) / s
            belief[i] = (a / (a + b), b / (a + b))
        return [b for _, b in belief]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, runs = parse(page)
        keep = [p >= 0.5 for p in self.marginals(nodes)]
        blocks: dict[int, list[str]] = {}
        for block, node, text in runs:
            if keep[node]:
                blocks.setdefault(block, []).append(text)
        joined = (_WHITE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
        return "\n".join(t for t in joined if t)


def labelled_pages(count: int = LABELLED, seed: int = SEED):
    """(html, set of labels): content blocks' text begins with C, all other text with N."""
    rng = random.Random(seed)
    say = lambda mark, low, high: f"{mark}" + " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(low, high)))
    wrap = lambda tag, inner, attr="": f"<{tag}{attr}>{inner}</{tag}>"
    link = lambda: wrap("a", say("N", 1, 3), ' href="/x"')
    named = lambda *words: f' {rng.choice(("class", "class", "id"))}="{rng.choice(words)}"'
    menu = lambda tag, attr="": wrap(tag, wrap("ul", "".join(wrap("li", link()) for _ in range(rng.randint(2, 7)))), attr)

    def body() -> str:
        parts = [wrap("h1", say("C", 2, 9))] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.7:
                parts.append(wrap("p", say("C", 1, 120) + (f" <a href='/y'>{say('C', 1, 3)}</a> {say('C', 2, 9)}" if rng.random() < 0.2 else "")))
            elif r < 0.78:
                parts.append(wrap(rng.choice(("h2", "h3")), say("C", 1, 7)))
            elif r < 0.84:
                parts.append(wrap(rng.choice(("ul", "ol")), "".join(wrap("li", say("C", 1, 20)) for _ in range(rng.randint(2, 5)))))
            elif r < 0.88:
                parts.append(wrap("blockquote", wrap("p", say("C", 5, 40))))
            elif r < 0.91:
                parts.append(wrap("table", "".join(wrap("tr", wrap("td", say("C", 1, 5)) * 2) for _ in range(3))))
            elif r < 0.94:
                parts.append(wrap("pre", say("C", 4, 20)))
            elif r < 0.97:
                parts.append(wrap("div", say("N", 3, 20), named("ad", "ads", "advert", "sponsored", "promo banner", "newsletter", "share social", "related")))
            else:
                parts.append(wrap("section", wrap("p", say("C", 5, 60))))
        return "".join(parts)

    comments = lambda: wrap(rng.choice(("section", "div")), "".join(wrap(rng.choice(("div", "p", "article", "li")), wrap("p", say("N", 2, 50)), rng.choice(("", ' class="comment"'))) for _ in range(rng.randint(1, 5))), named("comments", "comment-list", "responses", "disqus", "replies"))
    noise = [
        lambda: menu("nav"), lambda: menu("div", named("menu", "nav", "navbar", "breadcrumb", "navigation", "topnav")),
        lambda: wrap("header", wrap(rng.choice(("div", "p", "h1", "h2")), say("N", 1, 8)) + (menu("nav") if rng.random() < 0.5 else "")),
        lambda: wrap("div", say("N", 3, 30), named("ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner")),
        lambda: wrap(rng.choice(("div", "section")), wrap("p", say("N", 4, 40)), named("cookie", "cookie-notice", "notice", "consent", "popup", "modal", "alert", "gdpr banner")),
        lambda: wrap("aside", rng.choice((menu("div"), wrap("p", say("N", 3, 60)), wrap("h3", say("N", 1, 4)) + wrap("p", say("N", 3, 40)))), rng.choice(("", ' class="sidebar"'))),
        lambda: wrap("div", wrap("h3", say("N", 1, 4)) + menu("div") + wrap("p", say("N", 3, 40)), named("sidebar", "side", "widget", "related", "recommended", "rail")),
        lambda: wrap("div", wrap("p", say("N", 2, 20)), named("subscribe", "newsletter", "share", "social", "signup", "login", "search")),
    ]
    foot = [lambda: wrap("footer", say("N", 3, 40)), lambda: wrap("footer", wrap("p", say("N", 3, 40)) + menu("nav")), lambda: wrap("div", wrap("p", say("N", 3, 40)), named("footer", "foot", "copyright", "site-footer"))]
    for _ in range(count):
        main = body()
        form = rng.random()
        main = wrap("article", main, rng.choice(("", "", ' class="post"'))) if form < 0.55 else wrap("main", main) if form < 0.7 else wrap("main", wrap("article", main)) if form < 0.8 else wrap("div", main, named("content", "article", "post", "entry content", "main", "story body", "article-body", "text"))
        if rng.random() < 0.3:
            main = wrap("div", main, rng.choice(("", ' class="container"', ' id="wrapper"', ' class="page"')))
        before = "".join(rng.choice(noise)() for _ in range(rng.randint(0, 4)))
        after = (comments() if rng.random() < 0.4 else "") + "".join(rng.choice(noise)() for _ in range(rng.randint(0, 2))) + (rng.choice(foot)() if rng.random() < 0.85 else "")
        yield f"<html><head><title>{say('N', 1, 5)}</title></head><body>{before}{main}{after}</body></html>"


def train(count: int = LABELLED, seed: int = SEED) -> Model:
    """Count features and edges over the labelled pages. A node is content if any content text lies in it."""
    seen, edge, total = defaultdict(lambda: [0, 0]), defaultdict(lambda: [[0, 0], [0, 0]]), [0, 0]
    under = [0, 0]
    for page in labelled_pages(count, seed):
        nodes, runs = parse(page)
        votes = [[0, 0] for _ in nodes]
        for _, node, text in runs:
            if text.strip():
                votes[node][text.strip()[0] == "C"] += len(text)
        for i in range(len(nodes) - 1, 0, -1):
            for c in (0, 1):
                votes[nodes[i].parent][c] += votes[i][c]
        state = [int(v[1] > 0) for v in votes]
        for i, node in enumerate(nodes):
            if i == 0:
                total[state[i]] += 1
                continue
            edge[node.tag][state[node.parent]][state[i]] += 1
            if state[node.parent]:  # below anything else all is alike, and the edges say so
                under[state[i]] += 1
                for f in features(node):
                    seen[f][state[i]] += 1
    base = math.log((under[1] + 1) / (under[0] + 1))
    own = {f: math.log((v[1] + 0.5) / (v[0] + 0.5)) - base for f, v in seen.items() if not f.startswith("tag=")}
    every = [[sum(e[s][c] for e in edge.values()) for c in (0, 1)] for s in (0, 1)]
    default = tuple((v[1] + 0.5) / (v[0] + v[1] + 1) for v in every)
    share = lambda v, d: (v[1] + d) / (v[0] + v[1] + 1)
    return Model(own, {t: (share(e[0], default[0]), share(e[1], default[1])) for t, e in edge.items()}, default, math.log((total[1] + 0.5) / (total[0] + 0.5)))


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


@dataclass(frozen=True)
class _Extract:
    model: Model

    def __call__(self, batches):
        for batch in batches:
            texts = [self.model.extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_SCHEMA)


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_Extract(model or train()), "page_id long, url string, text string, n_chars long")
