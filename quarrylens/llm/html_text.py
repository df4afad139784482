"""Main text of web pages by a tree-structured graphical model over DOM elements.

Each element is a binary variable (content or not) with a unary potential from its tag, names and text, and a
potential with its parent. Sum-product messages go up and down the tree; an element's marginal decides its own text.
"""

from __future__ import annotations

import functools
import html
import json
import math
import pathlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: Scripts, styles, form fields and markup that is never shown.
UNSEEN = frozenset("script style title noscript template iframe select textarea option".split())
RAW = frozenset("script style title textarea noscript iframe".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img acronym bdi ruby rt rp math mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup mover munder munderover semantics svg g text tspan path object audio video canvas map picture output meter progress slot font".split())
CLOSES_P = frozenset("address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SCOPE = frozenset("html body article section main div table td th button".split())

#: Groups of tags and of words in class, id and role that the unary potential looks at.
TAGS = ("nav", "footer", "header", "aside", "form", "button", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "td", "table", "blockquote", "pre", "figure", "figcaption", "address", "dialog", "body", "label")
NAMES = {
    "good": "article articlebody content entry post body story main text prose".split(),
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc links".split(),
    "head": "header head masthead topbar banner site logo".split(),
    "foot": "footer foot copyright legal contentinfo colophon".split(),
    "side": "side sidebar rail widget related complementary aside recommended popular".split(),
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion".split(),
    "notice": "cookie cookies consent notice alert popup modal overlay dialog gdpr banner message warning".split(),
    "comment": "comment comments reply replies discussion disqus respond".split(),
    "form": "form search login signup subscribe newsletter".split(),
    "share": "share sharing social tags tag meta".split(),
}
_GROUPS = {w: [g for g, ws in NAMES.items() if w in ws] for ws in NAMES.values() for w in ws}
_FEATURES = ["bias", *[f"tag:{t}" for t in TAGS], "tag:other", *[f"name:{g}" for g in NAMES], "hidden", "text", "sentences", "links"]
_AT = {f: i for i, f in enumerate(_FEATURES)}
_NAME_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("tag", "parent", "attributes", "chars", "link_chars", "stops", "label")

    def __init__(self, tag: str, parent: int, attributes: dict[str, str], label: bool = False):
        self.tag, self.parent, self.attributes, self.label = tag, parent, attributes, label
        self.chars = self.link_chars = self.stops = 0


def parse(page: str) -> tuple[list[Element], list[tuple[int, list[str]]]]:
    """Block elements in page order (parents first; entry 0 is the root) and blocks of text as (element, parts).

    Inline elements are not variables: their text belongs to the block around them. A block ends at any start or
    end of a block element and at br and hr. Unseen elements, comments and a cut-off tag at the end are skipped.
    Open p, list and table items end where the next one starts, stray end tags are ignored, and the end of the page
    closes all.
    """
    elements = [Element("#root", -1, {})]
    stack = [(0, "#root")]  # (element, tag); inline elements stand on it with the element around them
    blocks: list[tuple[int, list[str]]] = []
    fresh, links, at, n = True, 0, 0, len(page)

    def add(text: str) -> None:
        nonlocal fresh
        own = stack[-1][0]
        text = html.unescape(text) if "&" in text else text
        if fresh or blocks[-1][0] != own:
            blocks.append((own, []))
            fresh = False
        blocks[-1][1].append(text)
        e = elements[own]
        e.chars += len(text)
        e.link_chars += len(text) if links else 0
        e.stops += text.count(". ") + text.count("? ") + text.count("! ") + text.rstrip().endswith((".", "!", "?"))

    def pop(depth: int) -> None:
        nonlocal links
        for _, tag in stack[depth:]:
            links -= tag == "a"
        del stack[depth:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            if page[at:].strip():
                add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if not m[4]:
            break
        if m[1]:
            if tag == "br":
                fresh = True
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][1] == tag:
                    pop(depth)
                    break
                if tag in INLINE and stack[depth][1] not in INLINE:
                    break
            fresh = fresh or tag not in INLINE
            continue
        if tag == "head":  # what it holds is unseen by itself; an open head ends where the body's content starts
            fresh = True
            continue
        if tag in UNSEEN:
            if not m[3].endswith("/"):
                # an option also ends where the next one or its list's end stands; unclosed lists and templates hide nothing
                end = re.compile(rf"</{tag}\b[^>]*>" + (r"|(?=<(?:option|/?optgroup|/select|/datalist)\b)" if tag == "option" else ""), re.I).search(page, at)
                at = end.end() if end else n if tag in RAW else at
            fresh = fresh or tag not in INLINE
            continue
        if tag in VOID:
            fresh = fresh or tag in ("br", "hr")
            continue
        if tag in INLINE:
            stack.append((stack[-1][0], tag))
            links += tag == "a"
            continue
        fresh = True
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][1] == "p":
                    pop(depth)
                    break
                if stack[depth][1] in _SCOPE:
                    break
        if tag in _SIBLING:
            closes, within = _SIBLING[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][1] in within:
                    break
                if stack[depth][1] in closes:
                    pop(depth)
                    if tag != "tr" or stack[-1][1] in within:
                        break
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        label = "data-main" in attributes or (elements[stack[-1][0]].label and "data-side" not in attributes)
        elements.append(Element(tag, stack[-1][0], attributes, label))
        if not m[3].endswith("/"):
            stack.append((len(elements) - 1, tag))
    return elements, blocks


def features(e: Element) -> list[tuple[int, float]]:
    """The nonzero features of an element."""
    out = [(0, 1.0), (_AT.get(f"tag:{e.tag}", _AT["tag:other"]), 1.0)]
    if e.attributes:
        a = e.attributes
        names = " ".join(a[k] for k in ("class", "id", "role") if k in a)
        if names:
            groups = {g for w in _NAME_SPLIT.split(_CAMEL.sub(" ", names).lower()) for g in _GROUPS.get(w, ())}
            out += [(_AT[f"name:{g}"], 1.0) for g in groups]
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
            out.append((_AT["hidden"], 1.0))
    if e.chars > 1:
        out += [(_AT["text"], math.log1p(e.chars) / 5), (_AT["sentences"], math.log1p(e.stops)), (_AT["links"], e.link_chars / e.chars)]
    return out


#: Classes of parent-child edges, by the child.
EDGES = ("flow", "box", "named box", "landmark")
_LANDMARKS = frozenset("nav footer header aside form button article main dialog body html".split())
_BOXES = frozenset("div section fieldset details center".split())


def edge_class(e: Element) -> int:
    if e.tag in _LANDMARKS:
        return 3
    named = any(k in e.attributes for k in ("class", "id", "role"))
    return (2 if named else 1) if e.tag in _BOXES or named else 0


def _log_sum(x: float, y: float) -> float:
    m = x if x > y else y
    return m + math.log(math.exp(x - m) + math.exp(y - m))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


class PageModel:
    """``weights``: unary log-odds of content by feature. ``both`` and ``neither``: for each edge class, the
    log-potential of parent and child both being content, and of neither; that of one alone is 0."""

    def __init__(self, weights: list[float], both: list[float], neither: list[float]):
        self.weights, self.both, self.neither = weights, both, neither

    def infer(self, elements: list[Element]) -> tuple[list[float], list[int], list[float], list[float], list[float]]:
        """Sum-product over the tree. Messages are kept as log-odds; elements stand after their parents, so the
        pass up (leaves to root) and the pass down are plain loops. Gives the log-odds of each element, its edge
        class, its belief from below, its message up, and its parent's log-odds without that message."""
        w, both, neither = self.weights, self.both, self.neither
        n = len(elements)
        below = [-3.0] + [sum(w[i] * x for i, x in features(e)) for e in elements[1:]]
        kinds = [0] + [edge_class(e) for e in elements[1:]]
        up, outside = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):
            k = kinds[i]
            up[i] = _log_sum(0.0, both[k] + below[i]) - _log_sum(neither[k], below[i])
            below[elements[i].parent] += up[i]
        odds = below[:]
        for i in range(1, n):
            k = kinds[i]
            z = outside[i] = odds[elements[i].parent] - up[i]
            odds[i] += _log_sum(0.0, both[k] + z) - _log_sum(neither[k], z)
        return odds, kinds, below, up, outside

    def marginals(self, elements: list[Element]) -> list[float]:
        """P(content) of each element."""
        return [_sigmoid(z) for z in self.infer(elements)[0]]

    def text(self, page: str) -> str:
        """The blocks whose element is more likely content than not, white space made single, joined by a space."""
        elements, blocks = parse(page)
        odds = self.infer(elements)[0]
        return " ".join(t for own, parts in blocks if odds[own] > 0 and (t := " ".join("".join(parts).split())))


def train(pages: list[str], penalty: float = 1e-5, steps: int = 400, rate: float = 0.3, batch: int = 40) -> PageModel:
    """Weights of largest penalised likelihood of the labels of whole trees: the gradient compares labels with
    the marginals of elements and edges that sum-product gives. Adam steps of falling rate over ``batch`` pages in
    turn. ``pages`` is the bounded training sample."""
    trees = [parse(page)[0] for page in pages]
    owned = [[features(e) for e in t[1:]] for t in trees]
    f, k = len(_FEATURES), len(EDGES)
    beta, first, second = np.zeros(f + 2 * k), np.zeros(f + 2 * k), np.zeros(f + 2 * k)
    beta[f:] = 1.0
    model = lambda: PageModel(beta[:f].tolist(), beta[f : f + k].tolist(), beta[f + k :].tolist())
    for step in range(1, steps + 1):
        now, grad = model(), np.zeros(f + 2 * k)
        turn = [(step * batch + j) % len(trees) for j in range(min(batch, len(trees)))]
        for tree, rows in [(trees[j], owned[j]) for j in turn]:
            odds, kinds, below, _, outside = now.infer(tree)
            for i, row in enumerate(rows, 1):
                gap = float(tree[i].label) - _sigmoid(odds[i])
                if abs(gap) > 1e-6:
                    for j, x in row:
                        grad[j] += gap * x
                c, z, y = kinds[i], outside[i], below[i]
                scores = [now.neither[c], z, y, now.both[c] + z + y]
                m = max(scores)
                weights = [math.exp(v - m) for v in scores]
                t = sum(weights)
                mine, above = tree[i].label, tree[tree[i].parent].label
                grad[f + c] += float(mine and above) - weights[3] / t
                grad[f + k + c] += float(not mine and not above) - weights[0] / t
        grad = grad / sum(len(owned[j]) for j in turn) - penalty * beta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        beta = beta + rate * (1 - step / (steps + 10)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return model()


_WEIGHTS = pathlib.Path(__file__).with_name("html_weights.json")


@functools.cache
def default_model() -> PageModel:
    """The model trained by ``train_default``, read on the driver; every worker gets it from there."""
    stored = json.loads(_WEIGHTS.read_text())
    return PageModel([stored["weights"][f] for f in _FEATURES], *([stored[c][e] for e in EDGES] for c in ("both", "neither")))


def train_default(n_pages: int = 800) -> PageModel:
    """Train on ``n_pages`` labelled pages and store the weights beside this module."""
    from quarrylens.llm.html_training import labelled_pages

    model = train(labelled_pages(n_pages))
    of = lambda names, values: {n: round(v, 4) for n, v in zip(names, values, strict=True)}
    _WEIGHTS.write_text(json.dumps({"weights": of(_FEATURES, model.weights), "both": of(EDGES, model.both), "neither": of(EDGES, model.neither)}, indent=1) + "\n")
    return model


def extract(pages: DataFrame, model: PageModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every whole page.

    Null or empty html, or no content: an empty text. Null page_id and url stay; repeated rows are extracted once
    each; other columns are ignored; an empty table gives no rows. No shuffle; a task holds one page's tree.
    """
    model = model or default_model()
    weights, both, neither = model.weights, model.both, model.neither

    def run(batches):
        own = PageModel(weights, both, neither)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = [own.text(h) if h else "" for h in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
