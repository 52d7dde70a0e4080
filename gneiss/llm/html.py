"""Main-text extraction: gradient-boosted trees over DOM-node features.

A page is read by a forgiving parser into block elements and the text that stands directly in
them. Each block element gets features of its subtree (length, link, tag and punctuation
density), of its attributes' tokens, of its depth and place, of its siblings and of what
encloses it; boosted trees give the probability that it is main text. Hierarchical decoding
then settles whole subtrees: a node is kept with all below it, dropped with all below it, or
split at a price, whichever explains the probabilities best, so that no kept block lies
in a dropped one.

The trees are trained here, on pages that ``compose`` writes with known main text: many
arrangements of articles, menus, headers, footers, sidebars, notices, adverts, forms, shares
and reader comments, with and without telling tags and attributes. The number of such
pages is the parameter ``PAGES``; nothing is learned from the input.

Defined cases: null or empty html gives an empty text; broken markup is read as far as it
goes (an unfinished tag is text, an unfinished comment runs to the end); repeated rows are
extracted alike; of two equally cheap decodings the one that drops is taken; a very long page is
read whole, in time linear in its length; an empty table gives an empty result; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import html as entities
import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, trimming

# ---- reading a page ----

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")

BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption nav header footer aside form "
    "fieldset legend blockquote pre figure figcaption address details summary hr hgroup dialog menu center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Read to the end tag, or to the end of the page: nothing in them is markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Nothing in them is text of the page; they end by the rules of the tree.
HIDDEN = frozenset("head noscript template svg math object canvas select option optgroup datalist button".split())
#: What may stand in a head; any other element, and text, ends it.
_HEAD = frozenset("base basefont link meta script style title noscript template".split())
#: A start tag of the key ends an open element of the values, up to the nearest enclosing list or table.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select", "datalist"}, "optgroup": {"select"}}


class Node:
    __slots__ = ("tag", "up", "down", "tokens", "own", "links", "tags", "begin")

    def __init__(self, tag: str, up: int, tokens=()):
        self.tag, self.up, self.tokens = tag, up, tokens
        self.down: list[int] = []
        self.own = self.links = self.tags = 0
        self.begin = 0


def read(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements (the first is the root) and text blocks (owner, text) in page order."""
    nodes, texts = [Node("html", -1)], []
    if not page:
        return nodes, texts
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the block they are, or are in
    # Where on the stack the elements of a tag lie, and those that are blocks: what is open is looked up, not walked to.
    at_tag: dict[str, list[int]] = {}
    at_block: list[int] = []
    run: list[str] = []
    owner, at, chars, anchors, hidden = 0, 0, 0, 0, 0

    def close_run() -> None:
        nonlocal run, chars
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            run = []
            if text:
                texts.append((owner, text))
                nodes[owner].own += len(text)
                chars += len(text)

    def say(piece: str) -> None:
        if hidden and stack[-1][0] == "head" and piece.strip():
            pop(len(stack) - 1)
        if hidden:
            return
        run.append(piece)
        if anchors:
            nodes[owner].links += len(piece.strip())

    def push(tag: str, block: int) -> None:
        nonlocal anchors, hidden
        at_tag.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            at_block.append(len(stack))
        stack.append((tag, block))
        anchors += tag == "a"
        hidden += tag in HIDDEN

    def pop(k: int) -> None:
        nonlocal owner, anchors, hidden
        for tag, _ in reversed(stack[k:]):
            at_tag[tag].pop()
            if tag in BLOCKS:
                at_block.pop()
            anchors -= tag == "a"
            hidden -= tag in HIDDEN
        if stack[k - 1][1] != owner:
            close_run()
        owner = stack[k - 1][1]
        del stack[k:]

    def nearest(tags) -> int:
        """The place of the last open element of the tags; 0 if there is none."""
        return max((at_tag[t][-1] for t in tags if at_tag.get(t)), default=0)

    def block() -> int:
        return at_block[-1] if at_block else 0

    def end_before(tag: str) -> None:
        """End the open element that a start tag ends, within its list, table or selection."""
        if tag not in ENDS:
            return
        k = nearest(ENDS[tag])
        if k and k >= (nearest(_SCOPE[tag]) if tag in _SCOPE else block()):
            if stack[k][0] != tag and tag == "optgroup" and stack[k - 1][0] == "optgroup":
                k -= 1
            pop(k)

    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            k = nearest((tag,))
            if k and (tag in BLOCKS or tag in HIDDEN or k > block()):  # an inline end tag doesn't end a block
                pop(k)
            continue
        closed = m[3].rstrip().endswith("/")
        if hidden and stack[-1][0] == "head" and tag not in _HEAD:
            pop(len(stack) - 1)
        if tag in RAW and not closed:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            nodes[owner].tags += not hidden
            continue
        if tag in ("option", "optgroup"):
            end_before(tag)
        if hidden or (tag in HIDDEN and not closed):  # what is in it is neither text nor structure
            nodes[owner].tags += not hidden
            if tag not in VOID and not closed:
                push(tag, owner)
            continue
        nodes[owner].tags += 1
        if tag == "br":
            run.append(" ")
        if tag in BLOCKS and tag not in ("html", "hr"):
            if block() and stack[block()][0] == "p":  # a block ends an open paragraph
                pop(block())
            end_before(tag)
            close_run()
            tokens = tuple(t.lower() for a in _ATTR.finditer(m[3]) for t in _PART.findall(a[2] or a[3] or a[4] or ""))
            node = Node(tag, owner, tokens)
            node.begin = chars
            nodes.append(node)
            nodes[owner].down.append(len(nodes) - 1)
            owner = len(nodes) - 1
            push(tag, owner)
        elif tag == "hr":
            close_run()
        elif tag not in VOID and tag != "html" and not closed:
            push(tag, owner)
    if at < len(page):
        say(page[at:])
    close_run()
    return nodes, texts


# ---- features ----

#: Tokens of attributes by what they tell.
HINTS = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs toc pagination pager tabs topbar skip",
    "head": "header masthead banner logo brand hero",
    "foot": "footer foot colophon copyright legal bottom",
    "side": "sidebar side aside rail widget widgets secondary complementary",
    "ad": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion promoted banner adsense dfp commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall subscribe newsletter disclaimer message",
    "comment": "comment comments commentlist reply replies respond discussion disqus reactions feedback reader thread",
    "form": "form search login signup register contact subscribe input",
    "share": "share sharing social follow related recommended recommendations more trending popular tags tag category meta author byline date",
    "main": "article content main body post entry story text page prose maincontent hentry blog",
    "hidden": "hidden hide offscreen sr print",
}
_HINT = {t: g for g, s in enumerate(HINTS.values()) for t in s.split()}
_GROUPS = ("article", "main", "section", "div body", "p", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt dd menu", "table tr td th tbody thead", "nav", "header", "footer", "aside", "form fieldset legend", "blockquote pre figure figcaption", "address details summary dialog")
_TAG = {t: g for g, s in enumerate(_GROUPS) for t in s.split()}
_AROUND = ("article", "main", "nav", "header", "footer", "aside", "form")
_PUNCT = re.compile(r"[.,;:!?]")
N_FEATURES = len(_GROUPS) + 2 * len(HINTS) + len(_AROUND) + 17


def features(nodes: list[Node], texts: list[tuple[int, str]]) -> np.ndarray:
    n, h = len(nodes), len(HINTS)
    size, links, tags, paras, punct, parts = ([0] * n for _ in range(6))
    signs = [0] * n
    for k, t in texts:
        punct[k] += len(_PUNCT.findall(t))
        parts[k] += 1
        signs[k] += "©" in t
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        size[i] += x.own
        links[i] += min(x.links, x.own)
        tags[i] += x.tags
        paras[i] += x.tag == "p" and size[i] > 0
        if x.up >= 0:
            for v in (size, links, tags, paras, punct, parts, signs):
                v[x.up] += v[i]
    total = max(1, size[0])
    out = np.zeros((n, N_FEATURES), np.float32)
    depth, around, above = [0] * n, [0] * n, [0] * n
    base = len(_GROUPS)
    place, alike = [0] * n, [1] * n  # among all siblings; of those with the same tag
    for x in nodes:
        tags_below: dict[str, int] = {}
        for k, j in enumerate(x.down):
            place[j] = k
            tags_below[nodes[j].tag] = tags_below.get(nodes[j].tag, 0) + 1
        for j in x.down:
            alike[j] = tags_below[nodes[j].tag]
    for i, x in enumerate(nodes):
        row = out[i]
        if x.up >= 0:
            depth[i] = depth[x.up] + 1
            around[i], above[i] = around[x.up], above[x.up]
        if (g := _TAG.get(x.tag)) is not None:
            row[g] = 1
        own = 0
        for t in x.tokens:
            if t in _HINT:
                own |= 1 << _HINT[t]
        for g in range(h):
            row[base + g] = own >> g & 1
            row[base + h + g] = above[i] >> g & 1
        for g, t in enumerate(_AROUND):
            row[base + 2 * h + g] = around[i] >> g & 1
            if x.tag == t:
                around[i] |= 1 << g
        above[i] |= own
        s = size[i]
        rest = len(nodes[x.up].down) - 1 if x.up >= 0 else 0
        up = max(1, size[x.up]) if x.up >= 0 else total
        row[base + 2 * h + len(_AROUND) :] = (
            math.log1p(s), links[i] / s if s else 0, 100 * tags[i] / (s + 1), paras[i], 100 * punct[i] / (s + 1), s / max(1, parts[i]), signs[i] > 0,
            x.own / s if s else 0, depth[i], x.begin / total, (x.begin + s) / total, s / up, s / total, place[i], alike[i],
            math.log1p((up - s) / rest) if rest else 0, (links[x.up] - links[i]) / max(1, up - s) if rest and x.up >= 0 else 0,
        )
    return out


# ---- boosted trees ----

ROUNDS, LEVELS, BINS, SHRINK = 60, 4, 32, 0.2


def boost(x: np.ndarray, y: np.ndarray) -> dict:
    """Trees of full depth by second-order boosting of the logistic loss on binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    n, d = x.shape
    margin = np.full(n, math.log(y.mean() / (1 - y.mean())))
    start, feats, cuts, leaves = margin[0], [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p) + 1e-6
        node = np.zeros(n, np.int64)
        tree_f, tree_c = [], []
        for level in range(LEVELS):
            m = 1 << level
            best = np.full(m, 1e-6)
            bf, bc = np.zeros(m, np.int64), np.full(m, BINS)
            for f in range(d):
                if not len(edges[f]):
                    continue
                key = node * BINS + binned[:, f]
                gs = np.bincount(key, g, m * BINS).reshape(m, BINS).cumsum(1)
                hs = np.bincount(key, h, m * BINS).reshape(m, BINS).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                k = gain[:, : len(edges[f])].argmax(1)
                v = gain[np.arange(m), k]
                up = v > best
                best[up], bf[up], bc[up] = v[up], f, k[up]
            tree_f.append(bf)
            tree_c.append([edges[f][c] if c < len(edges[f]) else np.inf for f, c in zip(bf, bc, strict=True)])
            node = 2 * node + (binned[np.arange(n), bf[node]] > bc[node])
        leaf = -SHRINK * np.bincount(node, g, 1 << LEVELS) / (np.bincount(node, h, 1 << LEVELS) + 1)
        margin = margin + leaf[node]
        feats.append(np.concatenate(tree_f))
        cuts.append(np.concatenate([np.asarray(c, np.float64) for c in tree_c]))
        leaves.append(leaf)
    return {"start": start, "feature": np.array(feats), "cut": np.array(cuts, np.float32), "leaf": np.array(leaves)}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    margin = np.full(len(x), model["start"])
    rows = np.arange(len(x))
    for f, c, leaf in zip(model["feature"], model["cut"], model["leaf"], strict=True):
        node = np.zeros(len(x), np.int64)
        for level in range(LEVELS):
            k = (1 << level) - 1 + node
            node = 2 * node + (x[rows, f[k]] > c[k])
        margin += leaf[node]
    return 1 / (1 + np.exp(-margin))


# ---- hierarchical decoding ----

SPLIT = 0.7
#: Weight of a node's evidence: that of one with text of its own, and of a mere container.
OWN, CONTAINER = 1.0, 0.5


def decode(nodes: list[Node], p: np.ndarray) -> list[bool]:
    """Which nodes are kept. The cheapest of: keep all of a subtree, drop all of it, or (at
    the price ``SPLIT``) decide the node's own text and each child's subtree apart."""
    n = len(nodes)
    keep, drop = -np.log(np.clip(p, 1e-6, 1)), -np.log(np.clip(1 - p, 1e-6, 1))
    all_keep, all_drop, best, choice = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n
    below = [0.0] * n
    for i in range(n - 1, -1, -1):
        w = OWN if nodes[i].own else CONTAINER
        a, b = w * keep[i], w * drop[i]
        all_keep[i] += a
        all_drop[i] += b
        own = min(a, b) if nodes[i].own else 0.0
        split = SPLIT + own + below[i] if nodes[i].down else math.inf
        best[i], choice[i] = min((all_keep[i], 1), (all_drop[i], 0), (split, 2))
        if (u := nodes[i].up) >= 0:
            all_keep[u] += all_keep[i]
            all_drop[u] += all_drop[i]
            below[u] += best[i]
    kept, state = [False] * n, [2] * n
    for i in range(n):
        u = nodes[i].up
        state[i] = choice[i] if u < 0 or state[u] == 2 else state[u]
        kept[i] = state[i] == 1 or (state[i] == 2 and keep[i] <= drop[i])
    return kept


# ---- pages with known main text ----


def compose(rng: random.Random) -> tuple[str, list[str]]:
    """A random page and the blocks of its main text."""
    syllables = ["".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiouéü") for _ in range(1)) for _ in range(40)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    sentence = lambda a=4, b=18: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice(".....!?,")
    some = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    telling = rng.random() < 0.8  # tags of the page's parts
    hinted = rng.random() < 0.8  # attributes of the page's parts
    hint = lambda kind: rng.choice([f' class="{t}"' for t in HINTS[kind].split()] + [f' id="{rng.choice(HINTS[kind].split())}-{word()}"']) if hinted else rng.choice(["", f' class="{word()}"'])
    tag = lambda t: t if telling else "div"
    shut = lambda t: "" if rng.random() < 0.3 else t  # noqa: E731  end tags that may be left out
    truth: list[str] = []

    def block(t: str, text: str, keep: bool, inner=None) -> str:
        if keep:
            truth.append(text)
        body = text
        if rng.random() < 0.15:
            body = f"<{(i := rng.choice(['b', 'em', 'span', 'strong', 'i']))}>{text}" + shut(f"</{i}>")
        elif rng.random() < 0.1 and keep:
            ws = text.split(" ")
            body = f'<a href="/{word()}">{ws[0]}</a> ' + " ".join(ws[1:])
        return f"<{t}>{body}" + ("<br>" if rng.random() < 0.1 else "") + (shut(f"</{t}>") if t in ("p", "li") else f"</{t}>")

    def links(k: int) -> str:
        inner = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k))
        return rng.choice([f"<ul>{inner}</ul>", " ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(k))])

    def article() -> str:
        out = []
        if rng.random() < 0.9:
            out.append(block(rng.choice(["h1", "h1", "h2"]), sentence(3, 14), True))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 10, 20]) or (0 if out else 1)):
            kind = rng.random()
            if kind < 0.8:
                out.append(block("p", some(1, rng.choice([1, 2, 4, 9])), True))
            elif kind < 0.86:
                out.append(block(rng.choice(["h2", "h3"]), sentence(2, 8), True))
            elif kind < 0.92:
                out.append("<ul>" + "".join(block("li", sentence(), True) for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.95:
                out.append("<blockquote>" + block("p", some(1, 2), True) + "</blockquote>")
            else:
                out.append(noise(rng.choice(["ad", "share", "notice"])))
        body = "".join(out)
        if rng.random() < 0.4:
            body = f"<div{hint('main')}>{body}</div>"
        t = rng.choice(["article", "article", "main", "section"]) if telling else "div"
        return f"<{t}{hint('main') if rng.random() < 0.5 or not telling else ''}>{body}</{t}>"

    def noise(kind: str) -> str:
        if kind == "menu":
            return f"<{tag('nav')}{hint('menu') if not telling or rng.random() < 0.4 else ''}>{links(rng.randint(3, 12))}</{tag('nav')}>"
        if kind == "head":
            return f"<{tag('header')}{hint('head')}>{rng.choice([block('h1', sentence(1, 4), False), block('p', sentence(2, 6), False), ''])}{links(rng.randint(0, 6))}</{tag('header')}>"
        if kind == "foot":
            said = rng.choice(["&copy; " + word() + ".example", "© 2020 " + sentence(), sentence()]) + " &middot; " + some(1, rng.choice([1, 1, 3]))
            return f"<{tag('footer')}{hint('foot') if not telling or rng.random() < 0.4 else ''}>{rng.choice([said, block('p', said, False)])}{rng.choice(['', links(4)])}</{tag('footer')}>"
        if kind == "side":
            return f"<{tag('aside')}{hint('side')}>{block('h3', sentence(1, 4), False)}{links(rng.randint(2, 8))}{rng.choice(['', block('p', some(1, 3), False)])}</{tag('aside')}>"
        if kind == "form":
            return f"<form{hint('form')}><label>{sentence(1, 5)}</label><input name=q><button>{word()}</button>{rng.choice(['', block('p', sentence(), False)])}</form>"
        said = some(1, rng.choice([1, 1, 2, 5]))
        inner = rng.choice([said, said, block("p", said, False), f'<a href="/{word()}">{said}</a>'])
        return f"<div{rng.choice([f' class={chr(34)}{t}{chr(34)}' for t in HINTS[kind].split()])}>{inner}</div>"

    def comments() -> str:
        each = "".join(f"<div{hint('comment')}>{block('h4', word(), False)}{block('p', some(1, 3), False)}</div>" for _ in range(rng.randint(1, 6)))
        return f"<div class=\"{rng.choice(HINTS['comment'].split())}\">{block('h2', sentence(1, 2), False)}{each}</div>"

    before = [noise(k) for k in ("menu", "head", "ad", "notice", "form", "side") if rng.random() < 0.5]
    after = [noise(k) for k in ("share", "ad", "side", "form", "notice") if rng.random() < 0.35]
    rng.shuffle(before)
    rng.shuffle(after)
    truth.clear()
    main = article()
    tail = ([comments()] if rng.random() < 0.4 else []) + after + ([noise("foot")] if rng.random() < 0.8 else [])
    if rng.random() < 0.3:
        main = f"<div{hint('main') if rng.random() < 0.5 else ''}>{main}{''.join(tail[:1])}</div>"
        tail = tail[1:]
    head = f'<head><meta charset="utf-8"><title>{sentence()}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>' if rng.random() < 0.9 else ""
    return f'<!DOCTYPE html><html lang="en">{head}<body>{"".join(before)}<!-- {word()} -->{main}{"".join(tail)}</body></html>', truth


PAGES = 700


def fit(pages: int = PAGES, seed: int = 11) -> dict:
    """Trees trained on ``pages`` composed pages; a node is main text if most of its characters are."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page, truth = compose(rng)
        nodes, texts = read(page)
        good, size = [0] * len(nodes), [0] * len(nodes)
        left: dict[str, int] = {}
        for t in truth:
            plain = _SPACE.sub(" ", t).strip()
            left[plain] = left.get(plain, 0) + 1
        for k, t in texts:
            size[k] += len(t)
            if left.get(t):
                left[t] -= 1
                good[k] += len(t)
        for i in range(len(nodes) - 1, 0, -1):
            good[nodes[i].up] += good[i]
            size[nodes[i].up] += size[i]
        x = features(nodes, texts)
        rows = [i for i in range(len(nodes)) if size[i]]
        xs.append(x[rows])
        ys += [2 * good[i] > size[i] for i in rows]
    return boost(np.concatenate(xs).astype(np.float64), np.array(ys, np.float64))


# ---- the operator ----


def texts_of(model: dict, pages: list[str | None]) -> list[str]:
    """Main texts of some pages; all their nodes are scored together."""
    parsed = [read(p) for p in pages]
    if not parsed:
        return []
    p = probability(model, np.concatenate([features(*x) for x in parsed]))
    out, at = [], 0
    for nodes, texts in parsed:
        kept = decode(nodes, p[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(t for k, t in texts if kept[k]))
    return out


STEP = 256


def extract(pages: DataFrame, html_col="html", keep=(), model: dict | None = None) -> DataFrame:
    """The columns ``keep`` and a struct ``_main`` of text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit())
    each = pages.select(F.struct(*[F.col(c) for c in keep]).alias("k"), F.col(html_col).alias("html"))

    def run(batches):
        for pdf in batches:
            found = []
            for i in range(0, len(pdf), STEP):
                found += texts_of(shared.value, list(pdf["html"].iloc[i : i + STEP]))
            yield pd.DataFrame({"k": pdf["k"], "r": pd.Series([{"text": t, "n_chars": len(t)} for t in found], index=pdf.index, dtype=object)})

    out = each.mapInPandas(trimming(run), f"k {each.schema['k'].dataType.simpleString()}, r struct<text:string,n_chars:bigint>")
    return out.select("k.*", F.col("r").alias("_main"))


def op3_html(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("page_id", "url", "_main.text", "_main.n_chars")
