"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page."""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav object ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag of the key ends open elements of the value, down to the nearest one that holds such elements.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol menu dl table select body article main section div nav aside header footer form blockquote".split())
#: Elements with no running text of their own.
RAW = "script|style|noscript|template|textarea|svg|math|xmp|title"

# No part of an attribute begins with "<", and nothing is tried twice, so that tags that never close cost no more than their length.
_ATTRIBUTES = r"""(?:[^\s>=<]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'<][^\s><]*+)?+)?+|[\s=]++)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b({_ATTRIBUTES})>|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES})>", re.S | re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*+>|\Z", re.I) for name in RAW.split("|")}
#: Elements that may close themselves; the slash may not belong to a value without quotes.
FOREIGN = frozenset(("svg", "math"))
_BARE_VALUE = re.compile(r"""=\s*+[^\s"'=<>][^\s<>]*+\Z""")
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=)|\baria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Words of class and id names, by what they speak for.
HINTS = {
    "ad": "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion outbrain taboola",
    "menu": "nav navbar navigation navigate menu menus breadcrumb breadcrumbs crumbs toc pagination pager skip tabs toolbar links topbar",
    "head": "header masthead logo brand branding hero site",
    "foot": "footer foot copyright legal imprint credits bottom",
    "side": "sidebar side aside rail related recommended recommendations widget widgets trending popular more teaser teasers complementary",
    "talk": "comment comments commentlist reply replies respond disqus discussion feedback reader review reviews responses",
    "note": "cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe subscription signup paywall disclaimer warning",
    "share": "share sharing social follow buttons byline author meta tags tag categories",
    "form": "form search login signin register contact input poll survey",
    "text": "article post entry content story body text main prose page",
}
_HINT_OF = {word: hint for hint, words in HINTS.items() for word in words.split()}
# Words at the end of a name that say nothing of what is inside.
NEUTRAL = frozenset("wrapper wrap container box list item items inner outer block area section bar row col column group panel module zone region slot unit space posts articles stories holder".split())
# Words of short blocks, by what they speak for.
CUES = {
    "note": "cookie cookies consent privacy subscribe newsletter",
    "foot": "copyright reserved imprint terms",
    "talk": "comments comment reply replies wrote commented",
    "menu": "home menu search login register",
    "ad": "advertisement sponsored",
    "side": "related popular recommended",
}
_CUE_OF = {word: cue for cue, words in CUES.items() for word in words.split()}
TAGS = tuple("article main nav header footer aside form section div ul ol li table td p h1 h2 h3 blockquote pre figure figcaption dl button label legend select option a body head details dialog".split())
NEAREST = frozenset("article main nav header footer aside form body head dialog figure table".split())
#: Elements that belong to the flow of the element around them, whatever they hold.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure li dd dt tr td th tbody thead tfoot caption figcaption button label legend select option optgroup".split())
_BIT = {t: 1 << i for i, t in enumerate(TAGS)}
_HINT_BIT = {h: 1 << i for i, h in enumerate(HINTS)}
DEPTH = 3


@dataclass
class Block:
    text: str
    tag: str
    tags: int  # bits of TAGS
    nearest: str
    hints: int  # bits of HINTS that elements around the block's own have
    own: int  # bits of HINTS of the block's own element
    hidden: bool
    linked: float
    zone: tuple[str, ...] = ()


def name_hints(attributes: str) -> int:
    """Bits of the hints that class, id, role and label of a tag give: a name speaks by its last word that isn't neutral."""
    bits = 0
    for found in _NAMES.findall(attributes):
        for name in " ".join(found).split():
            words = [w.lower() for w in _PART.findall(name)]
            while len(words) > 1 and (words[-1] in NEUTRAL or words[-1].isdigit()):
                words.pop()
            if words and words[-1] in _HINT_OF:
                bits |= _HINT_BIT[_HINT_OF[words[-1]]]
    return bits


def closes_itself(name: str, attributes: str) -> bool:
    """Whether a raw element has no body: an icon or a formula, `<svg class="i"/>`, whose last sign is a slash of its own."""
    return name in FOREIGN and attributes.endswith("/") and not _BARE_VALUE.search(attributes[-2000:])


def leaf_blocks(page: str) -> list[Block]:
    """Runs of text between boundaries of block elements, with what stands around them.

    Scripts, styles and comments vanish; unclosed and stray tags are borne. Time and memory are in proportion to the page.
    """
    # of each element on the way down: name, number, tags, nearest, hints around, own hints, hidden, place of the nearest that holds list items and the like
    root = ("none", 0, 0, "none", 0, 0, False, -1)
    stack: list[tuple] = []
    open_at: dict[str, list[int]] = {}
    parents, elements = [0], ["none"]
    blocks: list[Block] = []
    where: list[int] = []
    held: list[str] = []
    linked = 0
    in_link = False
    seen: dict[str, tuple[int, bool]] = {}

    def end() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                name, number, tags, nearest, hints, own, hidden, _ = stack[-1] if stack else root
                blocks.append(Block(text, name, tags, nearest, hints, own, hidden, min(1.0, linked / max(1, len(raw)))))
                where.append(number)
            held.clear()
        linked = 0

    def close(at: int) -> None:
        while len(stack) > at:
            open_at[stack.pop()[0]].pop()

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            held.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        if m.group(1):
            if not closes_itself(m.group(1).lower(), m.group(2)):
                at = _RAW_END[m.group(1).lower()].search(page, at).end()
            continue
        name = (m.group(4) or "").lower()
        if name == "a":
            in_link = not m.group(3)
        elif name == "br":
            held.append(" ")
        if name not in BLOCK:
            continue
        end()
        in_link = False
        if m.group(3):
            if open_at.get(name) and (name != "p" or stack[-1][0] == "p"):
                close(open_at[name][-1])
            continue
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if name in ENDS:
            holder = stack[-1][7] if stack else -1
            first = [places[i] for other in ENDS[name] if (places := open_at.get(other)) and (i := bisect_right(places, holder)) < len(places)]
            if first:
                close(min(first))
        attributes = m.group(5)
        if name in VOID or attributes.endswith("/"):
            continue
        if attributes not in seen:
            seen[attributes] = name_hints(attributes), bool(_HIDDEN.search(attributes))
        own, hidden = seen[attributes]
        above = stack[-1] if stack else root
        parents.append(above[1])
        elements.append(name)
        open_at.setdefault(name, []).append(len(stack))
        stack.append((name, len(parents) - 1, above[2] | _BIT.get(name, 0), name if name in NEAREST else above[3], above[4] | above[5], own, above[6] or hidden, len(stack) if name in HOLDS else above[7]))
    if at < len(page):
        held.append(page[at:])
    end()
    for block, zone in zip(blocks, _zones(blocks, where, parents, elements)):
        block.zone = zone
    return blocks


def _zones(blocks: list[Block], where: list[int], parents: list[int], elements: list[str]) -> list[tuple[str, ...]]:
    """What the part of the page that holds each block is like.

    Below the lowest element that holds a whole, its children with structure of their own are its zones, and all else in it
    is one more, its flow. Zones are split up again, DEPTH levels at most. Of a block's last zone counts its
    share of the page's words outside links, whether it and those above it have the most words among their like,
    its words a block, its share of links and whether it has a first heading.
    """
    n = len(parents)
    words, count, linked, heads = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    sizes = np.array([b.text.count(" ") + 1.0 for b in blocks])
    share = np.array([b.linked for b in blocks])
    if not len(blocks):
        return []
    own = np.array(where)
    np.add.at(words, own, sizes * (1 - share))
    np.add.at(count, own, 1)
    np.add.at(linked, own, sizes * share)
    np.add.at(heads, own, np.array([b.tag == "h1" for b in blocks], float))
    direct = count.tolist()
    sums = [list(x) for x in zip(words.tolist(), direct, linked.tolist(), heads.tolist())]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):  # parents come before their children
        if sums[i][1]:
            above = sums[parents[i]]
            for k in range(4):
                above[k] += sums[i][k]
            children[parents[i]].append(i)
    page = sums[0][0] or 1.0
    marks: dict[int, tuple[str, ...]] = {}
    ahead: list[tuple[int, int, int]] = [(0, 0, 0)]  # element, level, the first level at which it isn't the largest

    def described(s: list[float], off: int, flow: bool, alone: bool) -> tuple[str, ...]:
        part, mean = s[0] / page, s[0] / max(1.0, s[1])
        names = ["zone_alone" if alone else f"zone_off_{off}" if off else "zone_top"]
        names.append("zone_part_" + ("0" if part < 0.05 else "5" if part < 0.2 else "20" if part < 0.5 else "50" if part < 0.8 else "80"))
        names.append("zone_mean_" + ("low" if mean < 5 else "some" if mean < 12 else "high"))
        if flow:
            names.append("zone_flow")
        if s[2] > 0.5 * (s[0] + s[2]):
            names.append("zone_links")
        if s[3]:
            names.append("zone_h1")
        return tuple(names)

    while ahead:
        at, level, off = ahead.pop()
        while len(children[at]) == 1 and not direct[at] and elements[children[at][0]] not in FLOW:
            at = children[at][0]
        apart = [c for c in children[at] if elements[c] not in FLOW and (children[c] or elements[c] in NEAREST)]
        flow = [sums[at][k] - sum(sums[c][k] for c in apart) for k in range(4)]
        most = max([sums[c][0] for c in apart] + [flow[0]])
        alone = level == 0 and not apart
        marks[at] = described(flow, off or (level + 1 if flow[0] < most else 0), True, alone)
        for c in apart:
            now = off or (level + 1 if sums[c][0] < most else 0)
            if level + 1 < DEPTH and children[c]:
                ahead.append((c, level + 1, now))
            else:
                marks[c] = described(sums[c], now, False, False)
    found: list[tuple[str, ...]] = [marks.get(0, ())] * n
    for i in range(1, n):
        found[i] = marks.get(i) or found[parents[i]]
    return [found[i] for i in where]


FEATURES = ("bias", *[f"in_{t}" for t in TAGS], *[f"is_{t}" for t in TAGS], *[f"near_{t}" for t in sorted(NEAREST)], "near_none",
            *[f"hint_{h}" for h in HINTS], *[f"own_box_{h}" for h in HINTS], *[f"own_text_{h}" for h in HINTS], *[f"cue_{c}" for c in CUES], "hidden",
            "words_1", "words_2_4", "words_5_14", "words_15_39", "words_40", "linked_some", "linked_half", "ends", "sign", "first", "after_h1",
            "zone_alone", "zone_top", *[f"zone_off_{i + 1}" for i in range(DEPTH)], *[f"zone_part_{p}" for p in (0, 5, 20, 50, 80)], *[f"zone_mean_{m}" for m in ("low", "some", "high")],
            "zone_flow", "zone_links", "zone_h1")
_INDEX = {f: i for i, f in enumerate(FEATURES)}


def block_features(blocks: list[Block]) -> list[list[int]]:
    """Indices into FEATURES of what holds for each block."""
    out, headed = [], False
    known: dict[tuple, list[int]] = {}
    for i, b in enumerate(blocks):
        around = (b.tag, b.tags, b.nearest, b.hints, b.own, b.hidden, b.zone)
        if around not in known:
            kind = "text" if b.tag in FLOW else "box"
            names = ["bias", *[f"in_{t}" for t, bit in _BIT.items() if b.tags & bit], f"is_{b.tag}", f"near_{b.nearest}", *b.zone, *["hidden"] * b.hidden]
            names += [f"hint_{h}" for h, bit in _HINT_BIT.items() if b.hints & bit] + [f"own_{kind}_{h}" for h, bit in _HINT_BIT.items() if b.own & bit]
            known[around] = [_INDEX[n] for n in names if n in _INDEX]
        n = b.text.count(" ") + 1
        own = ["words_1" if n == 1 else "words_2_4" if n < 5 else "words_5_14" if n < 15 else "words_15_39" if n < 40 else "words_40"]
        if n <= 25:
            own += {f"cue_{_CUE_OF[w]}" for x in b.text.lower().split() if (w := x.strip(".,:;!?()")) in _CUE_OF}
        if b.linked > 0.1:
            own.append("linked_half" if b.linked > 0.5 else "linked_some")
        if b.text[-1] in ".!?:;\"”»":
            own.append("ends")
        if b.text[0] in "©|»›&" or "©" in b.text:
            own.append("sign")
        if i == 0:
            own.append("first")
        if headed:
            own.append("after_h1")
        headed = headed or b.tag == "h1"
        out.append(known[around] + sorted(_INDEX[n] for n in own))
    return out


@dataclass
class Crf:
    """Weights for `article` against `other`, and scores of label pairs (from, to)."""

    unary: np.ndarray
    pair: np.ndarray

    def decode(self, features: list[list[int]]) -> list[bool]:
        """The likeliest labels, by Viterbi."""
        if not features:
            return []
        w, ((oo, oa), (ao, aa)) = self.unary.tolist(), self.pair.tolist()
        other, article = 0.0, sum(w[f] for f in features[0])
        back: list[tuple[bool, bool]] = []
        for own in features[1:]:
            u = sum(w[f] for f in own)
            to_other, to_article = article + ao > other + oo, article + aa > other + oa
            back.append((to_other, to_article))
            other, article = (article + ao if to_other else other + oo), (article + aa if to_article else other + oa) + u
        label = article > other
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def fit_crf(pages: list[tuple[list[list[int]], list[bool]]], steps: int = 300, rate: float = 0.1, ridge: float = 1e-3) -> Crf:
    """Weights that maximise the labels' conditional likelihood over labelled pages, by gradient steps over all pages at once."""
    n, longest = len(pages), max(len(f) for f, _ in pages)
    x = np.zeros((n, longest, len(FEATURES)))
    y = np.zeros((n, longest), int)
    there = np.zeros((n, longest), bool)
    for i, (features, labels) in enumerate(pages):
        for t, own in enumerate(features):
            x[i, t, own] = 1
        y[i, : len(labels)] = labels
        there[i, : len(labels)] = True
    unary, pair = np.zeros(len(FEATURES)), np.zeros((2, 2))
    moments = [np.zeros_like(unary), np.zeros_like(unary), np.zeros_like(pair), np.zeros_like(pair)]
    both = there[:, 1:] & there[:, :-1]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    for step in range(1, steps + 1):
        score = np.stack([np.zeros((n, longest)), x @ unary], 2)
        ahead, behind = score.copy(), np.zeros_like(score)
        for t in range(1, longest):
            moved = np.logaddexp(ahead[:, t - 1, :1] + pair[0], ahead[:, t - 1, 1:] + pair[1]) + score[:, t]
            ahead[:, t] = np.where(there[:, t, None], moved, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            later = score[:, t + 1] + behind[:, t + 1]
            moved = np.logaddexp(later[:, :1] + pair[:, 0], later[:, 1:] + pair[:, 1])
            behind[:, t] = np.where(there[:, t + 1, None], moved, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        p = np.where(there, np.exp(ahead[..., 1] + behind[..., 1] - total[:, None]), 0)
        joint = ahead[:, :-1, :, None] + pair + (score + behind)[:, 1:, None, :] - total[:, None, None, None]
        expected = np.where(both[..., None, None], np.exp(np.minimum(joint, 0)), 0).sum((0, 1))
        slopes = [np.einsum("nt,ntf->f", np.where(there, y - p, 0), x) / n - ridge * unary, (seen - expected) / n - ridge * pair]
        for k, (value, slope) in enumerate(zip((unary, pair), slopes)):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * slope
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * slope**2
            value += rate * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return Crf(unary, pair)


#: Words of names that training pages use; the other words of HINTS only serve as features and are met for the first time in use.
TRAINED_NAMES = {hint: tuple(words.split()[::2]) for hint, words in HINTS.items()}


def labelled_pages(n: int = 500, seed: int = 11, names: dict[str, tuple[str, ...]] | None = None, wrappers: tuple[str, ...] = ("", "div", "div div", "main"), named: float = 0.45) -> list[tuple[str, list[bool]]]:
    """Pages put together from random words by random layouts, and whether each leaf block belongs to the article.

    A share `named` of the pages has class and id names from `names` (by kind of part; default: TRAINED_NAMES); of the others, one half has names
    that say nothing and one half none. `wrappers` are the elements that may stand around the page's parts.
    """
    r = random.Random(seed)
    names = TRAINED_NAMES if names is None else names
    word = lambda: "".join(r.choice("abdefgilmnorstué") for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    pages = []

    def sentence(a: int = 3, b: int = 60, cue: str = "", often: float = 0.5) -> str:
        own = words(a, b).split()
        if cue in CUES and r.random() < often:
            own.insert(r.randrange(len(own) + 1), r.choice(CUES[cue].split()))
        return " ".join(own).capitalize() + r.choice("...!?")

    for _ in range(n):
        out: list[str] = []
        labels: list[bool] = []
        style = r.random()
        mode = "names" if style < named else "odd" if style < (1 + named) / 2 else "bare"

        def put(tag: str, text: str, label: bool, attributes: str = "", close: bool = True) -> None:
            out.append(f"<{tag}{attributes}>{text}" + f"</{tag}>" * close)
            labels.append(label)

        def links() -> None:
            tag = r.choice(["ul", "ul", "div"])
            out.append(f"<{tag}>")
            for _ in range(r.randint(2, 7)):
                put("li" if tag == "ul" else r.choice(["div", "p"]), f'<a href="/{word()}">{words(1, 3)}</a>', False)
            out.append(f"</{tag}>")

        def name(kind: str) -> str:
            if mode == "bare":
                return ""
            value = r.choice(["", "site-", "main-", "c-", "box "]) + r.choice(names[kind]) if mode == "names" else r.choice(["zone-", "x", "part_", "c"]) + r.choice("abcdefgh123456")
            return f' {r.choice(["class", "id"])}="{value}"'

        def around(kind: str, inside: bool) -> None:
            """A part that isn't of the article, marked by its element, its name, or where neither is given by what it holds."""
            element = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "ad": "div", "note": "div", "talk": "section", "form": "form", "share": "div"}[kind]
            telling = element not in ("div", "section")
            tag = element if r.random() < (0.6 if mode == "names" or not inside else 1.0) else "div"
            if inside and mode != "names" and not telling:
                tag = "aside"  # nothing else would tell it from the article around it
            own = name(kind) if tag == "div" or tag == "section" or r.random() < 0.4 else ""
            if own and tag == "div" and kind in ("side", "talk", "head", "foot", "menu") and r.random() < 0.3:
                tag = "section"
            out.append(f"<{tag}{own}>")
            if kind in ("menu", "side") and (r.random() < 0.8 or tag == "div"):
                if r.random() < 0.4:
                    put("h3", sentence(1, 2, kind)[:-1], False)
                links()
            elif kind == "form":
                put(r.choice(["label", "p", "div"]), words(1, 6), False)
                out.append('<input type="text" name="q">')
                if r.random() < 0.3:
                    out.append("<select>")
                    for _ in range(r.randint(1, 4)):
                        put("option", words(1, 2), False)
                    out.append("</select>")
                put("button", words(1, 2), False)
            elif kind == "talk":
                if mode == "names" or r.random() < 0.7:
                    put("h2", sentence(1, 2, kind, 0.8)[:-1], False)
                for _ in range(r.randint(1, 5 if mode == "names" else 3)):
                    put(r.choice(["p", "div", "li"]), sentence(2, 50 if mode == "names" else 18, kind, 0.3), False)
            elif kind == "head":
                put(r.choice(["h1", "div", "p", "a"]), words(1, 4), False) if r.random() < 0.5 else put("div", words(1, 4), False)
                if r.random() < 0.4:
                    links()
            elif kind == "foot":
                put(r.choice(["p", "div"]), r.choice(["&copy; ", "© ", ""]) + sentence(2, 20, kind, 0.4), False)
                if r.random() < 0.3:
                    links()
            else:
                inner = r.choice(["", "p", "div"])
                if inner:
                    for _ in range(r.randint(1, 2)):
                        put(inner, sentence(2, 25, kind), False)
                else:
                    out.append(sentence(2, 25, kind))
                    labels.append(False)
            out.append(f"</{tag}>")

        wrap = r.choice(wrappers).split()
        out.append(f"<html><head><title>{words(2, 8)}</title></head><body>")
        out += [f"<{w}>" for w in wrap]
        minimal = r.random() < 0.12
        for kind in ("note", "head", "menu", "ad"):
            if not minimal and r.random() < (0.7 if kind in ("head", "menu") else 0.35):
                around(kind, False)
        holder = r.choice(["article"] * 5 + ["main"] * 2 + ["div"] * 5 + ["div div"]) if not minimal else ""
        if not holder and not minimal:
            holder = "div"
        bare = mode != "names" and holder.startswith("div")
        for i, tag in enumerate(holder.split()):
            own = name("text") if i == 0 and (tag == "div" or r.random() < 0.3) else ""
            out.append(f"<{tag}{own}>")
        shape = r.choice(["p", "p", "p", "div"])
        if r.random() < (0.3 if minimal else 0.85):
            put("h1", words(2, 10) + r.choice(["", "", "."]), True)
        for _ in range(r.randint(1, 4) if minimal else r.randint(3 if bare else 1, 14)):
            x = r.random()
            own = f' class="{r.choice(["lead ", ""])}{r.choice(sum(map(list, names.values()), []))}-{r.choice(["on-", ""])}{word()}"' if r.random() < 0.06 else f' class="{r.choice(sum(map(list, names.values()), []))}"' if r.random() < 0.02 else ""
            if x < 0.74 or minimal:
                put(shape, r.choice(["", "", "<b>"]) + sentence(12 if bare else 2, 90, r.choice(list(CUES)), 0.04), True, own, close=shape == "div" or r.random() < 0.85)
            elif x < 0.80:
                put(r.choice(["h2", "h3"]), words(1, 6), True, own)
            elif x < 0.85:
                out.append("<ul>")
                for _ in range(r.randint(1, 4)):
                    put("li", sentence(2, 20), True)
                out.append("</ul>")
            elif x < 0.88:
                put(r.choice(["blockquote", "pre", "figcaption"]), sentence(3, 30), True, own)
            elif x < 0.90:
                out.append("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    put("td", words(1, 5), True)
                out.append("</tr></table>")
            elif x < 0.92:
                out.append("<select>")
                for _ in range(r.randint(1, 4)):
                    put("option", words(1, 3), False)
                out.append("</select>")
            else:
                around(r.choice(["ad", "side", "note", "share", "form", "talk"]), True)
        for kind in ("talk", "share"):
            if not minimal and r.random() < 0.2:
                around(kind, True)
        out += [f"</{tag}>" for tag in reversed(holder.split())]
        for kind in ("talk", "side", "form", "ad", "foot", "note"):
            if not minimal and r.random() < (0.7 if kind == "foot" else 0.3):
                around(kind, False)
        out += [f"</{w}>" for w in reversed(wrap)]
        out.append("</body></html>")
        pages.append(("".join(out), labels))
    return pages


@lru_cache(maxsize=4)
def trained(n: int = 500, seed: int = 11) -> Crf:
    """The model, from `n` labelled pages; pages whose layout gives other blocks than were labelled are left out. Made once in a process."""
    ready = []
    for page, labels in labelled_pages(n, seed):
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            ready.append((block_features(blocks), labels))
    return fit_crf(ready)


def main_text(page: str | None, model: Crf) -> tuple[str, int, int]:
    """The article's blocks joined by line feeds, how many they are, and how many blocks the page has."""
    blocks = leaf_blocks(page or "")
    kept = [b.text for b, label in zip(blocks, model.decode(block_features(blocks))) if label]
    return "\n".join(kept), len(kept), len(blocks)


def _text_rows(model: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page, model) for page in batch.column(2).to_pylist()]
            texts = [t for t, _, _ in found]
            columns = [pa.array(texts, pa.string()), *[pa.array(x, pa.int64()) for x in (map(len, texts), (n for _, n, _ in found), (n for _, _, n in found))]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["page_id", "url", "text", "n_chars", "n_kept", "n_blocks"])

    return run


def extract_text(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """The main text of each row of `pages` (page_id, url, html).

    Returns page_id, url, text, n_chars (code points), n_kept and n_blocks (leaf blocks of the article, and in all).
    Null, empty and textless pages give an empty text. Rows are independent of each other, so
    repeated ones each get theirs; ids and urls may be null. An empty table gives no rows; other columns
    don't matter. A page has to fit into a task's memory; broken markup is borne.
    """
    types = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    schema = f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long, n_kept long, n_blocks long"
    return pages.select("page_id", "url", "html").mapInArrow(_text_rows(model or trained()), schema)
