"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text with no block element inside. Each block has features of its ancestors
(tags, words of class, id and role) and of its text. The field is trained by maximum likelihood on labelled pages and
decoded by Viterbi; blocks labelled main are joined in page order. The labelled pages are written by `labelled_pages`,
in many layouts with and without telling markup, from a seed: no table is needed to train, and every session trains
the same weights.

A null or empty page gives an empty text. Broken markup is read as far as it goes: unclosed elements end with their
parents, also those whose text is skipped; an option ends at the next one, the head at the first thing that is not head
content; a tag without its end is text; a quote in a tag opens a value only after an equals sign. Reading takes time in
proportion to the page, whatever its markup. Character references are decoded piece by piece between tags and comments.
Text for readers whose browser lacks a feature (noscript, and what stands inside audio, video, canvas, textarea) is no text of
the page; where such an element is not closed, that is the rest of its parent, as in a browser. Repeated rows get equal
results; other columns do not matter.
"""

from __future__ import annotations

import html as references
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by their role in HTML.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp".split())
SKIPPED = set("applet audio button canvas datalist head iframe noembed noframes noscript object optgroup option select svg template video".split())
#: Skipped elements that may hold their like, that hold plain text, and what may stand in a head.
NESTED, PLAIN = set("object svg template".split()), set("iframe noembed noframes".split())
HEAD = set("base basefont bgsound html head link meta noframes noscript script style template title".split())
MINOR = set("section ul ol dl table blockquote figure".split())
SEMANTIC = set("article aside blockquote dialog figcaption figure footer form header main nav section table ul ol dl".split())
#: Words of class, id and role attributes, by what they tell.
CLASS_WORDS = {
    "ad": "ad ads adv advert advertisement adsense advertising banner sponsor sponsored promo promotion dfp",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip topbar",
    "header": "header masthead head logo branding site top",
    "footer": "footer foot bottom copyright colophon legal",
    "side": "sidebar side aside rail widget widgets complementary secondary",
    "comment": "comment comments commentlist reply replies respond discussion disqus responses reader",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay message warning dialog toast",
    "share": "share sharing social follow twitter facebook tools meta byline author date tags",
    "related": "related recommended recommendations more popular trending latest teaser teasers newsletter subscribe signup",
    "form": "form search searchbox login register contact",
    "main": "article content main post entry story body text page copy prose maincontent articlebody",
}
_GROUP = {word: group for group, words in CLASS_WORDS.items() for word in words.split()}
#: A tag: in attributes a quote opens a value only after an equals sign. And the same where quotes do not pair up.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+|[\"']))*+)>")
_BARE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_LABEL = re.compile(r"data-main=\"1\"")
_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}
_OPTIONS = {"option": "option", "optgroup": "option optgroup", "select": "option optgroup select"}
_KEEPS = set("ul ol dl table menu".split())


class Place:
    """Where text stands: the element, what is around it by the nearest telling one, all telling ones, depth and label.

    Made once for an element from its parent's, so that deep pages cost no more than flat ones.
    """

    __slots__ = ("tag", "near", "has", "depth", "label")

    def __init__(self, tag: str = "body", near: str = "none", has: frozenset[str] = frozenset(), depth: int = 0, label: bool = False):
        self.tag, self.near, self.has, self.depth, self.label = tag, near, has, depth, label

    def inside(self, tag: str, groups: tuple[str, ...], label: bool) -> Place:
        near, more = self.near, {f".{g}" for g in groups}
        if tag in SEMANTIC:
            more.add(tag)
            if tag not in MINOR or near == "none":
                near = tag
        if groups:
            near = f".{groups[-1]}"
        return Place(tag, near, self.has | more if more - self.has else self.has, min(self.depth + 1, 6), self.label or label)


class Block:
    """A leaf block: its text, its place, and how many of its words are links."""

    __slots__ = ("text", "place", "linked")

    def __init__(self, text: str, place: Place, linked: int):
        self.text, self.place, self.linked = text, place, linked

    @property
    def label(self) -> int:
        return int(self.place.label)


def _groups(attributes: str) -> tuple[str, ...]:
    found = []
    for _, a, b, c in _NAMED.findall(attributes):
        found += [_GROUP[w] for w in map(str.lower, _WORD.findall(a or b or c)) if w in _GROUP]
    return tuple(found)


class Scanner:
    """The tags of a page in order, in linear time."""

    def __init__(self, page: str):
        self.page, self.at, self.tag = page, 0, _TAG
        self.last = page.rfind(">")
        self.ends: dict[str, int] = {}

    def find(self, what: str) -> int:
        """The next place of a fixed text, the end of the page if there is none; kept until it is passed."""
        if self.ends.get(what, -1) < self.at:
            place = self.page.find(what, self.at)
            self.ends[what] = len(self.page) if place < 0 else place
        return self.ends[what]

    def next(self) -> tuple[str, re.Match | None] | None:
        """(the text before, a tag or nothing for a comment or declaration); None at the end. A tag without its end is text."""
        page, start = self.page, self.at
        look = start
        while (begin := page.find("<", look)) >= 0 and begin < self.last:
            if page.startswith("<!--", begin):
                self.at = begin + 4
                if page.startswith((">", "->"), self.at):
                    self.at = page.index(">", self.at) + 1
                else:
                    self.at = min(len(page), self.find("-->") + 3)
                return page[start:begin], None
            if page.startswith("<![CDATA[", begin):
                self.at = begin
                self.at = min(len(page), self.find("]]>") + 3)
                return page[start:begin], None
            if page.startswith(("<!", "<?"), begin):
                self.at = page.index(">", begin) + 1
                return page[start:begin], None
            tag = self.tag.match(page, begin)
            if tag is None and page[begin + 1 : begin + 3].lstrip("/")[:1].isalpha() and page[begin + 1 : begin + 3].lstrip("/")[:1].isascii():
                self.tag = _BARE_TAG  # no end outside quotes up to the end of the page: from here on quotes are plain characters
                tag = self.tag.match(page, begin)
            if tag:
                self.at = tag.end()
                return page[start:begin], tag
            look = begin + 1
        return None


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    out: list[Block] = []
    #: Open elements with their places; for a skipped element, whether it has an end tag of its own.
    stack: list[tuple[str, Place, bool]] = []
    parts: list[str] = []
    link_parts: list[str] = []
    in_link, skip = False, 0
    scan = Scanner(page)
    opened: Counter[str] = Counter()
    body = Place()
    place = lambda: stack[-1][1] if stack else body
    next_tag: dict[str, tuple[int, bool, int]] = {}

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, place(), len("".join(link_parts).split())))
            parts.clear()
            link_parts.clear()

    def cut(k: int) -> None:
        nonlocal skip
        skip -= sum(s[0] in SKIPPED for s in stack[k:])
        opened.subtract(s[0] for s in stack[k:])
        del stack[k:]

    def close(name: str) -> None:
        for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
            if stack[k][0] == name:
                cut(k)
                break

    def leave_head() -> None:
        for k in range(len(stack) - 1, -1, -1) if opened["head"] else ():
            if stack[k][0] == "head":
                cut(k)
            elif stack[k][0] not in SKIPPED or stack[k][2]:
                break

    def ended(name: str) -> int:
        """Where the end tag of the skipped element that begins before here ends, 0 if it has none."""
        if next_tag.get(name, (-1,))[0] < scan.at:
            tag = re.compile(rf"<(/{'' if name in NESTED | PLAIN else '?'}){name}(?=[\s/>])[^>]*>", re.I).search(page, scan.at)
            next_tag[name] = (tag.start(), bool(tag[1]), tag.end()) if tag else (len(page), False, 0)
        _, closes, end = next_tag[name]
        return end if closes else 0

    def add(text: str) -> None:
        if skip and stack[-1][0] == "head" and text.strip():
            leave_head()
        if text and not skip:
            # A reference lies within one piece of text: what tags or comments part does not join to one.
            text = references.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                link_parts.append(text)

    while (step := scan.next()) is not None:
        before, tag = step
        add(before)
        if tag is None:
            continue
        closing, name = tag[1], tag[2].lower()
        if skip and not closing and name not in HEAD:
            leave_head()
        if name in RAW and not closing:
            end = re.compile(rf"</{name}[^>]*>", re.I).search(page, scan.at)
            scan.at = end.end() if end else len(page)
        elif name in SKIPPED:
            if closing:
                close(name)
            elif not tag[3].rstrip().endswith("/"):
                end = ended(name)
                if end and name in PLAIN:
                    scan.at = end
                    continue
                while skip and name in _OPTIONS and stack[-1][0] in _OPTIONS[name].split():
                    cut(len(stack) - 1)
                stack.append((name, place(), end > 0))
                opened[name] += 1
                skip += 1
        elif name == "body" and not closing:
            flush()
            cut(next((k for k, s in enumerate(stack) if s[0] in SKIPPED), len(stack)))
        elif name == "br":
            add(" ")
        elif name == "a":
            in_link = not closing
        elif name in BLOCK:
            flush()
            in_link = False
            if closing:
                close(name)
            elif name not in VOID and name not in ("html", "body"):
                ends = _CLOSES.get(name, "").split()
                for k in range(len(stack) - 1, -1, -1) if opened["p"] or any(opened[e] for e in ends) else ():
                    if stack[k][0] in SKIPPED:
                        if stack[k][2]:
                            break
                    elif stack[k][0] == "p" or stack[k][0] in ends:
                        cut(k)
                        if not ends or stack and stack[-1][0] in _KEEPS:
                            break
                    elif stack[k][0] in _KEEPS or not ends:
                        break
                stack.append((name, place().inside(name, _groups(tag[3]) if tag[3] else (), bool(tag[3]) and bool(_LABEL.search(tag[3]))), False))
                opened[name] += 1
    add(page[scan.at :])
    flush()
    return out


def _bucket(value: float, bounds: tuple[float, ...]) -> int:
    return sum(value >= b for b in bounds)


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    for k, block in enumerate(blocks):
        n = len(block.text.split())
        text, near = block.text, block.place.near
        size = _bucket(n, (3, 6, 12, 25, 60))
        share = _bucket(block.linked / max(n, 1), (0.01, 0.3, 0.6))
        f = ["bias", f"tag={block.place.tag}", f"near={near}", f"words={size}", f"links={share}", f"near={near} words={size}"]
        f += [f"in={x}" for x in sorted(block.place.has)]
        f.append("ends" if text[-1] in ".!?…:;\"”»)" else "open")
        if "©" in text or "copyright" in text.lower() or "rights reserved" in text.lower():
            f.append("copyright")
        f.append(f"depth={block.place.depth}")
        f.append("first" if k == 0 else "last" if k == len(blocks) - 1 else "inner")
        out.append(f)
    return out


class Field:
    """A two-label linear chain: one weight a feature for label main, and a weight for each pair of neighbours' labels."""

    def __init__(self, weight: dict[str, float], step: np.ndarray):
        self.weight, self.step = weight, step

    @classmethod
    def train(cls, pages: list[str], rounds: int = 250, decay: float = 2e-3, rate: float = 0.15) -> Field:
        """Maximum conditional likelihood with an L2 penalty, by gradient steps over all pages at once."""
        read = [leaf_blocks(p) for p in pages]
        read = [r for r in read if r]
        named = [features(r) for r in read]
        names = sorted({f for page in named for block in page for f in block})
        index = {f: i for i, f in enumerate(names)}
        longest = max(map(len, read))
        gold = np.zeros((len(read), longest), int)
        there = np.zeros((len(read), longest), bool)
        rows, cols = [], []
        for p, (page, blocks) in enumerate(zip(named, read, strict=True)):
            there[p, : len(blocks)] = True
            gold[p, : len(blocks)] = [b.label for b in blocks]
            for t, block in enumerate(page):
                rows += [p * longest + t] * len(block)
                cols += [index[f] for f in block]
        rows, cols = np.array(rows), np.array(cols)
        w, step = np.zeros(len(names)), np.zeros((2, 2))
        slow = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, step)]
        pairs = there[:, 1:]
        for n in range(1, rounds + 1):
            score = np.bincount(rows, w[cols], len(read) * longest).reshape(gold.shape)
            node = np.stack([np.zeros_like(score), score], 2)
            ahead, back = np.zeros_like(node), np.zeros_like(node)
            ahead[:, 0] = node[:, 0]
            for t in range(1, longest):
                ahead[:, t] = node[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + step, axis=1)
            for t in range(longest - 2, -1, -1):
                later = np.logaddexp.reduce(step + (node[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
                back[:, t] = np.where(there[:, t + 1, None], later, 0)
            belief = ahead + back
            total = np.logaddexp.reduce(belief, axis=2, keepdims=True)
            chance = np.exp(belief - total)[:, :, 1]
            two = ahead[:, :-1, :, None] + step + (node[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, :-1, :, None]
            expected = (np.exp(two) * pairs[:, :, None, None]).sum((0, 1))
            seen = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)])
            error = np.where(there, gold - chance, 0).ravel()
            grads = (np.bincount(cols, error[rows], len(names)) / len(read) - decay * w, (seen - expected) / len(read) - decay * step)
            for x, g, (m, v) in zip((w, step), grads, slow, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
        return cls({f: float(w[i]) for f, i in index.items()}, step)

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most probable labels of a page's blocks."""
        if not blocks:
            return []
        get, (s00, s01), (s10, s11) = self.weight.get, *self.step.tolist()
        no, yes = 0.0, 0.0
        came: list[tuple[int, int]] = []
        for t, names in enumerate(features(blocks)):
            score = sum(get(f, 0.0) for f in names)
            if t == 0:
                no, yes = 0.0, score
                continue
            from_no = 0 if no + s00 >= yes + s10 else 1
            from_yes = 0 if no + s01 > yes + s11 else 1
            came.append((from_no, from_yes))
            no, yes = max(no + s00, yes + s10), max(no + s01, yes + s11) + score
        label = int(yes > no)
        out = [label]
        for pair in reversed(came):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        return "\n".join(b.text for b, label in zip(blocks, self.decode(blocks), strict=True) if label)


def labelled_pages(count: int = 240, seed: int = 11) -> list[str]:
    """Pages in varied layouts; elements of the main text carry data-main="1"."""
    draw = random.Random(seed)
    syllables = "an be co da el fi ga ho in jo ka lu me no os pa qui ra se ti un ve wi yo zu er th on st ée ñu äh".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(draw.randint(low, high)))

    def prose(low: int = 8, high: int = 120) -> str:
        text = words(low, high).capitalize() + draw.choice([".", ".", ".", "!", "?", ""])
        return text.replace(" ", ", ", 1) if draw.random() < 0.3 else text

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(n))

    def pick(group: str) -> str:
        word = draw.choice(CLASS_WORDS[group].split())
        return draw.choice([f'class="{word}"', f'id="{word}"', f'class="{word}-box wide"', f'class="site {word}"' if group != "main" else f'id="{word}"'])

    main = 'data-main="1"'

    def body() -> str:
        out = [f"<{(h := draw.choice(['h1', 'h1', 'h2']))} {main}>{words(2, 12).capitalize()}</{h}>"] if draw.random() < 0.9 else []
        for _ in range(draw.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = draw.random()
            if kind < 0.72:
                inner = prose(1, 120) if draw.random() < 0.85 else f"<b>{prose(4, 40)}<br>"
                out.append(f"<p {main}>{inner}" + draw.choice(["</p>", "</p>", "</p>", ""]))
            elif kind < 0.8:
                out.append(f"<h3 {main}>{words(2, 7)}</h3>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li {main}>{prose(3, 25)}</li>" for _ in range(draw.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p {main}>{prose(8, 40)}</p></blockquote>")
            elif kind < 0.92:
                out.append("<table>" + "".join(f"<tr><td {main}>{words(1, 4)}</td><td {main}>{words(1, 8)}</td></tr>" for _ in range(draw.randint(1, 3))) + "</table>")
            elif kind < 0.94:
                out.append(f"<figure><img src=x><figcaption {main}>{prose(4, 15)}</figcaption></figure>")
            elif kind < 0.96:
                out.append(f"<div {main}>{prose(10, 80)}</div>")
            else:
                out.append(draw.choice([f"<div {pick('ad')}><p>{prose(3, 30)}</p></div>", f"<aside><p>{prose(4, 40)}</p></aside>", f"<div {pick('share')}><a href=s>{words(1, 2)}</a> <a href=t>{words(1, 2)}</a></div>", f"<div {pick('related')}><ul>{links(3)}</ul></div>"]))
        return "".join(out)

    def comments() -> str:
        each = "".join(draw.choice([f"<div class=comment><b>{words(1, 2)}</b><p>{prose(3, 60)}</p></div>", f"<li><p>{words(1, 2)}</p><p>{prose(3, 60)}</p></li>", f"<article class=comment><p>{prose(4, 60)}</p></article>"]) for _ in range(draw.randint(1, 4)))
        return draw.choice([f"<section {pick('comment')}><h3>{words(1, 2)}</h3>{each}</section>", f"<div {pick('comment')}>{each}</div>"])

    pages = []
    for k in range(count):
        around = {
            "nav": lambda: draw.choice([f"<nav><ul>{links(draw.randint(2, 8))}</ul></nav>", f"<div {pick('nav')}><ul>{links(5)}</ul></div>", f"<ul>{links(6)}</ul>", f"<nav><p>{words(1, 4)}</p></nav>"]),
            "header": lambda: draw.choice([f"<header><h1>{words(1, 4)}</h1><p>{words(2, 8)}</p></header>", f"<div {pick('header')}><p>{words(1, 8)}</p></div>", f"<header><div>{words(1, 3)}</div></header>"]),
            "ad": lambda: draw.choice([f'<div class="ad">{prose(2, 30)}</div>', f"<div {pick('ad')}><p>{prose(2, 40)}</p></div>", f"<aside {pick('ad')}>{prose(3, 30)}</aside>"]),
            "side": lambda: draw.choice([f"<aside><h3>{words(1, 3)}</h3><p>{prose(3, 60)}</p><ul>{links(4)}</ul></aside>", f"<div {pick('side')}><h4>{words(1, 3)}</h4><p>{prose(3, 60)}</p></div>", f"<div {pick('related')}><p>{prose(3, 20)}</p><ul>{links(4)}</ul></div>"]),
            "notice": lambda: draw.choice([f"<div {pick('notice')}><p>{prose(5, 40)}</p></div>", f"<div role=alert>{prose(4, 30)}</div>", f"<dialog><p>{prose(4, 30)}</p></dialog>", f"<section {pick('notice')}>{prose(5, 40)}</section>"]),
            "form": lambda: f"<form {draw.choice(['', pick('form')])}><label>{words(1, 4)}</label><p>{prose(3, 25)}</p><input><button>{words(1, 1)}</button></form>",
            "footer": lambda: draw.choice([f"<footer>&copy; {words(1, 2)} &middot; {prose(3, 25)}</footer>", f"<footer><p>{prose(3, 40)}</p><ul>{links(3)}</ul></footer>", f"<div {pick('footer')}><p>{words(2, 12)}</p></div>"]),
            "comment": comments,
        }
        some = lambda name, share: around[name]() if draw.random() < share else ""
        inside = body() + some("comment", 0.15) + (f"<footer><p>{words(2, 12)}</p></footer>" if draw.random() < 0.1 else "") + some("form", 0.08)
        holder = draw.choice(["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", f"<div {pick('main')}>{{}}</div>", f"<div {pick('main')}>{{}}</div>", f"<section {pick('main')}>{{}}</section>", "<div>{}</div>", "{}"])
        page = "".join(some(n, s) for n, s in (("header", 0.5), ("nav", 0.8), ("notice", 0.3), ("ad", 0.4), ("side", 0.2))) + holder.format(inside)
        page += "".join(some(n, s) for n, s in (("comment", 0.35), ("side", 0.35), ("form", 0.3), ("ad", 0.2), ("notice", 0.15), ("footer", 0.8)))
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{page}" + draw.choice(["</body></html>", ""]))
    return pages


@lru_cache(maxsize=4)
def trained(count: int = 240, seed: int = 11) -> Field:
    """The field trained on `count` labelled pages: the bound on what it is fitted to."""
    return Field.train(labelled_pages(count, seed))


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """Per page: page_id, url, text and n_chars (its code points)."""
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [field.main_text(page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
