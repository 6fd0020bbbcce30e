"""Main text of web pages with wrappers inferred per host.

A page is a stream of tags and texts.  Runs of equal blocks in it are folded into repeated groups.  The streams
of a host are aligned one after another, without unions: what both have stays, a text that differs becomes a
slot, what only one has becomes optional.  The result is the host's wrapper.  Each page is parsed by it, which gives
every text a place in the wrapper.  A text that stands at its place on all pages that have the place, two
different pages at least, is template; what differs from page to page fills a slot.  The slots' texts tell in
which element the main text stands: an article or main element, else the innermost one that holds all of the
text that is no link.  Inside an article or main element the markup itself says that a text is content, so
equal texts there are no template.

Class names and ids decide only where structure doesn't: outside an article or main element a name that tells of a
menu, notice, advert and so on marks a part as no content; inside one, a whole name has to say so, of an element
that holds others, or of a text block where it can mean nothing else; a header there belongs to its article.  Names never
leave a page with next to nothing: where what they mark holds all but a twentieth of the text, the marks of the parts
that hold more than half of it don't count.

The streams are counted by host and structure before anything is gathered, so a host with very many pages
brings its different structures only; those are aligned in groups of about ``GROUP``, level by level.  Streams are
aligned at what stands once in both, and whole between those places; longer stretches without such a place are
aligned in halves until a part has ``ALIGNED`` pairs at most, so a long page costs no square of its length.  A host's
element paths, with their sums, are chosen from in one group.
Each page then is cut by its host's wrapper: the slots' texts inside the main element, less what lies in
menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles within it.  A page
that lacks its host's main element is cut by the slots' texts of its own stream alone.

Rules: null html is empty; a page without main text has an empty text; a null or odd URL is a host of its
own name; pages of any length and depth are read whole; rows with one id, or repeated rows, are cut each for itself;
of elements with equal weight the deepest, then the greatest number counts; an empty table gives an empty table;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import difflib
import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm._spark import cut, small_batches

GROUP = 64
#: Blocks up to this length are tried at every place; longer ones where a token comes again at their distance.
SHORT_BLOCK = 16
#: Pairs of tokens that are aligned whole.
ALIGNED = 250_000
MARK = 80
BROADCAST_HOSTS = 20_000
BROADCAST_BYTES = 32 << 20
#: The path of what stands in no element, and of what would hold that.
TOP, NOWHERE = 0, -1

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^"'>]+|"[^"]*"|'[^']*'|["'])*)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO_CONTENT = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "label", "search", "object", "canvas", "audio", "video"} | RAW
NO_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}
# Fixed words of class names and ids: what is no content, which of these say so of a text block too, and what they are joined with.
ASIDE = "ads? advert\\w* banner sponsor\\w* promo\\w* cookies? consent gdpr notices? alerts? popup modal overlay comments? disqus respond replies sidebar side menu nav navbar navigation breadcrumbs? share sharing social related recommended newsletter subscribe subscription footer header masthead pagination pager toolbar widgets? skip login signup"
ASIDE_TEXT = "ads? advert\\w* sponsor\\w* promo\\w* cookies? consent gdpr notices? comments? breadcrumbs? share sharing newsletter subscribe pagination"
JOINED = "section list box block area wrap wrapper container bar panel links? posts? articles? items? form thread slot unit body content inner top bottom left right main site page user reader [0-9]+"
HOLDERS = {"address", "center", "details", "div", "dl", "fieldset", "figure", "hgroup", "ol", "section", "summary", "table", "tbody", "tr", "ul"}


def _names(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


BOILER = re.compile(rf"(?:^|[-_\s]){_names(ASIDE)}(?:[-_\s]|$)", re.I)
# inside an article or main element a header is the article's own
INSIDE = " ".join(x for x in ASIDE.split() if x not in ("header", "masthead"))
WHOLE, WHOLE_TEXT = (re.compile(rf"(?:{_names(JOINED)}[-_]+)*{_names(x)}(?:[-_]+(?:{_names(JOINED)}|{_names(ASIDE)}))*", re.I) for x in (INSIDE, ASIDE_TEXT))
#: Where names leave less than this share of a page's text, those of its largest parts don't count.
LEAST_LEFT = 0.05
TAG = 0


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return (m[1] if m else (url or "")).lower()


def number(text: str) -> int:
    """A 64-bit number of a text, the same on all workers."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Page:
    """The stream of a page: tags and '#' for texts; of each text its characters, element path, block and whether it is content.

    A path is a number made of the parent's path and the element's key; ``elements`` has each path's parent, name and depth.
    """

    def __init__(self, source: str):
        self.stream: list[str] = []
        self.texts: list[tuple] = []  # text, path, block, boilerplate, in a link, in an article or main element
        self.elements: dict[int, tuple[int, str, int]] = {TOP: (NOWHERE, "", 0)}
        stack: list[tuple[str, int, tuple[int, ...], bool, bool]] = []  # name, path, what marks it as no content (a tag, or numbers of elements by their names), in a link, in an article or main element
        named = TAG
        held, pieces = Counter(), []  # open elements by name; the pieces of each text
        block, raw_until, at, n = 0, None, 0, len(source)
        while at < n:
            if raw_until is not None:
                end = re.compile(rf"</{re.escape(raw_until)}\b", re.I).search(source, at)
                at, raw_until = (end.start() if end else n), None
                continue
            m = TOKEN.match(source, at)
            at = m.end()
            name = m[2]
            if name is None:
                piece = m[0]
                if piece[:2] in ("<!", "<?"):
                    continue
                path, boiler, link, inside = stack[-1][1:] if stack else (TOP, (), False, False)
                if self.texts and self.stream[-1] == "#" and self.texts[-1][1:3] == (path, block):
                    pieces[-1].append(piece)
                else:
                    self.texts.append(("", path, block, boiler, link, inside))
                    pieces.append([piece])
                    self.stream.append("#")
                continue
            name = name.lower()
            if name in BLOCK:
                block += 1
            if m[1]:
                if held[name]:
                    while self._pop(stack, held) != name:
                        pass
                    self.stream.append(f"</{name}>")
                continue
            if name == "br" and self.texts and self.texts[-1][2] == block:
                pieces[-1].append("\n")
            if name in VOID:
                self.stream.append(f"<{name}>")
                continue
            self._close_before(stack, held, name)
            mark = self._mark(m[3])
            key = name + (f".{mark}" if mark else "")
            parent, boiler, link, inside = stack[-1][1:] if stack else (TOP, (), False, False)
            if name in NO_CONTENT or (name == "header" and not inside):
                boiler = (TAG,)
            elif mark and boiler[:1] != (TAG,) and self._is_boiler(name, m[3], inside):
                named += 1
                boiler = (*boiler[-7:], named)  # of deeper ones the innermost count
            path = number(f"{parent}/{key}")
            self.elements[path] = (parent, name, len(stack) + 1)
            stack.append((name, path, boiler, link or name == "a", inside or name in ("article", "main")))
            held[name] += 1
            self.stream.append(f"<{key}>")
            if name in RAW:
                raw_until = name
        self.texts = [("".join(p), *x[1:]) for p, x in zip(pieces, self.texts, strict=True)]
        self.texts = [(" ".join(html.unescape(t).split()), *rest) for t, *rest in self._spaced()]
        self._settle()

    def _settle(self) -> None:
        """Decide which texts are boilerplate: marks by tags and by names, but for names that would leave next to nothing."""
        sizes, total, left = Counter(), 0, 0
        for text, _, _, marks, link, _ in self.texts:
            if marks[:1] != (TAG,) and not link:
                total += len(text)
                left += 0 if marks else len(text)
                for mark in marks:
                    sizes[mark] += len(text)
        large = {mark for mark, size in sizes.items() if 2 * size > total} if left < LEAST_LEFT * total else set()
        self.texts = [(text, path, block, bool(set(marks) - large), link, inside) for text, path, block, marks, link, inside in self.texts]

    @staticmethod
    def _pop(stack: list, held: Counter) -> str:
        name = stack.pop()[0]
        held[name] -= 1
        return name

    def _spaced(self):
        """White space at the joints of a block's texts is kept until the texts are joined."""
        self.joints = [(t[:1].isspace() or t[:1] == "", t[-1:].isspace()) for t in (html.unescape(x[0]) for x in self.texts)]
        return self.texts

    def _close_before(self, stack: list, held: Counter, name: str) -> None:
        """Close what an opening tag ends: an open paragraph, and elements of its own kind up to the list or table that holds them."""
        if name in BLOCK and held["p"]:
            last = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK)
            while len(stack) > last and (stack[last][0] == "p"):
                self._pop(stack, held)
        ends = CLOSES.get(name)
        if ends and any(held[x] for x in ends):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    while len(stack) > i:
                        self._pop(stack, held)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "div", "article"):
                    break

    @staticmethod
    def _mark(attributes: str) -> str:
        found = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        mark = re.sub(r"[0-9]+", "0", "#".join(found[k].strip().lower() for k in ("class", "id", "role") if found.get(k))).replace("/", "|")
        return mark if len(mark) <= MARK else f"{mark[:MARK]}~{number(mark[MARK:]):x}"

    @staticmethod
    def _is_boiler(name: str, attributes: str, inside: bool) -> bool:
        if name in ("html", "body", "article", "main"):
            return False
        for a, b, c, d in ATTRIBUTE.findall(attributes):
            value, kind = b or c or d, a.lower()
            if kind == "role" and value.lower() in NO_ROLE:
                return True
            if kind not in ("class", "id"):
                continue
            if not inside and BOILER.search(value) or inside and any((WHOLE if name in HOLDERS else WHOLE_TEXT).fullmatch(x) for x in value.split()):
                return True
        return False

    def within(self, main: int | None) -> set[int]:
        """The paths of the main element and of what lies in it."""
        held = set()
        for path, (parent, _, _) in self.elements.items():  # parents come first
            if path == main or parent in held:
                held.add(path)
        return held

    def main_text(self, main: int | None, template: frozenset[int] | set[int] = frozenset()) -> str:
        """The texts inside the main element, less those numbered in template, by block."""
        held = self.within(main)
        blocks: list[tuple[int, str]] = []
        gap = True
        for i, ((text, path, block, boiler, *_), (before, after)) in enumerate(zip(self.texts, self.joints, strict=True)):
            if boiler or i in template or path not in held:
                gap = True
                continue
            if blocks and blocks[-1][0] == block:
                if text:
                    old = blocks[-1][1]
                    blocks[-1] = (block, old + (" " if old and (gap or before) else "") + text)
                gap = after or (gap and not text)
            else:
                blocks.append((block, text))
                gap = after
        return "\n".join(t for _, t in blocks if t)


# -- wrappers -----------------------------------------------------------------------------------


def _long_sizes(stream: list) -> list[int]:
    """Lengths over ``SHORT_BLOCK`` at which a block of the stream may follow itself."""
    _, codes = np.unique(np.array([json.dumps(x) for x in stream], object).astype(str), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    gaps = np.diff(order)[np.diff(codes[order]) == 0]
    sizes, counts = np.unique(gaps[gaps > SHORT_BLOCK], return_counts=True)
    out = []
    for size in sizes[counts > 1].tolist():
        apart = np.flatnonzero(np.concatenate([[True], codes[:-size] != codes[size:], [True]]))
        if np.diff(apart).max() > size:
            out.append(size)
    return out


def fold_places(stream: list, places: list[list]) -> tuple[list, list[list]]:
    """Tandem repeats as groups ['+', block]; places has of each node, for each '#' in it, the numbers of the texts that stand there."""
    stream, places = list(stream), list(places)

    def fold_size(size: int) -> tuple[list, list[list]]:
        out, held, i, n = [], [], 0, len(stream)
        while i < n:
            block, j = stream[i : i + size], i + size
            while len(block) == size and stream[j : j + size] == block:
                j += size
            if j > i + size and not (size == 1 and isinstance(block[0], list)):
                out.append(["+", block])
                held.append(_joined([_flat(places[k : k + size]) for k in range(i, j, size)]))
                i = j
            else:
                out.append(stream[i])
                held.append(places[i])
                i += 1
        return out, held

    for size in range(1, SHORT_BLOCK + 1):
        stream, places = fold_size(size)
    for size in _long_sizes(stream) if len(stream) > 2 * SHORT_BLOCK else ():
        stream, places = fold_size(size)
    return stream, places


def _flat(places: list[list]) -> list:
    return [x for p in places for x in p]


def _joined(repeats: list[list]) -> list:
    """One place for each '#' of a block, of what stands there in its repeats."""
    return [_flat(x) for x in zip(*repeats, strict=True)]


def fold(stream: list) -> list:
    """Tandem repeats as groups ['+', block]."""
    return fold_places(stream, _numbered(stream))[0]


def _absorb(nodes: list, groups: list[list]) -> list:
    """Single occurrences of blocks that the other side repeats become repeated groups too; so do groups that follow each other. Nodes may carry places."""
    for block in {json.dumps(x): x for x in groups}.values():
        size, out, i = len(block), [], 0
        while i < len(nodes):
            if nodes[i][0] == block[0] and [x[0] for x in nodes[i : i + size]] == block:
                part = nodes[i : i + size]
                out.append((["+", block], all(x[1] for x in part), *([_flat([x[2] for x in part])] if len(part[0]) > 2 else [])))
                i += size
            else:
                out.append(nodes[i])
                i += 1
        nodes = []
        for x in out:
            if nodes and isinstance(x[0], list) and x[0] == nodes[-1][0]:
                if len(x) > 2:
                    nodes[-1] = (*x[:1], nodes[-1][1], _joined([nodes[-1][2], x[2]]))
            else:
                nodes.append(x)
    return nodes


def _slots(node) -> int:
    """How many '#' a node has."""
    return sum(map(_slots, node[1])) if isinstance(node, list) else int(node == "#")


def matches(a: list, b: list) -> list[tuple[int, int, int]]:
    """(i, j, size) of stretches that two sequences have in common, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        size = 0
        while i + size < m and j + size < n and a[i + size] == b[j + size]:
            size += 1
        if size:
            out.append((i, j, size))
            i, j = i + size, j + size
        size = 0
        while m - size > i and n - size > j and a[m - size - 1] == b[n - size - 1]:
            size += 1
        if size:
            m, n = m - size, n - size
            out.append((m, n, size))
        if i == m or j == n:
            continue
        if (m - i) * (n - j) <= ALIGNED:
            out += [(i + x, j + y, k) for x, y, k in difflib.SequenceMatcher(None, a[i:m], b[j:n], autojunk=False).get_matching_blocks() if k]
            continue
        once = [Counter(x) for x in (a[i:m], b[j:n])]
        where = {x: y for y, x in enumerate(b[j:n], j) if once[1][x] == 1}
        pairs = [(x, where[k]) for x, k in enumerate(a[i:m], i) if once[0][k] == 1 and k in where]
        # the longest part of these pairs that ascends on both sides
        tails, tops, back = [], [], {}
        for x, y in pairs:
            at = bisect_left(tails, y)
            if at == len(tails):
                tails.append(y)
                tops.append((x, y))
            tails[at], tops[at] = y, (x, y)
            back[x, y] = tops[at - 1] if at else None
        chain, pair = [], tops[-1] if tops else None
        while pair:
            chain.append(pair)
            pair = back[pair]
        for x, y in chain:
            out.append((x, y, 1))
            todo.append((x + 1, m, y + 1, n))
            m, n = x, y
        if chain:
            todo.append((i, m, j, n))
        else:
            x, y = (i + m) // 2, (j + n) // 2
            todo += [(i, x, j, y), (x, m, y, n)]
    return sorted(out)


class Wrapper:
    """A host's expression, by which structures are parsed."""

    def __init__(self, text: str):
        nodes = [x[0] for x in json.loads(text)]
        self.groups = [x[1] for x in nodes if isinstance(x, list)]
        self.keys, self.first, n = [json.dumps(x) for x in nodes], [], 0
        for x in nodes:
            self.first.append(n)
            n += _slots(x)

    def parse(self, nodes: list, places: list[list]) -> dict[int, int]:
        """The wrapper's place of each numbered text of a structure; texts without a place are left out."""
        own = _absorb(list(zip(nodes, [False] * len(nodes), places, strict=True)), self.groups)
        out = {}
        for i, j, size in matches(self.keys, [json.dumps(x[0]) for x in own]):
            for k in range(size):
                for at, texts in enumerate(own[j + k][2]):
                    out.update(dict.fromkeys(texts, self.first[i + k] + at))
        return out


def _numbered(stream: list) -> list[list]:
    """The places of a stream: its texts are numbered in order."""
    out, n = [], 0
    for x in stream:
        out.append([[n]] if x == "#" else [])
        n += x == "#"
    return out


def align(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """One union-free expression for both: lists of (node, optional)."""
    groups = [x[0][1] for x in (*a, *b) if isinstance(x[0], list)]
    a, b = _absorb(a, groups), _absorb(b, groups)
    keys = [[json.dumps(x[0]) for x in side] for side in (a, b)]
    if keys[0] == keys[1]:
        return [(x[0], x[1] or y[1]) for x, y in zip(a, b, strict=True)]
    out, x, y = [], 0, 0
    for i, j, size in [*matches(*keys), (len(a), len(b), 0)]:
        out += [(node[0], True) for node in (*a[x:i], *b[y:j])]
        out += [(p[0], p[1] or q[1]) for p, q in zip(a[i : i + size], b[j : j + size], strict=True)]
        x, y = i + size, j + size
    return out


def main_path(weights: dict[int, list[float]], elements: dict[int, tuple[int, str, int]]) -> int | None:
    """The path of the main element. weights: by path the characters of content and of links in it; elements: by path its parent, name and depth."""
    total = dict.fromkeys(elements, 0.0)
    for path, (content, links) in weights.items():
        if path in total:
            total[path] += content - links
    for path in sorted(elements, key=lambda p: -elements[p][2]):
        if elements[path][0] in total:
            total[elements[path][0]] += total[path]
    by_depth = sorted(elements, key=lambda p: elements[p][2])
    for name in ("article", "main"):
        below, outer = set(), []
        for path in by_depth:
            parent, own, _ = elements[path]
            if parent in below:
                below.add(path)
            elif own == name:
                below.add(path)
                outer.append(path)
        if outer and max(total[p] for p in outer) > 0:
            return max(outer, key=lambda p: (total[p], p))
    best = max(total.values(), default=0)
    if best <= 0:
        return None
    most = [p for p, v in total.items() if v >= (1 - 1e-9) * best]
    return max(most, key=lambda p: (elements[p][2], total[p], p))


def _weights(page: Page, without: frozenset[int] | set[int] = frozenset()) -> dict[int, list[float]]:
    """By path the characters of content and of links in it, less those of the texts numbered in without."""
    out: dict[int, list[float]] = {}
    for i, (text, path, _, boiler, link, _) in enumerate(page.texts):
        if not boiler and i not in without:
            w = out.setdefault(path, [0.0, 0.0])
            w[0] += len(text)
            w[1] += len(text) * link
    return out


def _open(page: Page) -> set[int]:
    """The numbers of the texts that could be template or content: neither boilerplate nor in an article or main element."""
    return {i for i, (text, _, _, boiler, _, inside) in enumerate(page.texts) if text and not boiler and not inside}


FOUND = "host string, structure string, id long, place int, text long, page long, path long, parent long, name string, depth int, content double, links double"
FOUND_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64()]


def _structures(batches):
    """Of each batch: structures (with how many pages have them), elements (with the weights of texts that can't be template), and texts that can, by their number in the structure."""
    for batch in batches:
        weights: dict[tuple[str, int], list] = {}
        streams: dict[tuple[str, str], int] = defaultdict(int)
        rows: list[tuple] = []
        for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host, page = host_of(url), Page(source or "")
            nodes, places = fold_places(page.stream, _numbered(page.stream))
            structure, open_texts, whole = json.dumps([[x, False] for x in nodes]), _open(page), number(source or "")
            streams[host, structure] += 1
            if open_texts:
                own = number(structure)
                for place, texts in enumerate(_flat(places)):
                    for i in texts:
                        if i in open_texts:
                            text, path, _, _, link, _ = page.texts[i]
                            rows.append((host, None, own, place, number(text), whole, path, None, None, None, float(len(text)), float(len(text) * link)))
            held = _weights(page, open_texts)
            for path in {x[1] for x in page.texts}:
                first = True
                while path in page.elements and (first or (host, path) not in weights):
                    have = weights.setdefault((host, path), [*page.elements[path], 0.0, 0.0])
                    if first:
                        have[3], have[4] = (x + y for x, y in zip(have[3:], held.get(path, (0.0, 0.0)), strict=True))
                    first, path = False, page.elements[path][0]
        rows += [(h, s, number(s), None, None, None, None, None, None, None, float(n), 0.0) for (h, s), n in streams.items()]
        rows += [(h, None, None, None, None, None, p, *w) for (h, p), w in weights.items()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(FOUND_TYPES)
        names = [x.split()[0] for x in FOUND.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, FOUND_TYPES, strict=True)], names=names)


def _parse(batches):
    """(host, id, places): of each structure, the wrapper's place of each of its own places, or -1."""
    for batch in batches:
        out = []
        for wrapper, structure in zip(batch.column("wrapper").to_pylist(), batch.column("structure").to_pylist(), strict=True):
            nodes = [x for x, _ in json.loads(structure)]
            places, n = [], 0
            for x in nodes:
                size = _slots(x)
                places.append([[n + k] for k in range(size)])
                n += size
            found = Wrapper(wrapper).parse(nodes, places)
            out.append([found.get(k, -1) for k in range(n)])
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("id"), pa.array(out, pa.list_(pa.int32()))], names=["host", "id", "places"])


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["pages", "wrapper"], ascending=[False, True])
    wrapper = None
    for text in rows["wrapper"]:
        nodes = [tuple(x) for x in json.loads(text)]
        wrapper = nodes if wrapper is None else align(wrapper, nodes)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(wrapper)], "pages": [int(rows["pages"].sum())]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages, main, template): each host's expression as JSON of [node, optional] (a node is a tag, '#', or ['+', block]), the path of its main element, and its template texts: the place (which '#' of the expression) and number of each."""
    small_batches(pages.sparkSession)
    found = cut(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_structures, FOUND))
    structures = found.filter("structure is not null").groupBy("host", "structure", "id").agg(F.sum("content").cast("long").alias("pages"))
    level = cut(structures.select("host", F.col("structure").alias("wrapper"), "pages"))
    while True:
        sizes = level.groupBy("host").agg(F.count("*").alias("n"))
        largest = sizes.agg(F.max("n")).first()[0] or 0
        if largest <= 1:
            break
        dealt = level.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / GROUP).cast("int")))
        level = cut(dealt.groupBy("host", "part").applyInPandas(lambda key, x: _merge(x), "host string, wrapper string, pages long"))

    texts = found.filter("text is not null")
    parsed = structures.join(texts.select("host", "id").distinct(), ["host", "id"], "left_semi").join(level.select("host", "wrapper"), "host")
    parsed = parsed.select("host", "id", "structure", "wrapper").mapInArrow(_parse, "host string, id long, places array<int>")
    placed = cut(texts.join(parsed, ["host", "id"]).select("host", F.col("places")[F.col("place")].alias("place"), "text", "page", "path", "content", "links"))
    standing = placed.filter("place >= 0").select("host", "place", "text", "page").distinct()
    repeated = standing.groupBy("host", "place", "text").agg(F.count("*").alias("n")).filter("n > 1")
    everywhere = standing.select("host", "place", "page").distinct().groupBy("host", "place").agg(F.count("*").alias("n"))
    template = cut(repeated.join(everywhere, ["host", "place", "n"]).select("host", "place", "text"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        weights = {p: [c, k] for p, c, k in zip(rows["path"], rows["content"], rows["links"], strict=True)}
        elements = {p: (q, n, d) for p, q, n, d in zip(rows["path"], rows["parent"], rows["name"], rows["depth"], strict=True)}
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "main": pd.array([main_path(weights, elements)], "Int64")})

    slots = placed.join(template, ["host", "place", "text"], "left_anti").select("host", "path", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("depth"), "content", "links")
    paths = found.filter("parent is not null").select(slots.columns).unionByName(slots)
    paths = paths.groupBy("host", "path").agg(*(F.max(c).alias(c) for c in ("parent", "name", "depth")), *(F.sum(c).alias(c) for c in ("content", "links"))).filter("parent is not null")
    chosen = paths.groupBy("host").applyInPandas(choose, "host string, main long")
    listed = template.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("template"))
    return level.join(chosen, "host", "left").join(listed, "host", "left")


def _extract(batches):
    for batch in batches:
        texts, wrappers = [], {}
        for source, main, wrapper, listed in zip(*(batch.column(c).to_pylist() for c in ("html", "main", "wrapper", "template")), strict=True):
            page, template = Page(source or ""), set()
            if listed and (open_texts := _open(page)):
                if wrapper not in wrappers:
                    wrappers[wrapper] = (Wrapper(wrapper), {(x["place"], x["text"]) for x in listed})
                by, known = wrappers[wrapper]
                placed = by.parse(*fold_places(page.stream, _numbered(page.stream)))
                template = {i for i in open_texts if (placed.get(i, -1), number(page.texts[i][0])) in known}
            text = page.main_text(main, template) if main is not None else ""
            texts.append(text or page.main_text(main_path(_weights(page, template), page.elements), template))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    wrapper = F.when(F.col("template").isNotNull(), F.col("wrapper")).alias("wrapper")
    wrappers = cut(infer_wrappers(pages).select(F.col("host").alias("h"), "main", wrapper, "template"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # hosts are few as against pages, but grow with them: they are broadcast only where they are counted and few
    n, size = wrappers.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("wrapper"), F.lit(0)) + 16 * F.coalesce(F.array_size("template"), F.lit(0)))).first()
    few = n <= BROADCAST_HOSTS and (size or 0) <= BROADCAST_BYTES
    host = F.lower(F.coalesce(F.nullif(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), F.when(F.col("url").rlike(r"^\s*(?:[a-zA-Z][\w+.-]*:)?//"), F.lit("")), F.col("url"), F.lit("")))
    held = rows.withColumn("host", host).join(F.broadcast(wrappers) if few else wrappers, F.col("host") == F.col("h"), "left")
    return held.select("page_id", "url", "html", "main", "wrapper", "template").mapInArrow(_extract, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
