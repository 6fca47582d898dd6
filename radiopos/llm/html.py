"""Main text of web pages by union-free wrapper inference.

Pages of a host come from a few templates. A wrapper is a regular expression without alternatives over a page's token
stream, nested as elements nest: the content of every element is a sequence of members (child elements with their
class, and texts), optional groups and repeated groups. It is inferred from the outermost element inwards: streams of
one element are folded (neighbouring equal groups become a repeated group) and aligned one after the other, and what
only one side has becomes an optional group. Streams of any length are aligned, by a longest common subsequence.

Texts that meet at one place of the wrapper make a slot. A text that all of at least DISTINCT different pages of the
host have there is template text: blocks of nothing else are not given. A page's text is what the slots give, in page order: those
in article elements (else in main elements, else all of the page), without the slots in furniture. An element is
furniture by its tag; by its class, id or role where it is a container (of the weaker names only if half its text over
the host's pages is in links); or, outside articles, as a list of links over the host's pages. Headings in a header
belong to the text inside an article, or where the host's pages differ in them. What a page has beyond its wrapper is
read by the page's own figures. Pages of hosts with fewer than DISTINCT different pages have no template text.

Wrappers are fitted on at most PAGES pages a host (a parameter), chosen by hash in two steps so that a host with a
third of all pages is never gathered; every page is then extracted whole. Parsing takes time in proportion to the tokens;
aligning two contents and matching one take as many operations on whole numbers as one has symbols, each on as many bits
as the other has.

Character references are decoded, white space within a block (a line break in it too) is one space, blocks are
trimmed and joined by newlines, empty ones dropped.

Cases: null and empty pages give the empty text, as pages without a body text do; a null url is a host of its
own; repeated rows give a row each; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PAGES = 12
DISTINCT = 4
#: Characters outside links from which a container may be text in spite of its name.
LEAST = 200
#: Bits of an alignment's table that are kept at once (or its square root's rows, if more); the rest is worked out again.
#: Results do not depend on it.
ALIGNED = 200_000
#: The same for the states of a match.
KEPT = 1 << 27
#: A task keeps wrappers of so many nodes.
NODES = 500_000
#: Wrappers of all hosts up to so many bytes are broadcast; beyond it they join by host and salt.
BROADCAST_CHARS, SALTS = 16_000_000, 32
_RAW = "script style iframe textarea title xmp noembed noframes".split()
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>|<\?[^>]*>|</[^a-z][^>]*>"
    rf"|<(?P<raw>{'|'.join(_RAW)})(?=[\s>/])[^>]*>.*?(?:</(?P=raw)(?=[\s>/])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>"
    r"|<[a-z/!?][^>]*\Z|(?P<text>[^<]++|<)",
    re.IGNORECASE | re.DOTALL,
)
_CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav aside footer form button menu dialog header noscript template svg object select head".split())
_NAMED = frozenset("aside div dl footer form header iframe nav ol section span table td ul".split())
_EDGE = r"(?:^|[-_\s])(?:{})(?:$|[-_\s])"
_NAMES = re.compile(_EDGE.format(r"ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|masthead|menu|navbar|nav|navigation|newsletter|notice|popup|repl(?:y|ies)|sidebar|signup|sponsor\w*|subscribe|toolbar|complementary|contentinfo"))
_COMMENTS = re.compile(_EDGE.format(r"comments?|disqus|repl(?:y|ies)"))
_ADVERTS = re.compile(_EDGE.format(r"ad|ads|advert\w*|sponsor\w*"))
#: Classes that say what a container has or lacks, not what it is.
_MODIFIER = re.compile(r"(?:has|have|with|without|no|not|non|is|js)[-_].*|.*[-_](?:free|less|open|enabled|disabled|on|off|hidden|visible|left|right)")
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|\Z)|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE)
#: Stands among the classes of an element that is not shown.
_UNSHOWN = "\x00"
_WEAK = re.compile(_EDGE.format(r"related|share|sharing|social|promo\w*|side|widget"))
#: An opening tag closes the nearest of these open elements, unless an element of its scope is nearer.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
_P_SCOPE = ("article", "aside", "blockquote", "body", "button", "caption", "div", "dl", "footer", "form", "header", "li", "main", "nav", "ol", "section", "table", "td", "th", "ul")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT = "#"


class Page:
    """A page's elements and texts in document order. key: tag and class of an element, '#' of a text, None of void
    tags; end: the number after an element's last descendant; kids: the elements and texts of an element."""

    def __init__(self, source: str):
        self.key: list[str | None] = ["/"]
        self.name: list[str] = ["/"]
        self.value: list[str] = [""]
        self.end: list[int] = [0]
        self.kids: list[list[int]] = [[]]
        self._read(source)
        self._measure()

    def _read(self, source: str) -> None:
        key, names, value, ends, kids = self.key, self.name, self.value, self.end, self.kids
        stack = [0]
        at: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of a name

        def cut(depth: int) -> None:
            while len(stack) > depth:
                i = stack.pop()
                ends[i] = len(key)
                at[names[i]].pop()

        def top(wanted) -> int:
            return max((at[n][-1] for n in wanted if at[n]), default=0)

        for m in _TOKEN.finditer(source):
            name = m["name"]
            if m["text"]:
                here = kids[stack[-1]]
                if here and here[-1] == len(key) - 1 and key[-1] == TEXT:
                    value[-1] += m["text"]
                    continue
                names.append(TEXT)
                value.append(m["text"])
                key.append(TEXT)
                ends.append(len(key))
                kids.append([])
                here.append(len(key) - 1)
            elif name and m["end"]:
                name = name.lower()
                if at[name]:
                    cut(at[name][-1])
                elif name == "p":  # an empty paragraph
                    names.append("hr")
                    value.append("")
                    key.append(None)
                    ends.append(len(key))
                    kids.append([])
            elif name:
                name = name.lower()
                if name in _CLOSES:
                    depth = top(_CLOSES[name])
                    if depth > top(_SCOPES[name]):
                        cut(depth)
                if name in _BLOCK and at["p"] and at["p"][-1] > top(_P_SCOPE):
                    cut(at["p"][-1])
                if name in ("html", "body") and at[name]:
                    continue
                if name == "body" and at["head"]:
                    cut(at["head"][0])
                elif at["head"] and name not in _VOID and name not in ("noscript", "template", "object"):
                    cut(at["head"][0])  # nothing else can stand in a head
                shown = name
                if m["attrs"] and (found := _CLASS.findall(m["attrs"])):
                    shown = f"{name}.{_DIGITS.sub('0', ' '.join(map(''.join, found)).lower())}"
                if m["attrs"] and _HIDDEN.search(m["attrs"]):
                    shown = f"{shown}{' ' if '.' in shown else '.'}{_UNSHOWN}"
                names.append(name)
                value.append("")
                void = name in _VOID
                key.append(None if void else shown)
                ends.append(len(key))
                kids.append([])
                if not void:
                    kids[stack[-1]].append(len(key) - 1)
                    at[name].append(len(stack))
                    stack.append(len(key) - 1)
            elif m["raw"]:
                names.append("wbr")
                value.append("")
                key.append(None)
                ends.append(len(key))
                kids.append([])
        cut(1)
        ends[0] = len(key)

    def _measure(self) -> None:
        """chars, linked, links and titles of every element: characters of text, those in links, and the numbers of links
        and of main headings."""
        n = len(self.key)
        self.chars, self.linked, self.links, self.titles = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if self.key[i] == TEXT:
                self.chars[i] = len(self.value[i].strip())
                continue
            # blank texts make no slots
            self.kids[i] = [k for k in self.kids[i] if self.key[k] != TEXT or self.chars[k]]
            for k in self.kids[i]:
                self.chars[i] += self.chars[k]
                self.linked[i] += self.linked[k]
                self.links[i] += self.links[k]
                self.titles[i] += self.titles[k]
            if self.name[i] == "a":
                self.linked[i], self.links[i] = self.chars[i], 1
            elif self.name[i] == "h1":
                self.titles[i] = 1

    def keys(self, i: int) -> tuple[str, ...]:
        return tuple(self.key[k] for k in self.kids[i])


def _words(key: str) -> list[str]:
    return key.partition(".")[2].split()


def _named(key: str) -> str:
    """What an element's classes call it."""
    return " ".join(w for w in _words(key) if not _MODIFIER.fullmatch(w))


def furniture(name: str, key: str, links: int, linked: int, chars: int) -> int:
    """0: text; 1: a list of links, which is no text outside articles; 2: not text; 3: not text, but for headings."""
    if name in ("body", "html", "/", TEXT):
        return 0
    named = _named(key)
    if name in ("article", "main"):
        return 2 * bool(_UNSHOWN in named or _COMMENTS.search(named))
    if name == "header":
        return 3
    if name in _FURNITURE or _UNSHOWN in named:
        return 2
    if named and (name in _NAMED and (_NAMES.search(named) or 2 * linked >= chars > 0 and _WEAK.search(named)) or _ADVERTS.search(named)):
        return 2
    return int(name in _BLOCK and links >= 3 and 5 * linked >= 4 * chars)


def spared(key: str, chars: float, of: float, titled: bool) -> bool:
    """Whether an element that is furniture by its class, or a form, is text for what it holds: most of the text outside
    links, and LEAST characters of it. Comments may well hold most of a page's text, but not its heading."""
    name = key.partition(".")[0]
    if name in _FURNITURE and name != "form" or chars < LEAST or 2 * chars <= of:
        return False
    return titled or not _COMMENTS.search(_named(key))


def own_kind(page: Page, i: int, kind: int | None = None) -> int:
    """What an element is by its name (or `kind`), unless most of the page's text is in it."""
    if kind is None:
        kind = furniture(page.name[i], page.key[i], page.links[i], page.linked[i], page.chars[i])
    if kind == 2 and spared(page.key[i], page.chars[i] - page.linked[i], page.chars[0] - page.linked[0], page.titles[i] > 0):
        return 0
    return kind


def fold(row: list) -> list:
    """Neighbouring equal groups of up to 12 symbols become ('+', group), shortest groups first."""
    for width in range(1, 13):
        out, i = [], 0
        while i < len(row):
            group, n = row[i : i + width], 1
            while len(group) == width and row[i + n * width : i + (n + 1) * width] == group:
                n += 1
            if n > 1:
                out.append(group[0] if width == 1 and isinstance(group[0], tuple) else ("+", tuple(group)))
                i += n * width
            else:
                out.append(row[i])
                i += 1
        row = out
    return row


def _refolded(row: list, groups: list[tuple]) -> list:
    """Single occurrences of groups that repeat elsewhere become groups too, the longest first."""
    starts: dict = {}
    for g in groups:
        at = starts
        for x in g:
            at = at.setdefault(x, {})
        at[None] = g
    out, i = [], 0
    while i < len(row):
        at, n, group = starts, i, None
        while n < len(row) and (at := at.get(row[n])):
            n, group = n + 1, at.get(None, group)
        if group and out and isinstance(out[-1], tuple) and out[-1][1] == group:
            i += len(group)
        elif group:
            out.append(("+", group))
            i += len(group)
        else:
            out.append(row[i])
            i += 1
    return out


def _mask(bits: Iterable[int], size: int) -> int:
    digits = bytearray(b"0") * size
    for b in bits:
        digits[size - 1 - b] = 49
    return int(digits, 2)


def shared(left: list, right: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, the earliest places. A row of the table of lengths is a whole number (a 0
    bit: one more than before), so a row takes three operations on numbers of as many bits as `left` has symbols."""
    head, least = 0, min(len(left), len(right))
    while head < least and left[head] == right[head]:
        head += 1
    tail = 0
    while tail < least - head and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    j, i = len(left) - tail - head, len(right) - tail - head
    pairs = [(len(left) - 1 - t, len(right) - 1 - t) for t in range(tail)]
    places: dict = defaultdict(list)
    for n in range(j):
        places[left[head + n]].append(n)
    ones = (1 << j) - 1
    masks = {x: _mask(at, j) for x, at in places.items()}
    block = max(1, math.isqrt(i), ALIGNED // (j + 1))

    def rows(begin: int, row: int, end: int) -> list[int]:
        out = [row]
        for x in right[head + begin : head + min(begin + block, end)]:
            if both := row & masks.get(x, 0):
                row = (row + both | row - both) & ones
            out.append(row)
        return out

    kept, end = [ones], i
    for begin in range(0, end, block):
        kept.append((now := rows(begin, kept[-1], end))[-1])
    for begin in reversed(range(0, end, block)):
        if begin + block < end:
            now = rows(begin, kept[begin // block], end)
        while i > begin and (j := (~now[i - begin] & (1 << j) - 1).bit_length()):
            i -= 1
            if now[i - begin] >> j - 1 & 1:
                j -= 1
                pairs.append((head + j, head + i))
        i = begin
    return [(n, n) for n in range(head)] + pairs[::-1]


def align(wrapper: list, row: list) -> list:
    """The wrapper generalised so that it also matches row."""
    groups = list(dict.fromkeys(x[1] for x in wrapper + row if isinstance(x, tuple) and x[0] in "+*"))
    wrapper, row = _refolded(wrapper, groups), _refolded(row, groups)
    out: list = []
    bare = lambda x: x[1] if isinstance(x, tuple) else (x,)
    a = c = 0
    for b, d in [*shared([*map(bare, wrapper)], [*map(bare, row)]), (len(wrapper), len(row))]:
        for part in (wrapper[a:b], row[c:d]):
            if any(isinstance(x, tuple) for x in part):
                out += [("*" if x[0] in "+*" else "?", x[1]) if isinstance(x, tuple) else ("?", (x,)) for x in part]
            elif part:
                out.append(("?", tuple(part)))
        if b < len(wrapper):
            x, y = wrapper[b], row[d]
            signs = {z[0] if isinstance(z, tuple) else "" for z in (x, y)}
            many, least = signs & {"+", "*"}, signs & {"?", "*"}
            sign = ("*" if least else "+") if many else "?" if least else ""
            out.append((sign, bare(x)) if sign else x)
        a, c = b + 1, d + 1
    merged: list = []
    for x in out:
        if merged and isinstance(x, tuple) and isinstance(merged[-1], tuple) and x[1] == merged[-1][1]:
            merged[-1] = ("+" if "+" in (x[0], merged[-1][0]) else "*", x[1])
        else:
            merged.append(x)
    return merged


class Level:
    """Bits of a depth of a content expression: its symbols, the starts of its groups, the ends of its sequences, what
    lies in items that may be absent, and the symbols an item can end in; loops: ends of repeated groups by their width."""

    def __init__(self):
        self.symbols, self.starts, self.ends, self.absent, self.tails = [], [], [], [], []
        self.loops: dict[int, list[int]] = defaultdict(list)

    def seal(self, size: int) -> None:
        for what in ("symbols", "starts", "ends", "absent", "tails"):
            setattr(self, what, _mask(getattr(self, what), size))
        self.loops = [(width, _mask(at, size)) for width, at in self.loops.items()]
        self.places = self.symbols | self.starts | self.ends

    def reach(self, at: int) -> int:
        """The places from those of `at` over items that may be absent: a carry runs through them."""
        return (self.absent + (at & self.absent) ^ self.absent | at) & self.places if at and self.absent else at


class Content:
    """A content expression as an automaton over its members: items are symbols (members) or (sign, items). Symbols and
    the ends of groups are numbered in their order; sets of them, and of the places before them, are bits of a whole number
    for each depth. A step takes some operations on such numbers, whatever it passes; short ones are remembered."""

    def __init__(self, items: list):
        self.members: list[str] = []
        self.number: list[int] = []  # of a symbol's member
        self.place: list[tuple | None] = []  # of a symbol: depth, start, first bit it can follow, whether it can be first, group
        self.levels = [Level()]
        last = self._sequence(items, 0, None)[0]
        self._close(0)
        size = len(self.place)
        for level in self.levels:
            level.seal(size)
        self.last = _mask(last, size)
        places: dict[str, list[int]] = defaultdict(list)
        for i, p in enumerate(self.place):
            if p:
                places[self.members[self.number[i]]].append(i)
        self.of = {k: _mask(at, size) for k, at in places.items()}
        self.steps: dict[tuple[int, str], int] = {}
        self.first = self._next(0, 1)

    def _close(self, depth: int) -> None:
        self.levels[depth].ends.append(len(self.place))
        self.place.append(None)
        self.number.append(-1)

    def _sequence(self, items, depth: int, group: list | None) -> tuple[list[int], bool]:
        """The symbols a sequence can end in, and whether it can be empty. group: as in place, and the end if repeated."""
        level = self.levels[depth]
        last, empty, low = [], True, len(self.place)
        for x in items:
            start = len(self.place)
            if isinstance(x, tuple):
                if len(self.levels) == depth + 1:
                    self.levels.append(Level())
                level.starts.append(start)
                own = [depth, start, low, empty, group, 0]
                ends, absent = self._sequence(x[1], depth + 1, own)
                if x[0] in "+*":
                    own[-1] = len(self.place)
                    self.levels[depth + 1].loops[own[-1] - start].append(own[-1])
                self._close(depth + 1)
                absent = absent or x[0] in "?*"
            else:
                ends, absent = [start], False
                level.symbols.append(start)
                self.place.append((depth, start, low, empty, group))
                self.number.append(len(self.members))
                self.members.append(x)
            level.tails += ends
            if absent:
                level.absent += range(start, len(self.place))
                last += ends
            else:
                last, empty, low = [*ends], False, start
        return last, empty

    def _next(self, taken: int, begin: int = 0) -> int:
        """The symbols that can follow those taken; with begin 1, the first ones."""
        here, up = [0] * len(self.levels), 0
        for d in range(len(here) - 1, -1, -1):
            level = self.levels[d]
            here[d] = level.reach((taken & level.symbols) << 1 | up | (0 if d else begin))
            up = (here[d] & level.ends) << 1
        found = down = 0
        for at, level in zip(here, self.levels, strict=True):
            for width, ends in level.loops:
                down |= (at & ends) >> width
            at |= level.reach(down)
            found |= at & level.symbols
            down = at & level.starts
        return found

    def _step(self, now: int, k: str) -> int:
        step = self.steps.get((now, k))
        if step is None:
            if len(self.steps) * len(self.place) > 1 << 24:  # bits
                self.steps.clear()
            step = self.steps[now, k] = self._next(now) & self.of.get(k, 0)
        return step

    def _before(self, state: int, later: int) -> int:
        """The first symbol of the state that `later` can follow, -1 if none."""
        depth, start, low, first, group = self.place[later]
        found = []
        while True:
            if (at := (state & self.levels[depth].tails) >> low) and (i := low + (at & -at).bit_length() - 1) < start:
                found.append(i)
            if not first or group is None:
                return min(found, default=-1)
            depth, start, low, first, group, end = group
            if end and (at := (state & self.levels[depth].tails) >> start) and (i := start + (at & -at).bit_length() - 1) < end:
                found.append(i)

    def fits(self, keys: tuple[str, ...]) -> bool:
        now = self.first
        for n, k in enumerate(keys):
            now = self._step(now, k) if n else now & self.of.get(k, 0)
            if not now:
                return False
        return not keys or bool(now & self.last)

    def match(self, keys: tuple[str, ...]) -> tuple[list[int], bool]:
        """The member of every symbol (-1: none), and whether the expression matches. A symbol that cannot follow
        begins anew at the members of its kind. The states of a block of symbols are kept at once."""
        block = max(1, math.isqrt(len(keys)), KEPT // len(self.place))
        whole = True

        def run(begin: int, now: int) -> tuple[list[int], int]:
            nonlocal whole
            states = []
            for n in range(begin, min(begin + block, len(keys))):
                k = keys[n]
                step = self._step(now, k) if n else self.first & self.of.get(k, 0)
                if not step:
                    whole = False
                    step = self.of.get(k, 0)
                states.append(step)
                now = step or now
            return states, now

        kept, states = [0], []
        for begin in range(0, len(keys), block):
            states, now = run(begin, kept[-1])
            kept.append(now)
        whole = whole and bool(not keys or states[-1] & self.last)
        fits = whole
        out, later = [-1] * len(keys), -1
        for begin in reversed(range(0, len(keys), block)):
            if begin + block < len(keys):
                states = run(begin, kept[begin // block])[0]
            for n in range(len(states) - 1, -1, -1):
                if state := states[n]:
                    i = -1
                    if later < 0:
                        state = fits and state & self.last or state
                    elif state & state - 1:
                        i = self._before(state, later)
                    later = i if i >= 0 else (state & -state).bit_length() - 1
                    out[begin + n] = self.number[later]
        return out, fits


def _symbols(items) -> Iterator[str]:
    for x in items:
        if isinstance(x, str):
            yield x
        else:
            yield from _symbols(x[1])


def expression(streams: list[tuple[str, ...]]) -> list:
    """The union-free expression of the streams of one element."""
    out: list | None = None
    content: Content | None = None
    for s in dict.fromkeys(streams):
        if content is None or not content.fits(s):
            row = fold(list(s))
            out = row if out is None else align(out, row)
            content = Content(out)
    return out or []


class Wrapper:
    """nodes: [content expression, numbers of its members, furniture, template texts, whether its texts differ]. Once
    written and read, equal nodes are one, and a content all of whose members of a kind are one node is [None, node by kind,
    ...]: which of them a symbol matches makes no difference."""

    def __init__(self, nodes: list):
        self.nodes = nodes
        self.root = 0
        self.contents: dict[int, Content] = {}

    def content(self, node: int) -> Content:
        if node not in self.contents:
            self.contents[node] = Content(self.nodes[node][0])
        return self.contents[node]

    def written(self) -> bytes:
        rows: dict[str, int] = {}
        number = [0] * len(self.nodes)
        for n in range(len(number) - 1, -1, -1):  # members have greater numbers than their element
            items, members, *own = self.nodes[n]
            kinds: dict[str, set[int]] = defaultdict(set)
            for k, m in zip(_symbols(items), members, strict=True):
                kinds[k].add(number[m])
            if all(len(found) == 1 for found in kinds.values()):
                row = [None, {k: found.pop() for k, found in sorted(kinds.items())}, *own]
            else:
                row = [items, [number[m] for m in members], *own]
            number[n] = rows.setdefault(json.dumps(row, separators=(",", ":")), len(rows))
        return zlib.compress(f"[{','.join(rows)}]".encode())

    @classmethod
    def read(cls, written: bytes) -> Wrapper:
        nodes = json.loads(zlib.decompress(written))
        back = lambda items: [x if isinstance(x, str) else (x[0], tuple(back(x[1]))) for x in items]
        for n in nodes:
            n[0] = n[0] and back(n[0])
        made = cls(nodes)
        made.root = len(nodes) - 1
        return made


def _text(value: str) -> str:
    return " ".join(unescape(value).split())


def different(pages: list[Page], least: int = DISTINCT) -> set[int]:
    """Numbers of pages no two of which share half of their runs of three words; none if fewer than `least`."""
    kept: dict[int, set] = {}
    for n, p in enumerate(pages):
        words = extract(p, None).split()
        runs = set(zip(words, words[1:], words[2:], strict=False)) or {tuple(words)}
        if all(3 * len(runs & k) < len(runs) + len(k) for k in kept.values()):
            kept[n] = runs
    return set(kept) if len(kept) >= least else set()


def infer(pages: list[Page]) -> Wrapper:
    """The wrapper of a host's pages, element by element from the outermost."""
    evidence = different(pages)
    nodes: list = []
    varying: list[int] = []  # characters outside links of texts that differ over the pages
    titled: list[bool] = []
    named: list[str] = []
    todo: list[tuple[int, list[tuple[int, int]]]] = []

    def put(key: str, found: list[tuple[int, int]]) -> int:
        sums = [sum(getattr(pages[p], what)[i] for p, i in found) for what in ("links", "linked", "chars")]
        template, differs = [], False
        if key == TEXT:
            held: dict[str, set[int]] = defaultdict(set)
            for p, i in found:
                held[_text(pages[p].value[i])].add(p)
            template = sorted(t for t, at in held.items() if evidence and evidence <= at)
            differs = bool(evidence) and any(not evidence <= at for at in held.values())
        name = TEXT if key == TEXT else key.partition(".")[0]
        # a list of links on every page: three links a page at least
        links = sums[0] // max(1, len({p for p, _ in found}))
        nodes.append([[], [], furniture(name, key, links, *sums[1:]), template, differs])
        varying.append(sums[2] if key == TEXT and (differs or not evidence) else 0)
        titled.append(name == "h1")
        named.append(key)
        if key != TEXT:
            todo.append((len(nodes) - 1, found))
        return len(nodes) - 1

    put("/", [(p, 0) for p in range(len(pages))])
    while todo:
        node, found = todo.pop()
        streams = [pages[p].keys(i) for p, i in found]
        content = Content(made := expression(streams))
        members: list[list[tuple[int, int]]] = [[] for _ in content.members]
        for (p, i), s in zip(found, streams, strict=True):
            for k, m in zip(pages[p].kids[i], content.match(s)[0], strict=True):
                members[m].append((p, k))
        nodes[node][0] = made
        nodes[node][1] = [put(k, m) for k, m in zip(content.members, members, strict=True)]
    # slots decide first: where most of the text that differs over the host's pages lies is text, whatever its name
    for node in range(len(nodes) - 1, -1, -1):
        for member in nodes[node][1]:
            titled[node] = titled[node] or titled[member]
            if named[member].partition(".")[0] != "a":
                varying[node] += varying[member]
    for n, own in enumerate(nodes):
        if own[2] == 2 and spared(named[n], varying[n] / len(pages), varying[0] / len(pages), titled[n]):
            own[2] = 0
    return Wrapper(nodes)


def _zone(page: Page) -> tuple[str, set[int]]:
    """The outermost article elements outside furniture, else the main elements."""
    for wanted in ("article", "main"):
        found, i = set(), 1
        while i < len(page.key):
            key, name = page.key[i], page.name[i]
            if key and key != TEXT and (name == wanted or name not in ("body", "html", "a", "p") and wanted in _words(key)):
                if own_kind(page, i) < 2 and (not _NAMES.search(_named(key)) or own_kind(page, i, 2) < 2):
                    found.add(i)
                i = page.end[i]
            elif key and key != TEXT and own_kind(page, i) >= 2:
                i = page.end[i]
            else:
                i += 1
        if found:
            return wanted, found
    return "", set()


def extract(page: Page, wrapper: Wrapper | None) -> str:
    """The texts that the wrapper's slots give, as blocks; without a wrapper, by the page's own figures."""
    wanted, zone = _zone(page)
    blocks: list[str] = []
    parts: list[str] = []
    new = False  # whether the block has text that is not the template's
    node = [-1] * len(page.key)
    node[0] = wrapper.root if wrapper else -1
    inside = 0 if zone else len(page.key)  # until here within the zone
    closed = 0  # until here within furniture
    header = 0  # until here within a header, of which headings are text
    heading = 0
    ends: list[int] = []  # of open blocks

    def finish() -> None:
        nonlocal new
        if new and (text := " ".join("".join(parts).split())):
            blocks.append(text)
        parts.clear()
        new = False

    i = 0
    while i < len(page.key):
        while ends and ends[-1] <= i:
            ends.pop()
            finish()
        key, name = page.key[i], page.name[i]
        if key is None:
            if name in _BLOCK:
                finish()
            elif name == "br":
                parts.append(" ")
            i += 1
            continue
        own = wrapper.nodes[node[i]] if node[i] >= 0 else None
        if key == TEXT:
            if i < inside:
                value = unescape(page.value[i])
                if i >= header or i < heading and (zone or own is not None and own[4]):
                    parts.append(value)
                    new = new or not own or not own[3] or bool(text := " ".join(value.split())) and text not in own[3]
                elif page.value[i][:1].isspace() or page.value[i][-1:].isspace():
                    parts.append(" ")
            i += 1
            continue
        if i in zone:
            inside = page.end[i]
        kind = own_kind(page, i, own[2] if own is not None else None)
        if i not in zone and (kind == 2 or kind == 1 and not (zone and i < inside)):
            if name in _BLOCK:
                finish()
            i = page.end[i]
            continue
        if name in _BLOCK:
            finish()
            ends.append(page.end[i])
        if kind == 3:
            header = max(header, page.end[i])
        if name in _HEADINGS:
            heading = page.end[i]
        if own is not None and own[0] is None:
            for k in page.kids[i]:
                node[k] = own[1].get(page.key[k], -1)
        elif own is not None and page.kids[i]:
            content = wrapper.content(node[i])
            for k, m in zip(page.kids[i], content.match(page.keys(i))[0], strict=True):
                node[k] = own[1][m] if m >= 0 else -1
        i += 1
    finish()
    return "\n".join(blocks)


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, size: int = PAGES) -> DataFrame:
    """host, wrapper: fitted on at most `size` pages a host."""
    draw = F.xxhash64("html")
    keyed = pages.select(host().alias("host"), draw.alias("draw"))
    # the least hash of each of `size` parts of a host: partial minima leave a task, not pages
    chosen = keyed.groupBy("host", F.pmod("draw", F.lit(size)).alias("part")).agg(F.min("draw").alias("draw"))
    chosen = common.stage(chosen.select("host", "draw").distinct(), "page-sample")
    sample = pages.select(host().alias("host"), draw.alias("draw"), common.text_of("html").alias("html")).join(chosen, ["host", "draw"], "left_semi")
    sample = sample.withColumn("n", F.row_number().over(Window.partitionBy("host", "draw").orderBy("draw"))).filter("n = 1").drop("n")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        made = infer([Page(x) for x in group.sort_values(["draw", "html"])["html"]])
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [made.written()]})

    return common.stage(sample.groupBy("host").applyInPandas(run, "host string, wrapper binary"), "wrappers")


def with_wrappers(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (with host) and the wrapper of each one's host."""
    if (known.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_CHARS:
        return rows.join(F.broadcast(known), "host", "left")
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["host", "_salt"], "left").drop("_salt")


def main_text(pages: DataFrame, size: int = PAGES) -> DataFrame:
    """page_id, url, text of every row of pages (page_id, url, html)."""
    known = wrappers(pages, size)
    rows = with_wrappers(pages.select("page_id", "url", common.text_of("html").alias("html"), host().alias("host")), known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, Wrapper] = {}
        for b in batches:
            texts = [""] * len(b)
            for n in sorted(range(len(b)), key=b["host"].tolist().__getitem__):
                at = b["host"].iat[n]
                if at not in ready:
                    if len(ready) >= 200 or sum(len(w.nodes) for w in ready.values()) > NODES:
                        ready.clear()
                    ready[at] = Wrapper.read(b["wrapper"].iat[n])
                texts[n] = extract(Page(b["html"].iat[n]), ready[at])
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"page_id {kind}, url string, text string")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
