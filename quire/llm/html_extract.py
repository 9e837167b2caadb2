"""HTML main text by wrappers: union-free regular-expression inference over the pages of a host.

A page is a stream of block tags and text slots, nested by its balanced tags. Neighbouring repeats, single ones or runs,
are folded into repeated groups. The distinct streams of a host are aligned one after the other: parts that both have are
merged, a part that one lacks becomes optional, and parts that then repeat next to each other fold again, so that optional
and repeated groups meet plain tokens. This gives one union-free expression for the host, its wrapper, with tags, text
slots (#), optional groups (...)? and repeated groups (...)+. Each slot holds what was seen in it: on how many pages, how
much text, how much of it in links, and the least and largest print of the text, which tell a constant from a slot.

The wrapper decides. Its content part is the article or main element with most text, or else the lowest part that holds
MOST of the host's text that varies and is in no link; constants, links and furniture count for nothing. Every page is
then aligned with its host's wrapper, and its text is what lies in slots of the content part: no furniture (elements and
whole class or role tokens below, fixed values) and no constant that CONSTANT_PAGES pages or more and nearly all pages of
the host have in the same place. Records of short texts and a longer one that repeat after the prose are readers' comments,
whatever their marks. Headings are no constants. Where constants are most of the content, the pages are copies
of each other and nothing counts as constant. A page without its host's content part is its own wrapper.

Distinct streams are counted with partial sums before the shuffle; a host's streams are aligned in parts of PART streams,
then part by part, so a host with a third of all pages is no large group. The order is that of the streams, so results
do not depend on how pages are dealt out. Elements deeper than DEPTH belong to their ancestor at that depth, but for
furniture, which is left out there as anywhere. Pages stay where they are while all wrappers together have at most
BROADCAST_BYTES; beyond that they are joined by host.

Nulls: null or empty html gives an empty text; a null url is the host of all null urls. Tags that are never closed end with
their parent. Repeated rows give equal rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, drop_scratch, slices, written

#: Elements whose content is no text of the page.
RAW = ("script", "style", "template", "textarea", "svg", "iframe", "canvas", "select", "annotation-xml", "annotation")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that may be the content part; a paragraph or list item is a block of it.
HOLDERS = frozenset("html body div section main article center table tbody tr td".split())
#: Elements that hold blocks; only these are furniture by a mark, so a marked paragraph, cell or span is text.
CONTAINERS = frozenset("div section article ul ol dl details dialog fieldset figure center dir".split())
#: Elements that may hold one reader's comment, and the most code points of a name or date on average.
RECORDS, SHORT_TEXT = frozenset("div section article li dd".split()), 40
#: Elements that are furniture wherever they stand (a header within an article or main element is its own).
NOISE = frozenset("nav header footer aside form head title menu button".split())
#: Whole class or role tokens that mark furniture; a word between hyphens may be a subject of the text.
NOISE_TOKEN = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|nav\w*|menu|sidebar|footer|header|masthead|breadcrumbs?|respond|disqus|share|social|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|pagination|pager|toolbar|widget|complementary|contentinfo|navigation)"
    r"|(?:\w+[_-])?comments?(?:[_-]\w+)?|ads?[_-](?:slot|box|unit|banner|container|wrapper)|(?:site|page|main|global|top)[_-](?:header|footer|nav|navigation|menu)|nav[_-](?:bar|menu|links)|(?:cookies?|consent)[_-](?:banner|notice|bar|popup)"
    r"|(?:share|social)[_-](?:bar|buttons?|links|icons)|related[_-](?:posts?|articles?|stories|links)|search[_-](?:form|box|bar)|newsletter[_-](?:signup|form|box)|widget[_-]area|promo[_-]card",
    re.I,
)
#: Marks that name a page's article.
NAMED_MARK = re.compile(r"article[-_]?body|main|main[-_]content", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)",
    re.S | re.I,
)
MARK = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
#: Distinct streams of one host that are aligned in one part.
PART = 64
#: Pages that must have the same text in a place, and the share of the host's pages, before it counts as constant.
CONSTANT_PAGES, CONSTANT_SHARE = 3, 0.9
#: The share of a host's varying text that its content part holds at least.
MOST = 0.9
DEPTH = 200
#: Lists whose lengths have a product of at most this are aligned by their longest common runs.
SMALL = 1 << 14
BROADCAST_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


@lru_cache(1 << 14)
def labelled(name: str, attributes: str) -> tuple[str, bool]:
    """An element as other pages of the host have it (marks with a digit are a page's own), and whether it is furniture."""
    marks = []
    noise = name in NOISE
    for kind, a, b, c in MARK.findall(attributes) if attributes else ():
        for token in (a or b or c).split():
            is_id = kind.lower() == "id"
            # an id is a hint for a div or list only
            if kind.lower() != "itemprop" and name in CONTAINERS and (not is_id or name in ("div", "ul")):
                noise = noise or bool(NOISE_TOKEN.fullmatch(token))
            marks.append("#" if any(x.isdigit() for x in token) else ("#" + token if is_id else token))
    return (f"{name}.{' '.join(marks)}" if marks else name), noise


@lru_cache(1 << 14)
def is_named(label: str) -> bool:
    name, _, marks = label.partition(".")
    return name in ("article", "main") or any(NAMED_MARK.fullmatch(m.lstrip("#")) for m in marks.split())


class Part:
    """A text slot (label #), an element, or a group of parts that repeats (label in brackets).

    A slot has the number of pages, the characters in all and in links, and the least and largest print; on a page it has
    the numbers of its texts instead of pages."""

    __slots__ = ("label", "kids", "optional", "repeated", "noise", "pages", "mass", "link", "lo", "hi", "texts", "kept", "constant")

    def __init__(self, label: str, noise: bool = False):
        self.label, self.noise = label, noise
        self.kids: list[Part] = []
        self.optional = self.repeated = self.kept = self.constant = False
        self.pages = self.mass = self.link = 0
        self.lo = self.hi = None
        self.texts: list[int] = []


def merged(a: Part, b: Part) -> Part:
    """One part for two of the same label."""
    out = Part(a.label, a.noise)
    out.optional, out.repeated = a.optional and b.optional, a.repeated or b.repeated
    if a.label == "#":
        out.pages, out.mass, out.link, out.texts = a.pages + b.pages, a.mass + b.mass, a.link + b.link, a.texts + b.texts
        out.lo, out.hi = (b.lo, b.hi) if a.lo is None else (a.lo, a.hi) if b.lo is None else (min(a.lo, b.lo), max(a.hi, b.hi))
    elif a.label[0] == "(":
        out.kids = [merged(x, y) for x, y in zip(a.kids, b.kids)]
    else:
        out.kids = aligned(a.kids, b.kids)
    return out


def grouped(kids: list[Part], groups: list[Part]) -> list[Part]:
    """Runs of parts that are the unit of one of the groups become that group, longest units first."""
    units: dict[int, dict[tuple, str]] = {}
    for g in groups:
        units.setdefault(len(g.kids), {})[tuple(k.label for k in g.kids)] = g.label
    sizes = sorted(units, reverse=True)
    labels = [k.label for k in kids]
    out, i = [], 0
    while i < len(kids):
        for size in sizes:
            label = units[size].get(tuple(labels[i : i + size]))
            if label is not None:
                group = Part(label)
                group.kids, group.optional = kids[i : i + size], all(k.optional for k in kids[i : i + size])
                out.append(group)
                i += size
                break
        else:
            out.append(kids[i])
            i += 1
    return out


def steps(a: list[Part], b: list[Part]):
    """The alignment of two lists: (part of a, part of b) in order, None for one that the other lacks."""
    for mine, other in ((a, b), (b, a)):
        there = {y.label for y in other}
        lacking = [x for x in mine if x.label[0] == "(" and x.label not in there]
        if lacking:
            other[:] = grouped(other, lacking)
    la, lb = [x.label for x in a], [x.label for x in b]
    if la == lb:
        yield from zip(a, b)
        return
    i = k = 0
    for j, m in [*_pairs(la, lb), (len(la), len(lb))]:
        yield from ((x, None) for x in a[i:j])
        yield from ((None, y) for y in b[k:m])
        if j < len(la):
            yield a[j], b[m]
        i, k = j + 1, m + 1


def _pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal labels, rising in both lists. Short lists are matched by their longest common runs; longer ones are
    first cut at runs of labels that each of them has once, the shortest such runs that there are."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        head = 0
        while i + head < j and k + head < m and a[i + head] == b[k + head]:
            head += 1
        out += [(i + n, k + n) for n in range(head)]
        i, k = i + head, k + head
        while j > i and m > k and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        if (j - i) * (m - k) <= SMALL:
            for x, y, n in SequenceMatcher(None, a[i:j], b[k:m], autojunk=False).get_matching_blocks():
                out += [(i + x + d, k + y + d) for d in range(n)]
            continue
        anchors = _anchors(a[i:j], b[k:m])
        edges = [(i, k), *((i + x, k + y) for x, y in anchors), (j, m)]
        if anchors:
            work += [(x, x2, y, y2) for (x, y), (x2, y2) in zip(edges, edges[1:])]
    return sorted(out)


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places at which both lists have a run that is in each of them once, rising in both lists."""
    rank = {x: n for n, x in enumerate(dict.fromkeys([*a, *b]))}
    ranks_a, ranks_b = ([rank[x] for x in side] for side in (a, b))
    length = 1
    while ranks_a and ranks_b:
        once_a, once_b = Counter(ranks_a), Counter(ranks_b)
        where = {r: n for n, r in enumerate(ranks_b) if once_b[r] == 1}
        both = [(n, where[r]) for n, r in enumerate(ranks_a) if once_a[r] == 1 and r in where]
        if both:
            return _rising(both)
        # the ranks of runs of twice the length
        pairs = [list(zip(side, side[length:])) for side in (ranks_a, ranks_b)]
        number = {x: n for n, x in enumerate(dict.fromkeys([*pairs[0], *pairs[1]]))}
        ranks_a, ranks_b = ([number[x] for x in side] for side in pairs)
        length *= 2
    return []


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of the pairs, in the order of the first, whose second rises."""
    tops: list[int] = []
    last: list[int] = []
    before = []
    for n, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        before.append(last[at - 1] if at else -1)
        if at == len(tops):
            tops.append(y)
            last.append(n)
        else:
            tops[at], last[at] = y, n
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def aligned(a: list[Part], b: list[Part]) -> list[Part]:
    """One list for two: what both have is merged, the rest is optional, and repeats fold."""
    out = []
    for x, y in steps(list(a), list(b)):
        if x is None or y is None:
            (x or y).optional = True
            out.append(x or y)
        else:
            out.append(merged(x, y))
    return folded(out)


class _Suffixes:
    """A stack of labels that knows the smallest repeat it ends with: the last ``size`` labels equal to those before them.

    Runs of 2, 4, 8 ... labels are indexed by their hash and the place they end at. A repeat of ``size`` labels has the run of
    the largest such length up to size at both of its ends; as repeats are folded as soon as they are there, equal runs stand
    apart, so few places are tried and a push costs the logarithm of the stack."""

    MOD, BASE = (1 << 61) - 1, 1_000_003

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.codes: list[int] = []
        self.sums, self.powers = [0], [1]
        self.ends: list[dict[int, list[int]]] = []

    def _run(self, start: int, end: int) -> int:
        return (self.sums[end] - self.sums[start] * self.powers[end - start]) % self.MOD

    def push(self, label: str) -> None:
        code = self.names.setdefault(label, len(self.names) + 1)
        self.codes.append(code)
        self.sums.append((self.sums[-1] * self.BASE + code) % self.MOD)
        n = len(self.codes)
        if n == len(self.powers):
            self.powers.append(self.powers[-1] * self.BASE % self.MOD)
        for k, length in self._lengths(n):
            if k == len(self.ends):
                self.ends.append({})
            self.ends[k].setdefault(self._run(n - length, n), []).append(n)

    def _lengths(self, n: int):
        k, length = 0, 2
        while length <= n:
            yield k, length
            k, length = k + 1, 2 * length

    def pop(self, count: int) -> None:
        for _ in range(count):
            n = len(self.codes)
            for k, length in self._lengths(n):
                self.ends[k][self._run(n - length, n)].pop()
            self.codes.pop()
            self.sums.pop()

    def repeat(self) -> int:
        """The size of the smallest repeat of two labels or more at the end; 0 if there is none."""
        n = len(self.codes)
        for k, length in self._lengths(n // 2):
            for end in reversed(self.ends[k][self._run(n - length, n)][:-1]):
                size = n - end
                if size >= 2 * length or 2 * size > n:
                    break
                if size >= length and self._run(n - size, n) == self._run(n - 2 * size, end):
                    return size
        return 0


def folded(kids: list[Part]) -> list[Part]:
    """Neighbouring parts of one label become one repeated part, and neighbouring equal runs one repeated group."""
    out: list[Part] = []
    seen = _Suffixes()
    groups: dict[int, list[int]] = {}  # place of each group, by the length of the list at which it may meet its run again

    def push(x: Part) -> None:
        out.append(x)
        seen.push(x.label)
        if x.label[0] == "(":
            groups.setdefault(len(out) + len(x.kids), []).append(len(out) - 1)

    def pop(count: int) -> None:
        for at in range(len(out) - 1, len(out) - 1 - count, -1):
            if out[at].label[0] == "(":
                groups[at + 1 + len(out[at].kids)].pop()
        del out[len(out) - count :]
        seen.pop(count)

    for x in kids:
        if out and out[-1].label == x.label:
            optional = out[-1].optional and x.optional
            out[-1] = merged(out[-1], x)
            out[-1].repeated, out[-1].optional = True, optional
            continue
        if out and out[-1].label[0] == "(" and out[-1].kids[-1].label == x.label:  # one more of the group's last part
            last = out[-1].kids[-1] = merged(out[-1].kids[-1], x)
            last.repeated = True
            continue
        push(x)
        if len(out) < 3:
            continue
        size = seen.repeat()
        near = [at for at in groups.get(len(out), ()) if all(p.label == q.label for p, q in zip(out[at].kids, out[at + 1 :]))]
        if near and (not size or len(out) - 1 - near[-1] < size):
            size = len(out) - 1 - near[-1]
            run, before = out[-size:], out[near[-1]]
            pop(size + 1)
        elif size:
            run = out[-size:]
            before = Part("(" + " ".join(k.label for k in run) + ")")
            before.kids, before.optional = out[-2 * size : -size], all(k.optional for k in run)
            pop(2 * size)
        else:
            continue
        group = Part(before.label)
        group.kids, group.repeated, group.optional = [merged(p, q) for p, q in zip(before.kids, run)], True, before.optional and all(k.optional for k in run)
        push(group)
    return out


def parsed(page: str) -> tuple[Part, list[str], list[int]]:
    """The page as a part, its texts, and the block that each is in."""
    root = Part("html")
    stack, names = [root], [""]  # open parts, and all open elements (those that are no part of their own as well)
    owner = [1]  # whether an open element is a part (1), none (0), or furniture below DEPTH (-1)
    opened: Counter = Counter()
    texts: list[str] = []
    blocks: list[int] = []
    block, links, hidden = 0, 0, 0

    def close() -> None:
        nonlocal links, hidden
        name = names.pop()
        opened[name] -= 1
        links -= name == "a"
        kind = owner.pop()
        hidden -= kind < 0
        if kind > 0:
            part = stack.pop()
            part.kids = folded(part.kids)

    for m in TOKEN.finditer(page):
        text = m.group(5)
        if text is not None:
            if hidden:
                continue
            if not text.isspace():
                kids = stack[-1].kids
                if not kids or kids[-1].label != "#":
                    kids.append(Part("#"))
                slot, size = kids[-1], len(text)
                slot.mass += size
                slot.link += size if links else 0
                slot.texts.append(len(texts))
                texts.append(text)
                blocks.append(block)
            elif texts and blocks[-1] == block:
                texts.append(text)  # white space between words of a block
                blocks.append(block)
                kids = stack[-1].kids
                if kids and kids[-1].label == "#":
                    kids[-1].texts.append(len(texts) - 1)
            continue
        name = m.group(3)
        if not name:
            continue
        name = name.lower()
        is_block = name in BLOCK
        if m.group(2):
            if opened[name]:
                while True:
                    last = names[-1]
                    close()
                    if last == name:
                        break
            block += is_block
            continue
        if is_block:
            block += 1
            while len(names) > 1 and (names[-1] not in BLOCK or names[-1] == "p" or (name in ("li", "td", "tr", "dd", "dt") and names[-1] == name)):
                close()
        if name in VOID:
            continue
        label, noise = labelled(name, m.group(4))
        if name == "header" and (opened["article"] or opened["main"]):
            noise = False
        names.append(name)
        opened[name] += 1
        links += name == "a"
        # inline elements are part of the text, unless they are furniture
        own = (is_block or noise) and len(stack) < DEPTH and name != "html"
        owner.append(int(own) if own or not noise else -1)
        hidden += noise and not own
        if own:
            part = Part(label, noise)
            stack[-1].kids.append(part)
            stack.append(part)
    while len(names) > 1:
        close()
    root.kids = folded(root.kids)
    return root, texts, blocks


def slots(part: Part) -> list[Part]:
    """All slots in page order."""
    return [part] if part.label == "#" else [s for k in part.kids for s in slots(k)]


def shape(part: Part) -> list | str:
    """The stream without what its slots hold."""
    if part.label == "#":
        return "#"
    return [part.label, int(part.optional) | int(part.repeated) << 1 | int(part.noise) << 2, *map(shape, part.kids)]


def dumped(part: Part) -> list:
    if part.label == "#":
        return ["#", int(part.optional) | int(part.repeated) << 1, part.pages, part.mass, part.link, part.lo, part.hi]
    return [part.label, int(part.optional) | int(part.repeated) << 1 | int(part.noise) << 2, *map(dumped, part.kids)]


def loaded(row: list | str) -> Part:
    """A part from what dumped() or shape() made of it."""
    if row == "#":
        return Part("#")
    part = Part(row[0], bool(row[1] & 4))
    part.optional, part.repeated = bool(row[1] & 1), bool(row[1] & 2)
    if row[0] == "#":
        part.pages, part.mass, part.link, part.lo, part.hi = row[2:]
    else:
        part.kids = [loaded(k) for k in row[2:]]
    return part


def print_of(slot: Part, texts: list[str]) -> int:
    raw = "".join([texts[k] for k in slot.texts]).strip().encode("utf-8", "surrogatepass")
    return (len(raw) & 0x3FFFFFFF) << 32 | zlib.crc32(raw)


def expression(part: Part) -> str:
    """The wrapper as a union-free regular expression."""
    inner = part.label if part.label == "#" else "".join(map(expression, part.kids))
    if part.label[0] not in "#(":
        inner = f"<{part.label}>{inner}</{part.label.split('.')[0]}>"
    sign = ("+" if part.repeated else "") + ("?" if part.optional else "")
    return "(" + inner + ")" + sign if sign and part.label != "#" else inner + ("?" if sign[-1:] == "?" else "")


STREAM = "host string, h1 long, h2 long, slot int, stream string, pages long, mass long, link long, lo long, hi long"


def _streams(batches):
    """Each distinct stream of a batch, and the sums of each of its slots."""
    for rows in batches:
        for part in slices(rows, 1, 16 << 20):
            known: dict[tuple[str, str], list] = {}
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                root, texts, _ = parsed(page or "")
                held = slots(root)
                key = host, json.dumps(shape(root), separators=(",", ":"), ensure_ascii=False)
                prints = [print_of(s, texts) for s in held]
                sums = known.get(key)
                if sums is None:
                    known[key] = [1, [[s.mass, s.link, p, p] for s, p in zip(held, prints)]]
                    continue
                sums[0] += 1
                for had, s, p in zip(sums[1], held, prints):
                    had[0] += s.mass
                    had[1] += s.link
                    if p < had[2]:
                        had[2] = p
                    elif p > had[3]:
                        had[3] = p
            out = []
            for (host, stream), (pages, held) in known.items():
                raw = stream.encode("utf-8", "surrogatepass")
                h1, h2 = zlib.crc32(raw) << 31 ^ zlib.adler32(raw), zlib.crc32(raw[::-1]) << 31 ^ len(raw)
                out.append((host, h1, h2, -1, raw.decode("utf-8", "replace"), pages, 0, 0, 0, 0))
                out += [(host, h1, h2, k, None, pages, *s) for k, s in enumerate(held)]
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5)
            names = ["host", "h1", "h2", "slot", "stream", "pages", "mass", "link", "lo", "hi"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 10, types)], names=names)


def _filled(row: list, held: list[dict]) -> Part:
    """A stream with what its slots hold."""
    part = loaded(row)
    for s, x in zip(slots(part), held):
        s.pages, s.mass, s.link, s.lo, s.hi = x["pages"], x["mass"], x["link"], x["lo"], x["hi"]
    return part


def _parts(batches):
    """host, its number of pages, and the stream of each row with its slots filled."""
    for rows in batches:
        wrappers = [json.dumps(dumped(_filled(json.loads(s), held))) for s, held in zip(rows.column(1).to_pylist(), rows.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(wrappers, pa.string())], names=["host", "stream", "pages", "wrapper"])


def _aligned(table: pa.Table) -> pa.Table:
    """All streams of one part, in the order of the streams, into one expression."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("stream", "pages", "wrapper"))))
    whole = loaded(json.loads(rows[0][2]))
    for _, _, other in rows[1:]:
        whole = merged(whole, loaded(json.loads(other)))
    return pa.table({"host": table.column("host").slice(0, 1), "stream": pa.array([rows[0][0]]), "pages": pa.array([sum(r[1] for r in rows)], pa.int64()), "wrapper": pa.array([json.dumps(dumped(whole))])})


def wrappers(pages: DataFrame) -> tuple[DataFrame, str]:
    """host, stream, pages, wrapper of each host, and where they are written. pages: host, html."""
    spark = pages.sparkSession
    found = pages.mapInArrow(_streams, STREAM)
    summed = found.groupBy("host", "h1", "h2", "slot").agg(F.max("stream").alias("stream"), *[F.sum(c).alias(c) for c in ("pages", "mass", "link")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    held = F.sort_array(F.collect_list(F.when(F.col("slot") >= 0, F.struct("slot", "pages", "mass", "link", "lo", "hi"))))
    streams = summed.groupBy("host", "h1", "h2").agg(F.max("stream").alias("stream"), F.max("pages").alias("pages"), held.alias("held")).select("host", "stream", "pages", "held")
    schema = "host string, stream string, pages long, wrapper string"
    now, path = written(streams.mapInArrow(_parts, schema), "streams")
    while True:
        sizes = now.groupBy("host").agg(F.count(F.lit(1)).alias("streams"))
        if (sizes.agg(F.max("streams")).first()[0] or 0) <= 1:
            return now, path
        dealt = now.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("stream"), F.ceil(F.col("streams") / PART)))
        after, new_path = written(dealt.groupBy("host", "part").applyInArrow(_aligned, schema), "streams")
        drop_scratch(spark, path)
        now, path = after, new_path


def choose(root: Part, pages: int) -> list[Part]:
    """Marks the constants and the slots that are kept; gives the content parts."""
    held: dict[int, list[int]] = {}

    def measured(part: Part) -> tuple[int, int]:
        """Text of a part that is in no link: what varies, and all."""
        if part.label == "#":
            part.constant = part.pages >= CONSTANT_PAGES and part.pages >= CONSTANT_SHARE * pages and part.lo == part.hi
            free = part.mass - part.link
            got = (0 if part.constant else free, free)
        else:
            each = [measured(k) for k in part.kids]
            got = (0, 0) if part.noise else (sum(a for a, _ in each), sum(b for _, b in each))
        held[id(part)] = got
        return got

    varying, text = measured(root)
    which = 0 if 5 * varying >= text and varying else 1  # without text that varies all text counts
    weight = lambda p: held[id(p)][which]

    named: list[tuple[int, int, Part]] = []

    def search(part: Part, depth: int) -> None:
        for k in part.kids:
            if not k.noise and k.label != "#":
                if is_named(k.label):
                    named.append((held[id(k)][1], depth, k))
                search(k, depth + 1)

    search(root, 0)
    most = max((m for m, _, _ in named), default=0)
    if most:
        # the innermost of the elements with nearly all of that text
        content = [max((d, m, -n, k) for n, (m, d, k) in enumerate(named) if m >= MOST * most)[3]]
    else:
        here = root
        while True:
            inner = [k for k in here.kids if not k.noise and not k.repeated and k.label.split(".")[0] in HOLDERS and weight(k) >= MOST * weight(here) and weight(k)]
            if not inner:
                break
            here = inner[0]
        content = [here]
        if here is not root:
            content = [*lead_headings(root, here, which, held), here]
    for c in content:
        mark_records(c, held)
    inside = sum(held[id(c)][1] for c in content)
    sure = sum(held[id(c)][0] for c in content)
    for c in content:
        keep(c, drop_constants=2 * sure >= inside)
    return content


def is_record(part: Part) -> bool:
    """Whether a repeated part looks like one reader's comment: a name and a date, or another short text, in blocks of their
    own and then a longer one, without a heading."""
    if part.label[0] != "(" and part.label.split(".")[0] not in RECORDS:
        return False
    held = []
    for k in part.kids:
        inner = [k] if k.label == "#" else slots(k)
        if any(h.label.split(".")[0] in HEADS for h in elements(k)):
            return False
        mass, pages = sum(s.mass for s in inner), max((s.pages for s in inner), default=0)
        if mass:
            held.append(mass / max(1, pages))
    return len(held) >= 3 and max(held[:2]) <= SHORT_TEXT < 2 * max(held[2:])


def elements(part: Part) -> list[Part]:
    return [part, *(e for k in part.kids for e in elements(k))]


def mark_records(content: Part, held: dict[int, tuple[int, int]]) -> None:
    """Records that repeat after the prose of the content part are readers' comments: furniture. Prose is what stands in no
    such record; nine tenths of it must come before them."""
    found: list[tuple[int, Part]] = []
    prose = 0

    def look(part: Part) -> None:
        nonlocal prose
        for k in part.kids:
            if k.label == "#":
                prose += k.mass - k.link
            elif not k.noise:
                if k.repeated and is_record(k):
                    found.append((prose, k))
                else:
                    look(k)

    look(content)
    for before, record in found:
        if prose and before >= MOST * prose:
            record.noise = True
            held[id(record)] = (0, 0)


def lead_headings(root: Part, content: Part, which: int, held: dict) -> list[Part]:
    """First-level headings that stand before the content part and outside of furniture."""
    out: list[Part] = []

    def look(part: Part) -> bool:
        for k in part.kids:
            if k is content:
                return True
            if k.noise or k.label == "#":
                continue
            if k.label.split(".")[0] == "h1" and held[id(k)][which]:
                out.append(k)
            elif look(k):
                return True
        return False

    look(root)
    return out


def keep(part: Part, drop_constants: bool, heading: bool = False) -> None:
    if part.label == "#":
        part.kept = heading or not (drop_constants and part.constant)
        return
    heading = heading or part.label.split(".")[0] in HEADS
    for k in part.kids:
        if not k.noise:
            keep(k, drop_constants, heading)
    part.kept = True


def take(page: Part, wrapper: Part, out: list[int], lone: bool) -> None:
    """The texts of a page's part that the wrapper keeps. lone: what the wrapper lacks is kept as well."""
    if page.label == "#":
        page.constant = wrapper.constant
        if wrapper.kept:
            out += page.texts
        return
    if page.label[0] == "(":
        pairs = zip(wrapper.kids, page.kids)
    else:
        pairs = steps(list(wrapper.kids), list(page.kids))
    for w, p in pairs:
        if p is None:
            continue
        if w is None:
            if lone or wrapper.kept:
                out += [t for s in free_slots(p) for t in s.texts]
        else:
            take(p, w, out, wrapper.kept)


def free_slots(part: Part) -> list[Part]:
    """The slots of a part that are in no furniture."""
    if part.noise:
        return []
    return [part] if part.label == "#" else [s for k in part.kids for s in free_slots(k)]


def text_of(page: str, wrapper: Part) -> str:
    """The text of a page in the content slots of its host's wrapper: blocks in page order, white space as one space."""
    root, texts, blocks = parsed(page)
    found: list[int] = []
    take(root, wrapper, found, False)
    if not found:
        # the page lacks the host's content part: it is its own wrapper
        for s in slots(root):
            s.lo = s.hi = 0
            s.pages = CONSTANT_PAGES if s.constant else 1
        for c in choose(root, 1):
            found += [t for s in slots(c) if s.kept for t in s.texts]
    out: list[str] = []
    now, block = [], -1
    for k in sorted(set(found)):
        if blocks[k] != block:
            out.append("".join(now))
            now, block = [], blocks[k]
        now.append(texts[k])
    out.append("".join(now))
    return " ".join(b for b in (SPACE.sub(" ", entities.unescape(x)).strip() for x in out) if b)


def ready(stream: str, pages: int) -> Part:
    """A host's wrapper with its content chosen."""
    root = loaded(json.loads(stream))
    choose(root, pages)
    return root


def _texts(batches, shared=None):
    """Texts by the wrapper that is shared for the host, or that stands beside the page."""
    made: dict[str | None, Part] = {}
    for rows in batches:
        for part in slices(rows, 3, 8 << 20):
            texts = []
            beside = part.column(4).to_pylist() if shared is None else None
            for k, (host, page) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                if not page:
                    texts.append("")
                    continue
                if host not in made:
                    if shared is None and len(made) > 256:
                        made.clear()
                    made[host] = ready(*(shared.value[host] if shared is not None else (beside[k]["wrapper"], beside[k]["pages"])))
                texts.append(text_of(page, made[host]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    rows = pages.select(col(pages, id_col).cast("long").alias("page_id"), col(pages, url_col).cast("string").alias("url"), host_of(col(pages, url_col).cast("string")).alias("host"), col(pages, html_col).cast("string").alias("html"))
    found, path = wrappers(rows.select("host", "html"))
    out = "page_id long, url string, text string, n_chars long"
    size = found.agg(F.sum(F.length("wrapper") + F.length("host") + 200)).first()[0] or 0
    if size <= broadcast_bytes:
        table = {r.host: (r.wrapper, r.pages) for r in found.collect()}
        drop_scratch(pages.sparkSession, path)
        return rows.mapInArrow(partial(_texts, shared=pages.sparkSession.sparkContext.broadcast(table)), out)
    beside = found.select("host", F.struct("wrapper", "pages").alias("beside"))
    return rows.join(beside, "host", "left").select("page_id", "url", "host", "html", "beside").mapInArrow(_texts, out)
