"""Main text of pages through inferred wrappers.

Method: union-free regular-expression inference by host. A page becomes a stream of structural
tokens, nested as its elements are: labels of block elements (tag with class or id), and text slots;
inline tags are dropped. Siblings that repeat, one by one or in passages of up to PERIOD siblings of
any size, fold into repeated groups. The streams of a host's pages are aligned one after the other
with the wrapper so far, level by level along a longest common subsequence: what only one side has
becomes optional, and a text slot stays constant only while all pages have the same text there (a
repeated slot: the same texts). All pages of a host count, not a sample: streams are aligned in
bounded groups, whose wrappers are aligned in turn, until one is left. A wrapper has at most CHILDREN
items a level and ITEMS in all: optional items seen least go. Where any went, the host's pages are
aligned once more, each with the wrapper that is left, and all slots of all pages are counted, exactly
and in no one place: those that stand in the wrapper by slot, the rest by path and number among the
page's slots of that path. These counts decide the container and the constants of that host; a slot
of fewer than LEAST_PAGES pages is variable there, so that the bound never costs text.

Extraction: the wrapper names the host's content container, outside regions which are menus, headers,
footers, sidebars, notices, adverts, forms or comments by tag, role, class or id: an article or main
element that holds half of the variable text, else the lowest element that holds all of it. A page's
text is what its container holds outside such regions and outside what is never text (scripts, styles,
...). Where the container is no article or main, the page is aligned with the wrapper, and constant
slots that LEAST_PAGES pages share go, if they stand before or after all variable text or in a region
of the container without any; constant lines within the article stay. Where less than a quarter of a
wrapper's text varies (few pages, or copies of one) constants say nothing and all stays. A page that
lacks the container falls back to its own article, main or body, and one whose text is all in away
regions to what lies in those that are so by their name alone: menus and forms by tag are no main text, so
that a page of nothing else has none. A class or id names a region as a whole (``site-header``, not
``has-sidebar``), and only of an element that is one: never of a heading, paragraph, quotation, table or
inline element.

Defined results: null and empty pages give an empty text; pages without a host in their url share
the wrapper of the empty host; broken and cut-off markup is read as far as it goes, a quote counts
only around an attribute's value; null page ids and repeated rows pass through; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: Elements by role (fixed values).
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe svg select option button canvas audio video head".split())
AWAY = frozenset("nav header footer aside form dialog menu".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu".split())
_AWAY_WORD = r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|side-bar|aside|widget\w*|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|replies|respond|disqus|pagination|pager|toolbar|skip-link)"
#: Words that say no more than where or what sort of box it is; a number too.
_PLACE_WORD = r"(?:site|page|main|global|top|bottom|left|right|primary|secondary|post|posts|user|wrap|wrapper|container|area|section|list|items?|links?|box|block|bar|panel|inner|outer|content|form|buttons?|[0-9]+)"
#: A whole class or id: of these words alone, one of the former at least.
AWAY_NAMES = re.compile(rf"(?i)(?:^|\s)(?:{_PLACE_WORD}[_-]+)*{_AWAY_WORD}(?:[_-]+(?:{_AWAY_WORD}|{_PLACE_WORD}))*(?=$|\s)")
#: Elements whose class, id or role may make them a region; that of a heading, a line, a table or an inline element says nothing (fixed values).
REGIONS = frozenset("div section aside nav header footer ul ol dl form dialog menu details fieldset address article main center iframe".split())
#: A name that says no more than that it is a header.
_HEADER_NAME = re.compile(rf"(?i)^(?:{_PLACE_WORD}[_-]+)*(?:header|masthead)(?:[_-]+(?:header|masthead|{_PLACE_WORD}))*$")
#: Elements that are lines of a text rather than regions (fixed values).
TEXT_LINES = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd figcaption summary".split())
#: Implied ends: an opening tag on the left closes an open one of those on the right.
_P_ENDS = BLOCKS - {"html", "body"}
#: A quote counts after = only; one that is never closed, or closes in another tag, does not.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:\"[^\"<]*+\"|'[^'<]*+'|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))|[^>])*+)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_CUT_OFF = re.compile(r"<[A-Za-z/!][^<>]*\Z")

#: Siblings of a repeated passage, items of a wrapper's level, and items of a wrapper, at most.
PERIOD, CHILDREN, ITEMS = 8, 64, 4096
#: Elements below this depth are no level of their own in a stream.
DEPTH = 48
#: Pages that share a constant, at least, before it counts as the template's.
LEAST_PAGES = 3
#: Streams that one group aligns.
GROUP_STREAMS = 64
#: Shares into which a host's pages are dealt where its wrapper is joined.
SHARES = 32
#: Wrappers of this many characters in all are sent to every executor; beyond it they are joined by host.
BROADCAST_CHARS = 8_000_000


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _attributes(text: str) -> dict[str, str]:
    return {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or "" for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def _away(tag: str, own: dict[str, str]) -> str:
    """Why a region holds no main text: its tag or role, its name, or that it is a header; empty where it may hold some."""
    name = own.get("id", "") + " " + own.get("class", "")
    role = own.get("role", "").lower() in AWAY_ROLES and tag in REGIONS
    named = [n for n in name.split() if tag in REGIONS and AWAY_NAMES.search(n)]
    if tag == "header" and not role and all(map(_HEADER_NAME.match, named)) or tag != "header" and named and not role and tag not in AWAY and all(map(_HEADER_NAME.match, named)):
        return "header"
    return "tag" if tag in AWAY or role else "name" if named else ""


def events(page: str) -> Iterator[tuple[str, str, str, str]]:
    """("open", tag, label, away), ("close", tag, "", "") and ("text", text, "", ""), in page order.

    Raw elements and comments are left out. label is the tag with its id or classes; away tells why a region holds no main text.
    """
    at, skipping = 0, ""
    for m in _MARKUP.finditer(page):
        if m.start() < at:
            continue
        if not skipping and m.start() > at:
            yield "text", page[at : m.start()], "", ""
        at = m.end()
        tag = (m.group(2) or "").lower()
        if skipping:
            if tag == skipping and m.group(1):
                skipping = ""
            continue
        if not tag:
            continue
        if m.group(1):
            yield "close", tag, "", ""
            continue
        if tag in RAW and not m.group(3).endswith("/"):
            end = re.compile(rf"(?i)</{re.escape(tag)}\s*>").search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style", "title", "textarea"):
                return
            elif tag == "head":
                body = re.compile(r"(?i)<body\b").search(page, at)
                at = body.start() if body else at
            continue
        own = _attributes(m.group(3))
        name = own.get("id", "") + " " + own.get("class", "")
        yield "open", tag, " ".join([tag, *sorted(name.split())]), _away(tag, own)
    if not skipping and at < len(page):
        rest = _CUT_OFF.sub("", page[at:])
        if rest:
            yield "text", rest, "", ""


def lines(page: str) -> list[tuple[tuple[list, ...], str]]:
    """Elements around it, outermost first, and text, of every block in page order.

    An element: tag, label, why away (or empty), its parent, and the characters in it.

    html and body are never away, nor is a header within an article or main that holds an h1 or h2, or
    that is a header element without a name of another region. Where every article and main lies in an away region, what holds the
    longest of them (main elements before articles) is not one.
    """
    stack: list[list] = []
    held: list[tuple[tuple[list, ...], str]] = []
    named: list[list] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                held.append((tuple(stack), text))
                for element in stack:
                    element[4] += len(text)

    for kind, tag, label, away in events(page):
        if kind == "text":
            parts.append(tag)
        elif tag == "br":
            parts.append(" ")
        elif tag not in BLOCKS and not (kind == "open" and away and tag not in VOID) and not (kind == "close" and any(e[0] == tag and e[2] for e in stack)):
            continue
        elif kind == "open":
            flush()
            if tag in _P_ENDS and stack and stack[-1][0] == "p":
                stack.pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th") and stack and (stack[-1][0] == tag or {stack[-1][0], tag} in ({"dt", "dd"}, {"td", "th"})):
                stack.pop()
            if tag not in VOID:
                # Only what can hold blocks, or is away, gets a place; the header of an article belongs to it.
                inside = tag == "header" and away == "header" and label == "header" and any(e[0] in ("article", "main") for e in stack)
                stack.append([tag, label, "" if inside or tag in ("html", "body") else away, stack[-1] if stack else None, 0])
                if tag in ("h1", "h2"):
                    for k, element in enumerate(stack):
                        if element[2] == "header" and any(e[0] in ("article", "main") for e in stack[:k]):
                            element[2] = ""
                if tag in ("article", "main"):
                    named.append(stack[-1])
        else:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
    flush()
    if named and all(any(e[2] for e in _line(own)) for own in named):
        for element in _line(max(named, key=lambda e: (e[4] > 0, e[0] == "main", e[4]))):
            element[2] = ""
    return held


def label_of(element: list) -> str:
    return "!" + element[1] if element[2] else element[1]


def blocks(page: str) -> list[tuple[tuple[str, ...], bool, str]]:
    """Path of labels, whether it lies in an away region, and text, of every block in page order."""
    return [(tuple(map(label_of, line)), any(e[2] for e in line), text) for line, text in lines(page)]


def _line(element: list | None) -> Iterator[list]:
    """An element and all that holds it."""
    while element is not None:
        yield element
        element = element[3]


# Items of a stream or wrapper:
#   ["t", digest or None where texts differ, characters, pages, numbers of a page's blocks]
#   ["e", label, items, repeated, optional, pages]
#   ["g", items, repeated, optional, pages]: a passage of several siblings


def key(item: list) -> str:
    """What must be equal for two items to be aligned: repeated or not is no part of it."""
    return "#" if item[0] == "t" else item[1] if item[0] == "e" else "(" + "\0".join(map(key, item[1])) + ")"


def merged(a: list, b: list, within: bool) -> list:
    """One item that stands for both. within: both are of one page, so their texts are one slot's list of texts."""
    if a[0] == "t":
        if within:
            return ["t", (31 * a[1] + b[1]) % (1 << 48), a[2] + b[2], 1, a[4] + b[4]]
        return ["t", a[1] if a[1] == b[1] else None, a[2] + b[2], a[3] + b[3], []]
    flags = [int(bool(x or y)) for x, y in zip(a[-3:-1], b[-3:-1])]
    return [*a[:-4], merged_lists(a[-4], b[-4], within), *flags, 1 if within else a[-1] + b[-1]]


def optional(item: list) -> list:
    return ["g", [item], 0, 1, item[3]] if item[0] == "t" else [*item[:-2], 1, item[-1]]


def bare(item: list) -> list:
    """An optional text slot as what it holds."""
    return item[1][0] if item[0] == "g" and len(item[1]) == 1 and item[1][0][0] == "t" else item


def regrouped(items: list, others: list) -> list:
    """items, with every passage that others has as a group folded into one."""
    for group in (x for x in others if x[0] == "g" and len(x[1]) > 1):
        keys, inner, own = [key(x) for x in items], [key(x) for x in group[1]], key(group)
        if own in keys or len(inner) > len(items):
            continue
        size, at, out = len(inner), 0, []
        while at < len(items):
            if keys[at : at + size] == inner:
                out.append(["g", items[at : at + size], 0, 0, 1])
                at += size
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence: a longest one, but of lists with over 65,536 pairs of items the longest blocks in common, and what lies between them likewise."""
    if a == b:
        return [(k, k) for k in range(len(a))]
    if len(a) * len(b) > 1 << 16:
        return [(m.a + k, m.b + k) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for k in range(m.size)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(a: list, b: list) -> tuple[list, list, list[tuple[int, int]]]:
    """Both lists of items, passages grouped alike, and the places that align."""
    a, b = regrouped(a, b), regrouped(b, a)
    return a, b, common([key(bare(x)) for x in a], [key(bare(x)) for x in b])


def merged_lists(a: list, b: list, within: bool) -> list:
    a, b, places = aligned(a, b)
    out, i, j = [], 0, 0
    for k, l in [*places, (len(a), len(b))]:  # noqa: E741
        out += [optional(x) for x in a[i:k]] + [optional(x) for x in b[j:l]]
        if k < len(a):
            x, y = bare(a[k]), bare(b[l])
            both = merged(x, y, within)
            out.append(optional(both) if x is not a[k] or y is not b[l] else both)
        i, j = k + 1, l + 1
    return out


def folded(items: list) -> list:
    """The items with adjacent passages that align folded into repeated ones."""
    for x in items:
        if x[0] == "e":
            x[2] = folded(x[2])
    size = 1
    while size <= min(PERIOD, len(items) // 2):
        keys, out, at = [key(x) for x in items], [], 0
        while at < len(items):
            passage, n = items[at : at + size], 1
            while len(passage) == size and keys[at : at + size] == keys[at + n * size : at + (n + 1) * size]:
                passage = [merged(x, y, True) for x, y in zip(passage, items[at + n * size : at + (n + 1) * size])]
                n += 1
            if n == 1:
                out.append(items[at])
            elif size > 1:
                out.append(["g", passage, 1, 0, 1])
            else:
                out.append(passage[0] if passage[0][0] == "t" else [*passage[0][:-3], 1, *passage[0][-2:]])
            at += size * n if n > 1 else 1
        # A shorter passage may repeat only now.
        size, items = 1 if len(out) < len(items) and size > 1 else size + 1, out
    return items


def stream_of(held: list[tuple[tuple[list, ...], str]]) -> list:
    """The items of a page from its lines."""
    root: list = []
    levels, path = [root], ()
    for number, (line, text) in enumerate(held):
        line, same = line[:DEPTH], 0
        while same < min(len(path), len(line)) and path[same] is line[same]:
            same += 1
        del levels[same + 1 :]
        for element in line[same:]:
            levels[-1].append(["e", label_of(element), [], 0, 0, 1])
            levels.append(levels[-1][-1][2])
        levels[-1].append(["t", crc32(text.encode("utf-8", "surrogatepass")), len(text), 1, [number]])
        path = line
    return folded(root)


def bounded(items: list, room: int | None = None, lost: list | None = None) -> list:
    """The items without those optional ones seen least, so that no level and not the whole is too large; room (ITEMS) is shared out evenly. lost gets an entry wherever any go."""
    room, lost = ITEMS if room is None else room, [] if lost is None else lost
    if len(items) > (most := max(1, min(CHILDREN, room))):
        lost.append(True)
        keep = sorted(sorted(range(len(items)), key=lambda k: (-items[k][3 if items[k][0] == "t" else -1], k))[:most])
        items = [items[k] for k in keep]
    share = (room - len(items)) // max(1, sum(x[0] != "t" for x in items))
    if share <= 0 and any(x[0] != "t" and x[-4] for x in items):
        lost.append(True)
    return [[*x[:4], []] if x[0] == "t" else [*x[:-4], bounded(x[-4], share, lost), *x[-3:]] if share > 0 else [*x[:-4], [], *x[-3:]] for x in items]


def align(wrapper: list, stream: list, lost: list | None = None) -> list:
    """The wrapper generalised so that it also fits the stream (itself possibly a wrapper)."""
    return bounded(merged_lists(wrapper, stream, False), lost=lost)


def constants(wrapper: list, stream: list, out: set[int]) -> set[int]:
    """Adds the numbers of the stream's blocks that stand at constant slots of the wrapper."""
    wrapper, stream, places = aligned(wrapper, stream)
    for k, l in places:  # noqa: E741
        x, y = bare(wrapper[k]), bare(stream[l])
        if x[0] != "t":
            constants(x[-4], y[-4], out)
        elif x[1] is not None and x[1] == y[1] and x[3] >= LEAST_PAGES:
            out.update(y[4])
    return out


def _texts(items: list, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], list]]:
    """Path and text slot, in order."""
    for item in items:
        if item[0] == "t":
            yield path, item
        else:
            yield from _texts(item[-4], path if item[0] == "g" else (*path, item[1]))


def numbered(wrapper: list) -> list:
    """The wrapper, whose text slots hold their number."""
    for number, (_, item) in enumerate(_texts(wrapper)):
        item[4] = [number]
    return wrapper


def _placed(wrapper: list, stream: list, path: tuple[str, ...] = ()) -> Iterator[tuple[int, tuple[str, ...], list]]:
    wrapper, stream, places = aligned(wrapper, stream)
    at = {l: k for k, l in places}  # noqa: E741
    for place, item in enumerate(stream):
        if place not in at:
            yield from ((-1, *found) for found in _texts([item], path))
            continue
        x, y = bare(wrapper[at[place]]), bare(item)
        if x[0] == "t":
            yield x[4][0], path, y
        else:
            yield from _placed(x[-4], y[-4], path if y[0] == "g" else (*path, y[1]))


def placed(wrapper: list, stream: list) -> Iterator[tuple[int, tuple[str, ...], int, list]]:
    """Every text slot of a page: the number of the numbered wrapper's slot at which it stands, or -1 where that has none; its path; for -1 its number among the page's such slots of that path; the slot."""
    met: dict[tuple[str, ...], int] = {}
    for number, path, item in _placed(wrapper, stream):
        if number < 0:
            met[path] = met.get(path, -1) + 1
        yield number, path, met[path] if number < 0 else 0, item


def _weights(items: list, path: tuple[str, ...], out: dict[tuple[str, ...], list[int]]) -> None:
    """Characters of variable and of constant slots by path; away regions count for nothing."""
    for item in items:
        if item[0] == "t":
            out.setdefault(path, [0, 0])[item[1] is not None] += item[2]
        elif item[0] == "g":
            _weights(item[1], path, out)
        elif not item[1].startswith("!"):
            _weights(item[2], (*path, item[1]), out)


def content_path(wrapper: list) -> tuple[tuple[str, ...], bool]:
    """The innermost container with most of the variable text: an article or main element that holds
    half of it, else the lowest element that holds all of it, so that no sibling with text is left out;
    and whether constant slots in it may be the template's."""
    weights: dict[tuple[str, ...], list[int]] = {}
    _weights(wrapper, (), weights)
    within: dict[tuple[str, ...], list[int]] = {}
    for own, counts in weights.items():
        for k in range(len(own) + 1):
            within[own[:k]] = [a + b for a, b in zip(within.get(own[:k], (0, 0)), counts)]
    return container(within)


def container(within: dict[tuple[str, ...], list[int]]) -> tuple[tuple[str, ...], bool]:
    """``content_path`` of the characters of variable and of constant slots below each path. Paths with at most half of them are needed only where they hold all."""
    variable, constant = within.get((), (0, 0))
    varies = variable > 0 and 3 * variable >= constant
    total = {p: v if varies else v + c for p, (v, c) in within.items()}
    here: tuple[str, ...] = ()
    if named := [p for p in total if p and p[-1].split()[0] in ("article", "main") and 2 * total[p] > total[()]]:
        return max(named, key=lambda p: (p[-1].split()[0] == "article", total[p], p)), False
    while below := [p for p in total if len(p) == len(here) + 1 and p[: len(here)] == here and p[-1].split()[0] in ("html", "body", "div", "section", "td", "tr", "table", "tbody", "center")]:
        best = max(below, key=lambda p: (total[p], p))
        if total[best] < total[here] or not total[here]:
            break
        here = best
    return here, varies and within[here][1] > 0


def main_text(page: str, path: tuple[str, ...], wrapper: list | None = None, also: Iterable[int] = ()) -> str:
    """The texts of the blocks under the container at path that lie in no away region, one a line; where all lie in one, of those in regions that are away by name alone.

    With a wrapper, constant slots of the template go, and so do the blocks with the numbers in also.
    """
    held = lines(page)
    every = [(tuple(map(label_of, line)), number, text) for number, (line, text) in enumerate(held)]
    for found in ([b for b in every if not any(e[2] for e in held[b[1]][0])], [b for b in every if not any(e[2] == "tag" or e[0] in AWAY and e[2] for e in held[b[1]][0])]):
        inside = [b for b in found if path and b[0][: len(path)] == path]
        if inside and wrapper:
            inside = without_template(inside, held, len(path), constants(wrapper, stream_of(held), set(also)))
        for tag in ("article", "main"):
            inside = inside or [b for b in found if any(x.split()[0].removeprefix("!") == tag for x in b[0])]
        if inside := inside or found:
            return "\n".join(text for *_, text in inside)
    return ""


def without_template(inside: list, held: list, depth: int, constant: set[int]) -> list:
    """The blocks without constant ones before or after all variable ones, or in a region (an element of the container that is no line of text) without variable ones."""
    numbers = [number for _, number, _ in inside if number not in constant]
    if not numbers:
        return inside
    region = lambda number: held[number][0][depth] if len(held[number][0]) > depth else None
    varied = {id(region(n)) for n in numbers}
    keep = lambda n: n not in constant or numbers[0] < n < numbers[-1] and ((r := region(n)) is None or r[0] in TEXT_LINES or id(r) in varied)
    return [b for b in inside if keep(b[1]) or any(x.split()[0] in ("article", "main") for x in b[0])]


def _merge_streams(group: pa.Table) -> pa.Table:
    wrapper: list | None = None
    lost = [True for short in group.column("short").to_pylist() if short]
    for stream in sorted(group.column("stream").to_pylist()):
        wrapper = json.loads(stream) if wrapper is None else align(wrapper, json.loads(stream), lost)
    return pa.table({"host": [group.column("host")[0].as_py()], "stream": [json.dumps(wrapper, ensure_ascii=False)], "short": [bool(lost)]})


def _met(own: DataFrame, wrappers: DataFrame, size: int, how: str) -> DataFrame:
    """Pages (host, html, ...) with the wrappers of their hosts; size: the characters of all wrappers."""
    if size <= BROADCAST_CHARS:
        return own.join(F.broadcast(wrappers), "host", how)
    # A host's pages are dealt out: each share meets a copy of its wrapper.
    dealt = own.withColumn("share", F.pmod(F.xxhash64("html"), F.lit(SHARES)).cast("int"))
    return dealt.join(wrappers.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))), ["host", "share"], how)


def _counted(own: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, content, templated and wrapper (constants and pages set anew), one row a host, and with rest (``_rest``) one for each constant slot of the content that it has no room for.

    own: host and html; wrappers: host and stream, from which items went. The counts are those of all slots of all pages.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            found: dict[tuple, list[int]] = {}
            for host, page, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "stream"))):
                for number, path, k, item in placed(_numbered(wrapper), stream_of(lines(page or ""))):
                    lo, hi, pages, chars = found.get((host, path, number, k), (item[1], item[1], 0, 0))
                    found[host, path, number, k] = [min(lo, item[1]), max(hi, item[1]), pages + 1, chars + item[2]]
            columns = [*zip(*found)], [*zip(*found.values())]
            hosts, paths, numbers, ks = columns[0] or ((),) * 4
            arrays = [pa.array(hosts, pa.string()), pa.array([list(p) for p in paths], pa.list_(pa.string())), pa.array(numbers, pa.int32()), pa.array(ks, pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1] or ((),) * 4)]
            yield pa.record_batch(arrays, names=["host", "path", "slot", "k", "lo", "hi", "pages", "chars"])

    size = wrappers.agg(F.sum(F.length("stream") + F.length("host"))).first()[0] or 0
    rows = _met(own, wrappers, size, "inner").select("host", "html", "stream").mapInArrow(slots, "host string, path array<string>, slot int, k int, lo long, hi long, pages long, chars long")
    counts = cut(rows.groupBy("host", "path", "slot", "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars")))

    below = F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", 1, n))).alias("path")
    seen = counts.where(~F.exists("path", lambda label: F.startswith(label, F.lit("!")))).withColumn("same", (F.col("lo") == F.col("hi")) & (F.col("pages") >= LEAST_PAGES))
    within = seen.select("host", below, F.when(~F.col("same"), F.col("chars")).otherwise(0).alias("v"), F.when(F.col("same"), F.col("chars")).otherwise(0).alias("c")).groupBy("host", "path").agg(F.sum("v").alias("v"), F.sum("c").alias("c"))
    whole = within.where(F.size("path") == 0).select("host", F.col("v").alias("all_v"), F.col("c").alias("all_c"))
    # Only what holds over half of either is a candidate: a few nested elements a host.
    most = within.join(whole, "host").where("2 * v > all_v OR 2 * (v + c) > all_v + all_c OR size(path) = 0").groupBy("host").agg(F.collect_list(F.struct("path", "v", "c")).alias("within"))
    kept = counts.where("slot >= 0").groupBy("host").agg(F.collect_list(F.struct("slot", "lo", "hi", "pages")).alias("slots"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, stream, within, slots in zip(*(batch.column(c).to_pylist() for c in ("host", "stream", "within", "slots"))):
                path, templated = container({tuple(w["path"]): [w["v"], w["c"]] for w in within or ()})
                wrapper, held = numbered(json.loads(stream)), {x["slot"]: x for x in slots or ()}
                for _, item in _texts(wrapper):
                    x = held.get(item[4][0])
                    item[1], item[3] = (x["lo"] if x["lo"] == x["hi"] else None, x["pages"]) if x else (None, 0)
                yield pa.record_batch([pa.array([host]), pa.array([json.dumps(wrapper, ensure_ascii=False)]), pa.array([json.dumps(path, ensure_ascii=False)]), pa.array([templated]), pa.array([list(path)], pa.list_(pa.string()))], names=["host", "wrapper", "content", "templated", "path"])

    found = wrappers.join(most, "host", "left").join(kept, "host", "left").select("host", "stream", "within", "slots")
    hosts = cut(found.mapInArrow(finish, "host string, wrapper string, content string, templated boolean, path array<string>"))
    rest = counts.where(f"slot < 0 AND lo = hi AND pages >= {LEAST_PAGES}").join(hosts.where("templated").select("host", F.col("path").alias("content_path")), "host").where(F.slice("path", 1, F.size("content_path")) == F.col("content_path"))
    return hosts.select("host", "wrapper", "content", "templated", F.lit(None).cast("string").alias("rest")).union(
        rest.select("host", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.concat_ws("\n", "path", F.col("k").cast("string")))
    )


def _rest(path: tuple[str, ...], k: int) -> str:
    """The name of a slot that a wrapper has no room for."""
    return "\n".join([*path, str(k)])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper and content (JSON: the wrapper, and the path of its container), templated; one row a host. Rows with rest besides, each a constant slot that the host's wrapper has no room for."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            held: dict[str, list] = {}
            lost: dict[str, list] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                of_host = lost.setdefault(host, [])
                stream = bounded(stream_of(lines(page or "")), lost=of_host)
                held[host] = align(held[host], stream, of_host) if host in held else stream
            yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array([json.dumps(w, ensure_ascii=False) for w in held.values()], pa.string()), pa.array([bool(lost[h]) for h in held], pa.bool_())], names=["host", "stream", "short"])

    schema = "host string, stream string, short boolean"
    own = pages.select(host_of(F.col("url")).alias("host"), "html")
    state = cut(own.mapInArrow(streams, schema))
    while True:
        # Streams of a host go to as many groups as keep each near GROUP_STREAMS.
        sizes = state.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        grouped = state.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("stream", F.monotonically_increasing_id()), F.ceil(F.col("n") / GROUP_STREAMS)))
        state = cut(grouped.groupBy("host", "part").applyInArrow(_merge_streams, schema))
        most, short = state.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max("short").alias("short")).agg(F.max("n"), F.max("short")).first()
        if most is None or most == 1:
            break

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [content_path(json.loads(w)) for w in batch.column("stream").to_pylist()]
            yield pa.record_batch([batch.column("host"), batch.column("stream"), pa.array([json.dumps(path, ensure_ascii=False) for path, _ in found], pa.string()), pa.array([any_ for _, any_ in found], pa.bool_())], names=["host", "wrapper", "content", "templated"])

    whole = state.where("NOT short").mapInArrow(finish, "host string, wrapper string, content string, templated boolean").withColumn("rest", F.lit(None).cast("string"))
    return whole.union(_counted(own, state.where("short").select("host", "stream"))) if short else whole


@lru_cache(maxsize=1_000)
def _loaded(text: str | None) -> list | None:
    return json.loads(text) if text else None


@lru_cache(maxsize=1_000)
def _numbered(text: str) -> list:
    return numbered(json.loads(text))


def _rest_blocks(own: DataFrame, wrappers: DataFrame, size: int) -> DataFrame:
    """host, page (a digest of its html) and also, the numbers of the page's blocks that stand at constant slots for which its host's wrapper has no room."""
    rest = wrappers.where("rest IS NOT NULL").select("host", "rest")
    hosts = wrappers.where("rest IS NULL").join(rest.select("host").distinct(), "host", "left_semi").select("host", "content", "wrapper")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out: list[tuple] = []
            for host, page, html, content, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html", "content", "wrapper"))):
                inside = tuple(_loaded(content))
                out += [(host, page, _rest(path, k), item[4]) for number, path, k, item in placed(_numbered(wrapper), stream_of(lines(html or ""))) if number < 0 and path[: len(inside)] == inside]
            columns = [*zip(*out)] or ((),) * 4
            yield pa.record_batch([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.list_(pa.int32()))], names=["host", "page", "rest", "blocks"])

    found = _met(own, hosts, size, "inner").select("host", "page", "html", "content", "wrapper").mapInArrow(slots, "host string, page string, rest string, blocks array<int>")
    dealt = found.withColumn("share", F.pmod(F.xxhash64("page"), F.lit(SHARES)).cast("int"))
    copies = rest.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return dealt.join(copies, ["host", "rest", "share"]).groupBy("host", "page").agg(F.flatten(F.collect_set("blocks")).alias("also"))


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars; one row a page."""
    wrappers = infer_wrappers(pages) if wrappers is None else wrappers
    # Only wrappers with constants of a template are sent; of the others the container is enough.
    wrappers = cut(wrappers.select("host", "content", F.when(F.col("templated"), F.col("wrapper")).alias("wrapper"), "rest"))
    size, n_rest = wrappers.agg(F.sum(F.length("content") + F.length("host") + F.coalesce(F.length("wrapper"), F.lit(0))), F.count("rest")).first()
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if n_rest:
        own = own.withColumn("page", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
        own = own.join(_rest_blocks(own, wrappers, size), ["host", "page"], "left")
    else:
        own = own.withColumn("also", F.lit(None).cast("array<int>"))
    joined = _met(own, wrappers.where("rest IS NULL").drop("rest"), size or 0, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = [main_text(page or "", tuple(_loaded(content) or ()), _loaded(wrapper), also or ()) for page, content, wrapper, also in zip(*(batch.column(c).to_pylist() for c in ("html", "content", "wrapper", "also")))]
            yield pa.record_batch([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "content", "wrapper", "also").mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
