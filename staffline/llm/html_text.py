"""Main text of web pages by wrappers that are inferred from the pages of a host.

A page becomes a tree of block elements and text slots; names are the tag with its classes
and id, numbers in them masked. The trees of a host are folded into a wrapper, a regular
expression without unions: two trees are aligned child by child, equal names are merged
recursively, what has no partner becomes optional, neighbours of equal name (or equal
runs of up to ``PERIOD`` names) become a repeated group, and texts become slots. This is
done pair by pair until one wrapper is left. Pages with equal trees are counted first, and
a host with many different trees is folded in parts of at most ``PART`` trees, round after
round, so that a host with a third of all pages costs no more than its different trees.

The wrapper's slots have figures, summed over all pages of the host: characters,
characters in links, whether the text is always the same. The main region is found by
descending from the root as long as one child holds most of the varying text outside
links; an ``article`` or ``main`` on the way ends the descent. A page gives the texts of
its blocks in the wrapper's main region, without elements that are boilerplate by tag or
by name. A page that lacks the region gets the same rule on its own figures.

A name only marks an element as boilerplate; the host's figures decide whether the mark
stands (``lifted``). It does not for an element around most of the varying text or around
the article, nor for varying text of an article under a word that also names layouts or
topics (``LAYOUT_NAMES``).

Text: character references are decoded, white space inside a block becomes one space, and
blocks are joined by line feeds. Line breaks are white space. Unclosed elements are closed
by what follows; an element nested deeper than ``DEPTH`` counts as part of the one at that
level, its text stays; comments, scripts, styles, forms and the like are left out with all they
hold, formulas and fallback text are not; cut-off tags at the end are ignored.

Nulls: a null or blank page gives an empty text; a null url is a host of its own. Repeated
rows are extracted each. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import html as references
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.session import staged

PERIOD = 4
PART = 256
#: Levels of a path. What is nested deeper counts as part of the element at this level.
DEPTH = 100
#: A child must hold this part of its parent's varying text for the descent to go on.
MOST = 0.7

#: HTML's element kinds.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes template xmp svg select button".split())
DROPPED_TAGS = frozenset("head nav footer aside form menu dialog fieldset".split())
#: Words in classes, ids and roles that mark boilerplate.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets header masthead topbar footer bottombar "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations newsletter subscribe "
    "signup login search pagination pager toolbar skip complementary contentinfo".split())
#: Those of them that are names of layouts and topics as well.
LAYOUT_NAMES = frozenset(
    "ad ads sponsor sponsored promotion banner notice notices alert modal overlay nav navbar navigation menu sidebar aside widget widgets header masthead "
    "topbar footer bottombar discussion share sharing social related recommended search skip".split())
#: Attributes that name an element, and their signs in its name.
NAMING = {"class": ".", "id": "#", "role": "@"}
#: Ends of names: a mark, and a mark by a layout name.
MARK, LAYOUT_MARK = "!", "!?"
CLOSED_BY: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})), "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}
#: Prefixes of classes that speak of something elsewhere on the page.
ABOUT_OTHERS = frozenset("with without has have no not is".split())
REGIONS = frozenset({"article", "main"})
CONTAINERS = REGIONS | frozenset("html body div section center table tbody tr td".split())
RUNNING_TEXT = frozenset("p h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|[/!?a-zA-Z][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME_WORD = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A block's text or, if it holds marked inline elements, a part of it, and where it
    stands: the names from the root on."""

    path: tuple[str, ...]
    text: str
    link_chars: int
    line: int
    raw: str


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    tree: list = field(default_factory=list)


def _name(tag: str, attributes: str) -> tuple[str, bool]:
    """The element's name, with a mark if its words are boilerplate's, and whether it is
    boilerplate by tag."""
    dropped, marks = tag in DROPPED_TAGS or tag == "header", set()
    name = tag
    for kind, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        kind, value = kind.lower(), (a or b or c).lower()
        if kind not in NAMING:
            continue
        if tag not in ("html", "body", "main", "article"):
            for one in value.split():
                words = _NAME_WORD.findall(one)
                if words and words[0] not in ABOUT_OTHERS:
                    marks |= DROPPED_NAMES.intersection(words)
        name += NAMING[kind] + re.sub(r"\d+", "0", " ".join(sorted(value.split())))
    if marks:
        name += LAYOUT_MARK if marks <= LAYOUT_NAMES else MARK
    return name, dropped


def parse(source: str) -> Page:
    """Blocks outside elements that are boilerplate by tag, and the tree of all block elements
    and marked inline ones."""
    page = Page()
    # Open elements: tag, path, children (None for an inline element that is left out),
    # inside boilerplate. A marked inline element has the children of its block.
    stack: list[tuple[str, tuple[str, ...], list | None, bool]] = [("", (), page.tree, False)]
    # Text, its path, characters in links.
    texts: list[tuple[str, tuple[str, ...], int]] = []
    in_link, line = False, 0

    def flush() -> None:
        nonlocal line
        line += 1
        if texts:
            _, path, children, dropped = next(x for x in reversed(stack) if x[2] is not None and (x[0] in BLOCKS or not x[0]))
            for own, parts in itertools.groupby(texts, lambda x: x[1]):
                parts = list(parts)
                raw = references.unescape("".join(x[0] for x in parts))
                text = _SPACE.sub(" ", raw).strip()
                if text:
                    into = children
                    for name in own[len(path):]:
                        into.append([name, "1", []])
                        into = into[-1][2]
                    if not into or into[-1][0] != "#":
                        into.append(["#", "1", []])
                if not dropped and raw:
                    page.blocks.append(Block(own, text, min(sum(x[2] for x in parts), len(text)), line, raw))
            texts.clear()

    def close(at: int) -> None:
        flush()
        del stack[at:]

    at, end = 0, len(source)
    while at < end:
        m = _TAG.search(source, at)
        stop = m.start() if m else end
        if stop > at and stack[-1][2] is not None and not (len(stack) == 1 and source[at:stop].isspace()):
            texts.append((source[at:stop], stack[-1][1], stop - at if in_link else 0))
        if not m:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag in BLOCKS:
                        close(i)
                    else:
                        del stack[i:]
                    break
            if tag == "a":
                in_link = False
            continue
        if tag in RAW:
            ends = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            shown = references.escape(source[at : ends.start() if ends else end]) if tag == "xmp" and stack[-1][2] is not None else ""
            at = ends.end() if ends else end
            texts.append((f" {shown} ", stack[-1][1], 0))
            continue
        if tag == "br":
            texts.append((" ", stack[-1][1], 0))
            continue
        if tag == "a":
            in_link = True
        name, dropped = _name(tag, m[3])
        if tag not in BLOCKS:
            if tag not in VOID and not m[3].endswith("/"):
                if dropped:
                    stack.append((tag, stack[-1][1], None, True))
                elif name.endswith((MARK, LAYOUT_MARK)):
                    stack.append((tag, (*stack[-1][1], name)[:DEPTH], stack[-1][2], stack[-1][3]))
            continue
        flush()
        in_link = False
        for i in range(len(stack) - 1, 0, -1):
            open_tag = stack[i][0]
            if open_tag == "p":
                close(i)
                break
            if open_tag in ("td", "th", "table", "li", "body", "article", "section", "div"):
                break
        if tag in CLOSED_BY:
            closes, scope = CLOSED_BY[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in scope:
                    break
                if stack[i][0] in closes:
                    del stack[i:]
                    if tag != "tr":
                        break
        if tag == "hr":
            continue
        children = next(x for x in reversed(stack) if x[2] is not None)[2]
        if len(stack[-1][1]) < DEPTH:
            children.append([name, "1", own := []])
            children = own
        stack.append((tag, (*stack[-1][1], name)[:DEPTH], children, stack[-1][3] or dropped))
    flush()
    return page


# --- Wrappers: lists of [name, quantity, children]; "#" is a slot, "()" a group.


def _joined(p: str, q: str, more: bool = False) -> str:
    optional = p in "?*" or q in "?*"
    many = more or p in "+*" or q in "+*"
    return {(False, False): "1", (True, False): "?", (False, True): "+", (True, True): "*"}[optional, many]


def _alike(x: list, y: list) -> bool:
    return x[0] == y[0] and (x[0] != "()" or [c[0] for c in x[2]] == [c[0] for c in y[2]])


def _merged(x: list, y: list, more: bool = False) -> list:
    return [x[0], _joined(x[1], y[1], more), align(x[2], y[2])]


def fold(items: list) -> list:
    """Neighbours of equal name become one repeated item, equal runs a repeated group."""
    out: list = []
    for item in ([n, q, fold(c)] for n, q, c in items):
        if out and _alike(out[-1], item):
            out[-1] = _merged(out[-1], item, more=item[0] != "#")
        else:
            out.append(item)
    for size in range(2, PERIOD + 1):
        at = 0
        while at + 2 * size <= len(out):
            run, then = out[at : at + size], out[at + size : at + 2 * size]
            if all(map(_alike, run, then)):
                out[at : at + 2 * size] = [["()", "+", [_merged(x, y) for x, y in zip(run, then, strict=True)]]]
                while at + 1 + size <= len(out) and all(map(_alike, out[at][2], out[at + 1 : at + 1 + size])):
                    out[at][2] = [_merged(x, y) for x, y in zip(out[at][2], out[at + 1 : at + 1 + size], strict=True)]
                    del out[at + 1 : at + 1 + size]
            at += 1
    return out


def align(a: list, b: list) -> list:
    """One expression for both: a longest common sequence of names is merged, the rest is
    optional."""
    if [x[0] for x in a] == [y[0] for y in b] and all(map(_alike, a, b)):
        return [_merged(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _alike(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out: list = []
    i = j = 0
    optional = lambda x: [x[0], _joined(x[1], "?"), x[2]]
    while i < n or j < m:
        if i < n and j < m and _alike(a[i], b[j]) and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(_merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return fold(out)


def written(items: list) -> str:
    """The wrapper as an expression, for people."""
    def one(item: list) -> str:
        name, quantity, children = item
        inner = " ".join(map(one, children))
        body = "#text" if name == "#" else f"({inner})" if name == "()" else f"<{name}>{inner}</>"
        return body + ("" if quantity == "1" else quantity)

    return " ".join(map(one, items))


def paths(items: list, above: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    """The paths of all slots."""
    for name, _, children in items:
        if name == "#":
            yield above
        else:
            yield from paths(children, above if name == "()" else (*above, name))


# --- The main region.


def main_region(figures: Iterable[tuple[tuple[str, ...], float]]) -> tuple[str, ...]:
    """``figures``: path and weight of each slot."""
    weights: dict[tuple[str, ...], float] = {}
    for path, weight in figures:
        for depth in range(len(path) + 1):
            weights[path[:depth]] = weights.get(path[:depth], 0) + weight
    region: tuple[str, ...] = ()
    tag = lambda path: re.split(r"[.#@]", path[-1])[0]
    while weights.get(region, 0) > 0:
        children = [p for p in weights if len(p) == len(region) + 1 and p[: len(region)] == region]
        best = max(children, key=lambda p: (weights[p], p), default=None)
        if best is None or weights[best] < MOST * weights[region] or tag(best) not in CONTAINERS:
            break
        # Headings and paragraphs beside the best child belong to the text as well.
        if any(tag(p) in RUNNING_TEXT and weights[p] > 0 for p in children):
            break
        region = best
        if tag(region) in REGIONS:
            break
    return region


def weight_of(chars: int, link_chars: int, constant: bool) -> float:
    """Text that varies counts; links and texts that never change hardly do."""
    return max(chars - 2 * link_chars, 0) * (0.1 if constant else 1.0)


def marks_of(path: tuple[str, ...]) -> list[tuple[str, ...]]:
    return [path[: i + 1] for i, name in enumerate(path) if name.endswith((MARK, LAYOUT_MARK))]


def lifted(figures: list[tuple[tuple[str, ...], int, float]]) -> set[tuple[str, ...]]:
    """The marked elements that are no boilerplate. ``figures``: path, characters and weight
    of each slot.

    A mark is lifted if no article or main element elsewhere has unmarked text, and the
    element holds ``MOST`` of all weight or, under a layout name, an article or main; and,
    under a layout name inside an article or main, if half of its characters count."""
    out: set[tuple[str, ...]] = set()
    total = sum(weight for _, _, weight in figures)
    in_region = lambda names: any(re.split(r"[.#@]", n)[0] in REGIONS for n in names)
    for mark in sorted({m for path, _, _ in figures for m in marks_of(path)}, key=lambda m: (len(m), m)):
        if not out.issuperset(marks_of(mark[:-1])):
            continue
        n = len(mark)
        inside = [(path[n:], chars, weight) for path, chars, weight in figures if path[:n] == mark]
        weight, layout = sum(x[2] for x in inside), mark[-1].endswith(LAYOUT_MARK)

        def beside(path: tuple[str, ...]) -> bool:
            shared = next((i for i, (x, y) in enumerate(zip(path, mark)) if x != y), min(len(path), n))
            return path[:n] != mark and in_region(path[shared:]) and out.issuperset(marks_of(path))

        if not any(w > 0 and beside(path) for path, _, w in figures):
            if 0 < weight >= MOST * total or (layout and weight > 0 and any(in_region(below) for below, _, _ in inside)):
                out.add(mark)
        if layout and in_region(mark[:-1]) and 0 < 2 * weight >= sum(x[1] for x in inside):
            out.add(mark)
    return out


def unmarked(path: tuple[str, ...], kept: set[tuple[str, ...]]) -> bool:
    return kept.issuperset(marks_of(path))


def main_text(page: Page, region: tuple[str, ...] | None, kept: Iterable[tuple[str, ...]] = ()) -> str:
    kept = set(kept)
    blocks = [b for b in page.blocks if unmarked(b.path, kept)]
    if region is None or not any(b.text and b.path[: len(region)] == region for b in blocks):
        figures = [(b.path, len(b.text), weight_of(len(b.text), b.link_chars, False)) for b in page.blocks]
        kept = lifted(figures)
        blocks = [b for b in page.blocks if unmarked(b.path, kept)]
        region = main_region((path, weight) for path, _, weight in figures if unmarked(path, kept))
    inside = (b for b in blocks if b.path[: len(region)] == region)
    lines = (_SPACE.sub(" ", "".join(b.raw for b in parts)).strip() for _, parts in itertools.groupby(inside, lambda b: b.line))
    return "\n".join(filter(None, lines))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _analysed(pages: DataFrame) -> DataFrame:
    """Per page: host, tree, and the figures of its slots."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for host, source in zip(frame["host"], frame["html"], strict=True):
                page = parse(source or "")
                slots: dict[tuple[str, ...], list] = {}
                for b in page.blocks:
                    if not b.text:
                        continue
                    slot = slots.setdefault(b.path, [0, 0, []])
                    slot[0] += len(b.text)
                    slot[1] += b.link_chars
                    slot[2].append(b.text)
                figures = [(json.dumps(p), c, n, str(hash_of(t))) for p, (c, n, t) in slots.items()]
                rows.append((host, json.dumps(fold(page.tree)), figures))
            yield pd.DataFrame(rows, columns=["host", "tree", "slots"])

    return pages.select("host", "html").mapInPandas(
        run, "host string, tree string, slots array<struct<path:string,chars:bigint,links:bigint,text:string>>")


def hash_of(texts: list[str]) -> int:
    import zlib

    return zlib.crc32("\n".join(texts).encode())


def _folded(group: pd.DataFrame) -> pd.DataFrame:
    whole: list | None = None
    for tree in sorted(group["tree"]):
        whole = json.loads(tree) if whole is None else align(whole, json.loads(tree))
    return pd.DataFrame({"host": [group["host"].iloc[0]], "tree": [json.dumps(whole or [])]})


def wrappers(pages: DataFrame) -> DataFrame:
    """``pages``: host, html. Per host: the wrapper, its main region and the marks that are
    lifted, as JSON."""
    analysed = staged(_analysed(pages))
    trees = staged(analysed.select("host", "tree").distinct())
    while True:
        most = trees.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        parts = -(-most // PART)
        salted = trees.withColumn("part", F.pmod(F.xxhash64("tree"), F.lit(max(parts, 1))))
        trees = staged(salted.groupBy("host", "part").applyInPandas(_folded, "host string, tree string").distinct())
        if parts <= 1:
            break
    slots = analysed.select("host", F.explode("slots").alias("s")).groupBy("host", "s.path").agg(
        F.sum("s.chars").alias("chars"), F.sum("s.links").alias("links"), F.count("*").alias("n"),
        (F.min("s.text") == F.max("s.text")).alias("same"))

    def decide(tree: pd.DataFrame, figures: pd.DataFrame) -> pd.DataFrame:
        if not len(tree):
            return pd.DataFrame({"host": [], "wrapper": [], "region": [], "kept": []})
        wrapper = json.loads(tree["tree"].iloc[0])
        known = set(paths(wrapper))
        slots = [
            (path, chars, weight_of(chars, links, bool(same) and n > 1))
            for path, chars, links, n, same in zip(
                (tuple(json.loads(p)) for p in figures["path"]), figures["chars"], figures["links"], figures["n"], figures["same"], strict=True)
            if path in known]
        kept = lifted(slots)
        region = main_region((path, weight) for path, _, weight in slots if unmarked(path, kept))
        return pd.DataFrame({
            "host": [tree["host"].iloc[0]], "wrapper": [json.dumps(wrapper)], "region": [json.dumps(region)], "kept": [json.dumps(sorted(kept))]})

    return trees.groupBy("host").cogroup(slots.groupBy("host")).applyInPandas(
        decide, "host string, wrapper string, region string, kept string")


def main_texts(pages: DataFrame) -> DataFrame:
    """``pages``: page_id, url, html. Per row: page_id, url, text, n_chars."""
    plain = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    regions = staged(wrappers(plain)).select("host", "region", "kept")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            decided = {r: tuple(json.loads(r)) for r in frame["region"].dropna().unique()}
            lifts = {k: set(map(tuple, json.loads(k))) for k in frame["kept"].dropna().unique()}
            texts = [
                main_text(parse(h or ""), decided.get(r), lifts.get(k, ()))
                for h, r, k in zip(frame["html"], frame["region"], frame["kept"], strict=True)]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return plain.join(regions, "host", "left").select("page_id", "url", "html", "region", "kept").mapInPandas(
        run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")
