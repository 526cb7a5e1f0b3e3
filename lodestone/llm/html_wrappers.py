"""HTML extraction (6): union-free wrapper inference over same-host pages.

A page is a stream of blocks, each with the path of its open elements and a text. Neighbouring blocks of one path fold
into a repeated slot, and sequences that recur fold into a repeated group. Streams of one host are aligned one after the
other: what matches stays, a path that only one side has becomes optional, repetition counts widen, and a text that
differs becomes a slot while one that never differs stays template. The result is a regular expression without unions,
`item | item? | item+ | (group)+`. Its slots say in which container the host's pages vary, so where the article is. Every
page is aligned with its host's wrapper again, and each block is weighed: slot or template at its place, inside or outside the container, and marks,
elements and class words as evidence beside it. Wrappers are merged from partial ones, so a host of any size is no single task's.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

# Fixed values of the language: elements by their part in block structure.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
RAW = "script|style|noscript|template|iframe|textarea|svg|title"
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
# What isn't the article, by element and by words of class, id and role.
BOILER = frozenset("head nav footer aside form button select option datalist dialog menu object canvas audio video map".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations comment comments commentlist reply replies respond disqus footer pagination pager "
    "widget login search toolbar copyright skip complementary contentinfo hidden".split()
)
HEAD_WORDS = frozenset(("header", "masthead"))
ARTICLE = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset(("article", "main", "articlebody"))

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
MOST_GROUP = 6
# Elements that hold text of an article themselves, rather than a part of the page.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hr address details summary".split())
#: A text of as many different pages or more, alike on all of them, is template.
LEAST_PAGES = 3


def words_of(attrs: str) -> tuple[str, frozenset]:
    """(first class, words of class, id, role and itemprop)."""
    first, found = "", set()
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            found.add("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            found.update(w.lower() for w in WORDS.findall(value))
            if name == "itemprop":
                found.add(value.lower())
            if name == "class" and value.split():
                first = value.split()[0]
    return first, frozenset(found)


class Block(NamedTuple):
    """A text with the path of its open elements; depths count the elements of the path down to the one that gives evidence, 0 for none."""

    path: str
    element: int  # the outermost boilerplate element
    box: int  # the innermost part of the page with a boilerplate word
    word: bool  # the text's own element has a boilerplate word
    mark: int  # the innermost element that is marked as article
    links: bool  # all of the text is links
    text: str


class Open(NamedTuple):
    name: str
    path: str
    depth: int
    element: int
    box: int
    word: bool
    mark: int


TOP = Open("", "", 0, 0, 0, False, 0)


def blocks_of(page: str) -> list[Block]:
    """Every block in page order."""
    out: list[Block] = []
    stack: list[Open] = []
    text: list[str] = []
    plain = False  # some of the text isn't a link

    def add(piece: str) -> None:
        nonlocal plain
        text.append(piece)
        plain = plain or not any(s.name == "a" for s in reversed(stack)) and not piece.isspace()

    def flush() -> None:
        nonlocal plain
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                own = next((s for s in reversed(stack) if s.name not in INLINE), TOP)
                top = stack[-1] if stack else TOP
                out.append(Block(own.path, top.element, top.box, top.word, own.mark, not plain, whole))
            text.clear()
        plain = False

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"] and m["raw"].lower() in ("title", "textarea"):
                text.append(" ")
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    if name not in INLINE or all(s.name in INLINE for s in stack[i:]):
                        del stack[i:]
                    break
            continue
        if name == "br":
            text.append(" ")
        if name in VOID:
            continue
        if name not in INLINE:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == "p":
                    del stack[i:]
                    break
                if stack[i].name not in INLINE:
                    break
        for i in range(len(stack) - 1, -1, -1) if name in CLOSES else ():
            if stack[i].name in SCOPE[name]:
                break
            if stack[i].name in CLOSES[name]:
                del stack[i:]
        up = stack[-1] if stack else TOP
        first, found = words_of(m["attrs"]) if m["attrs"] else ("", frozenset())
        if name == "html" or name == "body":
            found = frozenset()
        depth = up.depth + (name not in INLINE)
        mark = depth if name in ARTICLE or found & ARTICLE_WORDS else up.mark
        element = up.element or (depth if name in BOILER or not mark and (name == "header" or found & HEAD_WORDS) else 0)
        word = bool(found & BOILER_WORDS)
        box = depth if word and name not in TEXT and name not in INLINE else up.box
        path = up.path if name in INLINE else f"{up.path}/{name}" + (f".{first}" if first else "")
        stack.append(Open(name, path, depth, element, box, word and box != depth or up.word, mark))
    if at < len(page):
        add(page[at:])
    flush()
    return out


# --- wrappers -----------------------------------------------------------------------------------------
# An item is [path or list of items, least, most, pages, text code or None for a slot, chars, [element, links, mark]], the last as of a Block.


def fold_runs(blocks: list[Block]) -> list[list]:
    items: list[list] = []
    for path, element, _box, _word, mark, links, text in blocks:
        if items and items[-1][0] == path:
            last = items[-1]
            last[1] += 1
            last[2] += 1
            last[4] = zlib.crc32(text.encode(), last[4])
            last[5] += len(text)
            last[6] = [min(last[6][0], element), min(last[6][1], int(links)), min(last[6][2], mark)]
        else:
            items.append([path, 1, 1, 1, zlib.crc32(text.encode()), len(text), [element, int(links), mark]])
    return fold_groups(items)


def fold_groups(items: list[list]) -> list[list]:
    """Folds sequences of two to MOST_GROUP items that follow themselves into one repeated group."""
    out: list[list] = []
    at = 0
    while at < len(items):
        for size in range(2, MOST_GROUP + 1):
            shape = [x[0] for x in items[at : at + size]]
            times = 1
            while len(shape) == size and [x[0] for x in items[at + times * size : at + (times + 1) * size]] == shape:
                times += 1
            if times > 1:
                own = items[at : at + size]
                for k in range(1, times):
                    own = [widen(a, b) for a, b in zip(own, items[at + k * size : at + (k + 1) * size], strict=True)]
                for x in own:
                    x[3] = 1
                out.append([own, times, times, 1, None, sum(x[5] for x in own), own[0][6]])
                at += times * size
                break
        else:
            out.append(items[at])
            at += 1
    return out


def shape_of(item: list) -> object:
    return item[0] if isinstance(item[0], str) else tuple(shape_of(x) for x in item[0])


def widen(a: list, b: list) -> list:
    """One item that matches what either did."""
    inner = a[0] if isinstance(a[0], str) else [widen(x, y) for x, y in zip(a[0], b[0], strict=True)]
    return [inner, min(a[1], b[1]), max(a[2], b[2]), a[3] + b[3], a[4] if a[4] == b[4] else None, a[5] + b[5], [min(x, y) for x, y in zip(a[6], b[6], strict=True)]]


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of both: matching shapes widen, the rest becomes optional."""
    left, right = [shape_of(x) for x in a], [shape_of(x) for x in b]
    if left == right:
        return [widen(x, y) for x, y in zip(a, b, strict=True)]
    out: list[list] = []
    for tag, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if tag == "equal":
            out += [widen(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [[x[0], 0, *x[2:]] for x in a[i:j]] + [[x[0], 0, *x[2:]] for x in b[k:m]]
    return out


def expression(items: list[list]) -> str:
    """A wrapper as a regular expression: paths, `#text` for slots, quantifiers."""

    def one(x: list) -> str:
        inner = (x[0] + ("#text" if x[4] is None else "")) if isinstance(x[0], str) else f"({' '.join(map(one, x[0]))})"
        return inner + ({(0, 1): "?", (1, 1): ""}.get((x[1], x[2])) if x[2] < 2 else "*" if x[1] == 0 else "+")

    return " ".join(map(one, items))


def leaves(items: list[list]) -> Iterator[list]:
    for x in items:
        if isinstance(x[0], str):
            yield x
        else:
            yield from leaves(x[0])


def tag_of(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def parts_above(path: str) -> list[str]:
    """The parts of the page that hold a path, from the outermost; none of them is an element of text or below one."""
    out, at = [], 0
    while at != -1 and len(path) > 1:
        at = path.find("/", at + 1)
        own = path[:at] if at != -1 else path
        if tag_of(own) in TEXT:
            break
        out.append(own)
    return out


def within(path: str, part: str) -> bool:
    return not part or path == part or path.startswith(f"{part}/")


def depth_of(path: str) -> int:
    return path.count("/")


def is_template(x: list) -> bool:
    return x[4] is not None and x[3] >= LEAST_PAGES


class Rules(NamedTuple):
    items: list
    shapes: list
    core: str  # the deepest part that holds four fifths of the varying text
    container: str  # the same, or the marked element around it
    marked: bool  # the container is a list of marked elements: what isn't marked lies outside
    varying: frozenset  # paths that have a slot
    fixed: frozenset  # parts inside the container that hold template only


def rules_of_items(items: list[list]) -> Rules:
    every = list(leaves(items))
    used = [x for x in every if not is_template(x) and not x[6][0] and not x[6][1]] or [x for x in every if not is_template(x) and tag_of(x[0]) != "head"]
    mass: dict[str, int] = {}
    for x in used:
        for part in parts_above(x[0]):
            mass[part] = mass.get(part, 0) + x[5]
    total = sum(x[5] for x in used)
    core = max((p for p, n in mass.items() if n >= 0.8 * total), key=depth_of, default="")
    marks: dict[str, int] = {}
    for x in used:
        if x[6][2]:
            own = "/".join(x[0].split("/")[: x[6][2] + 1])
            marks[own] = marks.get(own, 0) + x[5]
    around = max((p for p in marks if within(core, p)), key=depth_of, default="")
    container, marked = core, False
    if around and core:
        container = around
    elif sum(marks.values()) >= 0.8 * total and total:
        marked = True
    else:
        above = core.rpartition("/")[0]
        while depth_of(above) > 2 and all(not is_template(x) for x in every if within(x[0], above) and not x[6][0]):
            container = above  # a heading beside the text varies as the text does
            above = above.rpartition("/")[0]
    whole: dict[str, bool] = {}
    for x in every:
        for part in parts_above(x[0]):
            if within(part, container) and depth_of(part) > depth_of(container):
                whole[part] = whole.get(part, True) and is_template(x)
    return Rules(items, [shape_of(x) for x in items], core, container, marked, frozenset(x[0] for x in every if not is_template(x)), frozenset(p for p, t in whole.items() if t))


@lru_cache(maxsize=512)
def rules_of(wrapper: str) -> Rules:
    return rules_of_items(json.loads(wrapper))


def places_of(blocks: list[Block], items: list[list]) -> list[list[int]]:
    """The numbers of the blocks of each leaf of the items that fold_runs() made of them, in page order; a folded group has those of all its turns."""
    runs: list[list[int]] = []
    for i, b in enumerate(blocks):
        if runs and blocks[runs[-1][0]].path == b.path:
            runs[-1].append(i)
        else:
            runs.append([i])
    out, at = [], 0
    for x in items:
        if isinstance(x[0], str):
            out.append(runs[at])
            at += 1
        else:
            size = len(x[0])
            out += [[i for k in range(x[1]) for i in runs[at + k * size + j]] for j in range(size)]
            at += x[1] * size
    return out


def evidence(blocks: list[Block], rules: Rules) -> list[int]:
    """For each block 2 where the wrapper has a slot at its place, -2 where it has this very text as template, 0 where it can't tell."""
    out = [0] * len(blocks)
    items = fold_runs(blocks)
    numbers = iter(places_of(blocks, items))
    own = [[(x, next(numbers)) for x in leaves([item])] for item in items]
    for i, j, n in SequenceMatcher(None, [shape_of(x) for x in items], rules.shapes, autojunk=False).get_matching_blocks():
        for k in range(n):
            for (x, places), known in zip(own[i + k], leaves([rules.items[j + k]]), strict=True):
                said = 2 if known[4] is None else -2 if is_template(known) and known[4] == x[4] else 0
                for at in places:
                    out[at] = said
    return out


def weight(b: Block, said: int, rules: Rules) -> int:
    """Above 0 for a block of the article."""
    inside = within(b.path, rules.container) and (b.mark > 0 or not rules.marked)
    held = sum(within(rules.core, p) for p in parts_above(b.path))  # so many parts hold the core too: what they are called says nothing
    total = said + (2 if inside else -4)
    if b.element > held:
        total -= 6
    if b.box > held:
        total -= 4
    total -= b.word + 2 * b.links + 3 * (b.word and b.links)
    if not any(p in rules.fixed for p in parts_above(b.path)) and (tag_of(b.path) in TEXT or b.path in rules.varying):
        total += 1
    return total


def extract(page: str, wrapper: str | None) -> str:
    """The article's blocks, two line feeds between them."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    rules = rules_of(wrapper) if wrapper else rules_of_items(fold_runs(blocks))
    said = evidence(blocks, rules) if wrapper else [0] * len(blocks)
    kept = [b for b, n in zip(blocks, said, strict=True) if weight(b, n, rules) > 0]
    if not kept:  # a page unlike the others of its host: its own marks, then whatever isn't boilerplate
        clean = [(b, n) for b, n in zip(blocks, said, strict=True) if not b.element and not b.box]
        kept = [b for b, n in clean if b.mark and n >= 0] or [b for b, n in clean if n >= 0] or [b for b, _ in clean]
    return "\n\n".join(b.text for b in kept)


# --- DataFrames ---------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


WRAPPERS = "host string, wrapper string, pages long"
#: A host's pages are merged in so many shares at most, each by its own task, then the shares.
SHARES = 256
#: A task forgets its pages after so many; this only saves shuffling copies.
MOST_SEEN = 200_000


def _merged(rows: Iterator[tuple], width: int) -> Iterator[pa.RecordBatch]:
    """Merges rows of (*key, items, pages) that are sorted by key; the key's first column is the host. A key is given out when it is complete."""
    key, items, n, out = None, [], 0, []

    def give() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], ["host", "wrapper", "pages"])
        out.clear()
        return made

    for row in rows:
        if row[:width] == key:
            items, n = align(items, row[width]), n + row[width + 1]
            continue
        if key is not None:
            out.append((key[0], json.dumps(items, separators=(",", ":")), n))
        if len(out) >= 256:
            yield give()
        key, items, n = row[:width], row[width], row[width + 1]
    if key is not None:
        out.append((key[0], json.dumps(items, separators=(",", ":")), n))
        yield give()


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, pages): one wrapper per host over all its different pages (copies teach nothing about what varies).

    Pages are the same if host and all blocks are. Shares of a host's pages, by the hash of the blocks, are merged in the order of
    the hashes, then the shares are: what comes out depends on the pages alone, not on how files or tasks divide them.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                out = []
                for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    blocks = blocks_of(page or "")
                    code = hashlib.md5(json.dumps(blocks).encode()).hexdigest()
                    if blocks and (host, code) not in seen:
                        if len(seen) >= MOST_SEEN:
                            seen.clear()
                        seen.add((host, code))
                        out.append((host, int(code[:8], 16) % SHARES, code, json.dumps(fold_runs(blocks), separators=(",", ":"))))
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["host", "share", "code", "items"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last = None
            for batch in batches:
                for host, share, code, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (host, code) != last:
                        yield host, share, json.loads(items), 1
                    last = (host, code)

        yield from _merged(rows(), 2)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for host, wrapper, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield host, json.loads(wrapper), n

        yield from _merged(rows(), 1)

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    parsed = map_arrow(rows, parse, "host string, share int, code string, items string")
    shares = map_arrow(parsed.repartition("host", "share").sortWithinPartitions("host", "share", "code"), partial, WRAPPERS)
    return map_arrow(shares.repartition("host").sortWithinPartitions("host", "wrapper"), merge, WRAPPERS)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page: the article of the whole html.

    Null and empty html give an empty text, as does a page that is boilerplate all through. Pages without a host
    share a wrapper. Repeated rows each have a row; an empty table gives no rows; further columns aren't read.
    Wrappers are broadcast while they are small (measured: 8 MB); else those of hosts with 1/256 of all different pages or more are, which are
    256 at most, and the rest is joined by host.
    """
    wrappers = materialize(infer_wrappers(pages, url_col, html_col), "wrappers")
    kind = pages.schema[id_col].dataType.simpleString()
    size, total = wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0))).first()
    every = wrappers.select("host", "wrapper")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    if size < 8 << 20:
        rows = rows.join(F.broadcast(every), "host", "left").select("id", "url", "html", "wrapper")
    else:
        large = F.broadcast(wrappers.where(F.col("pages") * 256 >= total).select("host", "wrapper"))
        rest = rows.join(large, "host", "left_anti").join(every, "host", "left")
        rows = rows.join(large, "host").select("id", "url", "html", "wrapper").unionByName(rest.select("id", "url", "html", "wrapper"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = [extract(p, w) if p else "" for p, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    done = map_arrow(rows, run, f"id {kind}, url string, text string")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
