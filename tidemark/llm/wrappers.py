"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import json
import re
from collections.abc import Generator, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, stored

#: Pages of a host that must agree before a text inside its main part counts as template, and where it has no such part.
TEMPLATE_PAGES = 10
TEMPLATE_PAGES_ALONE = 3

# fixed values: element names by role, and the words of classes, ids and roles that mark what isn't main text
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
    tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes template svg math".split())
DROPPED = frozenset(
    """head nav header footer aside form menu dialog button select option input textarea label fieldset script style noscript
    iframe template svg math object canvas audio video map title""".split()
)
DROPPED_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot banner banners sponsor sponsored
    sponsors promo promotion promoted cookie cookies consent gdpr notice notices alert alerts warning comment comments
    commentlist disqus respond reply replies discussion sidebar sidebars menu menus nav navbar navigation breadcrumb
    breadcrumbs header footer masthead topbar toolbar related recommended recommendations share sharing social newsletter
    subscribe subscription signup login popup modal overlay widget widgets pagination pager skip copyright legal""".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_WORDS = frozenset("article articlebody content post story entry main maincontent body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
# an opening tag that ends an open element of the same group
CLOSES = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
SCOPES = frozenset("ul ol dl table article main section div body html td th nav aside header footer form blockquote".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_VALUE_OR_END = re.compile(r"=\s*([\"'])|>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ends: dict[str, re.Pattern] = {}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if "=" in text or "hidden" in text.lower() else {}


KEPT, SOFT, DROP = 0, 1, 2


def _element(name: str, attributes: str) -> tuple[str, int]:
    """Label of an element, and whether it is dropped with all it holds: always (``DROP``), or unless it holds most of a page or
    heads an article (``SOFT``). Digits in names count as variable parts."""
    kind = SOFT if name in ("form", "header") else DROP if name in DROPPED else KEPT
    if not attributes.strip():
        return name, kind
    held = _attributes(attributes)
    marks = [_CAMEL.sub(" ", held.get(k, "")) for k in ("class", "id")]
    words = [w for mark in marks for w in _WORDS.findall(mark.lower())]
    if name not in ("html", "body", "article", "main") and not DROPPED_WORDS.isdisjoint(words):
        if name in TEXTS:
            # one word among others doesn't make a paragraph something else
            kind = DROP if DROPPED_WORDS.issuperset(words) else kind
        else:
            kind = max(kind, DROP if CONTENT_WORDS.isdisjoint(words) else SOFT)
    if held.get("role", "").lower() in DROPPED_ROLES or "hidden" in held or held.get("aria-hidden", "").lower() == "true":
        kind = DROP
    if "display:none" in held.get("style", "").lower().replace(" ", ""):
        kind = DROP
    if held.get("role", "").lower() == "main" or held.get("itemprop", "").lower() == "articlebody":
        words.append("content")
    return ".".join([name, *sorted(set(words))]), kind


def _names_content(label: str) -> bool:
    name, *words = label.split(".")
    return name in CONTENT_TAGS or (name in ("div", "section", "td") and not CONTENT_WORDS.isdisjoint(words))


def _tag_end(html: str, at: int, unclosed: set[str]) -> int:
    """Where the tag whose attributes begin at ``at`` ends: its ``>``, or the end of the page. Quoted values are skipped whatever
    their length; a quote that is never closed counts as a sign like any other."""
    while (m := _VALUE_OR_END.search(html, at)) is not None:
        if m[1] is None:
            return m.start()
        stop = -1 if m[1] in unclosed else html.find(m[1], m.end())
        if stop < 0:
            unclosed.add(m[1])
        at = stop + 1 if stop >= 0 else m.end()
    return len(html)


def events(html: str) -> Iterator[tuple[str, str, int]]:
    """``open``/``close`` with a label and whether the element is dropped, and ``text``; every open element closes.

    Comments and declarations vanish, raw elements are skipped to their end, a line break is a blank, other void elements are
    nothing, and missing end tags are supplied the way browsers do for paragraphs, items, rows and cells.
    """
    stack: list[tuple[str, str, int]] = []
    depths: dict[str, list[int]] = {}  # where the elements of a name lie in the stack
    at, size = 0, len(html)
    unclosed: set[str] = set()

    def close(depth: int) -> Iterator[tuple[str, str, int]]:
        while len(stack) > depth:
            name, label, dropped = stack.pop()
            depths[name].pop()
            yield "close", label, dropped

    while at < size:
        m = _MARKUP.search(html, at)
        if m is None:
            yield "text", html[at:], KEPT
            break
        if m.start() > at:
            yield "text", html[at : m.start()], KEPT
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>").replace("&", "&amp;"), KEPT
            continue
        name = m[2].lower()
        end = _tag_end(html, at, unclosed)
        attributes, at = html[at:end], end + 1
        if m[1]:
            if depths.get(name):
                yield from close(depths[name][-1])
            continue
        label, dropped = _element(name, attributes)
        if name in VOID:
            if name in BLOCKS:
                yield "open", label, dropped
                yield "close", label, dropped
            elif name == "br":
                yield "text", " ", KEPT
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                stop = _ends.setdefault(name, re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I)).search(html, at)
                at = stop.end() if stop else size
            continue
        ends = CLOSES.get(name) or (frozenset({"p"}) if name in BLOCKS else frozenset())
        for i in range(len(stack) - 1 if ends else -1, -1, -1):
            if stack[i][0] in ends:
                yield from close(i)
                break
            if stack[i][0] in SCOPES:
                break
        depths.setdefault(name, []).append(len(stack))
        stack.append((name, label, dropped))
        yield "open", label, dropped
        if attributes.endswith("/") and name not in BLOCKS:
            yield from close(len(stack) - 1)
    yield from close(0)


def resolved(html: str) -> list[tuple[str, str, bool]]:
    """The events of a page, with each element either dropped or not.

    A form, a page header and an element named both as content and as something else stay if they hold more than half of
    the page's text; a header also stays in an article, whose title it holds.
    """
    found = list(events(html))
    held, path, hard, total = [0] * len(found), [], 0, 0
    soft: list[tuple[int, int]] = []
    inside = 0
    for i, (kind, value, dropped) in enumerate(found):
        if kind == "open":
            path.append(i)
            hard += dropped == DROP
            inside += _names_content(value)
            if dropped == SOFT:
                soft.append((i, inside - _names_content(value)))
        elif kind == "close":
            hard -= dropped == DROP
            inside -= _names_content(value)
            first = path.pop()
            if path:
                held[path[-1]] += held[first]
        elif not hard:
            n = len(_squeezed(value))
            total += n
            if path:
                held[path[-1]] += n
    stay = {i for i, content in soft if 2 * held[i] > total or (content and found[i][1].partition(".")[0] == "header")}
    out, opened = [], []
    for i, (kind, value, dropped) in enumerate(found):
        if kind == "open":
            opened.append(dropped == DROP or (dropped == SOFT and i not in stay))
            out.append((kind, value, opened[-1]))
        elif kind == "close":
            out.append((kind, value, opened.pop()))
        else:
            out.append((kind, value, False))
    return out


def _squeezed(text: str) -> str:
    return " ".join(unescape(text).split())


def _is_block(label: str) -> bool:
    name = label.partition(".")[0]
    return name in BLOCKS or name in CONTENT_TAGS


def _mixed(*parts: int | str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)))


def _squeezed_parts(parts: list[str]) -> str:
    return " ".join("".join(unescape(p) for p in parts).split())


# An expression is a list [label, quantifier, text, pages, chars, children, digests]: the quantifier is one of "1", "?", "+", "*";
# the text is a constant, None for a slot, or "" where there is none; chars counts the text that isn't dropped; the digests are
# those of all texts of the element that every page has, of each item where it is repeated, with the item's own chars.


def page_expression(html: str) -> list:
    """The expression of one page: its block structure, with runs of equal neighbours folded into repeats."""
    root = ["", "1", "", 1, 0, [], {}]
    path, drops, held = [root], 0, [[]]
    texts: list[list[str]] = [[]]
    digest = [0]

    def flush() -> None:
        text = _squeezed_parts(held[-1])
        held[-1].clear()
        if text:
            texts[-1].append(text)
            digest[-1] = _mixed(digest[-1], text)

    for kind, value, dropped in resolved(html):
        if kind == "text":
            held[-1].append(value)
            if not drops:
                path[-1][4] += len(_squeezed(value))
            continue
        block = _is_block(value)
        if block:
            flush()
        if kind == "open":
            drops += dropped
            if block:
                node = [value, "1", "", 1, 0, [], {}]
                path[-1][5].append(node)
                path.append(node)
                held.append([])
                texts.append([])
                digest.append(0)
        else:
            drops -= dropped
            if block and len(path) > 1:
                done = path.pop()
                held.pop()
                done[2] = " ".join(texts.pop())
                done[5] = folded(done[5])
                one = digest.pop()
                if one:
                    done[6][one] = done[4]
                    digest[-1] = _mixed(digest[-1], done[0], one)
    flush()
    root[2] = " ".join(texts[0])
    root[5] = folded(root[5])
    return root


def merged(a: list, b: list, same_page: bool = False) -> list:
    """The least expression that covers both: unequal texts become a slot, elements of one side become optional.

    Merging goes as deep as the pages do, so it keeps its own stack.
    """
    stack, value = [_merging(a, b, same_page)], None
    while stack:
        try:
            asked = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(_merging(*asked))
            value = None
    return value


def _merging(a: list, b: list, same_page: bool) -> Generator[tuple, list, list]:
    quantifier = "1?+*"[("?" in (x := a[1] + b[1]) or "*" in x) + 2 * ("+" in x or "*" in x)]
    text = a[2] if a[2] == b[2] else None
    digests = {**a[6], **b[6]} if same_page else {d: n for d, n in a[6].items() if d in b[6]}
    children = yield from _aligning(a[5], b[5], same_page)
    return [a[0], quantifier, text, max(a[3], b[3]) if same_page else a[3] + b[3], a[4] + b[4], children, digests]


def _aligning(a: list[list], b: list[list], same_page: bool) -> Generator[tuple, list, list]:
    """Align two sequences on a longest common subsequence of labels."""
    head = 0
    while head < len(a) and head < len(b) and a[head][0] == b[head][0]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail][0] == b[-1 - tail][0]:
        tail += 1
    out = []
    for x, y in zip(a[:head], b[:head]):
        out.append((yield x, y, same_page))
    u, v = a[head : len(a) - tail], b[head : len(b) - tail]
    best = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
    for i in range(len(u) - 1, -1, -1):
        for j in range(len(v) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if u[i][0] == v[j][0] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(u) or j < len(v):
        if i < len(u) and j < len(v) and u[i][0] == v[j][0]:
            out.append((yield u[i], v[j], same_page))
            i, j = i + 1, j + 1
        elif j == len(v) or i < len(u) and best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(u[i]))
            i += 1
        else:
            out.append(_optional(v[j]))
            j += 1
    for x, y in zip(a[len(a) - tail :], b[len(b) - tail :]):
        out.append((yield x, y, same_page))
    return (yield from _folding(out)) if u or v else out


def _optional(x: list) -> list:
    return [x[0], {"1": "?", "+": "*"}.get(x[1], x[1]), *x[2:]]


def _repeated(x: list) -> list:
    return [x[0], {"1": "+", "?": "*"}.get(x[1], x[1]), *x[2:]]


def _folding(nodes: list[list]) -> Generator[tuple, list, list]:
    out: list[list] = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            out[-1] = _repeated((yield out[-1], node, True))
        else:
            out.append(node)
        while len(out) > 3 and out[-1][0] == out[-3][0] and out[-2][0] == out[-4][0]:
            first, second = (yield out[-4], out[-2], True), (yield out[-3], out[-1], True)
            out[-4:] = [_repeated(first), _repeated(second)]
    return out


def folded(nodes: list[list]) -> list[list]:
    """Neighbours of one label become one repeated element, and so do repeated pairs of labels."""
    steps, value = _folding(nodes), None
    while True:
        try:
            asked = steps.send(value)
        except StopIteration as done:
            return done.value
        value = merged(*asked)


def packed_expression(x: list) -> str:
    """An expression as JSON without nesting: its elements in order, each with its depth."""
    out, stack = [], [(0, x)]
    while stack:
        depth, node = stack.pop()
        out.append([depth, *node[:5], list(node[6].items())])
        stack += [(depth + 1, y) for y in reversed(node[5])]
    return json.dumps(out)


def unpacked_expression(text: str) -> list:
    path: list[list] = []
    for depth, *node, digests in json.loads(text):
        made = [*node, [], dict(map(tuple, digests))]
        del path[depth:]
        if path:
            path[-1][5].append(made)
        path.append(made)
    return path[0]


def written(x: list) -> str:
    """An expression as text: ``#`` is a slot, a constant stands in quotes."""
    inner = ["#" if x[2] is None else json.dumps(x[2], ensure_ascii=False)] if x[2] != "" else []
    inner += [written(y) for y in x[5]]
    return f"{x[0]}({' '.join(inner)})" + (x[1] if x[1] != "1" else "")


def _elements(wrapper: list) -> list[tuple[list, int, int, int]]:
    """Elements in order: node, place of the parent, depth, and hash of the labels from the root."""
    out, stack = [], [(wrapper, -1, 0, _mixed(0, wrapper[0]))]
    while stack:
        node, parent, depth, path = stack.pop()
        at = len(out)
        out.append((node, parent, depth, path))
        stack += [(y, at, depth + 1, _mixed(path, y[0])) for y in reversed(node[5])]
    return out


def _content(elements: list[tuple], total: list[int]) -> tuple[int | None, int | None]:
    """Places of the element that holds the main text, and of the one inside it that holds most of that.

    Of those named as content the one with most text, if that is a good part of all; of nested ones the outermost.
    """
    named = [i for i, x in enumerate(elements) if _names_content(x[0][0])]
    tags = [i for i in named if elements[i][0][0].partition(".")[0] in CONTENT_TAGS and 5 * total[i] >= total[0]]
    found = tags or [i for i in named if 3 * total[i] >= total[0]]
    if not found or not total[0]:
        return None, None
    outer = max(found, key=lambda i: (total[i], -elements[i][2]))
    inner = None
    for i in named:
        up = i
        while up > outer:
            up = elements[up][1]
        if up == outer and i != outer and 2 * total[i] > total[outer]:
            inner = i
    return outer, inner


def rules_of(wrapper: list) -> str:
    """What a wrapper tells about its host's pages, as JSON: where the main text lies, and which elements are template.

    Template elements have the same texts on many pages of the host. In the main part that takes ``TEMPLATE_PAGES`` pages and a
    part of it that varies, and headings stay; where nothing is named as main part, the wrapper alone tells it from the rest: what is the
    same on ``TEMPLATE_PAGES_ALONE`` pages goes, if what varies is the larger part.
    """
    elements = _elements(wrapper)
    total = [x[0][4] for x in elements]
    heads = [x[0][0].partition(".")[0] in HEADINGS for x in elements]
    for i in range(len(elements) - 1, 0, -1):
        total[elements[i][1]] += total[i]
        heads[elements[i][1]] |= heads[i]
    outer, inner = _content(elements, total)
    pages = TEMPLATE_PAGES if outer is not None else TEMPLATE_PAGES_ALONE
    within, same, constant = [False] * len(elements), [], 0
    for i, (node, parent, _, path) in enumerate(elements):
        within[i] = i == outer or (parent >= 0 and within[parent])
        if (outer is None or within[i]) and node[3] >= pages:
            constant += sum(node[6].values()) * node[3]
            # an element that holds a heading is looked at part by part
            if i not in (outer, inner) and not heads[i]:
                same += [[path, digest] for digest in node[6]]
    varying = total[outer or 0] - constant
    if varying <= 0 or (outer is None and varying < constant):
        same = []
    return json.dumps([None if outer is None else elements[outer][3], None if inner is None else elements[inner][3], same])


def main_text(html: str, rules: str | None) -> str:
    """The blocks of a page's main text, one to a line."""
    outer, inner, same = json.loads(rules) if rules else (None, None, [])
    found = resolved(html)
    kept = _blocks(found, outer, inner, {(path, digest) for path, digest in same})
    if not kept and outer is not None:
        kept = _blocks(found, None, None, set())
    return "\n".join(kept)


def _digests(found: list[tuple[str, str, bool]]) -> dict[int, int]:
    """For each block of a page, by the place of its first event, the digest of all its texts, as in ``page_expression``."""
    out, path, digest, held = {}, [-1], [0], [[]]

    def flush() -> None:
        text = _squeezed_parts(held[-1])
        held[-1].clear()
        if text:
            digest[-1] = _mixed(digest[-1], text)

    for i, (kind, value, dropped) in enumerate(found):
        if kind == "text":
            held[-1].append(value)
            continue
        block = _is_block(value)
        if block:
            flush()
        if block and kind == "open":
            path.append(i)
            digest.append(0)
            held.append([])
        elif block and len(path) > 1:
            one = digest.pop()
            held.pop()
            out[path.pop()] = one
            digest[-1] = _mixed(digest[-1], value, one) if one else digest[-1]
    return out


def _blocks(found: list[tuple[str, str, bool]], outer: int | None, inner: int | None, same: set[tuple[int, int]]) -> list[str]:
    """Texts of the blocks in the outer element. Where an inner one holds most of it, what stands around that is kept before it, as
    titles and leads are, and after it only as plain paragraphs of the outer element itself."""
    digests = _digests(found) if same else {}
    out: list[str] = []
    held: list[str] = []
    path = [(_mixed(0, ""), "", outer is None, inner is None, False)]  # hash, label, in outer, in inner, right below outer
    drops, seen = 0, inner is None
    starts: list[int] = []

    def flush() -> None:
        if held:
            text = _squeezed_parts(held)
            held.clear()
            _, label, in_outer, in_inner, below = path[-1]
            around = not seen or (below and label.partition(".")[0] in TEXTS)
            if text and in_outer and (in_inner or around):
                out.append(text)

    for i, (kind, value, dropped) in enumerate(found):
        if kind == "text":
            if not drops:
                held.append(value)
            continue
        block = _is_block(value)
        if block:
            flush()
        if kind == "open":
            drops += dropped
            if block:
                up = path[-1]
                here = _mixed(up[0], value)
                drops += (here, digests.get(i)) in same
                path.append((here, value, up[2] or here == outer, up[3] or here == inner, up[0] == outer))
                seen = seen or path[-1][3]
                starts.append(i)
        else:
            drops -= dropped
            if block and len(path) > 1:
                here = path.pop()[0]
                drops -= (here, digests.get(starts.pop())) in same
    flush()
    return out


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, wrapper)``: for each host one expression that covers all its pages, as JSON.

    A task aligns its pages host by host and hands on one expression for each; these are aligned in a second step,
    one host after the other, so a host with a third of all pages costs one small row for each task.
    """

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = page_expression(page or "")
                held[host] = merged(held[host], one) if host in held else one
            if len(held) > 2000:
                yield _rows(held)
                held = {}
        yield _rows(held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, wrapper = None, None
        for batch in batches:
            for h, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h != host:
                    if wrapper is not None:
                        yield _rows({host: wrapper})
                    host, wrapper = h, unpacked_expression(w)
                else:
                    wrapper = merged(wrapper, unpacked_expression(w))
        if wrapper is not None:
            yield _rows({host: wrapper})

    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = map_arrow(pages.select(host_of(url).alias("host"), html), infer, "host string, wrapper string")
    return map_arrow(parts.repartition(n, "host").sortWithinPartitions("host", "wrapper"), join, "host string, wrapper string")


def _rows(held: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([packed_expression(w) for w in held.values()], pa.string())], ["host", "wrapper"])


def host_of(url: str):
    """The host part of an address in lower case; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` of every page.

    The text is the article without what its markup or its host's wrapper tells to be something else; see
    ``main_text``. Null and empty pages have an empty text, pages without an address share the host ``""``. Character
    references are decoded, white space inside a block becomes one space, blocks stand in page order with a line end
    between them. Repeated rows are extracted alike; other columns are not read.
    """
    kind = pages.schema[key].dataType.simpleString()

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rules_of(unpacked_expression(w)) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["host", "rules"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", r) for page, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["k", "u", "text"])

    hosts = stored(map_arrow(infer_wrappers(pages, url, html), rules, "host string, rules string"), "wrappers")
    joined = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"), host_of(url).alias("host")).join(hosts, "host", "left")
    out = map_arrow(joined.select("k", "u", "h", "rules"), extract, f"k {kind}, u string, text string")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))
