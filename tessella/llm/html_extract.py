"""Main text of web pages by wrappers inferred as union-free regular expressions.

A page becomes a stream of tags and texts, nested by its block elements.  A wrapper is such
a stream with quantifiers: a tag matched in every page stands plain, one that some pages
lack is optional, one that recurs at its level is a repeated group, and a text is a constant
while all pages agree on it and a slot once two differ.  Wrappers of one host are aligned
one after the other: at each level the longest common sequence of labels is kept, and every
mismatch is resolved into an optional group (found in one side only), a repeated group
(the same label again) or a text slot.  There are no unions.

Each map task folds its own pages into one wrapper a host and only those wrappers are
shuffled and aligned again: a hot host costs one small row a task.  Alignment is associative
in all that the result needs (labels, pages, slots and their mass, not the order of optional
groups), so how the pages are dealt changes nothing.

From the wrapper follow, per host:

* the main region: an article or main element if there is one, else the innermost element that
  holds most of the host's changing text; telling class words only settle ties;
* what goes within it: a text that is the same wherever it stands, and stands in most pages of
  a host whose text otherwise changes, unless the region is an article element;
* what stays though its class sounds like furniture: a block whose text changes from page to
  page, unless it is an advert, a comment or a teaser by name.

With a single page there is no evidence and names decide.

Fixed meaning of the result: blocks are the texts between block-level tags; references are
decoded once, white space in a block becomes one space, empty blocks vanish, blocks are
joined by two newlines.  Unclosed elements close where HTML closes them, or at the end of the
page.  Elements may be nested to any depth.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, small

MAX_BROADCAST_WRAPPERS = 20_000
NO_PLAN = "[[],[],[]]"
#: Fewest pages that can agree: one page tells nothing.
AGREEING = 2
_MASK = (1 << 62) - 1

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")

# Element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul button svg object".split())
CHROME_TAGS = frozenset("nav footer aside form menu dialog head button select option svg object script style textarea title noscript iframe template xmp noembed noframes fieldset search".split())
# Words of class, id and role that mark furniture, and those that mark the article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adslot sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup social share sharing sidebar side rail widget widgets related recommended recommendations menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies respond disqus discussion pagination pager popup modal overlay login search searchbox toolbar copyright legal skip complementary contentinfo paywall teaser".split()
)
#: Of these, the ones whose text changes from page to page although it is no part of the article.
CHANGING_WORDS = frozenset("ad ads advert adverts advertisement advertising adslot sponsor sponsored sponsors promo promotion promoted comment comments reply replies respond disqus discussion related recommended recommendations teaser login signup widget widgets breadcrumb breadcrumbs pagination pager".split())
HEADER_WORDS = frozenset("header".split())
MAIN_WORDS = frozenset("content article post entry story main body text".split())
#: Elements that a start tag closes when they are open (within the nearest container).
CLOSES = {
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}),
    "body": frozenset({"head"}),
}
CONTAINERS = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table", "tr"}), "th": frozenset({"table", "tr"}), "option": frozenset({"select"}), "body": frozenset()}


class Node:
    """A block element: label, whether it is furniture by name, and children (nodes or texts)."""

    __slots__ = ("tag", "label", "words", "items")

    def __init__(self, tag: str, label: str, words: frozenset[str]):
        self.tag, self.label, self.words, self.items = tag, label, words, []


def _label(tag: str, attrs: str) -> tuple[str, frozenset[str]]:
    if "=" not in attrs:
        return tag, frozenset()
    words: set[str] = set()
    for _, value in NAMES.findall(attrs):
        words.update(WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
    return tag + "".join(f".{w}" for w in sorted(words)), frozenset(words)


def parse(page: str) -> Node:
    """The tree of block elements; inline tags vanish, raw-text elements are skipped."""
    root = Node("", "", frozenset())
    stack, text, pos, n = [root], [], 0, len(page)

    def flush() -> None:
        if text:
            block = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if block:
                stack[-1].items.append(block)

    def close(tags: frozenset[str], stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stop:
                return
            if stack[k].tag in tags:
                del stack[k:]

    lower = None
    while pos < n:
        start = page.find("<", pos)
        if start < 0:
            text.append(page[pos:])
            break
        if start > pos:
            text.append(page[pos:start])
        m = TOKEN.match(page, start)
        if m is None:
            text.append("<")
            pos = start + 1
            continue
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in RAW and not closing:
            if lower is None:
                lower = page.lower()
                if len(lower) != n:  # a few letters change their length
                    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
            end = lower.find(f"</{tag}", pos)
            pos = n if end < 0 else (lower.find(">", end) + 1 or n)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCK:
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES:
            close(CLOSES[tag], CONTAINERS[tag])
        elif stack[-1].tag == "p":
            stack.pop()  # every block element ends an open paragraph
        if tag in VOID:
            continue
        label, words = _label(tag, attrs)
        node = Node(tag, label, words)
        stack[-1].items.append(node)
        if not attrs.endswith("/"):
            stack.append(node)
    flush()
    return root


def furniture(node: Node, in_article: bool) -> bool:
    """Whether a block element is furniture by its name or names."""
    if node.tag in CHROME_TAGS:
        return True
    if node.tag in ("article", "main", "body", "html"):
        return False
    if node.tag == "header" or node.words & HEADER_WORDS:
        return not in_article
    return bool(node.words & CHROME_WORDS)


# A wrapper node is [label, quantifier, pages, slot, children, mass]: quantifier "1", "?", "+" or
# "*"; slot is None without text, the CRC of the constant text (of all texts of a page's group), or
# -1 for a text slot, which differs between pages; mass counts the characters of all texts below it.  Levels hold each label once, in order.
def wrapper(node: Node) -> list:
    """The wrapper of a single page: its own stream with repetitions folded."""
    todo: list[tuple[Node, int, dict[str, list]]] = [(node, 0, {})]
    made: list = []
    while todo:
        x, at, kids = todo.pop()
        if at == len(x.items):
            made = [x.label, "1", 1, None, list(kids.values()), 0]
            made[5] = _mass(made[4])
            if todo:
                _add(todo[-1][2], made)
            continue
        todo.append((x, at + 1, kids))
        item = x.items[at]
        if isinstance(item, Node):
            todo.append((item, 0, {}))
        else:
            _add(kids, ["#", "1", 1, zlib.crc32(item.encode("utf-8", "surrogatepass")), [], len(item)])
    return made


def _mass(children: list) -> int:
    total = 0
    for c in children:
        total += c[5]
    return total


def _add(kids: dict[str, list], x: list) -> None:
    old = kids.get(x[0])
    kids[x[0]] = x if old is None else _merge(old, x, True)


def _quantifier(a: str, b: str, repeated: bool) -> str:
    optional = a in "?*" or b in "?*"
    many = repeated or a in "+*" or b in "+*"
    return "*" if optional and many else "+" if many else "?" if optional else "1"


def _optional(x: list) -> list:
    return [x[0], _quantifier(x[1], "?", False), *x[2:]]


def _merge(a: list, b: list, repeated: bool = False) -> list:
    """Both nodes as one, and their levels aligned all the way down, by a stack of its own.

    repeated: they stand in one page.
    """
    top: list = []
    todo = [(a, b, repeated, top)]
    while todo:
        x, y, again, into = todo.pop()
        if x[3] is None or y[3] is None:
            slot = y[3] if x[3] is None else x[3]
        elif repeated:  # all texts of a page's group count as one
            slot = zlib.crc32(b"%d" % y[3], x[3])
        else:
            slot = x[3] if x[3] == y[3] else -1
        level: list = []
        into.append([x[0], _quantifier(x[1], y[1], again), max(x[2], y[2]) if repeated else x[2] + y[2], slot, level, x[5] + y[5]])
        for pair, moved in _align(x[4], y[4]):
            if len(pair) == 2:
                place: list = []
                level.append(place)  # filled with the merged node below
                todo.append((*pair, moved, place))
            else:
                level.append(_optional(pair[0]))
    return _settled(top[0])


def _settled(node: list) -> list:
    """The places of merged nodes replaced by the nodes."""
    todo = [node]
    while todo:
        level = todo.pop()[4]
        for k, c in enumerate(level):
            if len(c) == 1:
                level[k] = c[0]
                todo.append(c[0])
    return node


def _align(a: list, b: list) -> list[tuple[tuple, bool]]:
    """Children of two wrappers in one order: pairs of equal label, with whether they stand out
    of the longest common sequence (then the group recurs), and single ones, which are optional.

    A level has each label once, so the longest common sequence is a longest increasing one.
    """
    at = {y[0]: j for j, y in enumerate(b)}
    common = [(i, at[x[0]]) for i, x in enumerate(a) if x[0] in at]
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(common):
        n = bisect_left(tails, j)
        before.append(ends[n - 1] if n else -1)
        tails[n:n + 1] = [j]
        ends[n:n + 1] = [k]
    kept: set[int] = set()
    k = ends[-1] if ends else -1
    while k >= 0:
        kept.add(common[k][0])
        k = before[k]
    out: list[tuple[tuple, bool]] = []
    known = {x[0] for x in a}
    j = 0
    for i, x in enumerate(a):
        where = at.get(x[0])
        if where is None:
            out.append(((x,), False))
            continue
        if i in kept:
            out += [((y,), False) for y in b[j:where] if y[0] not in known]
            j = max(j, where + 1)
        out.append(((x, b[where]), i not in kept))
    return out + [((y,), False) for y in b[j:] if y[0] not in known]


def align(a: list, b: list) -> list:
    """The wrapper of the pages of both wrappers."""
    return _merge(a, b)


def pack(w: list) -> str:
    """A wrapper as flat JSON: its nodes in order, each with its number of children."""
    flat: list = []
    todo = [w]
    while todo:
        x = todo.pop()
        flat += [x[0], x[1], x[2], x[3], x[5], len(x[4])]
        todo.extend(reversed(x[4]))
    return json.dumps(flat, separators=(",", ":"))


def unpack(text: str) -> list:
    flat = json.loads(text)
    top: list = []
    open_: list[tuple[list, int]] = [(top, 1)]
    for k in range(0, len(flat), 6):
        label, quantifier, pages, slot, mass, n = flat[k : k + 6]
        while open_[-1][1] == 0:
            open_.pop()
        level, left = open_[-1]
        open_[-1] = (level, left - 1)
        children: list = []
        level.append([label, quantifier, pages, slot, children, mass])
        open_.append((children, n))
    return top[0]


@lru_cache(20_000)
def _named(label: str) -> Node:
    tag, *words = label.split(".")
    return Node(tag, label, frozenset(words))


def _key(parent: int, label: str) -> int:
    """The name of a label path, from that of the path above."""
    return (parent * 0x9E3779B97F4A7C15 + zlib.crc32(label.encode("utf-8", "surrogatepass")) + 1) & _MASK


def _changes(w: list) -> dict[int, bool]:
    """Per node (by identity): whether a text below it differs between pages."""
    order, found = [w], {}
    for x in order:
        order.extend(x[4])
    for x in reversed(order):
        changed = x[3] == -1
        for c in x[4]:
            changed = changed or found[id(c)]
        found[id(x)] = changed
    return found


#: Elements whose content is one text; a region is never inside one.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption legend tr".split())


def _region(w: list, changes: dict[int, bool]) -> tuple[list[str], bool]:
    """Label path of the host's main region, and whether it is an article or main element."""
    # the mass of text that counts: what changes, or all of it where nothing does
    weight: dict[int, int] = {}
    order = [w]
    for x in order:
        order.extend(x[4])
    for x in reversed(order):
        total = x[5] if x[0] == "#" and (changes[id(x)] or not changes[id(w)]) else 0
        for c in x[4]:
            if c[0] == "#" or not furniture(_named(c[0]), True):
                total += weight[id(c)]
        weight[id(x)] = total

    best: dict[str, tuple] = {}
    todo: list[tuple[list, tuple]] = [(w, ())]
    while todo:
        x, path = todo.pop()
        for c in reversed(x[4]):
            if c[0] == "#" or furniture(_named(c[0]), False):
                continue
            here = (path, c[0])
            tag = _named(c[0]).tag
            if tag in ("article", "main"):
                found = (weight[id(c)], here)
                if found[0] and (tag not in best or found[0] >= best[tag][0]):
                    best[tag] = found
            todo.append((c, here))

    def labels(path: tuple) -> list[str]:
        out = []
        while path:
            path, label = path
            out.append(label)
        return out[::-1]

    for tag in ("article", "main"):
        if tag in best:
            return labels(best[tag][1]), True
    path: list[str] = []
    x, own = w, weight[id(w)]
    while own:
        inner = [c for c in x[4] if c[0] != "#" and not furniture(_named(c[0]), False) and _named(c[0]).tag not in LEAVES]
        sized = [(weight[id(c)], bool(_named(c[0]).words & MAIN_WORDS), -k, c) for k, c in enumerate(inner)]
        most = max(sized, key=lambda y: y[:3], default=None)
        if most is None or 2 * most[0] <= own:
            break
        x, own = most[3], most[0]
        path.append(x[0])
    return path, False


def plan_of(w: list) -> tuple[list[str], list[int], list[int]]:
    """What a wrapper says of its pages: the label path of the main region, the paths of constant
    texts to drop and the paths of blocks to keep although their names are those of furniture."""
    changes = _changes(w)
    path, article = _region(w, changes)
    drop: list[int] = []
    keep: list[int] = []
    level, key = [w], 0
    for label in path:
        level = [c for x in level for c in x[4] if c[0] == label]
        key = _key(key, label)
    pages = level[0][2] if level else 0
    todo = [(x, key) for x in level]
    while todo:
        x, at = todo.pop()
        for c in x[4]:
            here = _key(at, c[0])
            changed = changes[id(c)]
            if c[0] != "#":
                node = _named(c[0])
                if furniture(node, True):
                    if changed and named_only(node) and not node.words & CHANGING_WORDS:
                        keep.append(here)
                    else:
                        continue
                todo.append((c, here))
            elif not article and not changed and c[2] >= AGREEING and 2 * c[2] > pages and changes[id(w)]:
                drop.append(here)
    return path, sorted(drop), sorted(keep)


def named_only(node: Node) -> bool:
    """Whether only a block's class, id or role makes it furniture, not its element."""
    return node.tag not in CHROME_TAGS and node.tag != "header"


def _texts(region: Node, key: int, in_article: bool, drop: frozenset[int], keep: frozenset[int], out: list[str]) -> None:
    todo: list[tuple[Node | str, int, bool]] = [(region, key, in_article)]
    first = True
    while todo:
        x, at, inside = todo.pop()
        if isinstance(x, str):
            if not drop or _key(at, "#") not in drop:
                out.append(x)
            continue
        if not first:
            at = _key(at, x.label)
            if furniture(x, inside) and at not in keep:
                continue
            inside = inside or x.tag in ("article", "main")
        first = False
        for item in reversed(x.items):
            todo.append((item, at, inside))


def _regions(node: Node, path: list[str]) -> list[Node]:
    """All elements at a label path."""
    level = [node]
    for label in path:
        level = [x for n in level for x in n.items if isinstance(x, Node) and x.label == label]
    return level


Plan = tuple[list[str], frozenset[int], frozenset[int]]


def read_plan(text: str) -> Plan:
    path, drop, keep = json.loads(text)
    return path, frozenset(drop), frozenset(keep)


def extract(root: Node, plan: Plan) -> str:
    """A page's main text along its host's wrapper.

    A page without the wrapper's region is cut along its own one-page wrapper.
    """
    path, drop, keep = plan
    regions = _regions(root, path)
    if path and not regions:
        path, _, _ = plan_of(wrapper(root))
        drop = keep = frozenset()
        regions = _regions(root, path)
    key = 0
    for label in path:
        key = _key(key, label)
    blocks: list[str] = []
    for r in regions:
        _texts(r, key, bool(path), drop, keep, blocks)
    if drop and not blocks:  # a page of constant texts only
        for r in regions:
            _texts(r, key, bool(path), frozenset(), keep, blocks)
    return "\n\n".join(blocks)


def host_of(url: str | None) -> str:
    """Lower-case host of a URL; '' if it has none."""
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([pack(w) for w in held.values()], pa.string())], names=["host", "wrapper"])
        held.clear()
        return made

    for batch in batches:
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host, w = host_of(url), wrapper(parse(page or ""))
            held[host] = align(held[host], w) if host in held else w
        if len(held) > 5000:
            yield out()
    if held:
        yield out()


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host: their wrappers aligned, the region of each host."""
    rows = ((h, w) for b in batches for h, w in zip(b.column("host").to_pylist(), b.column("wrapper").to_pylist(), strict=True))
    host, held, done = None, None, []

    def batch_of(done):
        hosts, plans = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(plans, pa.string())], names=["host", "plan"])

    for h, w in rows:
        if h == host:
            held = align(held, unpack(w))
            continue
        if held is not None:
            done.append((host, json.dumps(plan_of(held), separators=(",", ":"))))
        host, held = h, unpack(w)
        if len(done) >= 1000:
            yield batch_of(done)
            done = []
    if held is not None:
        done.append((host, json.dumps(plan_of(held), separators=(",", ":"))))
    if done:
        yield batch_of(done)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, plan): JSON of what each host's wrapper says (plan_of)."""
    partial = pages.select("url", "html").mapInArrow(_infer, "host string, wrapper string")
    return partial.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_reduce, "host string, plan string")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of text).

    Null or empty html gives the empty text; pages without a host share one wrapper.  Repeated
    rows are returned as often as they come, an empty table gives no rows, a null page_id stays
    null; extra columns are ignored.
    """
    ws = Workspace(pages.sparkSession, "html")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    plans = ws.write(infer_wrappers(rows), "plans")
    kind = rows.schema["page_id"].dataType.simpleString()
    names = ["page_id", "url", "text", "n_chars"]

    def cut(batches: Iterator[pa.RecordBatch], plan_of) -> Iterator[pa.RecordBatch]:
        known: dict[str, Plan] = {}
        for batch in batches:
            step = 256
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                texts = []
                for row, (url, page) in enumerate(zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True)):
                    plan = plan_of(part, row, url)
                    if plan not in known:
                        if len(known) > 5000:
                            known.clear()
                        known[plan] = read_plan(plan)
                    texts.append(extract(parse(page or ""), known[plan]))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    schema = f"page_id {kind}, url string, text string, n_chars bigint"
    if small(plans, MAX_BROADCAST_WRAPPERS):
        table = pages.sparkSession.sparkContext.broadcast({r.host: r.plan for r in plans.collect()})
        return rows.mapInArrow(lambda it: cut(it, lambda part, row, url: table.value.get(host_of(url), NO_PLAN)), schema)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    joined = rows.withColumn("host", host).join(plans, "host", "left").withColumn("plan", F.coalesce("plan", F.lit(NO_PLAN)))
    return joined.select("page_id", "url", "html", "plan").mapInArrow(lambda it: cut(it, lambda part, row, url: part.column("plan")[row].as_py()), schema)
