"""Main text of web pages by wrapper induction.

A page's tree is made of slots: an element, or a run of siblings of one label that stand for a list (paragraphs,
items, inline marks, elements of equal shape), so that lists of different lengths align. Pages of one host are
aligned with one of them, the host's reference, by simple tree matching; what it lacks is a slot by its path. A slot
goes by its path of labels on all hosts, so hosts of one layout tell each other what their slots are.

Over all pages a slot is template if its texts recur on pages that differ otherwise (menus, footers, adverts that rotate),
as often as the draws from a pool of texts would that are repeated at the rate seen: so few pages and many are judged alike.
On a host, a text is template that stands in a slot on most pages that have it (notices, lines to share). Slots
whose texts vary are content. A page's text is that of its body without template, and without the elements that HTML
itself defines as no content. Where too few pages are there to tell a varying slot from a rotating one, and only there, it
counts whether the slot is in an article or main part that holds the page's text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A text recurs if of the pairs of pages that have it in a slot so many, as a share, differ in their longest other texts.
DIFFERING = 0.6
#: A slot is template if this share of its characters recurs, at least, and this share of what a pool of texts would show.
LEAST_SHARE, RECURRING = 0.3, 0.8
#: A recurring text is template on a host if this share of the slot's pages has it, unless more than COPIED of the slot recurs there, as with copies.
SAME_SHARE, COPIED = 0.8, 0.5
#: Of so many pages' texts 0.3 or more would recur if they were drawn from a pool of up to 800: a slot whose texts don't is told to vary.
TOLD_PAGES = 300
#: Undecided text outside of an article or main part goes if that holds at least this part of it.
REGION_PART = 0.05
#: References are broadcast up to this size, and joined by host beyond it.
BROADCAST_BYTES = 32 << 20

# HTML's element names by their role, ARIA's roles, and the names that mark readers' comments, which
# vary from page to page as an article does, so that no count tells them apart.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe".split())
DROPPED = frozenset("script style noscript template textarea title svg iframe head nav footer aside form button select dialog menu object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("tbody tfoot thead tr li dd dt caption body html summary".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = frozenset("ul ol dl table body html div section article main nav footer aside header form blockquote select".split())
LISTED = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6 blockquote pre figure hr br wbr a b i u s q em strong small span sub sup code abbr cite time mark img input label font".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar comment".split())
COMMENT_NAMES = re.compile(r"(?<![a-z])(?:comment|comments|commentlist|disqus|respond)(?![a-z])")

_TOKEN = re.compile(r"<!--|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?")
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")


class Node:
    """An element: kids are elements and strings in page order; dropped if it and all below is boilerplate by its name."""

    __slots__ = ("tag", "kids", "dropped", "label", "elements", "words")

    def __init__(self, tag: str, dropped: bool, label: str = ""):
        self.tag, self.dropped, self.label = tag, dropped, label or tag
        self.kids: list = []
        self.words = None


def _label(tag: str, attributes: str) -> str:
    """An element's name and classes without numbers, by which pages of one layout agree."""
    m = _CLASS.search(attributes) if attributes else None
    return f"{tag}.{_DIGITS.sub('', m[1] or m[2] or m[3] or '')}" if m else tag


def _is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main", "h1"):
        return False
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in BOILERPLATE_ROLES:
            return True
        if name in ("class", "id") and COMMENT_NAMES.search(value):
            return True
    return False


def parse(html: str) -> Node:
    """A tree from any text: unclosed and stray tags are tolerated, character references decoded."""
    root = Node("#root", False)
    stack, articles, at, n = [root], 0, 0, len(html)
    opened: Counter[str] = Counter()  # spares the search for what isn't open

    def leave(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    while at < n:
        start = html.find("<", at)
        m = _TOKEN.match(html, start) if start >= 0 else None
        if start < 0:
            stack[-1].kids.append(unescape(html[at:]))
            break
        if m is None:  # a bare <
            stack[-1].kids.append(unescape(html[at : start + 1]))
            at = start + 1
            continue
        if start > at:
            stack[-1].kids.append(unescape(html[at:start]))
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0] == "<!--":
                end = html.find("-->", at)
                at = n if end < 0 else end + 3
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(" ")
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    articles -= sum(x.tag == "article" for x in stack[k:])
                    leave(k)
                    break
            continue
        closing = {"p"} if tag in CLOSES_P else ENDED_BY.get(tag)
        if closing and any(opened[x] for x in closing):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closing:
                    leave(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag == "br" or tag == "wbr":
            if tag == "br":
                stack[-1].kids.append(" ")
            continue
        node = Node(tag, _is_boilerplate(tag, m[3], articles > 0), _label(tag, m[3]))
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            stack[-1].kids.append(node)
        elif tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(html, at)
            close = html.find(">", end.end()) if end else -1
            at = n if end is None or close < 0 else close + 1
            stack[-1].kids.append(node)
        else:
            stack[-1].kids.append(node)
            stack.append(node)
            opened[tag] += 1
            articles += tag == "article"
    for _ in walk(root):  # lists each element's elements
        pass
    return root


def walk(node: Node) -> Iterator[Node]:
    """All elements in page order."""
    stack = [node]
    while stack:
        x = stack.pop()
        x.elements = [k for k in x.kids if type(k) is Node]
        yield x
        stack += reversed(x.elements)


def own_text(node: Node) -> str:
    """The text that stands directly in an element, white space collapsed."""
    if node.words is None:
        node.words = " ".join(" ".join(x for x in node.kids if type(x) is str).split())
    return node.words


class Slot:
    """What stands for an element, or a run of them: its label, the elements, the slots below, and their measure."""

    __slots__ = ("label", "nodes", "kids", "shape", "size")

    def __init__(self, label: str, nodes: list[Node]):
        self.label, self.nodes, self.kids = label, nodes, []


def _runs(slots: list[Slot]) -> list[Slot]:
    """Neighbours of one label and shape become one slot."""
    out: list[Slot] = []
    for x in slots:
        if out and out[-1].label == x.label and out[-1].shape == x.shape:
            pairs = [(out[-1], x)]
            while pairs:  # equal shapes have the same slots all the way down
                a, b = pairs.pop()
                a.nodes += b.nodes
                pairs += zip(a.kids, b.kids, strict=True)
        else:
            out.append(x)
    return out


def slots_of(root: Node) -> Slot:
    """The slots of a tree, from the leaves up: list elements by their label, other ones where label and shape are equal."""
    top = Slot(root.label, [root])
    order, stack = [], [top]
    while stack:
        x = stack.pop()
        order.append(x)
        listed: dict[str, Slot] = {}
        loose = x.nodes[0].tag in LISTED  # inside of list elements the number and order of marks say nothing
        for node in x.nodes:
            for y in node.elements:
                if y.tag not in LISTED:
                    if not loose:
                        listed.clear()
                    x.kids.append(Slot(y.label, [y]))
                elif y.label in listed:
                    listed[y.label].nodes.append(y)
                else:
                    listed[y.label] = Slot(y.label, [y])
                    x.kids.append(listed[y.label])
        stack += x.kids
    for x in reversed(order):
        x.kids = _runs(x.kids)
        x.shape = hash((x.label, tuple(k.shape for k in x.kids)))
        x.size = 1 + sum(k.size for k in x.kids)
    return top


def walk_slots(top: Slot) -> Iterator[Slot]:
    stack = [top]
    while stack:
        x = stack.pop()
        yield x
        stack += reversed(x.kids)


def _trim(a: list[Slot], b: list[Slot]) -> tuple[int, int]:
    """How many children at the start, and then at the end, have equal shapes; matching those is optimal."""
    most, head = min(len(a), len(b)), 0
    while head < most and a[head].shape == b[head].shape:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail].shape == b[-1 - tail].shape:
        tail += 1
    return head, tail


def _middle(x: Slot, y: Slot) -> tuple[list[Slot], list[Slot], int]:
    head, tail = _trim(x.kids, y.kids)
    p, q = x.kids[head : len(x.kids) - tail], y.kids[head : len(y.kids) - tail]
    return p, q, 1 + sum(k.size for k in x.kids) - sum(k.size for k in p)


def similarity(a: Slot, b: Slot, memo: dict) -> int:
    """Simple tree matching: the slots of the largest order-preserving, level-by-level common tree.

    Each pair of shapes is worked out once, children first, without recursion.
    """
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        key = (x.shape, y.shape)
        if x.label == y.label and x.shape != y.shape and key not in memo:
            p, q, fixed = _middle(x, y)
            below = {u.shape: u for u in p}.values(), {v.shape: v for v in q}.values()
            missing = [(u, v) for u in below[0] for v in below[1] if u.label == v.label and u.shape != v.shape and (u.shape, v.shape) not in memo]
            if missing:
                stack += missing
                continue
            memo[key] = fixed + _best(p, q, memo)
        stack.pop()
    return _known(a, b, memo)


def _known(a: Slot, b: Slot, memo: dict) -> int:
    return 0 if a.label != b.label else a.size if a.shape == b.shape else memo[a.shape, b.shape]


def _rows(p: list[Slot], q: list[Slot], memo: dict) -> Iterator[np.ndarray]:
    """For each slot of p the best sums of matched sizes of the list so far with all beginnings of q."""
    different = {v.shape: v for v in q}
    place = {shape: i for i, shape in enumerate(different)}
    at = np.array([place[v.shape] for v in q])
    worth: dict[int, np.ndarray] = {}
    row = np.zeros(len(q) + 1, np.int64)
    yield row
    for u in p:
        if u.shape not in worth:
            worth[u.shape] = np.array([_known(u, v, memo) for v in different.values()], np.int64)[at]
        both = np.maximum(row[1:], row[:-1] + worth[u.shape])
        row = np.concatenate([row[:1], np.maximum.accumulate(both)])
        yield row


def _best(p: list[Slot], q: list[Slot], memo: dict) -> int:
    last = 0
    if p and q:
        for row in _rows(p, q, memo):
            last = int(row[-1])
    return last


def _pairs(p: list[Slot], q: list[Slot], memo: dict) -> list[tuple[Slot, Slot]]:
    """The matched slots of two lists, by dividing the first in halves, so that memory stays within the lists' lengths."""
    out, parts = [], [(p, q)]
    while parts:
        u, v = parts.pop()
        if not u or not v:
            continue
        if len(u) == 1:
            worth = [_known(u[0], y, memo) for y in v]
            if max(worth):
                out.append((u[0], v[int(np.argmax(worth))]))
            continue
        half = len(u) // 2
        for first in _rows(u[:half], v, memo):
            pass
        for last in _rows(u[half:][::-1], v[::-1], memo):
            pass
        cut = int(np.argmax(first + last[::-1]))
        parts += [(u[half:], v[cut:]), (u[:half], v[:cut])]
    return out


def align(a: Slot, b: Slot, memo: dict | None = None) -> list[tuple[Slot, Slot]]:
    """Pairs of matched slots of two trees, in page order, the roots first."""
    memo = {} if memo is None else memo
    if a.label != b.label:
        return []
    similarity(a, b, memo)
    out, open_pairs = [], [(a, b)]
    while open_pairs:
        x, y = open_pairs.pop()
        out.append((x, y))
        head, tail = _trim(x.kids, y.kids)
        p, q, _ = _middle(x, y)
        pairs = [*zip(x.kids[:head], y.kids[:head], strict=True), *_pairs(p, q, memo), *zip(x.kids[len(x.kids) - tail :], y.kids[len(y.kids) - tail :], strict=True)]
        open_pairs += reversed(pairs)
    return out


def _outside(root: Node, muted: set[int], told: set[int]) -> set[int]:
    """Of the elements that hold text those outside of the page's articles, or main parts, and not told to vary.

    Articles or main parts count, whichever hold more text; none if they hold less than REGION_PART of what is
    untold outside of them. Text that is muted or boilerplate by its name counts nowhere.
    """
    best: tuple[int, set[int]] = (0, set())
    for tag in ("article", "main"):
        inside, untold, out = 0, 0, set()
        stack = [(root, False)]
        while stack:
            x, within = stack.pop()
            if x.dropped:
                continue
            within = within or x.tag == tag
            size = len(own_text(x)) if id(x) not in muted else 0
            if within:
                inside += size
            elif size and id(x) not in told:
                untold += size
                out.add(id(x))
            stack += [(k, within) for k in x.elements]
        if inside > best[0] and inside >= REGION_PART * untold:
            best = inside, out
    return best[1]


def text_of(root: Node, template: frozenset[int] | set[int] = frozenset(), by_name: bool = True) -> str:
    """The main text: blocks in page order joined by a line feed.

    template: ids of elements whose own text is left out. Without by_name only scripts, styles and their like are
    left out besides.
    """
    blocks: list[str] = []
    words: list[str] = []

    def end_block() -> None:
        line = " ".join("".join(words).split())
        if line:
            blocks.append(line)
        words.clear()

    stack: list[tuple] = [(root, False)]
    while stack:
        x, ends = stack.pop()
        if type(x) is str:
            words.append(x)
            continue
        if ends:
            end_block()
            continue
        if x.dropped if by_name else x.tag in RAW:
            if x.tag in BLOCK:  # what goes still parts what stands before it from what follows
                end_block()
            continue
        if x.tag in BLOCK:
            end_block()
            stack.append((x, True))
        elif x.tag in ("td", "th"):
            words.append(" ")
        muted = id(x) in template
        stack += [(k, False) for k in reversed(x.kids) if not (muted and type(k) is str)]
    end_block()
    return "\n".join(blocks)


def _key(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Reference:
    """A host's reference page: the paths of its slots, which slots and which texts in them are template, and which slots vary."""

    def __init__(self, html: str, slots: list[int] | None = None, texts: list[dict] | None = None, told: list[int] | None = None):
        self.html, self.top = html, slots_of(parse(html))
        self.paths: dict[int, int] = {}
        stack = [(self.top, 0)]
        while stack:
            x, above = stack.pop()
            self.paths[id(x)] = path = _below(above, x)
            stack += [(k, path) for k in x.kids]
        self.slots, self.told = frozenset(slots or ()), frozenset(told or ())
        self.texts = frozenset((x["slot"], x["text"]) for x in texts or ())
        self.mixed = frozenset(x for x, _ in self.texts)

    def place(self, tree: Node) -> Iterator[tuple[Node, int]]:
        """The elements of a page that hold text, each with its slot: the path of what it is aligned with in the reference, else its own."""
        top = slots_of(tree)
        aligned = {id(y): self.paths[id(x)] for x, y in align(self.top, top)}
        stack = [(top, 0)]
        while stack:
            x, above = stack.pop()
            if x.nodes[0].tag in RAW:
                continue
            path = aligned[id(x)] if id(x) in aligned else _below(above, x)
            for n in x.nodes:
                if own_text(n):
                    yield n, path
            stack += [(k, path) for k in x.kids]

    def extract(self, html: str | None, name: str = "", by_name: bool = True) -> str:
        """The text of a page of the host of this name."""
        tree = parse(html or "")
        placed = list(self.place(tree))
        out = {id(n) for n, slot in placed if slot in self.slots or slot in self.mixed and (slot, _key(_masked(own_text(n), name))) in self.texts}
        if by_name:
            out |= _outside(tree, out, {id(n) for n, slot in placed if slot in self.told})
        return text_of(tree, out, by_name)


def _below(path: int, slot: Slot) -> int:
    return xxhash.xxh3_64_intdigest(slot.label, seed=path & (1 << 64) - 1) - (1 << 63)


def _masked(text: str, name: str) -> str:
    """A text without its host's name, which footers of one kind differ in."""
    return text.replace(name, "\0") if name else text


class _References:
    """The latest hosts' references; a worker keeps few at a time, and reads them once from the rows that carry them."""

    def __init__(self, most: int = 256):
        self.kept: dict = {}
        self.most = most

    def get(self, batch: pa.RecordBatch, i: int, host: int) -> Reference:
        if host not in self.kept:
            if len(self.kept) >= self.most:
                self.kept.clear()
            html, *template = (batch.column(k)[i].as_py() for k in ("reference", "slots", "texts", "told") if k in batch.schema.names)
            self.kept[host] = Reference(html or "", *template)
        return self.kept[host]


_COUNTED = "host long, slot long, text long, other long, chars int, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages by host, slot, text, and what tells the page beside it; and by host and slot alone.

    A page is told by its two longest other texts together: one may be a standing text of the host.
    """
    references, counts = _References(), Counter()
    for batch in batches:
        for i, (host, name, html) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("host", "name", "html")), strict=True)):
            if not html:
                continue
            placed = [(slot, _masked(own_text(n), name or "")) for n, slot in references.get(batch, i, host).place(parse(html))]
            if not placed:
                continue
            longest = sorted({t for _, t in placed}, key=lambda t: (-len(t), t))[:3]
            whole = _key("\0".join(longest[:2]))
            for slot, text in set(placed):
                other = _key("\0".join([t for t in longest if t != text][:2])) if text in longest else whole
                counts[host, slot, _key(text), other, len(text)] += 1
            for slot in {slot for slot, _ in placed}:
                counts[host, slot, None, None, None] += 1
            if len(counts) > 100_000:
                yield _counted(counts)
                counts.clear()
    yield _counted(counts)


def _counted(counts: Counter) -> pa.RecordBatch:
    types = [*[pa.int64()] * 4, pa.int32(), pa.int64()]
    rows = [(*k, n) for k, n in counts.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [x.split()[0] for x in _COUNTED.split(", ")])


def _extract(by_name: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = _References()
        for batch in batches:
            rows = enumerate(zip(*(batch.column(x).to_pylist() for x in ("host", "name", "html")), strict=True))
            texts = [references.get(batch, i, host).extract(x, name or "", by_name) for i, (host, name, x) in rows]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def _by_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same by names alone, without any wrapper."""
    for batch in batches:
        texts = [text_of(parse(x or "")) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _repeated(counted: DataFrame, *keys: str) -> DataFrame:
    """keys, n, chars and recurs of each text: whether pairs of the pages that have it differ otherwise for DIFFERING of them."""
    by_other = counted.where("text IS NOT NULL").groupBy(*keys, "text", "other").agg(F.sum("n").alias("n"), F.max("chars").alias("chars"))
    n, same = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    return by_other.groupBy(*keys, "text").agg(n.alias("n"), F.max("chars").alias("chars"), ((n > 1) & (n * n - same >= DIFFERING * n * (n - 1))).alias("recurs"))


def induce(pages: DataFrame) -> DataFrame:
    """A row per host: host, reference (html), slots (template slots), texts (template texts: slot, text), told (slots that vary).

    Takes rows of host (a number), name, html. The reference is the host's page with the smallest hash. Texts go by their
    hashes, the host's name masked, summed in each task before the shuffle. Pages that are copies of one another agree in their
    longest other texts too, so what they share doesn't recur and stays content.
    """
    refs = pages.where("html IS NOT NULL").groupBy("host").agg(F.min(F.struct(F.xxhash64("html").alias("h"), "html")).alias("m")).select("host", F.col("m.html").alias("reference"))
    refs = common.scratch(refs, "references")
    counted = _with_references(pages, refs).mapInArrow(common.resting(_count), _COUNTED)
    counted = common.scratch(counted.groupBy("host", "slot", "text", "other").agg(F.max("chars").alias("chars"), F.sum("n").alias("n")), "slot-texts")
    held = counted.where("text IS NULL").select("host", "slot", F.col("n").alias("pages"))
    # how much of a slot recurs over all hosts, and how much would if its texts were drawn from a pool that repeats them at this rate
    weight, pairs = F.col("n") * F.col("chars"), F.col("n") * F.col("chars") * (F.col("n") - 1)
    of = lambda x: F.coalesce(F.sum(F.when(F.col("recurs"), x)), F.lit(0))
    slots = _repeated(counted, "slot").groupBy("slot").agg(F.sum(weight).alias("all"), of(weight).alias("recurring"), of(pairs).alias("pairs"))
    slots = slots.join(held.groupBy("slot").agg(F.sum("pages").alias("pages")), "slot")
    share, rate = F.col("recurring") / F.col("all"), F.col("pairs") / (F.col("all") * F.greatest(F.col("pages") - 1, F.lit(1)))
    expected = 1 - F.pow(F.greatest(1 - rate, F.lit(0.0)), F.col("pages") - 1)
    judged = slots.select("slot", ((share >= LEAST_SHARE) & (share >= RECURRING * expected)).alias("whole"), (F.col("pages") >= TOLD_PAGES).alias("told"))
    # a host's texts in slots that vary
    own = _repeated(counted, "host", "slot")
    mine = own.groupBy("host", "slot").agg((of(weight) <= COPIED * F.sum(weight)).alias("varied"))
    placed = held.join(judged, "slot").join(mine, ["host", "slot"])
    texts = own.where("recurs").join(placed.where("NOT whole AND varied"), ["host", "slot"]).where(F.col("n") >= SAME_SHARE * F.col("pages"))
    none = F.lit(None).cast("struct<slot: bigint, text: bigint>")
    both = placed.where("whole OR told").select("host", "slot", "whole", none.alias("text")).unionByName(texts.select("host", "slot", F.lit(None).cast("boolean").alias("whole"), F.struct("slot", "text").alias("text")))
    template = both.groupBy("host").agg(
        F.sort_array(F.collect_set(F.when(F.col("whole"), F.col("slot")))).alias("slots"), F.sort_array(F.collect_list("text")).alias("texts"), F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("slot")))).alias("told")
    )
    return common.scratch(refs.join(template, "host", "left"), "wrappers")


def _with_references(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """Pages beside their host's row, which is broadcast if all of them are small: html in bytes, lists by their elements."""
    lists = sum((F.coalesce(F.size(x), F.lit(0)) * bytes_ for x, bytes_ in (("slots", 16), ("texts", 32), ("told", 16)) if x in refs.columns), F.lit(64))
    size = refs.agg(F.sum(F.coalesce(F.octet_length("reference"), F.lit(0)).cast("long") + lists)).first()[0] or 0
    return pages.join(F.broadcast(refs) if size <= BROADCAST_BYTES else refs, "host", "left")


def extract(pages: DataFrame, by_name: bool = True, wrapper: bool = True, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    The host is the url's between // and the next /, ?, # or port, lower-cased; null urls form a group of
    their own. Null and empty html give an empty text; repeated rows are each extracted; an empty table
    gives no rows. Pages are shuffled only when the hosts' references are too large to broadcast. Without
    by_name the induced wrapper alone decides; without wrapper HTML's own names do. Matching takes time by the product of
    the numbers of different shapes that two pages' lists of unlike siblings have.
    """
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    key = F.xxhash64(F.lit("host"), host)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), key.alias("host"), host.alias("name"))
    schema = "page_id long, url string, text string, n_chars long"
    if not wrapper:
        return rows.mapInArrow(common.resting(_by_hosts), schema)
    return _with_references(rows, induce(rows.select("host", "name", "html"))).mapInArrow(common.resting(_extract(by_name)), schema)
