"""HTML extraction by wrapper induction.

A page's skeleton is its tree of structural elements, equal neighbours folded into one repeated node. The most frequent
skeleton of a host is its wrapper. Simple tree matching aligns every page's skeleton to the wrapper; a wrapper node whose
text is the same on CONSTANT of the host's different pages that have it is template, the other slots hold content. What a page keeps is
the text of its slots inside article or main elements (all of the body where it has none), without the elements and
class, id or role names that mark menus, headers, footers, sidebars, notices, adverts, forms and reader comments.

Pages with the same content count once when the constants are found, so that copies of an article don't make it template, and
hosts of fewer than LEAST different pages have no template. Wrappers are stored and joined by host, so a host of any size
is spread over all tasks.

Names of several meanings (WEAK: share, notice, search ...) count only where every word of the class or id is such a name or a
word for a piece of a page, so that "share-buttons" goes and "share-price" stays.

Cases: null and empty html give an empty text; a null or odd url counts as host ""; page_id may repeat or be null, rows are
treated one by one; unclosed and unknown elements are closed by their parents; an empty table gives no rows; other columns of pages
are not read, whatever their names; of equally frequent skeletons of a host the greatest string is its wrapper, of equally
frequent texts of a node the greatest hash. Pages of any length and depth are read and matched whole by one rule, without recursion:
equal subtrees count once, and of a table of children only some rows are held. Where page and wrapper have many different subtrees
under equal labels, time grows with the product of their numbers. A node without a partner is no template, so no text is lost by that.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, table

CONSTANT = 0.6
LEAST = 3
SHORT = 20_000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
# Elements and names that are no main text.
DROPPED = frozenset("head nav footer aside form button select input dialog menu object audio video canvas".split()) | RAW
NAMES = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies disqus footer menu navbar nav navigation newsletter pagination popup promo promoted reply replies sidebar signup sponsor sponsored subscribe toolbar".split())
WEAK = frozenset("banner consent login modal notice notices related search share sharing social subscription widget".split())
PIECES = frozenset("area articles bar block box button buttons container content form global group icon icons inner item items left line link links list main message modules page panel post posts right section site stories top bottom wrap wrapper".split())
OUTSIDE = frozenset("header masthead topbar".split())
ROLES = frozenset("banner complementary contentinfo navigation search form alert dialog".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """A parsed page: structural nodes (label, parent), pieces of text with their node and block, and what is left out."""

    __slots__ = ("labels", "parents", "pieces", "kept", "main")
    # The stack holds (tag, node, place of the nearest element that is not inline); opened counts its tags.

    def __init__(self, html: str):
        self.labels: list[str] = ["#"]
        self.parents: list[int] = [0]
        self.kept: list[bool] = [True]
        self.main: list[bool] = [False]
        self.pieces: list[tuple[int, int, str]] = []
        stack: list[tuple[str, int, int]] = [("#", 0, 0)]
        opened: Counter[str] = Counter()
        at, block, n = 0, 0, len(html)

        def close(place: int) -> None:
            opened.subtract(t for t, _, _ in stack[place:])
            del stack[place:]

        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                self.pieces.append((stack[-1][1], block, html[at:]))
                break
            if m.start() > at:
                self.pieces.append((stack[-1][1], block, html[at : m.start()]))
            at = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            single = m.group(3).endswith("/")
            if m.group(1):
                if opened[tag]:
                    place = len(stack) - 1
                    while stack[place][0] != tag:
                        place -= 1
                    close(place)
                block += tag not in INLINE
            elif tag == "br":
                self.pieces.append((stack[-1][1], block, " "))
            elif tag in RAW:
                # A closing tag must follow in the text; without one the rest of the page is raw.
                end = None if single else re.compile(f"</{tag}\\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else (at if single else n)
            elif tag in VOID:
                block += tag not in INLINE
            elif tag in INLINE:
                if not single:
                    names = _names(m.group(3))
                    node = self._node(tag, names, stack[-1][1]) if names[1] or names[2] in ROLES else stack[-1][1]
                    stack.append((tag, node, stack[-1][2]))
                    opened[tag] += 1
            else:
                place = stack[-1][2]
                if place and tag in CLOSED_BY.get(stack[place][0], ()):
                    close(place)
                node = self._node(tag, _names(m.group(3)), stack[-1][1])
                block += 1
                if not single:
                    stack.append((tag, node, len(stack)))
                    opened[tag] += 1

    def _node(self, tag: str, names: tuple[str, bool, str, bool], parent: int) -> int:
        label, named, role, outside = names
        main = self.main[parent] or tag in ("article", "main") or role == "main"
        drop = tag in DROPPED or named or role in ROLES or (not main and (tag == "header" or outside))
        self.labels.append(tag + label)
        self.parents.append(parent)
        self.kept.append(self.kept[parent] and not drop)
        self.main.append(main)
        return len(self.labels) - 1

    def inside(self) -> list[bool]:
        """Which nodes may hold main text."""
        if any(k and m for k, m in zip(self.kept, self.main, strict=True)):
            return [k and m for k, m in zip(self.kept, self.main, strict=True)]
        return self.kept

    def folded(self) -> tuple[str, list[int]]:
        """The skeleton, a line "parent label" for each folded node, and for each node of the page the number of its line."""
        children: list[list[int]] = [[] for _ in self.labels]
        for i in range(1, len(self.labels)):
            children[self.parents[i]].append(i)
        shapes: dict[tuple, int] = {}
        shape = [0] * len(self.labels)
        for i in range(len(self.labels) - 1, -1, -1):
            below = tuple(k for k, _ in groupby(shape[c] for c in children[i]))
            shape[i] = shapes.setdefault((self.labels[i], below), len(shapes))
        number, lines, todo = [0] * len(self.labels), ["0 #"], [[0]]
        while todo:  # members of a group have equal shapes, so their children fold in the same way
            group = todo.pop()
            columns: list[list[int]] = []
            for g in group:
                for k, (_, run) in enumerate(groupby(children[g], shape.__getitem__)):
                    if k == len(columns):
                        columns.append([])
                    columns[k].extend(run)
            for members in columns:
                for c in members:
                    number[c] = len(lines)
                lines.append(f"{number[group[0]]} {self.labels[members[0]]}")
            todo.extend(reversed(columns))
        return "\n".join(lines), number


@lru_cache(4096)
def _names(attributes: str) -> tuple[str, bool, str, bool]:
    """Of an element's attributes: a label of its class, whether a name marks it as no main text, its role, whether it is a header by name."""
    label, named, role, outside = "", False, "", False
    for m in _ATTRIBUTE.finditer(attributes):
        value = m.group(2) or m.group(3) or m.group(4) or ""
        kind = m.group(1).lower()
        if kind == "role":
            role = value.strip().lower()
            continue
        for name in value.split():
            words = {x.lower() for x in _WORD.findall(name)}
            named |= bool(words & NAMES or (words & WEAK and words <= WEAK | PIECES))
            outside |= bool(words & OUTSIDE)
        if kind == "class":
            label = "." + ".".join(value.split())
    return label, named, role, outside


def unfold(skeleton: str) -> tuple[list[str], list[list[int]]]:
    """Labels and children of a skeleton's nodes."""
    labels: list[str] = []
    children: list[list[int]] = []
    for line in skeleton.split("\n"):
        parent, label = line.split(" ", 1)
        if labels:
            children[int(parent)].append(len(labels))
        labels.append(label)
        children.append([])
    return labels, children


def _shapes(trees: list[tuple[list[str], list[list[int]]]]) -> tuple[list[list[int]], list[tuple[str, list[int], int]]]:
    """For each tree the number of each node's subtree, equal subtrees of all trees having equal numbers; of each number its label, its children and its size."""
    numbers: dict[tuple, int] = {}
    made: list[tuple[str, list[int], int]] = []
    out = []
    for labels, children in trees:
        own = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            below = [own[c] for c in children[i]]
            key = (labels[i], *below)
            if key not in numbers:
                numbers[key] = len(made)
                made.append((labels[i], below, 1 + sum(made[c][2] for c in below)))
            own[i] = numbers[key]
        out.append(own)
    return out, made


def _row(last: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """The next row of the table of largest matchings."""
    row = np.maximum(last[1:], last[:-1] + worth)
    return np.concatenate([last[:1], np.maximum.accumulate(row)])


def _paired(worths: list[np.ndarray], size: int) -> tuple[int, list[tuple[int, int]]]:
    """The largest sum of worths of pairs in order, and its pairs (of equal ones without the last child of the page, then of the wrapper). Of the table only every
    k-th row is kept, k the root of their number, and the rows between are made again on the way back."""
    m = len(worths)
    step = max(1, int(m**0.5))
    row = np.zeros(size + 1, np.int64)
    kept = [row]
    for i, w in enumerate(worths):
        row = _row(row, w)
        if (i + 1) % step == 0:
            kept.append(row)
    best, pairs, i, j = int(row[-1]), [], m, size
    while i and j:
        low = (i - 1) // step * step
        rows = [kept[low // step]]
        for w in worths[low:i]:
            rows.append(_row(rows[-1], w))
        while i > low and j:
            here = rows[i - low]
            if here[j] == rows[i - low - 1][j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
    return best, pairs


def _aligned(page: str, wrapper: str) -> list[int]:
    (la, ca), (lb, cb) = unfold(page), unfold(wrapper)
    if page == wrapper:
        return list(range(len(la)))
    (na, nb), shapes = _shapes([(la, ca), (lb, cb)])
    # Of each pair of different subtrees with equal labels: the size of the largest matching, and the places of the children in it. Equal subtrees match whole,
    # and a subtree without children matches by its root.
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def worth(x: int, y: int) -> int | None:
        if shapes[x][0] != shapes[y][0]:
            return 0
        if x == y or not shapes[x][1] or not shapes[y][1]:
            return shapes[x][2] if x == y else 1
        return known[x, y][0] if (x, y) in known else None

    stack = [(na[0], nb[0])]
    while stack:
        x, y = stack[-1]
        if worth(x, y) is not None:
            stack.pop()
            continue
        below, under = shapes[x][1], shapes[y][1]
        columns = set(under)
        missing = [(c, d) for c in set(below) for d in columns if worth(c, d) is None]
        if missing:
            stack.extend(missing)
            continue
        by_shape = {c: np.array([worth(c, d) for d in under], np.int64) for c in set(below)}
        best, pairs = _paired([by_shape[c] for c in below], len(under))
        known[x, y] = best + 1, pairs
        stack.pop()
    out, todo = [-1] * len(la), [(0, 0)]
    while todo:
        a, b = todo.pop()
        out[a] = b
        if na[a] == nb[b]:
            todo.extend(zip(ca[a], cb[b], strict=True))
        else:
            todo.extend((ca[a][i], cb[b][j]) for i, j in known.get((na[a], nb[b]), (0, []))[1])
    return out


_recent = lru_cache(256)(_aligned)


def matched(page: str, wrapper: str) -> list[int]:
    """Simple tree matching: for each node of a page's skeleton its partner in the wrapper's, or -1."""
    return _recent(page, wrapper) if len(page) + len(wrapper) <= SHORT else _aligned(page, wrapper)


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shapes, hashes, contents = [], [], []
        for html in b.column("html").to_pylist():
            page = Page(html or "")
            shape, number = page.folded()
            inside = page.inside()
            texts: dict[int, list[str]] = {}
            content = []
            for node, _, text in page.pieces:
                if text.strip():
                    texts.setdefault(number[node], []).append(text)
                    if inside[node]:
                        content.append(text)
            shapes.append(shape)
            contents.append(_digest("\0".join(content)))
            hashes.append([_digest(" ".join("".join(texts[i]).split())) if i in texts else None for i in range(max(number) + 1)])
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(shapes, pa.string()), pa.array(contents, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "shape", "content", "hashes"])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, nodes, hashes = [], [], []
        for host, shape, wrapper, own in zip(*(b.column(c).to_pylist() for c in ("host", "shape", "wrapper", "hashes")), strict=True):
            for partner, h in zip(matched(shape, wrapper), own, strict=False):
                if partner >= 0 and h is not None:
                    hosts.append(host)
                    nodes.append(partner)
                    hashes.append(h)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.int32()), pa.array(hashes, pa.int64())], names=["host", "node", "hash"])


def main_text(html: str, wrapper: str | None, template: dict[int, int]) -> str:
    """A page's text outside the template; template: wrapper node -> digest of its constant text."""
    page = Page(html)
    inside = page.inside()
    constant: set[int] = set()
    number: list[int] = []
    if template and wrapper is not None:
        shape, number = page.folded()
        partners = matched(shape, wrapper)
        texts: dict[int, list[str]] = {}
        for node, _, text in page.pieces:
            if number[node] < len(partners) and partners[number[node]] in template:
                texts.setdefault(number[node], []).append(text)
        constant = {i for i, t in texts.items() if _digest(" ".join("".join(x for x in t if x.strip()).split())) == template[partners[i]]}
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.pieces:
        if inside[node] and not (constant and number[node] in constant):
            blocks.setdefault(block, []).append(text)
    joined = (" ".join(unescape("".join(t)).split()) for t in blocks.values())
    return " ".join(x for x in joined if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for html, wrapper, nodes, hashes in zip(*(b.column(c).to_pylist() for c in ("html", "wrapper", "nodes", "hashes")), strict=True):
            texts.append(main_text(html or "", wrapper, dict(zip(nodes or (), hashes or (), strict=True))))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(sizes)], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    kind = dict(pages.dtypes)["page_id"]
    pages = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"), F.lower(F.coalesce(F.regexp_extract("url", r"//([^/?#]*)", 1), F.lit(""))).alias("host"))
    skeletons = stored(pages.mapInArrow(_skeletons, "host string, shape string, content long, hashes array<long>"), "skeletons")
    shapes = skeletons.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"))
    wrappers = stored(shapes.groupBy("host").agg(F.max_by("shape", F.struct("n", "shape")).alias("wrapper")), "wrappers")
    different = skeletons.groupBy("host", "content").agg(F.min(F.struct("shape", "hashes")).alias("one")).select("host", "one.*")
    votes = different.join(wrappers, "host").mapInArrow(_votes, "host string, node int, hash long").groupBy("host", "node", "hash").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy("host", "node").agg(F.max(F.struct("n", "hash")).alias("top"), F.sum("n").alias("all")).where(F.col("top.n") >= F.greatest(F.lit(LEAST), F.col("all") * CONSTANT))
    template = top.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", F.col("top.hash").alias("hash")))).alias("t"))
    known = stored(wrappers.join(template, "host").select("host", "wrapper", F.col("t.node").alias("nodes"), F.col("t.hash").alias("hashes")), "templates")
    return pages.join(known, "host", "left").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    return extracted(table(spark, sf_dir, "pages"))
