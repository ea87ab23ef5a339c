"""Main text of web pages, by structure and by differencing with the page of the nearest URL.

Elements that are menus, headers, footers, sidebars, notices, adverts, forms, scripts or reader comments by their name, role
or class are left out. What is left are lines of three kinds: those that an article marks, or the main element where there is
no article; doubtful ones in it, whose element's class holds such a word beside others; and plain ones outside.

Every page is compared with the page of the same host whose URL path is nearest: both pages' lines are aligned by their longest
common subsequence, and shared lines are deleted, unless they are of an article, as copies of an article share them all. Plain
lines count only where no article or main element is marked, or what it marks is a small part of the page.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .archives import gathered
from .common import arrow_map, bounded_batches, written
from .sharding import with_slots

#: A page that shares more of its characters with its neighbour is a copy of it, which says nothing of its template.
COPY_SHARE = 0.8
#: So many pages on each side, in order of URLs, are tried until one is no copy. Equal pages count as one.
REACH = 4
#: Marked lines with at least this share of all characters that are left are the whole text.
MAIN_SHARE = 0.3
#: Pages, in order of URLs, that are compared in one go; each such block also gets REACH more from either side.
BLOCK_ROWS = 1000
#: Decisions, of 64 bytes and more, and their line numbers up to which they are broadcast: 32 MB.
MOST_BROADCAST, MOST_NUMBERS = 100_000, 4_000_000
#: Equal pages from which their decision is broadcast in any case: at most a HOT_ROWS-th as many as pages.
HOT_ROWS = 10_000
#: Kinds of lines.
ARTICLE, DOUBT, PLAIN = range(3)

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^'">]++)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
#: How a tag begins, of which the rest is missing at the end of a page.
TAG_START = re.compile(r"<[a-zA-Z/!?]")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
RAW = frozenset("script style noscript template textarea title iframe svg object canvas audio video".split())
RAW_END = {x: re.compile(rf"</{x}\s*(?:>|[^>]*>)", re.I) for x in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACE = frozenset("br td th".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
OUT = frozenset("head nav header footer aside form menu dialog select button datalist fieldset search".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
OUT_CLASSES = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification newsletter subscribe subscription popup modal overlay sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs header footer masthead comment comments commentlist disqus reply replies respond share sharing social teaser teasers related recommended recommendations widget pagination pager toolbar login signup skip".split()
)
#: Words of layout beside which such a word still says what the element is; a class with any other word is doubtful.
PARTS = frozenset("area areas bar bars block body bottom box boxes button buttons col container content form global group inner item items js left link links list main module outer page panel posts primary region right row secondary section site slot thread top ui unit wrap wrapper zone".split())
#: Beside such a word a class describes a layout, not what the element is.
LAYOUT = frozenset("no has with without".split())

Lines = list[str]


def outness(name: str, attributes: str, in_main: bool) -> int:
    """Whether an element is no part of the text, by name, role, class or id: 2 if it is none, 1 if it may be none, else 0."""
    if name in OUT:
        return 2
    if not attributes or name in ("html", "body", "main"):
        return 0
    most = 0
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in OUT_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return 2
        if key in ("class", "id"):
            for token in value.split():
                found = set(WORD.findall(CAMEL.sub(" ", token).lower()))
                told = found & OUT_CLASSES
                if not told or found & LAYOUT:
                    continue
                # An article's heading may be in a header of its own.
                if all(x in OUT_CLASSES or x in PARTS or x.isdecimal() for x in found) and not (in_main and told == {"header"}):
                    return 2
                most = 1
    return most


def is_main(name: str, attributes: str) -> bool:
    return name in MAIN or bool(attributes) and re.search(r"""\brole\s*=\s*["']?main\b""", attributes, re.I) is not None


class Tags:
    """Where the tags of a page begin, by name; made when first asked for."""

    def __init__(self, html: str):
        self.html, self.known = html, {}

    def closed_after(self, name: str, at: int, opened: int) -> bool:
        """Whether of `opened` open elements the end tags after `at` close the outermost too."""
        if name not in self.known:
            begin, end = ([m.start() for m in re.finditer(rf"<{slash}{re.escape(name)}(?![^\s/>])", self.html, re.I)] for slash in ("", "/"))
            self.known[name] = begin, end
        begin, end = self.known[name]
        return len(end) - bisect_left(end, at) - (len(begin) - bisect_left(begin, at)) >= opened


def parsed(html: str) -> list[tuple[str, int]]:
    """(text, kind) of the lines of a page, in order; what is out is not among them."""
    made: list[tuple[str, bool, bool, bool]] = []  # text, in an article, in a main element, doubtful
    stack: list[tuple[str, int, bool]] = []  # name, outness, main
    opened: Counter[str] = Counter()
    tags = Tags(html)
    out = doubt = main = article = heading = 0
    parts: list[str] = []
    at, last = 0, html.rfind(">") + 1  # no tag ends after that

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                made.append((text, article > 0, main > 0, doubt > 0))

    def drop(to: int) -> None:
        nonlocal out, doubt, main, article, heading
        while len(stack) > to:
            name, was_out, was_main = stack.pop()
            opened[name] -= 1
            out -= was_out == 2
            doubt -= was_out == 1
            main -= was_main
            article -= was_main and name == "article"
            heading -= name in HEADING

    while at < len(html):
        m = TAG.search(html, at, last) if at < last else None
        cut = m or TAG_START.search(html, at)
        text = html[at : cut.start()] if cut else html[at:]
        # A heading in an article's own header is part of the article.
        if text and (not out or main and heading and out == sum(o == 2 for n, o, _ in stack if n in ("header", "hgroup"))):
            parts.append(text)
        if not m:
            break
        at = m.end()
        if m[0].startswith(("<!--", "<![CDATA[")) and not m[0].endswith(("-->", "]]>")):
            break
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        end, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in BLOCK:
            flush()
        elif name in SPACE:
            parts.append(" ")
        if end:
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    drop(k)
                    break
            continue
        if name in RAW:
            close = RAW_END[name].search(html, at) if not attributes.rstrip().endswith("/") else None
            at = close.end() if close else at if attributes.rstrip().endswith("/") else len(html)
            continue
        if name in VOID:
            continue
        if name in BLOCK:  # ends an open paragraph, or an open item of the same list
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or name == "li" and stack[k][0] == "li":
                    drop(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        gone = outness(name, attributes, bool(main))
        kept = is_main(name, attributes) and gone < 2
        if kept and out and not main:
            # An element that is never closed doesn't hide the article; one that is closed after it does.
            first = next(k for k, x in enumerate(stack) if x[1] == 2)
            outer = stack[first][0]
            if not tags.closed_after(outer, at, sum(x[0] == outer for x in stack[first:])):
                drop(first)
        kept = kept and not out
        stack.append((name, gone, kept))
        opened[name] += 1
        out += gone == 2
        doubt += gone == 1
        main += kept
        article += kept and name == "article"
        heading += name in HEADING
        if gone == 2 and name not in BLOCK:
            parts.append(" ")
    flush()
    # Beside an article the rest of the main element is no more than plain.
    articles = any(x[1] for x in made)
    return [(x, PLAIN if not (a if articles else m) else DOUBT if d else ARTICLE) for x, a, m, d in made]


def lines(html: str) -> tuple[Lines, Lines]:
    """The text lines in article or main elements, and those elsewhere; what is out is in neither."""
    made = parsed(html)
    return [x for x, k in made if k != PLAIN], [x for x, k in made if k == PLAIN]


def host_path(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (m[1].rpartition("@")[2].lower(), m[2]) if m else ("", url or "")


def shared(a: list, b: list) -> set[int]:
    """Numbers of the lines of `a` in a longest common subsequence of `a` and `b`."""
    n = min(len(a), len(b))
    first = next((k for k in range(n) if a[k] != b[k]), n)
    last = next((k for k in range(n - first) if a[-1 - k] != b[-1 - k]), n - first)
    out = {*range(first), *range(len(a) - last, len(a))}
    in_a, in_b = Counter(a[first : len(a) - last]), Counter(b[first : len(b) - last])
    left = [i for i in range(first, len(a) - last) if a[i] in in_b]
    right = [x for x in b[first : len(b) - last] if x in in_a]
    pairs = sum(n * in_b[x] for x, n in in_a.items() if x in in_b)
    middle = [a[i] for i in left]
    find = by_pairs if pairs <= 8 * (len(left) + len(right)) else by_bits
    return out | {left[i] for i in find(middle, right)}


def by_pairs(a: list, b: list) -> set[int]:
    """For lines that few others equal: time grows with the pairs of equal lines."""
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    ends: list[int] = []  # the smallest end in b of a common subsequence of each length
    chain: list[tuple[int, tuple | None]] = []
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k], chain[k] = j, link
    out, link = set(), chain[-1] if chain else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def prefix_lengths(a: list, b: list) -> np.ndarray:
    """The length of a longest common subsequence of `a` and each beginning of `b`, a bit of a long integer for each line
    of `b`."""
    m = len(b)
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    masks: dict = {}
    for x, at in places.items():
        if len(at) >= 8:
            flags = np.zeros(m, bool)
            flags[at] = True
            masks[x] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    full = (1 << m) - 1
    v = full
    for x in a:
        mask = masks.get(x)
        if mask is None:
            mask = 0
            for j in places.get(x, ()):
                mask |= 1 << j
        u = v & mask
        v = (v + u | v - u) & full
    zeros = 1 - np.unpackbits(np.frombuffer(v.to_bytes(m // 8 + 1, "little"), np.uint8), bitorder="little")[:m].astype(np.int64)
    return np.concatenate(([0], np.cumsum(zeros)))


def by_bits(a: list, b: list) -> set[int]:
    """For lines that repeat: halves of `a` are matched with the parts of `b` that give the longest subsequence."""
    out: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.add(a0)
            continue
        mid = (a0 + a1) // 2
        front = prefix_lengths(a[a0:mid], b[b0:b1])
        back = prefix_lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int(np.argmax(front + back))
        todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return out


def shared_with(own: list, sizes: list[int], neighbours: list[list]) -> set[int]:
    """Numbers of the lines of `own` that it shares with the first of its neighbours that isn't a copy of it."""
    total = sum(sizes)
    for other in neighbours:
        gone = shared(own, other)
        if sum(sizes[i] for i in gone) <= COPY_SHARE * total:
            return gone
    return set()


def without_shared(own: Lines, neighbours: list[Lines]) -> Lines:
    """`own` without the lines that it shares with the first of its neighbours that isn't a copy of it."""
    gone = shared_with(own, [len(x) for x in own], neighbours)
    return [x for i, x in enumerate(own) if i not in gone]


def chosen(kinds: bytes | list[int], sizes: list[int], gone: set[int]) -> list[int]:
    """Numbers of the lines that are the text, given those that are shared with a neighbour."""
    marked = [i for i, k in enumerate(kinds) if k == ARTICLE or k == DOUBT and i not in gone]
    plain = [i for i, k in enumerate(kinds) if k == PLAIN and i not in gone]
    n, m = sum(sizes[i] for i in marked), sum(sizes[i] for i in plain)
    return marked if not plain or n and n >= MAIN_SHARE * (n + m) else sorted([*marked, *plain])


def content_key(host: str, made: list[tuple[str, int]]) -> bytes:
    """128 bits that the host, the lines and their kinds decide."""
    h = hashlib.blake2b(digest_size=16)
    for x in (host, *(f"{k}{t}" for t, k in made)):
        data = x.encode("utf-8", "surrogatepass")
        h.update(len(data).to_bytes(8, "little") + data)
    return h.digest()


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


OUTLINE = "key binary, host string, path string, url string, page_id long, hashes array<long>, kinds binary, sizes array<int>"


def outlines(pages: DataFrame) -> DataFrame:
    """OUTLINE and n, how many pages it stands for, of each different page of a host: eight bytes a line, no text. The page
    with the first URL stands for its equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for page, url, source in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
                    (host, path), made = host_path(url), parsed(source or "")
                    yield {"key": content_key(host, made), "host": host, "path": path, "url": url, "page_id": page, "hashes": [line_hash(t) for t, _ in made], "kinds": bytes(k for _, k in made), "sizes": [len(t) for t, _ in made]}

        yield from gathered(rows(), schema, size=lambda r: 16 * len(r["sizes"]))

    schema = T._parse_datatype_string(OUTLINE)
    every = pages.mapInArrow(run, schema)
    place = F.min(F.struct("path", "url", "page_id")).alias("place")
    one = every.groupBy("key").agg(F.count("*").alias("n"), place, *[F.first(c).alias(c) for c in ("host", "hashes", "kinds", "sizes")])
    return one.select("key", "host", "place.*", "hashes", "kinds", "sizes", "n")


def decisions(pages: DataFrame) -> DataFrame:
    """(key, keep, n): the line numbers that are the text of pages whose neighbour makes a difference, and of those that
    very many pages equal."""
    # Gapless numbers in order of the URLs: the neighbours are the numbers around, whatever the size of a host.
    found = written(outlines(pages), "html-outlines")
    placed = with_slots(found.withColumn("every", F.lit(0)), ["host", "path", "url", "page_id", "key"], "every").drop("every")
    block = lambda n: F.floor((F.col("slot") + n) / BLOCK_ROWS)
    dealt = placed.withColumn("block", F.explode(F.array_distinct(F.array(block(-REACH), block(0), block(REACH)))))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "slot")
    schema = T._parse_datatype_string("key binary, keep array<int>, n long")

    def compared(row: dict, before: list[dict], after: list[dict]) -> dict | None:
        near = [(k, x) for rows in (before[::-1], after) for k, x in enumerate(rows) if x["host"] == row["host"]]
        near.sort(key=lambda x: (-len(commonprefix([x[1]["path"], row["path"]])), x[0]))
        keep = chosen(row["kinds"], row["sizes"], shared_with(row["hashes"], row["sizes"], [x["hashes"] for _, x in near]))
        if keep == chosen(row["kinds"], row["sizes"], set()) and row["n"] <= HOT_ROWS:
            return None
        return {"key": row["key"], "keep": keep, "n": row["n"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            window: deque = deque()  # up to REACH rows before the next to compare, itself, and those after it
            at = 0  # the next to compare
            for row in stream(batches):
                if row is None or window and window[-1]["block"] != row["block"]:
                    while at < len(window):
                        yield from one(window, at)
                        at += 1
                    window.clear()
                    at = 0
                if row is None:
                    return
                window.append(row)
                while len(window) - at > REACH:
                    yield from one(window, at)
                    at += 1
                while at > REACH:
                    window.popleft()
                    at -= 1

        def one(window: deque, at: int) -> Iterator[dict]:
            row, held = window[at], list(window)
            if row["slot"] // BLOCK_ROWS == row["block"]:
                made = compared(row, held[max(0, at - REACH) : at], held[at + 1 : at + 1 + REACH])
                if made:
                    yield made

        yield from gathered(rows(), schema, size=lambda r: 4 * len(r["keep"]))

    return written(dealt.mapInArrow(run, schema), "html-decisions")


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict | None]:
    """Rows, and None at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from batch.slice(at, 64).to_pylist()
    yield None


def decided(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The left join of `rows` with decisions by key. Texts are shuffled only if there are too many decisions to broadcast;
    those for very many pages are broadcast in any case."""
    count, numbers = found.agg(F.count("*"), F.sum(F.size("keep"))).first()
    found = found.withColumnRenamed("key", "known")
    meets = F.col("key") == F.col("known")
    if count <= MOST_BROADCAST and (numbers or 0) <= MOST_NUMBERS:
        return rows.join(F.broadcast(found), meets, "left")
    hot = F.broadcast(found.where(F.col("n") > HOT_ROWS))
    others = rows.join(hot.select("known"), meets, "left_anti").join(found.where(F.col("n") <= HOT_ROWS), meets, "left")
    return rows.join(hot, meets).unionByName(others)


def extracted(pages: DataFrame, *, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars per row of `pages`.

    Only these three columns are read, so others may have any name. A null or empty html has an empty text; a null url is
    of no host, and such pages are each other's neighbours; a null id stays null; rows that repeat each give a row and are
    copies of one another; a page of any length is one row; an empty table gives none. Neighbours at the same distance: the
    one before goes first. Pages are ordered by host, path, url and id.
    """
    bounded_batches(pages.sparkSession)
    read = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict = {"page_id": batch["page_id"], "url": batch["url"], "key": [], "lines": [], "usual": []}
        for address, source in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
            made = parsed(source or "")
            out["key"].append(content_key(host_path(address)[0], made))
            out["lines"].append([t for t, _ in made])
            out["usual"].append(chosen([k for _, k in made], [len(t) for t, _ in made], set()))
        return out

    texts = arrow_map(read, rows, "page_id long, url string, key binary, lines array<string>, usual array<int>")
    found = decided(texts, decisions(read))
    text = F.array_join(F.transform(F.coalesce("keep", "usual"), lambda i: F.get("lines", i)), "\n\n")
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_html(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
