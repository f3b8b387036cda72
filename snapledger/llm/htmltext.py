"""Main text of web pages: page differencing between neighbours by URL, on top of a block reader.

1. A reader turns a page into blocks of text. What HTML itself declares as no part of the article
   (scripts, styles, forms, navigation, headers, footers, asides, and elements with a class, id or role
   that says advert, notice, sidebar, comments and the like and nothing else) makes no blocks, nor does
   a block outside an ``<article>`` or ``<main>`` that is mostly links. All other blocks are candidates,
   unless declared articles outweigh the rest of the page, or the other way round, by ``OUTWEIGHED``.
2. All pages are differenced. Within each host the pages are sorted by the path of their URL; every
   page is paired with the neighbour whose path shares most leading parts, and their lines are aligned
   by a longest common subsequence. A neighbour that is a copy (four fifths or more of the lines
   shared) says nothing about the template and is passed over.
3. A shared line is deleted as part of the site's template, unless its place speaks for it. Prose (a
   paragraph, heading, list item and the like) between two lines of the page's own stays, and so does
   any line between two own lines of a declared article, and all prose of one. No count decides: what
   happens to a line does not depend on how many pages there are.

Only hashes of the lines are sorted and joined. The order over all hosts is one range partitioning
with positions counted on, so a host with a third of all pages is dealt over many tasks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import col, free_name, running_starts, shuffled, text_or_empty, written

#: Elements of HTML that hold no article text, by the standard's meaning of the tag.
EXCLUDED = frozenset("head nav footer aside form script style noscript template iframe object svg canvas audio "
                     "video button select textarea datalist dialog menu title".split())
#: Raw text elements: nothing in them is markup.
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run on within a line; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
#: Words of a class, id or role that mark an element as no part of the article.
NOISE = frozenset("ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner sidebar "
                  "nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices "
                  "newsletter subscribe subscription signup popup modal overlay comment comments reply replies respond "
                  "disqus share sharing social related recommended pagination pager widget toolbar complementary "
                  "contentinfo search skip masthead topbar login".split())
#: Words that may stand beside them in one name without changing what it says; with any other word it says something else.
BESIDE = frozenset("area bar block body box button buttons container form inner item items left link links list outer page post "
                   "posts right section side site slot thread top unit bottom wrapper".split())
#: Words in the class or role of an ``<article>`` or ``<main>`` that mark it as no article.
NO_ARTICLE = frozenset("comment reply ad advert sponsored promo related widget".split())
#: Elements whose id says what they are about, not what they are for.
SECTIONS = frozenset("h1 h2 h3 h4 h5 h6 section article main".split())
#: Elements of running text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th caption figcaption".split())
#: So many times the characters make declared articles, or the rest of the page, all of the main text.
OUTWEIGHED = 5
IN_ARTICLE, IS_PROSE = 1, 2
COPY = 0.8
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
                 r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?][^<>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
PATH = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")


def _says(value: str, words: frozenset[str]) -> bool:
    """Whether one of the names in a class, id or role is made of such words, and of words that mean nothing beside them."""
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if not words.isdisjoint(parts) and all(x in words or x in BESIDE for x in parts):
            return True
    return False


def _noise(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in EXCLUDED or tag == "header" and not in_main:
        return True
    if not attributes:
        return False
    words = NO_ARTICLE if tag in ("article", "main") else NOISE if in_main else NOISE | {"header"}
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "role") and tag not in ("html", "body") or name == "id" and tag not in SECTIONS | {"html", "body"}:
            if _says(value, words):
                return True
        if name == "hidden":
            return True
        if name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """Text blocks of a page in order, each with flags: whether it is inside a declared article, and prose."""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    linked = [0, 0]  # characters inside links, and all, of the block at hand
    opened: list[tuple[str, bool, bool]] = []  # tag, whether it hides, whether it is an article
    count: Counter = Counter()
    hidden = main = links = 0

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        # Outside an article, a block that is mostly links is a menu.
        if text and (main or 2 * linked[0] <= linked[1]):
            inside = next((tag for tag, *_ in reversed(opened) if tag not in INLINE), "")
            out.append((text, IN_ARTICLE * (main > 0) + IS_PROSE * (inside in PROSE)))
        buffer.clear()
        linked[:] = [0, 0]

    def close(to: int) -> None:
        nonlocal hidden, main
        while len(opened) > to:
            tag, hides, article = opened.pop()
            count[tag] -= 1
            hidden -= hides
            main -= article

    at = 0
    while at < len(page):
        found = TAG.search(page, at)
        text = page[at:found.start()] if found else page[at:]
        if text and not hidden:
            text = html.unescape(text)
            buffer.append(text)
            size = len("".join(text.split()))
            linked[1] += size
            linked[0] += size if links else 0
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        ends, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if tag == "a":
            links = not ends
        if tag in INLINE or tag in VOID:
            if tag == "br":
                buffer.append(" ")
            elif tag in VOID:
                if tag not in INLINE:
                    flush()
                continue
            if not (attributes and not ends and _noise(tag, attributes, main > 0)) and not (ends and count[tag]):
                continue
        else:
            flush()
            links = False
        if ends:
            if count[tag]:
                close(max(i for i in range(len(opened)) if opened[i][0] == tag) if opened[-1][0] != tag
                      else len(opened) - 1)
            continue
        if tag not in INLINE and opened and opened[-1][0] in ("p", tag) and (opened[-1][0] == "p" or tag in ("li", "p", "dt", "dd",
                                                                                                        "tr", "td", "th",
                                                                                                        "option")):
            close(len(opened) - 1)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if attributes.endswith("/") and tag in INLINE:
            continue
        hides = not hidden and _noise(tag, attributes, main > 0)
        article = tag in ("article", "main") and not hides and not hidden
        opened.append((tag, hides, article))
        count[tag] += 1
        hidden += hides
        main += article
    flush()
    return out


def candidate_blocks(page: str) -> list[tuple[str, int]]:
    """The blocks that may be the main text: all, but for the lighter of declared articles and the rest if the other
    outweighs it."""
    found = blocks(page)
    declared = sum(len(text) for text, flags in found if flags & IN_ARTICLE)
    rest = sum(len(text) for text, _ in found) - declared
    if declared > OUTWEIGHED * rest:
        return [x for x in found if x[1] & IN_ARTICLE]
    return [x for x in found if not x[1] & IN_ARTICLE] if rest > OUTWEIGHED * declared else found


def template_places(shared: list[int], flags: list[int]) -> list[int]:
    """Which of the lines that a page shares with its neighbour are the site's and not its own."""
    apart = set(range(len(flags))).difference(shared)
    first, last = min(apart, default=len(flags)), max(apart, default=-1)

    def falls(i: int) -> bool:
        edge = i < first or i > last
        if flags[i] & IN_ARTICLE:
            return edge and not flags[i] & IS_PROSE
        return edge or not flags[i] & IS_PROSE
    return [i for i in shared if falls(i)]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of two lists of line hashes.

    Lines that the other list lacks, and common ends, are set aside first. The rest is worked out
    with one bit per line of ``b``, halving ``a`` (Hirschberg) while the table would be large.
    """
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    there, here = set(b[start:len(b) - end]), set(a[start:len(a) - end])
    left = [i for i in range(start, len(a) - end) if a[i] in there]
    other = [x for x in b[start:len(b) - end] if x in here]
    middle = [left[i] for i in _aligned([a[i] for i in left], other)]
    return [*range(start), *middle, *range(len(a) - end, len(a))]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of ``a``, a number whose zero bits mark where the subsequence grows along ``b``."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        match = row & where.get(x, 0)
        row = (row + match | row - match) & every
        yield row


def _aligned(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > 1 << 28:
        half = len(a) // 2
        ahead = _lengths(a[:half], b)
        behind = _lengths(a[half:][::-1], b[::-1])[::-1]
        split = int((ahead + behind).argmax())
        return _aligned(a[:half], b[:split]) + [half + i for i in _aligned(a[half:], b[split:])]
    rows = [(1 << len(b)) - 1, *_rows(a, b)]
    found, j = [], len(b) - 1
    for i in range(len(a), 0, -1):
        # Zero bits at or below j that row i has and row i - 1 lacks: a line of ``a`` that counts.
        mask = (1 << j + 1) - 1
        if ((rows[i] ^ mask) & mask).bit_count() > ((rows[i - 1] ^ mask) & mask).bit_count():
            found.append(i - 1)
            while b[j] != a[i - 1]:
                j -= 1
            j -= 1
    return found[::-1]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every prefix of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007 - the last one is wanted
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(bits[:len(b)] == 0)])


def _hashes(lines: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(line) - (1 << 63) for line in lines]


def _url_parts(url: str | None) -> tuple[str, list[str]]:
    found = PATH.match(url or "")
    return (found[1].lower(), [x for x in found[2].split("/") if x]) if found else ("", [])


def template_lines(pages: DataFrame, url: str, page: str, copy: float = COPY) -> DataFrame:
    """``_host``, ``_lines`` (the key of a page's lines) and the places of its lines that are the site's."""
    @F.pandas_udf("_host string, _path array<string>, _hashes array<bigint>, _flags array<int>, _lines string")
    def lines(urls: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for target, text in zip(urls, texts, strict=True):
            found = candidate_blocks(text)
            host, path = _url_parts(target)
            out.append((host, path, _hashes([x for x, _ in found]), [x for _, x in found], _key(found)))
        return pd.DataFrame(out, columns=["_host", "_path", "_hashes", "_flags", "_lines"])

    every = (pages.select(lines(col(url).cast("string"), text_or_empty(page)).alias("_p")).select("_p.*")
                  .where(F.size("_hashes") > 0)
                  .groupBy("_host", "_lines").agg(F.min(F.struct("_path", "_hashes", "_flags")).alias("_p"))
                  .select("_host", "_lines", "_p.*"))
    ordered = written(every, "page-lines").repartitionByRange("_host", "_path", "_lines")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            batch["_task"], batch["_at"] = task, range(n, n + len(batch))
            n += len(batch)
            yield batch

    numbered = written(ordered.sortWithinPartitions("_host", "_path", "_lines")
                       .mapInPandas(number, "_host string, _lines string, _path array<string>, _hashes array<bigint>, "
                                            "_flags array<int>, _task int, _at bigint"), "page-order")
    starts = running_starts(numbered.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")), "_task", "_n")
    spark = pages.sparkSession
    firsts = spark.createDataFrame(list(starts.items()), "_task int, _first bigint")
    placed = numbered.join(F.broadcast(firsts), "_task").withColumn("_at", F.col("_at") + F.col("_first"))
    near = placed.select(F.col("_host").alias("_h"), "_path", "_hashes", "_at")
    beside = near.select((F.col("_at") + 1).alias("_at"), F.struct("_h", "_path", "_hashes").alias("_before")).join(
        near.select((F.col("_at") - 1).alias("_at"), F.struct("_h", "_path", "_hashes").alias("_after")), "_at", "full")

    @F.pandas_udf("array<int>")
    def fallen(host: pd.Series, path: pd.Series, hashes: pd.Series, flags: pd.Series, before: pd.DataFrame,
               after: pd.DataFrame) -> pd.Series:
        out = []
        for i, name in enumerate(host):
            mine, found = [int(x) for x in hashes[i]], []
            beside = [x for x in (before.iloc[i], after.iloc[i]) if x["_h"] == name and x["_hashes"] is not None]
            beside.sort(key=lambda x: -_shared_parts(list(path[i]), list(x["_path"])))
            for x in beside:
                found = common_lines(mine, [int(y) for y in x["_hashes"]])
                if len(found) < copy * len(mine):
                    break
                found = []
            out.append(template_places(found, list(flags[i])))
        return pd.Series(out)

    return (placed.join(beside, "_at", "left")
            .select("_host", "_lines", fallen("_host", "_path", "_hashes", "_flags", "_before", "_after").alias("_drop"))
            .where(F.size("_drop") > 0))


def _shared_parts(a: list[str], b: list[str]) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _key(found: list[tuple[str, int]]) -> str:
    return xxhash.xxh128_hexdigest("\n".join(f"{flags} {text}" for text, flags in found))


def extract(pages: DataFrame, *, url: str = "url", page: str = "html", text: str = "text",
            copy: float = COPY) -> DataFrame:
    """The rows with the main text added in column ``text`` (replaced if there), empty if there is none.

    Null page: the empty page. Null URL or one without a host: such pages are neighbours of each
    other. Repeated rows have equal results and count once as neighbours. Whole pages are read.
    """
    drops = written(template_lines(pages, url, page, copy), "template-lines")

    @F.pandas_udf("_host string, _lines string, _blocks array<string>")
    def read(urls: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for target, value in zip(urls, texts, strict=True):
            found = candidate_blocks(value)
            out.append((_url_parts(target)[0], _key(found), [x for x, _ in found]))
        return pd.DataFrame(out, columns=["_host", "_lines", "_blocks"])

    kept = pages.drop(text) if text != page and text in pages.columns else pages
    p, d = free_name(kept, "_page"), free_name(kept, "_drops")
    drops = drops.select(F.col("_host").alias(f"{d}h"), F.col("_lines").alias(f"{d}l"), F.col("_drop").alias(d))
    rows = kept.withColumn(p, read(col(url).cast("string"), text_or_empty(page)))
    joined = rows.join(shuffled(drops), (F.col(p)["_host"] == F.col(f"{d}h")) & (F.col(p)["_lines"] == F.col(f"{d}l")), "left")
    left = F.filter(F.col(p)["_blocks"], lambda x, i: F.coalesce(~F.array_contains(F.col(d), i), F.lit(True)))
    return joined.withColumn(text, F.array_join(left, "\n")).select(*[col(c) for c in kept.columns if c != text], text)
