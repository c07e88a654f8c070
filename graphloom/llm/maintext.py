"""Main text of web pages through a suffix array of each host, with landmarks as weights.

A page is parsed once into blocks, each with one of five kinds: *kept* (prose inside an article, or inside main on a page without
an article), *menu* (inside it, mostly link text), *weak* (inside it, under an element whose class or id only holds a word that
chrome uses, as in ``related-work``), *open* (all else on a page without article and main) and *chrome* (menus, headers, footers,
sidebars, notices, adverts, forms, comments by element, role, or a class or id that says nothing else; on a page with an article
all that stands outside it).

The words of all blocks, kept ones and chrome too, in page order with a separator between blocks, are the page's token stream; equal
pages of a host have one stream. Suffixes of all streams are sorted by host: first by their first ``run / 4`` words, as text, then by
prefix doubling, so that ranks of suffixes i and i + n give the order by 2n words. Each round is a range sort in Spark of the distinct
prefixes, numbered in that order; prefixes that stand in fewer than ``least`` distinct pages end there, as no longer one can be
frequent. What is left after two rounds are the runs of ``run`` words that repeat; blocks of fewer words are compared whole.
Overlapping runs make up longer matches: every run inside a longer match stands in all of its pages, so the words that frequent runs
cover are those that frequent matches of ``run`` words or more cover, whatever their length.

Most runs of prose stand in one page. Before any suffix is shuffled, each task counts digests of all runs of ``run`` words and of all
short blocks over the pages it holds: what stands in a share of the host's pages (``least`` of them at least) has to stand in that
share of the host's rows in some group of them, or it cannot add up. Such digests set bits of a bitmap of fixed size, those whose bit
is set are counted over all groups, and those that reach the share make a second bitmap. Only the suffixes that the doubling needs for
a run whose bit is set there go on; a false bit lets more in, none is lost.

Landmarks weigh what a repeat means, by the share of the host's distinct pages (``least`` of them at least) that a run has to stand in
for its words to go: none in chrome, which goes if it stands in one page alone, ``share`` in open and weak blocks, ``menu_share`` in
menu blocks. Kept blocks are whole, however often other pages repeat them, but their words count as repeats of others'; a
run that holds words of one weighs on no block beside it.
``n_repeated`` counts the words outside chrome that a page lost to repeats.

Defined cases: null or empty html gives an empty text; a page cut off in a tag loses the tag only; unclosed elements end with
the page; a null url is the host ''; a page's copies are one page in all counts; repeated rows are all returned; an empty table
gives an empty result; other columns, of any name, are not read.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import SLICE, mix, prefix_sums, slices, span_hash, strings, tokens
from ._common import cut, parts_for, plan_bytes

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "audio", "video", "select", "datalist", "noembed", "noframes", "xmp"}
CHROME = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "head", "input", "label", "output", "progress"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Words of class and id that name chrome, and words that may stand beside them without naming anything else.
CHROME_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adslot", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "paywall", "popup", "promo", "promos", "promotion", "recommended", "recommendations", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget"}
FILLER_WORDS = {"area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "form", "global", "group", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "message", "outer", "overlay", "page", "panel", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "stories", "thread", "to", "top", "unit", "widgets", "wrap", "wrapper"}
WORD_OF_CLASS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_a-zA-Z]+")
CHROME_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar", "note"}
DROPPED, OPEN, KEPT, WEAK, MENU = range(5)
#: The word that stands between blocks; words of a text hold no white space.
EDGE = "\n"
#: Bits of the bitmap of runs that may repeat, words that a task counts at a time, and bytes of the parsed table that a task reads.
FILTER_BITS, GROUP_WORDS, PART_BYTES = 1 << 26, 1 << 22, 12 << 20
#: Of a number that holds the digest of a run and, in its low bits, the page that has it.
DIGEST_BITS, PAGE_BITS = 40, 23
ODD = 0x9E3779B97F4A7C15


def class_weight(value: str) -> int:
    """2 if a name of the class or id says chrome and nothing else, 1 if it says chrome and more, else 0."""
    best = 0
    for name in value.split():
        words = [w.lower() for w in WORD_OF_CLASS.findall(name) if len(w) > 1]
        if any(w in CHROME_WORDS for w in words):
            best = max(best, 2 if all(w in CHROME_WORDS or w in FILLER_WORDS for w in words) else 1)
    return best


def chrome_weight(name: str, attributes: str, inside_article: bool) -> int:
    """2 for an element that is chrome, 1 for one that may be, else 0."""
    if name in CHROME and not (name == "header" and inside_article):
        return 2
    if "=" not in attributes and "hidden" not in attributes.lower():
        return 0
    best = 0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id") and name not in ("body", "html", "article", "main"):
            best = max(best, class_weight(value))
        if key in ("class", "id") and name in ("article", "main") and re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", value, re.I):
            best = 2
        if key == "role" and value.lower() in CHROME_ROLE or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            best = 2
    return best


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of a page's blocks in page order; blocks without ink are left out."""
    page, out, held = page or "", [], []
    stack: list[tuple] = []  # name, and inside how many chrome, weak, article, main and link elements
    chrome = weak = article = main = link = linked = at = 0
    saw = [False, False]

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((text, chrome > 0, article > 0, main > 0, MENU if 2 * linked >= sum(len(h.strip()) for h in held) else WEAK if weak else KEPT, weak > 0))
            held.clear()
        linked = 0

    def hold(text: str) -> None:
        nonlocal linked
        held.append(text)
        if link:
            linked += len(text.strip())

    end = len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            hold(page[at:])
            break
        if m.start() > at:
            hold(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if page.startswith("<![CDATA[", m.start()):
                hold(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        closing, attributes = m[1] or m[4], m[3] if m[2] else m[6]
        if name in RAW and not closing:
            if not attributes.endswith("/") or name not in ("svg", "math"):
                stop = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)|\Z", re.I).search(page, at)
                at = max(stop.end(), at)
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            held.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    _, chrome, weak, article, main, link = stack[k]
                    del stack[k:]
                    break
        elif name not in VOID:
            if not attributes.endswith("/") or name in BLOCK:
                weight = chrome_weight(name, attributes, article > 0)
                if weight:
                    flush()
                stack.append((name, chrome, weak, article, main, link))
                if name == "p":  # a paragraph does not nest: an open one ends here
                    for k in range(len(stack) - 2, -1, -1):
                        if stack[k][0] in BLOCK:
                            if stack[k][0] == "p":
                                del stack[k : len(stack) - 1]
                            break
                chrome, weak, link = chrome + (weight == 2), weak + (weight == 1), link + (name == "a")
                if not chrome:
                    article, main = article + (name == "article"), main + (name == "main")
                    saw[0], saw[1] = saw[0] or name == "article", saw[1] or name == "main"
    flush()
    inside = 2 if saw[0] else 3
    if not any(saw):
        return [(b[0], DROPPED if b[1] else OPEN) for b in out]
    return [(b[0], DROPPED if b[1] or not b[inside] else b[4]) for b in out]


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, stream, texts, kinds): the blocks of every page, with a digest of its token stream."""

    def step(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                found = [blocks(page) for page in part.column("html").to_pylist()]
                columns = [
                    part.column("page_id"), part.column("url"), pa.array([host_of(u) for u in part.column("url").to_pylist()], pa.string()),
                    pa.array([xxhash.xxh3_128_digest(EDGE.join(t for t, _ in own)) for own in found], pa.binary()),
                    pa.array([[t for t, _ in own] for own in found], pa.list_(pa.string())), pa.array([[k for _, k in own] for own in found], pa.list_(pa.int8())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "stream", "texts", "kinds"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        step, f"page_id {kind}, url string, host string, stream binary, texts array<string>, kinds array<tinyint>"
    )


def token_stream(texts: list[str]) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of the blocks with EDGE before, between and after them, and (place, number) of each block's words."""
    words, places = [EDGE], []
    for t in texts:
        own = t.split()
        places.append((len(words), len(own)))
        words += own
        words.append(EDGE)
    return words, places


def page_slices(batch):
    """Row ranges of a batch with about ``SLICE`` bytes of block texts each; one long page makes a range of its own."""
    texts = batch.column("texts")
    _, off = strings(texts.values)
    off, n, at = off[texts.offsets.to_numpy()], batch.num_rows, 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(off, off[at] + SLICE, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def word_digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digests of words for buckets, over about ``SLICE`` bytes at a time, as a long page may have many more."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to, low = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE))), starts[at]
        out[at:to] = span_hash(prefix_sums(raw[low : ends[to - 1]]), starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def run_digests(value: np.ndarray, run: int) -> np.ndarray:
    """A digest of every ``run`` neighbours, by doubling."""
    out, size = value, 1
    for bit in f"{run:b}"[1:]:
        out, size = out[: max(0, len(out) - size)] * np.uint64(pow(ODD, size, 1 << 64)) + out[size:], 2 * size
        if bit == "1":
            out, size = out[: max(0, len(out) - 1)] * np.uint64(ODD) + value[size:], size + 1
    return out


def digests(batch, run: int) -> tuple[np.ndarray, ...]:
    """Of the pages of a batch (host, texts): (page, at, digest) of every run of ``run`` words and (page, block, at, words, digest) of
    each block of fewer words; ``at`` is a place in the page's token stream, ``block`` counts within the page."""
    texts, pages = batch.column("texts"), np.arange(batch.num_rows)
    cells = texts.offsets.to_numpy().astype(np.int64)
    raw, off = strings(texts.values.slice(cells[0], cells[-1] - cells[0]))
    cells = cells - cells[0]
    starts, ends, first = tokens(raw, off)
    size, own = np.diff(first), np.repeat(pages, np.diff(cells))  # of each block: its words, its page
    block = np.repeat(np.arange(len(own)), size)
    begin = first[cells] + cells + np.arange(len(cells))  # of each page's stream: an edge first, and one after each block
    value = np.full(begin[-1], ODD, np.uint64)
    words = word_digests(raw, starts, ends)
    value[np.arange(len(words)) + block + own[block] + 1] = words
    seed = np.array([xxhash.xxh64_intdigest(h) for h in batch.column("host").to_pylist()], np.uint64)
    mask = np.uint64((1 << DIGEST_BITS) - 1)
    room = np.maximum(0, np.diff(begin) - run + 1)
    page = np.repeat(pages, room)
    at = np.arange(len(page)) - np.repeat(np.cumsum(room) - room, room)
    runs = mix(run_digests(value, run)[begin[page] + at] ^ seed[page]) & mask
    # a block of few words, as the sum of its words mixed with their places
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + (np.arange(len(words)) - first[block]).astype(np.uint64) * np.uint64(ODD)))])
    short = np.flatnonzero(size < run)
    whole = mix((sums[first[short + 1]] - sums[first[short]]) ^ mix(seed[own[short]] + np.uint64(1))) & mask
    return page, at, runs, own[short], short - cells[own[short]], first[short] + short + own[short] - begin[own[short]], size[short], whole


def set_bits(bits: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """The indexes of the digests whose bit is set."""
    slot = digest & np.uint64(FILTER_BITS - 1)
    return np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)


def bitmap(found: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which the column ``digest`` has set bits."""
    slot = F.col("digest").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    bits = found.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toArrow()
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for part, cell in zip(bits.column("part").to_pylist(), bits.column("bits").to_pylist(), strict=True):
        out[part - 1, : len(cell)] = np.frombuffer(cell, np.uint8)
    return out.ravel()


def tallies(rows: DataFrame, sizes: DataFrame, run: int, share: float, least: int, bits: np.ndarray | None = None) -> DataFrame:
    """(digest, found, need): in how many of its rows a group has a run or short block, and how many pages of the host it needs. Without
    ``bits`` those that have the group's part of these, with ``bits`` all whose bit is set."""
    shared = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)

    def step(batches):
        held, hosts, own, need, n = [], {}, [], [], 0

        def counted():
            all_, copies = np.array(need, float).T
            # a host's pages with a run add up to what it needs over all groups of its rows, so one group has its part of them or more
            part = all_ if shared is not None else all_ / copies * np.bincount(own, minlength=len(need))
            keys = np.sort(np.concatenate(held))
            keys = keys[np.diff(keys, prepend=-1) != 0]
            digest = keys >> PAGE_BITS
            begin = np.flatnonzero(np.diff(digest, prepend=-1))
            count = np.diff(begin, append=len(keys))
            lowest = np.minimum.reduceat(part[own][keys & ((1 << PAGE_BITS) - 1)], begin) if len(keys) else np.zeros(0)
            fits = slice(None) if shared is not None else count >= lowest - 1e-6
            return pa.RecordBatch.from_arrays([pa.array(digest[begin][fits]), pa.array(count[fits]), pa.array(lowest[fits])], ["digest", "found", "need"])

        for batch in batches:
            for piece in page_slices(batch):
                page, _, runs, block, *_, whole = digests(piece, run)
                page, digest = np.concatenate([page, block]), np.concatenate([runs, whole])
                if shared is not None:
                    some = set_bits(shared.value, digest)
                    page, digest = page[some], digest[some]
                held.append(digest.astype(np.int64) << PAGE_BITS | page + len(own))
                for host, size, copies in zip(*(piece.column(c).to_pylist() for c in ("host", "size", "copies")), strict=True):
                    if host not in hosts:
                        hosts[host] = len(hosts)
                        need.append((max(least, share * size), copies))
                    own.append(hosts[host])
                n += len(page) + piece.num_rows
                if n >= GROUP_WORDS:
                    yield counted()
                    held, hosts, own, need, n = [], {}, [], [], 0
        if held:
            yield counted()

    return rows.join(sizes, "host").select("host", "texts", "size", "copies").mapInArrow(step, "digest long, found long, need double")


def may_repeat(rows: DataFrame, sizes: DataFrame, head: int, run: int, share: float, least: int = 1) -> np.ndarray:
    """A bitmap of the runs of ``run`` words and the shorter blocks that may stand in ``share`` of the distinct pages of their host, and
    in ``least`` of them; ``rows``: (host, texts), and ``sizes``: (host, size, copies), its distinct pages and its rows. ``head`` does not
    matter: whole runs are counted."""
    bits = bitmap(tallies(rows, sizes, run, share, least))
    found = tallies(rows, sizes, run, share, least, bits).groupBy("digest").agg(F.sum("found").alias("found"), F.min("need").alias("need"))
    return bitmap(found.filter(F.col("found") >= F.col("need") - 1e-6))


def doublings(head: int, run: int) -> list[int]:
    """The steps from ``head`` words to ``run``: in each, ranks of suffixes i and i + step give the order by so many words more."""
    steps, size = [], head
    while size < run:
        steps.append(min(size, run - size))
        size += steps[-1]
    return steps


def suffixes(streams: DataFrame, head: int, run: int, bits: np.ndarray | None = None) -> DataFrame:
    """(host, stream, pages, at, whole, head): the suffixes of every stream by their first ``head`` words, and its blocks of fewer
    than ``run`` words, whole; with ``bits`` only those of runs that may repeat."""
    shared = None if bits is None else streams.sparkSession.sparkContext.broadcast(bits)
    # the suffixes whose first words make up those of a run
    parts = np.zeros(1, np.int64)
    for size in reversed(doublings(head, run)):
        parts = np.union1d(parts, parts + size)

    def step(batches):
        for batch in batches:
            for piece in page_slices(batch):
                page, at, runs, owner, block, place, size, whole = digests(piece, run)
                texts = piece.column("texts")
                if shared is None:
                    room = [max(0, len(token_stream(t)[0]) - head + 1) for t in texts.to_pylist()]
                    page, at = np.repeat(np.arange(len(room)), room), np.concatenate([np.arange(k) for k in room])
                else:
                    found, some = set_bits(shared.value, runs), set_bits(shared.value, whole)
                    # at most 2**31 words of a page
                    page, at = np.divmod(np.unique((page[found] << 32 | at[found])[:, None] + parts), 1 << 32)
                    owner, block, place, size = owner[some], block[some], place[some], size[some]
                if not len(page) + len(owner):
                    continue
                heads, last = [], -1
                for k, i in zip(page.tolist(), at.tolist(), strict=True):
                    if k != last:
                        (words, _), last = token_stream(texts[k].as_py()), k
                    heads.append(" ".join(words[i : i + head]))
                cells = texts.values.take(pa.array(texts.offsets.to_numpy()[owner] + block))
                heads += [f"{EDGE} {t} {EDGE}" for t in cells.to_pylist()]
                rows = pa.array(np.concatenate([page, owner]))
                columns = [
                    *(piece.column(c).take(rows) for c in ("host", "stream", "pages")), pa.array(np.concatenate([at, place]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(len(at), np.int64), size + 2]).astype(np.int32)), pa.array(heads, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["host", "stream", "pages", "at", "whole", "head"])

    return streams.mapInArrow(step, "host string, stream binary, pages long, at int, whole int, head string")


def ranked(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``rows`` (stream, pages, at, keys) with the rank of their keys in sorted order, and in how many pages the keys stand: those
    in fewer than ``least`` are left out."""
    counts = rows.select("stream", "pages", *keys).distinct().groupBy(*keys).agg(F.sum("pages").alias("found")).filter(F.col("found") >= least)
    # ids that ascend over the partitions of a range sort ascend with the order
    order = cut(counts.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), free=True)
    return rows.join(order, keys)


def repeats(streams: DataFrame, run: int, least: int, bits: np.ndarray | None = None) -> DataFrame:
    """(host, stream, at, n, found): runs of ``run`` words and short whole blocks (with the edges beside them) that stand in
    ``least`` distinct pages of a host, at each of their places; ``streams``: (host, stream, pages, texts), a stream may come twice.
    With ``bits`` only those that may repeat by it are looked at."""
    head = run // 4
    rows = cut(ranked(cut(suffixes(streams, head, run, bits).distinct(), free=True), ["host", "whole", "head"], least).select("host", "stream", "pages", "at", "whole", "rank", "found"), free=True)
    short = rows.filter("whole > 0").select("host", "stream", "at", F.col("whole").alias("n"), "found")
    rows = rows.filter("whole = 0").drop("whole")
    for step in doublings(head, run):
        after = rows.select("host", "stream", (F.col("at") - step).alias("at"), F.col("rank").alias("rank_after"))
        pairs = rows.withColumnRenamed("rank", "rank_here").drop("found").join(after, ["host", "stream", "at"])
        rows = cut(ranked(pairs, ["host", "rank_here", "rank_after"], least).select("host", "stream", "pages", "at", "rank", "found"), free=True)
    return rows.select("host", "stream", "at", F.lit(run).alias("n"), "found").unionByName(short)


def extract(pages: DataFrame, run: int = 20, share: float = 0.1, menu_share: float = 0.5, least: int = 3) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated): the main text of every page, blocks joined by one line feed."""
    rows = cut(parsed(pages))
    sizes = cut(rows.groupBy("host", "stream").count().groupBy("host").agg(F.count(F.lit(1)).alias("size"), F.sum("count").alias("copies")), free=True)
    # the more pages of a host a task holds, the less its share of them lets in
    few = rows.coalesce(parts_for(plan_bytes(rows), PART_BYTES))
    bits = may_repeat(few, sizes, run // 4, run, share, least)
    found = repeats(rows.select("host", "stream", F.lit(1).cast("long").alias("pages"), "texts"), run, least, bits)
    found = found.join(sizes.select("host", "size"), "host").filter(F.col("found") >= F.col("size") * share)
    spans = found.groupBy("host", "stream").agg(F.collect_list(F.struct("at", "n", (F.col("found") >= F.col("size") * menu_share).alias("menu"))).alias("spans"))

    def strip(batches):
        for batch in batches:
            text, lost = [], []
            for own, kinds, covered in zip(*(batch.column(c).to_pylist() for c in ("texts", "kinds", "spans")), strict=True):
                left, gone = unique_runs(own, kinds, covered or [])
                text.append("\n".join(left))
                lost.append(gone)
            size = [len(t) for t in text]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(size, pa.int64()), pa.array(lost, pa.int64())], ["page_id", "url", "text", "n_chars", "n_repeated"])

    kind = pages.schema["page_id"].dataType.simpleString()
    columns = ["page_id", "url", "texts", "kinds", "spans"]
    # kept blocks are whole and dropped ones go, so only pages with other blocks ask for spans, and only their texts are shuffled
    asks = F.exists("kinds", lambda k: ~k.isin(KEPT, DROPPED))
    asking = rows.filter(asks).join(spans, ["host", "stream"], "left").select(*columns)
    plain = rows.filter(~asks).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).select(*columns)
    return asking.unionByName(plain).mapInArrow(strip, f"page_id {kind}, url string, text string, n_chars long, n_repeated long")


def unique_runs(texts: list[str], kinds: list[int], spans: list[dict]) -> tuple[list[str], int]:
    """The blocks of the main text without the words that spans of the stream cover, and how many these are."""
    if all(kind in (KEPT, DROPPED) for kind in kinds):
        return [t for t, kind in zip(texts, kinds, strict=True) if kind == KEPT], 0
    words, places = token_stream(texts)
    edges = np.zeros((2, len(words) + 1), np.int64)
    kept = np.zeros(len(words) + 1, np.int64)
    for kind, (at, n) in zip(kinds, places, strict=True):
        if kind == KEPT:
            kept[at + 1 : at + n + 1] = 1
    kept = np.cumsum(kept)
    for s in spans:
        if kept[s["at"] + s["n"]] > kept[s["at"]]:
            continue  # it repeats prose, which says nothing of the blocks beside
        for level in range(1 + s["menu"]):
            edges[level, s["at"]] += 1
            edges[level, s["at"] + s["n"]] -= 1
    free = (np.cumsum(edges, 1) == 0).tolist()
    out, lost = [], 0
    for t, kind, (at, n) in zip(texts, kinds, places, strict=True):
        if kind == KEPT:
            out.append(t)
        elif kind != DROPPED:
            left = [words[i] for i in range(at, at + n) if free[kind == MENU][i]]
            lost += n - len(left)
            if left:
                out.append(" ".join(left))
    return out, lost
