"""Main text of web pages: page structure first, a suffix array per host for what the structure leaves open.

A page is read into blocks. A block is *main* inside an article or main element, *boilerplate* inside a menu, header, footer, sidebar,
form, advert, notice or comment section as told by tags, roles and class names, and else *open*. Everything outside
the main element is also written as a token stream. The streams of a host are concatenated and their suffixes sorted; neighbours in that order which agree in
``LONG`` tokens or more, from distinct pages, cover those tokens. Boilerplate blocks go, open blocks go if at least half of their
tokens are covered, and the unique runs stay. Main blocks stay even if other pages repeat them: an article that two pages carry is an article. Without a main
element only whole copies are known as such: pages equal but for their boilerplate blocks count as one page.

Equal streams of a host are merged first, with the least and greatest page hash that hold them. A host of up to ``HOST_TOKENS`` tokens is sorted by
one task. The suffixes of a larger one are grouped over all tasks by a hash of their first ``LONG`` tokens, which is all that the order is read for; no task holds
more than a stream at a time.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbweave.llm.common import bounded, written

LONG = 8
HOST_TOKENS = 1_000_000
WINDOW_ROWS = 50_000
MAIN, BOILER, OPEN = 0, 1, 2

_RAW = "script|style|noscript|template|textarea|title|svg|iframe|object|math|select|option"
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-z][^>]*+>|<[!?][^>]*+>",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BOILER = frozenset("nav footer aside form menu button dialog head label fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_HINTS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion related "
    "replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
# Class words that a wrapper of the whole content may have too; and first words that only tell that a page has such a part.
_LAYOUT = frozenset("menu nav navbar navigation search sidebar toolbar widget widgets".split())
_MODIFIERS = frozenset("has with no without".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marks(attrs: str) -> tuple[bool, frozenset[str], bool]:
    """Whether attributes tell boilerplate, the class words that tell it, and whether they tell the main element."""
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    role = values.get("role", "").lower()
    names: set[str] = set()
    for name in (values.get("class", "") + " " + values.get("id", "")).split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] not in _MODIFIERS:
            names.update(words)
    hidden = values.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs) is not None
    return role in _ROLES or hidden, _HINTS & names, role == "main" or values.get("itemprop") == "articleBody"


def page_blocks(page: str) -> list[tuple[str, int]]:
    """Blocks of a page in order, as (text, kind). Character references are decoded, white space is one space, a line break is white space.

    On a page without a main element, one inside a wrapper whose class tells boilerplate wins over that class if it holds more than
    the open blocks; an article element wins over the words of ``_LAYOUT`` only, since comments and teasers are articles as well.
    """
    blocks = _blocks(page, False)
    kinds = {kind for _, kind in blocks}
    if BOILER in kinds and MAIN not in kinds:
        inner = _blocks(page, True)
        if sum(len(t) for t, kind in inner if kind == MAIN) > sum(len(t) for t, kind in inner if kind == OPEN):
            return inner
    return blocks


def _blocks(page: str, inner: bool) -> list[tuple[str, int]]:
    """The blocks; with ``inner``, main elements win over the classes of their wrappers."""
    blocks: list[tuple[str, int]] = []
    stack: list[tuple[str, int, int, int, bool]] = []
    boiler = listed = layout = main = 0
    text: list[str] = []
    dropped: list[str] = []

    def flush() -> None:
        for parts, kind in ((text, MAIN if main else OPEN), (dropped, BOILER)):
            if parts:
                joined = " ".join("".join(parts).split())
                if joined:
                    blocks.append((joined, kind))
                parts.clear()

    def pop(at: int) -> None:
        nonlocal boiler, listed, layout, main
        if any(entry[0] in _BLOCK for entry in stack[at:]):
            flush()
        for _, b, c, w, m in stack[at:]:
            boiler -= b
            listed -= c
            layout -= w
            main -= m
        del stack[at:]

    def add(piece: str) -> None:
        if piece:
            (dropped if boiler or listed or layout else text).append(html.unescape(piece) if "&" in piece else piece)

    at = 0
    for tag in _TAG.finditer(page):
        add(page[at : tag.start()])
        at = tag.end()
        name = tag["name"]
        if name is None:
            continue
        name = name.lower()
        if tag["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if name not in _BLOCK and stack[i][0] in _BLOCK:
                    break
            else:
                if name in _BLOCK:
                    flush()
            continue
        if name in _BLOCK:
            flush()
            closes = "p" if name not in ("li", "tr", "td", "th", "dt", "dd") else None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" and closes or stack[i][0] == name and name in ("li", "tr", "td", "th", "dt", "dd"):
                    pop(i)
                    break
                if stack[i][0] in _BLOCK and stack[i][0] != "p":
                    break
        elif name == "br":
            add(" ")
        if name in _VOID or tag["attrs"].endswith("/"):
            continue
        told, hints, is_main = _marks(tag["attrs"]) if tag["attrs"] else (False, frozenset(), False)
        told = told or name in _BOILER or (name == "header" and not main)
        surely = is_main or name == "main"
        is_main = not told and not hints and (surely or name == "article")
        if name == "body":  # a class of the whole page tells nothing
            told, hints = False, frozenset()
        c, w = int(bool(hints - _LAYOUT)), int(bool(hints & _LAYOUT))
        if inner and is_main:
            c, w = -listed if surely else 0, -layout
        stack.append((name, told, c, w, is_main))
        boiler += told
        listed += c
        layout += w
        main += is_main
    add(page[at:])
    flush()
    return blocks


def streams(blocks: list[tuple[str, int]]) -> list[tuple[list[str], list[int]]]:
    """Runs of blocks outside the main element: their tokens, and the numbers of the blocks."""
    out: list[tuple[list[str], list[int]]] = []
    last = None
    for i, (text, kind) in enumerate(blocks):
        if kind != MAIN:
            if last != i - 1 or not out:
                out.append(([], []))
            out[-1][0].extend(text.split(" "))
            out[-1][1].append(i)
            last = i
    return out


def covered_starts(rows: list[tuple[list[str], int, int]], bucket: int, buckets: int) -> list[np.ndarray]:
    """For each stream (tokens, first page, last page) the positions whose ``LONG`` tokens another page repeats.

    The streams are concatenated with a separator of its own after each, and all suffixes sorted by prefix doubling until
    their first ``LONG`` tokens are in order; equal ranks are then neighbours in the suffix array with that many tokens in common.
    """
    sizes = np.array([len(tokens) for tokens, _, _ in rows])
    total = int(sizes.sum() + len(rows))
    ids: dict[str, int] = {}
    stream = np.empty(total, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes + 1)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    for i, (tokens, _, _) in enumerate(rows):
        a = int(starts[i])
        stream[a : a + len(tokens)] = [ids.setdefault(t, len(ids)) for t in tokens]
        stream[a + len(tokens)] = -1 - i
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < LONG:
        step = min(width, LONG - width)
        after = np.full(total, -1, dtype=np.int64)
        after[: total - step] = rank[step:]
        rank = np.unique(rank * (total + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    place = np.arange(total) - starts[owner]
    whole = place <= sizes[owner] - LONG  # suffixes that do not reach a separator
    if buckets > 1:
        mine = np.zeros(total, dtype=bool)
        for at in np.flatnonzero(whole).tolist():
            tokens = rows[owner[at]][0]
            mine[at] = bucket_of(tokens[place[at]], tokens[place[at] + 1], buckets) == bucket
        whole &= mine
    order = np.flatnonzero(whole)
    order = order[np.argsort(rank[order], kind="stable")]  # the suffix array
    found: list[list[int]] = [[] for _ in rows]
    if len(order):
        low, high = np.array([a for _, a, _ in rows]), np.array([b for _, _, b in rows])
        cut = np.flatnonzero(np.diff(rank[order], prepend=-1))
        least, most = np.minimum.reduceat(low[owner[order]], cut), np.maximum.reduceat(high[owner[order]], cut)
        repeated = np.repeat(least < most, np.diff(cut, append=len(order)))
        for at in order[repeated].tolist():
            found[owner[at]].append(int(place[at]))
    return [np.array(sorted(f), dtype=np.int32) for f in found]


def bucket_of(first: str, second: str, buckets: int) -> int:
    return zlib.crc32(f"{first} {second}".encode()) % buckets


def kept(blocks: list[tuple[str, int]], covered: dict[int, set[int]]) -> str:
    """Main blocks, and open blocks of which less than half is covered; ``covered`` has window starts by stream number."""
    drop: set[int] = set()
    for n, (tokens, numbers) in enumerate(streams(blocks)):
        marks = np.zeros(len(tokens) + 1, dtype=np.int64)
        for start in covered.get(n, ()):
            marks[start] += 1
            marks[min(start + LONG, len(tokens))] -= 1
        inside = np.cumsum(marks[:-1]) > 0
        at = 0
        for i in numbers:
            size = blocks[i][0].count(" ") + 1
            if blocks[i][1] == BOILER or 2 * int(inside[at : at + size].sum()) >= size:
                drop.add(i)
            at += size
    return "\n".join(text for i, (text, _) in enumerate(blocks) if i not in drop)


def parsed(pages: DataFrame) -> DataFrame:
    """``row, page_id, url, host, blocks, open, streams, copy`` of every page; ``row`` numbers the rows of this table.

    ``copy`` is a hash of the blocks that are no boilerplate: pages equal in them are copies of one page.
    """
    block = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int8())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_blocks(page or "") for page in batch.column(2).to_pylist()]
            hosts = [re.sub(r"^[a-z]+://|[/?#:].*$", "", (url or "").lower(), flags=re.S) for url in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array([[{"text": t, "kind": k} for t, k in b] for b in found], block),
                    pa.array([any(k == OPEN for _, k in b) for b in found], pa.bool_()), pa.array([[" ".join(t) for t, _ in streams(b)] for b in found], pa.list_(pa.string())),
                ],
                names=["page_id", "url", "host", "blocks", "open", "streams"],
            )

    schema = "page_id long, url string, host string, blocks array<struct<text:string,kind:tinyint>>, open boolean, streams array<string>"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)
    own = F.transform(F.filter("blocks", lambda b: b["kind"] != BOILER), lambda b: b["text"])
    return written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("copy", F.xxhash64(own)), "pages")


def windows(streams: DataFrame) -> DataFrame:
    """``host, at, low, high, place, window``: each position of the streams (host, at, low, high, stream), with a hash of the ``LONG`` tokens from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            index: list[int] = []
            places: list[int] = []
            found: list[int] = []

            def rows() -> pa.RecordBatch:
                own = batch.select(range(4)).take(pa.array(index, pa.int32()))
                arrays = [*own.columns, pa.array(places, pa.int32()), pa.array(np.array(found, dtype=np.uint64).view(np.int64))]
                for part in (index, places, found):
                    part.clear()
                return pa.RecordBatch.from_arrays(arrays, names=["host", "at", "low", "high", "place", "window"])

            for i, stream in enumerate(batch.column(4).to_pylist()):
                tokens = stream.split(" ")
                for place in range(len(tokens) - LONG + 1):
                    index.append(i)
                    places.append(place)
                    found.append(xxhash.xxh3_64_intdigest(" ".join(tokens[place : place + LONG]).encode("utf-8", "surrogatepass")))
                    if len(index) == WINDOW_ROWS:
                        yield rows()
            if index:
                yield rows()

    return streams.select("host", "at", "low", "high", "stream").mapInArrow(run, "host string, at long, low long, high long, place int, window long")


def repeated_runs(pages: DataFrame) -> DataFrame:
    """``host, at, starts``: of each distinct stream, by its hash, the covered positions; streams without any are left out."""
    rows = pages.select("copy", "host", F.explode("streams").alias("stream")).withColumn("at", F.xxhash64("stream"))
    rows = rows.filter(F.size(F.split("stream", " ")) >= LONG)
    distinct = written(rows.groupBy("host", "at").agg(F.min("copy").alias("low"), F.max("copy").alias("high"), F.first("stream").alias("stream")), "streams")
    sizes = distinct.groupBy("host").agg(F.sum(F.size(F.split("stream", " "))).alias("tokens"))
    large = bounded(written(sizes.filter(F.col("tokens") > HOST_TOKENS).select("host"), "hosts"))

    def sort(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = [(stream.split(" "), low, high) for stream, low, high in zip(group["stream"], group["low"], group["high"])]
        out = pd.DataFrame({"host": group["host"], "at": group["at"], "starts": [s.tolist() for s in covered_starts(rows, 0, 1)]})
        return out[out["starts"].map(len) > 0]

    small = distinct.join(large, "host", "left_anti").groupBy("host").applyInPandas(sort, "host string, at long, starts array<int>")
    if large.isEmpty():
        return small
    # Hot windows are summed up before the shuffle; what repeats is joined back window by window.
    every = windows(distinct.join(large, "host", "left_semi"))
    repeated = every.groupBy("host", "window").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most")
    repeated = bounded(written(repeated.select("host", "window"), "repeated"))
    covered = every.join(repeated, ["host", "window"]).groupBy("host", "at").agg(F.sort_array(F.collect_list("place")).alias("starts"))
    return small.unionByName(covered)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page. Null, empty and text-less pages have the empty text.

    Repeated rows are each returned, a null page_id stays null, and pages with a null url share the empty host. Other columns are
    not read. Copies of a page, repeated rows too, count as one page: what only they share is no boilerplate.
    """
    rows = parsed(pages)
    runs = written(repeated_runs(rows), "runs")
    # Pages without open blocks are settled by structure; the others look up their streams.
    settled = rows.filter(~F.col("open")).select("page_id", "url", F.array_join(F.transform(F.filter("blocks", lambda b: b["kind"] == MAIN), lambda b: b["text"]), "\n").alias("text"))
    open_ = rows.filter("open")
    hits = open_.select("row", "host", F.posexplode("streams").alias("n", "stream")).select("row", "host", "n", F.xxhash64("stream").alias("at")).join(runs, ["host", "at"])
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("n", "starts")).alias("runs"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                covered: dict[int, set[int]] = {}
                for run in found or ():
                    covered.setdefault(run["n"], set()).update(run["starts"])
                texts.append(kept([(b["text"], b["kind"]) for b in blocks], covered))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    decided = open_.join(hits, "row", "left").select("page_id", "url", "blocks", "runs").mapInArrow(settle, "page_id long, url string, text string")
    return settled.unionByName(decided)
