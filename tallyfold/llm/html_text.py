"""Main text of web pages: a suffix array of the host's token streams, with markup as evidence.

A page is cut into blocks of three zones: the *article* as marked up, *chrome* (menus,
headers, footers, sidebars, notices, adverts, forms, comments) by element, role or class
name, and *open* blocks outside both.  Chrome is dropped.

Boilerplate: the tokens of all blocks make a stream per page.  Runs of ``RUN`` tokens or
more that stand on a share ``SHARE`` of a host's pages, and on ``LEAST_PAGES`` at least,
are found in suffix arrays of the host's streams and removed wherever they stand, in
marked articles too; unique runs stay.  Pages whose own text is nearly the same, as copies
of one article are, count as one page, so that what only copies share is no boilerplate.

Of what is left a page gives the article blocks, unless they hold less than half as many
tokens as the open blocks: then markup has named a part only, and both are given.

A host may hold any share of all pages, so no task gets a whole host.  Streams are cut
into segments by an anchor (the least hash of a token pair in every window of ``RUN``
tokens), so equal windows meet under the same host and anchor.  Anchors are counted
first: only segments whose anchor is on enough pages, and outside chrome on one of them,
are written, equal ones are summed before they move, and each task builds suffix arrays of
the different ones.  Pages without such a run are not moved.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, mix, sliding_min, stage
from .keys import SLOT_BITS, bitmap, has, split_by_slot
from .suffix_dedup import common_prefixes, runs, suffix_array

RUN = 10
SHARE = 0.6  # of a host's pages, as a template has; what a third of them quote is no boilerplate
LEAST_PAGES = 6
SHARD_TOKENS = 200_000
ARTICLE, OPEN, CHROME = 0, 1, 2

# --- blocks ---------------------------------------------------------------------------

# fixed values: element and class names of HTML practice
_SKIPPED = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "head", "select", "canvas", "audio", "video"}
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
_CHROME_TAGS = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "button"}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
_CHROME_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "paywall",
    "sidebar", "widget", "related", "recommended", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "masthead",
    "header", "footer", "share", "sharing", "social", "comment", "comments", "disqus", "replies", "reply", "respond", "copyright",
    "legal", "disclaimer", "login", "signup", "search", "pagination", "pager", "skip", "toolbar", "topbar", "bottombar",
}
_OWN_OF_ARTICLES = {"header", "footer", "banner"}  # an article's own heading or closing lines
_ARTICLE_NAMES = {"articlebody", "article-body", "article-content", "post-content", "post-body", "entry-content", "story-body", "main-content"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![-\w])(class|id|role|itemprop|hidden|style)(?![-\w])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_STATE = re.compile(r"(?<![a-z0-9])(?:has|with|without|no|is)[-_][a-z0-9]+")  # says what a page has around it, not what it is
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")


def _zone(tag: str, attributes: str, zone: int) -> int:
    """The zone inside an element, given the one around it; -1 for what is never text."""
    if zone in (CHROME, -1):
        return zone
    if tag in _SKIPPED:
        return -1
    names: set[str] = set()
    whole: set[str] = set()
    if attributes and ("=" in attributes or "hidden" in attributes):
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            if key.lower() == "hidden" and value != "until-found" or key.lower() == "style" and _UNSEEN.search(value):
                return -1
            if key.lower() == "role" and value in _CHROME_ROLES:
                return CHROME
            if key.lower() == "role" and value == "main":
                whole.add("main-content")
            if key.lower() in ("class", "id", "itemprop"):
                whole.update(value.split())
                names.update(re.split(r"[^a-z0-9]+", _STATE.sub(" ", value)))
    if tag in _CHROME_TAGS or names & _CHROME_NAMES:
        own = (tag in _OWN_OF_ARTICLES or tag not in _CHROME_TAGS) and not (names & _CHROME_NAMES) - _OWN_OF_ARTICLES
        if tag not in ("body", "html", "article", "main") and not (zone == ARTICLE and own):
            return CHROME
        if tag in ("article", "main") and names & {"comment", "comments", "reply", "replies"}:
            return CHROME
    if tag in ("article", "main") or whole & _ARTICLE_NAMES:
        return ARTICLE
    return zone


def page_blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of all blocks with text, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, list[str] | None]] = []  # element, zone inside, and the block around an inline one of another zone
    text: list[str] = []
    zone = OPEN
    at = 0

    def close() -> None:
        if text:
            block = _SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if block and zone >= 0:
                out.append((zone, block))

    def leave(down_to: int) -> None:
        """End the elements from a place in the stack on; a block around an inline one goes on."""
        nonlocal text, zone
        while len(stack) > down_to:
            around = stack.pop()[2]
            if around is not None:
                close()
                text = around
            zone = stack[-1][1] if stack else OPEN

    while True:
        mark = _MARK.search(page, at)
        if zone >= 0 and (end := mark.start() if mark else len(page)) > at:
            text.append(html.unescape(page[at:end]))
        if not mark:
            close()
            leave(0)
            close()
            return out
        at = mark.end()
        closing, tag, attributes = mark.group(1, 2, 3) if mark.group(2) else mark.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append("\n")
            continue
        if tag in _INLINE:
            inside = _zone(tag, attributes, zone) if attributes and not closing else zone
            if inside != zone and tag not in _VOID:
                stack.append((tag, inside, text))
                text, zone = [], inside
            elif stack and stack[-1][0] == tag:  # within an inline element of another zone
                if closing:
                    leave(len(stack) - 1)
                elif tag not in _VOID:
                    stack.append((tag, zone, None))
            continue
        close()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    leave(i)
                    close()
                    break
        elif tag not in _VOID and not attributes.endswith("/"):
            if tag in _RAW:
                end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                leave(len(stack) - 1)  # these close themselves
            if tag == "body":  # closes an open head
                leave(0)
            close()
            zone = _zone(tag, attributes or "", zone)
            stack.append((tag, zone, None))


def host_of(url: str | None) -> str:
    found = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


# --- boilerplate ----------------------------------------------------------------------


def _stream(texts: list[str]) -> list[str]:
    """The tokens of a page's blocks."""
    return [w for t in texts for w in t.split(" ")]


def signature(zones: list[int], texts: list[str]) -> int:
    """A hash that pages with nearly the same own text are likely to share: the least of its token triples'."""
    tokens = _stream([t for z, t in zip(zones, texts, strict=True) if z != CHROME]) or _stream(texts)
    ids = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))
    grams = gram_hashes(ids, min(3, len(ids))) if len(ids) else ids
    return int(grams.min()) - (1 << 63) if len(grams) else 0


def _placed(zones: list[int], texts: list[str], host: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the segments of a page's stream: anchor, first window, number of windows, and whether a token is outside chrome."""
    tokens = _stream(texts)
    if len(tokens) < RUN:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    pairs = gram_hashes(ids, 2)
    packed = (pairs >> np.uint64(32) << np.uint64(32)) | np.arange(len(pairs), dtype=np.uint64)
    place = (sliding_min(packed, RUN - 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    count = np.diff(np.append(first, len(place)))
    anchors = mix(pairs[place[first]] + np.uint64(host & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
    sizes = np.array([t.count(" ") + 1 for t in texts], np.int64)
    outside = np.concatenate(([0], np.cumsum(np.repeat(np.array(zones) != CHROME, sizes))))
    return anchors, first, count, outside[first + count + RUN - 1] > outside[first]


def _shard_runs(pieces: list[list[str]], pages: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Piece, offset, number of windows and number of pages of runs of windows on ``LEAST_PAGES`` or more.

    ``pages`` says on how many pages a piece stands; a window is on those of all pieces that hold it.
    """
    names: dict[str, int] = {}
    sizes = np.array([len(p) for p in pieces], np.int64)
    ids = np.fromiter((names.setdefault(t, len(names)) for p in pieces for t in p), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    stop = np.repeat(ends, sizes)
    order, place = suffix_array(ids, 1, stop)
    shared = common_prefixes(ids, starts, ends, order, place)
    piece_of = np.repeat(np.arange(len(pieces)), sizes)
    full = order + RUN <= stop[order]
    windows = order[full]
    group, own = np.cumsum(shared[order] < RUN)[full], anchors[piece_of[windows]]
    # equal windows of different hosts, which have different anchors, are different
    by = np.lexsort((piece_of[windows], own, group))
    windows, group, own = windows[by], group[by], own[by]
    heads = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (own[1:] != own[:-1]))))
    again = np.zeros(len(windows), bool)  # a piece counts once for a window
    again[1:] = (piece_of[windows[1:]] == piece_of[windows[:-1]]) & (group[1:] == group[:-1]) & (own[1:] == own[:-1])
    size = np.diff(np.append(heads, len(windows)))
    holders = np.add.reduceat(np.where(again, 0.0, pages[piece_of[windows]]), heads) if len(heads) else np.zeros(0)
    on = np.zeros(len(ids) + 1)
    on[windows] = np.repeat(holders, size)
    on[on < LEAST_PAGES - 1e-6] = 0
    first = np.zeros(len(ids) + 1, bool)
    first[starts] = True
    new = np.flatnonzero(np.concatenate(([True], (on[1:] != on[:-1]) | first[1:])))
    new = new[new < len(ids)]
    count = np.diff(np.append(new, len(ids)))
    good = on[new] > 0
    begin, count = new[good], count[good]
    piece = piece_of[begin]
    return piece, begin - starts[piece], count, on[begin]


_SEGMENT = "anchor long, body string, _key long, host long, sig long, start long, n long, own int, open boolean"


def _common_anchors(parsed: DataFrame, hosts: DataFrame) -> np.ndarray:
    """Bits of the anchors on enough pages of their host, and outside chrome on one of them.

    No window of an anchor is on more pages than the anchor is.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for host, zones, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                anchors, _, _, outside = _placed(zones, texts, host)
                own, at = np.unique(anchors, return_inverse=True)  # a page counts once
                found.append((own, np.full(len(own), host), np.bincount(at, outside, len(own)) > 0 if len(own) else np.zeros(0, bool)))
            if not found:
                continue
            anchors, of, outside = (np.concatenate(x) for x in zip(*found, strict=True))
            names, first, at, n = np.unique(anchors, return_index=True, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(of[first]), pa.array(n), pa.array(np.bincount(at, outside, len(names)) > 0 if len(names) else np.zeros(0, bool))],
                names=["anchor", "host", "n", "open"],
            )

    found = parsed.select("host", "zones", "texts").mapInArrow(scan, "anchor long, host long, n long, open boolean")
    common = found.groupBy("anchor", "host").agg(F.sum("n").alias("n"), F.max("open").alias("open")).filter((F.col("n") >= LEAST_PAGES) & F.col("open"))
    common = common.join(hosts, "host").filter(F.col("n") >= F.col("all") * SHARE - 1e-6)
    return bitmap(common.select(F.col("anchor").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).alias("slot")), "slot")


def _boilerplate(parsed: DataFrame) -> DataFrame:
    """``_page, spans``: runs of windows (start, n) of the pages' streams that enough other pages of their hosts share."""
    groups = stage(parsed.groupBy("host", "sig").agg(F.count("*").alias("alike")), "like-pages")
    hosts = stage(groups.groupBy("host").agg(F.count("*").alias("all")), "host-votes")
    sent = parsed.sparkSession.sparkContext.broadcast(_common_anchors(parsed, hosts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        for batch in batches:
            rows = []
            for page, host, sig, zones, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                placed = _placed(zones, texts, host)
                common = np.flatnonzero(has(bits, placed[0] & ((1 << SLOT_BITS) - 1)))
                if not len(common):
                    continue
                tokens, within = _stream(texts), Counter()
                for anchor, start, n, outside in zip(*(x[common].tolist() for x in placed), strict=True):
                    body = tokens[start : start + n + RUN - 1]
                    rows.append((anchor, " ".join(body), page, host, sig, start, n, 1, outside))
                    within.update({(anchor, " ".join(body[i : i + RUN])) for i in range(n)})
                # a page has one vote for a window: further segments with it are taken back
                rows += [(anchor, window, page, host, sig, -1, 1, 1 - times, False) for (anchor, window), times in within.items() if times > 1]
            columns = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=["anchor", "body", "_key", "host", "sig", "start", "n", "own", "open"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            pieces = [r[1].split(" ") for r in rows]
            piece, offset, n, pages = _shard_runs(pieces, np.array([r[2] for r in rows]), np.array([r[0] for r in rows], np.int64))
            if len(piece):
                at = piece.tolist()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([rows[p][i] for p in at], t) for i, t in ((0, pa.int64()), (1, pa.string()), (3, pa.int64()))),
                     pa.array(offset), pa.array(n), pa.array(pages)],
                    names=["anchor", "body", "host", "offset", "count", "pages"],
                )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SHARD_TOKENS and held[-1][0] != row[0]:
                    yield from flush(held)
                    held, size = [], 0
                held.append(row)
                size += row[1].count(" ") + 1
        if held:
            yield from flush(held)

    found = stage(parsed.select("_key", "host", "sig", "zones", "texts").mapInArrow(cut, _SEGMENT), "segments")
    # pages with the same signature share one vote
    weighed = found.join(groups.filter("alike > 1"), ["host", "sig"], "left")
    bodies = weighed.groupBy("anchor", "body").agg(F.sum(F.col("own") / F.coalesce("alike", F.lit(1))).alias("pages"), F.first("host").alias("host"))
    dealt = bodies.repartition("anchor").sortWithinPartitions("anchor", "body")
    repeated = dealt.mapInArrow(compare, "anchor long, body string, host long, offset long, count long, pages double")
    common = repeated.join(hosts, "host").filter(F.col("pages") >= F.col("all") * SHARE - 1e-6).select("anchor", "body", "offset", "count")
    return (
        found.filter("open").join(common, ["anchor", "body"])
        .groupBy(F.col("_key").alias("_page")).agg(F.sort_array(F.collect_set(F.struct((F.col("start") + F.col("offset")).alias("start"), "count"))).alias("spans"))
    )


# --- pages ----------------------------------------------------------------------------


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text`` of every row; the text is empty if there is none.

    A null page is empty; pages without a host share the empty one.  Repeated rows and
    equal or null ids each give a row; pages with nearly the same own text are one page as
    evidence of boilerplate.  An empty table gives no rows.  Other columns are not read.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zones, texts, hosts, sigs = [], [], [], []
            for value, address in zip(batch.column(3), batch.column(2), strict=True):
                found = page_blocks(value.as_py() or "")
                zones.append([z for z, _ in found])
                texts.append([t for _, t in found])
                hosts.append(xxhash.xxh3_64_intdigest(host_of(address.as_py())) - (1 << 63))
                sigs.append(signature(zones[-1], texts[-1]))
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array(hosts, pa.int64()), pa.array(sigs, pa.int64()),
                pa.array(zones, pa.list_(pa.int8())), pa.array(texts, pa.list_(pa.string())),
            ], names=["_key", "page_id", "url", "host", "sig", "zones", "texts"])

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_kept(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    id_type = pages.schema[page_id].dataType.simpleString()
    picked = pages.select(
        F.monotonically_increasing_id().alias("_key"), F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html")
    )
    parsed = stage(picked.mapInArrow(
        parse, f"_key long, page_id {id_type}, url string, host long, sig long, zones array<tinyint>, texts array<string>"
    ), "pages", "zstd")
    spans = stage(_boilerplate(parsed), "boilerplate")
    sure, unsure = split_by_slot(parsed, [F.col("_key")], spans.select("_page"))
    columns = ["page_id", "url", "zones", "texts"]
    joined = unsure.join(spans, F.col("_key") == F.col("_page"), "left").select(*columns, "spans")
    whole = sure.select(*columns, F.lit(None).cast("array<struct<start:bigint,count:bigint>>").alias("spans")).union(joined)
    return whole.mapInArrow(join_blocks, f"page_id {id_type}, url string, text string")


def _kept(zones: list[int], texts: list[str], spans: list[dict] | None) -> str:
    """The blocks without boilerplate: of the article, or if that is the smaller part of article and open ones."""
    gone = bytearray(sum(t.count(" ") + 1 for t in texts))
    for span in spans or []:
        size = span["count"] + RUN - 1
        gone[span["start"] : span["start"] + size] = b"\1" * size
    at, kept, tokens = 0, [], {ARTICLE: 0, OPEN: 0, CHROME: 0}
    for z, t in zip(zones, texts, strict=True):
        words = t.split(" ")
        left = [w for w, g in zip(words, gone[at : at + len(words)], strict=True) if not g] if spans else words
        at += len(words)
        if left and z != CHROME:
            tokens[z] += len(left)
            kept.append((z, " ".join(left)))
    wanted = {ARTICLE} if 2 * tokens[ARTICLE] >= tokens[OPEN] and tokens[ARTICLE] else {ARTICLE, OPEN}
    return "\n".join(t for z, t in kept if z in wanted)


def digest_rows(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
