"""Main text of HTML pages: structure first, then nearest-URL page differencing.

A page is cut into blocks, the lines. Elements that by name, role, class or id are no article (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments) are skipped. Where the page marks its article (article,
else main or role=main) only blocks in it count. Then pages are paired with their nearest neighbours by URL path
within a host; the lines of both are aligned by longest common subsequence, and shared lines are deleted, in a marked
article too. Near-equal pages are copies and no neighbours: a run of pages that are copies one of the next looks past itself, to
the page before and the page after it. A page without a neighbour that is no copy keeps all lines.

Pages are sorted by host, path and page_id over ranges, so a host of any size is spread over tasks. In a range all pages but
those of its first and last run have both neighbours at hand. For these, a pass over the ranges' edges, four pages of each, one
range after the other, tells what lies before a range's first run and after its last one, however many ranges a run fills; so texts
depend on the order of pages alone, not on where ranges are cut.

Defined cases: null or empty html: empty text; null url: host and path are empty; repeated rows stay rows; unclosed
and stray tags never fail; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.llm.common import materialize, tidy

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "xmp", "noembed", "noframes"}
SKIP = {"head", "nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "canvas", "audio", "video", "datalist", "label", "option"} | RAW
BLOCK = {"p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "hr", "body", "html", "center", "fieldset", "legend"} | SKIP
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end an open element of the same kind.
SELF_ENDING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
#: Words of a class or id that mark something other than the article.
BAD = set("ad ads advert advertisement advertising adbox adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead topbar toolbar cookie cookies consent notice notification gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus reply replies widget pagination pager search form skip copyright legal disclaimer".split())
BAD_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
KEEP_HEADER_IN_ARTICLE = {"header"}
#: Pages that a range holds at least, and about at most until there are MAX_RANGES; keys sampled for each range.
RANGE_ROWS, FULL_RANGE, MAX_RANGES, SAMPLE = 200, 100_000, 10_000, 40
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")


def _is_bad(tag: str, attrs: str) -> bool:
    if tag in SKIP:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in BAD_ROLE or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and not BAD.isdisjoint(WORD.findall(value)):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks(page: str) -> list[tuple[str, bool]]:
    """(text, in a marked article) for each block in order."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # tag, starts a skipped part, kind of article it starts
    skipped, marked = 0, []

    def end_block():
        if text:
            line = SPACE.sub(" ", html_lib.unescape("".join(text))).strip()
            text.clear()
            if line:
                out.append((line, max(marked, default=0)))

    def pop(to: int):
        nonlocal skipped
        while len(stack) > to:
            _, bad, kind = stack.pop()
            skipped -= bad
            if kind:
                marked.pop()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            if not skipped:
                text.append(page[at:])
            break
        if m.start() > at and not skipped:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in ("br", "wbr"):
            if tag == "br" and not skipped:
                text.append(" ")
            continue
        if tag in BLOCK:
            end_block()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break  # a stray end of an inline element ends no block
        elif tag in VOID:
            continue
        elif tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        else:
            if tag in SELF_ENDING:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        pop(i)
                        break
                    if stack[i][0] in BLOCK and stack[i][0] not in SELF_ENDING:
                        break
            elif tag in BLOCK and any(s[0] == "p" for s in stack[-3:]):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
            attrs = m[3] or ""
            bad = _is_bad(tag, attrs) and not (tag in KEEP_HEADER_IN_ARTICLE and marked)
            kind = 2 if tag == "article" else 1 if tag == "main" or "role" in attrs and re.search(r"role\s*=\s*[\"']?main", attrs, re.I) else 0
            kind = 0 if bad or skipped else kind
            if attrs.rstrip().endswith("/") and tag not in BLOCK:
                continue
            stack.append((tag, bad, kind))
            skipped += bad
            if kind:
                marked.append(kind)
    end_block()
    best = max((k for _, k in out), default=0)
    return [(t, k > 0) for t, k in out if k == best]


def shared(a: list[str], b: list[str]) -> set[int]:
    """Indexes in a of a longest common subsequence with b (Hunt and Szymanski)."""
    where: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    tails: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(tails, j)
            node = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(node)
            else:
                tails[k], links[k] = j, node
    found, node = set(), links[-1] if links else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def _pairs(lines: list[str]) -> set[tuple[str, str]]:
    words = " ".join(lines).lower().split()
    return set(zip(["", *words], [*words, ""], strict=True)) if words else set()


def copies(a: list[str], b: list[str]) -> bool:
    """Near-equal pages: shared lines are most of both, and the rest is little and of one only, or has most word pairs in common."""
    if a == b:
        return True
    size = max(sum(map(len, a)), sum(map(len, b)))
    common = shared(a, b)
    if 2 * sum(len(a[i]) for i in common) <= size:
        return False
    rest_a = [t for i, t in enumerate(a) if i not in common]
    common = shared(b, a)
    rest_b = [t for i, t in enumerate(b) if i not in common]
    if not rest_a or not rest_b:
        return 10 * sum(map(len, rest_a + rest_b)) <= size
    p, q = _pairs(rest_a), _pairs(rest_b)
    return 2 * len(p & q) >= len(p | q)


def own_lines(lines: list[str], others: list[list[str]]) -> list[str]:
    """A page's lines without those that it shares with its neighbours."""
    gone: set[int] = set()
    for other in others:
        gone |= shared(lines, other)
    return [t for i, t in enumerate(lines) if i not in gone]


_LINES = pa.list_(pa.string())
_PAGE = "page_id long, url string, text string, n_chars long"
#: Kinds of rows of a range: a page with its text; a page of the first or last run, or of the only one, which has its lines; the
#: range's edges: its first page, the first one past its first run, the last one before its last run, its last page.
DONE, FIRST, LAST, ONLY, EDGES = range(5)
_PLACED = f"{_PAGE}, part int, kind int, lines array<string>, host string, first array<string>, second array<string>, before_last array<string>, last array<string>"


def _text(lines: list[str], neighbours: list[list[str] | None]) -> str:
    return "\n".join(own_lines(lines, [o for o in neighbours if o is not None and not copies(lines, o)]))


def _cut(cuts: list[tuple[str, str, bool, int]]):
    """(page_id, url, host, path, html) -> the page's lines, deflated as they move next, a hash that orders pages of one id, and its range: the cuts before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hosts, paths = (batch.column(c).to_pylist() for c in ("page_id", "host", "path"))
            first, size, cols = 0, 0, ([], [], [])
            names = ["page_id", "url", "host", "path", "lines", "tie", "part"]

            def out(lo: int, hi: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names[:4]), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names)

            for i, page in enumerate(batch.column("html")):
                page = page.as_py() or ""
                key = (hosts[i], paths[i], ids[i] is not None, ids[i] or 0)
                for c, x in zip(cols, (zlib.compress("\n".join(t for t, _ in blocks(page)).encode(), 1), zlib.crc32(page.encode()), bisect_right(cuts, key)), strict=True):
                    c.append(x)
                size += len(page)
                if size > 4 << 20:
                    yield out(first, i + 1)
                    first, size, cols = i + 1, 0, ([], [], [])
            if cols[0]:
                yield out(first, batch.num_rows)

    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of a range in order of host, path, page_id -> their texts as far as the range tells them, the rest, and the edges."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in _PLACED.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), _LINES, pa.string(), _LINES, _LINES, _LINES, _LINES]
    rows: list[tuple] = []
    edges: dict[str, list[str]] = {}
    run: list[tuple] = []  # (page_id, url, lines) of copies one of the next
    host = before = None  # of the run; before: the page before it, if of the same host
    first_run, size = True, 0

    def end_run(after: list[str] | None, is_last: bool) -> None:
        nonlocal first_run
        kind = ONLY if first_run and is_last else FIRST if first_run else LAST if is_last else DONE
        for page_id, url, lines in run:
            if kind == DONE:
                text = _text(lines, [before, after])
                rows.append((page_id, url, text, len(text), part, DONE, None, None, None, None, None, None))
            else:
                rows.append((page_id, url, None, None, part, kind, lines, host, None, None, None, None))
        first_run = False

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows.clear()
        return batch

    first_host = None
    for batch in batches:
        for i in range(batch.num_rows):
            page_id, url, its_host, packed = (batch.column(c)[i].as_py() for c in ("page_id", "url", "host", "lines"))
            text = zlib.decompress(packed).decode()
            lines = text.split("\n") if text else []
            size += sum(map(len, lines))
            same = bool(run) and host == its_host
            if same and copies(run[-1][2], lines):
                run.append((page_id, url, run[-1][2] if lines == run[-1][2] else lines))
            else:
                if run:
                    if first_run:
                        edges["second"] = lines if same else None
                    end_run(lines if same else None, False)
                    before = run[-1][2] if same else None
                    edges["before_last"] = before
                else:
                    edges["first"], first_host = lines, its_host
                run, host = [(page_id, url, lines)], its_host
            if size > 16 << 20 and rows:
                yield out()
                size = 0
    if run:
        only = first_run
        end_run(None, True)
        # of the edges, text is the host of the last page and n_chars whether all pages are one run
        rows.append((None, None, host, int(only), part, EDGES, None, first_host, edges["first"], None if only else edges["second"], None if only else edges["before_last"], run[-1][2]))
        yield out()


def _along(forward: bool):
    """Edges of ranges, in order or backwards, in one task -> (part, lines): the page before a range's first run, or after its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host = page = beyond = None  # of the range passed: its near end's host and page, and what lies beyond that page's run
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                near_host, far_host = (r["host"], r["text"]) if forward else (r["text"], r["host"])
                near, inner, far = (r["first"], r["before_last"], r["last"]) if forward else (r["last"], r["second"], r["first"])
                found = None
                if host is not None and near_host == host:
                    found = beyond if copies(page, near) else page
                out.append(found)
                beyond = found if r["n_chars"] else inner
                host, page = far_host, far
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(out, _LINES)], ["part", "found"])

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for r in batch.select(["kind", "lines", "before", "after", "second", "before_last"]).to_pylist():
            before = r["before_last"] if r["kind"] == LAST else r["before"]
            after = r["second"] if r["kind"] == FIRST else r["after"]
            texts.append(_text(r["lines"], [before, after]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    rows = pages.count()
    # a range streams through its task, so that more pages than FULL_RANGE take longer but no more memory
    n = max(1, min(rows // RANGE_ROWS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // FULL_RANGE), MAX_RANGES))
    # cuts between ranges, from a sample of SAMPLE pages for each; pages are parsed once, before they move
    few = src.select("host", "path", "page_id").orderBy(F.xxhash64("page_id", "url"), "page_id").limit(SAMPLE * n).collect() if n > 1 else []
    keys = sorted((r["host"], r["path"], r["page_id"] is not None, r["page_id"] or 0) for r in few)
    cuts = [keys[len(keys) * i // n] for i in range(1, n)] if keys else []
    parsed = src.mapInArrow(tidy(_cut(cuts)), "page_id long, url string, host string, path string, lines binary, tie long, part int")
    # pages of one id and path are ordered by a hash of their html, so that the order is one whatever the ranges
    dealt = parsed.repartitionById(n, "part").sortWithinPartitions("host", "path", "page_id", "tie")
    placed = materialize(spark, dealt.select("page_id", "url", "host", "lines").mapInArrow(tidy(_place), _PLACED), "html-pages")
    done = placed.where(F.col("kind") == DONE).select("page_id", "url", "text", "n_chars")
    edges = placed.where(F.col("kind") == EDGES).select("part", "host", "text", "n_chars", "first", "second", "before_last", "last")  # a row for each range
    passes = {}
    for name, forward in (("before", True), ("after", False)):
        line = edges.repartition(1).sortWithinPartitions(F.asc("part") if forward else F.desc("part"))
        passes[name] = line.mapInArrow(tidy(_along(forward)), "part int, found array<string>").withColumnRenamed("found", name)
    around = edges.select("part", "second", "before_last").join(passes["before"], "part").join(passes["after"], "part")
    rest = placed.where(F.col("kind").isin(FIRST, LAST, ONLY)).select("page_id", "url", "part", "kind", "lines").join(around, "part")
    return done.unionByName(rest.mapInArrow(tidy(_finish), _PAGE))
