"""Main text of web pages: blocks by the page's structure, and lines shared with the nearest page of the host deleted."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from itertools import islice
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.texts import map_texts, ship
from riskframe.llm.url_templates import host_and_path
from riskframe.session import materialise

#: Markup, as far as it ends; a tag or comment cut off by the end of the page is dropped.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.DOTALL)
MARKS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.IGNORECASE)

# Elements without text of their own; never part of the main text; without an end tag; and not breaking a line.
RAW = frozenset("script style textarea xmp iframe noembed noframes".split())
CHROME = frozenset("nav header footer aside form head title template noscript button select option dialog menu svg object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
MAIN = frozenset(("article", "main"))

# Words in class, id or role that name parts outside the main text, and ones that name the main text.
CHROME_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer
    form header masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related
    reply replies respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets alert complementary contentinfo search""".split()
)
MAIN_WORDS = frozenset("main content article post entry story".split())

#: Pages handled together; each group also sees the page before and the page after it.
GROUP = 256


def _named(attributes: str) -> set[str]:
    names = " ".join(m[2] or m[3] or m[4] or "" for m in MARKS.finditer(attributes))
    return set(re.split(r"[\s_-]+", names.lower())) if names else set()


def blocks(page: str) -> list[tuple[str, bool]]:
    """Text blocks in page order, and whether each stands in an article or main element.

    Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are left out.
    Character references are decoded, white space is one space, empty blocks are dropped.
    """
    found: list[tuple[str, bool]] = []
    pieces: list[str] = []
    main = 0
    mains: list[str] = []
    skipping: str | None = None  # the element being left out, and how many of its name are open
    depth = 0
    at = 0

    def close() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                found.append((text, main > 0))
            pieces.clear()

    while tag := MARKUP.search(page, at):
        if skipping is None and tag.start() > at:
            pieces.append(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        ending, name, attributes = bool(tag[1]), tag[2].lower(), tag[3]
        if name in RAW and not ending:
            end = re.compile(f"</{name}\\b[^>]*(?:>|\\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if skipping is not None:
            if name == skipping:
                depth += -1 if ending else 1
                if depth == 0:
                    skipping = None
                continue
            if name not in MAIN or ending or main or skipping in MAIN or _named(attributes) & CHROME_WORDS:
                continue
            skipping = None  # an article begins: what was left out has no end tag
        if name not in INLINE:
            close()
        if name in VOID:
            continue
        if ending:
            if mains and name == mains[-1]:
                mains.pop()
                main -= 1
            continue
        words = _named(attributes) if attributes.strip() else set()
        if name in CHROME or (name not in MAIN and name not in ("body", "html") and words & CHROME_WORDS and not words & MAIN_WORDS) or (
            name in MAIN and words & (CHROME_WORDS - {"form"})
        ) or HIDDEN.search(attributes):
            if not attributes.rstrip().endswith("/"):
                skipping, depth = name, 1
                if name in INLINE:
                    close()
            continue
        if name in MAIN:
            mains.append(name)
            main += 1
    if skipping is None and at < len(page):
        pieces.append(page[at:])
    close()
    return found


def main_blocks(page: str) -> tuple[list[str], bool]:
    """The blocks of the main element, or without one all blocks; and whether these are open to doubt."""
    found = blocks(page)
    inside = [text for text, in_main in found if in_main]
    return (inside, False) if inside else ([text for text, _ in found], True)


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Positions of ``own`` on a longest common subsequence with ``other``.

    Rows of the usual table are whole numbers, with a bit for each line of ``own``. A row is kept for each stretch of about the
    root of ``other``, and a stretch's own rows are made again on the way back.
    """
    places: dict[int, int] = {}
    for i, line in enumerate(own):
        places[line] = places.get(line, 0) | 1 << i
    every = (1 << len(own)) - 1

    def below(row: int, line: int) -> int:
        hit = row & places.get(line, 0)
        return ((row + hit) | (row - hit)) & every

    step = isqrt(len(other)) + 1
    row, starts = every, []
    for j, line in enumerate(other):
        if j % step == 0:
            starts.append(row)
        row = below(row, line)
    found, i = [], len(own)
    for start in reversed(range(len(starts))):
        stretch = other[start * step : (start + 1) * step]
        rows = [starts[start]]
        for line in stretch:
            rows.append(below(rows[-1], line))
        for j in reversed(range(len(stretch))):
            # A line of ``own`` adds to the subsequence where its bit is 0; if not without this line of ``other``, the two are matched.
            while i and rows[j + 1] >> (i - 1) & 1:
                i -= 1
            if i and rows[j] >> (i - 1) & 1:
                i -= 1
                found.append(i)
    return found[::-1]


def common_start(one: str, other: str) -> int:
    n = 0
    for a, b in zip(one, other, strict=False):
        if a != b:
            break
        n += 1
    return n


def shared_with_nearest(lines: DataFrame) -> DataFrame:
    """``page`` and the positions ``shared`` of its lines that the nearest page of its host has too.

    ``lines`` has ``page`` (a key), ``host``, ``path`` and ``lines`` (hashes). Pages are sorted by
    host and path over all tasks and numbered; the nearest is the one before or after with the longer common
    start of the path (the one before, if equal). Tasks take groups of ``GROUP`` neighbours with one more page on either
    side, so that a host of any size is spread and the result does not depend on where it is cut.
    """
    spark = lines.sparkSession
    ship(spark)
    lines = lines.repartitionByRange("host", "path", "page").sortWithinPartitions("host", "path", "page")
    numbered = materialise(lines.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "*"), "sorted")
    bases, base = [], 0
    for part, n in sorted((r.part, r["count"]) for r in numbered.groupBy("part").count().collect()):  # one row per partition
        bases.append((part, base))
        base += n
    at = F.col("base") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    rows = numbered.join(F.broadcast(spark.createDataFrame(bases, "part int, base bigint")), "part").withColumn("at", at)
    group = F.floor(F.col("at") / GROUP)
    seen_by = F.array_distinct(F.array(group, F.floor((F.col("at") - 1) / GROUP), F.floor((F.col("at") + 1) / GROUP)))
    rows = rows.select(F.explode(seen_by).alias("group"), "at", "page", "host", "path", "lines")
    rows = rows.repartition("group").sortWithinPartitions("group", "at").select("group", "at", "page", "host", "path", "lines")
    schema = pa.schema([("page", pa.int64()), ("shared", pa.list_(pa.int32()))])

    def nearest(before: dict | None, row: dict, after: dict | None) -> dict | None:
        near = [r for r in (before, after) if r and r["host"] == row["host"] and abs(r["at"] - row["at"]) == 1]
        return max(near, key=lambda r: common_start(r["path"], row["path"]), default=None)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered() -> Iterator[tuple[int, list[int]]]:
            before = row = None
            for batch in batches:
                for after in batch.to_pylist():
                    if row is not None:
                        follows = after if after["group"] == row["group"] else None
                        yield from one(before, row, follows)
                        before = row if follows else None
                    row = after
            if row is not None:
                yield from one(before, row, None)

        def one(before, row, after) -> Iterator[tuple[int, list[int]]]:
            if row["at"] // GROUP == row["group"] and row["lines"]:
                other = nearest(before, row, after)
                shared = shared_lines(row["lines"], other["lines"]) if other else []
                if shared:
                    yield row["page"], shared

        found = iter(answered())
        while some := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], f.type) for i, f in enumerate(schema)], schema=schema)

    return rows.mapInArrow(work, "page bigint, shared array<int>").dropDuplicates(["page"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of each row's main text.

    Where a page has an article or main element, its blocks are the text. Elsewhere the blocks are
    open to doubt: those on a longest common subsequence with the host's nearest page by path are deleted. Pages of a host with equal
    blocks are one page there, at the first of their paths, so that a copy is never the nearest; a page whose host has no
    other blocks keeps all. NULL and empty pages have an empty text and are no neighbours; pages without a host are
    neighbours of one another. Equal rows have equal results.
    """
    key = F.xxhash64("page_id", "url", "html")
    host, path = host_and_path(F.col("url"))
    keyed = pages.select("page_id", "url", "html", key.alias("page"))

    def start_lines():
        def answer(page: str) -> tuple:
            found, doubtful = main_blocks(page)
            return [xxhash.xxh64_intdigest(text.encode()) - (1 << 63) for text in found], doubtful

        return answer

    lines = keyed.select(host.alias("host"), path.alias("path"), "page", "html")
    lines = map_texts(lines, "html", ["page", "host", "path"], "lines array<bigint>, doubtful boolean", start_lines)
    # A certain page still is a neighbour.
    narrow = materialise(lines.withColumn("content", F.xxhash64("host", "lines")), "lines")
    doubtful = narrow.filter("doubtful").select("page", "content").distinct()
    first = F.min(F.struct("host", "path")).alias("at")
    different = narrow.filter(F.size("lines") > 0).groupBy("content").agg(first, F.first("lines").alias("lines"))
    shared = shared_with_nearest(different.select("at.host", "at.path", F.col("content").alias("page"), "lines"))
    shared = materialise(doubtful.join(shared.withColumnRenamed("page", "content"), "content").drop("content"), "shared")
    texts = map_texts(keyed, "html", ["page_id", "url", "page"], "blocks array<string>", lambda: lambda page: (main_blocks(page)[0],))
    joined = texts.join(shared, "page", "left")
    kept = F.filter("blocks", lambda _, i: ~F.array_contains("shared", i))
    text = F.array_join(F.when(F.col("shared").isNull(), F.col("blocks")).otherwise(kept), " ")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
