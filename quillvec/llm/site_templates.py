"""Main text of web pages, with the templates of their sites removed.

Every element's subtree is hashed twice: by its markup, and by its place, which is the kinds and names of the elements
from the root down to it, whatever its words. Spark counts, host by host, on how many different pages a subtree and a
place recur and how much of the host's text and links stand there. What recurs is decided by these counts; a list of
class names and the rule that text outside the article goes decide only for what too few pages show. Elements that by
their kind are menus, footers, sidebars, forms or scripts, and readers' comments, are left out from the start.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillvec.llm.common import small_batches
from quillvec.llm.near_dup import BROADCAST_IDS
from quillvec.session import settle

# A subtree is a template of its host if it is on this many different pages. Where it lies inside an article or main
# element, which may repeat what others say, it must also be on this share of them.
LEAST_PAGES = 5
LEAST_SHARE = 0.3
# A place outside the article that recurs is a template, whatever its words, if it holds less than this share of the
# host's text, or more links than this share of its own text. On pages without article or main element, only a place of
# links that holds less than half of the host's text is.
PLACE_SHARE = 0.25
LINK_SHARE = 0.5
# The names and the article decide for what is on fewer pages than this.
LISTED_BELOW = 5

# --- fixed values: element kinds -------------------------------------------------------------------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br".split()
)
# What holds a whole page or article.
WHOLE = set("html body article main".split())
# Blocks of text: what an article says, even if several pages say it.
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr caption figcaption".split()) | WHOLE
CLOSE_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
# An element that ends the earlier one of its kind, up to the element that holds both.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
DROPPED = set(
    "head nav footer aside form script style noscript template iframe svg math canvas object button select textarea "
    "dialog menu audio video".split()
)
DROPPED_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
DROPPED_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs "
    "consent cookie cookies footer gdpr masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination pager popup promo promoted promotion promotions related share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
COMMENT_NAMES = set("comment comments reply replies respond disqus".split())
# Words that say where or what kind of box, not what is in it.
BOX_WORDS = set(
    "area bar block bottom box button buttons container footer form global group header inner item items left link links "
    "list main outer page primary right secondary section site slot thread top unit wrap wrapper".split()
)
# --- end of fixed values ---------------------------------------------------------------------------

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^'\">]|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<rest2>[^>]*)>",
    re.IGNORECASE | re.DOTALL,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
DIGITS = re.compile(r"\d+")
NAME_PARTS = re.compile(r"[-_]+")


def means(name: str, words: set[str]) -> bool:
    """Whether a class name or id says one of `words` and nothing else but where it stands."""
    parts = [p for p in NAME_PARTS.split(DIGITS.sub("", name)) if p]
    return any(p in words for p in parts) and all(p in words or p in BOX_WORDS for p in parts)


def names_of(rest: str) -> tuple[set[str], list[str]]:
    """Roles, and class names and ids, of an element's attributes."""
    roles, names = set(), []
    if "=" in rest:
        for name, value in NAMED.findall(rest):
            found = value.strip("\"'").lower().split()
            roles.update(found) if name.lower() == "role" else names.extend(found)
    return roles, names


class Page(NamedTuple):
    blocks: list[str]
    # Whether each block is in an article or main element, and how much of it is in links.
    inside: list[bool]
    linked: list[int]
    # (markup hash, place hash or None, first block, end block, inside, holds a part inside)
    subtrees: list[tuple[int, int | None, int, int, bool, bool]]
    # Blocks of elements whose names are listed.
    listed: list[tuple[int, int]]
    main: bool


def parse(html: str) -> Page:
    """The blocks of a page and the subtrees that hold them.

    Paragraphs, headings, list items and cells are subtrees outside an article or main element only, and have a place
    only if they are named.
    """
    page = Page([], [], [], [], [], False)
    blocks = page.blocks
    # (tag, position, first block, drops, listed, path, named)
    stack: list[tuple[str, int, int, bool, bool, int, bool]] = []
    text: list[str] = []
    drops = soft = articles = mains = links = link_chars = 0
    seen = False
    # How many blocks of an article or main element there are before each block.
    before = [0]

    def flush() -> None:
        nonlocal link_chars
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if block:
                blocks.append(block)
                page.inside.append(articles + mains > 0)
                page.linked.append(min(link_chars, len(block)))
                before.append(before[-1] + page.inside[-1])
        link_chars = 0

    def close(depth: int, end: int) -> None:
        """Close the elements from `depth` on; their markup ends at `end`."""
        nonlocal drops, soft, articles, mains, links
        while len(stack) > depth:
            tag, start, first, drop, listed, path, named = stack.pop()
            links -= tag == "a"
            if tag not in INLINE:
                if not drops:
                    flush()
                inside = articles + mains > 0
                if not drops and len(blocks) > first:
                    if tag not in (TEXT_BLOCKS if inside else WHOLE):
                        place = path if named or tag not in TEXT_BLOCKS else None
                        markup = xxhash.xxh3_64_intdigest(html[start:end]) - 2**63
                        page.subtrees.append((markup, place, first, len(blocks), inside, before[-1] > before[first]))
                    if listed:
                        page.listed.append((first, len(blocks)))
            drops -= drop
            soft -= listed
            if not drops and not drop and not soft and not listed:
                articles -= tag == "article"
                mains -= tag == "main"

    def add(piece: str) -> None:
        nonlocal link_chars
        text.append(piece)
        if links:
            link_chars += len(piece.strip())

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at and not drops:
            add(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        path = stack[-1][5] if stack else 0
        if m["close"] or m["close2"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth, m.end())
                    break
                if tag in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        if tag in INLINE:
            if tag == "br" and not drops:
                text.append(" ")
            if tag not in VOID:
                links += tag == "a"
                stack.append((tag, m.start(), len(blocks), False, False, path, False))
            continue
        if tag in CLOSE_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    close(depth, m.start())
                    break
                if stack[depth][0] not in INLINE:
                    break
        if tag in SIBLINGS:
            ended, scope = SIBLINGS[tag]
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ended:
                    close(depth, m.start())
                    break
                if stack[depth][0] in scope:
                    break
        if not drops:
            flush()
        if tag in VOID:
            continue
        roles, names = names_of(m["rest"] if m["rest"] is not None else m["rest2"] or "")
        whole = tag in ("html", "body", "main")
        drop = tag in DROPPED or (tag == "header" and not articles) or (
            not whole and (bool(roles & DROPPED_ROLES) or any(means(n, COMMENT_NAMES) for n in names))
        )
        listed = not whole and tag != "article" and any(means(n, DROPPED_NAMES) for n in names)
        drops += drop
        soft += listed
        if not drops and not soft:
            articles += tag == "article"
            mains += tag == "main"
            seen |= tag in ("article", "main")
        label = " ".join([tag, *sorted(DIGITS.sub("0", n) for n in names)])
        path = xxhash.xxh3_64_intdigest(f"{stack[-1][5] if stack else 0} {label}") - 2**63
        stack.append((tag, m.start(), len(blocks), drop, listed, path, bool(names)))
    if not drops:
        add(html[at:])
        flush()
    close(0, len(html))
    return page._replace(main=seen)


def runs(marks: list[bool]) -> list[tuple[int, int]]:
    """(first, end) of each run of true marks."""
    ends = [i for i in range(len(marks) + 1) if (i < len(marks) and marks[i]) != (i > 0 and marks[i - 1])]
    return list(zip(ends[::2], ends[1::2]))


def without_counts(page: Page) -> tuple[list[tuple[int, int]], bool]:
    """The cuts of a page that names and the article make, and whether it has a main part.

    Text outside the article or main elements goes, if these hold half of the page's text at least, or none at all.
    """
    named = [False] * len(page.blocks)
    for first, end in page.listed:
        named[first:end] = [True] * (end - first)
    sizes = [0 if n else len(b) for n, b in zip(named, page.blocks)]
    main = sum(s for s, i in zip(sizes, page.inside) if i)
    has_main = page.main and (not main or 2 * main >= sum(sizes))
    return page.listed + (runs([not i for i in page.inside]) if has_main else []), has_main


def kept(blocks: int, cuts: list[tuple[int, int]], templates: list[tuple[int, int]], contents: list[tuple[int, int]]) -> list[bool]:
    """Which blocks stay: none of a template, and of a cut only what lies in a content inside it."""
    marks = np.zeros(blocks + 1, dtype=np.int32)
    for first, end in templates:
        marks[first] += 1
        marks[end] -= 1
    dropped = np.cumsum(marks)[:blocks] > 0
    for first, end in cuts:
        inner = [(a, b) for a, b in contents if first <= a and b <= end]
        held = np.ones(end - first, dtype=bool)
        for a, b in inner:
            held[a - first : b - first] = False
        dropped[first:end] |= held
    return (~dropped).tolist()


CUT = "struct<first:int,end:int>"
PARSED = (
    f"row struct<page_id:bigint,url:string,page:bigint>, host string, chars bigint, blocks array<string>, stays array<boolean>, cuts array<{CUT}>, "
    "places array<struct<place:bigint,outside:boolean,chars:bigint,linked:bigint>>, "
    "subtrees array<struct<key:bigint,kind:int,first:int,end:int,open:boolean,shut:boolean>>"
)
# Kinds of keys: markup outside and inside an article, places outside the main part and on pages without one.
MARKUP, MARKUP_INSIDE, PLACE_OUTSIDE, PLACE_PLAIN = range(4)


def page_row(page_id: int | None, url: str | None, html: str | None) -> dict:
    page = parse(html or "")
    cuts, has_main = without_counts(page)
    n = len(page.blocks)
    stays = kept(n, cuts, [], [])
    so_far, chars, linked = [0], [0], [0]
    for b, s, k in zip(page.blocks, stays, page.linked):
        so_far.append(so_far[-1] + s)
        chars.append(chars[-1] + len(b))
        linked.append(linked[-1] + k)
    subtrees, places = [], {}
    for markup, place, first, end, inside, holds in page.subtrees:
        stay = so_far[end] - so_far[first]
        at = {"first": first, "end": end, "open": stay > 0, "shut": stay < end - first}
        subtrees.append({"key": markup, "kind": MARKUP_INSIDE if inside else MARKUP, **at})
        if place is not None and not inside and not holds:
            subtrees.append({"key": place, "kind": PLACE_OUTSIDE if has_main else PLACE_PLAIN, **at})
            known = places.setdefault(place, {"place": place, "outside": has_main, "chars": 0, "linked": 0})
            known["chars"] += chars[end] - chars[first]
            known["linked"] += linked[end] - linked[first]
    try:
        host = urlsplit(url or "").hostname or ""
    except ValueError:
        host = ""
    same = "\n".join(b for b, s in zip(page.blocks, stays) if s)
    return {
        "row": {"page_id": page_id, "url": url, "page": xxhash.xxh3_64_intdigest(same) - 2**63},
        "host": host, "chars": chars[-1], "blocks": page.blocks, "stays": stays,
        "cuts": [{"first": a, "end": b} for a, b in cuts], "places": list(places.values()), "subtrees": subtrees,
    }


def page_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = pa.struct([("first", pa.int32()), ("end", pa.int32())])
    place = pa.struct([("place", pa.int64()), ("outside", pa.bool_()), ("chars", pa.int64()), ("linked", pa.int64())])
    subtree = pa.struct(
        [("key", pa.int64()), ("kind", pa.int32()), ("first", pa.int32()), ("end", pa.int32()), ("open", pa.bool_()), ("shut", pa.bool_())]
    )
    schema = pa.schema([
        ("row", pa.struct([("page_id", pa.int64()), ("url", pa.string()), ("page", pa.int64())])), ("host", pa.string()),
        ("chars", pa.int64()), ("blocks", pa.list_(pa.string())), ("stays", pa.list_(pa.bool_())), ("cuts", pa.list_(cut)), ("places", pa.list_(place)),
        ("subtrees", pa.list_(subtree)),
    ])
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html"))
        yield pa.RecordBatch.from_pylist([page_row(*r) for r in zip(*columns)], schema=schema)


def verdicts(parsed: DataFrame, least_pages: int, least_share: float, listed_below: int) -> DataFrame:
    """host, key, kind and template of the subtrees and places that enough different pages of a host show."""
    pages = parsed.groupBy("host", "row.page").agg(F.max("chars").alias("chars"))
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("host_chars"))
    markup = F.filter("subtrees", lambda t: t["kind"] <= MARKUP_INSIDE)
    seen = parsed.select("host", "row.page", F.explode(F.transform(markup, lambda t: F.struct(t["key"].alias("key"), t["kind"].alias("kind")))).alias("t"))
    recurring = (
        seen.select("host", "page", "t.*").distinct().groupBy("host", "key", "kind").agg(F.count(F.lit(1)).alias("on"))
        .where(F.col("on") >= least_pages).join(hosts, "host")
        .where((F.col("kind") == MARKUP) | (F.col("on") >= F.col("pages") * least_share))
        .select("host", "key", "kind", F.lit(True).alias("template"))
    )
    places = parsed.select("host", "row.page", F.explode("places").alias("p")).select("host", "page", "p.*")
    placed = (
        places.groupBy("host", "page", "place", "outside").agg(F.max("chars").alias("chars"), F.max("linked").alias("linked"))
        .groupBy("host", "place", "outside")
        .agg(F.count(F.lit(1)).alias("on"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
        .where(F.col("on") >= min(least_pages, listed_below)).join(hosts, "host")
    )
    share, of_links = F.col("chars") / F.col("host_chars"), F.col("linked") >= LINK_SHARE * F.col("chars")
    furniture = F.when(F.col("outside"), of_links | (share < PLACE_SHARE)).otherwise(of_links & (share < 0.5))
    judged = placed.withColumn("template", furniture & (F.col("on") >= least_pages)).where(F.col("template") | (F.col("on") >= listed_below))
    kind = F.when(F.col("outside"), PLACE_OUTSIDE).otherwise(PLACE_PLAIN)
    return recurring.unionByName(judged.select("host", F.col("place").alias("key"), kind.alias("kind"), "template"))


def main_text(
    pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, listed_below: int = LISTED_BELOW
) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html).

    Blocks are joined by a line feed; white space inside a block is one space; character references are decoded. Pages
    with the same text count once when a host's subtrees and places are counted, so copies of a page don't make it a
    template. Markup on `least_pages` pages is a template; inside an article or main element it must be on `least_share`
    of the host's pages too, and paragraphs, headings, list items and cells are never templates by themselves: an
    article may repeat another's. Outside, the number of pages decides alone, so that a large host's sections and
    designs lose theirs. A place outside the article that is on `least_pages` pages goes if it holds little of the
    host's text or mostly links, and stays otherwise, however its element is named. Names and the rule that only the
    article counts decide for places on fewer than `listed_below` pages.
    A null or empty page has an empty text; a null url is a host of its own; repeated rows are returned as often; an
    empty table gives no rows.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    with small_batches(pages.sparkSession):
        parsed = settle(source.mapInArrow(page_batches, PARSED), "parsed")
    judged = settle(verdicts(parsed, least_pages, least_share, listed_below), "judged")
    # Only what differs from the cuts already made: templates with blocks that stay, contents with blocks that don't.
    where = parsed.select("row", "host", F.explode("subtrees").alias("s")).select("row", "host", "s.*")
    where = where.where("open OR (shut AND kind >= 2)")
    if judged.count() <= BROADCAST_IDS // 10:
        met = where.join(F.broadcast(judged), ["host", "key", "kind"])
    else:
        # A large host's places are on all of its pages: its rows are dealt over salts, the verdicts repeated.
        salts = F.explode(F.array(*[F.lit(i) for i in range(16)])).alias("salt")
        met = where.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(16)).cast("int")).join(
            judged.select("*", salts), ["host", "key", "kind", "salt"]
        )
    spans = F.collect_set(F.struct("first", "end", "template")).alias("found")
    changes = met.where("IF(template, open, shut)").groupBy("row").agg(spans).withColumnRenamed("row", "found_row")
    found = settle(changes, "found")
    few = F.broadcast(found) if found.count() <= BROADCAST_IDS // 10 else found
    joined = parsed.select("row", "blocks", "stays", "cuts").join(few, F.col("row").eqNullSafe(F.col("found_row")), "left")
    # The rules of `kept`, for the pages whose cuts the counts change.
    holds = lambda span, i: (span["first"] <= i) & (i < span["end"])
    template = lambda i: F.exists("found", lambda f: f["template"] & holds(f, i))
    within = lambda c, i: F.exists("found", lambda f: ~f["template"] & holds(f, i) & (c["first"] <= f["first"]) & (f["end"] <= c["end"]))
    cut = lambda i: F.exists("cuts", lambda c: holds(c, i) & ~within(c, i))
    unchanged = F.filter("blocks", lambda b, i: F.get("stays", i))
    changed = F.filter("blocks", lambda b, i: ~template(i) & ~cut(i))
    text = F.array_join(F.when(F.col("found").isNull(), unchanged).otherwise(changed), "\n")
    return joined.select("row.page_id", "row.url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf}/pages.parquet"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
