"""HTML main text by site style trees."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.common import bound_batches, table
from segmentry.session import materialize

#: Pages that must share a style node before its entropy counts, and the importance below which it goes.
LEAST_PAGES, IMPORTANCE = 8, 0.3
#: Share of a node's pages from which one of its texts is a notice, and the importance that outweighs an outside mark.
REPEATED, OUTWEIGHS = 0.5, 0.7
#: Share of a node's characters inside links from which it counts as a menu.
LINKED = 0.7

# Elements of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp
small span strike strong sub sup time tt u var wbr""".split())
UNREAD = frozenset("script style noscript template iframe svg math object canvas audio video select textarea title".split())
#: A new element of the key closes open ones of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
          "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table body html div section article main aside nav header footer form".split())
#: Presentation nodes that seldom hold the article, by element, role and words of class or id.
OUTSIDE = frozenset("nav aside form footer head button dialog menu fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
OUTSIDE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices
notification overlay pager pagination popup promo promoted promotion related respond sharing share sidebar sidenav
signup skip social sponsor sponsored subscribe toc toolbar topbar widget""".split())
WITHIN = frozenset(("article", "main"))
#: Of the outside words those that stand on stories too, and words of class or id that speak for a story.
LOOSE_WORDS = frozenset("notice notices promoted related social toc widget".split())
STORY_WORDS = frozenset("article body content entry post prose story text".split())
#: Unmarked text so many times as long as that inside articles makes those teasers.
TEASER = 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Marks that the style tree weighs: never shown, outside the article, none, inside, and outside by a loose word only.
HIDDEN, NOISE, CONTESTED, MAIN, LOOSE = -1, 0, 1, 2, 3


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if "=" in raw or raw.strip(" /") else {}


def _judged(tag: str, attributes: dict[str, str], parent: int) -> int:
    """Class of a node from its own marks and its parent's class."""
    if (parent == HIDDEN or "hidden" in attributes or attributes.get("aria-hidden") == "true"
            or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""))):
        return HIDDEN
    if parent == NOISE or tag in OUTSIDE or (tag == "header" and parent != MAIN):
        return NOISE
    if attributes.get("role", "").lower() in OUTSIDE_ROLES:
        return NOISE
    marks = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    words = {w.lower() for w in _WORD.findall(marks)} if marks.strip() else ()
    outside = OUTSIDE_WORDS.intersection(words) if tag not in ("html", "body", "article", "main") else ()
    if outside and not LOOSE_WORDS.issuperset(outside):
        return NOISE
    if outside and STORY_WORDS.isdisjoint(words):
        return LOOSE
    if tag in WITHIN or attributes.get("role", "").lower() in WITHIN:
        return MAIN
    if tag == "header" and parent == MAIN:
        return MAIN
    return parent


def blocks(page: str) -> list[tuple[str, int, str, int]]:
    """(style path, class, text, characters in links) of the text blocks of a page, in order.

    A style node is an element with its class and id; inline elements belong to their block. Unclosed
    elements end where the markup's rules end them.
    """
    stack: list[tuple[str, str, int]] = [("", "", CONTESTED)]
    out: list[tuple[str, int, str, int]] = []
    pieces: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                path = next(p for t, p, _ in reversed(stack) if t not in INLINE)
                out.append((path, stack[-1][2], text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def read(text: str) -> None:
        nonlocal linked
        if text and stack[-1][2] != HIDDEN:
            text = html.unescape(text)
            pieces.append(text)
            if in_link:
                linked += len(text.strip())

    def cut(depth: int) -> None:
        nonlocal in_link
        while len(stack) > depth:
            tag = stack.pop()[0]
            in_link -= tag == "a"

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            read(page[at:])
            break
        read(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if tag not in INLINE or (depth and any(t not in INLINE for t, _, _ in stack[depth:])):
                flush()
            elif depth and stack[depth][2] != stack[depth - 1][2]:
                flush()
            if depth:
                cut(depth)
            continue
        if tag in UNREAD:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not m[3].endswith("/"):
                at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag not in INLINE:
            flush()
            closed = CLOSES.get(tag)
            for k in range(len(stack) - 1, 0, -1):
                if closed and stack[k][0] in closed or stack[k][0] == "p":
                    cut(k)
                elif stack[k][0] in SCOPES and not (closed and stack[k][0] == "tbody"):
                    break
        attributes = _attributes(m[3])
        judged = _judged(tag, attributes, stack[-1][2])
        if tag in INLINE and judged != stack[-1][2]:
            flush()
        if tag in INLINE:
            path = stack[-1][1]
        else:
            mark = " ".join(sorted(re.sub(r"\d+", "", f"{attributes.get('class', '')} {attributes.get('id', '')}").split()))
            path = f"{stack[-1][1]}/{tag}" + (f"[{mark}]" if mark else "")
        in_link += tag == "a"
        stack.append((tag, path, judged))
    flush()
    return out


def _tree_rows(pages: DataFrame) -> DataFrame:
    """page_id, url, host, row and parallel arrays path, judged, text, linked, content of every page row.

    A path's hash takes in its marks, a content's its path.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(p or "") for p in batch.column("html").to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            flat = [b for f in found for b in f]
            listed = lambda values, kind: pa.ListArray.from_arrays(offsets, pa.array(values, kind))  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays([
                *(batch.column(n) for n in ("page_id", "url", "host")),
                listed([xxhash.xxh3_64_intdigest(f"{b[1]} {b[0]}") - 2**63 for b in flat], pa.int64()), listed([b[1] for b in flat], pa.int32()),
                listed([b[2] for b in flat], pa.string()), listed([b[3] for b in flat], pa.int32()),
                listed([xxhash.xxh3_64_intdigest(f"{b[1]} {b[0]}\n{b[2]}") - 2**63 for b in flat], pa.int64())],
                names=["page_id", "url", "host", "path", "judged", "text", "linked", "content"])

    return pages.mapInArrow(run, "page_id long, url string, host string, path array<long>, judged array<int>, "
                                 "text array<string>, linked array<int>, content array<long>")


def importance(trees: DataFrame) -> DataFrame:
    """host, path, judged, pages, importance, repeated of the style nodes of every site.

    A node that m pages of a host have is worth 1 - the mean entropy of its contents: a text on k of the m
    pages has entropy log k / log m. So what all pages repeat is worth 0 and what each has for itself 1.
    A node of few pages takes its worth from the host's domain, or else from all sites, where enough pages
    have it, and is worth 1 otherwise; `pages` are those of the level used. Presentation counts as well: a node that is
    mostly links is a menu, worth 0. `repeated` are contents on REPEATED of the host's pages with the node,
    whatever else it holds. Equal pages of a host count once.
    """
    seen = trees.select("row", "host", F.xxhash64("content").alias("page"))
    copied = seen.groupBy("host", "page").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).filter("n > 1")
    copies = materialize(seen.join(copied, ["host", "page"]).filter("row > first").select("row"), "copies")
    once = trees.join(copies, "row", "left_anti")
    sized = F.arrays_zip("path", "judged", "content", "linked", F.transform("text", lambda t: F.length(t)).alias("size"))
    node = once.select("host", F.explode(F.array_distinct(sized)).alias("b")).select("host", "b.*")
    node = node.withColumnRenamed(node.columns[-1], "size")
    domain = F.substring_index("host", ".", -2)
    content = node.groupBy("host", "path", "judged", "content").agg(
        F.count(F.lit(1)).alias("k"), F.sum("linked").alias("linked"), F.sum("size").alias("size"))
    on = once.select("host", F.explode(F.array_distinct("path")).alias("path")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"))
    content, on = materialize(content, "contents"), materialize(on, "nodes")
    dealt = content.withColumn("domain", domain).repartition("path", "content")  # one shuffle for domains and all sites

    def mean(*by: str) -> DataFrame:
        held = content if by == ("host",) else dealt.groupBy(*by, "path", "content").agg(
            F.sum("k").alias("k"), F.sum("linked").alias("linked"), F.sum("size").alias("size"))
        held = held.groupBy(*by, "path").agg((F.sum(F.col("k") * F.log("k")) / F.sum("k")).alias("entropy"),
                                             (F.sum("linked") / F.sum("size")).alias("linked"))
        wide = on.withColumn("domain", domain).groupBy(*by, "path").agg(F.sum("pages").alias("pages"))
        return held.join(wide, [*by, "path"]).select(*by, "path", F.struct("pages", "entropy", "linked").alias(f"of_{by[0] if by else 'all'}"))

    judged = content.groupBy("host", "path").agg(F.first("judged").alias("judged"))  # one, as the path's hash has it
    often = content.join(on, ["host", "path"]).filter((F.col("pages") >= LEAST_PAGES) & (F.col("k") >= REPEATED * F.col("pages"))
                                                      ).groupBy("host", "path").agg(F.collect_set("content").alias("repeated"))
    known = (judged.withColumn("domain", domain).join(mean("host"), ["host", "path"]).join(mean("domain"), ["domain", "path"])
             .join(mean(), "path").join(often, ["host", "path"], "left"))
    levels = [F.col(f"of_{k}") for k in ("host", "domain", "all")]
    level = F.coalesce(*(F.when(x["pages"] >= LEAST_PAGES, x) for x in levels), levels[0])
    value = F.when(level["linked"] >= LINKED, 0.0).when(level["pages"] < LEAST_PAGES, 1.0).otherwise(
        1 - level["entropy"] / F.log(level["pages"]))
    return known.select("host", "path", "judged", level["pages"].alias("pages"), value.alias("importance"),
                        F.coalesce("repeated", F.array().cast("array<long>")).alias("repeated"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text of every page row; the text is empty where there is none.

    Pages of a host are merged into a style tree of all that they show, and branches of low importance and
    repeated notices go, also inside an article. Marks weigh in as evidence of presentation: if what is left inside articles is at
    least as long as what is left without a mark, only that is the text, else both are. Nodes marked as menus, headers, footers,
    asides, forms, adverts, notices or comments are the text only of a page that has nothing else, and only where
    enough pages show that they are important; nodes marked by a loose word (LOOSE_WORDS) count as unmarked
    there. Articles much shorter than the unmarked text (TEASER) are teasers and go. Null pages and
    hosts are allowed; pages without host form one site. Repeated rows stay.

    Style nodes are counted by (host, path, content), so a site with a third of all pages combines map-side.
    The nodes to tell apart are joined to (page, path, content) rows; page texts only meet the few ids that are told.
    """
    bound_batches(pages.sparkSession)
    given = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.lower(F.coalesce(F.regexp_extract(
        F.col(url), r"^[a-zA-Z]+://([^/:?#]+)", 1), F.lit(""))).alias("host"), F.col(page).alias("html"))
    trees = materialize(_tree_rows(given).withColumn("row", F.monotonically_increasing_id()), "trees")
    # told apart: important nodes among those marked as outside, unimportant ones and notices among the others
    outside = F.col("judged").isin(NOISE, LOOSE)
    whole = F.when(outside, (F.col("importance") >= OUTWEIGHS) & (F.col("pages") >= LEAST_PAGES)).otherwise(F.col("importance") < IMPORTANCE)
    told = importance(trees).select("host", "path", whole.alias("whole"), F.when(outside, F.array().cast("array<long>")).otherwise(
        F.col("repeated")).alias("repeated")).filter(F.col("whole") | (F.size("repeated") > 0))
    held = trees.select("row", "host", F.explode(F.array_distinct(F.arrays_zip("path", "content"))).alias("b")).select("row", "host", "b.*")
    told = materialize(held.join(told, ["host", "path"]).filter(F.col("whole") | F.array_contains("repeated", F.col("content")))
                       .groupBy("row").agg(F.collect_set("content").alias("told")), "told")
    kept = trees.select("row", "page_id", "url", "judged", "text", "content").join(told, "row", "left")
    left = F.filter(F.arrays_zip("judged", "text", "content"), lambda b: b["judged"].isin(NOISE, LOOSE) == F.coalesce(
        F.array_contains("told", b["content"]), F.lit(False)))
    left = F.transform(left, lambda b: F.struct(F.when(b["judged"] == LOOSE, CONTESTED).otherwise(b["judged"]).alias("judged"),
                                                b["text"].alias("text")))
    chars = lambda mark: F.aggregate(F.filter("left", lambda b: b["judged"] == mark), F.lit(0),
                                     lambda n, b: n + F.length(b["text"]))
    kept = kept.select("page_id", "url", left.alias("left")).withColumns({"inside": chars(MAIN), "between": chars(CONTESTED)})
    least = F.when((F.col("inside") > 0) & (F.col("inside") >= F.col("between")), MAIN).when(
        F.col("inside") + F.col("between") > 0, CONTESTED).otherwise(NOISE)
    most = F.when(F.col("between") > TEASER * F.col("inside"), CONTESTED).otherwise(MAIN)
    take = F.filter(F.col("left"), lambda b: (b["judged"] >= least) & (b["judged"] <= most))
    return kept.select("page_id", "url", F.array_join(F.transform(take, lambda b: b["text"]), " ").alias("text"))


def op8_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    found = main_text(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
