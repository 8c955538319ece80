"""Main text of web pages by consensus host paths.

Every page is cut into blocks of text, and its containers are scored by the article text that they hold. Each page
votes for the generalised tag-class path of its best container; Spark adds up the votes of each host. Then the blocks
of all containers at the host's winning path, in page order, are the page's text. A page without a container there uses
the path of its own best.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, save, table, text_chunks

BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER_TAGS = frozenset("article main section div td body".split())
SKIPPED_TAGS = frozenset("head nav header footer aside form menu button select option datalist dialog noscript template iframe object svg math canvas audio video".split())
RAW_TAGS = "script|style|textarea|title|xmp|noembed|noframes"
#: Words in a class or id that mark what is not the article.
SKIPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside rail notice notices notification alert cookie cookies consent gdpr popup modal overlay form search login signup subscribe subscription newsletter comment comments commentlist disqus replies reply respond share sharing social related recommended widget toolbar pagination pager hidden".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Of these, and of names, those that may mark a wrapper of the whole page: there they skip only what is not most of its text.
WRAPPER_TAGS = frozenset("nav header footer aside form noscript".split())
#: Names of reader comments. They skip an element whatever it holds, but for one around an article of its own.
REMARK_NAMES = frozenset("comment comments commentlist disqus replies reply respond".split())
#: A class that has one of these words beside such a name tells a state of the page, as in comments-open or no-replies.
STATE_WORDS = frozenset("no not has have with without show hide is open opened closed close enabled disabled on off allow allowed count".split())
#: Whole classes that hide an element, and those beside it that show it again on wider screens.
HIDING_CLASSES, SHOWING = frozenset(["hidden"]), re.compile(r"^\w+:(?:block|flex|grid|inline|contents|table|visible)")
CONTENT_NAMES = frozenset("article content post entry story body text main".split())
#: An opening tag closes these open elements, unless one of the second set lies between.
CLOSES = {
    "p": (frozenset(["p"]), frozenset("td th table button".split())),
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements nested deeper than this count as text of the one at this depth, but for those whose tag marks side matter; so paths
#: and scans of open elements are bounded.
MAX_DEPTH = 256


def token_pattern(attributes: str) -> re.Pattern:
    """A comment, an element of raw text, a tag or a declaration. No part of it is matched in more than one way, so it
    takes time in proportion to what it reads."""
    return re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW_TAGS})\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({attributes})>|<[!?][^>]*+>", re.S | re.I)


TOKEN = token_pattern(r"""(?:[^'">]|"[^"]*+"|'[^']*+')*+""")
#: Used from the first tag on whose quotes are open to the end of the page: there a tag ends at the next ``>``.
LOOSE_TOKEN = token_pattern("[^>]*+")
TAG_START = re.compile("</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>]++)))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Element:
    __slots__ = ("anchor", "article", "bonus", "chars", "depth", "doubtful", "end", "first", "heading", "held", "last", "never", "parent", "path", "remark", "skipped", "tag", "veiled")

    def __init__(self, tag: str, parent: Element | None, attributes: str, first: int, spared: bool = False):
        self.tag, self.parent, self.first, self.last = tag, parent, first, first
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.held = self.end = 0
        self.never = bool(parent and parent.never) or tag in SKIPPED_TAGS - WRAPPER_TAGS
        self.article = tag == "article" or bool(parent and parent.article)
        self.heading = tag in HEADINGS or bool(parent and parent.heading)
        own_header = tag == "header" and self.article  # the title of the article, not of the site
        self.doubtful = tag in WRAPPER_TAGS and not own_header
        self.bonus, classes = tag in ("article", "main"), ""
        self.remark = self.veiled = False
        if attributes and not attributes.isspace():
            found: dict[str, str] = {}
            for k, a, b, c in ATTRIBUTE.findall(attributes):
                found.setdefault(k.lower(), a or b or c or "")
            tokens = [{w.lower() for w in NAME_WORD.findall(t)} for v in (found.get("class", ""), found.get("id", "")) for t in v.split()]
            # a state names neither comments nor what is hidden
            tokens = [t - REMARK_NAMES if t & REMARK_NAMES and t & STATE_WORDS else t for t in tokens]
            names = {w for t in tokens for w in t} - {"hidden"}
            shown = found.get("class", "").split()
            roles = found.get("role", "").lower()
            if tag not in ("html", "body"):
                hidden = found.get("hidden", "until-found").lower() != "until-found" or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
                self.never |= hidden
                self.remark = not REMARK_NAMES.isdisjoint(names)
                self.veiled = not HIDING_CLASSES.isdisjoint(shown) and not any(map(SHOWING.match, shown))
                self.doubtful |= self.remark or self.veiled or roles in SKIPPED_ROLES or not SKIPPED_NAMES.isdisjoint(names - {"header"} if own_header else names)
                self.bonus = not self.remark and (self.bonus or roles == "main" or not CONTENT_NAMES.isdisjoint(names))
            classes = "".join(sorted("." + re.sub(r"\d+", "N", c) for c in found.get("class", "").split()))
        self.anchor = (tag in ("article", "main", "h1") or (self.bonus and tag != "div" and tag in CONTAINER_TAGS)) and not self.remark
        self.skipped = bool(parent and parent.skipped) or self.never or (self.doubtful and not spared)
        # the tag-class path from the root, as a hash: a path of any depth takes eight bytes
        self.path = xxhash.xxh64_intdigest(f"{parent.path if parent else 0}>{tag}{classes}") - (1 << 63)


def wrappers(elements: list[Element]) -> frozenset[int]:
    """Numbers of the skipped elements that hold most of the page's text outside links, and so are no side matter.

    An element stays skipped if an article-like one stands beside it, or one around it has over a tenth as much text. One
    that names comments or hides itself stays skipped too, unless an article of its own (``article``, ``main``, ``h1``) is
    inside, or, for one that hides itself, there is hardly any other text.
    """
    half = (elements[0].chars + elements[0].held) / 2
    anchors = [i for i, e in enumerate(elements) if e.anchor]
    large = [i for i, e in enumerate(elements) if e.doubtful and not e.never and e.held > half]
    article = [i for i, e in enumerate(elements) if e.bonus and not e.skipped] if large else []

    def side_matter(i: int) -> bool:
        own = elements[i]
        if (own.remark or own.veiled) and bisect_left(anchors, i) == bisect_left(anchors, own.end) and not (own.veiled and not own.remark and own.held > 1.9 * half):
            return True
        around, e = [], elements[i].parent
        while e:
            if e.bonus and not e.skipped:
                around.append(e)
            e = e.parent
        inside = bisect_left(article, elements[i].end) - bisect_left(article, i)
        return len(article) > inside + len(around) or any(e.chars * 10 > elements[i].held for e in around)

    return frozenset(i for i in large if not side_matter(i))


def outermost(best: Element, blocks: list[str], own: list[int], headings: set[int]) -> Element:
    """``best`` or the last container around it that adds only text of the article: blocks that are not mostly links, in
    an article-like container, or headings."""
    e, outer = best.parent, best
    while e and e.tag not in ("html", "body", "#page"):
        if e.tag in CONTAINER_TAGS:
            added = [*range(e.first, outer.first), *range(outer.last, e.last)]
            if not all(2 * own[i] > len(blocks[i]) and (e.bonus or i in headings) for i in added):
                break
            if added:
                outer = e
        e = e.parent
    return outer


def read_page(page: str | None, spared: frozenset[int] = frozenset()) -> tuple[list[str], list[tuple[int, int, int, float]]]:
    """The kept blocks of a page, and its containers as (hash of the path, first block, last block, score), best first.

    Score: share of the page's kept text that is not in links, more for article-like tags and names, and a little for
    depth, so that of containers with the same text the innermost counts. The first is then the outermost around the
    best that adds only text of the article. ``spared`` are numbers of elements that are not skipped by tag or name.
    Time and memory are in proportion to the page's length, however it is nested or broken.
    """
    page = page or ""
    blocks: list[str] = []
    owned: list[int] = []
    headings: set[int] = set()
    root = Element("#page", None, "", 0)
    stack, elements = [root], [root]
    opened: Counter[str] = Counter()  # open elements of each tag
    too_deep: Counter[str] = Counter()  # open tags below the greatest depth
    deep_skips = 0  # those of them that hold no text of the page
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                own = max(0, len(text) - linked)
                if stack[-1].heading:
                    headings.add(len(blocks))
                blocks.append(text)
                owned.append(own)
                stack[-1].chars += own
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        for e in reversed(stack[upto:]):
            e.last, e.end = len(blocks), len(elements)
            opened[e.tag] -= 1
            if e.parent:
                e.parent.chars += e.chars
                e.parent.held += e.held
        del stack[upto:]

    def read_text(text: str) -> None:
        nonlocal linked
        if deep_skips:
            return
        if not stack[-1].skipped:
            parts.append(text)
            linked += len(text) if links else 0
        elif not links and not stack[-1].never:
            stack[-1].held += len(" ".join(text.split()))

    at = look = links = 0
    pattern, last = TOKEN, page.rfind(">")
    while 0 <= (low := page.find("<", look)) < last:
        m = pattern.match(page, low)
        if m is None:
            if pattern is TOKEN and TAG_START.match(page, low):
                pattern = LOOSE_TOKEN
            else:  # a sign of its own
                look = low + 1
            continue
        if low > at:
            read_text(page[at:low])
        at = look = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK_TAGS
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            if block:
                flush()
            if too_deep[tag] > 0:
                too_deep[tag] -= 1
                deep_skips -= tag in SKIPPED_TAGS
            elif opened[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if not block and stack[i].tag in BLOCK_TAGS:  # an inline end tag stays within its block
                        break
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                flush()
            elif tag == "br" and not stack[-1].skipped:
                parts.append(" ")
            continue
        if tag == "a":
            links += 1
        if block:
            flush()
            links = 0
            ends, stops = CLOSES.get(tag, CLOSES["p"])
            if any(opened[t] > 0 for t in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        close(i)
                        break
                    if stack[i].tag in stops:
                        break
        if m[4].endswith("/") and tag in ("svg", "path", "use"):
            continue
        if len(stack) > MAX_DEPTH:
            too_deep[tag] += 1
            deep_skips += tag in SKIPPED_TAGS
            continue
        element = Element(tag, stack[-1], m[4], len(blocks), len(elements) in spared)
        stack.append(element)
        opened[tag] += 1
        elements.append(element)
    if at < len(page):
        read_text(page[at:])
    flush()
    close(0)
    if root.held and not spared and (found := wrappers(elements)):
        return read_page(page, found)
    total = root.chars or 1
    score = lambda e: e.chars / total + 0.6 * e.bonus + 0.01 * min(e.depth, 20)
    kept = sorted((e for e in elements if e.chars and not e.skipped and (e.tag in CONTAINER_TAGS or e is root)), key=lambda e: -score(e))
    if kept:
        kept.insert(0, kept.pop(kept.index(outermost(kept[0], blocks, owned, headings))))
    return blocks, [(e.path, e.first, e.last, score(e)) for e in kept]


def parsed_pages(pages: DataFrame, key: str, url: str, source: str) -> DataFrame:
    """(key, url, host, blocks, containers) of every page."""
    rows = pick(pages, key=key, url=url, text=source)
    shape = pa.list_(pa.struct([("path", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            read = [read_page(t) for t in texts]
            containers = [[{"path": p, "first": a, "last": b, "score": s} for p, a, b, s in c] for _, c in read]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([b for b, _ in read], pa.list_(pa.string())), pa.array(containers, shape)], names=["key", "url", "blocks", "containers"])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, f"key {kinds['key']}, url {kinds['url']}, blocks array<string>, containers array<struct<path:long,first:int,last:int,score:double>>")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return out.withColumn("host", host)


def winning_paths(parsed: DataFrame) -> DataFrame:
    """(host, winner): the path with the greatest sum of the pages' best scores; of equal ones the least path.

    A path is known by its 64-bit hash."""
    votes = parsed.filter(F.size("containers") > 0).select("host", F.col("containers")[0]["path"].alias("path"), F.col("containers")[0]["score"].alias("score"))
    # whole thousandths, so that the sum does not depend on its order
    sums = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("score") * 1000).cast("long")).alias("votes"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("winner"))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``key``, ``url`` and ``text`` of every page: the blocks of its main containers, joined by an empty line.

    Null and empty pages, and pages without article text, have an empty text; pages without a host vote together.
    Pages are read whole, very long ones too. Repeated rows keep a row each; an empty table gives an empty result; other
    columns are left out.
    """
    parsed = save(parsed_pages(pages, key, url, source), "pages")
    winners = save(winning_paths(parsed), "paths")
    if winners.count() <= 100_000:  # a host and a path each: some tens of MB at most
        winners = F.broadcast(winners)
    joined = parsed.join(winners, "host", "left")
    # all containers of a path, which are equally deep and so never within each other; the first container is the best
    own = F.get("containers", F.lit(0))["path"]
    path = F.when(F.exists("containers", lambda c: c["path"] == F.col("winner")), F.col("winner")).otherwise(own)
    chosen = F.array_sort(F.transform(F.filter("containers", lambda c: c["path"] == F.col("path")), lambda c: F.struct(c["first"], c["last"])))
    text = F.array_join(F.flatten(F.transform(chosen, lambda c: F.slice("blocks", c["first"] + 1, c["last"] - c["first"]))), "\n\n")
    joined = joined.withColumn("path", path)
    return joined.select(F.col("key").alias(key), F.col("url").alias(url), F.coalesce(text, F.lit("")).alias("text"))


def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
