"""HTML extraction with consensus host paths.

1. Every page is parsed by itself: its text blocks are found, each below a
   chain of containers, and the containers are scored by the text that stands in
   them outside links and boilerplate.  Elements that say by their kind that they
   are boilerplate (``nav``, ``footer``, hidden ones) are left out.  Names of
   classes and ids are only a hint: text below them counts at a ``DOUBT`` of its
   length, and where even so it outweighs all else, the name was misleading and
   the element stays.  From the best one the search climbs to
   the article or main element around it, or, where there is none, to the
   innermost container with all unlinked text of the page; that one casts the
   page's vote: its generalised tag-class path (digits and order of classes
   don't matter).
2. Spark counts the votes by host and path, partially before the shuffle, and
   the most frequent path of each host wins.
3. Every page is parsed again and extracted below all containers with its host's
   winning path; a page that has none, or in which they hold less than
   ``NEARLY_ALL`` of the text below the page's own best one, falls back on the latter.

Hosts' winners are one short row per host.  They are broadcast only if there
are at most ``BROADCAST_HOSTS`` of them; beyond that they are joined by host,
where adaptive execution splits a hot host's pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, cut, small_batches

BROADCAST_HOSTS = 20_000
NEARLY_ALL = 0.95
LONGEST_PATH = 500

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[a-zA-Z/!?][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# How elements and class names are read.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark math nobr picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
MATH = frozenset(
    "annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext "
    "mtr munder munderover none semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LIST_TAGS = frozenset("ul ol li".split())
CONTAINERS = frozenset("article body center div html main section td".split())
BOILERPLATE_TAGS = frozenset("aside button datalist dialog footer form head menu nav select".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion donate footer form gdpr login masthead menu "
    "modal nav navbar navigation newsletter notice overlay pager pagination paywall popup privacy promo promoted promotion recommended related replies reply respond responses search share sharing "
    "sidebar signin signup skip social sponsor sponsored subscribe subscription tagcloud teaser toolbar topbar widget".split()
)
#: Of these words, those that hardly ever name anything else.
PLAIN_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter pager "
    "pagination popup promo promoted related replies reply respond sharing sidebar signin signup skip social sponsor sponsored subscribe toolbar topbar".split()
)
#: What text below a name counts, for plain words and for the others.
DOUBT = (0.01, 0.25)
HEADER_WORDS = frozenset("header".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: Elements whose ids are anchors and say nothing of what they hold; a section's does so inside an article or content only.
ANCHORED = INLINE | frozenset("h1 h2 h3 h4 h5 h6 p".split())
BEFORE_HARMLESS = frozenset("has no with without".split())


class _Kind:
    __slots__ = ("bad", "bonus", "content", "doubt", "label", "main", "named")

    def __init__(self, tag: str, attrs: str):
        found: dict[str, str] = {}
        for m in _ATTR.finditer(attrs):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        classes, anchors = ([[p.lower() for p in _PART.findall(name)] for name in found.get(x, "").split()] for x in ("class", "id"))
        flat = {p for name in classes + anchors for p in name}
        bad = tag in BOILERPLATE_TAGS or found.get("role", "").lower() in BOILERPLATE_ROLES
        bad |= "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))

        def doubt(names: list[list[str]]) -> float:
            """0 without a word for boilerplate, else what text below is worth."""
            out = 0.0
            for name in names:
                for i, p in enumerate(name):
                    header = p in HEADER_WORDS and tag not in INLINE and not re.fullmatch("h[1-6]", tag)
                    if (p in BOILERPLATE_WORDS or header) and not (i and name[i - 1] in BEFORE_HARMLESS):
                        last = i == len(name) - 1 and not header  # an entry-header holds the title, an entry-footer nothing of the text
                        if last or not flat & CONTENT_WORDS:
                            worth = DOUBT[0] if p in PLAIN_WORDS else DOUBT[1]
                            out = min(out or worth, worth)
            return out

        whole = tag in ("html", "body", "article", "main")
        self.bad = bad
        self.doubt = 0.0 if whole else doubt(classes)
        self.named = 0.0 if whole or tag in ANCHORED else doubt(anchors)  # by its id alone
        if self.named and tag != "section" and ["section"] not in classes:
            self.doubt, self.named = min(self.doubt or self.named, self.named), 0.0
        self.content = tag not in ("html", "body") and (tag in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articleBody" or bool(flat & CONTENT_WORDS))
        self.bonus = (1.5 if tag == "article" or found.get("itemprop") == "articleBody" else 1.25 if tag == "main" or found.get("role") == "main" else 1.0) * (1.25 if flat & CONTENT_WORDS else 1.0)
        labels = sorted({re.sub(r"\d+", "#", c.lower()) for c in found.get("class", "").split()})
        self.main = tag == "main" or found.get("role") == "main"
        self.label = ".".join([tag, *labels])


_kinds: dict[tuple[str, str], _Kind] = {}


def _kind(tag: str, attrs: str) -> _Kind:
    key = (tag, attrs)
    found = _kinds.get(key)
    if found is None:
        if len(_kinds) > 20_000:
            _kinds.clear()
        found = _kinds[key] = _Kind(tag, attrs)
    return found


class Page:
    """Containers (``parent, path, bonus, article, main``) and text blocks (``container, text, linked characters``) of a page, boilerplate left out."""

    def __init__(self, source: str):
        spared = self._read(source, frozenset())
        if spared:
            self._read(source, spared)
        self.unlinked = [0] * len(self.parent)  # characters in the whole subtree
        for k, text, linked in self.blocks:
            self.unlinked[k] += max(0, len(text) - 2 * linked)
        for k in range(len(self.parent) - 1, 0, -1):
            self.unlinked[self.parent[k]] += self.unlinked[k]

    def _read(self, source: str, spared: frozenset[int]) -> frozenset[int]:
        """Parse; gives the places of elements that are left out for their names but should stay."""
        self.parent: list[int] = [-1]
        self.path: list[str] = [""]
        self.bonus: list[float] = [1.0]
        self.article: list[bool] = [False]
        self.main: list[bool] = [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.doubted: list[tuple[int, int, float, list[int]]] = []  # the doubted element around it, place, worth, [unlinked characters]
        self._parse(source, spared)
        if spared or not self.doubted:
            return frozenset()
        kept = sum(max(0, len(text) - 2 * linked) for _, text, linked in self.blocks)
        totals = [own[0] for *_, own in self.doubted]
        for k in range(len(totals) - 1, -1, -1):
            if self.doubted[k][0] >= 0:
                totals[self.doubted[k][0]] += totals[k]
        out: set[int] = set()
        tops = [k for k, found in enumerate(self.doubted) if found[0] < 0]
        for k in sorted(tops, key=lambda k: -self.doubted[k][2] * totals[k]):
            if self.doubted[k][2] * totals[k] <= kept:
                break
            out.add(self.doubted[k][1])
            kept += totals[k]
        for k, (outer, at, _, _) in enumerate(self.doubted):  # of what stays, also the one inside that holds the most of it
            if outer >= 0 and self.doubted[outer][1] in out and totals[k] > totals[outer] / 2:
                out.add(at)
        return frozenset(out)

    def _parse(self, source: str, spared: frozenset[int]) -> None:
        # tag, container, the container and the doubted element around it, whether it starts boilerplate, and by its kind, whether it says that it holds the content
        stack: list[tuple[str, int, int, int, bool, bool, bool]] = []
        open_tags: dict[str, int] = {}
        lists: list[int] = []  # places of ul, ol and li in the stack
        node, bad, hard, articles, contents, doubted = 0, 0, 0, 0, 0, -1
        words: list[str] = []
        linked, in_link, breaks = 0, False, 0
        at = 0

        def close() -> None:
            nonlocal linked, breaks
            if words:
                text = " ".join(html.unescape("".join(words)).split())
                if text:
                    self.blocks.append((node, text, linked))
                words.clear()
            linked = breaks = 0

        def push(tag: str, container: int, is_bad: bool, is_hard: bool, content: bool, outer: int) -> None:
            nonlocal bad, hard, articles, contents
            if tag in LIST_TAGS:
                lists.append(len(stack))
            stack.append((tag, container, outer, doubted, is_bad, is_hard, content))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            bad += is_bad
            hard += is_hard
            articles += container >= 0 and tag == "article"
            contents += content

        def pop(k: int) -> None:
            nonlocal node, bad, hard, articles, contents, doubted
            close()
            for tag, container, _, _, was_bad, was_hard, was_content in stack[k:]:
                open_tags[tag] -= 1
                bad -= was_bad
                hard -= was_hard
                contents -= was_content
                articles -= container >= 0 and tag == "article"
            if k < len(stack):
                node, doubted = stack[k][2], stack[k][3]
            del stack[k:]
            while lists and lists[-1] >= k:
                lists.pop()

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                piece = source[at : m.start()]
                if not bad:
                    words.append(piece)
                    if piece and not piece.isspace():
                        breaks = 0
                    if in_link:
                        linked += len(piece)
                elif not hard and not in_link:
                    self.doubted[doubted][3][0] += len(piece.strip())
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in MATH:
                words.append(" ")
                continue
            if m["end"]:
                if tag == "a":
                    in_link = False
                inline = tag in INLINE
                if not inline and not bad:
                    close()
                if open_tags.get(tag):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            pop(k)
                            break
                continue
            if tag == "br":
                breaks += 1
                words.append(" ")
                if breaks > 1 and not bad:
                    close()
                continue
            attrs = m["attrs"]
            if tag in VOID:
                if tag == "hr" and not bad:
                    close()
                continue
            if tag == "a":
                in_link = True
            kind = _kind(tag, attrs.rstrip("/")) if attrs or tag in CONTAINERS or tag in BOILERPLATE_TAGS else None
            is_hard = kind is not None and kind.bad or tag == "header" and not articles
            worth = 0.0 if kind is None or is_hard or m.start() in spared else kind.doubt or (0.0 if contents else kind.named)
            is_bad = is_hard or worth > 0
            if tag in INLINE:
                if is_bad and not attrs.endswith("/") or open_tags.get(tag):
                    if is_bad and not bad:
                        close()
                    push(tag, -1, is_bad, is_hard, False, node)
                    if worth and not hard:
                        doubted = self._doubt(doubted, m.start(), worth)
                continue
            if stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            elif not bad:
                close()
            if tag == "li" and lists and stack[lists[-1]][0] == "li":
                pop(lists[-1])
            if tag == "body":
                pop(0)
            if tag in CONTAINERS and not is_bad and not bad:
                path = f"{self.path[node]}>{kind.label}"
                self.parent.append(node)
                self.path.append(path if len(path) <= LONGEST_PATH else "#" + blake2b(path.encode(), digest_size=16).hexdigest())
                self.bonus.append(kind.bonus)
                self.article.append(tag == "article")
                self.main.append(kind.main)
                push(tag, len(self.parent) - 1, False, False, kind.content, node)
                node = len(self.parent) - 1
            elif is_bad or tag in CONTAINERS or bad:
                push(tag, -1, is_bad, is_hard, False, node)
                if worth and not hard:
                    doubted = self._doubt(doubted, m.start(), worth)
        if not bad and at < len(source):
            words.append(source[at:])
        close()

    def _doubt(self, outer: int, at: int, worth: float) -> int:
        self.doubted.append((outer, at, worth, [0]))
        return len(self.doubted) - 1

    def scores(self) -> list[float]:
        own = [0.0] * len(self.parent)
        for node, text, linked in self.blocks:
            own[node] += max(0, len(text) - 2 * linked)
        out = [x * b for x, b in zip(own, self.bonus, strict=True)]
        for k in range(len(own) - 1, 0, -1):
            out[self.parent[k]] += 0.5 * own[k] * self.bonus[self.parent[k]]
        return out

    def best(self) -> int:
        """The outermost article around the container with the highest score, else the main element around it, else the innermost container with all unlinked text."""
        points = self.scores()
        k = top = max(range(len(points)), key=points.__getitem__)
        article = main = -1
        while k >= 0:
            if self.article[k]:
                article = k
            if self.main[k]:
                main = k
            if self.unlinked[k] > self.unlinked[top]:
                top = k
            k = self.parent[k]
        return article if article >= 0 else main if main >= 0 else top

    def alike(self, path: str) -> list[int]:
        """The containers with a path that hold more than links."""
        return [k for k, other in enumerate(self.path) if other == path and self.unlinked[k]]

    def weight(self, tops: list[int]) -> int:
        return sum(max(0, len(text) - linked) for _, text, linked in self._below(tops))

    def _below(self, tops: list[int]) -> Iterator[tuple[int, str, int]]:
        inside = [False] * len(self.parent)
        for k in tops:
            inside[k] = True
        for k in range(1, len(inside)):
            inside[k] |= inside[self.parent[k]]
        return (b for b in self.blocks if inside[b[0]])

    def text(self, tops: list[int]) -> str:
        return "\n".join(text for _, text, _ in self._below(tops))


def vote(source: str) -> str | None:
    """The path of a page's best container; None if the page has no text."""
    page = Page(source)
    return page.path[page.best()] if page.blocks else None


def extract(source: str, winner: str | None) -> str:
    """The main text: below the containers with the winning path, or below the page's own best one and those alike."""
    page = Page(source)
    if not page.blocks:
        return ""
    best = page.best()
    own = page.alike(page.path[best]) or [best]
    if winner and page.path[best] != winner:
        there = page.alike(winner)
        if there and page.weight(there) >= NEARLY_ALL * page.weight(own):
            own = there
    return page.text(own)


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``id, url, text, n_chars`` for every row.

    Defined cases: null and empty pages, and pages without text, give an empty
    text; pages with a null or broken url vote together as one host without a
    name; ties between paths go to the one first in order; repeated rows vote
    each; an empty table gives no rows; other columns are ignored.
    """
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    pages = pages.withColumn("_h", F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch, "html"):
                paths = [vote(h or "") for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_h"), pa.array(paths, pa.string())], ["host", "path"])

    counted = arrow_map(pages.select("_h", "html"), "host string, path string", votes).where("path is not null").groupBy("host", "path").count()
    first = F.row_number().over(W.partitionBy("host").orderBy(F.desc("count"), "path"))
    winners = cut(counted.withColumn("place", first).where("place = 1").select(F.col("host").alias("_host"), "path"))
    small = winners.count() <= broadcast_hosts

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch, "html"):
                out = [extract(h or "", p) for h, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["id", "url", "text", "n_chars"])

    joined = pages.join(F.broadcast(winners) if small else winners, F.col("_h") == F.col("_host"), "left").select("id", "url", "html", "path")
    return arrow_map(joined, f"id {df.schema[id_col].dataType.simpleString()}, url string, text string, n_chars bigint", texts)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_pages(pages).withColumnRenamed("id", "page_id")
