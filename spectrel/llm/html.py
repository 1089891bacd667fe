"""Main text of web pages by consensus of hosts.

What is named as something around the article (menus, side bars, adverts, reader comments) goes first. A page's container
is then the smallest that holds all of the article as far as the page shows it: its main or article elements, or else all
blocks of running text. Its generalised tag-class path is the page's vote. Spark counts votes by host and path, and every
page is extracted again from all its containers of the host's winning path, or from its own where those hold less than
``LEAST`` of the running text that its own does. A headline before them belongs to the text.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, stored

# HTML element names and the words by which pages name what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside form script style noscript template iframe button select textarea svg math object head title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
CONTAINERS = frozenset("html body main article section div td blockquote center".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th pre address figure figcaption fieldset details summary hr hgroup".split()) | CONTAINERS | DROPPED
#: An opening tag ends an open element of these, if no element of the second set is between.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
AROUND = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottom sidebar aside complementary contentinfo widget widgets ad ads advert adverts advertisement adsense "
    "banner promo promotion promoted sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription share sharing "
    "social related recommended recommendations login signup search pagination pager toolbar skip".split()
)
COMMENTS = frozenset("comment comments commentlist commenting disqus respond reply replies".split())
#: Words that say nothing of their own in a name: site-footer is a footer, comments-area are comments; but comments-open, no-sidebar and social-science are none.
STRUCTURE = frozenset("area areas section sections list wrap wrapper container box block inner outer left right top upper lower site page global my our user users reader readers item items thread threads form module region unit slot col column row group mobile desktop sticky first last".split())
#: Names of comments may also say what is commented on, or what of a comment it is.
OF_COMMENTS = STRUCTURE | frozenset("post article entry body text content author meta title".split())

_TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|/?[a-zA-Z][^>]*+(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[^a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: A block of so many characters outside links is running text.
RUNNING = 80
#: The host's path decides where it holds at least so much of the running text of the page's own container.
LEAST = 0.5


def names_what(value: str) -> str | None:
    """Whether a class, id or role names "comments", something else "around" the article, or neither."""
    found = None
    for name in value.split():
        parts = set(_PARTS.split(_HUMP.sub("-", name).lower())) - {""}
        if parts & COMMENTS and parts <= COMMENTS | OF_COMMENTS:
            return "comments"
        if parts & AROUND and parts <= AROUND | STRUCTURE:
            found = "around"
    return found


class Page:
    """Blocks of text outside menus and the like, each with its innermost container; and the containers' paths."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters outside links
        self.paths: list[str] = [""]
        self.parents: list[int] = [-1]
        self._headlines: list[bool] = []  # for each block whether it is a first-level heading
        self._named: list[int] = []  # for each block the innermost subtree named like something around the article, or -1
        self._around: list[list] = []  # of such subtrees: the one above, whether it is of comments, whether it holds main, or article
        if html:
            self._read(html)
            self._decide()

    def _read(self, html: str) -> None:
        # name, container, dropped, subtree in _around, whether only headings count
        stack: list[tuple[str, int, bool, int, bool]] = [("", 0, False, -1, False)]
        text: list[str] = []
        linked = 0
        links = 0

        def flush() -> None:
            nonlocal linked
            if text:
                joined = " ".join("".join(text).split())
                name, container, _, around, only = stack[-1]
                if joined and (not only or name in HEADINGS):
                    self.blocks.append((container, joined, max(0, len(joined) - linked)))
                    self._headlines.append(name == "h1")
                    self._named.append(around)
                text.clear()
            linked = 0

        at, end = 0, len(html)
        while at < end:
            m = _TAG.search(html, at)
            stop = m.start() if m else end
            if stop > at and not stack[-1][2]:
                piece = unescape(html[at:stop])
                text.append(piece)
                if links:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                if name in BLOCKS:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == name:
                            flush()
                            links = 0
                            del stack[i:]
                            break
                elif name == "a":
                    links = max(0, links - 1)
                elif name == "br":
                    text.append(" ")
                continue
            if name == "br":
                if not stack[-1][2]:
                    text.append(" ")
                continue
            if name not in BLOCKS:
                if name == "a":
                    links += 1
                continue
            flush()
            links = 0
            if name in VOID:
                continue
            self._close(stack, name)
            _, container, dropped, around, only = stack[-1]
            attributes = m.group(3)
            classes, kind = "", None
            if "=" in attributes:
                for attribute, a, b, c in _NAMES.findall(attributes):
                    value = unescape(a or b or c)
                    if attribute.lower() == "class":
                        classes = ".".join(sorted({_DIGITS.sub("#", x) for x in value.lower().split()}))
                    named = names_what(value)
                    kind = named if named == "comments" or not kind else kind
            if name == "header" and not dropped and _in_article(self.paths[container]):
                only = True  # of an article's own header the headings are a part of it
            else:
                dropped = dropped or name in DROPPED
            if not dropped and kind and name not in ("html", "body"):
                self._around.append([around, kind == "comments", False, False])
                around = len(self._around) - 1
            if not dropped and name in ("main", "article"):
                i = around
                while i >= 0:
                    self._around[i][2 if name == "main" else 3] = True
                    i = self._around[i][0]
            if name in CONTAINERS and not dropped:
                self.parents.append(container)
                self.paths.append(f"{self.paths[container]}>{name}" + (f".{classes}" if classes else ""))
                container = len(self.paths) - 1
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else end
                continue
            if attributes.endswith("/") and name in ("svg", "math"):
                continue
            stack.append((name, container, dropped, around, only))
        flush()

    def _decide(self) -> None:
        """Drops comments, and subtrees named like something else around the article, unless they hold the article itself.

        The latter do if they hold main; or article, where no article or main outside of them has text; and all do if no text
        is left otherwise. Comments never do.
        """
        if not self._around:
            return
        outside = any(i < 0 and _in_article(self.paths[container]) for (container, _, _), i in zip(self.blocks, self._named))
        shown: list[bool] = []
        talk: list[bool] = []
        for above, comments, main, article in self._around:
            shown.append(not comments and (main or (article and not outside)) and (above < 0 or shown[above]))
            talk.append(comments or (above >= 0 and talk[above]))
        keep = [i < 0 or shown[i] for i in self._named]
        if not any(keep):
            keep = [not talk[i] for i in self._named]
        self.blocks = [b for b, k in zip(self.blocks, keep) if k]
        self._headlines = [h for h, k in zip(self._headlines, keep) if k]

    @staticmethod
    def _close(stack: list, name: str) -> None:
        """What an opening tag ends: a paragraph before any block, and list items or cells of its own kind."""
        ends, walls = ENDS.get(name, (frozenset(), frozenset()))
        for i in range(len(stack) - 1, 0, -1):
            open_ = stack[i][0]
            if open_ == "p" or open_ in ends:
                del stack[i:]
                if open_ in ends:
                    return
            elif open_ in walls or open_ in CONTAINERS or (not ends and open_ in BLOCKS):
                return

    def _joint(self, containers: set[int]) -> int:
        """The innermost container that holds all of these."""
        lines = []
        for i in containers:
            line = [i]
            while self.parents[line[-1]] >= 0:
                line.append(self.parents[line[-1]])
            lines.append(line[::-1])
        same = 0
        for level in zip(*lines):
            if len(set(level)) > 1:
                break
            same = level[0]
        return same

    def best(self) -> int:
        """The smallest container of all main elements with text, else of all article elements, else of all running text, else of all text outside links."""
        for name in ("main", "article"):
            found = set()
            for container, _, _ in self.blocks:
                outermost = None
                while container > 0:
                    if _element(self.paths[container]) == name:
                        outermost = container
                    container = self.parents[container]
                if outermost:
                    found.add(outermost)
            if found:
                return self._joint(found)
        for least in (RUNNING, 1, 0):
            found = {container for container, _, size in self.blocks if size >= least}
            if found:
                return self._joint(found)
        return 0

    def _inside(self, chosen: set[int]) -> list[bool]:
        """For each block whether it is in the chosen containers or below."""
        inside = [i in chosen for i in range(len(self.paths))]
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.parents[i]]
        return [inside[container] for container, _, _ in self.blocks]

    def running(self, chosen: set[int]) -> int:
        """Characters outside links in the chosen containers."""
        return sum(size for (_, _, size), i in zip(self.blocks, self._inside(chosen)) if i)

    def text(self, chosen: set[int]) -> str:
        """Blocks in the chosen containers or below, in page order; and the headlines right before them, if they have none."""
        inside = self._inside(chosen)
        if True in inside and not any(h and i for h, i in zip(self._headlines, inside)):
            first = inside.index(True)
            inside = [i or (h and n < first) for n, (i, h) in enumerate(zip(inside, self._headlines))]
        return "\n\n".join(text for (_, text, _), i in zip(self.blocks, inside) if i)


def _element(path: str) -> str:
    """The element's name of the last step of a path."""
    return path.rpartition(">")[2].partition(".")[0]


def _in_article(path: str) -> bool:
    return any(step.partition(".")[0] in ("article", "main") for step in path.split(">"))


def extract(html: str | None, path: str | None) -> str:
    page = Page(html)
    own = {page.best()}
    shared = {i for i, p in enumerate(page.paths) if p == path} if path else set()
    if shared and page.running(shared) >= LEAST * page.running(own):
        own = shared
    return page.text(own)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page (page_id, url, html); other columns are ignored.

    Null or empty html gives an empty text, and so does a page of reader comments alone. Pages of any length are read whole,
    one after another. Pages without a host in their url vote together. Of equally frequent paths
    the one first in the alphabet wins. Repeated rows are extracted each.
    """
    host = F.lower(F.coalesce(F.regexp_extract(pages["url"], r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    source = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"), host.alias("host"))

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        votes: list[str] = []
        for html in batch.column("html").to_pylist():
            page = Page(html)
            votes.append(page.paths[page.best()] if page.blocks else "")
        return pa.RecordBatch.from_arrays([batch.column("host"), pa.array(votes, pa.string())], ["host", "path"])

    votes = map_slices(source.select("host", "html"), vote, "host string, path string", "html").where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    winners = stored(votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), "path")).alias("path")), "paths")

    def again(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    # the planner sends the winners to all tasks where they are few, by their size on disk; else both sides are shuffled
    return map_slices(source.join(winners, "host", "left").select("page_id", "url", "html", "path"), again, "page_id long, url string, text string, n_chars long", "html")
