"""Main text of web pages, by the container paths that the pages of a host agree on.

Each page's containers are scored by the text that they hold, against that of links and bare fragments. A
container's path is the row of tags with their classes from the page's root, digits left out, so that
pages from one template have the same. Pages vote for their paths in Spark; each is then extracted by
its host's first winner where it has that, else by the next that holds enough of its own best score, else by its own best path.

Pages are read twice, so that between the two steps only votes are dealt, never the pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import batched, saved
from .urls import host_and_path

#: Winners kept of a host; a page that has none of them goes by its own best path.
WINNERS = 8
#: A winner beside the first has this share of the page's best score at least.
SHARE = 0.5
#: Containers that lie deeper than this count as part of the one above.
DEEPEST = 64
#: Winners go to all tasks while they have this many characters in total at most; else pages join them by host.
MOST_SENT = 8 << 20
#: Parts that a host's pages are dealt to where winners are joined by host.
SALTS = 64

# Elements of HTML, by what they do to text.
_RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
_DROPPED = frozenset("head script style template noscript textarea title xmp iframe noembed noframes nav aside footer form select button svg math canvas audio video object datalist dialog menu".split())
_CONTAINER = frozenset("html body main article section div td center fieldset details blockquote".split())
_BLOCK = _CONTAINER | _DROPPED | frozenset("address caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr legend li ol optgroup option p pre search summary table tbody tfoot th thead tr ul".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_INNER = _BLOCK - {"html", "body"}
_TABLE = frozenset("td th tr tbody thead tfoot caption option optgroup".split())
#: An end tag doesn't reach beyond these; those of tables and their rows do.
_CELL = ("td", "th", "table", "button", "object")
_UNTIL = {"table": (), "tr": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "td": ("table",), "th": ("table",), "button": (), "object": ()}
#: An opening tag ends an open element of these, up to the nearest of the second.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
# Words of class, id and role attributes.
_ASIDE = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar aside complementary contentinfo ad ads advert adverts advertisement advertising adsbygoogle banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations teaser teasers widget widgets toolbar pagination pager".split())
_READERS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
_MAIN = frozenset("article articlebody content post entry story main text body".split())

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in _RAW}


class Node:
    """An element, the path of its container, and the characters in it that count for and against that."""

    __slots__ = ("bad", "dropped", "good", "parent", "path", "tag", "weight")

    def __init__(self, tag: str, parent: Node | None, step: str = "", weight: float = 1.0, dropped: bool = False):
        self.tag, self.parent, self.dropped, self.weight = tag, parent, dropped, weight
        self.path = "" if parent is None else f"{parent.path}>{step}" if step and parent.path.count(">") < DEEPEST else parent.path
        self.good = self.bad = 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip("/ \t\r\n\f") else {}


@lru_cache(4096)
def _opened(tag: str, attributes: str) -> tuple[str, float, bool, bool]:
    """Step of the path ('' where it is no container), weight, whether it stands beside the main text, and whether only outside of articles."""
    a = _attributes(attributes)
    names = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')} {a.get('itemprop', '')}"
    words = frozenset(w.lower() for w in _WORDS.findall(names)) | frozenset(re.sub(r"[^a-z]", "", w) for w in names.lower().split())
    step = ""
    if tag in _CONTAINER:
        step = tag + "".join(f".{c}" for c in sorted({re.sub(r"\d+", "#", c) for c in a.get("class", "").split()}))
        step += "#" + re.sub(r"\d+", "#", a["id"].strip()) if a.get("id") else ""
    weight = 1.5 if tag in ("article", "main") or "articlebody" in words else 1.2 if words & _MAIN else 1.0
    unseen = "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", "")))
    beside = bool(words & _READERS) or bool(tag not in ("main", "article") and words & _ASIDE and not words & {"has", "with", "no"})
    return step, weight, tag in _DROPPED or unseen or beside, tag == "header"


def blocks(page: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """The page's blocks as (element, text, its linked characters) in order, and its elements.

    Tags that end what they should not, missing end tags and tags that are cut off at the page's end are
    met as browsers do for the elements that matter to text; text that never enters a block belongs to the body.
    """
    root = Node("html", None)
    now, out, nodes, opened = root, [], [root], Counter()
    text, link, linked = [], None, 0

    def end_block():
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append((now, whole, min(linked, len(whole))))
            text.clear()
        linked = 0

    def close(tags, until):
        """Ends the nearest open element of these tags, with all that is open in it; nothing, where `until` or the page comes first."""
        nonlocal now, link
        if not any(opened[t] for t in tags):
            return
        at = now
        while at.tag not in tags:
            if at.tag in until:
                return
            at = at.parent
        end_block()
        while now is not at.parent:
            opened[now.tag] -= 1
            # A link that isn't ended goes no further than the element that it began in.
            link = None if link is now else link
            now = now.parent

    def add(s: str):
        nonlocal linked
        if s and not now.dropped:
            s = html.unescape(s) if "&" in s else s
            text.append(s)
            if link:
                linked += len(" ".join(s.split()))

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = None
            elif tag in _INNER:
                close(_HEADING if tag in _HEADING else (tag,), _UNTIL.get(tag, _CELL))
            continue
        if tag == "a":
            link = now
        elif tag == "br":
            text.append(" ")
        if tag in _RAW_END:
            # What stands in these is no markup, up to their own end tag or the page's.
            end = _RAW_END[tag].search(page, at)
            at = end.start() if end else len(page)
        if tag not in _INNER:
            continue
        if tag in _ENDS:
            close(*_ENDS[tag])
        if tag not in _TABLE:
            close(("p",), _CELL)
        end_block()
        if tag == "hr":
            continue
        step, weight, beside, outside = _opened(tag, m[3])
        if outside and not beside:
            beside = not (">article" in now.path or ">main" in now.path)
        now = Node(tag, now, step, weight, now.dropped or beside)
        nodes.append(now)
        opened[tag] += 1
    end_block()
    return out, nodes


def judged(page: str) -> tuple[list[tuple[Node, str, bool]], dict[str, float]]:
    """The page's blocks with whether they are a menu's, and the score of each container path.

    A list of three or more blocks, four fifths of whose characters are links, is a menu. A container has the characters of
    headings, paragraphs and what else has 40 characters or the end of a sentence, less twice those of links and fragments.
    """
    found, nodes = blocks(page)
    # Lists first: a block belongs to the outermost list that it is in.
    lists: dict[Node, Node] = {}
    for n in nodes:
        if n.parent is not None:
            lists[n] = lists.get(n.parent) or (n if n.tag in ("ul", "ol", "dl") else None)
    size: dict[Node, list[int]] = {}
    for n, s, linked in found:
        if (own := lists.get(n)) is not None:
            x = size.setdefault(own, [0, 0, 0])
            x[0], x[1], x[2] = x[0] + 1, x[1] + len(s), x[2] + linked
    menus = {n for n, (count, letters, linked) in size.items() if count >= 3 and 5 * linked >= 4 * letters}
    out = []
    for n, s, linked in found:
        menu = lists.get(n) in menus
        out.append((n, s, menu))
        plain = len(s) - linked
        good = not menu and 2 * linked <= len(s) and (n.tag in _HEADING or n.tag == "p" or len(s) >= 40 or s[-1] in ".!?…。")
        n.good += plain if good else 0
        n.bad += linked if good else len(s)
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.good += n.good
            n.parent.bad += n.bad
    score: dict[str, float] = {}
    for n in nodes:
        if not n.dropped and (n.parent is None or n.path != n.parent.path):
            score[n.path] = score.get(n.path, 0.0) + max(0.0, (n.good - 2 * n.bad) * n.weight)
    return out, score


def _best(score: dict[str, float]) -> str:
    """The path of the best score; of equally good ones the deepest, then the first in the text's order."""
    return min(score, key=lambda p: (-score[p], -p.count(">"), p))


def main_text(page: str | None, winners: list[str] | None = None) -> str:
    """The page's main text, a line for each block, by the first of its host's winners that fits it, or by its own best path."""
    found, score = judged(page or "")
    path = _best(score)
    most = score[path]
    for k, w in enumerate(winners or ()):
        # What the host agrees on most needs no more than to be there.
        if w in score and (score[w] >= SHARE * most if k else score[w] > 0 or not most):
            path = w
            break
    else:
        path = path if most > 0 else ""
    return "\n".join(s for n, s, menu in found if not menu and (n.path == path or n.path.startswith(path + ">")))


def _votes(batches) -> Iterator[pa.RecordBatch]:
    """A task's votes, added up by host and path while they are few."""
    kind = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64())])
    votes: Counter[tuple[str, str]] = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes]), pa.array([k[1] for k in votes]), pa.array(list(votes.values()))], schema=kind)

    for b in batches:
        for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            _, score = judged(page)
            path = _best(score)
            if score[path] > 0:
                votes[host, path] += 1
        if len(votes) > 50_000:
            yield out()
            votes.clear()
    if votes:
        yield out()


def winners(pages: DataFrame) -> DataFrame:
    """host, winners: the paths with most votes, best first; of equally good ones the deepest, then the first in the text's order.

    pages: host, html. Each page that has a text votes for its own best path.
    """
    votes = batched(pages.filter("host <> '' AND html IS NOT NULL")).select("host", "html").mapInArrow(_votes, "host string, path string, votes long")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    # Of a host with any number of paths, tasks deal out no more than the winners each.
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc(F.regexp_count("path", F.lit(">"))), "path")
    ranked = votes.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= WINNERS)
    return ranked.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("k", "path"))).alias("w")).select("host", F.col("w.path").alias("winners"))


def _texts(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(p, w) for p, w in zip(b.column("html").to_pylist(), b.column("winners").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page: its blocks in page order, joined by one line feed.

    White space inside a block becomes one space, character references are decoded. Null or empty html, or a page
    without text, gives an empty text. A page without host goes by its own best path. Repeated pages
    vote each time; no rows give no rows; other columns are ignored.
    """
    p = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    host, _ = host_and_path(F.col("url").cast("string"))
    p = p.select("page_id", "url", "html", host.alias("host"))
    won = saved(winners(p), "winners")
    letters = won.agg(F.sum(F.length("host") + F.length(F.array_join("winners", " ")) + 16)).first()[0] or 0
    if letters <= MOST_SENT:
        joined = p.join(F.broadcast(won), "host", "left")
    else:
        # The pages of a host go round its parts, so that a host of any size is dealt evenly.
        salt = F.monotonically_increasing_id() % SALTS
        spread = won.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = p.withColumn("salt", salt).join(spread, ["host", "salt"], "left")
    out = batched(joined).select("page_id", "url", "html", "winners").mapInArrow(_texts, T.StructType([p.schema["page_id"], p.schema["url"], T.StructField("text", T.StringType())]))
    return out.withColumn("n_chars", F.length("text").cast("long"))
