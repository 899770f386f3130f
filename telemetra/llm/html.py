"""Main text of web pages by consensus paths.

Every page's containers are scored by the text they hold outside boilerplate and links, each under its generalised
path (tags with classes, digits taken out). Pages vote: scores, as shares of their page, are summed per host and path,
and of the paths that are some page's best, the PATHS with the most votes win. A page is read anew with the first winning
path of its host that holds a FAIR share of what the page's own best container is worth, or else with that container;
so hosts with several templates work, and a small container of the same path doesn't replace an article.

Elements whose class or id names boilerplate (an advert, a menu, comments ...) are set aside, unless almost nothing
else is left of the page. A name counts as a whole, with usual prefixes and suffixes (`post-comments`, `share-buttons`),
so `share-price`, `has-sidebar` and `no-comments` don't.

Defined results: null and empty html and pages without text give an empty text; broken markup is read as far as
it goes; whole pages are read; containers more than DEPTH levels deep count as their ancestor at that level; ties go to
the smaller path; null urls form one host; repeated rows get equal texts; an empty table is empty; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, written

# Elements and class words by HTML's own meaning and by custom.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea".split())
BOILERPLATE = frozenset("nav header footer aside form button select dialog menu head title".split()) | RAW
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
ROLES = frozenset("navigation banner contentinfo complementary".split())
_WORDS = r"ads?|advert\w*|banners?|breadcrumbs?|comments?|cookies?|consent|disqus|footer|form|header|login|menu|masthead|modal|nav|navbar|navigation|newsletter|notices?|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widgets?"
_BEFORE = r"(?:article|blog|bottom|entry|global|js|left|main|page|post|primary|right|secondary|site|the|top|user|reader)"
_AFTER = r"(?:area|banner|bar|block|box|buttons?|container|content|form|icons?|inner|items?|links?|list|menu|nav|notice|overlay|popup|posts?|section|slot|thread|unit|wrap|wrapper|widget|articles)"
HINT = re.compile(rf"(?:{_BEFORE}[-_]+)*(?:{_WORDS})(?:[-_]+{_AFTER})*[-_]*", re.I)

#: Paths that win at a host, the share of a page's best that a winning path must hold, and levels that paths tell apart.
PATHS, FAIR, DEPTH = 3, 0.3, 48
#: Up to this number of hosts their paths are broadcast (some 300 bytes each); more are joined by shuffle, in SALTS parts a host.
BROADCAST_HOSTS, SALTS = 50_000, 32

# As HTML reads it, `<` before anything but a letter, `/`, `!` or `?` is text, and `</` before no letter begins a comment.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][\w:-]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|</[^>]*>|([^<]+)|(<)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")

Block = tuple[tuple[str, ...], str, int]


def _hinted(names: dict[str, str]) -> bool:
    """Whether a class or the id names boilerplate."""
    return any(HINT.fullmatch(_DIGITS.sub("", x)) for k in ("class", "id") for x in names.get(k, "").split())


def blocks(html: str | None) -> list[Block]:
    """(paths of the containers around, text, characters in links) of each block outside boilerplate, in page order."""
    out: list[tuple[tuple[str, ...], str, int, bool]] = []
    # tag, its path among blocks, paths of the containers around, inside boilerplate (1: by its names only, 2: by its element)
    stack: list[tuple[str, str, tuple[str, ...], int]] = []
    within: Counter[str] = Counter()
    text: list[str] = []
    linked = links = 0
    html = html or ""
    last = html.rfind(">")

    def close() -> None:
        nonlocal text, linked
        if text:
            said = _SPACE.sub(" ", unescape("".join(text))).strip()
            if said:
                out.append((stack[-1][2] if stack else (), said, linked, bool(stack and stack[-1][3])))
            text, linked = [], 0

    def leave(k: int) -> None:
        nonlocal links
        for t, *_ in stack[k:]:
            within[t] -= 1
            links -= t == "a"
        del stack[k:]

    at = 0
    while at < len(html):
        if at > last:  # no tag is complete from here on
            m, said = None, html[at:]
        else:
            m = _TOKEN.match(html, at)
            said = m[0] if m[4] or m[5] else None
        at = m.end() if m else len(html)
        if said is not None:
            if not (stack and stack[-1][3] == 2):
                text.append(said)
                linked += len(said) if links else 0
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if within[tag]:
                if tag in BLOCKS:
                    close()
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                leave(k)
            continue
        if tag == "br":
            text.append(" ")
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in BLOCKS:
            close()
            while tag in CLOSES_P and within["p"]:
                k = len(stack) - 1
                while stack[k][0] != "p" and stack[k][0] not in CONTAINERS:
                    k -= 1
                if stack[k][0] != "p":
                    break
                leave(k)
            if tag in ("li", "dt", "dd") and stack and stack[-1][0] in ("li", "dt", "dd"):
                leave(len(stack) - 1)
        names: dict[str, str] = {}
        for name, a, b, c in _ATTRIBUTE.findall(m[3]) if m[3] else ():
            names.setdefault(name.lower(), a or b or c)
        cls = names.get("class", "")
        above = stack[-1] if stack else ("", "", (), 0)
        off = above[3]
        if tag in BOILERPLATE or names.get("role") in ROLES:
            off = 2
        elif not off and tag not in ("body", "html", "article", "main") and names and _hinted(names):
            off = 1
        path, around = above[1], above[2]
        if tag in BLOCKS and path.count(">") < DEPTH:
            path += ">" + tag + "".join(f".{c}" for c in sorted(_DIGITS.sub("", cls).split()))
            if tag in CONTAINERS:
                around = (*around, path)
        if not m[3].endswith("/") or tag in BLOCKS:
            stack.append((tag, path, around, off))
            within[tag] += 1
            links += tag == "a"
    close()
    kept = [(p, t, n) for p, t, n, off in out if not off]
    aside = [(p, t, n) for p, t, n, off in out if off]
    return [(p, t, n) for p, t, n, _ in out] if sum(len(t) - n for _, t, n in kept) * 10 < sum(len(t) - n for _, t, n in aside) else kept


def worth(found: list[Block]) -> dict[str, float]:
    """What each container path of a page is worth; a deeper container with nearly as much text is worth more."""
    out: dict[str, float] = defaultdict(float)
    for paths, text, linked in found:
        value = max(0.0, len(text) - 2.0 * linked) * (1.5 if len(text) > 80 else 1.0)
        for path in paths:
            bonus = 1.3 if path.rpartition(">")[2].split(".")[0] in ("article", "main") else 1.0
            out[path] += value * bonus * (1 + 0.05 * path.count(">"))
    return {p: v for p, v in out.items() if v}


def _best(own: dict[str, float]) -> str | None:
    return min(own, key=lambda p: (-own[p], p)) if own else None


def chosen(found: list[Block], winners: list[str] | None) -> str:
    """Text of the blocks within the first of `winners` that is worth enough here, or within the page's own best container."""
    own = worth(found)
    best = _best(own)
    path = next((p for p in winners or () if own.get(p, 0.0) >= FAIR * own[best]), best) if own else None
    return "\n".join(text for paths, text, _ in found if path is None or path in paths)


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the paths that a host's pages agree on, most votes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            votes: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0])
            for host, html in zip(part["host"].to_pylist(), part["html"].to_pylist()):
                own = worth(blocks(html))
                total, best = sum(own.values()), _best(own)
                for path, value in own.items():
                    vote = votes[host, path]
                    vote[0] += value / total
                    vote[1] += path == best
            yield pa.RecordBatch.from_pylist([{"host": h, "path": p, "share": v, "best": b} for (h, p), (v, b) in votes.items()], pa.schema([("host", pa.string()), ("path", pa.string()), ("share", pa.float64()), ("best", pa.int64())]))

    votes = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, share double, best long")
    sums = votes.groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("share"), F.sum("best").alias("best")).where("best > 0")
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("share"), "path"))
    top = sums.withColumn("place", place).where(F.col("place") <= PATHS)
    return top.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "path"))).alias("top")).select("host", F.col("top.path").alias("paths"))


def extracted(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) with text: one row per row."""
    won = written(host_paths(pages), "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            texts = [chosen(blocks(h), p) for h, p in zip(part["html"].to_pylist(), part["paths"].to_pylist())]
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host(F.col("url")).alias("host"))
    if won.count() <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(won), "host", "left")
    else:
        salted = won.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "paths").mapInArrow(run, "page_id long, url string, text string")


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extracted(pages).withColumn("n_chars", F.length("text").cast("long"))
