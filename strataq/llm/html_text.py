"""HTML extraction by line-block distribution."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, texts_of

# Elements by role.
RAW = "script|style|noscript|template|svg|iframe|textarea|select|canvas|audio|video|title|xmp"
BOILER = frozenset("nav header footer aside form menu dialog button fieldset datalist map".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr nobr img input object math mrow mi mn mo mtext msup msub mfrac msqrt".split())
CONTAINERS = frozenset("html body div section article main table td th center blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A name marks boilerplate if its last word does, or one that only words for parts of a page follow: cookie-notice and
# notice-box are notices, notice-board isn't.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adsbygoogle|advert|advertis\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notices|alert|alerts|"
    r"popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|widget|footer|site-?header|masthead|"
    r"comments?|commentlist|respond|disqus|replies|reply|related|recommend\w*|share|sharing|social|newsletter|subscribe|"
    r"pagination|pager|toolbar|skip-?link|login|signup|search-?form)"
    r"(?:[_-](?:area|articles?|author|bar|block|body|bottom|box|btns?|buttons?|card|col|column|container|content|count|date|entry|feed|fixed|footer|form|"
    r"group|header|holder|icons?|inline|inner|items?|left|links?|list|main|menu|meta|module|nav|outer|panel|posts?|primary|region|right|row|secondary|"
    r"section|slot|sticky|stories|story|strip|text|thread|title|top|unit|widget|wrap|wrapper|\w*\d\w*))*(?=$|\s)", re.I)
ROLES = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|form|menu|alert|dialog)\b", re.I)
NAMES = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# A wrapper that says what the page has around it is not that thing.
STATES = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|show|hide)[-_]\S+", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|$)"
    r"""|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^<>]*>""",
    re.S | re.I)


def is_boiler(tag: str, attrs: str) -> bool:
    if tag in BOILER:
        return True
    if tag in ("html", "body", "main", "article") or not attrs:
        return False
    if ROLES.search(attrs) or HIDDEN.search(attrs):
        return True
    return tag not in INLINE and any(MARKS.search(STATES.sub(" ", a or b or c)) for a, b, c in NAMES.findall(attrs))


def lines_of(page: str, gap: int) -> list[tuple[str, bool, int, int, int]]:
    """The page without markup as (text, inside article or main, characters in links, depth, least depth since the line
    before), one block a line; depth counts open containers.

    What boilerplate elements hold is left out, and `gap` blank lines stand in its place and where an outermost
    article or main element begins and ends.
    """
    lines: list[tuple[str, bool, int, int, int]] = []
    parts: list[str] = []
    article = links = linked = 0
    skip, depth, at, level, least = "", 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked, least
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append((text, article > 0, linked, level, least))
            least = level
        parts.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if not skip and text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    last: dict[str, int] = {}  # where an element of this name is closed for the last time
    for m in TOKEN.finditer(page):
        put(page[at:m.start()])
        at = m.end()
        if m["raw"]:
            if m["raw"].lower() == "textarea" and not skip:
                flush()
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        end = bool(m["end"])
        if skip:
            if tag == skip:
                depth += -1 if end else (0 if (m["attrs"] or "").rstrip().endswith("/") else 1)
                if depth <= 0:
                    skip = ""
            continue
        if not end and tag not in VOID and is_boiler(tag, m["attrs"] or ""):
            flush()
            lines.extend([("", False, 0, level, level)] * gap)
            if tag not in last:
                last[tag] = max((x.start() for x in re.finditer(rf"</{re.escape(tag)}(?![\w:-])", page, re.I)), default=-1)
            if last[tag] >= at and not (m["attrs"] or "").rstrip().endswith("/"):
                skip, depth = tag, 1
            continue
        if tag == "a":
            links = 0 if end else 1
        if tag == "br":
            put(" ")
        elif tag not in INLINE:
            flush()
            if tag in CONTAINERS:
                level += -1 if end else 1
                least = min(least, level)
            if tag in ("article", "main"):
                if article == end:  # the outermost begins or ends
                    lines.extend([("", False, 0, level, level)] * gap)
                article = max(0, article + (-1 if end else 1))
    put(page[at:])
    flush()
    return lines


def extract_main(page: str | None, window: int = 3, surge: int = 80, gap: int = 3, links: float = 0.6,
                 weight: int = 4) -> str:
    """Main text of one page.

    Line blocks are windows of `window` lines; their text lengths are summed. A run of lines begins where the sum rises
    from zero and ends where it dives to zero again; boilerplate elements leave `gap` blank lines, so that it does. Runs
    whose highest sum reaches `surge` are kept, or else the run with the most text; and runs beside a kept one that its
    container holds too, as where a box stands between paragraphs. Characters inside an article or main element count
    `weight` times, and blank lines stand around it, so that runs inside and outside are judged on their own. Lines
    outside that are mostly links (more than `links` of their characters, or half of the rest too in a line that reaches
    `surge` by itself) count nothing.
    """
    if not page:
        return ""
    lines = lines_of(page, max(gap, window))
    share = lambda n: links if n < surge else (1 + links) / 2
    texts = ["" if x[0] and not x[1] and x[2] > share(len(x[0])) * len(x[0]) else x[0] for x in lines]
    sizes = [len(t) * (weight if x[1] else 1) for t, x in zip(texts, lines)]
    n = len(sizes)
    total, sums = 0, []
    for i in range(n + window - 1):
        total += (sizes[i] if i < n else 0) - (sizes[i - window] if i >= window else 0)
        sums.append(total)  # of the window that ends at line i
    runs, start = [], None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i
        elif not s and start is not None:
            runs.append((max(sums[start:i]), sum(sizes[start:i]), start, min(i, n)))
            start = None
    strong = {i for i, r in enumerate(runs) if r[0] >= surge} or set(sorted(range(len(runs)), key=lambda i: (-runs[i][1], i))[:1])
    keep = set(strong)
    filled = [[k for k in range(a, b) if sizes[k]] for _, _, a, b in runs]
    for i in range(1, len(runs)):  # the container of a kept run is still open
        here = filled[i - 1][-1]
        if i - 1 in keep and min(x[4] for x in lines[here + 1:filled[i][0] + 1]) >= lines[here][3]:
            keep.add(i)
    for i in range(len(runs) - 2, -1, -1):
        here, ahead = filled[i][-1], filled[i + 1][0]
        if i + 1 in keep and min([lines[here][3], *(x[4] for x in lines[here + 1:ahead + 1])]) >= lines[ahead][3]:
            keep.add(i)
    return "\n".join(t for i in sorted(keep) for t in texts[runs[i][2]:runs[i][3]] if t)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  **how: float) -> DataFrame:
    """id_col, url_col, text and n_chars (code points) of every page.

    Null or empty pages, and pages without text, give an empty string and 0; a page without markup is text. Repeated
    rows are kept; an empty table gives an empty result; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [extract_main(p, **how) for p in texts_of(batch, "html")]
        return pa.RecordBatch.from_arrays(
            [column(batch, "id"), column(batch, "url"), pa.array(found, pa.string()),
             pa.array([len(t) for t in found], pa.int64())], ["id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    key, url = (picked.schema[c].dataType.simpleString() for c in ("id", "url"))
    out = map_arrow(picked, run, f"id {key}, url {url}, text string, n_chars bigint", rows=256)
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
