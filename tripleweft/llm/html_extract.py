"""Main text of pages: markup rules, and differencing against the page of the nearest URL on the host."""

import html as _html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keep, with_offsets

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "math", "canvas", "object", "video", "audio"}
SKIPPED = {"nav", "footer", "aside", "form", "head", "dialog", "button", "select", "menu"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}
#: Whole names of classes and ids that mark what isn't the page's text: a thing's name, or that name with a container's behind it ("ad-slot", "comment_list").
NAMES = re.compile(
    r"^(ads?|adverts?|advertisements?|advertising|adsense|adsbygoogle|sponsor|sponsors|sponsored|promo|promos|promotion|banner|banners|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|sidebar|widgets?|related|recommended|recommendations"
    r"|shar(e|ing)|social|breadcrumbs?|menus?|menubar|nav|navbar|navigation|footer|masthead|comments?|disqus|respond|repl(y|ies)|pagination|pager|toolbar|login|signup|skip)"
    r"([-_](slots?|units?|box|boxes|container|wrapper|wrap|area|block|bar|buttons?|links?|list|section|thread|form|signup|widgets?|popup|modal|banner|notice|overlay|posts?|articles?))*$"
)
#: Of these, what may stand inside an article: adverts, readers' comments, rows of buttons and boxes laid over it. Anything else in an article is its text, whatever it is called.
INSIDE = re.compile(r"^(ads?|adverts?|advertisements?|advertising|adsense|adsbygoogle|sponsored|cookies?|consent|gdpr|newsletter|comments?|disqus|respond|social|shar(e|ing)[-_](bar|buttons?|links?)|related[-_](posts?|articles?|links?)|breadcrumbs?|navbar|pagination|pager)([-_](slots?|units?|box|container|wrapper|area|block|bar|list|section|thread|form|signup|banner|notice))*$")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that hold the page's content whatever classes a theme sets on them.
HOLDERS = {"html", "body", "main", "article"}
DROPPED, PLAIN, ARTICLE, LINKS = 0, 1, 2, 3


def _zone(name: str, attributes: str, now: int, reopen: bool = False) -> int:
    """The zone inside an element, by its name and attributes; with reopen, an article inside a dropped element is read."""
    if now == DROPPED and not (reopen and name == "article"):
        return now
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    tokens = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    names = INSIDE if now == ARTICLE else NAMES
    if name in SKIPPED or name == "header" and now != ARTICLE or name not in HOLDERS and any(names.match(x) for x in tokens) or now != ARTICLE and name == "div" and any(re.match(r"(site|page|main)?[-_]?header$", x) for x in tokens):
        return DROPPED
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true" or HIDDEN.search(found.get("style", "")) or re.search(r"(^|\s)hidden(\s|$)", ATTRIBUTE.sub(" ", attributes)):
        return DROPPED
    return ARTICLE if name == "article" or found.get("itemprop") == "articleBody" else now


def lines(page: str | None) -> list[tuple[str, int]]:
    """A page's blocks of text in order, each with its zone. If its article lies in a dropped element and is longer than all that is left, it is read from there."""
    out = _lines(page)
    if "<article" in (page or "").lower() and all(z < ARTICLE for _, z in out):
        again = _lines(page, reopen=True)
        size = lambda found, zone: sum(len(t) for t, z in found if z == zone)
        if size(again, ARTICLE) > size(out, PLAIN):
            return again
    return out


def _lines(page: str | None, reopen: bool = False) -> list[tuple[str, int]]:
    """A page's blocks of text in order, each with its zone: dropped by markup, plain, of the article, or of the article and nothing but links. Unclosed elements end where an outer one does."""
    out, held, zone, stack, at, loose = [], [], PLAIN, [], 0, False
    page = page or ""

    def take(text):
        nonlocal loose
        held.append(text)
        loose = loose or bool(text) and not text.isspace() and not any(n == "a" for n, _ in stack)

    def flush():
        nonlocal loose
        text = " ".join(_html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, zone if loose or zone != ARTICLE else LINKS))
        loose = False

    while m := TAG.search(page, at):
        take(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "br":
                held.append(" ")
                continue
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name not in INLINE or depth is not None and stack[depth][1] != zone:
                flush()
            if depth is not None:
                zone = stack[depth][1]
                del stack[depth:]
            continue
        if name in RAW:
            if m[0].endswith("/>"):
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in VOID or m[0].endswith("/>"):
            if name not in INLINE:
                flush()
            continue
        inside = None
        if name not in INLINE or m[3].strip():
            shut = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
            if name not in INLINE:
                flush()
            while shut and (i := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), None)) is not None and stack[i][0] in shut:
                zone = stack[i][1]
                del stack[i:]
            inside = _zone(name, m[3], zone, reopen)
            if inside != zone:
                flush()
        stack.append((name, zone))
        zone = zone if inside is None else inside
    take(page[at:])
    flush()
    return out


def shared(a: list, b: list, most: int = 200_000_000) -> list[int]:
    """Where in a a longest common subsequence with b lies: bit-parallel rows, and above `most` bits the middle of a is placed first (in linear space)."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = [*range(lo), *range(len(a) - hi, len(a))]
    both = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    rows = [i for i in range(lo, len(a) - hi) if a[i] in both]
    other = [x for x in b[lo : len(b) - hi] if x in both]
    stack = [(rows, other)]
    while stack:
        rows, other = stack.pop()
        if not rows or not other:
            continue
        if len(rows) * len(other) > most and len(rows) > 1:
            mid = len(rows) // 2
            ahead, behind = _lengths([a[i] for i in rows[:mid]], other), _lengths([a[i] for i in rows[:mid - 1:-1]], other[::-1])
            cut = int(np.argmax(np.array(ahead) + np.array(behind)[::-1]))
            stack += [(rows[:mid], other[:cut]), (rows[mid:], other[cut:])]
            continue
        table = [full := (1 << len(other)) - 1]
        where: dict = {}
        for j, x in enumerate(other):
            where[x] = where.get(x, 0) | 1 << j
        for i in rows:
            u = table[-1] & where.get(a[i], 0)
            table.append((table[-1] + u | table[-1] - u) & full)
        j = len(other) - 1
        for k in range(len(rows), 0, -1):  # a zero bit: the length rises there
            while j >= 0 and table[k] >> j & 1:
                j -= 1
            if j < 0:
                break
            if table[k - 1] >> j & 1:
                out.append(rows[k - 1])
                j -= 1
    return sorted(out)


def _lengths(a: list, b: list) -> list[int]:
    """The length of a longest common subsequence of a with each prefix of b."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    now = full = (1 << len(b)) - 1
    for x in a:
        u = now & where.get(x, 0)
        now = (now + u | now - u) & full
    bits = np.array([0, *(c == "0" for c in reversed(f"{now:0{len(b)}b}"))], np.int64)
    return np.cumsum(bits).tolist()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Every page is paired with its neighbour in the order of host, path and page_id that shares the longer start of its path (the one before, if equal); their lines are aligned,
    and lines in common are deleted: outside an article element all of them (but where nearly the whole page is shared, as in copies), inside one only those that are nothing but links, since sentences may recur. Lines that the markup marks as menus, adverts and so on go too; where
    a page has an article element, only its lines stay. Null pages are empty; null URLs are one host; repeated rows are extracted alike, and rows of one page_id by their own html; very long pages are read whole (alignment takes linear space); an empty table gives an empty result.
    """
    import xxhash

    kind = dict(pages.dtypes)["page_id"]
    pages = pages.select("page_id", "url", "html").withColumn("_sig", F.xxhash64("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)

    def sketch(batches):
        for b in batches:
            found = [lines(x.as_py()) for x in b["html"]]
            yield {k: b[k] for k in ("page_id", "_sig", "host", "path")} | {
                "hashes": [np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _ in f], np.uint64).view(np.int64) for f in found], "zones": [bytes(z for _, z in f) for f in found]}

    flat = keep(arrow_map(pages.withColumns({"host": host, "path": path}).select("page_id", "_sig", "host", "path", "html"), sketch, f"page_id {kind}, _sig long, host string, path string, hashes array<long>, zones binary"))  # each page is parsed once here and once for its text
    placed = keep(with_offsets(flat, ["host", "path", "page_id", "_sig"], {"_pos": F.lit(1)}))
    side = lambda k, by: placed.select((F.col("_pos") + by).alias("_pos"), *[F.col(c).alias(f"{k}_{c}") for c in ("host", "path", "hashes")])
    near = placed.join(side("a", 1), "_pos", "left").join(side("b", -1), "_pos", "left")

    def align(batches):
        start = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        for b in batches:
            rows = {"page_id": [], "_sig": [], "_drop": []}
            for r in zip(*[b[k].to_pylist() for k in ("page_id", "_sig", "host", "path", "hashes", "zones", "a_host", "a_path", "a_hashes", "b_host", "b_path", "b_hashes")]):
                mine, zones, best = r[4], r[5], None
                for other in (r[6:9], r[9:12]):
                    if other[0] == r[2] and (best is None or start(r[3], other[1]) > start(r[3], best[1])):
                        best = other
                common = shared(mine, best[2]) if best else []
                own = LINKS if ARTICLE in zones else PLAIN
                drop = [i for i in common if zones[i] == own]
                if drop and (own == LINKS or LINKS not in zones and len(drop) < 0.9 * zones.count(PLAIN)):
                    for k, v in zip(rows, (r[0], r[1], drop)):
                        rows[k].append(v)
            yield rows

    drops = keep(arrow_map(near, align, f"page_id {kind}, _sig long, _drop array<int>").dropDuplicates(["page_id", "_sig"]))
    drops = drops.select(F.col("page_id").alias("_p"), F.col("_sig").alias("_s"), "_drop")
    if drops.count() <= 20_000:  # else the join shuffles
        drops = F.broadcast(drops)

    def text(batches):
        for b in batches:
            out = []
            for x, drop in zip(b["html"], b["_drop"].to_pylist()):
                found, gone = lines(x.as_py()), set(drop or ())
                least = ARTICLE if any(z >= ARTICLE for _, z in found) else PLAIN
                out.append(" ".join(t for i, (t, z) in enumerate(found) if z >= least and i not in gone).encode("utf-8", "replace").decode())
            yield {"page_id": b["page_id"], "url": b["url"], "text": out, "n_chars": [len(t) for t in out]}

    joined = pages.join(drops, F.col("page_id").eqNullSafe(F.col("_p")) & F.col("_sig").eqNullSafe(F.col("_s")), "left")
    return arrow_map(joined.select("page_id", "url", "html", "_drop"), text, f"page_id {kind}, url string, text string, n_chars long")
