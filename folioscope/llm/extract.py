"""Main text of web pages by equivalence classes of tokens across pages of a host.

Pages of a host (in blocks of bounded size) are cut into tokens: tags, and words told apart by the
path of elements they stand in. Tokens that occur equally often in every page of the block share an
occurrence vector and form an equivalence class. A class is valid if its tokens come in the same
order in every page. The class that occurs once in every page is the outer template; a valid class
that repeats is nested in the gap of the outer one that holds all its rounds, and one that no single
gap holds is dropped. Words of both are the site's, not the page's; what is left between them are the slots.
The main element holds nearly all the slots' text, not counting slots in menus, footers and the like:
an article or main element if one does, else the innermost that does. Its slots are the page's text.

In blocks of fewer than ``FEW_PAGES`` pages chance makes classes too: there the main element's words
all count as the page's, and class, id and role names tell menus, notices and the like.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import common

#: Pages and bytes of a block, about.
BLOCK_PAGES, BLOCK_BYTES = 256, 16 << 20
#: Blocks of a task, about.
TASK_BLOCKS = 4
#: Share of the slots' text that the main element holds.
MAIN_SHARE = 0.9
#: Pages from which on a block's classes alone tell the site's words; below it names of elements help.
FEW_PAGES = 8
#: What an element is beside the page's own text: not at all, by its class, id or role, by its tag or as it is hidden.
OWN, NAMED, BESIDE = range(3)
#: Levels of elements that a path names; below, a hash of the names stands for them, so paths stay short in pages nested without end.
LEVELS = 48

# Names of HTML elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
UNSEEN = frozenset("script style noscript template svg math iframe object form button select textarea head title canvas audio video dialog".split())
AROUND = frozenset("nav footer aside menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html head td th tr tbody thead tfoot caption option legend li dd dt".split())
ITEMS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_ITEMS = frozenset("ul ol dl table menu select".split())
#: Words of class, id and role values that mark what isn't the page's own text.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal overlay nav navbar navigation menu breadcrumb "
    "breadcrumbs header footer masthead sidebar aside widget related recommended share sharing social comment comments respond disqus newsletter subscribe signup login search "
    "toolbar pagination pager complementary contentinfo hidden".split()
)
#: Those of them that an article has of its own.
ARTICLE_WORDS = frozenset("header masthead".split())
#: Tags with a quote that never closes end at the next angle bracket.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>|\Z)|</?[a-zA-Z][^<>]*>?|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_WORD = re.compile(r"\S+")
_HIDDEN = re.compile(r"\shidden(?:[\s=>/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


@dataclass
class Page:
    """A page's tokens in order: (kind, value, path, aside). Kinds: '<' opens, '>' closes, 't' is text; aside: OWN, NAMED or BESIDE."""

    tokens: list[tuple[str, str, str, int]] = field(default_factory=list)


def _aside(name: str, tag: str, inside_main: bool) -> int:
    if name in UNSEEN or name in AROUND or name == "header" and not inside_main:
        return BESIDE
    if " " not in tag and "\n" not in tag and "\t" not in tag:
        return OWN
    if _HIDDEN.search(tag):
        return BESIDE
    if inside_main and name in ("article", "main", "body", "html", "p", "span", "b", "i", "a"):
        return OWN
    marks = " ".join("".join(m) for m in _MARK.findall(tag)).lower()
    named = ASIDE_WORDS.intersection(_PARTS.findall(marks)) if marks and name not in ("article", "main", "body", "html") else ()
    return NAMED if named and not (inside_main and ARTICLE_WORDS.issuperset(named)) else OWN


def _below(path: str, name: str) -> str:
    """The path of an element ``name`` in the element of ``path``."""
    if "~" in path or path.count("/") >= LEVELS:
        top, _, deep = path.partition("/~")
        return f"{top}/~{_mix(zlib.crc32(name.encode('utf-8', 'surrogatepass')) ^ int(deep or '0', 16)):016x}"
    return f"{path}/{name}"


def parse(source: str) -> Page:
    """Cuts a page into tokens. Elements left open are closed as HTML implies; stray end tags are ignored."""
    page = Page()
    add = page.tokens.append
    stack: list[tuple[str, str, int]] = []  # name, path, aside
    open_: Counter = Counter()  # elements on the stack by name

    def close_to(k: int) -> None:
        while len(stack) > k:
            name, path, aside = stack.pop()
            open_[name] -= 1
            add((">", name, path, aside))

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.match(source, at)
        value = m.group()
        at = m.end()
        _, path, aside = stack[-1] if stack else ("", "", OWN)
        if value[0] != "<" or value == "<":
            add(("t", value, path, aside))
            continue
        named = _NAME.match(value)
        if value.startswith(("<!", "<?")) or named is None:
            continue
        name = named.group(1).lower()
        if value[1] == "/":
            if open_[name]:
                close_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in CLOSES_P and open_["p"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close_to(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in ITEMS and any(open_[x] for x in ITEMS[name]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in KEEPS_ITEMS:
                    break
                if stack[k][0] in ITEMS[name]:
                    close_to(k)
                    break
        _, path, aside = stack[-1] if stack else ("", "", OWN)
        aside = aside if aside == BESIDE else max(aside, _aside(name, value, bool(open_["article"] or open_["main"])))
        path = _below(path, name)
        add(("<", name, path, aside))
        if name in VOID or value.endswith("/>") and name not in BLOCKS:
            add((">", name, path, aside))
            continue
        stack.append((name, path, aside))
        open_[name] += 1
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}", re.I).search(source, at)
            if stop is None:
                at = end
            elif stop.start() > at:
                add(("t", source[at : stop.start()], path, aside))
                at = stop.start()
    close_to(0)
    return page


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & (2**64 - 1)
    return x ^ (x >> 31)


Key = tuple[str, str, str]


@dataclass
class Template:
    """The outer class in order, the nested classes, the gap of the outer class that holds each, the main element's path.

    Gap k comes before the k-th token of the outer class; the last one comes after all. ``few``: the block has too few pages.
    """

    outer: list[Key]
    nested: list[set[Key]]
    gaps: list[int]
    main: str
    few: bool

    def words(self) -> dict[str, set[str]]:
        """The site's own words by path."""
        return _words_by_path(set(self.outer).union(*self.nested))


def _counts(page: Page, words: bool) -> Counter:
    """How often each token occurs in a page."""
    tags: Counter = Counter()
    texts: dict[str, Counter] = {}
    for kind, value, path, _ in page.tokens:
        if kind != "t":
            tags[kind, value, path] += 1
        elif words:
            texts.setdefault(path, Counter()).update(value.split())
    for path, found in texts.items():
        for word, n in found.items():
            tags["t", word, path] = n
    return tags


def _words_by_path(keys: Iterable[Key]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = defaultdict(set)
    for kind, value, path in keys:
        if kind == "t":
            out[path].add(value)
    return dict(out)


def _in_order(page: Page, keys: set[Key]) -> list[Key]:
    """The tokens of a page that are among ``keys``, in order."""
    words, out = _words_by_path(keys), []
    for kind, value, path, _ in page.tokens:
        if kind != "t":
            if (kind, value, path) in keys:
                out.append((kind, value, path))
        elif path in words:
            out += [("t", w, path) for w in value.split() if w in words[path]]
    return out


def deduce(pages: list[Page]) -> Template:
    """The template of pages of one site. A single page's own words can't be told from the site's: tags alone make it."""
    vectors: dict[Key, int] = defaultdict(int)
    in_pages: Counter = Counter()
    for number, page in enumerate(pages):
        mixed: dict[int, int] = {}
        for key, n in _counts(page, len(pages) > 2).items():
            if n not in mixed:
                mixed[n] = _mix(_mix(number + 1) + n)
            vectors[key] += mixed[n]
            in_pages[key] += 1
    once = sum(_mix(_mix(number + 1) + 1) for number in range(len(pages)))
    classes: dict[int, list] = defaultdict(list)
    for key, vector in vectors.items():
        if 2 * in_pages[key] >= len(pages):
            classes[vector].append(key)
    # a class is valid if its tokens keep their order: of the outer class, those that don't are left out
    outer = set(classes.pop(once, []))
    order: list[Key] | None = None
    for page in pages:
        found = _in_order(page, outer)
        if order is None:
            order = found
        elif found != order:
            order = _kept(order, found)
            outer = set(order)
    found = Template(order or [], [], [], "", len(pages) < FEW_PAGES)
    for keys, gap in _nested(pages, found.outer, [c for c in classes.values() if len(c) > 1]):
        found.nested.append(keys)
        found.gaps.append(gap)
    found.main = _main(pages, found)
    return found


def _kept(order: list[Key], found: list[Key]) -> list[Key]:
    """The longest run of ``order`` that comes in the same order in ``found``; each token is in it at most once."""
    place = {k: i for i, k in enumerate(found)}
    ends, last, before = [], [], {}  # by length: the least place that a run ends at, and its token
    for k in order:
        if k in place:
            n = bisect_left(ends, place[k])
            before[k] = last[n - 1] if n else None
            ends[n:], last[n:] = [place[k], *ends[n + 1 :]], [k, *last[n + 1 :]]
    out, k = [], last[-1] if last else None
    while k is not None:
        out.append(k)
        k = before[k]
    return out[::-1]


def _nested(pages: list[Page], outer: list[Key], classes: list[list[Key]]) -> list[tuple[set[Key], int]]:
    """The valid classes that repeat, with their gaps: in every page the same tokens in the same order, round by round, in one gap."""
    place = {k: i + 1 for i, k in enumerate(outer)}
    of = {k: c for c, keys in enumerate(classes) for k in keys}
    keys = set(place) | set(of)
    rounds: list[list[Key]] = [[] for _ in classes]  # the order of the first round
    gaps: list[int | None] = [None] * len(classes)
    valid = [True] * len(classes)
    for page in pages:
        gap, met = 0, [0] * len(classes)
        for k in _in_order(page, keys):
            if k in place:
                gap = place[k]
                continue
            c = of[k]
            at = met[c] % len(classes[c])
            met[c] += 1
            if len(rounds[c]) < len(classes[c]):
                valid[c] = valid[c] and k not in rounds[c]
                rounds[c].append(k)
            if rounds[c][at] != k or gaps[c] not in (None, gap):
                valid[c] = False
            gaps[c] = gap
    return [(set(keys), gap) for keys, gap, good in zip(classes, gaps, valid, strict=True) if good and gap is not None]


def _main(pages: list[Page], found: Template) -> str:
    """The path of the article or main element of the template, else of its innermost, that holds nearly all text of slots beside asides."""
    held: Counter = Counter()
    total = 0
    template, beside = found.words(), NAMED if found.few else BESIDE
    for page in pages:
        for kind, value, path, aside in page.tokens:
            if kind == "t" and aside < beside:
                own = template.get(path, ())
                size = sum(len(w) for w in value.split() if w not in own)
                if size:
                    total += size
                    held[path] += size
    within: Counter = Counter()
    for path, size in held.items():
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            within["/".join(parts[:k])] += size
    opens = {path for kind, _, path in found.outer if kind == "<"}
    fits = [p for p in opens | {""} if "~" not in p and p.rpartition("/")[2] in ("", "article", "main", "section", "div", "body", "html", "td", "center") and within[p] >= MAIN_SHARE * total]
    for name in ("/article", "/main"):  # what the site itself marks as the article, if it holds as much
        marked = [p for p in fits if p.endswith(name) and within[p] > 0]
        if marked:
            return max(marked, key=lambda p: (within[p], -len(p), p))
    return max(fits, key=lambda p: (len(p), p), default="")


def main_text(page: Page, found: Template) -> str:
    """The slots of the main element, in order, a line each block; of the whole page if it hasn't that element.

    The template's words are left out; in a block of few pages they stay.
    """
    main, beside = found.main, NAMED if found.few else BESIDE
    template = {} if found.few else found.words()
    if main and not any(kind == "<" and path == main for kind, _, path, _ in page.tokens):
        main = next((path for kind, value, path, aside in page.tokens if kind == "<" and value in ("article", "main") and aside < beside), "")
    blocks: list[list[str]] = [[]]
    for kind, value, path, aside in page.tokens:
        if aside >= beside or not (path == main or path.startswith(main + "/") or not main):
            continue
        if kind == "t":
            own = template.get(path)
            blocks[-1].append(_WORD.sub(lambda m: "" if m.group() in own else m.group(), value) if own else value)  # noqa: B023
        elif value in BLOCKS:
            blocks.append([])
        elif value == "br":
            blocks[-1].append(" ")
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(line for line in lines if line)


def extract_block(sources: list[str]) -> list[str]:
    """The main texts of pages of one site. Equal pages count once: words don't become the site's by being copied."""
    pages = {s: parse(s) for s in sources}
    found = deduce(list(pages.values()))
    texts = {s: main_text(p, found) for s, p in pages.items()}
    return [texts[s] for s in sources]


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, text and n_chars, one row for each row.

    Null html counts as empty; empty pages have the text ''. A null url, or one without a host, belongs to the
    site ''. Equal pages have equal texts within a block, and count once in its template. Pages may nest without
    end, and tags may be left open. Other columns are ignored, whatever their names. Sites of many pages are dealt to blocks by a hash of the row, so that no task holds one whole.
    """
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    sited = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    sizes = sited.groupBy("host").agg(F.expr(f"cast(ceil(greatest(count(*) / {BLOCK_PAGES}, sum(octet_length(html)) / {BLOCK_BYTES}, 1)) as int)").alias("blocks"))
    sizes = common.table(sizes, "extract-hosts")
    dealt = sited.join(common.small(sizes, 200_000), "host").withColumn("block", F.pmod(F.xxhash64("page_id", "url"), F.col("blocks")))
    blocks = sizes.agg(F.sum("blocks")).first()[0] or 0
    n = max(n, -(-blocks // TASK_BLOCKS))  # so that the longest task doesn't grow with the input
    dealt = dealt.select("host", "block", "page_id", "url", "html").repartition(n, "host", "block").sortWithinPartitions("host", "block", "page_id", "url")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, urls, sources = None, [], [], []

        def out() -> pa.RecordBatch:
            texts = extract_block(sources)
            row = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
            for x in (ids, urls, sources):
                x.clear()
            return row

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(2).type
            for h, b, i, u, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h, b) != key and ids:
                    yield out()
                key = (h, b)
                ids.append(i)
                urls.append(u)
                sources.append(s)
        if ids:
            yield out()

    return dealt.mapInArrow(common.light(run), f"page_id {kind}, url string, text string, n_chars long")


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))
