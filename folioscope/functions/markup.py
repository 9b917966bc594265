"""Regions of HTML and Markdown documents: paragraphs, headings, sections and their content."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from urllib.parse import unquote

INTRO = "_intro"
#: Elements whose text is no prose, and elements that end a paragraph when they open.
SKIPPED = "style script table figure sup title h1".split()
CLOSERS = frozenset("div ul ol dl li table blockquote pre hr h2 h3 h4 h5 h6".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[\s/][^>]*)?)>")
_HEADING = re.compile(r"<h([1-6])(?:[\s/][^>]*)?>(.*?)</h\1\s*>", re.I | re.S)
_HATNOTE = re.compile(r"class\s*=\s*[\"'][^\"']*\bhatnote\b|role\s*=\s*[\"']?note\b", re.I)
_SIMPLE = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
_REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]+)|#([0-9]+)|(\w+));")


def simple_unescape(text: str) -> str:
    """Numeric references and six names; other names stay as they are."""

    def one(m: re.Match) -> str:
        if m[3]:
            return _SIMPLE.get(m[3], m[0])
        digits, base = (m[1], 16) if m[1] else (m[2], 10)
        code = int(digits, base) if len(digits) < 9 else 0x110000
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 and code else "�"

    return _REFERENCE.sub(one, text)


def unescape(text: str) -> str:
    """All references of HTML, as browsers read them."""
    return entities.unescape(text)


def percent_decode(text: str) -> str:
    """UTF-8 percent escapes; signs that begin none stay, bytes that are no UTF-8 become U+FFFD, plus signs stay."""
    return unquote(text, errors="replace")


def _flat(text: str) -> str:
    return " ".join(simple_unescape(re.sub(r"<[^>]*>", "", text)).split())


def without_skipped(source: str) -> str:
    """The source without elements of no prose and hatnotes; tables and divisions go with what they nest."""
    out, at = [], 0
    while m := _TAG.search(source, at):
        name = m[2].lower()
        if m[1] or not (name in SKIPPED or _HATNOTE.search(m[3])) or m[3].endswith("/"):
            out.append(source[at : m.end()])
            at = m.end()
            continue
        out.append(source[at : m.start()])
        depth, at = 1, m.end()
        nests = name not in ("script", "style", "title")
        for t in re.compile(rf"<(/?){name}(?:[\s/][^>]*)?>", re.I).finditer(source, at):
            depth += -1 if t[1] else nests
            if depth == 0:
                at = t.end()
                break
        else:
            at = len(source)
    out.append(source[at:])
    return "".join(out)


def html_paragraphs(source: str, strict: bool = False) -> list[str]:
    """Prose from each <p>. What ends it is the next <p> or an opening block; with ``strict`` also its end tag."""
    found: list[str] = []
    start: int | None = None
    bare = re.sub(r"<!--.*?-->", "", without_skipped(source), flags=re.S)
    for m in _TAG.finditer(bare):
        name = m[2].lower()
        opens = not m[1] and name == "p"
        if opens or not m[1] and name in CLOSERS or strict and m[1] and name == "p":
            if start is not None:
                found.append(_flat(bare[start : m.start()]))
            start = m.end() if opens else None
    if start is not None:
        found.append(_flat(bare[start:]))
    return [p for p in found if p]


def html_body(source: str) -> str:
    """The inside of the wiki content division if there is one, else the whole."""
    m = re.search(r"<div[^>]*\bid\s*=\s*[\"']mw-content-text[\"'][^>]*>", source, re.I)
    if m is None:
        return source
    depth = 1
    for t in re.compile(r"<(/?)div(?:[\s/][^>]*)?>", re.I).finditer(source, m.end()):
        depth += -1 if t[1] else 1
        if depth == 0:
            return source[m.end() : t.start()]
    return source[m.end() :]


@dataclass
class Heading:
    level: int
    name: str
    start: int
    end: int


def html_headings(source: str) -> list[Heading]:
    return [Heading(int(m[1]), _flat(m[2]), m.start(), m.end()) for m in _HEADING.finditer(source)]


def extent(headings: list[Heading], k: int, end: int) -> int:
    """A heading governs what comes before the next one of its level or higher."""
    return next((h.start for h in headings[k + 1 :] if h.level <= headings[k].level), end)


def html_sections(source: str) -> list[tuple[str, list[str]]]:
    """The introduction, then every heading of level two and below with its paragraphs, nested ones included."""
    body = html_body(source)
    heads = html_headings(body)
    below = [k for k, h in enumerate(heads) if h.level >= 2]
    first = heads[below[0]].start if below else len(body)
    return [(INTRO, html_paragraphs(body[:first])), *((heads[k].name, html_paragraphs(body[heads[k].end : extent(heads, k, len(body))])) for k in below)]


def key_of(name: str) -> str:
    return " ".join(name.split()).lower()


def _best(heads: list[Heading], wanted: str) -> int | None:
    """The heading of that name: the highest, then the first."""
    found = [k for k, h in enumerate(heads) if wanted and key_of(h.name) == wanted]
    return min(found, key=lambda k: (heads[k].level, k), default=None)


def html_section_content(source: str, name: str) -> str | None:
    """The HTML of a section without style and script; null if there is no such section."""
    if key_of(name) == INTRO:
        paragraphs = html_sections(source)[0][1]
        return "\n\n".join(paragraphs) or None
    heads = html_headings(source)
    k = _best(heads, key_of(name))
    if k is None:
        return None
    part = source[heads[k].end : extent(heads, k, len(source))]
    part = re.sub(r"<(style|script)\b.*?</\1\s*>", "", part, flags=re.I | re.S)
    return re.sub(r"<[^>]*$", "", part).strip()


# --- Markdown -------------------------------------------------------------------------------------

_ATX = re.compile(r"^(#{1,6})(?:\s+(.*?))?\s*#*\s*$")
_LIST = re.compile(r"^\s*(?:[-*+]|\d+\.)\s")
_RULE = re.compile(r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$")


def is_hatnote(line: str) -> bool:
    """Wholly in single asterisks."""
    t = line.strip()
    return len(t) > 2 and t[0] == t[-1] == "*" and "*" not in t[1:-1] and t[1] != " "


def strip_inline(text: str) -> str:
    """Text without wikilink brackets, emphasis and code marks."""

    def link(m: re.Match) -> str:
        target, bar, label = m[1].partition("|")
        return label if bar else target.partition("#")[0].replace("_", " ")

    return re.sub(r"\[\[([^\[\]]*)\]\]", link, text).replace("*", "").replace("`", "")


def _lines(text: str) -> list[tuple[str, bool]]:
    """Lines, and whether each is part of a fenced block."""
    out, fence = [], None
    for line in text.split("\n"):
        mark = line.lstrip()[:3]
        if fence is None and mark in ("```", "~~~"):
            fence = mark
            out.append((line, True))
        elif fence is not None:
            out.append((line, True))
            if mark == fence:
                fence = None
        else:
            out.append((line, False))
    return out


def md_headings(text: str) -> list[Heading]:
    """ATX headings outside fences; start and end are line numbers."""
    out = []
    for k, (line, fenced) in enumerate(_lines(text)):
        m = None if fenced else _ATX.match(line)
        if m:
            out.append(Heading(len(m[1]), " ".join(strip_inline(m[2] or "").split()), k, k + 1))
    return out


def md_paragraphs(text: str) -> list[str]:
    """Blocks between blank lines; a table or a list is one; hatnotes, fences, headings and rules are none."""
    blocks: list[list[str]] = [[]]
    for line, fenced in _lines(text):
        if fenced or not line.strip() or _ATX.match(line) or _RULE.match(line):
            blocks.append([])
            continue
        listed, table = bool(_LIST.match(line)), line.lstrip().startswith("|")
        if blocks[-1] and (listed != bool(_LIST.match(blocks[-1][0])) or table != blocks[-1][0].lstrip().startswith("|")):
            blocks.append([])
        blocks[-1].append(line)
    out = []
    for b in blocks:
        if not b or len(b) == 1 and is_hatnote(b[0]):
            continue
        whole = "\n".join(b)
        plain = _flat(without_skipped(whole)) if whole.lstrip().startswith("<") else " ".join(strip_inline(whole).split())
        if plain:
            out.append(plain)
    return out


def md_sections(text: str) -> list[tuple[str, list[str]]]:
    """The introduction, then every heading but the leading one, which is the title."""
    lines = text.split("\n")
    heads = md_headings(text)
    if heads and not any(x.strip() for x in lines[: heads[0].start]):
        title, rest = heads[0].end, heads[1:]
    else:
        title, rest = 0, heads
    first = rest[0].start if rest else len(lines)
    out = [(INTRO, md_paragraphs("\n".join(lines[title:first])))]
    return out + [(h.name, md_paragraphs("\n".join(lines[h.end : extent(rest, k, len(lines))]))) for k, h in enumerate(rest)]


def md_section_content(text: str, name: str) -> str | None:
    lines = text.split("\n")
    heads = md_headings(text)
    wanted = key_of(re.sub(r"[*`]|_(?=[^_]*_)", "", name)) if name != INTRO else INTRO
    if wanted == INTRO:
        leads = heads and not any(x.strip() for x in lines[: heads[0].start])
        rest = heads[1:] if leads else heads
        return "\n".join(lines[heads[0].end if leads else 0 : rest[0].start if rest else len(lines)]).strip() or None
    k = _best(heads, wanted)
    return None if k is None else "\n".join(lines[heads[k].end : extent(heads, k, len(lines))]).strip()


def is_blank_article(markdown: str) -> bool:
    """Nothing after the title line but at most one bare link."""
    rest = [x for x in markdown.split("\n")[1:] if x.strip()]
    return not rest or len(rest) == 1 and re.fullmatch(r"\[\[[^\]]*\]\]", rest[0].strip()) is not None


def index_text(markdown: str) -> str:
    """What an introduction-only index takes: the title line and the paragraphs before the first section."""
    lines = markdown.split("\n")
    stop = next((k for k, x in enumerate(lines) if x.startswith("## ")), len(lines))
    parts = [p for p in "\n".join(lines[1:stop]).split("\n\n") if p.strip()]
    while parts and is_hatnote(parts[0]):
        parts = parts[1:]
    return "\n\n".join([lines[0], *(p.strip("\n") for p in parts)])
