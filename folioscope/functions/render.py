"""HTML to Markdown: a tolerant tree builder and a block renderer."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from folioscope.functions.markup import percent_decode
from folioscope.functions.text import SHORT_CODES

# Names of elements, and what the conversion leaves out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("style script link figcaption figure img gallery input button audio video source".split())
DROPPED_CLASSES = frozenset(
    "reference noprint mw-editsection metadata shortdescription mw-jump-link mw-indicators catlinks printfooter mw-references-wrap reflist refbegin navbox sistersitebox sidebar "
    "side-box ambox mw-empty-elt toc navbox-styles thumb mw-editsection-bracket mw-ref referencetooltip mw-cite-backlink hatnote-dummy ext-phonos ext-phonos-PhonosButton "
    "ext-phonos-attribution mwo-cat-pagination".split()
)
#: Elements that stand before the body, or that browsers keep apart from it.
BESIDE_BODY = frozenset("head title meta template".split())
DROPPED_SECTIONS = frozenset(["references", "notes", "footnotes", "notes and references", "references and notes", "works cited", "external links", "further reading", "family tree"])
DROPPED_SECTIONS_OF = {
    "fr": frozenset(["références", "notes et références", "notes et sources", "notes, sources et références", "sources et références", "liens externes", "bibliographie", "webographie"]),
    "es": frozenset(["referencias", "notas", "notas y referencias", "notas y fuentes", "notas, fuentes y referencias", "fuentes y referencias", "enlaces externos", "bibliografía", "webografía"]),
}
EDIT_MARKERS = {"fr": ["[edit]", "[modifier]"], "es": ["[edit]", "[editar]"]}
KEY_FACTS = {"fr": "Données clés", "es": "Datos clave"}
FENCES = {
    "c++": "cpp", "cxx": "cpp", "py": "python", "js": "javascript", "ts": "typescript", "c#": "csharp", "cs": "csharp", "yml": "yaml", "sh": "bash", "shell": "bash", "zsh": "bash",
    "dockerfile": "docker", "tex": "latex", "plain": "", "text": "", "wikitext": "", "wiki": "", "output": "text",
}
CATEGORY_HEADING = {"fr": "Catégories", "es": "Categorías"}
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption h1 h2 h3 h4 h5 h6 header html li main ol p pre section table tbody td tfoot th thead tr ul hr caption".split())
CLOSES_P = frozenset("address article blockquote center details div dl fieldset h1 h2 h3 h4 h5 h6 header hr main ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements nested deeper become siblings at this level, so no page exhausts the stack.
DEEPEST = 120
LINK_NAMESPACES = frozenset("file image media category".split())


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    @property
    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self):
        """The elements within, in the order of the page."""
        left = self.children[::-1]
        while left:
            c = left.pop()
            if isinstance(c, Node):
                yield c
                left.extend(c.children[::-1])

    def find(self, test) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]

    def _close(self, names: set[str], stops: frozenset | set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in names:
                del self.stack[k:]
                return
            if self.stack[k].tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, BLOCKS - {"p"})
        if tag in SAME:
            self._close(SAME[tag], {"ul", "ol", "dl", "table"})
        node = Node(tag, {})
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        if len(self.stack) > DEEPEST:
            self.stack.pop()
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag):
        self._close({tag}, {"table"} if tag not in ("table", "body", "html", "div", "section") else set())

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(source: str) -> Node:
    builder = _Builder()
    builder.feed(source)
    builder.close()
    return builder.root


def is_dropped(n: Node) -> bool:
    if n.tag in DROPPED or n.tag in BESIDE_BODY or n.classes & DROPPED_CLASSES or n.attrs.get("role") == "navigation" or n.attrs.get("typeof", "").startswith("mw:File"):
        return True
    if re.search(r"display\s*:\s*none", n.attrs.get("style", "")) and n.find(lambda c: c.tag == "math") is None:
        return True
    return n.attrs.get("aria-hidden") == "true" and n.tag in ("span", "sup", "div")


def target_of(href: str) -> str:
    return percent_decode(href.removeprefix("./").removeprefix("../")).replace("_", " ")


def balanced(url: str) -> str:
    return url if url.count("(") == url.count(")") else url.replace("(", "%28").replace(")", "%29")


def _around(mark: str, inner: str) -> str:
    core = inner.strip()
    return inner if not core else inner[: len(inner) - len(inner.lstrip())] + mark + core + mark + inner[len(inner.rstrip()) :]


def anchor(n: Node, label: str) -> str:
    href = n.attrs.get("href", "")
    text = label.strip()
    if not text or not href or href.startswith("#"):
        return label
    if re.match(r"(?i)[a-z][a-z0-9+.-]*:", href) or href.startswith("//"):
        if re.match(r"(?i)(?:https?:)?//", href):
            return f"<{href}>" if text == href else f"[{text}]({balanced(href)})"
        if href.lower().startswith(("geo:", "javascript:", "data:")):
            return label
    place = target_of(href)
    space = place.lstrip(":").partition(":")
    if space[1] and space[0].lower() in LINK_NAMESPACES:
        return ""
    return f"[[{place}]]" if place == text else f"[[{place}|{text}]]"


def inline(n: Node | str, pre: bool = False) -> str:
    if isinstance(n, str):
        return n if pre else re.sub(r"\s+", " ", n).replace("*", "\\*")
    if is_dropped(n):
        return ""
    tag = n.tag
    if tag == "br":
        return "\n" if pre else " "
    if tag == "math":
        code = n.attrs.get("alttext", "").replace("\\displaystyle ", "").strip()
        code = code[1:-1].strip() if code.startswith("{") and code.endswith("}") else code
        return (f"$${code}$$" if n.attrs.get("display") == "block" else f"${code}$") if code else ""
    inner = "".join(inline(c, pre) for c in n.children)
    if tag in ("b", "strong"):
        return _around("**", inner)
    if tag in ("i", "em", "cite", "var", "dfn"):
        return _around("*", inner)
    if tag in ("code", "tt", "kbd", "samp") and not pre:
        return _around("`", inner.replace("\\*", "*"))
    if tag == "sup":
        core = inner.strip()
        return "" if not core or core.startswith("[") else f"^{core}^"
    if tag == "sub":
        return f"~{inner.strip()}~" if inner.strip() else ""
    if tag == "a":
        return anchor(n, inner)
    return f" {inner} " if tag in BLOCKS else inner


def _line(text: str) -> str:
    return re.sub(r" +([,.;:!?)\]])", r"\1", " ".join(text.split()))


def table(n: Node) -> list[str]:
    rows = [r for r in n.walk() if r.tag == "tr" and not is_dropped(r)]
    cells = [[c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th") and not is_dropped(c)] for r in rows]
    if any(c.attrs.get("rowspan", "1") not in ("", "1") or c.attrs.get("colspan", "1") not in ("", "1") or c.find(lambda x: x.tag in ("ul", "ol")) for r in cells for c in r):
        out = []
        for r in cells:
            parts = []
            for c in r:
                spans = "".join(f' {k}="{c.attrs[k]}"' for k in ("rowspan", "colspan") if c.attrs.get(k, "1") not in ("", "1"))
                parts.append(f"<{c.tag}{spans}>{_line(''.join(inline(x) for x in c.children))}</{c.tag}>")
            out.append("<tr>" + "".join(parts) + "</tr>")
        return ["\n".join(["<table>", *out, "</table>"])] if out else []
    texts = [[_line("".join(inline(x) for x in c.children)).replace("|", "\\|") for c in r] for r in cells]
    kept = [(any(c.tag == "th" for c in r), t) for r, t in zip(cells, texts, strict=True) if any(t)]
    if not kept:
        return []
    head = next((k for k, (is_head, _) in enumerate(kept) if is_head), 0)
    order = [kept[head][1], *(t for k, (_, t) in enumerate(kept) if k != head)]
    width = max(map(len, order))
    lines = ["| " + " | ".join(t + [""] * (width - len(t))) + " |" for t in order]
    caption = n.find(lambda c: c.tag == "caption")
    named = [f"*{_line(inline(caption))}*"] if caption is not None and _line(inline(caption)) else []
    return [*named, "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])]


def _number(value: str, other: int) -> int:
    return int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else other


def listing(n: Node, depth: int = 0) -> list[str]:
    out, number = [], _number(n.attrs.get("start", ""), 1)
    for item in n.children:
        if not isinstance(item, Node) or is_dropped(item):
            continue
        if item.tag in ("ul", "ol"):
            out += listing(item, depth + 1)
            continue
        number = _number(item.attrs.get("value", ""), number)
        kind = n.attrs.get("type", "1")
        mark = "-" if n.tag != "ol" else f"{chr(ord(kind) + (number - 1) % 26)}." if kind in ("a", "A") else f"{number}."
        nested = [c for c in item.children if isinstance(c, Node) and c.tag in ("ul", "ol")]
        text = _line("".join(inline(c) for c in item.children if c not in nested))
        if text:
            out.append("  " * depth + f"{mark} {text}")
            number += 1
        for sub in nested:
            out += listing(sub, depth + 1)
    return out


def definitions(n: Node) -> list[str]:
    """Terms and what defines them; lists within a definition follow it, a level deeper."""
    out: list[str] = []
    for c in n.children:
        if not isinstance(c, Node) or is_dropped(c):
            continue
        if c.tag not in ("dt", "dd"):
            out += definitions(c)
            continue
        lists = [x for x in c.children if isinstance(x, Node) and x.tag in ("dl", "ul", "ol")]
        text = _line("".join(inline(x) for x in c.children if x not in lists))
        if c.tag == "dt" and text:
            out.append(f"- **{text}**")
        elif c.tag == "dd" and text:
            if out and out[-1].endswith("**") and ": " not in out[-1]:
                out[-1] += f": {text}"
            else:
                out.append(f"  - {text}" if out else f"- {text}")
        for x in lists:
            out += ["  " + line for line in (definitions(x) if x.tag == "dl" else listing(x))]
    return out


def key_facts(box: Node) -> list[str]:
    """Label and value rows of an infobox as a list."""
    out = []
    for r in (r for r in box.walk() if r.tag == "tr" and not is_dropped(r)):
        cells = [c for c in r.children if isinstance(c, Node) and c.tag in ("th", "td") and not is_dropped(c)]
        texts = [_line("".join(inline(x) for x in c.children)) for c in cells]
        if len(cells) == 2 and all(texts):
            out.append(f"- **{texts[0].rstrip(':')}**: {texts[1]}")
    return out


def blocks(n: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _line("".join(run))
        if text:
            out.append(text)
        run.clear()

    for c in n.children:
        if isinstance(c, str) or c.tag not in BLOCKS and not c.find(lambda x: x.tag in BLOCKS):
            run.append(inline(c))
            continue
        flush()
        if is_dropped(c) or "infobox" in c.classes:
            continue
        if re.fullmatch("h[1-6]", c.tag):
            text = _line("".join(inline(x) for x in c.children)).replace("**", "")
            if text:
                out.append("#" * max(2, int(c.tag[1])) + " " + text)
        elif "hatnote" in c.classes or c.attrs.get("role") == "note":
            text = _line(inline(c)).replace("*", "")
            if text:
                out.append(f"*{text}*")
        elif c.tag == "p":
            out += [t for t in (_line(part) for part in "".join(inline(x) if isinstance(x, str) or x.tag != "br" else "\x00" for x in c.children).split("\x00")) if t]
        elif c.tag in ("ul", "ol"):
            out.append("\n".join(listing(c)))
        elif c.tag == "dl":
            out.append("\n".join(definitions(c)))
        elif c.tag == "table":
            out += table(c)
        elif c.tag == "pre":
            marked = next((x.removeprefix("lang-").lower() for x in c.attrs.get("class", "").split() if x.startswith("lang-")), "")
            out.append(f"```{FENCES.get(marked, marked)}\n" + "".join(inline(x, True) for x in c.children).strip("\n") + "\n```")
        elif c.tag == "blockquote":
            out.append("\n".join("> " + line if line else ">" for line in "\n\n".join(blocks(c)).split("\n")))
        elif c.tag == "hr":
            out.append("---")
        else:
            out += blocks(c)
    flush()
    return [b for b in out if b]


def _level(block: str) -> int:
    m = re.match(r"(#{1,6}) ", block)
    return len(m[1]) if m else 0


def language(lang: str | None) -> str:
    """The first code of a list, without subtag; French and Spanish by their codes of two letters."""
    code = re.split(r"[,;\s]", lang or "", maxsplit=1)[0].partition("-")[0].lower()
    return SHORT_CODES.get(code, code)


def without_dropped_sections(parts: list[str], lang: str | None = None) -> list[str]:
    """Leaves out sections of no prose, with what they nest, then headings that have nothing below them."""
    kept, skip = [], 0
    gone = DROPPED_SECTIONS | DROPPED_SECTIONS_OF.get(language(lang), frozenset())
    for b in parts:
        level = _level(b)
        if level and (not skip or level <= skip):
            skip = level if " ".join(b.lstrip("# ").split()).lower() in gone else 0
        if not skip:
            kept.append(b)
    out: list[str] = []
    for k in range(len(kept) - 1, -1, -1):
        level = _level(kept[k])
        if not level or out and not (_level(out[-1]) and _level(out[-1]) <= level):
            out.append(kept[k])
    return out[::-1]


def html_to_md(source: str, title: str | None = None, lang: str | None = None, categories: bool = True) -> str:
    """A page as Markdown: title, introduction, key facts of infoboxes, sections, categories."""
    root = parse(source or "")
    by_id = lambda name: root.find(lambda n: n.attrs.get("id") == name)
    content = by_id("mw-content-text")
    wiki = (content.find(lambda n: "mw-parser-output" in n.classes) or content) if content else root.find(lambda n: "mw-parser-output" in n.classes)
    main = wiki or root.find(lambda n: n.tag == "body") or root
    heading = by_id("firstHeading") or (main.find(lambda n: n.tag == "h1") if wiki is None else None)
    named = title or (_line(heading.text()) if heading else "")
    if heading is not None and wiki is None and _line(heading.text()) == named:
        heading.children, heading.tag = [], "span"
    facts = [f for box in main.walk() if "infobox" in box.classes for f in key_facts(box)]
    parts = blocks(main)
    if facts:
        at = next((k for k, b in enumerate(parts) if _level(b)), len(parts))
        parts[at:at] = ["## " + KEY_FACTS.get(language(lang), "Key facts"), "\n".join(facts)]
    bar = by_id("mw-normal-catlinks")
    if categories and bar is not None:
        found = [_line(n.text()) for n in bar.walk() if n.tag == "li"]
        if found:
            parts += ["## " + CATEGORY_HEADING.get(language(lang), "Categories"), "\n".join(f"- {c}" for c in found)]
    text = "\n\n".join(([f"# {named}"] if named else []) + without_dropped_sections(parts, lang))
    for marker in EDIT_MARKERS.get(language(lang), ["[edit]"]):
        text = text.replace(marker, "")
    text = text.replace(" ", " ").replace("﻿", "").replace("​", "")
    return re.sub(r"\n{3,}", "\n\n", text).strip("\n") + "\n"
