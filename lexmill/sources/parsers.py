"""Document parsers: a registry of functions from text to sections, run per file in Arrow batches.

Every parser returns sections with id, title, content, heading_path, level, tables, code_blocks and links.
Scans hand over whole files, so one task holds one file at a time.
"""

from __future__ import annotations

import csv
import io
import re
import unicodedata
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

SECTION = (
    "struct<id:string,title:string,content:string,heading_path:array<string>,level:int,parent_id:string,"
    "tables:array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>,"
    "code_blocks:array<struct<language:string,code:string>>,links:array<struct<target:string,label:string,ref_type:string>>>"
)


@dataclass
class Section:
    title: str
    level: int = 1
    content: str = ""
    heading_path: list[str] = field(default_factory=list)
    id: str = ""
    parent_id: str | None = None
    tables: list[dict] = field(default_factory=list)
    code_blocks: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)


def slug(title: str) -> str:
    kept = re.sub(r"[^\w\s/-]", "", title.lower().strip())
    return re.sub(r"\s+", "-", kept) or "section"


def number_sections(found: list[Section]) -> list[Section]:
    """Unique ids, heading paths and parents from titles and levels."""
    used: set[str] = set()
    path: list[str] = []
    open_: list[Section] = []
    for s in found:
        base, n = slug(s.title), 0
        s.id = base
        while s.id in used:
            n += 1
            s.id = f"{base}-{n}"
        used.add(s.id)
        path = [*path[: s.level - 1], s.title]
        s.heading_path = list(path)
        while open_ and open_[-1].level >= s.level:
            open_.pop()
        s.parent_id = open_[-1].id if open_ else None
        open_.append(s)
    return found


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


#: A fence's line (with a language where it opens), a table's row, and the rule below its head.
FENCE, FENCE_END, ROW, RULE = re.compile(r"```(\w*)$"), re.compile(r"```\s*$"), re.compile(r"\|.+\|$"), re.compile(r"\|[-| :]+\|$")


def _body(lines: list[str], section: Section) -> None:
    """Fill content, code blocks, pipe tables and links from a section's lines.

    Content is without fenced lines and table rows; a fence that nothing closes runs to the end of the section.
    """
    kept: list[str] = []
    inside = False
    for line in lines:
        if FENCE.match(line) or FENCE_END.match(line):
            inside = not inside
        elif not inside and not ROW.match(line):
            kept.append(line)
            for label, target in re.findall(r"\[([^\]]+)\]\(([^)\s]+)\)", line):
                section.links.append({"target": target, "label": label, "ref_type": "link"})
    section.content = "\n".join(kept).strip()
    at = 0
    while at < len(lines):
        opened = FENCE.match(lines[at])
        if opened:
            end = next((j for j in range(at + 1, len(lines)) if FENCE_END.match(lines[j])), len(lines))
            section.code_blocks.append({"language": opened[1], "code": "\n".join(lines[at + 1 : end])})
            at = end
        at += 1
    at = 0
    while at + 1 < len(lines):
        if ROW.match(lines[at]) and RULE.match(lines[at + 1]):
            end = next((j for j in range(at + 2, len(lines)) if not ROW.match(lines[j])), len(lines))
            section.tables.append({"headers": _cells(lines[at]), "rows": [_cells(x) for x in lines[at + 2 : end]], "caption": ""})
            at = end
        else:
            at += 1


def parse_markdown(text: str) -> list[Section]:
    """ATX headings open sections; text before the first one is dropped."""
    found: list[Section] = []
    held: list[list[str]] = []
    for line in text.splitlines():
        heading = re.match(r"(#{1,6})\s+(.+)$", line)
        if heading:
            found.append(Section(heading[2].strip(), len(heading[1])))
            held.append([])
        elif held:
            held[-1].append(line)
    for section, lines in zip(found, held):
        _body(lines, section)
    return number_sections(found)


RST_ROLE = re.compile(r":(class|func|meth|mod|ref|doc|attr|exc|data):`(?:([^`<]+)<)?([^`>]+)>?`")


def parse_rst(text: str) -> list[Section]:
    """Underlined (and overlined) titles; levels by the order in which their characters first appear."""
    lines = text.split("\n")
    marks: list[str] = []
    found: list[Section] = []
    held: list[list[str]] = []
    rule = re.compile(r"^([=\-~^\"'`#*+.:_])\1{2,}\s*$")
    i = 0
    while i < len(lines):
        line = lines[i]
        over = rule.match(line) and i + 2 < len(lines) and lines[i + 1].strip() and rule.match(lines[i + 2]) and lines[i + 2][0] == line[0]
        under = line.strip() and i + 1 < len(lines) and rule.match(lines[i + 1]) and len(lines[i + 1].rstrip()) >= len(line.rstrip()) and not rule.match(line)
        if over or under:
            title, mark = (lines[i + 1].strip(), line[0] * 2) if over else (line.strip(), lines[i + 1][0])
            if mark not in marks:
                marks.append(mark)
            found.append(Section(title, marks.index(mark) + 1))
            held.append([])
            i += 3 if over else 2
            continue
        if held:
            held[-1].append(line)
        i += 1
    for section, body in zip(found, held):
        kept: list[str] = []
        j = 0
        while j < len(body):
            line = body[j]
            block = re.match(r"^(\s*)\.\. code(?:-block)?::\s*(\S*)", line)
            bare = not block and line.rstrip().endswith("::") and not line.lstrip().startswith("..")
            if block or bare:
                indent = len(line) - len(line.lstrip())
                code = []
                j += 1
                while j < len(body) and (not body[j].strip() or len(body[j]) - len(body[j].lstrip()) > indent):
                    code.append(body[j].strip())
                    j += 1
                section.code_blocks.append({"language": block[2] if block else "", "code": "\n".join(code).strip()})
                if bare and line.strip() != "::":
                    kept.append(line.rstrip()[:-1])
                continue
            if re.match(r"^\s*\+[-=+]+\+\s*$", line):
                grid = []
                while j < len(body) and re.match(r"^\s*[+|]", body[j]):
                    grid.append(body[j].strip())
                    j += 1
                rows = [_cells(g) for g in grid if g.startswith("|")]
                if rows:
                    section.tables.append({"headers": rows[0], "rows": rows[1:], "caption": ""})
                continue
            if not line.lstrip().startswith(".. "):
                kept.append(line)
                for kind, label, target in RST_ROLE.findall(line):
                    section.links.append({"target": target, "label": (label or target).strip(), "ref_type": kind})
            j += 1
        section.content = "\n".join(kept).strip()
    return number_sections(found)


class _Outline(HTMLParser):
    """Headings, text, tables, code and links of a page in document order."""

    SKIP = {"script", "style", "nav", "footer", "header", "aside"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.sections = "", []
        self.depth_skip = 0
        self.into: str | None = None
        self.text: list[str] = []
        self.row: list[str] | None = None
        self.table: dict | None = None
        self.code: dict | None = None
        self.href: str | None = None

    def current(self) -> Section:
        if not self.sections:
            self.sections.append(Section(self.title or "page"))
        return self.sections[-1]

    def handle_starttag(self, tag, attrs):
        have = dict(attrs)
        if tag in self.SKIP:
            self.depth_skip += 1
        elif tag == "title" or re.fullmatch("h[1-6]", tag) or tag in ("td", "th", "dt"):
            self.into, self.text = tag, []
        elif tag == "table":
            self.table = {"headers": [], "rows": [], "caption": ""}
        elif tag == "tr":
            self.row = []
        elif tag in ("pre", "code") and self.code is None:
            language = re.search(r"language-(\S+)", have.get("class") or "")
            self.code = {"language": language[1] if language else "", "code": ""}
        elif tag == "a" and have.get("href"):
            self.href = have["href"]
            self.current().links.append({"target": self.href, "label": "", "ref_type": have.get("class") or "link"})

    def handle_endtag(self, tag):
        text = " ".join("".join(self.text).split())
        if tag in self.SKIP:
            self.depth_skip = max(0, self.depth_skip - 1)
        elif tag == "title":
            self.title, self.into = text, None
        elif re.fullmatch("h[1-6]", tag):
            self.sections.append(Section(text, int(tag[1])))
            self.into = None
        elif tag == "dt":
            self.sections.append(Section(text, min(6, self.current().level + 1)))
            self.into = None
        elif tag in ("td", "th") and self.row is not None:
            self.row.append(text)
            if tag == "th" and self.table is not None and not self.table["rows"]:
                self.table["headers"].append(text)
            self.into = None
        elif tag == "tr" and self.table is not None and self.row is not None:
            if self.row and self.row != self.table["headers"]:
                self.table["rows"].append(self.row)
            self.row = None
        elif tag == "table" and self.table is not None:
            if self.table["rows"]:
                self.current().tables.append(self.table)
            self.table = None
        elif tag == "pre" or (tag == "code" and self.code is not None):
            if self.code and self.code["code"].strip():
                self.current().code_blocks.append(self.code)
            self.code = None
        elif tag == "a":
            self.href = None

    def handle_data(self, data):
        if self.depth_skip and self.into != "title":
            return
        if self.into:
            self.text.append(data)
        elif self.code is not None:
            self.code["code"] += data
        elif data.strip():
            self.current().content += (" " if self.current().content else "") + " ".join(data.split())
            if self.href and self.current().links and not self.current().links[-1]["label"]:
                self.current().links[-1]["label"] = data.strip()


def parse_html(text: str) -> list[Section]:
    outline = _Outline()
    outline.feed(text)
    outline.close()
    return number_sections(outline.sections)


# A filing's item headers, the longest header and the fallback's length.
ITEM, HEADER_LENGTH, FALLBACK = re.compile(r"^\s*item\s+\d+[ab]?\b", re.I), 200, 50_000


def parse_filing(text: str) -> list[Section]:
    """Annual reports: block texts that start with "Item N" open sections; repeated headers are one."""
    blocks = [" ".join(re.sub(r"<[^>]*>", " ", b).split()) for b in re.split(r"(?i)</(?:p|div|tr|h\d|td)>|<br\s*/?>", text)]
    found: list[Section] = []
    seen: set[str] = set()
    for block in filter(None, blocks):
        if ITEM.match(block) and len(block) <= HEADER_LENGTH:
            if block.lower() not in seen:
                seen.add(block.lower())
                found.append(Section(block))
        elif found:
            found[-1].content += ("\n" if found[-1].content else "") + block
    if not found:
        found = [Section("filing", content="\n".join(filter(None, blocks))[:FALLBACK])]
    return number_sections(found)


def parse_plaintext(text: str) -> list[Section]:
    """Lines in capitals followed by a blank one are headings."""
    lines = text.split("\n")
    found = [Section("document")]
    for i, line in enumerate(lines):
        heading = re.fullmatch(r"[A-Z][A-Z0-9 :,&/\-]{2,79}", line.strip()) and (i + 1 == len(lines) or not lines[i + 1].strip())
        if heading:
            found.append(Section(line.strip()))
        else:
            found[-1].content += line + "\n"
    for s in found:
        s.content = s.content.strip()
    return number_sections([s for s in found if s.content or s is not found[0]])


def parse_csv(text: str, rows_a_section: int = 20) -> list[Section]:
    """Sections of 20 rows, each row as ``h: v; h: v`` of the cells that are not blank; a tab in the first line makes it
    TSV; blank rows go."""
    first = text.split("\n", 1)[0]
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), delimiter="\t" if "\t" in first else ",")]
    if not rows:
        return []
    head, body = rows[0], [r for r in rows[1:] if any(r)]
    found = []
    for at in range(0, len(body), rows_a_section):
        part = body[at : at + rows_a_section]
        content = "\n".join("; ".join(f"{h}: {v}" for h, v in zip(head, r) if v) for r in part)
        found.append(Section(f"Rows {at + 1}-{at + len(part)}", content=content, tables=[{"headers": head, "rows": part, "caption": ""}]))
    return number_sections(found)


def parse_docx(data: bytes) -> list[Section]:
    """Paragraph styles give headings; needs nothing but the standard library."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    found = [Section("document")]
    for p in root.iter(f"{space}p"):
        text = "".join(t.text or "" for t in p.iter(f"{space}t"))
        style = p.find(f"{space}pPr/{space}pStyle")
        heading = re.fullmatch(r"Heading(\d)", style.get(f"{space}val", "")) if style is not None else None
        if heading:
            found.append(Section(text, int(heading[1])))
        elif text.strip():
            found[-1].content += ("\n" if found[-1].content else "") + text
    return number_sections([s for s in found if s.content or s is not found[0]])


def headings_by_size(spans: list[tuple[float, str]]) -> list[Section]:
    """Sections from (font size, text) spans of a page layout: larger than 1.15 times the upper median is a heading."""
    if not spans:
        return []
    sizes = sorted(s for s, _ in spans)
    median = sizes[len(sizes) // 2]
    is_heading = lambda s, t: s > 1.15 * median and len(t) < 200
    ranks = {s: i + 1 for i, s in enumerate(sorted({round(s, 1) for s, t in spans if is_heading(s, t)}, reverse=True))}
    found = [Section("document")]
    for s, t in spans:
        if is_heading(s, t):
            found.append(Section(t.strip(), ranks[round(s, 1)]))
        else:
            found[-1].content += ("\n" if found[-1].content else "") + t
    return number_sections([s for s in found if s.content or s is not found[0]])


PARSERS: dict[str, Callable[[str], list[Section]]] = {
    "markdown": parse_markdown, "rst": parse_rst, "html": parse_html, "filing": parse_filing, "text": parse_plaintext, "csv": parse_csv, "web": parse_html,
}
# The known extensions and their formats.
EXTENSIONS = {
    ".md": "markdown", ".markdown": "markdown", ".rst": "rst", ".html": "html", ".htm": "html", ".txt": "text",
    ".csv": "csv", ".tsv": "csv", ".docx": "docx", ".pdf": "pdf", ".xml": "html",
}


def decode(data: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def parse(data: bytes, kind: str) -> list[Section]:
    if kind == "docx":
        return parse_docx(data)
    return PARSERS[kind](unicodedata.normalize("NFC", decode(data)))
