"""Documents to sections: HTML, Markdown and page texts; scripts in templates. Sequential state, so Arrow batches of rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Characters of texts whose sections are held at a time.
BATCH = 1 << 20
Section = tuple[str, int, str, str]  # heading, level, kind, content
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_DROPPED = {"script", "style", "nav", "header", "footer", "aside"}


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.sections: list[Section] = []
        self.title, self.heading, self.level = "", "", 0
        self.dropped, self.kind, self.held, self.rows = 0, "", [], []

    def flush(self) -> None:
        text = re.sub(r"[^\S\n]+", " ", "".join(self.held)).strip() if self.kind != "code" else "".join(self.held).strip("\n")
        if text and (self.kind in ("code", "table", "list") or len(text) > 10):
            self.sections.append((self.heading, self.level, self.kind or "text", text))
        self.held, self.kind = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in _DROPPED:
            self.dropped += 1
        if self.dropped or tag in _VOID:
            return
        if tag == "title" or re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind = tag
        elif tag in ("pre", "table", "ul", "ol", "p", "div", "article", "main"):
            if self.kind not in ("table", "list", "code"):
                self.flush()
                self.kind = {"pre": "code", "table": "table", "ul": "list", "ol": "list"}.get(tag, "")
        elif tag in ("tr", "li") and self.held:
            self.held.append("\n")
        elif tag in ("td", "th") and self.held and not self.held[-1].endswith("\n"):
            self.held.append(" | ")

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif self.kind == tag and (tag == "title" or re.fullmatch("h[1-6]", tag)):
            text = " ".join("".join(self.held).split())
            self.held, self.kind = [], ""
            if tag == "title":
                self.title = text
            else:
                self.heading, self.level = text, int(tag[1])
        elif tag in ("pre", "table", "ul", "ol", "p", "div", "article", "main", "body"):
            if {"pre": "code", "table": "table", "ul": "list", "ol": "list"}.get(tag, "") == self.kind:
                self.flush()

    def handle_data(self, data):
        if not self.dropped:
            self.held.append(data)


def html_sections(html: str) -> list[Section]:
    """Sections of the main part (main, article, body or all of it), without scripts and navigation."""
    parser = _Html()
    head = re.search(r"(?is)<title[^>]*>.*?</title>", html)
    for tag in ("main", "article", "body"):
        if m := re.search(rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", html):
            html = m[1]
            break
    parser.feed((head[0] if head else "") + html)
    parser.close()
    parser.flush()
    return [s if s[0] else (parser.title, 0, *s[2:]) for s in parser.sections]


def markdown_sections(text: str) -> list[Section]:
    """Headings of one to six marks, fenced code, tables and text between them."""
    out: list[Section] = []
    heading, level, held, fence, table = "", 0, [], None, []

    def flush(kind: str, lines: list[str]) -> None:
        if body := "\n".join(lines).strip("\n"):
            out.append((heading, level, kind, body))
        lines.clear()

    for line in text.split("\n"):
        if fence is not None:
            if line.strip().startswith(fence):
                flush("code", held)
                fence = None
            else:
                held.append(line)
            continue
        if m := re.match(r"\s*(```+|~~~+)", line):
            flush("text", held)
            flush("table", table)
            fence = m[1]
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            flush("text", held)
            flush("table", table)
            heading, level = m[2].strip(), len(m[1])
        elif re.match(r"\s*\|.*\|\s*$", line):
            flush("text", held)
            table.append(line.strip())
        else:
            flush("table", table)
            held.append(line)
    flush("table", table)
    flush("code" if fence else "text", held)
    return out


def page_sections(text: str) -> list[Section]:
    """Text of pages parted by form feeds: short numbered or capital lines are headings; a block of which more than half
    the lines look like code is code."""
    out: list[Section] = []
    heading, level = "", 0
    for page in text.split("\f"):
        for block in re.split(r"\n\s*\n", page):
            lines = [x for x in block.split("\n") if x.strip()]
            if not lines:
                continue
            first = lines[0].strip()
            m = re.fullmatch(r"(?:(\d+(?:\.\d+)*)\.?\s+|Chapter\s+\d+:?\s*)?([A-Z][^.!?]{2,78})", first)
            if len(lines) == 1 and m and (m[1] or first.isupper() or first.startswith("Chapter")):
                heading, level = first, (m[1] or "1").count(".") + 1
                continue
            code = sum(bool(re.search(r"[;{}]\s*$|^\s{4,}\S|^\s*(SELECT|CREATE|BEGIN|END|def |class |import )", x)) for x in lines)
            out.append((heading, level, "code" if 2 * code > len(lines) else "text", "\n".join(lines)))
    return out


def sections_of(docs: DataFrame, extract: Callable[[str], list[Section]], key: str = "id", text: str = "content") -> DataFrame:
    """key, at, heading, level, kind, content: a row for each section."""
    names = [key, "at", "heading", "level", "kind", "content"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            #: rows go out by about BATCH characters, however many texts come in
            rows, held = [], 0
            for k, x in zip(df[key], df[text], strict=True):
                rows += [(k, i, *s) for i, s in enumerate(extract(x or ""))]
                held += len(x or "")
                if held >= BATCH:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, at int, heading string, level int, kind string, content string")


def breadcrumbs(sections: list[Section]) -> list[tuple[str, ...]]:
    """The path of headings above each section."""
    stack: list[tuple[int, str]] = []
    out = []
    for heading, level, *_ in sections:
        if heading and (not stack or stack[-1] != (level, heading)):
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, heading))
        out.append(tuple(h for _, h in stack))
    return out


def scripts_of(text: str, ending: str) -> tuple[str, str, list[int]]:
    """The scripts of a template joined by blank lines, their language, and the original line (from 1) of each line."""
    lines, out, where, language, inside = text.split("\n"), [], [], "javascript", False
    if ending == ".astro" and lines and lines[0].strip() == "---":
        end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), len(lines))
        out, where, language = lines[1:end], list(range(2, end + 1)), "typescript"
        lines = [""] * (end + 1) + lines[end + 1 :]
    for i, line in enumerate(lines):
        if not inside and (m := re.search(r"<script\b([^>]*)>(.*)", line, re.I)):
            if re.search(r"""lang=["']ts["']|type=["']text/typescript["']""", m[1]):
                language = "typescript"
            if out:
                out.append("")
                where.append(i + 1)
            inside = "</script>" not in m[2].lower()
            body = re.split(r"(?i)</script>", m[2])[0]
            if body.strip():
                out.append(body)
                where.append(i + 1)
        elif inside:
            if "</script>" in line.lower():
                inside = False
            else:
                out.append(line)
                where.append(i + 1)
    return "\n".join(out), language, where
