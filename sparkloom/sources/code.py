"""Source code to symbols and edges, SQL scripts to statements, tables and routines; text to chunks with overlap."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

Symbol = tuple[str, str, str, int, int, str, str]  # fqn, name, kind, start, end, signature, docstring
Edge = tuple[str, str, str, float, int]  # source, target, type, confidence, line


def python_symbols(source: str) -> list[Symbol]:
    """Functions and classes of a module, and the methods of its classes."""
    lines = source.split("\n")
    tree = ast.parse(source)

    def one(node, prefix: str, kind: str) -> Symbol:
        return (prefix + node.name, node.name, kind, node.lineno, node.end_lineno or node.lineno, lines[node.lineno - 1].strip().rstrip(":"), ast.get_docstring(node) or "")

    out: list[Symbol] = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(one(node, "", "function"))
        elif isinstance(node, ast.ClassDef):
            out.append(one(node, "", "class"))
            out += [one(m, node.name + ".", "method") for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return out


def python_edges(source: str) -> list[Edge]:
    """Imports 1.0 (from the file itself), bases 0.8 by name and 0.7 by attribute, calls of plain names 0.5."""
    out: list[Edge] = []

    def walk(node, owner: str, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            name = owner
            if isinstance(child, ast.Import):
                out.extend(("", a.name, "IMPORTS", 1.0, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append(("", "." * child.level + (child.module or ""), "IMPORTS", 1.0, child.lineno))
            elif isinstance(child, ast.ClassDef):
                for b in child.bases:
                    if isinstance(b, ast.Name):
                        out.append((child.name, b.id, "INHERITS", 0.8, child.lineno))
                    elif isinstance(b, ast.Attribute):
                        out.append((child.name, b.attr, "INHERITS", 0.7, child.lineno))
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = prefix + child.name
            elif isinstance(child, ast.Call) and isinstance(child.func, ast.Name) and owner:
                out.append((owner, child.func.id, "CALLS", 0.5, child.lineno))
            walk(child, name, child.name + "." if isinstance(child, ast.ClassDef) else prefix)

    walk(ast.parse(source), "", "")
    return out


#: For other languages: patterns of (kind, name); fixed forms of their grammars.
_SYMBOLS = {
    "javascript": (("function", r"(?:async\s+)?function\s+(\w+)\s*\("), ("class", r"\bclass\s+(\w+)"), ("method", r"^\s+(?:async\s+|static\s+)?(?!if|for|while|switch|return|function|catch)(\w+)\s*\([^)]*\)\s*\{")),
    "go": (("function", r"^func\s+(\w+)\s*\("), ("method", r"^func\s+\([^)]*\)\s*(\w+)\s*\(")),
    "java": (("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("method", r"^\s+(?:public|private|protected|static|final|\s)*[\w<>\[\], ]+\s+(\w+)\s*\([^)]*\)\s*(?:throws [\w, ]+)?\{")),
    "c": (("function", r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*\)\s*\{"), ("struct", r"\bstruct\s+(\w+)\s*\{"), ("typedef", r"^typedef\s+[^;]*?\b(\w+)\s*;")),
}
_SYMBOLS["typescript"] = (*_SYMBOLS["javascript"], ("interface", r"\binterface\s+(\w+)"))
_EDGES = {
    "javascript": (("IMPORTS", 1.0, r"""(?:\bfrom\s+|require\(\s*|^import\s+)["']([^"']+)["']"""), ("INHERITS", 0.8, r"\bclass\s+\w+\s+extends\s+([\w.]+)")),
    "go": (("IMPORTS", 1.0, r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$'),),
    "java": (("IMPORTS", 1.0, r"^import\s+(?:static\s+)?([\w.*]+);"), ("INHERITS", 0.9, r"\bextends\s+(\w+)"), ("IMPLEMENTS", 0.9, r"\bimplements\s+(\w+)"), ("CALLS", 0.6, r"\bnew\s+(\w+)\s*\(")),
    "c": (("IMPORTS", 1.0, r'^#include\s+[<"]([^>"]+)[>"]'),),
}
_EDGES["typescript"] = (*_EDGES["javascript"], ("IMPLEMENTS", 0.9, r"\bimplements\s+(\w+)"))
_KEYWORDS = frozenset("if for while switch return catch function sizeof func new class".split())


def symbols_of(source: str, language: str) -> list[Symbol]:
    """First of each fqn; a method belongs to the class before it."""
    if language == "python":
        try:
            found = python_symbols(source)
        except SyntaxError:
            found = []
    else:
        found, owner = [], ""
        for i, line in enumerate(source.split("\n"), 1):
            for kind, pattern in _SYMBOLS.get(language, ()):
                if m := re.search(pattern, line):
                    name = m[1]
                    owner = name if kind in ("class", "interface") else owner
                    fqn = f"{owner}.{name}" if kind == "method" and owner and language != "go" else name
                    found.append((fqn, name, kind, i, i, line.strip().rstrip("{").strip(), ""))
                    break
    return list({s[0]: s for s in reversed(found)}.values())[::-1]


def edges_of(source: str, language: str) -> list[Edge]:
    if language == "python":
        try:
            return python_edges(source)
        except SyntaxError:
            return []
    starts = sorted((s[3], s[0]) for s in symbols_of(source, language) if s[2] in ("function", "method"))
    own = {s[1] for s in symbols_of(source, language)}
    out: list[Edge] = []
    for i, line in enumerate(source.split("\n"), 1):
        owner = next((name for at, name in reversed(starts) if at <= i), "")
        for kind, confidence, pattern in _EDGES.get(language, ()):
            out += [("" if kind == "IMPORTS" else owner, m, kind, confidence, i) for m in re.findall(pattern, line)]
        if owner and (i, owner) not in starts:
            out += [(owner, m, "CALLS", 0.5, i) for m in re.findall(r"\b(\w+)\s*\(", line) if m not in _KEYWORDS and (m in own or m.islower())]
    return out


def statements_of(sql: str) -> list[tuple[str, str, int, int, bool]]:
    """(type, text, first line, last line, is data): statements end at a line with `;` outside dollar quotes."""
    out, held, start, tag = [], [], 0, None

    def put(last: int) -> None:
        text = "\n".join(held)
        bare = re.sub(r"--[^\n]*", "", text).strip().upper()
        m = re.match(r"(CREATE|ALTER|DROP)(?:\s+OR\s+REPLACE)?(?:\s+(?:UNIQUE|TEMP|TEMPORARY|MATERIALIZED))*\s+(\w+)|(\w+)", bare)
        kind = "OTHER" if not m else f"{m[1]}_{m[2]}" if m[1] else m[3]
        out.append((kind, text, start, last, kind in ("INSERT", "COPY", "LOAD", "UPDATE", "DELETE")))
        held.clear()

    lines = sql.split("\n")
    for n, line in enumerate(lines, 1):
        bare = line.strip()
        if not held and (not bare or bare.startswith("--")):
            continue
        if not held:
            start = n
        held.append(line)
        for m in re.finditer(r"\$(\w*)\$", line):
            tag = m[1] if tag is None else None if m[1] == tag else tag
        if tag is None and ";" in line:
            put(n)
    if held:
        put(len(lines))
    return out


def group_statements(statements: list[tuple[str, str, int, int, bool]], chars: int = 5000, most: int = 50) -> list[list[int]]:
    """Neighbours together, up to so many characters and statements, never schema with data."""
    groups: list[list[int]] = []
    size = 0
    for i, s in enumerate(statements):
        if not groups or size + len(s[1]) > chars or len(groups[-1]) >= most or statements[groups[-1][-1]][4] != s[4]:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += len(s[1])
    return groups


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts between marks outside parentheses and quotes."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == mark and not depth:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


def _inside(text: str, at: int) -> str:
    depth = 0
    for i in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if depth == 0:
            return text[at + 1 : i]
    return text[at + 1 :]


def parse_ddl(statement: str) -> tuple[str, str, list[dict]] | None:
    """(kind, name, columns or parameters) of CREATE TABLE, FUNCTION, PROCEDURE or TRIGGER."""
    name = r"([\w.\"`\[\]]+)"
    if m := re.match(rf"\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{name}\s*\(", statement, re.I):
        columns = []
        for item in split_top(_inside(statement, m.end() - 1)):
            if re.match(r"(PRIMARY|FOREIGN|UNIQUE|CHECK|CONSTRAINT|EXCLUDE|KEY|INDEX)\b", item, re.I):
                continue
            column, _, rest = item.partition(" ")
            type_ = re.match(r"\s*([\w]+(?:\s*\([^)]*\))?(?:\[\])?)", rest)
            fk = re.search(rf"REFERENCES\s+{name}\s*(?:\(\s*(\w+)\s*\))?", rest, re.I)
            key = bool(re.search(r"PRIMARY\s+KEY", rest, re.I))
            columns.append({"name": column.strip('"`[]'), "type": type_[1] if type_ else "", "nullable": not key and not re.search(r"NOT\s+NULL", rest, re.I), "fk": f"{fk[1]}.{fk[2] or ''}".rstrip(".") if fk else None})
        return "table", m[1].strip('"`[]'), columns
    if m := re.match(rf"\s*CREATE\s+(?:OR\s+REPLACE\s+)?(FUNCTION|PROCEDURE)\s+{name}\s*", statement, re.I):
        parts = split_top(_inside(statement, m.end())) if statement[m.end() : m.end() + 1] == "(" else []
        parameters = []
        for p in parts:
            q = re.match(r"(?:(INOUT|IN|OUT|VARIADIC)\s+)?(\w+)\s+(.+?)(?:\s+(?:DEFAULT|:?=)\s*(.+))?$", p, re.I | re.S)
            if q:
                parameters.append({"name": q[2], "type": q[3].strip(), "nullable": True, "fk": None})
        return m[1].lower(), m[2], parameters
    if m := re.match(rf"\s*CREATE\s+(?:OR\s+REPLACE\s+)?TRIGGER\s+{name}", statement, re.I):
        timing = re.search(r"\b(BEFORE|AFTER|INSTEAD\s+OF)\b", statement, re.I)
        events = [e for e in ("INSERT", "UPDATE", "DELETE", "TRUNCATE") if re.search(rf"\b{e}\b", statement, re.I)]
        return "trigger", m[1], [{"name": e, "type": timing[1].upper() if timing else "", "nullable": True, "fk": None} for e in events]
    return None


@dataclass(frozen=True)
class Sizes:
    """Sizes of chunks in characters."""

    target: int = 1500
    most: int = 2000
    least: int = 200
    overlap: int = 150

    @classmethod
    def for_model(cls, tokens: int) -> Sizes:
        """Of an embedding model's context: 70 % of it as target, 10 % as the least and as overlap, four characters a token."""
        chars = tokens * 4
        return cls(chars * 7 // 10, chars, chars // 10, chars // 10)


def split_text(text: str, sizes: Sizes = Sizes()) -> list[str]:
    """Chunks that end at a paragraph, a sentence or a line near the target, each beginning `overlap` before the last's end."""
    if len(text) <= sizes.most:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = min(at + sizes.target, len(text))
        if end < len(text):
            for mark, kept in (("\n\n", 2), (". ", 1), ("\n", 1)):
                low, high = max(at, end - 500), min(len(text), at + sizes.most, end + 500)
                found = text.rfind(mark, low, end)
                found = found if found >= 0 else text.find(mark, end, high)
                if found >= 0 and found + kept - at > sizes.least:
                    end = found + kept
                    break
        if chunk := text[at:end].strip():
            out.append(chunk)
        if end >= len(text):
            break
        at = end - sizes.overlap if end - sizes.overlap > at else end
    return out


def explode_with(docs: DataFrame, f, columns: str, key: str = "id", inputs: tuple[str, ...] = ("content",)) -> DataFrame:
    """key and a row for each tuple that f gives for a document's inputs."""
    names = [c.strip().split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(k, *r) for k, *x in zip(df[key], *(df[c] for c in inputs), strict=True) for r in f(*x)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return docs.select(key, *inputs).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, {columns}")
