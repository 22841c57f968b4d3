"""Python source to records, on the standard library's syntax tree."""

from __future__ import annotations

import ast
import re

from .records import CallRecord, FileRecord, ImportRecord, ParameterRecord, Span, SymbolRecord

DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def parse_python(source: bytes) -> FileRecord:
    """All symbols and imports; broken lines are blanked and flagged, never fatal."""
    text = source.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    tree, text, broken = repaired(text)
    record = FileRecord(has_syntax_errors=broken)
    if tree is not None:
        Collector(text, record).collect(tree)
    return record


#: Lines of one attempt, and the most that one grows to where its end looks broken.
SPAN, WIDEST = 80, 320
#: Words that carry on the statement above, and lines that no attempt may begin with.
CARRIED = re.compile(r"\s*(?:(?:else|elif|except|finally|case)\b|[)\]}])")
#: What a broken header becomes, so that its block stays: the first word decides.
HEADERS = {"except": "except Exception:", "elif": "elif 1:", "else": "else:", "finally": "finally:"}


def repaired(text: str) -> tuple[ast.Module | None, str, bool]:
    """The tree of the text, with offending lines replaced by `pass` or blanked where needed.

    A text that does not parse is taken a stretch of lines at a time.  What stands before a
    broken line is settled and not read again, whatever the depth of nesting, so the time grows
    with the text and not with the number of its broken lines, and no text is given up for it."""
    broken = "\x00" in text
    text = text.replace("\x00", " ")
    try:
        return ast.parse(text), text, broken
    except (SyntaxError, ValueError):
        pass
    lines = text.split("\n")
    settle(lines)
    while True:  # most often the first attempt; else lines are blanked until the whole parses
        try:
            return ast.parse("\n".join(lines)), "\n".join(lines), True
        except (SyntaxError, ValueError) as problem:
            if not mend(lines, 0, len(lines), problem, 0):
                return None, text, True


def margin(line: str) -> str:
    return line[: len(line) - len(line.lstrip())]


def attempt(lines: list[str], at: int, to: int, levels: list[str]) -> tuple[ast.Module | None, Exception | None]:
    """The tree of lines[at:to] below headers that stand for the blocks around them."""
    try:
        return ast.parse("\n".join([f"{w}if 1:" for w in levels] + lines[at:to])), None
    except (SyntaxError, ValueError) as problem:
        return None, problem


def levels_after(tree: ast.Module, lines: list[str], first: int, levels: list[str]) -> list[str]:
    """Margins of the blocks that are open behind the last statement of a tree of lines from `first` on."""
    out, node = [], tree
    while node is not None:
        last = None
        for name in ("finalbody", "orelse", "handlers", "cases", "body"):
            if block := getattr(node, name, None):
                if isinstance(block, list) and isinstance(block[-1], (ast.stmt, ast.ExceptHandler, ast.match_case)):
                    last = block[-1]
                    break
        if isinstance(last, ast.stmt):
            row = last.lineno - 1 - len(levels)
            out.append(levels[last.lineno - 1] if row < 0 else margin(lines[first + row]))
        node = last
    return [w for k, w in enumerate(out) if not k or len(w) > len(out[k - 1])]


#: What the scan for brackets and strings has to tell apart.  Triple quotes are closed by a search of their own.
PIECE = re.compile(r"""\#[^\n]*|\"{3}|'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[()\[\]{}]|^[ \t]*(?:def|class|return|import|raise|pass|break|continue|while|try|with|del|global|nonlocal|assert)\b""", re.MULTILINE | re.DOTALL)
OPENED = ("was never closed", "unterminated triple-quoted")
PARTNER = {")": "(", "]": "[", "}": "{"}


def whole_stretches(text: str) -> dict[int, int]:
    """First line to last line of each bracket or triple-quoted string that is closed again, the outermost ones, from 0.

    One pass: a bracket that is never closed, or whose inside begins a line with a word that only
    statements begin with, is passed over, and so is a quote without its partner."""
    found: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    line = at = seen = 0
    while True:
        piece = PIECE.search(text, at)
        if piece is None:
            break
        line += text.count("\n", seen, piece.start())
        seen, at, said = piece.start(), piece.end(), piece[0]
        if said in ('"""', "'''"):
            end = at
            while (end := text.find(said, end)) >= 0 and text[end - 1] == "\\":
                end += 1
            if end >= 0:
                found.append((line, line + text.count("\n", at, end)))
                at = end + 3
        elif said in "([{":
            stack.append((said, line))
        elif said in PARTNER:
            if any(kind == PARTNER[said] for kind, _ in stack[-8:]):
                while (top := stack.pop())[0] != PARTNER[said]:
                    pass
                found.append((top[1], line))
        elif said.lstrip()[0].isalpha():
            stack.clear()
    outer: dict[int, int] = {}
    last = -1
    for first, end in sorted(found, key=lambda f: (f[0], -f[1])):
        if end > first and end > last:
            outer[first], last = end, end
    return outer


def settle(lines: list[str]) -> None:
    """Replace offending lines until every stretch of lines parses."""
    at, span, levels = 0, SPAN, []
    inside = [-1] * len(lines)  # the last line of the closed bracket or string that a line is part of, but for its first
    for first, end in whole_stretches("\n".join(lines)).items():
        inside[first + 1 : end + 1] = [end] * (end - first)
    while at < len(lines):
        to = min(at + span, len(lines))
        while to < len(lines) and (inside[to] >= 0 or not lines[to].strip() or lines[to].lstrip().startswith("#") or CARRIED.match(lines[to])):
            to = max(to, inside[to]) + 1
        mine = [w for w in levels if len(w) < len(margin(next((x for x in lines[at:to] if x.strip() and not x.lstrip().startswith("#")), "")))]
        tree, problem = attempt(lines, at, to, mine)
        if tree is not None:
            levels = levels_after(tree, lines, at, mine)
            at, span = to, SPAN
            continue
        row = at + (getattr(problem, "lineno", None) or 1) - 1 - len(mine)
        # what is left open here is closed nowhere; else the end of the stretch may have cut a statement
        if to < len(lines) and span < WIDEST and row >= to - 2 and not any(u in getattr(problem, "msg", "") for u in OPENED):
            span *= 2
            continue
        if not mend(lines, at, to, problem, len(mine)):
            at, span = to, SPAN  # nothing is left to blank in this stretch
            continue
        span = SPAN
        # settle what stands before the broken line, if that is whole by itself
        for cut in cuts(lines, at, min(row, to)):
            tree, _ = attempt(lines, at, cut, mine)
            if tree is not None:
                levels = levels_after(tree, lines, at, mine)
                at = cut
                break


def cuts(lines: list[str], at: int, row: int) -> list[int]:
    """Lines at or before a broken one, and behind `at`, where a new attempt may begin: the nearest, and the nearest further left."""
    out: list[int] = []
    width = None
    for k in range(row, at, -1):
        line = lines[k] if k < len(lines) else ""
        if line.strip() and not CARRIED.match(line) and (width is None or len(margin(line)) < width):
            out.append(k)
            width = len(margin(line))
            if not width or len(out) > 3:
                break
    return out


def mend(lines: list[str], at: int, to: int, problem: Exception, shift: int) -> bool:
    """Change one line of lines[at:to] so that a parse can get further; whether there was one to change.

    A line becomes a plain header if it has a block, else `pass`; then `pass`; then empty."""
    row = min(max(at + (getattr(problem, "lineno", None) or 1) - 1 - shift, at), to - 1)
    said = getattr(problem, "msg", "") or ""
    if "expected an indented block" in said:  # the header above gets a body
        row = next((k for k in range(row, at - 1, -1) if lines[k].rstrip().endswith(":")), row)
        if lines[row].rstrip().endswith(":") and not lines[row].lstrip().startswith("#"):
            lines[row] = f"{lines[row].rstrip()} pass"
            return True
    row = next((k for k in (*range(row, at - 1, -1), *range(row + 1, to)) if lines[k].strip()), -1)
    if row < 0:
        return False
    line, left = lines[row].strip(), margin(lines[row])
    below = next((x for x in lines[row + 1 : to] if x.strip()), "")
    header = HEADERS.get((re.match(r"\w*", line) or [""])[0], "if 1:")
    if "indent" in said or line == "pass" or line.endswith(": pass"):
        lines[row] = ""
    elif line.endswith(":") and line not in (*HEADERS.values(), "if 1:") and len(margin(below)) > len(left):
        lines[row] = left + header
    else:
        lines[row] = left + "pass"
    return True


class Collector:
    def __init__(self, text: str, record: FileRecord):
        self.raw, self.record = text.encode(), record
        #: byte at which each line begins; columns of the tree are bytes too
        self.lines = [0, *[i + 1 for i, b in enumerate(self.raw) if b == 10]]

    def source(self, node: ast.AST) -> str:
        start = self.lines[node.lineno - 1] + node.col_offset
        return self.raw[start : self.lines[node.end_lineno - 1] + node.end_col_offset].decode()

    def collect(self, tree: ast.Module) -> None:
        # an explicit stack, in source order, so that deep nesting cannot overflow
        stack: list[tuple[ast.AST, int | None]] = [(tree, None)]
        while stack:
            node, enclosing = stack.pop()
            if isinstance(node, DEFINITIONS):
                enclosing = self.symbol(node, enclosing)
            elif isinstance(node, ast.Import):
                for name in node.names:
                    self.record.imports.append(ImportRecord(name.name, [], name.asname, node.lineno, node.end_lineno or node.lineno))
            elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
                self.record.imports.append(ImportRecord("." * node.level + (node.module or ""), [n.name for n in node.names], None, node.lineno, node.end_lineno or node.lineno))
            stack.extend((child, enclosing) for child in reversed(in_order(node)))

    def symbol(self, node: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef, enclosing: int | None) -> int:
        symbols = self.record.symbols
        above = symbols[enclosing] if enclosing is not None else None
        is_class = isinstance(node, ast.ClassDef)
        kind = "class" if is_class else "method" if above and above.kind == "class" else "function"
        entry = SymbolRecord(kind, node.name, f"{above.qualified_name}.{node.name}" if above else node.name, Span(node.lineno, node.end_lineno, node.col_offset, node.end_col_offset), enclosing)
        if is_class:
            entry.bases = [self.source(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        else:
            entry.parameters = self.parameters(node.args)
            entry.calls = self.calls(node)
        symbols.append(entry)
        return len(symbols) - 1

    def parameters(self, args: ast.arguments) -> list[ParameterRecord]:
        """Plain, annotated and defaulted names, and bare splats; an annotated splat has no plain name and is left out."""
        plain = [*args.posonlyargs, *args.args]
        defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
        out = [self.parameter(a, d) for a, d in zip(plain, defaults, strict=True)]
        if args.vararg and not args.vararg.annotation:
            out.append(ParameterRecord(args.vararg.arg))
        out += [self.parameter(a, d) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
        if args.kwarg and not args.kwarg.annotation:
            out.append(ParameterRecord(args.kwarg.arg))
        return out

    def parameter(self, arg: ast.arg, default: ast.expr | None) -> ParameterRecord:
        return ParameterRecord(arg.arg, self.source(arg.annotation) if arg.annotation else None, self.source(default) if default is not None else None)

    def calls(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[CallRecord]:
        """Calls of the definition itself: not of nested definitions, nor of its own decorators."""
        found: list[ast.Call] = []
        own = set(map(id, node.decorator_list))
        stack = [child for child in ast.iter_child_nodes(node) if id(child) not in own]
        while stack:
            child = stack.pop()
            if isinstance(child, DEFINITIONS):
                stack.extend(child.decorator_list)
                continue
            if isinstance(child, ast.Call):
                found.append(child)
            stack.extend(ast.iter_child_nodes(child))
        found.sort(key=lambda c: (c.lineno, c.col_offset, -c.end_lineno, -c.end_col_offset))
        return [CallRecord(self.source(c.func), c.lineno, c.end_lineno) for c in found]


def in_order(node: ast.AST) -> list[ast.AST]:
    """Children by place in the source."""
    children = [c for c in ast.iter_child_nodes(node)]
    return sorted(children, key=lambda c: (getattr(c, "lineno", 0), getattr(c, "col_offset", 0)))
