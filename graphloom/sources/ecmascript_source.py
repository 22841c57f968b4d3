"""JavaScript, TypeScript and TSX source to records, with a tokenizer of our own.

Only what the tables need is understood: declarations of functions and classes,
methods, their parameters and calls, `extends`, and import statements.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from .records import CallRecord, FileRecord, ImportRecord, ParameterRecord, Span, SymbolRecord

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
      |(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
      |(?P<name>\#?[^\W\d][\w$]*|\#?\$[\w$]*)
      |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
      |(?P<sign>\?\.(?!\d)|\.\.\.|=>|[{}()\[\];,.<>:?!=+\-*/%&|^~@`\\\#"'])""",
    re.X | re.S,
)
#: How a JSX element or fragment begins; `<T,` and `<T extends` begin type parameters.
ELEMENT = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/>])(?!\s+extends\b)(?!\s*,))")
STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
#: Words after which a slash begins a regular expression and a parenthesis is no call.
OPERATOR_WORDS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "instanceof", "yield", "await", "extends", "default"}
HEADS = {"if", "for", "while", "switch", "catch", "with"}
NOT_CALLED = OPERATOR_WORDS | HEADS | {"function", "class", "var", "let", "const", "import", "export", "async", "get", "set", "static"} - {"async", "get", "set", "static", "import"}
MODIFIERS = {"public", "private", "protected", "readonly", "override", "static", "async", "get", "set", "abstract", "declare", "accessor"}
CLOSERS = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Token:
    kind: str  # name, number, string, template, regex, sign
    text: str
    start: int
    end: int
    pair: int = -1  # index of the matching bracket


def tokenize(text: str, jsx: bool = False) -> tuple[list[Token], bool]:
    """Tokens with matched brackets, and whether everything fitted.

    jsx: elements are literals, whose {...} parts count as code."""
    tokens: list[Token] = []
    fine, at = True, 0
    while at < len(text):
        if jsx and text[at] == "<" and ELEMENT.match(text, at) and starts_regex(tokens):
            end, parts, closed = element(text, at)
            fine &= closed
            tokens.append(Token("string", text[at:end], at, end))
            for begin, stop in parts:
                inner, ok = tokenize(text[begin:stop], jsx)
                fine &= ok
                tokens += [Token(t.kind if t.kind != "template" else "inner", t.text, t.start + begin, t.end + begin) for t in inner]
            at = end
            continue
        if text[at] == "`":
            end, parts = template(text, at)
            tokens.append(Token("template", text[at:end], at, end))
            for begin, stop in parts:  # code inside ${...} counts as code
                inner, ok = tokenize(text[begin:stop], jsx)
                fine &= ok
                tokens += [Token(t.kind if t.kind != "template" else "inner", t.text, t.start + begin, t.end + begin) for t in inner]
            at = end
            continue
        if text[at] == "/" and starts_regex(tokens) and (found := REGEX.match(text, at)) and text[at : at + 2] not in ("//", "/*"):
            tokens.append(Token("regex", found[0], at, found.end()))
            at = found.end()
            continue
        found = TOKEN.match(text, at)
        if not found:
            fine, at = False, at + 1
            continue
        if found.lastgroup not in ("space", "comment"):
            tokens.append(Token(found.lastgroup, found[0], at, found.end()))
            fine &= found[0] not in ('"', "'", "\\")
        at = found.end()
    open_: list[int] = []
    for i, token in enumerate(tokens):
        if token.kind != "sign":
            continue
        if token.text in CLOSERS:
            open_.append(i)
        elif token.text in CLOSERS.values():
            if open_ and CLOSERS[tokens[open_[-1]].text] == token.text:
                j = open_.pop()
                tokens[i].pair, tokens[j].pair = j, i
            else:
                fine = False
    return tokens, fine and not open_


def starts_regex(tokens: list[Token]) -> bool:
    if not tokens:
        return True
    last = tokens[-1]
    if last.kind == "name":
        return last.text in OPERATOR_WORDS
    return last.kind == "sign" and last.text not in (")", "]", "}")


def braced(text: str, at: int) -> int:
    """Index behind the {...} that opens at `at`, or the text's length."""
    depth, i = 0, at
    while i < len(text):
        if text[i] == "`":
            i, _ = template(text, i)
            continue
        if text[i] in "\"'":
            quoted = STRING.match(text, i)
            i = quoted.end() if quoted else i + 1
            continue
        depth += (text[i] == "{") - (text[i] == "}")
        i += 1
        if not depth:
            break
    return i


def element(text: str, at: int) -> tuple[int, list[tuple[int, int]], bool]:
    """End of the JSX element or fragment at `at`, the code ranges inside it, and whether it is closed.

    Text between tags is no code; tags are counted, with a stack too small to matter."""
    parts: list[tuple[int, int]] = []
    depth, i = 0, at
    while i < len(text):
        if text[i] == "{":
            end = braced(text, i)
            parts.append((i + 1, end - 1))
            i = end
        elif text[i] != "<":
            i += 1
        else:
            closing = text.startswith("</", i)
            i += 1
            while i < len(text) and text[i] != ">":
                if text[i] == "{":
                    end = braced(text, i)
                    parts.append((i + 1, end - 1))
                    i = end
                elif text[i] in "\"'":
                    end = text.find(text[i], i + 1)
                    i = len(text) if end < 0 else end + 1
                else:
                    i += 1
            alone = text[i - 1 : i + 1] == "/>"
            depth += -1 if closing else 0 if alone else 1
            i += 1
            if depth <= 0:
                return min(i, len(text)), parts, i <= len(text)
    return len(text), parts, False


def template(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """End of the template literal at `at`, and the code ranges inside it."""
    i, parts = at + 1, []
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text[i] == "`":
            return i + 1, parts
        elif text.startswith("${", i):
            depth, j = 1, i + 2
            while j < len(text) and depth:
                if text[j] == "`":
                    j, _ = template(text, j)
                    continue
                depth += (text[j] == "{") - (text[j] == "}")
                j += 1
            parts.append((i + 2, j - 1))
            i = j
        else:
            i += 1
    return len(text), parts


class Reader:
    def __init__(self, source: bytes, typed: bool, jsx: bool):
        self.text = source.decode("utf-8", errors="replace")
        self.typed = typed
        self.tokens, fine = tokenize(self.text, jsx)
        self.record = FileRecord(has_syntax_errors=not fine)
        self.lines = [0] + [m.end() for m in re.finditer("\n", self.text)]
        self.scopes: list[tuple[int, int, int]] = []  # first token, last token, symbol
        self.members: dict[int, bool] = {}  # opening brace to whether its body holds members
        #: the innermost bracket group around each token, -1 at top level
        self.around: list[int] = []
        open_: list[int] = []
        for i, token in enumerate(self.tokens):
            if open_ and token.pair == open_[-1]:
                open_.pop()
            self.around.append(open_[-1] if open_ else -1)
            if token.pair > i:
                open_.append(i)

    # ---- helpers ----------------------------------------------------------------

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind in ("sign", "name") and self.tokens[i].text in texts

    def name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def after(self, i: int) -> int:
        """Index behind a bracket group, or behind the one token."""
        return self.tokens[i].pair + 1 if self.tokens[i].pair > i else i + 1

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def column(self, at: int) -> int:
        begin = self.lines[self.line(at) - 1]
        return len(self.text[begin:at].encode())

    def span(self, start: int, end: int) -> Span:
        return Span(self.line(start), self.line(end), self.column(start), self.column(end))

    def code(self, first: int, last: int) -> str:
        """Source of the tokens first..last (inclusive)."""
        return self.text[self.tokens[first].start : self.tokens[last].end] if first <= last else ""

    def statement_start(self, i: int) -> bool:
        """Whether a declaration may begin at token i."""
        if i == 0 or self.is_(i - 1, ";", "{", "}", "export", "default", "declare", "else", "do", ")"):
            return True
        before = self.tokens[i - 1]
        ended = before.kind != "sign" and not (before.kind == "name" and before.text in OPERATOR_WORDS) or before.text == "]"
        return ended and "\n" in self.text[before.end : self.tokens[i].start]

    def skip_type(self, i: int, stops: tuple[str, ...]) -> int:
        """First token at or after i that is one of stops, outside brackets and angle brackets."""
        depth = 0
        while i < len(self.tokens):
            if not depth and self.is_(i, *stops):
                return i
            if self.is_(i, "<"):
                depth += 1
            elif self.is_(i, ">"):
                depth = max(0, depth - 1)
            i = self.after(i) if self.is_(i, "(", "[", "{") and not (not depth and "{" in stops and self.is_(i, "{")) else i + 1
        return i

    def generics(self, i: int) -> int:
        """Index behind <...> at i, if it is there."""
        if not (self.typed and self.is_(i, "<")):
            return i
        depth = 0
        while i < len(self.tokens):
            depth += self.is_(i, "<") - self.is_(i, ">")
            i = self.after(i) if self.is_(i, "(", "[", "{") else i + 1
            if not depth:
                break
        return i

    def body(self, i: int) -> int:
        """Index of the { that opens a function's body after its parameters, or -1."""
        if self.typed and self.is_(i, ":"):
            i += 1
            while i < len(self.tokens) and not self.is_(i, ";"):
                stop = self.skip_type(i, ("{", ";", "}"))
                if not self.is_(stop, "{"):
                    return -1
                # an object type is followed by more type or by the body
                if self.is_(stop - 1, ":", "|", "&", "=>", "is", "keyof") and self.tokens[stop].pair > 0:
                    i = self.tokens[stop].pair + 1
                    continue
                return stop
            return -1
        return i if self.is_(i, "{") else -1

    # ---- symbols ----------------------------------------------------------------

    def read(self) -> FileRecord:
        i, depth_until = 0, []
        self.class_bodies: dict[int, int] = {}
        while i < len(self.tokens):
            while depth_until and i > depth_until[-1][0]:
                depth_until.pop()
            enclosing = depth_until[-1][1] if depth_until else None
            made = self.declaration(i, enclosing)
            if made:
                last, symbol, resume = made
                depth_until.append((last, symbol))
                i = resume
                continue
            if self.is_(i, "import"):
                self.imported(i)
            i += 1
        self.attach_calls()
        return self.record

    def declaration(self, i: int, enclosing: int | None) -> tuple[int, int, int] | None:
        """(last token, symbol, token to go on with) of a symbol that begins at token i."""
        if self.is_(i, "function") or (self.is_(i, "async") and self.is_(i + 1, "function")):
            head = i + self.is_(i, "async")
            if self.statement_start(i) and self.name(head + 1) and not self.is_(i - 1, "async"):
                opening = self.generics(head + 2)
                if self.is_(opening, "("):
                    brace = self.body(self.after(opening))
                    if brace >= 0 and self.tokens[brace].pair > 0:
                        return self.add("function", head + 1, i, self.tokens[brace].pair, opening, enclosing)
            return None
        if self.is_(i, "class") and self.statement_start(i) and self.name(i + 1) and not self.is_(i - 1, "abstract"):
            brace = self.skip_type(i + 2, ("{",))
            if brace < len(self.tokens) and self.tokens[brace].pair > 0:
                return self.add("class", i + 1, i, self.tokens[brace].pair, None, enclosing, brace)
            return None
        return self.method(i, enclosing)

    def method(self, i: int, enclosing: int | None) -> tuple[int, int, int] | None:
        """A method of a class body or an object literal: [modifiers] name(...) {...}."""
        if not (i and (self.is_(i - 1, "{", "}", ";", ",") or self.tokens[i - 1].kind != "sign" or self.is_(i - 1, ")", "]"))):
            return None
        k = i
        while (self.name(k) and self.tokens[k].text in MODIFIERS or self.is_(k, "*")) and not self.is_(k + 1, "(", "=", ";", ":", ","):
            k += 1
        if k >= len(self.tokens):
            return None
        if self.is_(k, "["):
            last = self.tokens[k].pair
            if last < 0:
                return None
        elif self.tokens[k].kind in ("name", "string", "number") and not (self.tokens[k].kind == "name" and self.tokens[k].text in HEADS | {"function", "return"} and not self.in_members(i)):
            last = k
        else:
            return None
        opening = self.generics(last + 1)
        if not self.is_(opening, "(") or not self.in_members(i):
            return None
        brace = self.body(self.after(opening))
        if brace < 0 or self.tokens[brace].pair < 0:
            return None
        return self.add("method", (k, last), i, self.tokens[brace].pair, opening, enclosing)

    def in_members(self, i: int) -> bool:
        """Whether token i stands directly in a class body or an object literal."""
        j = self.around[i]
        if not self.is_(j, "{"):
            return False
        if j not in self.members:
            literal = self.is_(j - 1, "(", ",", "=", ":", "[", "return", "?", "&", "|", "default")
            self.members[j] = literal or self.class_brace(j)
        return self.members[j]

    def class_brace(self, j: int) -> bool:
        """Whether the { at token j opens a class body: `class` stands before it in the same statement."""
        k, angle = j - 1, 0
        while k >= 0:
            if self.is_(k, "class"):
                return not self.is_(k - 1, ".")
            if self.is_(k, ")", "]") or (self.is_(k, "}") and self.is_(k + 1, ",", ">", "|", "&")):
                if self.tokens[k].pair < 0:
                    return False
                k = self.tokens[k].pair - 1
                continue
            if self.is_(k, ";", "{", "}", "(", "=", "=>"):
                return False
            k -= 1
        return False

    def add(self, kind: str, name: int | tuple[int, int], first: int, last: int, opening: int | None, enclosing: int | None, brace: int | None = None) -> tuple[int, int, int]:
        low, high = name if isinstance(name, tuple) else (name, name)
        label = self.code(low, high)
        above = self.record.symbols[enclosing] if enclosing is not None else None
        if kind == "function" and above is not None and above.kind == "class":
            kind = "method"
        entry = SymbolRecord(kind, label, f"{above.qualified_name}.{label}" if above else label, self.span(self.tokens[first].start, self.tokens[last].end), enclosing)
        if kind == "class":
            entry.bases = self.bases(high + 1, brace)
            resume = brace
        else:
            entry.parameters = self.parameters(opening)
            resume = opening
        self.record.symbols.append(entry)
        self.scopes.append((first, last, len(self.record.symbols) - 1))
        return last, len(self.record.symbols) - 1, resume + 1 if kind == "class" else resume

    def bases(self, i: int, brace: int) -> list[str]:
        i = self.generics(i)
        if not self.is_(i, "extends"):
            return [self.code(i, brace - 1)] if self.typed and self.is_(i, "implements") else []
        end = next((k for k in range(i + 1, brace) if self.is_(k, "implements")), brace)
        if not self.typed:
            return [self.code(i + 1, end - 1)]
        angle = next((k for k in range(i + 1, end) if self.is_(k, "<")), end)
        return [t for t in (self.code(i + 1, angle - 1), self.code(angle, end - 1)) if t]

    def parameters(self, opening: int) -> list[ParameterRecord]:
        close = self.tokens[opening].pair
        out, first, i, angle = [], opening + 1, opening + 1, 0
        while i <= close:
            if i == close or (self.is_(i, ",") and not angle):
                if first < i:
                    made = self.parameter(first, i - 1)
                    if made:
                        out.append(made)
                first = i + 1
                i += 1
                continue
            if self.typed and self.is_(i, "<"):
                angle += 1
            elif self.typed and self.is_(i, ">") and angle:
                angle -= 1
            i = self.after(i)
        return out

    def parameter(self, first: int, last: int) -> ParameterRecord | None:
        while self.is_(first, "@"):  # a decorator and its arguments
            first += 2
            first = self.after(first) if self.is_(first, "(") else first
        while self.typed and first < last and self.name(first) and self.tokens[first].text in MODIFIERS and (self.name(first + 1) or self.is_(first + 1, "{", "[")):
            first += 1
        rest = self.is_(first, "...")
        at = first + rest
        if at > last:
            return None
        if self.is_(at, "{", "["):
            label, end = self.code(at, self.tokens[at].pair), self.tokens[at].pair
            if rest:
                return None
        elif self.name(at) and self.tokens[at].text != "this":
            label, end = self.tokens[at].text, at
        else:
            return None
        at = end + 1
        annotation = default = None
        if self.typed and self.is_(at, "?"):
            at += 1
        if self.typed and self.is_(at, ":"):
            stop = self.equals(at + 1, last)
            annotation = self.code(at + 1, stop - 1) or None
            at = stop
        if at <= last and self.is_(at, "="):
            if rest and not self.typed:
                return None
            default = self.code(at + 1, last) or None
        return ParameterRecord(label, annotation, default)

    def equals(self, i: int, last: int) -> int:
        """First = outside brackets in i..last, else last + 1 (arrows are tokens of their own)."""
        while i <= last:
            if self.is_(i, "="):
                return i
            i = self.after(i)
        return last + 1

    # ---- calls ------------------------------------------------------------------

    def attach_calls(self) -> None:
        """Give every call to the innermost symbol around it, unless that is a class."""
        calls = []
        for i in range(1, len(self.tokens)):
            found = self.call_at(i)
            if found:
                calls.append(found)
        calls.sort(key=lambda c: c[3])
        waiting = sorted(self.scopes, key=lambda s: (s[0], -s[1]), reverse=True)
        inside: list[tuple[int, int, int]] = []
        owned = []
        for start, end, callee, token in calls:
            while waiting and waiting[-1][0] <= token:
                inside.append(waiting.pop())
            while inside and inside[-1][1] < token:
                inside.pop()
            if inside and self.record.symbols[inside[-1][2]].kind != "class":
                owned.append((start, -end, callee, inside[-1][2]))
        for start, end, callee, owner in sorted(owned):
            self.record.symbols[owner].calls.append(CallRecord(callee, self.line(start), self.line(-end)))

    def call_at(self, i: int) -> tuple[int, int, str, int] | None:
        """(start, end, callee, token) if token i opens a call's arguments or is a tagged template."""
        tagged = self.tokens[i].kind == "template"
        if not tagged and not (self.is_(i, "(") and self.tokens[i].pair > 0):
            return None
        last = i - 1
        if self.is_(last, "?."):
            last -= 1
        if self.typed and self.is_(last, ">") and (back := self.type_arguments(last)) >= 0:
            last = back
        before = self.tokens[last]
        if before.kind == "name":
            if before.text in NOT_CALLED and not self.is_(last - 1, ".", "?."):
                return None
        elif not self.is_(last, ")", "]") and before.kind != "template":
            return None
        if self.is_(last, ")"):
            head = self.tokens[last].pair - 1
            if self.is_(head, *HEADS) and not self.is_(head - 1, "."):
                return None
        if i in self.heads:
            return None
        if tagged and "\n" in self.text[before.end : self.tokens[i].start]:
            return None
        first = self.chain_start(last)
        if first is None or self.is_(first - 1, "function", "class"):
            return None
        if self.is_(first - 1, "*") and self.is_(first - 2, "function"):
            return None
        if self.is_(first - 1, "new"):
            if first == last or not self.has_arguments(first, last):
                return None  # the arguments of `new` itself
            first -= 1
        end = self.tokens[i].end if tagged else self.tokens[self.tokens[i].pair].end
        return self.tokens[first].start, end, self.code(first, last), i

    @property
    def heads(self) -> set[int]:
        """Tokens that open the parameters of a symbol, a signature or a function expression."""
        if not hasattr(self, "_heads"):
            self._heads: set[int] = set()
            for first, last, symbol in self.scopes:
                if self.record.symbols[symbol].kind != "class":
                    k = first
                    while k < last and not self.is_(k, "("):
                        k = self.after(k) if self.is_(k, "[") else k + 1
                    self._heads.add(k)
            for i, token in enumerate(self.tokens):
                if token.kind == "sign" and token.text == "(" and token.pair > 0:
                    if self.typed and self.name(i - 1) and self.in_signature(i):
                        self._heads.add(i)
        return self._heads

    def in_signature(self, i: int) -> bool:
        """Whether ( belongs to a body-less method signature of a class or an interface, or an overload."""
        if self.is_(i - 2, "function") and not self.is_(self.after(i), "{"):
            return True
        follows = self.after(i)
        return self.is_(follows, ":") and self.is_(i - 2, "{", ";", "}") and self.in_members_or_interface(i - 1)

    def in_members_or_interface(self, i: int) -> bool:
        k = self.around[i] - 1
        while k >= 0 and not self.is_(k, ";", "{", "}"):
            if self.is_(k, "interface", "class", "type"):
                return True
            k -= 1
        return False

    def type_arguments(self, last: int) -> int:
        """Token before <...> that ends at last, or -1 if that is no type argument list."""
        depth, k = 0, last
        while k > 0:
            depth += self.is_(k, ">") - self.is_(k, "<")
            if not depth:
                return k - 1 if self.name(k - 1) else -1
            if self.is_(k, ";", "{", "}", "=", "&&") and not self.is_(k, "}"):
                return -1
            k -= 1
        return -1

    def chain_start(self, last: int) -> int | None:
        """First token of the member chain that ends at token last."""
        k = last
        while True:
            token = self.tokens[k]
            if self.is_(k, ")", "]"):
                if token.pair < 0:
                    return None
                k = token.pair
                if self.is_(k, "(") and not (self.name(k - 1) and self.tokens[k - 1].text not in NOT_CALLED or self.is_(k - 1, ")", "]", "?.") or (self.typed and self.is_(k - 1, ">"))):
                    return k  # a parenthesised expression
                if self.is_(k, "[") and not (self.name(k - 1) and self.tokens[k - 1].text not in NOT_CALLED or self.is_(k - 1, ")", "]", "?.") or self.tokens[k - 1].kind in ("template", "string")):
                    return k  # an array literal
                k -= 1
                if self.is_(k, "?."):
                    k -= 1
                if self.typed and self.is_(k, ">"):
                    back = self.type_arguments(k)
                    if back < 0:
                        return k + 1
                    k = back
                continue
            if token.kind in ("name", "string", "template", "number", "regex"):
                if self.is_(k - 1, ".", "?."):
                    k -= 2
                    if self.is_(k, "!"):
                        k -= 1
                    continue
                return k
            if self.is_(k, "!") and self.typed:
                k -= 1
                continue
            return k + 1

    def has_arguments(self, first: int, last: int) -> bool:
        """Whether the chain first..last holds an argument list, which then belongs to `new`."""
        return any(self.is_(k, "(") for k in range(first + 1, last + 1))

    # ---- imports ----------------------------------------------------------------

    def imported(self, i: int) -> None:
        if self.is_(i - 1, ".") or self.is_(i + 1, "(", "."):
            return
        k, alias, names = i + 1, None, []
        if self.is_(k, "type", "typeof") and (self.is_(k + 1, "{", "*") or self.name(k + 1) and not self.is_(k + 1, "from")):
            k += 1
        if k < len(self.tokens) and self.tokens[k].kind != "string":
            while k < len(self.tokens) and not self.is_(k, "from"):
                if self.is_(k, "=", ";"):
                    return
                if self.is_(k, "*") and self.is_(k + 1, "as"):
                    alias, k = self.tokens[k + 2].text, k + 3
                elif self.is_(k, "{"):
                    names += self.specifiers(k)
                    k = self.after(k)
                elif self.name(k):
                    alias, k = self.tokens[k].text, k + 1
                else:
                    k += 1
            k += 1
        if k < len(self.tokens) and self.tokens[k].kind == "string":
            end = k + 1 if self.is_(k + 1, ";") else k
            self.record.imports.append(ImportRecord(self.tokens[k].text.strip("\"'"), names, alias, self.line(self.tokens[i].start), self.line(self.tokens[end].start)))

    def specifiers(self, opening: int) -> list[str]:
        names, fresh = [], True
        for k in range(opening + 1, self.tokens[opening].pair):
            if self.is_(k, ","):
                fresh = True
            elif fresh and self.is_(k, "type") and self.tokens[k + 1].kind in ("name", "string") and not self.is_(k + 1, "as", ","):
                continue
            elif fresh:
                names.append(self.tokens[k].text)
                fresh = False
        return names


def parse_ecmascript(source: bytes, typed: bool = False, jsx: bool = False) -> FileRecord:
    """typed: TypeScript.  jsx: elements may stand where an expression begins."""
    return Reader(source, typed, jsx).read()
