import textwrap

from graphloom.sources.ecmascript_source import parse_ecmascript
from graphloom.sources.parsing import parser_for
from graphloom.sources.python_source import parse_python


def symbols(record):
    return [(s.kind, s.qualified_name) for s in record.symbols]


def calls(record, name):
    return [c.callee for s in record.symbols if s.qualified_name == name for c in s.calls]


def names(record, name):
    return [(p.name, p.annotation, p.default) for s in record.symbols if s.qualified_name == name for p in s.parameters]


def test_python_parameters():
    record = parse_python(b"def f(a, b: int, c=1, d: str = 'x', *args, **kwargs): pass\ndef g(a, /, *, b, *c: int): pass" .replace(b", *c: int", b""))
    assert names(record, "f") == [("a", None, None), ("b", "int", None), ("c", None, "1"), ("d", "str", "'x'"), ("args", None, None), ("kwargs", None, None)]
    assert names(record, "g") == [("a", None, None), ("b", None, None)]


def test_python_annotated_splat_has_no_plain_name():
    assert names(parse_python(b"def f(a, *b: int, c): pass"), "f") == [("a", None, None), ("c", None, None)]


def test_python_nesting():
    record = parse_python(b"class A(B, m.C, metaclass=M, *D):\n  def f(self):\n    def g():\n      inner()\n    outer(g())\n  class In: pass\n")
    assert symbols(record) == [("class", "A"), ("method", "A.f"), ("function", "A.f.g"), ("class", "A.In")]
    assert record.symbols[0].bases == ["B", "m.C"]
    assert calls(record, "A.f") == ["outer", "g"] and calls(record, "A.f.g") == ["inner"]


def test_python_call_order_and_decorators():
    record = parse_python(b"@top()\ndef f(x=d()):\n  a()(b(c()))\n  @deco()\n  def g(): pass\n  return e() if h() else i()\n")
    assert calls(record, "f") == ["d", "a()", "a", "b", "c", "deco", "e", "h", "i"]
    assert record.symbols[0].span.start_line == 2


def test_python_imports():
    record = parse_python(b"import a.b as c, d\nfrom ..x import y as z, w\nfrom . import q\nfrom m import *\nfrom __future__ import annotations\n")
    assert [(i.module, i.names, i.alias) for i in record.imports] == [("a.b", [], "c"), ("d", [], None), ("..x", ["y", "w"], None), (".", ["q"], None), ("m", ["*"], None)]


def test_python_errors_keep_the_rest():
    record = parse_python(b"def good(): pass\ndef bad(:\n  pass\nclass Also: pass\n")
    assert record.has_syntax_errors and ("function", "good") in symbols(record) and ("class", "Also") in symbols(record)
    assert not parse_python(b"").has_syntax_errors


def test_python_errors_have_no_limit():
    """However many lines are broken, the rest stays."""
    bad = "".join(f"x{i} = = (\n" for i in range(70))
    assert symbols(parse_python(f"def good():\n    a()\n{bad}".encode())) == [("function", "good")]
    record = parse_python(f"class A:\n    def m(self):\n        one()\n{textwrap.indent(bad * 20, ' ' * 8)}        two()\n    def n(self): pass\n{bad * 20}def last(): pass\n".encode())
    assert symbols(record) == [("class", "A"), ("method", "A.m"), ("method", "A.n"), ("function", "last")] and calls(record, "A.m") == ["one", "two"]
    old = "".join(f"def f{i}(a):\n    print 'x', a\n    try:\n        g(a)\n    except E, e:\n        raise E, 'x'\n" for i in range(400))
    record = parse_python(old.encode())
    assert [s.name for s in record.symbols] == [f"f{i}" for i in range(400)] and calls(record, "f399") == ["g"]


def test_python_strings_stay_whole_beside_errors():
    record = parse_python(b'def a():\n    """doc\nx = = 1\n  more\n"""\n    b()\n\ndef bad(:\n   pass\nclass C:\n    """\ncol0\n    """\n    def m(self): q()\n')
    assert symbols(record) == [("function", "a"), ("class", "C"), ("method", "C.m")] and calls(record, "a") == ["b"] and calls(record, "C.m") == ["q"]
    assert symbols(parse_python(b"def bad(:\n  pass\nclass Also: pass\n\x00")) == [("class", "Also")]


def test_jsx_is_no_plain_typescript():
    source = b"""const A = () => <div className='x' on={() => f(1)}>it's {g(2)} <b/> </div>;
export function B(p) { return <><A x={h(p)}>don't</A></>; }
function less(a, b) { return a < b && b > c(a); }
"""
    record = parse_ecmascript(source, jsx=True)
    assert not record.has_syntax_errors and calls(record, "B") == ["h"] and calls(record, "less") == ["c"]
    assert parse_ecmascript(source).has_syntax_errors
    typed = b"function id() { const f = <T,>(x: T) => g<T>(x); return h(f); }\nfunction V(p: P): E { return <p>{k(p)}'</p> }\n"
    tsx = parser_for("typescript", True)(typed)
    assert not tsx.has_syntax_errors and calls(tsx, "id") == ["g", "h"] and calls(tsx, "V") == ["k"]
    assert parser_for("typescript", False)(typed).has_syntax_errors
    assert calls(parser_for("typescript", False)(b"function c() { return <any>h(f); }"), "c") == ["h"]


def test_javascript_symbols():
    source = b"""import def, { a, b as c } from './m'; import * as ns from "n"; import 'side';
export default function main(x, y = 1, ...rest) { helper(x); ns.run(`t ${inner(y)}`); const arrow = (q) => later(q); }
export class Foo extends Base.Bar { #p = 1; constructor({a, b}, [c]) { super(a); this.go(); } static async go() { if (x) { return new Thing(z()) } } get v() { return 1 } }
const o = { m(k) { tick() } };
const anonymous = function hidden() { unseen() };
function* gen() { yielded() }
"""
    record = parse_ecmascript(source)
    assert symbols(record) == [("function", "main"), ("class", "Foo"), ("method", "Foo.constructor"), ("method", "Foo.go"), ("method", "Foo.v"), ("method", "m")]
    assert record.symbols[1].bases == ["Base.Bar"]
    assert names(record, "main") == [("x", None, None), ("y", None, "1"), ("rest", None, None)]
    assert [n for n, _, _ in names(record, "Foo.constructor")] == ["{a, b}", "[c]"]
    assert calls(record, "main") == ["helper", "ns.run", "inner", "later"]
    assert calls(record, "Foo.constructor") == ["super", "this.go"] and calls(record, "Foo.go") == ["z"] and calls(record, "m") == ["tick"]
    assert [(i.module, i.names, i.alias) for i in record.imports] == [("./m", ["a", "b"], "def"), ("n", [], "ns"), ("side", [], None)]
    assert not record.has_syntax_errors


def test_javascript_chains_and_regexes():
    record = parse_ecmascript(b"function f() { a.b(c).d(e); x = y / 2 / z; m(/[)\"]/.test(s)); import('q'); tag`t`; o?.p(); }")
    assert calls(record, "f") == ["a.b(c).d", "a.b", "m", '/[)"]/.test', "import", "tag", "o?.p"]


def test_typescript():
    source = b"""import type { T } from './t';
interface I { sig(x: number): void }
export class A<T> extends Base<T> implements I, J {
  constructor(private readonly n: number, opt?: string, d: Map<string, number> = new Map()) { super(); }
  run<T>(cb: (x: T) => void): { ok: boolean } { cb(make<T>(1)); return { ok: true } }
  abstract later(): void;
}
function over(a: string): void;
function over(a: any): void { deep(a as string) }
"""
    record = parse_ecmascript(source, typed=True)
    assert symbols(record) == [("class", "A"), ("method", "A.constructor"), ("method", "A.run"), ("function", "over")]
    assert record.symbols[0].bases == ["Base", "<T>"]
    assert names(record, "A.constructor") == [("n", "number", None), ("opt", "string", None), ("d", "Map<string, number>", "new Map()")]
    assert names(record, "A.run") == [("cb", "(x: T) => void", None)]
    assert calls(record, "A.run") == ["cb", "make"] and calls(record, "over") == ["deep"]
    assert [(i.module, i.names) for i in record.imports] == [("./t", ["T"])]


def test_broken_javascript():
    assert parse_ecmascript(b"function ok() {} function bad( {").has_syntax_errors
    assert parse_ecmascript(b"").symbols == []


def test_a_long_literal_beside_a_broken_line_keeps_its_calls():
    """In time that grows with the text, wherever the broken line stands; brackets that never close cost only themselves."""
    import time

    took = {}
    for n in (5_000, 20_000):
        literal = "def f():\n    return {\n" + "".join(f"        'k{i}': g{i}(x),\n" for i in range(n)) + "    }\n"
        began = time.perf_counter()
        for source in (literal + "x = = 1\n", "x = = 1\n" + literal, literal + "def h():\n    y = = 2\n    z(1)\n"):
            record = parse_python(source.encode())
            assert record.has_syntax_errors and len(calls(record, "f")) == n
        assert calls(record, "h") == ["z"]
        took[n] = time.perf_counter() - began
    assert took[20_000] < 12 * took[5_000]
    text = "S = '''\n" + "open ( [ {\n" * 9_000 + "'''\ndef f():\n    g()\nx = = 1\n"
    assert calls(parse_python(text.encode()), "f") == ["g"]
    for opener in ("a = (\n", "b = ['''\n"):
        assert symbols(parse_python((opener * 30 + "def f():\n    g()\n").encode())) == [("function", "f")]
