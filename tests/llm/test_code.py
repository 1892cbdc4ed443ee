from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strataforge.llm import handwritten, parsecheck, syntax

VALID = {
    "python": ["", "x = 1\n", "def f(a, /, b=1, *c, d, **e) -> int:\n    return a if b else [*c]\n", "match x:\n    case [1, *_] if y: pass\n    case {'a': b}: pass\n", "async def f():\n    async with a as b, c: pass\n    return [x async for x in y]\n", "@d\nclass A(B, m=C):\n    x: int = 1\n", "print(f'{x!r:>{w}}', end='')\n", "lambda *a, **k: (yield)\n", "if (n := 10) > 5: pass\n", "try:\n    pass\nexcept* E as e:\n    pass\n", "x = {**a, 'b': 1}; y = a[1:2, ::3]\n"],
    "javascript": ["", "const {a, b: [c = 1], ...d} = require('x');", "export default async function* f() { yield* g(); }", "a?.b?.[c] ?? d ** e;", "for (const [k, v] of Object.entries(x)) continue;", "const r = /[(]{2}\\}/g, s = '/* open';", "label: for (;;) { break label }", "class A extends B { static #x = 1; get y() { return this.#x } static { } async *z() {} }", "x = `a ${b + `c ${d}`} e`", "if (a) b\nelse c", "const f = async ({a}, [b]) => ({a, b});", "!function(s){s.a=s.b||[];var o=8;s.q=o>>2}(globalThis);", "import x, {y as z} from 'm'; export {z as default};", "var {a = 1} = b; ({a = 1} = b);", "var yield_ = 1, of = 2, get = 3; async = 1;", "a\n++b"],
    "typescript": ["interface A<T extends B = C> extends D { readonly x?: string; [k: string]: unknown; f(n: number): void; new (x: any): A }", "type M = { [K in keyof T]?: T[K] extends (infer U)[] ? U : never };", "export class A<T> implements B<T> { private readonly m: Map<string, number> = new Map(); constructor(private x: string[]) {} f(k: string): number { return this.m.get(k) ?? this.x.length + 1; } }", "const f: (a: number) => string = (a) => `${a * 2}-x`;", "enum E { A = 'x', B }", "declare module 'x' { export const a: number }", "function f<T extends { s: number }>(a: T[], b: number = 1): T[] { return a as unknown as T[]; }", "abstract class A { abstract f(): void; protected g?(): asserts x is string }", "export type X = Record<string, K | null>;", "let a = <T,>(x: T): x is T => true; let b = y!; const c = z satisfies W;", "function f(): void;\nfunction f(x?: number) {}", "namespace N.M { export namespace O {} }", "import type { A } from './a';"],
    "c": ["", "#include <stdio.h>\nint main(void) { printf(\"%d\\n\", 1); return 0; }", "typedef struct { int a : 3; struct { int b; }; } t; static t x = { .a = 1, .b = 2 };", "int f(a, b) int a; char *b; { return a; }", "#if 0\nnot c at all {\n#else\nint x;\n#endif", "int (*fp[3])(int, char *) = { 0 }; _Static_assert(sizeof(int) == 4, \"x\");", "void g(void) { goto end; end: ; for (int i = 0; i < 3; i++) { switch (i) { case 1: break; default: continue; } } }", "unsigned h(unsigned s) { do { s = s * 39u + 8u; } while (s % 7u == 0u); return s; }", "#define API\nAPI int k(const char *in) { return in[0] == '}' ? '_' : in[0]; }", "int a = _Generic(1, int: 2, default: 3), *p = (int[]){1, 2};", "enum e { A, B = 2, };", "size_t n; foo *p; int m = (size_t)n * sizeof *p;"],
    "cpp": ["", "#include <vector>\ntemplate <typename T>\nT f(const std::vector<T>& v, T limit) { T total{}; for (const auto& x : v) { if (x < limit) total += x; } return total; }", "namespace a::b { inline auto g = [](int x) { return x * 4 + 7; }; }", "class A { public: explicit A(std::string n) : n_(std::move(n)) {} std::size_t s() const { return n_.size() + 1; } virtual ~A() = default; private: std::string n_; };", "enum class E : int { a = 1, b = 2 };\nstatic std::string h(E k) { return static_cast<int>(k) == 1 ? \"x\" : \"y\"; }", "template <int N> struct Tag {};\ntemplate <> struct Tag<1> { static constexpr int id = 7; };", "auto s = R\"x(a \" )\" b)x\"; int n = 1'000'000;", "template <class... T> auto sum(T... t) { return (t + ... + 0); }", "int main() { auto [a, b] = f(); if (auto it = m.find(1); it != m.end()) { delete it; } try { throw 1; } catch (...) {} }", "struct B { B operator+(const B& o) const; operator bool() const; template <class T> T get() &&; friend class C; };", "std::map<int, std::vector<int>> m; using V = std::vector<int>; V::iterator it;"],
}
INVALID = {
    "python": ["def f(:\n  pass\n", "x = (1\n", "if x:\npass\n", "print 'x'\n", "<<<<<<< HEAD\nx = 1\n", "return 1\n", "x = 012\n", "  x = 1\n", "def f():\n    x = 1\n   y = 2\n", "'abc\n", "a b\n"],
    "javascript": ["function f( { }", "const a;", "let x: number = 1;", "<<<<<<< HEAD\nvar a = 1;\n=======\n", "if (a { b }", "return 1", "x = 'abc", "a b", "for (const x of) {}", "class A { x: string }", "`abc ${x", "import x from;", "const s = ‘a’;", "{ a: 1, }"],
    "typescript": ["interface A { x: }", "const a: = 1;", "class A { f( }", "@@ -1,2 +1,3 @@", "enum E { A = }", "function f<T(a: T) {}", "#include <x>", "export class A {", "type X = ;"],
    "c": ["int f( { return 0; }", "int x = ;", "class A { public: int x; };", "template <typename T> T f(T x);", "std::string s;", "int f(void) { return 0;", "#endif", "#ifdef X\nint a;", "# This is no directive\nint x;", "int f() { case 1: ; }", "import os", "value.len = \u201cx\u201d;", "void f() { else x; }", "struct { int a }; "],
    "cpp": ["class A { public int x; }", "int f() { return (1; }", "template <typename T T f();", "namespace a { int x;", "export interface X { a: string }", "def f(x):\n    return x", "int x = 5 +;", "enum class E : int { a = 1, b = 2 ;", "for (;;) {}", "\"\"\"text\"\"\""],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    assert syntax.check(language, text) == []


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(language, text):
    assert syntax.check(language, text)


def test_panic_mode_goes_on_and_tells_lines():
    found = syntax.check("javascript", "var a = ;\nvar b = 1;\nfunction f() { return }\nvar c = ];\n")
    assert [p.line for p in found] == [1, 4]
    assert syntax.check("typescript", "<<<<<<< HEAD\nlet a = 1;\n")[0].cause == "conflict marker"
    assert syntax.check("c", "int f(void) { return 0;")[0].cause == "truncated"


@pytest.mark.parametrize("language", list(syntax.CHECKERS))
def test_any_text_ends(language):
    r = random.Random(1)
    for _ in range(150):
        syntax.check(language, "".join(r.choice("(){}[]<>;:,.=+-*/\"'`#@!?&|\\ \nabif0ñ") for _ in range(r.randint(0, 80))))
    assert syntax.check(language, "(" * 20000)


FILES = "file_id long, repository string, path string, relative_path string, language string, content string, size long, content_hash string, commit_sha string, ingested_at timestamp"


def files(spark, data):
    rows = [(i, r, p, p, lang, t, 0, "h", None, None) for i, r, p, lang, t in data]
    return spark.createDataFrame(rows, FILES).withColumn("valid", F.lit("clash"))


def test_verdicts(spark, rows):
    df = files(spark, [(1, "o/a", "a.py", "python", "x = 1"), (1, "o/a", "a.py", "python", "x = 1"), (2, "o/a", "b.py", "python", "x ="), (3, "o/b", "c.js", "javascript", ""), (4, "o/b", "d.rs", "rust", "fn"), (5, None, None, None, None), (None, "o/a", "e.py", "python", "x")])
    checked = parsecheck.verdicts(parsecheck.newest(df))
    assert {r["file_id"]: r["valid"] for r in checked.collect()} == {1: True, 2: False, 3: True, 4: None, 5: None}
    assert rows(parsecheck.rates(checked)) == [("o/a", "python", 2, 1, 0.5), ("o/b", "javascript", 1, 0, 0.0)]
    assert parsecheck.acceptance(checked).count() == 2
    inspected = spark.createDataFrame([(1, ([],), 1), (2, ([],), 1), (3, None, 1)], "file_id long, parse_result struct<errors:array<string>>, t long").withColumn("inspected_at", F.timestamp_seconds("t"))
    assert rows(parsecheck.against_inspections(checked, inspected), "outcome", "files") == [("agrees", 1), ("missed", 1), ("no result", 1)]
    assert parsecheck.verdicts(parsecheck.newest(df.where("false"))).count() == 0


# Problem 2


def test_notices_and_heads():
    assert handwritten.has_notice("// Code generated by protoc. DO NOT EDIT.\nint x;")
    assert not handwritten.has_notice("# The files next to this one are auto-generated; this one is written by hand.\nx = 1")
    assert not handwritten.has_notice("x = '@generated by hand'\n")
    head, body = handwritten.split_head("/* a */ int x;\n")
    assert (head, body) == ("/* a */", " int x;\n")
    assert handwritten.split_head("#include <x>\n")[0] == ""
    assert handwritten.features("") == [0.0] * len(handwritten.FEATURES)
    assert len(handwritten.features("x = 1\n" * 10)) == len(handwritten.FEATURES)


def source(seed):
    r = random.Random(seed)
    names = ["cursor", "anchor", "digest", "facet", "lexer", "queue", "token", "merger"]
    parts = []
    for _ in range(4):
        a, b, c = (r.choice(names) + str(r.randint(1, 99)) for _ in range(3))
        parts.append(f"def {a}_{b}({c}):\n    # explains why {b} needs {r.choice(names)}\n    {a} = [{c}.{r.choice(names)} for x in {b} if x > {r.randint(1, 900)}]\n    while {a}:\n        {a}.pop()\n    return sorted({a}, key=lambda {b}: ({b}.{r.choice(names)}, {c}))\n")
    return "\n".join(parts)


def test_classify(spark):
    data = [(i, f"o/r{i % 5}", f"src/m{i}.py", "python", source(i)) for i in range(120)]
    for i in range(200, 240):
        head = "# Code generated by tool 1.2. DO NOT EDIT.\n" if i % 2 else ""
        data.append((i, "o/r1", f"src/t{i}.py", "python", head + "".join(f"ROW_{k:04d} = ({k * i}, {k % 7})\n" for k in range(60))))
    library = source(999)
    data.append((300, "o/lib", "core/a.py", "python", library))
    data.append((301, "o/r2", "vendor/lib-1.2/a.py", "python", "# lib 1.2, see upstream\n" + library.replace("explains", "tells", 1)))
    data.append((302, "o/r2", "src/a.py", "python", library))
    data.append((303, "o/r2", "src/adapters/lib/b.py", "python", source(55)))
    data += [(400, None, None, None, ""), (401, "o/r1", "x.py", "python", None)]
    repositories = spark.createDataFrame([("o", "lib"), ("o", "lib"), ("o", "r1"), ("o", "r2"), (None, "x")], "owner string, name string")
    got = {r["file_id"]: r for r in handwritten.classify(files(spark, data), repositories).collect()}
    assert all(not got[i]["handwritten"] for i in range(200, 240))
    assert sum(not got[i]["handwritten"] for i in range(120)) == 0
    assert got[301]["library"] == "lib" and not got[301]["handwritten"]
    assert all(got[i]["handwritten"] for i in (300, 302, 303, 400)) and 401 not in got


def test_copy_whose_library_stands_below_a_long_licence(spark, rows):
    licence = "".join(f"# Clause {i} of the licence says what may be done with this file and {'what may not ' * 12}.\n" for i in range(15))
    library = "\n".join(source(700 + i) for i in range(12))
    data = [(1, "o/lib", "core/a.py", "python", licence + library), (2, "o/r2", "src/a.py", "python", licence + "# From lib 1.2, see upstream.\n" + library), (3, "o/r2", "src/b.py", "python", licence + library)]
    df = files(spark, data)
    repositories = spark.createDataFrame([("o", "lib"), ("o", "r2")], "owner string, name string")
    assert rows(handwritten.copies(df, handwritten.described(df), repositories)) == [(2, "lib")]


def test_classify_without_labels(spark):
    df = files(spark, [(1, "o/a", "a.py", "python", "x = 1")])
    repositories = spark.createDataFrame([("o", "a")], "owner string, name string")
    assert handwritten.classify(df, repositories).first()["handwritten"]
    assert handwritten.classify(df.where("false"), repositories).count() == 0


def test_bands_meet_at_the_similarity():
    r = random.Random(3)
    missed = 0
    for _ in range(200):
        words = [r.getrandbits(63) for _ in range(100)]
        other = words[:89] + [r.getrandbits(63) for _ in range(11)]
        import numpy as np

        a, b = (set(handwritten.bands(np.unique(np.array(w, np.uint64)))) for w in (words, other))
        missed += not a & b
    assert missed == 0
