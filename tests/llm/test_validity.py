"""Parse tables: valid and invalid texts of five languages, quick lexing, and the operator."""

import ast
import os
import warnings

import pytest
from hypothesis import given, settings, strategies as st

from strataloom.llm import validity
from strataloom.llm.syntax.languages import first_error, parser

ENDING = {"go": "go", "rust": "rs", "javascript": "js", "typescript": "ts", "python": "py"}
VALID = {
    "go": [
        "package a\nfunc f[T any, K comparable](x T, ys ...K) (a, b int, err error) { if v, ok := m[x]; ok && v > 3 { return } ; for i := range 10 { _ = i }; switch y := x.(type) { case int, *string: return 1, 2, nil; default: } ; return }\n",
        'package a\nimport (\n "fmt"\n x "y"\n)\ntype S struct {\n A, B int `json:"a"`\n *Foo\n sync.Mutex\n f func(a int) error\n}\nvar x = map[string]S{"a": {A: 1}, "b": S{B: 2}}\n',
        "package a\nfunc (s *S[T]) M() <-chan int { go func() { defer close(c) }(); select { case v := <-c: use(v); case c <- 1: default: }; L: for { break L }; return nil }\n",
        "package a\nfunc f() {\n\tif x := f(); x == nil {\n\t} else if y {\n\t} else {\n\t}\n\tfor ; ; {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfunc() {}()\n\tgoto end\nend:\n}\n",
    ],
    "rust": [
        "fn main() { let x = if a < b { 1 } else { 2 }; let Some(y) = z else { return; }; match x { 1 | 2 => {} 3..=5 if y => println!(\"{}\", x), Foo { a, ref b, .. } => 3, _ => (), } let v: Vec<_> = a.iter().map(|x| x * 2).collect::<Vec<_>>(); }",
        "impl<T> Iterator for Foo<T> where T: Fn(u8) -> u8 { type Item = T; fn next(&mut self) -> Option<Self::Item> { self.0.next()?.await; Some(Foo { a: 1, ..Default::default() }) } }",
        "/* outer /* inner */ x */ fn f() { let s = r#\"a\"b\"#; a <<= 2; if x == (S { x: 1 }) {} loop { break; } }",
    ],
    "javascript": [
        'import a, { b as c } from "x"; export default class A extends B { #p = 1; static { foo() } async *g() { yield* x } get y() { return this.#p } }',
        "const r = /ab[/\"]+c/gi.test(s) ? a / b / c : `x ${a + `y ${b}`} z`;\nx = a ?? b?.c?.[d]?.(e);\na = b\n++c\n",
        "!function(q,z){q.sM=z||{};void 0===this&&q.sM()}(p,j);for(;c.oI<62;)switch(r){case 8:c.oI++;break;default:k()}",
    ],
    "typescript": [
        "type X<T> = T extends (infer U)[] ? U : keyof T; abstract class C<T> implements I { private readonly a: string = 'x'; constructor(private b: number, public c?: string) { super() } abstract f(): void; }",
        "const f = <T,>(x: T): x is string => x satisfies any; let a = <any>b; let h: { [K in keyof T]?: T[K] }; enum E { A = 1, B }\nnamespace N.M { export let y = a < b && c > d }",
    ],
    "python": ["match x:\n    case {'a': 1, **r} if r: pass\n    case _: pass\ntype X[T] = list[T]\nprint(f\"{a[\"b\"]!r}\")\n"],
}
INVALID = {
    "go": ["package a\nfunc f() { x := }\n", "package a\nfunc f() {\n if x {\n", "func f() {}\n", 'package a\nvar x = "abc\n', "package a\nfunc f() { a b }\n"],
    "rust": ["fn f() { let x = ; }", "fn f() { let x = 5 }", "fn f( { }", "fn f() { (1 + 2 }", "struct A { a: u8 b: u8 }", "let x = 1;", '{"a": 1}'],
    "javascript": ["function f( { }", "let x = ;", "const a = 1 2", "class A { x: number = 1 }", "function f(a: string) {}", 'x = "abc', "x = `abc", '{"a": 1, "b": 2}', "<<<<<<< HEAD\nx\n"],
    "typescript": ["let x: = 3", "interface X { a: string", "type X = ", "x = {a: 1,, b}", "def f(x): return 1", "const x = <div>;"],
    "python": ["def f(:\n  pass", "if x:\npass", "x = (1", "print 'a'", "'abc"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid(language, text):
    assert first_error(language, f"a.{ENDING[language]}", text.encode()) is None


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in INVALID.items() for t in ts])
def test_invalid(language, text):
    line, column, message = first_error(language, f"a.{ENDING[language]}", text.encode())
    assert line >= 1 and column >= 1 and message


@pytest.mark.parametrize(("text", "valid"), [('fn f() { println!("{}", a); }', True), ('fn f() { println!("{}", a \x01); }', False), ("#[cfg(\x01)]\nfn f() {}", False), ("macro_rules! m { ($a:expr) => { \x01 }; }", False), ("macro_rules! m { ($($a:expr),* $(,)?) => { [$($a),*] }; }", True)])
def test_what_rust_macros_hold_is_tokens(text, valid):
    assert (first_error("rust", "a.rs", text.encode()) is None) is valid


def test_jsx_needs_its_ending():
    text = b"const A = () => <div className=\"a\" {...p} onClick={() => b < c}>text {x ? <B/> : null} <></></div>;"
    assert first_error("javascript", "a.jsx", text) is None and first_error("javascript", "a.js", text)
    assert first_error("typescript", "a.tsx", b"export const A: FC<P> = <T,>({a}: P<T>) => { return (<div>{a}</div>); };") is None


@pytest.mark.parametrize("language", ENDING)
def test_empty_marks_and_cut_texts(language):
    path = f"a.{ENDING[language]}"
    assert first_error(language, path, b"") is None
    assert first_error(language, path, b"\xef\xbb\xbf") is None
    assert first_error(language, path, b" \r\n") is None
    assert first_error(language, path, b"\xef\xbb\xbf" + VALID[language][0].encode()) is None
    for cut in range(3, len(VALID[language][0]), 7):
        first_error(language, path, VALID[language][0][:cut].encode())
    first_error(language, path, b"(" * 50_000)


@given(st.text(alphabet="ab1 \n\t(){}[]<>=+-*/.,:;'\"`$#@!?&|\\", max_size=60))
@settings(max_examples=150, deadline=None)
def test_any_text_ends(text):
    for language in ENDING:
        first_error(language, f"a.{ENDING[language]}", text.encode())
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        assert first_error("python", "a.py", text.encode()) is None
    except SyntaxError:
        assert not text.strip() or first_error("python", "a.py", text.encode())


def test_quick_lexing_gives_the_same_tokens(small):
    import duckdb

    rows = duckdb.sql(f"SELECT DISTINCT ON (file_id) rel_path, content FROM '{small}/files.parquet'").fetchall()
    kinds = {"py": "python", "go": "go", "rs": "rust", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript"}
    for path, content in rows:
        language = kinds.get(path.rsplit(".", 1)[-1])
        if language and first_error(language, path, content) is None:
            text = content.decode().lstrip("﻿")
            _, lexer = parser(language)
            a, b = lexer(text, path), lexer(text, path, True)
            assert (a.kinds, a.newline) == (b.kinds, b.newline), path


def test_operator(spark):
    schema = "file_id long, cache_key string, rel_path string, language string, content binary, valid string"
    rows = [(1, "k", "a.go", None, bytearray(b"package a\n"), "x"), (2, "k", "b.js", "Golang ", bytearray(b"let x = 1"), "x"), (2, "k", "b.js", "Golang ", bytearray(b"let x = 1"), "x"), (3, None, None, "rs", None, None), (4, "k", "c.md", "md", bytearray(b"{"), None), (5, "k", "d", None, bytearray(b"{"), None)]
    files = spark.createDataFrame(rows, schema)
    assert [r.file_id for r in validity.invalid_files(files).collect()] == [2]
    assert {(r.cache_key, r.language, r.files, r.invalid, r.rate) for r in validity.validity_rates(files).collect()} == {("k", "go", 2, 1, 0.5), (None, "rust", 1, 0, 0.0)}
    assert validity.checked_files(spark.createDataFrame([], schema)).count() == 0


EARLY = {
    "javascript": ["1 = 2;", "const a;", "return 1;", "function f(){ break; }", "await = 1", "f() = 1", "a + b = 1", "if (x) { return }", "while (x) { (() => { continue; })() }"],
    "go": ["package a\nfunc f() { a + b := 1 }\n", "package a\nfunc f() { x.y, c := 1 }\n"],
    "python": ["1 = 2", "f() = 1", "x, f() = 1", "a + b = 1", "x: int, y = 1", "(a, b) += 1", 'f"{a!z}"', 'f"{}"', 'f"{a +}"', 'f"{(a}"', 'f"{a:{b+}}"', '"""a"b" ""', "'''a\n''"],
}
LATE = {
    "javascript": ["a = b = c; a.b = 1; [a, b] = c; ({a} = b); f().x = 1; x = y\n++z\nw = 1\nthis.x = 1; a.this = 2; a.b[c](d).e = 5; for (;;) if (x) { break } switch (x) { case 1: f(); break; default: { break; } }", "x.map(function () { return 1 }); class A { m() { if (x) { return } try { return } catch { return } } } lbl: { break lbl; } do { break; } while (x); const z = await f();"],
    "typescript": ["a! = 1; (a as any) = 2; const c: number; declare const d; function f(this: A): B<C> { return 1 } class Q { x: number = 1; m(): { a: 1 } { return 1 } }"],
    "go": ["package a\nfunc f() { for i, x := range y { }; if v, ok := m[x]; ok {}; a := 1 }\n"],
    "python": ["a = b = 1; a.b, c[0] = 1, 2; (a) = 1; (a, b) = 1; [a, *b] = c; a.b += 1; self.x: int = 2\nx = yield\n() = x\n'a'.b = 1\n", "f\"{a!r:>{w}} {b=} {c:%Y-%m} {{}} {d['x']} {'a' if b != c else {1: 2}[1]}\" rf'{x}\\{y}'\n"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in EARLY.items() for t in ts])
def test_early_errors(language, text):
    assert first_error(language, f"a.{ENDING[language]}", text.encode()) is not None


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in LATE.items() for t in ts])
def test_what_looks_like_early_errors(language, text):
    assert first_error(language, f"a.{ENDING[language]}", text.encode()) is None


def test_the_python_table_agrees_with_the_interpreter(small):
    import random
    import re

    import duckdb

    rows = [c.decode().lstrip("﻿") for (c,) in duckdb.sql(f"SELECT DISTINCT ON (file_id) content FROM '{small}/files.parquet' WHERE rel_path LIKE '%.py' AND content IS NOT NULL").fetchall()]
    rng = random.Random(9)
    for n in range(600):
        words = re.findall(r"\w+|[^\w\s]|\s+", rng.choice(rows)[:3000]) or ["x"]
        k, j = rng.randrange(len(words)), rng.randrange(len(words))
        words[k : k + 1] = [[], [words[k], words[j]], [words[j]]][n % 3]
        text = "".join(words) if n > 20 else rows[n % len(rows)]
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text.encode())
            valid = True
        except SyntaxError:
            valid = False
        assert (first_error("python", "a.py", text.encode()) is None) is valid or not text.strip(), text
