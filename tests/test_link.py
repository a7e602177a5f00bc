"""Readers of five languages, resolution of imports, references and calls, and their edges."""

import pytest

from strataloom.operators import graph, link, observe
from strataloom.parsing import braced, python
from strataloom.parsing.observed import Offsets

FILES = "file_id long, cache_key string, rel_path string, language string, content binary"


def of(spark, texts):
    return spark.createDataFrame([(i, "k", p, None, bytearray(t.encode())) for i, (p, t) in enumerate(texts.items())], FILES)


def seen(language, text, what):
    found = python.read_python(language, text.encode()) if language == "python" else braced.READERS[language](language, text)
    return [s for s in found if s.what == what]


@pytest.mark.parametrize(
    ("language", "text", "symbols"),
    [
        ("python", "X = 1\n@d\nclass K:\n    def m(self): pass\ntry:\n    pass\nexcept E:\n    def g(): pass\n", {("X", "constant"), ("K", "class"), ("K.m", "method"), ("g", "function")}),
        ("javascript", "export default class K { static async m(a) { function inner() {} } get x() { return 1 } }\nconst LIM = 1, low = 2;\nfunction* g() {}\n", {("K", "class"), ("K.m", "method"), ("K.m.inner", "function"), ("K.x", "method"), ("LIM", "constant"), ("g", "function")}),
        ("typescript", "export interface I { a: string }\nexport type T<A> = A | B;\nabstract class C<T> extends D implements I { private m(x: number): Promise<void> { } }\nexport async function f<T>(a: T): Promise<T> { return a }\n", {("I", "interface"), ("T", "type"), ("C", "class"), ("C.m", "method"), ("f", "function")}),
        ("go", "package p\ntype S struct { a int }\nconst A = 1\nconst (\n\tB = 2\n\tC = 3\n)\nfunc (s *S) M() (int, error) { return 1, nil }\nfunc f[T any](x T) {}\n", {("S", "type"), ("A", "constant"), ("B", "constant"), ("C", "constant"), ("M", "method"), ("f", "function")}),
        ("rust", "pub struct S;\nenum E { A, B(u8) }\npub trait T { fn t(&self); }\nimpl<X> T for S<X> { fn t(&self) { fn inner() {} } }\nconst LIM: u8 = 1;\nmod m { pub fn f() {} }\n", {("S", "struct"), ("E", "enum"), ("T", "trait"), ("T.t", "function"), ("S<X>", "impl"), ("S<X>.t", "method"), ("S<X>.t.inner", "function"), ("LIM", "constant"), ("f", "function")}),
    ],
)
def test_symbols(language, text, symbols):
    assert {(s.qualified, s.kind) for s in seen(language, text, "symbol")} == symbols


def test_metadata_docs_and_decorators():
    [s] = seen("rust", "mod a { /// Doc.\n#[cfg(x)]\n#[inline]\npub(super) fn f() {} }", "symbol")
    assert s.decorators == ("cfg", "inline") and s.metadata == {"visibility": "pub(super)", "lexical_module_path": ["a"], "configuration": "declared_possible"}
    [s] = seen("typescript", "/**\n * One\n * two.\n */\n@Inj({ a: 1 })\n@b.Two()\nexport class K {}", "symbol")
    assert s.decorators == ("Inj", "Two")
    assert seen("go", "package p\n\n// F does.\n// More.\nfunc F() {}\n", "symbol")[0].doc == "F does.\nMore."
    assert braced.clean_comment("/** a\n * b */") == "a b" and braced.clean_comment("//! x\n/// y") == "x\ny"


def test_imports_and_bindings():
    found = [(s.name, s.imported, s.kind, s.specifier, s.type_only, s.exported) for s in seen("typescript", 'import D, { a as b, type T } from "./x";\nimport * as ns from "y";\nimport "z";\nexport { p as q } from "w";\nexport * from "v";\nimport type { U } from "u";', "import")]
    assert found == [("D", "default", "symbol", "./x", False, None), ("b", "a", "symbol", "./x", False, None), ("T", "T", "symbol", "./x", True, None), ("ns", None, "namespace", "y", False, None), (None, None, "side_effect", "z", False, None), (None, "p", "symbol", "w", False, "q"), (None, None, "glob", "v", False, None), ("U", "U", "symbol", "u", True, None)]
    assert [(s.name, s.specifier, s.kind) for s in seen("go", 'package p\nimport (\n\tf "fmt"\n\t. "a/b"\n\t_ "c"\n\t"d/e"\n)\n', "import")] == [("f", "fmt", "namespace"), (None, "a/b", "glob"), (None, "c", "side_effect"), ("e", "d/e", "namespace")]
    assert braced.use_leaves("a :: { b as c , d :: { self , e } , * }".split()) == [(("a", "b"), "c"), (("a", "d"), "d"), (("a", "d", "e"), "e"), (("a", "*"), "*")]
    assert [s.path for s in seen("rust", "pub use crate::a::B;\nextern crate serde as s;\nmod m;\n", "import")] == [("crate", "a", "B"), ("serde",), ()]


def test_calls_and_their_bindings():
    calls = {s.text: (s.form, s.path) for s in seen("python", "def f(g):\n    return f(g(1), a.b.c(), d()(2))\n", "call")}
    assert calls["f"] == ("identifier", ("f",)) and calls["a.b.c"] == ("static_path", ("a", "b", "c")) and calls["d()"] == ("dynamic", ())
    assert [s.text for s in seen("javascript", "class K { m(x) { this.n(x); new K(); if (x) { f() } } n() {} }", "call")] == ["this.n", "f"]
    assert [s.text for s in seen("rust", '#[cfg(test)]\nfn f() { g(1); a::b(2); println!("{}", h(3)); }', "call")] == ["g", "a::b", "h"]
    text = 'import {x} from "./m";\nfunction f(x) { return x(1); }\nx.y(2);\n'
    assert [(s.text, s.kind) for s in seen("javascript", text, "reference")] == [("x", "shadowed"), ("x.y", "bound")]


def test_offsets_count_bytes():
    text = "// é\nfunction ü() {}\n"
    o = Offsets(text)
    assert text.encode()[o.byte(text.index("function")) :].startswith(b"function") and o.line(text.index("function")) == 2


REPO = {
    "pkg/__init__.py": "from .core import run\n",
    "pkg/core.py": "def run(x):\n    return helper(x)\n\ndef helper(y):\n    return y\n\ndef shadow(helper):\n    return helper(1)\n",
    "app.py": "from pkg import run\nimport pkg.core as c\n\ndef main():\n    run(1)\n    c.helper(2)\n    missing(3)\n    return (lambda: 1)()\n",
    "broken.py": "def f(:\n",
    "web/a.ts": "export function one(): number { return 1 }\nexport default function two() { return one() }\nexport const LIM = 1;\n",
    "web/index.ts": 'export * from "./a";\nexport { one as uno } from "./a";\n',
    "web/use.ts": 'import { uno, LIM } from "./index";\nimport two from "./a";\nimport type { T } from "./t";\nexport function go() { uno(); two(); return LIM; }\n',
    "web/t.ts": "export type T = string;\n",
    "src/lib.rs": "mod inner;\nuse crate::inner::deep;\npub fn top() { deep(); inner::deep(); }\n",
    "src/inner.rs": "pub fn deep() {}\nuse super::top;\nuse super::super::nope;\n",
    "go.mod": "module example.invalid/m\n",
    "p/p.go": "package p\n\nfunc F() {}\n",
    "p/q.go": "package p\n\nfunc G() {}\n\nfunc low() {}\n",
    "main.go": 'package main\n\nimport "example.invalid/m/p"\n\nfunc main() { p.F(); p.G(); g() }\n\nfunc g() {}\n',
}


@pytest.fixture(scope="module")
def linked(spark):
    files = of(spark, REPO).unionByName(of(spark, {"app.py": REPO["app.py"]}))
    rows = observe.observed(files).cache()
    modules = spark.createDataFrame([("k", "example.invalid/m", "")], "cache_key string, module string, directory string")
    symbols = observe.symbols_of(rows.dropDuplicates(["cache_key", "file_path", "what", "n"])).cache()
    imports = link.resolved_imports(rows, files, modules).cache()
    surface = link.export_surface(*link.export_rules(rows, imports)).cache()
    references = link.resolved_references(rows, imports, surface, symbols).cache()
    return rows, symbols, imports, surface, references, link.resolved_calls(rows, references, symbols).cache()


def test_imports_find_their_files(linked):
    found = {(r.file_path, r.specifier, r.imported_name): (r.status, r.target_file, r.reason) for r in linked[2].collect()}
    assert found["pkg/__init__.py", ".core", "run"] == ("resolved", "pkg/core.py", None)
    assert found["app.py", "pkg", "run"][:2] == ("resolved", "pkg/__init__.py")
    assert found["app.py", "pkg.core", None][:2] == ("resolved", "pkg/core.py")
    assert found["web/use.ts", "./index", "uno"][:2] == ("resolved", "web/index.ts")
    assert found["main.go", "example.invalid/m/p", None][:2] == ("resolved", "p/p.go")
    assert found["src/lib.rs", "inner", None][:2] == ("resolved", "src/inner.rs") and found["src/lib.rs", "crate::inner::deep", "deep"][:2] == ("resolved", "src/inner.rs")
    assert found["src/inner.rs", "super::super::nope", "nope"] == ("unresolved", None, "invalid_specifier")
    assert [r.what for r in linked[0].where("file_path = 'broken.py'").collect()] == ["problem"]


def test_names_travel_over_exports(linked):
    found = {(r.file_path, r.name): (r.status, r.def_file) for r in linked[3].collect()}
    assert found["pkg/__init__.py", "run"] == ("resolved", "pkg/core.py")
    assert found["web/index.ts", "uno"] == ("resolved", "web/a.ts") and found["web/index.ts", "LIM"] == ("resolved", "web/a.ts")
    assert ("web/index.ts", "default") not in found


def test_calls_lead_to_callables(linked):
    found = {(r.file_path, r.text): (r.status, r.source_id, r.target_id, r.resolution or r.reason) for r in linked[5].collect()}
    assert found["app.py", "run"] == ("resolved", "app.py::main#function", "pkg/core.py::run#function", "import-resolved")
    assert found["app.py", "c.helper"][2] == "pkg/core.py::helper#function"
    assert found["app.py", "missing"][3] == "callee_not_proven"
    assert {r.reason for r in linked[5].where("file_path = 'app.py' AND form = 'dynamic'").collect()} == {"unsupported_callee"}
    assert found["pkg/core.py", "helper"][3] in ("local_binding_shadowed", "exact")
    assert found["web/use.ts", "uno"][2] == "web/a.ts::one#function" and found["web/use.ts", "two"][2] == "web/a.ts::two#function"
    assert found["web/a.ts", "one"][3] == "exact"
    assert found["main.go", "p.G"][2] == "p/q.go::G#function"
    assert found["main.go", "g"][2:] == ("main.go::g#function", "exact") and found["main.go", "p.F"][2] == "p/p.go::F#function"
    assert found["src/lib.rs", "deep"][2] == "src/inner.rs::deep#function"


def test_edges(linked):
    rows, symbols, imports, _, references, calls = linked
    pairs = {(r.from_id, r.to_id, r.edge_type) for r in link.import_edges(imports).collect()}
    assert ("app.py::__file__#file", "pkg/core.py::__file__#file", "imports") in pairs and ("web/use.ts::__file__#file", "web/t.ts::__file__#file", "imports_type") in pairs
    assert all(a != b for a, b, _ in pairs)
    made = {(r.from_id, r.to_id): r.evidence.line for r in link.call_edges(calls).collect()}
    assert made["app.py::main#function", "pkg/core.py::run#function"] == 5
    refs = {(r.from_id, r.to_id) for r in link.reference_edges(references, rows, symbols).collect()}
    assert ("web/use.ts::go#function", "web/a.ts::LIM#constant") in refs
    assert graph.adjacency(link.call_edges(calls).withColumn("edge_id", graph.F.lit(1)), "outgoing").count() == len(made)


def test_repeated_ids_are_numbered(spark):
    rows = observe.observed(of(spark, {"a.py": "def f(): pass\ndef f(): pass\ndef f(): pass\n"}))
    assert [r.id for r in observe.symbols_of(rows).orderBy("byte_offset").collect()] == ["a.py::f#function", "a.py::f#function~1", "a.py::f#function~2"]
    nodes = observe.file_nodes(of(spark, {"src/getUser/b.test.ts": "x"})).first()
    assert (nodes.id, nodes.name, nodes.keywords) == ("src/getUser/b.test.ts::__file__#file", "b.test.ts", ["b", "getuser", "test"])


def test_script_stages(spark):
    files = spark.createDataFrame([("k", p) for p in ("lib/util/x.ts", "packages/core/src/index.ts", "packages/core/src/deep.ts", "packages/app/src/own.ts", "packages/app/main.ts", "packages/old/lib/main.js")], "cache_key string, rel_path string")
    configs = spark.createDataFrame([("k", "", ".", {"@u/*": ["lib/util/*"], "@u/special/*": ["nowhere/*"]}, False), ("k", "odd", None, {}, True)], "cache_key string, directory string, base_url string, paths map<string,array<string>>, unsupported boolean")
    packages = spark.createDataFrame([("k", "packages/core", "@org/core", '{".": "./src/index.ts", "./d*": {"types": "./src/d*.ts"}}', None, None), ("k", "packages/app", "app", None, '{"#own": "./src/own.ts"}', None), ("k", "packages/old", "old", None, None, "./lib/main.js")], "cache_key string, directory string, name string, exports string, imports string, main string")
    asked = [("@u/x", "a.ts"), ("@u/special/y", "a.ts"), ("lib/util/x", "a.ts"), ("@org/core", "packages/app/main.ts"), ("@org/core/deep", "packages/app/main.ts"), ("#own", "packages/app/main.ts"), ("old", "a.ts"), ("react", "a.ts"), ("node:fs", "a.ts"), ("https://x/y", "a.ts"), ("a b", "a.ts"), ("@u/x", "odd/a.ts"), ("#none", "packages/app/main.ts")]
    imports = spark.createDataFrame([(i, "k", f, s, False) for i, (s, f) in enumerate(asked)], "import_id long, cache_key string, file_path string, specifier string, type_only boolean")
    found = {r.import_id: (r.status, r.target) for r in link.script_targets(imports, files, configs, packages).collect()}
    assert [found[i] for i in range(len(asked))] == [
        ("resolved", "lib/util/x.ts"), ("external", None), ("resolved", "lib/util/x.ts"), ("resolved", "packages/core/src/index.ts"), ("resolved", "packages/core/src/deep.ts"), ("resolved", "packages/app/src/own.ts"), ("resolved", "packages/old/lib/main.js"),
        ("external", None), ("external", None), ("external", None), ("invalid_specifier", None), ("unsupported_configuration", None), ("not_indexed", None),
    ]


def test_contexts_visibility_and_modules(spark):
    rows = [(1, "a", None, 1, "unconditional"), (1, "a", None, 2, "declared_possible"), (2, None, "external", None, None), (2, None, "external", None, None), (3, "a", None, 1, "unconditional"), (3, "b", None, 1, "unconditional"), (4, "a", None, 1, "unconditional"), (4, None, "external", None, None)]
    merged = {r.import_id: (r.endpoint, r.reason, r.basis, r.configuration) for r in link.merged_contexts(spark.createDataFrame(rows, "import_id int, endpoint string, reason string, basis int, configuration string")).collect()}
    assert merged == {1: ("a", None, 2, "declared_possible"), 2: (None, "external", None, None), 3: (None, "ambiguous", None, None), 4: (None, "ambiguous", None, None)}
    cases = [("pub", ["a"], ["z"], True), ("private", ["a", "b"], ["a", "b", "c"], True), ("private", ["a", "b"], ["a"], False), ("pub(super)", ["a", "b"], ["a", "c"], True), ("pub(in crate::x)", ["x", "y"], ["x", "q"], True), ("pub(in crate::x)", ["x", "y"], ["w"], False), ("pub(crate)", ["a"], [], True)]
    df = spark.createDataFrame([c[:3] for c in cases], "v string, d array<string>, i array<string>").coalesce(1)
    assert [r.ok for r in df.select(link.visible_to(graph.F.col("v"), graph.F.col("d"), graph.F.col("i")).alias("ok")).collect()] == [c[3] for c in cases]
    manifests = spark.createDataFrame([("k", "", None, None, ["./a", "b"]), ("k", "a", "m/a", {"m/x": "../vendored/x"}, None), ("k", "b", "m/b", None, None), ("k", "c", "m/c", None, None), ("l", "", "n", None, None)], "cache_key string, directory string, module string, replaces map<string,string>, uses array<string>")
    assert {(r.cache_key, r.module, r.directory) for r in link.go_modules(manifests, None).collect()} == {("k", "m/a", "a"), ("k", "m/b", "b"), ("k", "m/x", "vendored/x"), ("l", "n", "")}


def test_empty_tables(spark):
    rows = observe.observed(spark.createDataFrame([(1, None, None, None, None), (2, "k", "a.md", None, bytearray(b"x")), (3, "k", "e.go", None, bytearray(b""))], FILES))
    assert rows.count() == 0 and observe.symbols_of(rows).count() == 0
