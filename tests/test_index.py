"""Text, content, search, anchors, resolution, integrity and usage on small fixtures."""

import math
import re

import pytest
from pyspark.sql import functions as F

from strataloom.functions import policy, text as X
from strataloom.operators import anchors, content, extract, integrity, resolve, search, telemetry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("name", "words"), [("getUserByID", ["get", "user", "by", "id"]), ("_snake_case_", ["snake", "case"]), ("", []), (None, []), ("a_b", []), ("naïveThing", ["naïve", "thing"])])
def test_name_words(spark, name, words):
    assert one(spark, X.name_words(F.lit(name).cast("string"))) == words


@pytest.mark.parametrize(("term", "out"), [("queries", "query"), ("edges", "edge"), ("class", "class"), ("status", "status"), ("axis", "axis"), ("news", "news"), ("hubs", "hubs")])
def test_normalized_term(spark, term, out):
    assert one(spark, X.normalized_term(F.lit(term))) == out


@pytest.mark.parametrize(("term", "out"), [("darkness", "dark"), ("linking", "link"), ("linked", "link"), ("queries", "query"), ("boxes", "box"), ("cats", "cat"), ("pass", "pass")])
def test_stem(spark, term, out):
    assert one(spark, X.stem(F.lit(term))) == out


@pytest.mark.parametrize("text", ["a\nb", "a\r\nb\r\n", "", "\n", "a\x0bb\x0cc\x1cd\x85e\u2028f\u2029g", "\r\r\n\n", "x" * 100_000])
def test_lines_are_those_of_python(spark, text):
    assert one(spark, X.lines(F.lit(text))) == text.splitlines()


@pytest.mark.parametrize(("path", "plain"), [("a/b.py", True), ("/a", False), ("a/../b", False), ("a\\b", False), ("", False), ("./a", False), ("a//b", False), (None, False)])
def test_plain_paths(spark, path, plain):
    assert one(spark, X.is_plain_path(F.lit(path).cast("string"))) is plain


@pytest.mark.parametrize(("glob", "path", "fits"), [("src/*.py", "src/a.py", True), ("src/*.py", "src/x/a.py", False), ("src/**/a.py", "src/x/y/a.py", True), ("src/**/a.py", "src/a.py", True), ("a?c", "abc", True)])
def test_globs(glob, path, fits):
    assert bool(re.match(X.glob_pattern(glob), path)) is fits


def test_policy(spark):
    rows = spark.createDataFrame([("a/node_modules/x/y.js",), (".env",), ("a.PEM",), ("a.txt",), ("a/b.py",)], "p string")
    found = rows.select("p", policy.exclusion_reason(F.col("p")), policy.exclusion_root(F.col("p"))).collect()
    assert [tuple(r)[1:] for r in found] == [("policy_excluded", "a/node_modules"), ("sensitive_or_binary", None), ("sensitive_or_binary", None), ("unsupported_file_type", None), (None, None)]


def test_grep_and_slices(spark):
    rows = spark.createDataFrame([(1, "a\nhit\nb\nc\nd", 5), (2, None, 5), (3, "", 5), (4, "hit", 5)], "doc_id long, text string, line_no int")
    found = {r.doc_id: r for r in content.grep_context(rows.drop("line_no"), "doc_id", F.col("text"), "hit").collect()}
    assert (found[1].line_no, found[1].before, found[1].after) == (2, ["a"], ["b", "c"])
    assert (found[4].before, found[4].after) == ([], [])
    body = {r.doc_id: (r.total_lines, r.body) for r in content.file_slice(rows, "doc_id", F.col("text"), 4, 99).collect()}
    assert body == {1: (5, "c\nd"), 2: (0, ""), 3: (0, ""), 4: (1, "")}


def test_context_in_files_of_any_text(spark, tmp_path):
    from hashlib import sha256

    from strataloom.plans import catalog

    texts = ["\ufeffa\nb\nc\nd\ne\n".encode(), "é\r\nü\nx\ny\nz".encode(), "中\u2028文\n字\n\n.".encode(), b"bad \xff\xc3\nb\nc\nd\ne\nf", b"one\ntwo\nthree", b""]
    spark.createDataFrame([(i, "k", f"f{i}.py", bytearray(t)) for i, t in enumerate(texts)], "file_id long, cache_key string, rel_path string, content binary").write.parquet(f"{tmp_path}/files.parquet")
    places = [(i, line, end) for i in range(len(texts)) for line, end in ((1, 1), (2, 3), (4, 4), (5, 5))]
    spark.createDataFrame([(n, "k", f"f{i}.py", "function", "python", line, end) for n, (i, line, end) in enumerate(places)], "ord long, cache_key string, file_path string, kind string, language string, line int, end_line int").write.parquet(f"{tmp_path}/symbols.parquet")
    plain = []
    for n, (i, line, end) in enumerate(places):
        ls = texts[i].decode("utf-8", errors="replace").splitlines()
        first, last = max(line - 2, 1), min(end + 2, len(ls))
        plain.append((n, first, last, sha256("\n".join(ls[first - 1:last]).encode()).hexdigest()))
    assert sorted(map(tuple, catalog.QUERIES["symbol_context"](spark, str(tmp_path)).collect())) == plain


def test_pages(spark):
    rows = spark.range(10).withColumnRenamed("id", "n")
    assert [r.n for r in content.numbered(rows, ["n"], 2, 3).collect()] == [2, 3, 4]
    assert {r.next_offset for r in content.numbered(rows, ["n"], 2, 3).collect()} == {5}
    assert {r.next_offset for r in content.numbered(rows, ["n"], 8, 3).collect()} == {None}
    with pytest.raises(ValueError):
        content.numbered(rows, ["n"], 0, 501)


SYMBOL = "ord long, cache_key string, id string, kind string, language string, file_path string, name string, qualified_name string, signature string, summary string, docstring string, keywords array<string>, metadata struct<frontmatter:map<string,string>,markdown:struct<page_root:boolean,root_id:string,saved_pct:int,span_kind:string>>"


def symbols_of(spark, *rows):
    return spark.createDataFrame([(i, "k", f"id{i}", *r) for i, r in enumerate(rows)], SYMBOL)


def test_search(spark):
    rows = symbols_of(
        spark,
        ("function", "python", "a.py", "resolve_import", "resolve_import", "def resolve_import()", None, None, [], None),
        ("constant", "python", "a.py", "IMPORT", "IMPORT", "IMPORT", None, None, None, None),
        ("function", "cobol", "_templates/a", "resolve", "resolve", None, "import", "", ["import"], None),
        (None, None, None, None, None, None, None, None, None, None),
    )
    found = {r.id: r.score for r in search.scored(rows, "resolve import").collect()}
    assert found == {"id0": 5 + 5 + 2 + 2 + 10, "id1": 5 + 2 - 5, "id2": 0.5 * (5 + 1 + 3 + 8)}
    assert [r.id for r in search.top(rows, "  ", 2).collect()] == ["id0", "id1"]
    assert search.scored(rows, "import", allowed=[]).count() == 0
    assert [r.id for r in search.scored(rows, "import", kind="constant").collect()] == ["id1"]


def test_inherited_frontmatter(spark):
    page = ({"title": "Import guide", "tags": "[import, x]"}, (True, "id0", 0, "section"))
    rows = symbols_of(
        spark,
        ("section", "markdown", "a.md", "Start", "Start", None, None, None, [], page),
        ("section", "markdown", "a.md", "The import", "Start > The import", None, None, None, [], (None, (False, "id0", 80, "section"))),
    )
    found = {r.id: r.score for r in search.scored(rows, "import").collect()}
    front = 16 + 4 + 8 + 2
    assert found["id0"] == front * 0.5
    assert math.isclose(found["id1"], 12 + 10 + 5 + front * 0.55 + 8)


def plain_anchors(rows, question):
    terms = anchors.question_terms(question)

    def norm(t):
        if len(t) > 4 and t.endswith("ies"):
            return t[:-3] + "y"
        return t[:-1] if len(t) > 4 and t.endswith("s") and not t.endswith(("ss", "us", "is")) else t

    def toks(t):
        return [y for y in map(norm, re.findall("[a-z0-9]+", (t or "").lower())) if len(y) >= 2]

    units = {}
    for r in rows:
        base = re.sub(r"(?<=.)\.[^.]*$", "", r["file_path"].rsplit("/", 1)[-1])
        texts = [("file_basename", base), ("file_path", r["file_path"]), ("symbol_name", r["name"]), ("qualified_name", r["qualified_name"]), ("signature", r["signature"]), ("summary", r["summary"]), ("docstring", r["docstring"]), ("keywords", " ".join(r["keywords"] or []))]
        unit = f"{r['cache_key']}::{r['file_path'] if r['language'] == 'markdown' else r['id']}"
        units.setdefault(unit, []).append((r["id"], [(s, toks(t)) for s, t in texts]))
    df = {t: sum(any(t in k for _, f in syms for _, k in f) for syms in units.values()) for t in terms}
    out = []
    for unit, syms in units.items():
        best = None
        for ident, fields in syms:
            got, high, bonus = {}, False, 0.0
            for s, k in fields:
                hits = [t for t in terms if t in k]
                if not hits:
                    continue
                cov = len(hits) / len(set(k))
                for t in hits:
                    spec = 1 + math.log((len(units) + 1) / (df[t] + 1))
                    got[t] = max(got.get(t, 0), anchors.FIELD_WEIGHTS[s] * spec * (0.35 + 0.65 * cov * cov))
                if s in anchors.HIGH_SIGNAL:
                    high = True
                    if set(zip(terms, terms[1:])) & set(zip(k, k[1:])):
                        bonus = max(bonus, 2 * anchors.FIELD_WEIGHTS[s])
            if got and (high or len(got) >= 2):
                score = (sum(sorted(got.values(), reverse=True)[:4]) + bonus) * (1 + 0.25 * min(len(got), 4) / len(terms))
                if best is None or (-score, ident) < (-best[0], best[1]):
                    best = (score, ident)
        if best:
            out.append((unit, *best))
    out.sort(key=lambda x: (-x[1], x[2]))
    return [(u, i, round(s, 4)) for u, s, i in out[: anchors.cap(len(units), 10)]]


def test_anchors_equal_a_plain_version(spark, small):
    from strataloom.operators import tables

    rows = tables.symbols(spark, small, "cache_key", "id", "name", "qualified_name", "signature", "summary", "docstring", "keywords", "metadata")
    plain = [r.asDict() for r in rows.collect()]
    plain = [r for r in plain if not (r["metadata"] and r["metadata"]["frontmatter"])]
    keep = rows.where("metadata.frontmatter IS NULL")
    for question in ("How does the resolver prune stale evidence of an import?", "merge bounded cursors", "the of"):
        found = [(r.unit, r.id, round(r.score, 4)) for r in anchors.inferred(keep, question).orderBy("rank").collect()]
        assert found == plain_anchors(plain, question) if anchors.question_terms(question) else found == []


IMPORT = "import_id long, cache_key string, file_path string, level int, module string, name string"


def paths_of(spark, *paths):
    return spark.createDataFrame([("k", p) for p in paths], "cache_key string, rel_path string")


def test_python_imports(spark):
    files = paths_of(spark, "pkg/__init__.py", "pkg/a.py", "pkg/sub/__init__.py", "pkg/sub/b.py", "src/pkg2/__init__.py", "src/pkg2/m.py", "pkg2.py")
    asked = [("pkg/a.py", 0, "pkg.sub", "b"), ("pkg/a.py", 0, "pkg.sub", "thing"), ("pkg/sub/b.py", 2, "a", "x"), ("pkg/sub/b.py", 1, "", "b"), ("pkg/a.py", 0, "pkg2", ""), ("pkg/a.py", 0, "os", "path"), ("pkg/a.py", 9, "x", "y"), ("pkg/a.py", 0, "1bad", ""), ("pkg/a.py", 0, "pkg2.m", "")]
    rows = spark.createDataFrame([(i, "k", *a) for i, a in enumerate(asked)], IMPORT)
    found = {r.import_id: (r.status, r.target) for r in resolve.python_imports(rows, files).collect()}
    assert found == {
        0: ("resolved", "pkg/sub/b.py"), 1: ("resolved", "pkg/sub/__init__.py"), 2: ("resolved", "pkg/a.py"), 3: ("resolved", "pkg/sub/b.py"), 4: ("ambiguous", None),
        5: ("not_indexed", None), 6: ("invalid_specifier", None), 7: ("invalid_specifier", None), 8: ("resolved", "src/pkg2/m.py"),
    }


SPECIFIER = "import_id long, cache_key string, file_path string, specifier string"


def test_script_imports(spark):
    files = paths_of(spark, "src/a.ts", "src/b.js", "src/lib/index.tsx", "src/c.mts", "src/d.js", "src/d.ts")
    asked = ["./b", "./lib", "./c.mjs", "./d.js", "../src/a", "../../x", "react", "./none", "./a.ts"]
    rows = spark.createDataFrame([(i, "k", "src/a.ts", a) for i, a in enumerate(asked)], SPECIFIER)
    found = {r.import_id: (r.status, r.target) for r in resolve.script_imports(rows, files).collect()}
    assert found == {0: ("resolved", "src/b.js"), 1: ("resolved", "src/lib/index.tsx"), 2: ("resolved", "src/c.mts"), 3: ("resolved", "src/d.ts"), 4: ("resolved", "src/a.ts"), 5: ("invalid_specifier", None), 6: ("external", None), 7: ("not_indexed", None), 8: ("resolved", "src/a.ts")}


def test_go_imports(spark):
    files = paths_of(spark, "a/x.go", "a/internal/y.go", "b/z.go", "m2/w.go", "b/only_test.go")
    modules = spark.createDataFrame([("k", "ex.org/m", ""), ("k", "ex.org/m/two", "m2")], "cache_key string, module string, directory string")
    asked = [("b/z.go", "ex.org/m/a"), ("b/z.go", "ex.org/m/two"), ("b/z.go", "ex.org/m/a/internal"), ("a/x.go", "ex.org/m/a/internal"), ("b/z.go", "fmt"), ("b/z.go", "C"), ("b/z.go", "ex.org/m/none"), ("b/z.go", "bad spec")]
    rows = spark.createDataFrame([(i, "k", *a) for i, a in enumerate(asked)], SPECIFIER)
    found = {r.import_id: (r.status, r.target) for r in resolve.go_imports(rows, files, modules).collect()}
    assert found == {0: ("resolved", "a"), 1: ("resolved", "m2"), 2: ("inaccessible", None), 3: ("resolved", "a/internal"), 4: ("external", None), 5: ("external", None), 6: ("not_indexed", None), 7: ("invalid_specifier", None)}


def test_rust_imports(spark):
    files = paths_of(spark, "c/src/lib.rs", "c/src/a.rs", "c/src/b/mod.rs", "c/src/b/d.rs")
    asked = ["crate::a::Thing", "crate::b", "crate::b::d::X", "std::fmt", "crate::none"]
    rows = spark.createDataFrame([(i, "k", "c/src/a.rs", a) for i, a in enumerate(asked)], SPECIFIER)
    found = {r.import_id: (r.status, r.target) for r in resolve.rust_imports(rows, files).collect()}
    assert found == {0: ("resolved", "c/src/a.rs"), 1: ("resolved", "c/src/b/mod.rs"), 2: ("resolved", "c/src/b/d.rs"), 3: ("external", None), 4: ("not_indexed", None)}


def test_surfaces(spark):
    rules = [("d1", None), ("d2", None), ("a", "d1"), ("b", "a"), ("c", "d1"), ("c", "d2"), ("x", "y"), ("y", "x")]
    found = {r.source: (r.status, r.definition) for r in resolve.surface_fixpoint(spark.createDataFrame(rules, "source string, target string")).collect()}
    assert found == {"d1": ("resolved", "d1"), "d2": ("resolved", "d2"), "a": ("resolved", "d1"), "b": ("resolved", "d1"), "c": ("ambiguous", None), "x": ("cyclic", None), "y": ("cyclic", None)}


def test_owners(spark):
    spans = spark.createDataFrame([("k", "f", "outer", 0, 100), ("k", "f", "inner", 10, 50), ("k", "f", "same", 10, 50), ("k", "g", "other", 0, 9)], "cache_key string, file_path string, span_id string, s_start long, s_end long")
    obs = spark.createDataFrame([(1, "k", "f", 20, 30), (2, "k", "f", 60, 70), (3, "k", "f", 90, 120), (4, "k", "none", 0, 1), (5, "k", "f", 0, 100), (6, "k", None, 0, 1)], "obs_id long, cache_key string, file_path string, start long, end long")
    assert {r.obs_id: r.span_id for r in resolve.nearest_owner(obs, spans).collect()} == {1: "inner", 2: "outer", 3: None, 4: None, 5: "outer", 6: None}
    assert {r.obs_id: r.outcome for r in resolve.exact_span(obs, spans).collect()} == {1: "missing", 2: "missing", 3: "missing", 4: "missing", 5: "definite", 6: "missing"}


def test_last_search(spark):
    schema = "event_id long, ts timestamp_ntz, session long, repo string, event string, has_results boolean"
    at = lambda s: f"2024-01-01 00:{s // 60:02}:{s % 60:02}"
    rows = [(1, 0, 1, "a", "search", True), (2, 10, 1, "a", "get", None), (3, 300, 1, "a", "get", None), (4, 301, 1, "a", "get", None), (5, 302, 1, "b", "search", True), (6, 303, 1, "a", "get", None), (7, 304, 2, "a", "get", None), (8, 305, 1, "b", "search", False), (9, 306, 1, "b", "get", None), (10, 302, 1, "b", "get", None)]
    import datetime as dt

    log = spark.createDataFrame([(i, dt.datetime.fromisoformat(at(t)), s, r, e, h) for i, t, s, r, e, h in rows], schema)
    assert {r.event_id: r.search_event_id for r in telemetry.last_search(log).collect()} == {2: 1, 3: 1, 4: None, 6: None, 7: None, 9: 5, 10: 5}


def test_overlaps_and_conflicts(spark):
    roots = spark.createDataFrame([("a", "/srv/x"), ("b", "/srv/x/y/"), ("c", "/srv/xy"), ("d", "")], "cache_key string, path string")
    assert [(r.cache_key, r.outer_key) for r in integrity.root_overlaps(roots).collect()] == [("b", "a")]
    over = spark.createDataFrame([("n", "a", '{"x": "1"}'), ("n", "b", '{"x": "2", "y": "3"}'), ("m", "a", None)], "id string, namespace string, attributes string")
    assert {(r.attribute, r.value, r.conflict) for r in integrity.overlay_merge(over).collect()} == {("x", "1", True), ("y", "3", False)}


def test_symbols_against_files(spark):
    from hashlib import sha256

    source, page = b"def f(x):\n  pass\n", b"# Head\n\ntext\n"
    files = spark.createDataFrame([(1, "k", "a.py", bytearray(source)), (2, "k", "p.md", bytearray(page))], "file_id long, cache_key string, rel_path string, content binary")
    schema = "ord long, cache_key string, file_path string, kind string, language string, name string, signature string, byte_offset long, byte_length long, content_hash string, metadata struct<markdown:struct<synthetic_name:boolean>>"
    own, whole = sha256(source[:16]).hexdigest(), sha256(source).hexdigest()
    rows = [
        (1, "k", "a.py", "function", "python", "f", "def f(q):", 0, 16, own, None), (2, "k", "b.py", "function", "python", "f", "", 0, 1, None, None), (3, "k", "a.py", "function", "python", "g", "", 0, 16, None, None),
        (4, "k", "p.md", "section", "markdown", "Head", "# Other", 0, 7, None, None), (5, "k", "a.py", "file", "python", "z", None, 0, 0, whole, None), (6, "k", "a.py", "file", "python", "z", None, 0, 0, own, None), (7, "k", "a.py", "function", "python", "f", None, 0, 16, whole, None),
        (8, "k", "p.md", "section", "markdown", "made up", "", 0, 7, None, ((True,),)), (9, "k", "a.py", "function", "python", None, None, 90, 16, "", None), (10, "k", None, None, None, None, None, None, None, None, None),
    ]
    symbols = spark.createDataFrame(rows, schema)
    found = {r.ord: r.problem for r in integrity.verify_symbols(symbols, files).collect()}
    assert found == {1: None, 2: "source_file_missing", 3: "name_not_in_bytes", 4: "signature_not_in_bytes", 5: None, 6: "content_drift", 7: "content_drift", 8: None, 9: None, 10: "source_file_missing"}
    live = spark.createDataFrame([("k", "a.py", bytearray(b"def f(y):\n  pass\n"))], "cache_key string, rel_path string, content binary")
    now = {r.ord: r.problem for r in integrity.verify_symbols(symbols, files, live).collect()}
    assert (now[1], now[5], now[3], now[8]) == ("content_drift", "content_drift", "name_not_in_bytes", None)


def test_markdown():
    text = b"---\ntitle: T\ntags: [a, b]\n---\nintro\n# One\n\n```\n# no\n```\n## Two\nx\n# Three ##\n"
    rows = extract.markdown_sections("d/p.md", text)
    assert [(r[1], r[2], r[3], r[4]) for r in rows] == [("p.md", "p.md", 0, None), ("One", "One", 1, None), ("Two", "One > Two", 2, 1), ("Three", "Three", 1, None)]
    assert text[rows[1][5] : rows[1][5] + rows[1][6]].decode().startswith("# One") and b"x\n" in text[rows[1][5] : rows[1][5] + rows[1][6]]
    assert extract.frontmatter(text.decode())[0] == {"title": "T", "tags": "a,b"}
    assert extract.markdown_sections("a.md", b"") == []
    assert extract.frontmatter("---\nkeywords:\n  - a\n  - b\n---\n")[0] == {"keywords": "a,b"}


def test_python_extraction():
    source = "import a.b\nfrom . import c as d\nX = 1\nclass K:\n    @dec\n    def m(self):\n        'doc'\n        return self.x.y(1)\ndef f(): pass\ndef f(): (lambda: 0)()\n".encode()
    found = extract.python_symbols("p.py", source)
    assert [(r[0], r[3]) for r in found] == [("p.py::X#constant", "constant"), ("p.py::K#class", "class"), ("p.py::K.m#method", "method"), ("p.py::f#function", "function"), ("p.py::f#function~1", "function")]
    assert found[2][7] == "doc" and found[2][8] == ["dec"]
    assert [r[1:5] for r in extract.python_imports("p.py", source)] == [(0, "a.b", "", "a"), (1, "", "c", "d")]
    assert [(r[1], r[2], r[3]) for r in extract.python_calls("p.py", source)] == [("self.x.y", "static_path", "K.m"), (None, "dynamic", "f")]
    assert extract.python_symbols("p.py", b"def (")[0][-1].startswith("SyntaxError")


def test_python_definitions_in_every_branch():
    source = b"""try:
    import x
except ImportError:
    def fallback(): pass
else:
    class Loaded: pass
finally:
    DONE = 1
if x:
    pass
elif y:
    def second(): pass
else:
    def third(): pass
for i in x:
    def looped(): pass
else:
    AFTER: int = 2
while x:
    def turned(): pass
match x:
    case 1:
        def matched(): pass
try:
    pass
except* ValueError:
    def starred(): pass
with x:
    def held(): pass
from m import *
"""
    names = ["fallback", "Loaded", "DONE", "second", "third", "looped", "AFTER", "turned", "matched", "starred", "held"]
    assert [r[1] for r in extract.python_symbols("a.py", source)] == names
    assert [r[0] for r in extract.python_exports("a.py", source)] == [*names, "*"]


def test_reexports_by_stars(spark, tmp_path):
    from strataloom.plans import catalog

    texts = {"p/__init__.py": b"from .a import *\ndef own(): pass\n", "p/a.py": b"try:\n    from .b import *\nexcept ImportError:\n    LIMIT: int = 1\ndef own(): pass\n", "p/b.py": b"def deep(): pass\ndef _hidden(): pass\n"}
    spark.createDataFrame([(i, "k", p, "python", bytearray(t)) for i, (p, t) in enumerate(texts.items())], "file_id long, cache_key string, rel_path string, language string, content binary").write.parquet(f"{tmp_path}/files.parquet")
    found = {r.source: r.definition for r in catalog.QUERIES["reexport_fixpoint"](spark, str(tmp_path)).collect()}
    at = lambda f, n: f"k::p/{f}.py::{n}"
    own = [("__init__", "own"), ("a", "own"), ("a", "LIMIT"), ("b", "deep"), ("b", "_hidden")]
    assert found == {at(*x): at(*x) for x in own} | {at("__init__", "LIMIT"): at("a", "LIMIT"), at("__init__", "deep"): at("b", "deep"), at("a", "deep"): at("b", "deep")}


def test_other_imports():
    js = b"import a, {b as c} from './x'; // import z from 'q'\nexport * from \"y\"\nimport 'side'\nconst r = require('r'); import('dyn')\n"
    assert [(r[1], r[2]) for r in extract.script_specifiers("a.js", js)] == [("./x", "import"), ("y", "reexport"), ("side", "side_effect"), ("r", "require"), ("dyn", "dynamic")]
    go = b'package p\nimport "fmt"\nimport (\n  x "a/b"\n  _ "c"\n // "no"\n)\n'
    assert [(r[1], r[2], r[3]) for r in extract.go_specifiers("a.go", go)] == [("fmt", "import", ["fmt"]), ("a/b", "import", ["x"]), ("c", "blank", ["_"])]
    assert extract.expanded_use("a::{b, c::{self, d as e}, f::*}") == [("a::b", "b"), ("a::c", "c"), ("a::c::d", "e"), ("a::f::*", "*")]
    rust = b"use std::fmt;\npub use crate::{a, b};\nmod m;\nextern crate x as y;\n"
    assert [(r[1], r[2]) for r in extract.rust_specifiers("a.rs", rust)] == [("std::fmt", "use"), ("crate::a", "use"), ("crate::b", "use"), ("self::m", "mod"), ("x", "extern_crate")]
    with pytest.raises(ValueError):
        extract.expanded_use("a::{" + ",".join(f"b{i}" for i in range(2000)) + "}")
