"""Packrat grammars, extraction with offsets, and what documentation says something."""

import pytest

from strataloom.llm import functions as U
from strataloom.llm.docwords import informative
from strataloom.llm.peg import Peg


def test_packrat():
    g = Peg("Sum <- Product (~[+]~ Product)*\nProduct <- Value (~[*]~ Value)*\nValue <- ~[0-9]+~ / '(' Sum ')'", {"Value": lambda t, a, b, v: v or [int(t[a:b])]})
    assert g.parse("Sum", "1+(2*3)+4") == (9, [1, 2, 3, 4])
    assert g.parse("Sum", "x")[0] == -1
    assert Peg("A <- !'b' ~.~ &'c'").parse("A", "ac")[0] == 1
    calls = []
    g = Peg("S <- A 'x' / A 'y'\nA <- ~a+~", {"A": lambda t, a, b, v: calls.append(a) or [a]})
    assert g.parse("S", "aay")[0] == 3 and calls == [0]


@pytest.mark.parametrize(
    ("language", "source", "found"),
    [
        ("python", "class A:\n    def m(self, x) -> int:\n        '''Doc.'''\n        return 1\n\n\nasync def f(): pass\n", [("m", "(self, x)", "'''Doc.'''"), ("f", "()", None)]),
        ("go", "package a\n\n// Doc of it.\nfunc (s *S) F(a int) (int, error) {\n\treturn func() { }, nil\n}\nfunc g() {}\n", [("F", "(a int)", "// Doc of it.\n"), ("g", "()", None)]),
        ("rust", "/// Doc.\n#[inline]\npub fn f<T: A>(x: &'a T) -> Vec<u8> { '{'; }\nimpl B { fn g(&self); }\n", [("f", "(x: &'a T)", "/// Doc.\n"), ("g", "(&self)", None)]),
        ("typescript", "/** Doc. */\nexport async function f<T>(a: T): Promise<T> { if (a) { b(); } }\nclass C {\n  // m doc\n  private m(x: number): void { }\n}\nconst h = (a) => { };\n", [("f", "(a: T)", "/** Doc. */\n"), ("m", "(x: number)", "// m doc\n  "), ("h", "(a)", None)]),
        ("javascript", "function broken( { \n/** d */ function ok() { return `}` }\n", [("ok", "()", "/** d */ ")]),
    ],
)
def test_units(language, source, found):
    units = U.units_of(language, source.encode())
    assert [u[2:] for u in units] == found
    for start, end, name, *_ in units:
        assert name in source.encode()[start:end].decode()


def test_offsets_count_bytes():
    source = "# é\r\n\r\ndef f():\r\n    '''ü'''\r\n    return 1\r\n".encode()
    start, end, *_ = U.units_of("python", source)[0]
    assert source[start:end].startswith(b"def f()") and source[start:end].endswith(b"return 1")
    for odd in (b"", b"{" * 30_000, b"(" * 5_000, b"\xff\xfe def f(): pass", b"x" * 300_000):
        for language in ("python", "go", "javascript", "rust"):
            assert isinstance(U.units_of(language, odd), list)


@pytest.mark.parametrize(
    ("doc", "says"),
    [
        (None, False), ("", False), (" \n", False), ("parse_path", False), ("Parses the path.", False), ("The parse path method.", False), ("Helper for parse_path.", False), ("TODO", False), ("TODO: write this up", False), ("tbd.", False),
        ("@param node\n@returns", False), (":param node: the node\n:return: the result", False), ("_summary_\n\nArgs:\n    node (_type_): _description_", False), ("---", False), ("noqa: D103", False), ("eslint-disable-next-line no-unused-vars", False),
        ("Copyright (c) 2020 X. All rights reserved.", False), ("SPDX-License-Identifier: MIT", False), ("return parse_path(node)", False), ("if (debug) {\n  dump(x);\n}", False), ("See above.", False), ("{@inheritDoc}", False), ("Siehe oben.", False), ("Konstruktor.", False),
        ("Returns -1 when the file is missing.", True), ("Not thread-safe.", True), ("Strips the copyright banner before hashing.", True), ("TODO: faster. Skips symbolic links.", True), ("@param node must be sorted by offset", True),
        ("noqa lines are kept: reads the hidden part of the file.", True), ("noqa lines are kept: splits overlapping definition ranges.", True), ("eslint-disable max-len, no-console", False), ("索引が空のときは空の一覧を返す。", True), ("Renvoie les titres placés sous une page.", True), ("// Ties go to the earlier file.", True), ("/** Locks the store. */", True),
    ],
)
def test_informative(doc, says):
    assert informative("parse_path", "def parse_path(node)", doc) is says


SYMBOLS = "ord long, cache_key string, name string, kind string, file_path string, byte_offset long, signature string, docstring string, code string"
FILES = "file_id long, cache_key string, rel_path string, language string, content binary"


def test_pairs(spark):
    source = b"def f(node):\n    '''Never blocks.'''\n"
    files = spark.createDataFrame([(1, "k", "a.py", "Python", bytearray(source)), (1, "k", "a.py", "Python", bytearray(source)), (2, "k", "n.py", None, None), (3, "k", "b.py", None, bytearray(b"def f(node):\n    '''Node.'''\n"))], FILES)
    rows = [(6, "k", "f", "function", "b.py", 0, "", "Never blocks.", None), (1, "k", "f", " Function", "a.py", 0, "", "Node.", None), (2, "k", "f", "method", "a.py", 0, "", "Never blocks.", None), (2, "k", "f", "method", "a.py", 0, "", "Never blocks.", None), (3, "k", "f", "class", "a.py", 0, "", "Never blocks.", None), (4, None, None, "function", None, None, None, "Never blocks.", None), (5, "k", "f", None, "a.py", 0, "", "x y", None)]
    symbols = spark.createDataFrame(rows, SYMBOLS)
    found = {r.ord: (r.documentation, r.code) for r in U.documented_functions(symbols, files).collect()}
    # The pair is what the grammar emits: symbols without a function at their place have none.
    pair = ("'''Never blocks.'''", "def f(node):\n    '''Never blocks.'''")
    assert found == {1: pair, 2: pair}
    assert {r.ord for r in U.documented_ords(symbols, files).collect()} == {1, 2}
    assert U.documented_ords(symbols, files.where("false")).count() == 0
    assert U.documented_ords(spark.createDataFrame([], SYMBOLS), files).count() == 0


@pytest.mark.parametrize("levels", [151, 20_000])
def test_deep_nesting(levels):
    source = "package a\n\n// Doc.\nfunc f() {\n" + "{\n" * levels + "// Inner.\nfunc g() {}\n" + "}\n" * levels + "}\n\n// Last.\nfunc h() {}\n"
    assert [u[2] for u in U.units_of("go", source.encode())] == ["f", "g", "h"]


CUT = [("go", "// Doc.\nfunc f(a int) {\n\tif a {\n\t\tb("), ("typescript", "/** Doc. */\nfunction f(a) {\n  while (a) {"), ("rust", "/// Doc.\nfn f(a: u8) { if a {"), ("python", "def f(a):\n    '''Doc.'''\n    return (")]


@pytest.mark.parametrize(("language", "source"), CUT)
def test_cut_off_functions_end_with_the_file(language, source):
    start, end, name, params, doc = U.units_of(language, source.encode())[0]
    assert (name, "Doc." in doc, end) == ("f", True, len(source))
