"""Extraction from file contents: sections, symbols, imports, calls and exports.

Each extractor is a plain function from one file's text to rows, run over Arrow batches. Python
is read with the interpreter's own parser; markdown by lines; imports of the other languages
from texts whose comments are blanked out. A file that can't be read gives one diagnostic row.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_COMMENTS = re.compile(r"""//[^\n]*|/\*[\s\S]*?\*/|("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)""")
#: Leaves that one ``use`` tree may have.
MAX_USE_LEAVES = 1_024


def over_files(files: DataFrame, read: Callable[[str, bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``read(path, content)`` for each file, behind its cache_key and file_path.

    Null contents give no rows; a path that is null counts as ''.
    """
    full = StructType.fromDDL(f"cache_key string, file_path string, {schema}")
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in full.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, (key, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                content = batch.column(2)[i].as_py()
                if content is not None:
                    rows += [(key, path, *r) for r in read(path or "", content)]
            columns = list(zip(*rows)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return files.select(F.col("cache_key").cast("string"), F.col("rel_path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, full)


def frontmatter(text: str) -> tuple[dict[str, str], int]:
    """Plain members of a page's frontmatter and the character it ends at; lists are joined by commas."""
    m = re.match(r"---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|$)", text)
    if not m:
        return {}, 0
    out: dict[str, str] = {}
    key = ""
    for line in m[1].splitlines():
        item = re.match(r"\s+-\s+(.*)$|-\s+(.*)$", line)
        pair = re.match(r"([A-Za-z_][\w-]*)\s*:\s*(.*)$", line)
        if pair:
            key, value = pair[1], pair[2].strip()
            out[key] = ",".join(x.strip().strip("\"'") for x in value[1:-1].split(",")) if value.startswith("[") else value.strip("\"'")
        elif item and key:
            value = (item[1] or item[2] or "").strip().strip("\"'")
            out[key] = f"{out[key]},{value}" if out.get(key) else value
    return out, m.end()


def slug(text: str) -> str:
    return re.sub(r"[^0-9a-z]+", "-", text.lower()).strip("-")


SECTION = "ord_in_file int, name string, qualified_name string, level int, parent int, byte_offset long, byte_length long, line int, end_line int, saved_pct int"


def markdown_sections(path: str, content: bytes) -> list[tuple]:
    """Sections under ATX headings outside fences, each through the sections nested in it.

    Text before the first heading is a section of level 0 with the file's name. saved_pct is the
    part of the file, in whole percent, that reading just the section saves.
    """
    text = content.decode("utf-8", "surrogateescape")
    lines = text.splitlines(keepends=True)
    heads: list[tuple[int, int, str]] = []  # line index, level, title
    fence = ""
    begin = len(text[: frontmatter(text)[1]].splitlines())
    for i, line in enumerate(lines):
        if i < begin:
            continue
        f = _FENCE.match(line)
        if f and not fence:
            fence = f[1]
        elif f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not line.strip().strip(fence[0]):
            fence = ""
        elif not fence and (h := _HEADING.match(line.rstrip("\r\n"))):
            heads.append((i, len(h[1]), (h[2] or "").strip()))
    sizes = [0]
    for line in lines:
        sizes.append(sizes[-1] + len(line.encode("utf-8", "surrogateescape")))
    rows: list[list] = []
    first = heads[0][0] if heads else len(lines)
    if first > begin and "".join(lines[begin:first]).strip():
        rows.append([path.rsplit("/", 1)[-1], 0, begin, first])
    for n, (i, level, title) in enumerate(heads):
        end = next((j for j, other, _ in heads[n + 1 :] if other <= level), len(lines))
        rows.append([title, level, i, end])
    out: list[tuple] = []
    open_: list[tuple[int, int, str]] = []
    whole = max(1, len(content))
    for n, (name, level, a, b) in enumerate(rows):
        while open_ and (open_[-1][1] >= level or level == 0):
            open_.pop()
        qualified = " > ".join([*(o[2] for o in open_), name])
        size = sizes[b] - sizes[a]
        out.append((n, name, qualified, level, open_[-1][0] if open_ else None, sizes[a], size, a + 1, b, max(0, min(100, int((len(content) - size) / whole * 100)))))
        if level:
            open_.append((n, level, name))
    return out


SYMBOL = "symbol_id string, name string, qualified_name string, kind string, byte_offset long, byte_length long, signature string, docstring string, decorators array<string>, line int, end_line int, problem string"


class _Text:
    """Byte offsets by line and column of a Python source, whose columns count UTF-8 bytes."""

    def __init__(self, content: bytes):
        self.content = content[3:] if content.startswith(b"\xef\xbb\xbf") else content
        self.shift = len(content) - len(self.content)
        self.starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", self.content))]

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column + self.shift


def _parsed(content: bytes) -> ast.Module | str:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return f"{type(e).__name__}: {e}"[:200]


def _statements(body: list[ast.stmt]) -> Iterator[ast.stmt]:
    """Statements in order, also those in all branches of compound ones; of functions and classes
    only themselves."""
    todo = body[::-1]
    while todo:
        node = todo.pop()
        yield node
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inner = [x for part in ("body", "handlers", "orelse", "finalbody", "cases") for x in getattr(node, part, ())]
            todo += [x for n in inner for x in ([n] if isinstance(n, ast.stmt) else n.body)][::-1]


def python_symbols(path: str, content: bytes) -> list[tuple]:
    """Functions, methods, classes and module-level constants in capitals; repeated ids get ~1, ~2."""
    tree = _parsed(content)
    if isinstance(tree, str):
        return [(None,) * 11 + (tree,)]
    places, out, seen = _Text(content), [], {}

    def add(node: ast.AST, name: str, kind: str, above: list[str], doc: str | None, decorators: list[str], signature: str) -> None:
        qualified = ".".join([*above, name])
        base = f"{path}::{qualified}#{kind}"
        n = seen[base] = seen.get(base, -1) + 1
        start, end = places.at(node.lineno, node.col_offset), places.at(node.end_lineno, node.end_col_offset)
        out.append((f"{base}~{n}" if n else base, name, qualified, kind, start, end - start, signature, doc, decorators, node.lineno, node.end_lineno, None))

    def walk(body: list[ast.stmt], above: list[str], inside_class: bool) -> None:
        for node in _statements(body):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(node, ast.ClassDef)
                kind = "class" if is_class else "method" if inside_class else "function"
                first = content.splitlines()[node.lineno - 1].decode("utf-8", "replace").strip().rstrip(":") if node.lineno <= len(content.splitlines()) else ""
                add(node, node.name, kind, above, ast.get_docstring(node, clean=True), [ast.unparse(d) for d in node.decorator_list], first)
                walk(node.body, [*above, node.name], is_class)
            elif isinstance(node, (ast.Assign, ast.AnnAssign)) and not above:
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Name) and target.id.isupper():
                        add(node, target.id, "constant", above, None, [], target.id)

    walk(tree.body, [], False)
    return out


IMPORT = "line int, level int, module string, name string, alias string, kind string, problem string"


def python_imports(path: str, content: bytes) -> list[tuple]:
    """One row for each name that an import binds; of a star the name is '*'."""
    tree = _parsed(content)
    if isinstance(tree, str):
        return [(None,) * 6 + (tree,)]
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(node.lineno, 0, a.name, "", a.asname or a.name.split(".")[0], "module", None) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(node.lineno, node.level, node.module or "", a.name, a.asname or a.name, "glob" if a.name == "*" else "symbol", None) for a in node.names]
    return sorted(out, key=lambda r: (r[0], r[2], r[3]))


CALL = "line int, callee string, form string, owner string, start_byte long, end_byte long, problem string"


def python_calls(path: str, content: bytes) -> list[tuple]:
    """Call sites with the callee's form: identifier, static_path or dynamic, and their function."""
    tree = _parsed(content)
    if isinstance(tree, str):
        return [(None,) * 6 + (tree,)]
    places, out = _Text(content), []

    def static(node: ast.expr) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute) and (base := static(node.value)):
            return f"{base}.{node.attr}"
        return None

    def walk(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{owner}.{child.name}" if owner else child.name
            if isinstance(child, ast.Call):
                callee = static(child.func)
                form = "identifier" if isinstance(child.func, ast.Name) else "static_path" if callee else "dynamic"
                f = child.func
                out.append((child.lineno, callee, form, owner, places.at(f.lineno, f.col_offset), places.at(f.end_lineno, f.end_col_offset), None))
            walk(child, inner)

    walk(tree, "")
    return sorted(out, key=lambda r: (r[4], r[5]))


EXPORT = "name string, kind string, line int, target_module string, target_level int, target_name string"


def python_exports(path: str, content: bytes) -> list[tuple]:
    """What a module offers: its own definitions and constants, and names that it imports ('*': all)."""
    tree = _parsed(content)
    if isinstance(tree, str):
        return []
    out = []
    for node in _statements(tree.body):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.append((node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, None, None, None))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            out += [(t.id, "constant", node.lineno, None, None, None) for t in targets if isinstance(t, ast.Name) and t.id.isupper()]
        elif isinstance(node, ast.ImportFrom):
            out += [(a.asname or a.name, "import", node.lineno, node.module or "", node.level, a.name) for a in node.names]
    return out


def _blanked(text: str) -> str:
    """The text with comments as blanks, line ends kept."""
    return _COMMENTS.sub(lambda m: m.group() if m.group(1) else re.sub(r"[^\n]", " ", m.group()), text)


SPECIFIER = "line int, specifier string, kind string, names array<string>"
_SCRIPT = re.compile(r"""(?:^|[;\n}])[ \t]*(?:(import|export)\b([^;'"`]*?)\bfrom\s*|(import)\s*)(["'])([^"'\n]+)\4|\b(require|import)\s*\(\s*(["'])([^"'\n]+)\7\s*\)""")


def script_specifiers(path: str, content: bytes) -> list[tuple]:
    """Module specifiers of imports, re-exports, require and dynamic import."""
    text = _blanked(content.decode("utf-8", "replace"))
    out = []
    for m in _SCRIPT.finditer(text):
        place = m.start(5) if m[5] else m.start(8)
        clause = m[2] or ""
        names = re.findall(r"[A-Za-z_$][\w$]*(?=\s*(?:,|\}|$|as\b))", re.sub(r"\btype\b", " ", clause))
        kind = "side_effect" if m[3] else m[6] if m[6] else "reexport" if m[1] == "export" else "type" if clause.strip().startswith("type ") else "import"
        out.append((text.count("\n", 0, place) + 1, m[5] or m[8], "dynamic" if m[6] == "import" else kind, names))
    return out


_GO_ONE, _GO_MANY = re.compile(r'(?m)^[ \t]*import[ \t]+(?:([\w.]+)[ \t]+)?(?:"([^"\n]+)"|`([^`]+)`)'), re.compile(r"(?m)^[ \t]*import[ \t]*\(([^)]*)\)")


def go_specifiers(path: str, content: bytes) -> list[tuple]:
    """Import paths with the name they are bound to; kind is blank, dot or import."""
    text = _blanked(content.decode("utf-8", "replace"))
    found = [(m.start(), m[1], m[2] or m[3]) for m in _GO_ONE.finditer(text)]
    for block in _GO_MANY.finditer(text):
        found += [(block.start(1) + m.start(2), m[1], m[2]) for m in re.finditer(r'(?:([\w.]+)[ \t]+)?["`]([^"`\n]+)["`]', block[1])]
    kinds = {"_": "blank", ".": "dot"}
    return [(text.count("\n", 0, at) + 1, spec, kinds.get(name or "", "import"), [name or spec.rsplit("/", 1)[-1]]) for at, name, spec in sorted(found)]


def expanded_use(tree: str) -> list[tuple[str, str]]:
    """(path, name) of each leaf of a ``use`` tree; more than the allowed leaves are an error."""
    out: list[tuple[str, str]] = []

    def split(text: str) -> list[str]:
        parts, depth, last = [], 0, 0
        for i, c in enumerate(text):
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                parts.append(text[last:i])
                last = i + 1
        return [p for p in (*parts, text[last:]) if p.strip()]

    def walk(text: str, above: str) -> None:
        text = text.strip()
        brace = text.find("{")
        if brace >= 0:
            base = above + text[:brace].strip()
            for part in split(text[brace + 1 : text.rfind("}")]):
                walk(part, base)
            return
        path, _, name = (x.strip() for x in text.partition(" as "))
        path = (above + path).removesuffix("::self")
        out.append((path, name or path.rsplit("::", 1)[-1]))
        if len(out) > MAX_USE_LEAVES:
            raise ValueError("a use tree has too many leaves")

    walk(re.sub(r"\s+", " ", tree), "")
    return out


_USE = re.compile(r"(?m)(?:^|[;{}]|\n)[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:use[ \t\n]+([^;]+);|extern[ \t]+crate[ \t]+(\w+)(?:[ \t]+as[ \t]+(\w+))?[ \t]*;|mod[ \t]+(\w+)[ \t]*;)")


def rust_specifiers(path: str, content: bytes) -> list[tuple]:
    """Paths that ``use``, ``extern crate`` and ``mod`` name, use trees written out."""
    text = _blanked(content.decode("utf-8", "replace"))
    out = []
    for m in _USE.finditer(text):
        line = text.count("\n", 0, m.start(m.lastindex)) + 1
        if m[1]:
            out += [(line, p, "glob" if n == "*" else "use", [n]) for p, n in expanded_use(m[1])]
        elif m[2]:
            out.append((line, m[2], "extern_crate", [m[3] or m[2]]))
        else:
            out.append((line, f"self::{m[4]}", "mod", [m[4]]))
    return out
