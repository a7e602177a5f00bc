"""Python: declarations, imports, exports, bindings and calls, out of the interpreter's syntax tree.

Offsets are bytes. A file that doesn't parse gives nothing but the problem.
"""

from __future__ import annotations

import ast
import re
import warnings

from strataloom.parsing.observed import Seen

_CONSTANT = re.compile(r"[A-Z][A-Z0-9_]*\Z")
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def static_path(node: ast.expr) -> tuple[str, ...] | None:
    """The names of ``a.b.c``, or None for anything else."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return (node.id, *reversed(names)) if isinstance(node, ast.Name) else None


def statements(node: ast.AST) -> list[ast.stmt]:
    """The statements right inside a compound statement, all its branches in order."""
    out = [x for name in ("body", "orelse", "finalbody") for x in getattr(node, name, []) if isinstance(x, ast.stmt)]
    for part in (*getattr(node, "handlers", ()), *getattr(node, "cases", ())):
        out += part.body
    return out


def read_python(language: str, content: bytes) -> list[Seen]:
    text = content.replace(b"\r\n", b" \n") if b"\r\n" in content else content
    text = text.replace(b"\r", b"\n") if b"\r" in text else text
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    starts = [0]
    at = text.find(b"\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find(b"\n", at + 1)
    # A byte order mark isn't counted in columns.
    mark = 3 if text.startswith(b"\xef\xbb\xbf") else 0
    size = len(content)

    def a(node: ast.AST) -> int:
        return starts[node.lineno - 1] + node.col_offset + (mark if node.lineno == 1 else 0)

    def b(node: ast.AST) -> int:
        return starts[node.end_lineno - 1] + node.end_col_offset + (mark if node.end_lineno == 1 else 0)

    def cut(start: int, end: int) -> str:
        return content[start:end].decode("utf-8", "replace")

    seen: list[Seen] = []
    imports: list[Seen] = []
    exports: dict[str, Seen] = {}

    def bind(name: str, kind: str, node: ast.AST, scope: tuple[int, int], active: int) -> None:
        seen.append(Seen("binding", name, kind, a(node), b(node), inner=scope, active=active))

    def targets(node: ast.AST, scope: tuple[int, int]) -> None:
        for x in ast.walk(node):
            if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                bind(x.id, "value", x, scope, a(x))

    def visit(body: list[ast.stmt], parent: str | None, container: bool, scope: tuple[int, int], top: bool, conditional: bool) -> None:
        for node in body:
            if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
                is_class = isinstance(node, ast.ClassDef)
                kind = "class" if is_class else "method" if container else "function"
                start = min([a(node), *(a(d) - 1 for d in node.decorator_list)])
                names = tuple(p[-1] for d in node.decorator_list if (p := static_path(d.func if isinstance(d, ast.Call) else d)))
                qualified = f"{parent}.{node.name}" if parent else node.name
                seen.append(Seen("symbol", node.name, kind, start, b(node), qualified, text=cut(a(node), b(node)).split("\n", 1)[0].strip().rstrip(":"), doc=(ast.get_docstring(node, False) or "").strip(), decorators=names))
                whole = (start, b(node))
                if not container:
                    bind(node.name, kind, node, scope, b(node))
                if top:
                    exports[node.name] = Seen("export", node.name, kind, start, b(node))
                inner = (a(node.body[0]), b(node))
                if not is_class:
                    seen.append(Seen("owner", None, kind, start, b(node), inner=inner))
                    if not container:
                        bind(node.name, kind, node, whole, inner[0])
                    args = node.args
                    for x in (*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))):
                        bind(x.arg, "value", x, whole, a(x))
                visit(node.body, qualified, is_class, whole if not is_class else scope, False, False)
                continue
            if isinstance(node, (ast.Import, ast.ImportFrom)):
                start, end = a(node), b(node)
                module = node.module or "" if isinstance(node, ast.ImportFrom) else ""
                level = node.level if isinstance(node, ast.ImportFrom) else 0
                for x in node.names:
                    if isinstance(node, ast.Import):
                        local, kind, specifier, imported = x.asname or x.name.split(".")[0], "module", x.name, None
                    else:
                        kind = "glob" if x.name == "*" else "symbol"
                        local, specifier, imported = None if kind == "glob" else x.asname or x.name, "." * level + module, x.name
                    s = Seen("import", local, kind, start, end, inner=scope, text=cut(start, end), imported=imported, specifier=specifier, module_level=top, form="conditional" if conditional else None, metadata={"level": level, "aliased": bool(x.asname)})
                    seen.append(s)
                    imports.append(s)
                    if top:
                        exports[local or f"*{specifier}"] = Seen("export", local or "*", "reexport", start, end, imported=imported, specifier=specifier)
            elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                listed = node.targets if isinstance(node, ast.Assign) else [node.target]
                for t in listed:
                    if not (container and isinstance(t, ast.Name)):
                        targets(t, scope)
                    if isinstance(t, ast.Name) and _CONSTANT.match(t.id) and not isinstance(node, ast.AugAssign):
                        seen.append(Seen("symbol", t.id, "constant", a(node), b(node), f"{parent}.{t.id}" if parent else t.id, text=cut(a(node), b(node)).split("\n", 1)[0].strip()))
                        if top:
                            exports[t.id] = Seen("export", t.id, "constant", a(node), b(node))
            else:
                for x in ("target", "items", "optional_vars"):
                    found = getattr(node, x, None)
                    for y in found if isinstance(found, list) else [found] if found else []:
                        targets(y, scope)
                visit(statements(node), parent, container, scope, top, True)

    visit(tree.body, None, False, (0, size), True, False)
    by_name: dict[str, list[Seen]] = {}
    for s in imports:
        if s.name:
            by_name.setdefault(s.name, []).append(s)
    shadows: dict[str, list[Seen]] = {}
    for s in seen:
        if s.what == "binding" and s.name in by_name:
            shadows.setdefault(s.name, []).append(s)
    covered: set[ast.AST] = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            path = static_path(node.func)
            form = "dynamic" if path is None else "identifier" if len(path) == 1 else "static_path"
            seen.append(Seen("call", path[-1] if path else None, None, a(node), b(node), inner=(a(node.func), b(node.func)), text=cut(a(node.func), b(node.func)), path=path or (), form=form))
        if isinstance(node, (ast.Attribute, ast.Name)) and node not in covered and isinstance(node.ctx, ast.Load):
            path = static_path(node)
            if path and path[0] in by_name:
                x: ast.AST = node
                while isinstance(x, ast.Attribute):
                    x = x.value
                    covered.add(x)
                at = a(node)
                near = [s for s in by_name[path[0]] if s.inner[0] <= at < s.inner[1]]
                width = min((s.inner[1] - s.inner[0] for s in near), default=size)
                hidden = any(h.inner[0] <= at < h.inner[1] and h.active <= at and h.inner[1] - h.inner[0] <= width for h in shadows.get(path[0], ()))
                if near:
                    kind = "shadowed" if hidden else "unsupported" if any(s.form == "conditional" for s in near) else "bound"
                    seen.append(Seen("reference", path[0], kind, at, b(node), text=cut(at, b(node)), path=path))
    return [*seen, *exports.values()]
