"""Control files: go.mod and go.work, package.json, tsconfig.json and Cargo.toml."""

from __future__ import annotations

import json
import re
import tomllib

MAX_BYTES, MAX_DIRECTIVES = 1 << 20, 10_000


class ManifestError(ValueError):
    """A control file that can't be used; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _text(content: bytes) -> str:
    if len(content) > MAX_BYTES:
        raise ManifestError("CONTROL_FILE_TOO_LARGE", f"{len(content)} bytes")
    return content.decode("utf-8")


def go_mod(content: bytes) -> dict:
    """module, requires, replaces (local paths only) and uses of a go.mod or go.work."""
    out: dict = {"module": None, "require": [], "replace": {}, "use": []}
    block, count = "", 0
    for line in _text(content).splitlines():
        line = re.sub(r"//.*$", "", line).strip()
        if not line:
            continue
        count += 1
        if count > MAX_DIRECTIVES:
            raise ManifestError("TOO_MANY_DIRECTIVES", f"more than {MAX_DIRECTIVES}")
        if line == ")":
            block = ""
            continue
        if m := re.match(r"(\w+)\s*\($", line):
            block = m[1]
            continue
        verb, rest = (block, line) if block else (line.split(None, 1) + [""])[:2]
        parts = [p.strip("\"`") for p in rest.split()]
        if verb == "module" and parts:
            out["module"] = parts[0]
        elif verb == "require" and parts:
            out["require"].append(parts[0])
        elif verb == "use" and parts:
            out["use"].append(parts[0])
        elif verb == "replace" and "=>" in parts:
            at = parts.index("=>")
            if parts[at + 1 :] and parts[at + 1].startswith((".", "/")):
                out["replace"][parts[0]] = parts[at + 1]
    return out


_JSONC = re.compile(r'("(?:[^"\\\n]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/')


def strip_jsonc(text: str) -> str:
    """JSON with comments and trailing commas, as JSON."""
    plain = _JSONC.sub(lambda m: m[1] or " ", text)
    return re.sub(r'("(?:[^"\\\n]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", plain)


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ManifestError("DUPLICATE_KEY", "a key is repeated")
    return out


def _not_finite(x: str) -> float:
    raise ManifestError("NON_FINITE_NUMBER", x)


def bounded_json(text: str, depth: int = 16, longest: int = 4096) -> object:
    """JSON without repeated keys, non-finite numbers, deep nesting or very long strings."""
    try:
        value = json.loads(text, object_pairs_hook=_no_repeats, parse_constant=_not_finite)
    except RecursionError as e:
        raise ManifestError("TOO_DEEP", str(e)) from e
    todo = [(value, 1)]
    while todo:
        x, d = todo.pop()
        if d > depth:
            raise ManifestError("TOO_DEEP", f"deeper than {depth}")
        if isinstance(x, str) and len(x) > longest:
            raise ManifestError("STRING_TOO_LONG", f"longer than {longest}")
        if isinstance(x, dict):
            todo += [(v, d + 1) for v in (*x.keys(), *x.values())]
        elif isinstance(x, list):
            todo += [(v, d + 1) for v in x]
    return value


def package_json(content: bytes) -> dict:
    """name, type, entry points, export and import maps and workspaces of a package.json."""
    found = bounded_json(_text(content))
    if not isinstance(found, dict):
        raise ManifestError("NOT_AN_OBJECT", "package.json")
    spaces = found.get("workspaces") or []
    return {k: found.get(k) for k in ("name", "type", "main", "module", "types", "exports", "imports")} | {"workspaces": spaces.get("packages", []) if isinstance(spaces, dict) else spaces}


def tsconfig(content: bytes) -> dict:
    """extends and the options about modules of a tsconfig.json or jsconfig.json."""
    found = bounded_json(strip_jsonc(_text(content)))
    options = found.get("compilerOptions") or {} if isinstance(found, dict) else {}
    keys = ("baseUrl", "paths", "rootDirs", "rootDir", "outDir", "module", "moduleResolution", "moduleSuffixes", "customConditions", "plugins", "resolveJsonModule")
    return {"extends": found.get("extends"), **{k: options[k] for k in keys if k in options}}


def inherited(configs: dict[str, dict], path: str, most: int = 32) -> dict:
    """The options at ``path`` over those that it extends, nearest first; a cycle or too long a chain is an error."""
    chain, seen = [], set()
    while path:
        if path in seen or len(chain) >= most:
            raise ManifestError("EXTENDS_CHAIN", path)
        seen.add(path)
        chain.append(configs[path])
        path = configs[path].get("extends") or ""
    out: dict = {}
    for c in reversed(chain):
        out |= {k: v for k, v in c.items() if k != "extends"}
    return out


def package_target(field: object, key: str, conditions: set[str]) -> str | None:
    """What ``key`` maps to in an export or import map: exact keys first, then the longest pattern.

    Conditions are tried in the order of the document. Targets lie inside the package.
    """
    table = field if isinstance(field, dict) and any(str(k).startswith((".", "#")) for k in field) else {".": field}
    chosen, star = table.get(key), ""
    if chosen is None:
        fits = [k for k in table if k.count("*") == 1 and key.startswith(k.split("*")[0]) and key.endswith(k.split("*")[1]) and len(key) >= len(k) - 1]
        if not fits:
            return None
        best = max(fits, key=lambda k: (len(k.split("*")[0]), k))
        head, tail = best.split("*")
        chosen, star = table[best], key[len(head) : len(key) - len(tail)]

    def pick(x: object) -> str | None:
        if isinstance(x, str):
            return x
        if isinstance(x, list):
            return next((t for t in map(pick, x) if t), None)
        if isinstance(x, dict):
            return next((t for k, v in x.items() if k in conditions or k == "default" for t in [pick(v)] if t), None)
        return None

    target = pick(chosen)
    if target is None or not target.startswith("./") or ".." in target.split("/") or "node_modules" in target.split("/"):
        return None
    return target.replace("*", star)


def cargo(content: bytes) -> dict:
    """Package, edition, targets, dependencies and workspace of a Cargo.toml."""
    try:
        found = tomllib.loads(_text(content))
    except tomllib.TOMLDecodeError as e:
        raise ManifestError("INVALID_TOML", str(e)) from e
    package = found.get("package") or {}
    deps = {}
    for table in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, spec in (found.get(table) or {}).items():
            deps[name.replace("-", "_")] = {"package": spec.get("package", name) if isinstance(spec, dict) else name, "path": spec.get("path") if isinstance(spec, dict) else None}
    return {"name": package.get("name"), "edition": package.get("edition", "2015"), "lib": found.get("lib"), "bin": found.get("bin") or [], "autobins": package.get("autobins", True), "dependencies": deps, "workspace": found.get("workspace")}


def cargo_targets(manifest: dict, directory: str, paths: set[str]) -> list[tuple[str, str, str]]:
    """(kind, crate name, root file) of a package's targets: explicit ones, then those found by their places."""
    at = lambda p: f"{directory}/{p}" if directory else p
    name = (manifest["name"] or "").replace("-", "_")
    out: dict[tuple[str, str], str] = {}
    lib = manifest["lib"] or {}
    if lib:
        out["lib", (lib.get("name") or name).replace("-", "_")] = at(lib.get("path", "src/lib.rs"))
    for b in manifest["bin"]:
        if b.get("name"):
            out["bin", b["name"].replace("-", "_")] = at(b.get("path", f"src/bin/{b['name']}.rs"))
    if manifest["autobins"] and not (manifest["edition"] == "2015" and (lib or manifest["bin"])):
        found = [("lib", name, at("src/lib.rs")), ("bin", name, at("src/main.rs"))]
        prefix = at("src/bin/")
        found += [("bin", p[len(prefix) :].removesuffix("/main.rs").removesuffix(".rs").replace("-", "_"), p) for p in sorted(paths) if p.startswith(prefix) and (p.count("/", len(prefix)) == 0 and p.endswith(".rs") or p.endswith("/main.rs"))]
        for kind, crate, path in found:
            out.setdefault((kind, crate), path)
    return [(kind, crate, path) for (kind, crate), path in out.items() if path in paths]


def workspace_members(patterns: list[str], directories: set[str]) -> list[str]:
    """Directories that a workspace's patterns name; those after '!' are taken out."""
    from strataloom.functions.text import glob_pattern

    chosen: set[str] = set()
    for p in patterns:
        rule = re.compile(glob_pattern(p.lstrip("!").strip("/").removeprefix("./")))
        hit = {d for d in directories if rule.match(d)}
        chosen = chosen - hit if p.startswith("!") else chosen | hit
    return sorted(chosen)
