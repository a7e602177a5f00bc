"""JavaScript, TypeScript, Go and Rust: declarations, imports, exports, bindings and calls.

A text becomes tokens with one pattern; brackets are matched, and one pass over the tokens reads
what begins at a declaring word. What isn't understood is passed over, so files that don't parse
still give what can be read.
"""

from __future__ import annotations

import re

from strataloom.parsing.observed import Seen

_TOKEN = {
    "script": re.compile(r"""(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>"(?:[^"\\\n]|\\[\s\S])*"?|'(?:[^'\\\n]|\\[\s\S])*'?|`(?:[^`\\]|\\[\s\S])*`?)|(?P<w>[\w$\#@]+)|(?P<p>\?\.(?!\d)|=>|\.\.\.|[^\s\w])"""),
    "go": re.compile(r"""(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>"(?:[^"\\\n]|\\.)*"?|`[^`]*`?|'(?:[^'\\\n]|\\.)*'?)|(?P<w>\w+)|(?P<p>:=|<-|\.\.\.|[^\s\w])"""),
    "rust": re.compile(r"""(?P<c>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<s>b?r(?P<h>\#*)"[\s\S]*?"(?P=h)|b?"(?:[^"\\]|\\[\s\S])*"?|b?'(?:[^'\\\n]|\\[^\n]{1,8})')|(?P<w>(?:r\#)?\w+|'\w+)|(?P<p>::|->|=>|\.\.[.=]?|[^\s\w])"""),
}
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_CONSTANT = re.compile(r"[A-Z][A-Z0-9_]*\Z")
_NAME = re.compile(r"[^\W\d][\w$]*\Z")
_SCRIPT_KEYWORDS = frozenset("if for while switch catch with function return typeof await else do super import new in of instanceof void delete yield case throw class extends const let var default async get set static export this null true false try finally break continue".split())
_GO_KEYWORDS = frozenset("if for switch select return func go defer range case else var const type struct interface map chan import package break continue goto fallthrough default".split())
_RUST_KEYWORDS = frozenset("if for while loop match return fn let mut ref in as use mod pub impl trait struct enum const static type where unsafe async await move else break continue crate super self Self dyn extern".split())


class Reader:
    """Tokens of one text, their brackets, and what was seen."""

    def __init__(self, language: str, text: str):
        self.language, self.text = language, text
        family = language if language in ("go", "rust") else "script"
        self.words: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.kinds: list[str] = []
        self.comments: list[tuple[int, int, int]] = []  # token they stand before, start, end
        for m in _TOKEN[family].finditer(text):
            k = "s" if m["s"] is not None else "c" if m["c"] is not None else "w" if m["w"] is not None else "p"
            if k == "c":
                self.comments.append((len(self.words), m.start(), m.end()))
                continue
            self.words.append(m.group())
            self.kinds.append(k)
            self.starts.append(m.start())
            self.ends.append(m.end())
        self.partner = [-1] * len(self.words)
        waiting: list[int] = []
        for i, w in enumerate(self.words):
            if self.kinds[i] == "p":
                if w in _PAIRS:
                    waiting.append(i)
                elif w in ")]}" and waiting and _PAIRS[self.words[waiting[-1]]] == w:
                    j = waiting.pop()
                    self.partner[i], self.partner[j] = j, i
        self.seen: list[Seen] = []
        self.heads: set[int] = set()  # where declared functions are named
        self.size = len(text)

    # Looking around

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.words) and self.kinds[i] == "w" and _NAME.match(self.words[i]) is not None

    def after(self, i: int) -> int:
        """The token behind the bracket at ``i``, or behind the text if it has no partner."""
        return self.partner[i] + 1 if self.partner[i] > i else len(self.words)

    def end_of(self, i: int) -> int:
        """Where the bracket at ``i`` is closed, as an offset."""
        return self.ends[self.partner[i]] if self.partner[i] > i else self.size

    def newline_before(self, i: int) -> bool:
        return i == 0 or "\n" in self.text[self.ends[i - 1] : self.starts[i]]

    def find(self, i: int, wanted: str, stop: str = ";}") -> int:
        """The first token from ``i`` on that is one of ``wanted``, past brackets; -1 at one of ``stop``."""
        while i < len(self.words):
            w = self.words[i]
            if self.kinds[i] == "p":
                if w in wanted:
                    return i
                if w in stop:
                    return -1
                if w in _PAIRS:
                    i = self.after(i)
                    continue
            i += 1
        return -1

    def statement_end(self, i: int) -> int:
        """Offset behind the statement that goes on at ``i``: a semicolon or a line's end outside brackets."""
        last = self.ends[i - 1] if i else 0
        while i < len(self.words):
            w = self.words[i]
            if w == ";":
                return self.ends[i]
            if w in (")", "]", "}") and self.kinds[i] == "p" or self.newline_before(i) and w not in (".", "?.", "=>", "+", "-", "*", "/", "?", ":", "&", "|", "=", ",") and self.word(i - 1) not in ("=", "=>", ",", "+", "&", "|", "?", ":", "(", "."):
                return last
            if w in _PAIRS and self.kinds[i] == "p":
                last = self.end_of(i)
                i = self.after(i)
                continue
            last = self.ends[i]
            i += 1
        return last

    def line_of(self, start: int) -> str:
        return self.text[start:].split("\n", 1)[0].rstrip(":").strip()

    def doc(self, i: int) -> str:
        """The comments right in front of token ``i``, cleaned."""
        near = [c for c in self.comments if c[0] == i]
        lines: list[str] = []
        below = self.starts[i] if i < len(self.starts) else self.size
        for _, a, b in reversed(near):
            if self.text[b:below].count("\n") > 1:
                break
            lines.insert(0, self.text[a:b])
            below = a
        return clean_comment("\n".join(lines))

    # Telling

    def symbol(self, name: str, kind: str, start: int, end: int, parent: str | None, i: int, decorators: tuple = (), metadata: dict | None = None) -> str:
        qualified = f"{parent}.{name}" if parent else name
        self.seen.append(Seen("symbol", name, kind, start, end, qualified, text=self.line_of(start), doc=self.doc(i), decorators=decorators, metadata=metadata or {}))
        return qualified

    def bind(self, name: str, kind: str, start: int, end: int, scope: tuple[int, int], active: int) -> None:
        self.seen.append(Seen("binding", name, kind, start, end, inner=scope, active=active))

    def owner(self, kind: str, start: int, end: int, body: tuple[int, int]) -> None:
        self.seen.append(Seen("owner", None, kind, start, end, inner=body))

    def parameters(self, i: int, scope: tuple[int, int]) -> None:
        """The names in the parameter list that opens at ``i``."""
        j, stop = i + 1, self.after(i) - 1
        first = True
        while j < stop:
            w = self.words[j]
            if self.language == "rust":
                if self.named(j) and self.word(j + 1) == ":" and w not in _RUST_KEYWORDS:
                    self.bind(w, "value", self.starts[j], self.ends[j], scope, scope[0])
                    while j < stop and self.words[j] != ",":
                        j = self.after(j) if self.words[j] in _PAIRS else j + 1
            elif first and self.named(j) and w not in _SCRIPT_KEYWORDS:
                self.bind(w, "value", self.starts[j], self.ends[j], scope, scope[0])
                first = False
            if w == ",":
                first = True
            elif w in _PAIRS and not first:
                j = self.after(j)
                continue
            j += 1

    def calls(self, keywords: frozenset[str], imports: dict[str, Seen]) -> None:
        """Call sites, and references that begin with the name of an import."""
        step = "::" if self.language == "rust" else "."
        bindings = [s for s in self.seen if s.what == "binding"]
        declared = {s.start for s in bindings}
        shadows: dict[str, list[Seen]] = {}
        for b in bindings:
            if b.name in imports:
                shadows.setdefault(b.name, []).append(b)
        i, n = 0, len(self.words)
        while i < n:
            w = self.words[i]
            if self.kinds[i] == "w" and self.named(i) and (w not in keywords or w == "this" and self.word(i + 1) == ".") and self.word(i - 1) not in (".", "?.", "::"):
                path, j = [w], i
                while self.word(j + 1) in (step, ".") and self.word(j + 2) and self.named(j + 2):
                    path.append(self.words[j + 2])
                    j += 2
                before, after = self.word(i - 1), self.word(j + 1)
                key = self.language in ("javascript", "typescript") and after == ":" and before in ("{", ",")
                from_import = imports.get(w)
                if from_import and self.starts[i] not in declared and not key and not (from_import.start <= self.starts[i] < from_import.end):
                    hidden = any(b.inner[0] <= self.starts[i] < b.inner[1] and b.active <= self.starts[i] for b in shadows.get(w, ()))
                    self.seen.append(Seen("reference", w, "shadowed" if hidden else "bound", self.starts[i], self.ends[j], text=self.text[self.starts[i] : self.ends[j]], path=tuple(path)))
                if after == "(" and before not in ("function", "func", "fn", "new") and self.starts[i] not in declared and self.starts[i] not in self.heads and not self.newline_before(j + 1):
                    self._call(i, j, j + 1, "identifier" if len(path) == 1 else "static_path", tuple(path))
                i = j + 1
                continue
            if w == "(" and self.kinds[i] == "p" and i and not self.newline_before(i):
                before = self.words[i - 1]
                if self.kinds[i - 1] == "p" and before in (")", "]") and self.partner[i - 1] >= 0:
                    head = self.word(self.partner[i - 1] - 1)
                    if head not in keywords and head not in ("func", "fn", "function") and not (before == ")" and self.word(self.partner[i - 1] - 2) in ("func", "function", "fn")) and self.kinds[max(self.partner[i - 1] - 1, 0)] == "w":
                        self._call(self.partner[i - 1] - 1, i - 1, i, "dynamic", ())
                elif self.kinds[i - 1] == "w" and self.word(i - 2) in (".", "?.") and self.named(i - 1) and before not in keywords:
                    j = i - 3
                    chained = j >= 0 and (self.words[j] in (")", "]") or self.word(i - 2) == "?." or self.kinds[j] == "s")
                    if chained:
                        self._call(self.partner[j] - 1 if self.words[j] in (")", "]") and self.partner[j] > 0 else j, i - 1, i, "dynamic", ())
            i += 1

    def _call(self, first: int, last: int, bracket: int, form: str, path: tuple[str, ...]) -> None:
        first = max(first, 0)
        callee = (self.starts[first], self.ends[last])
        self.seen.append(Seen("call", path[-1] if path else None, None, callee[0], self.end_of(bracket), inner=callee, text=self.text[callee[0] : callee[1]], path=path, form=form))


def clean_comment(raw: str) -> str:
    """A comment's text without its marks: lines of line comments, one line of a block."""
    raw = raw.strip()
    if raw.startswith("/*"):
        body = re.sub(r"\*/\Z", "", re.sub(r"\A/\*\*?", "", raw)).strip()
        return " ".join(x.strip() for x in (re.sub(r"^\s*\*\s?", "", line) for line in body.split("\n")) if x.strip())
    return "\n".join(x.strip() for x in (re.sub(r"^\s*///?!?\s?", "", line) for line in raw.split("\n")) if x.strip())


def _unquoted(text: str) -> str:
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'`" else text


# JavaScript and TypeScript


def read_script(language: str, text: str) -> list[Seen]:
    r = Reader(language, text)
    typed = language == "typescript"
    whole = (0, r.size)
    imports: dict[str, Seen] = {}
    #: (end token, qualified name, scope, container)
    around: list[tuple[int, str | None, tuple[int, int], bool]] = [(len(r.words) + 1, None, whole, False)]
    i, n = 0, len(r.words)
    exported = default = False
    made: tuple[str, str] | None

    def function(i: int, start: int, name: str, kind: str, bracket: int, parent: str | None, scope: tuple[int, int], at: int) -> int:
        """A function whose parameters open at ``bracket``; the next token to look at, inside its body."""
        behind = r.after(bracket)
        body = r.find(behind, "{", ";}") if r.word(behind) != "{" else behind
        end = r.end_of(body) if body >= 0 else r.statement_end(behind)
        qualified = r.symbol(name, kind, start, end, parent, at, tuple(decorators(at)))
        inner = (r.starts[bracket], end)
        if kind == "function":
            r.bind(name, "function", start, end, scope, scope[0])
        if body >= 0:
            r.owner(kind, start, end, (r.starts[body], end))
            around.append((r.partner[body] if r.partner[body] >= 0 else n, qualified, inner, False))
        r.parameters(bracket, inner)
        return bracket + 1

    def decorators(at: int) -> list[str]:
        out, j = [], at - 1
        while r.word(j) in ("export", "default", "declare", "abstract"):
            j -= 1
        while j >= 0:
            if r.words[j] == ")" and r.partner[j] > 0:
                j = r.partner[j] - 1
            while j >= 2 and r.words[j - 1] == "." and r.kinds[j] == "w" and not r.words[j].startswith("@"):
                name_end = j
                j -= 2
                if r.words[j].startswith("@"):
                    out.insert(0, r.words[name_end])
                    break
            else:
                if not r.words[j].startswith("@"):
                    break
                out.insert(0, r.words[j][1:])
            j -= 1
        return out

    while i < n:
        while len(around) > 1 and i >= around[-1][0]:
            around.pop()
        w, (_, parent, scope, container) = r.words[i], around[-1]
        top = len(around) == 1
        begins = i == 0 or r.word(i - 1) in (";", "{", "}") or exported or r.words[i - 1].startswith("@") or r.newline_before(i) and r.word(i - 1) not in ("=", "(", ",", ":", "?", "[", "&", "|", "+", "=>", "return", ".", "?.", "!")
        if r.kinds[i] != "w" or not begins and not (container and r.partner[i] < 0 and r.word(i - 1) in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "*", ")")):
            i += 1
            continue
        if container:
            # A member: a name, then perhaps type parameters, then parameters and a body.
            j = i
            while r.word(j) in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "accessor", "declare") and r.word(j + 1) not in ("(", "=", ";", ":", "?"):
                j += 1
            j += r.word(j) == "*"
            k = j + 1
            if r.word(k) == "?":
                k += 1
            if r.word(k) == "<":
                k = next((x + 1 for x in range(k, min(n, k + 60)) if r.words[x] == ">" and r.word(x + 1) == "("), k)
            if r.kinds[j] == "w" and r.word(k) == "(":
                body = r.find(r.after(k), "{", ";}") if r.word(r.after(k)) != "{" else r.after(k)
                if body >= 0 and not (r.newline_before(body) and r.word(r.after(k)) not in ("{", ":")):
                    r.heads.add(r.starts[j])
                    i = function(i, r.starts[i], r.words[j], "method", k, parent, scope, i)
                    continue
            m = r.find(j, ";", "}")
            nxt = next((x for x in range(j + 1, n) if r.newline_before(x) and x > r.partner[j]), n)
            i = j + 1 if m < 0 else min(m, max(nxt, j + 1))
            continue
        start = i
        if w == "import" and top and r.word(i + 1) not in ("(", "."):
            i = _script_import(r, i, imports)
            continue
        if w == "export" and not top and (i == 0 or r.text[r.starts[i] - 1] == "\n"):
            # Exports are of the module; at a line's start it is brackets before that aren't closed.
            del around[1:]
            continue
        if w == "export" and top:
            nxt = r.word(i + 1)
            if nxt in ("{", "*") or nxt == "type" and r.word(i + 2) in ("{", "*"):
                i = _script_reexport(r, i)
                continue
            exported, default = True, nxt == "default"
            i += 1 + default
            if default and r.word(i) not in ("function", "class", "async", "abstract"):
                named = r.words[i] if r.named(i) and r.word(i + 1) in (";", "") else None
                r.seen.append(Seen("export", "default", "expression", r.starts[i], r.statement_end(i), imported=named))
                exported = default = False
            continue
        if w in ("declare", "abstract", "async") and r.kinds[i + 1 : i + 2] == ["w"]:
            i += 1
        w = r.word(i)
        name_at = i + 1 + (r.word(i + 1) == "*")
        name = r.word(name_at)
        made = None
        at_end = i + 1
        if w == "function":
            bracket = r.find(name_at, "(", ";}")
            if bracket >= 0:
                own = name if r.named(name_at) else ""
                made = (own or "default", "function")
                at_end = function(i, r.starts[start], own or "default", "function", bracket, parent, scope, start) if own else bracket + 1
        elif w == "class":
            body = r.find(i, "{", ";")
            if body >= 0 and r.named(name_at):
                end = r.end_of(body)
                qualified = r.symbol(name, "class", r.starts[start], end, parent, start, tuple(decorators(start)))
                r.bind(name, "class", r.starts[start], end, scope, scope[0])
                made, at_end = (name, "class"), body + 1
                around.append((r.partner[body] if r.partner[body] >= 0 else n, qualified, (r.starts[body], end), True))
        elif typed and w == "interface" and r.named(name_at):
            body = r.find(i, "{", ";")
            if body >= 0:
                r.symbol(name, "interface", r.starts[start], r.end_of(body), parent, start)
                made, at_end = (name, "interface"), r.after(body)
        elif typed and w == "type" and r.named(name_at) and r.word(name_at + 1) in ("=", "<"):
            end = r.statement_end(name_at)
            r.symbol(name, "type", r.starts[start], end, parent, start)
            made = (name, "type")
        elif w in ("const", "let", "var"):
            j = i + 1
            while j < n:
                if r.words[j] in ("{", "["):
                    for x in range(j + 1, r.after(j) - 1):
                        if r.named(x) and r.word(x + 1) != ":" and r.words[x] not in _SCRIPT_KEYWORDS:
                            r.bind(r.words[x], "value", r.starts[x], r.ends[x], scope, scope[0])
                    break
                if not r.named(j):
                    break
                eq = r.find(j, "=,", ";}")
                value = eq + 1 if eq >= 0 and r.words[eq] == "=" else j + 1
                arrow = r.word(value) == "function" or r.word(value + (r.word(value) == "async")) == "(" and r.word(r.after(value + (r.word(value) == "async"))) in ("=>", ":")
                end = r.statement_end(value)
                end -= r.text[end - 1 : end] in (";", ",")
                r.bind(r.words[j], "function" if arrow else "value", r.starts[j], end, scope, scope[0])
                if _CONSTANT.match(r.words[j]):
                    r.symbol(r.words[j], "constant", r.starts[j], end, parent, start)
                if exported:
                    r.seen.append(Seen("export", r.words[j], "constant", r.starts[j], end))
                comma = r.find(value, ",", ";}")
                if comma < 0 or r.starts[comma] > end + 1:
                    break
                j = comma + 1
        if made and exported:
            last = next((s for s in reversed(r.seen) if s.what == "symbol" and s.name == made[0]), None)
            r.seen.append(Seen("export", "default" if default else made[0], made[1], last.start if last else r.starts[start], last.end if last else r.ends[i], imported=made[0] if default else None))
        exported = default = False
        i = max(at_end, start + 1)
    r.calls(_SCRIPT_KEYWORDS, imports)
    return r.seen


def _script_import(r: Reader, i: int, imports: dict[str, Seen]) -> int:
    j = i + 1
    type_only = r.word(j) == "type" and r.word(j + 1) not in ("from", ",", "=")
    j += type_only
    stop = next((x for x in range(j, min(len(r.words), j + 4000)) if r.kinds[x] == "s"), -1)
    if stop < 0:
        return i + 1
    specifier, start, end = _unquoted(r.words[stop]), r.starts[i], r.ends[stop]
    text = r.text[start:end]

    def add(local, imported, kind, only):
        s = Seen("import", local, kind, start, end, inner=(0, r.size), text=text, imported=imported, specifier=specifier, type_only=only)
        r.seen.append(s)
        if local:
            imports[local] = s

    if stop == j:
        add(None, None, "side_effect", False)
        return stop + 1
    while j < stop:
        w = r.words[j]
        if w == "*" and r.word(j + 1) == "as":
            add(r.word(j + 2), None, "namespace", type_only)
            j += 3
        elif w == "{":
            for a, b in _specifiers(r, j):
                only = a[:1] == ["type"] and len(a) > 1
                a = a[only:]
                add((b or a)[-1], a[0], "symbol", type_only or only)
            j = r.after(j)
        elif r.named(j) and w != "from":
            add(w, "default", "symbol", type_only)
            j += 1
        else:
            j += 1
    return stop + 1


def _specifiers(r: Reader, i: int) -> list[tuple[list[str], list[str]]]:
    """Names and aliases of the list in braces at ``i``."""
    out, now, alias = [], [], None
    for x in range(i + 1, r.after(i) - 1):
        w = _unquoted(r.words[x])
        if w == ",":
            if now:
                out.append((now, alias or []))
            now, alias = [], None
        elif w == "as" and now:
            alias = []
        elif alias is not None:
            alias.append(w)
        else:
            now.append(w)
    return out + ([(now, alias or [])] if now else [])


def _script_reexport(r: Reader, i: int) -> int:
    j = i + 1
    type_only = r.word(j) == "type"
    j += type_only
    close = r.after(j) if r.words[j] == "{" else j + 1
    star = None
    if r.words[j] == "*" and r.word(j + 1) == "as":
        star, close = r.word(j + 2), j + 3
    source = r.words[close + 1] if r.word(close) == "from" and close + 1 < len(r.words) else None
    end = r.ends[close + 1] if source else r.ends[min(close - 1, len(r.ends) - 1)]
    start, specifier = r.starts[i], _unquoted(source) if source else None
    pairs = [(None, star, "namespace" if star else "glob")] if r.words[j] == "*" else [(a[-1], (b or a)[-1], "symbol") for a, b in _specifiers(r, j)]
    for name, exported, kind in pairs:
        if specifier is not None:
            r.seen.append(Seen("import", None, kind, start, end, inner=(0, r.size), text=r.text[start:end], imported=name, exported=exported, specifier=specifier, type_only=type_only))
        r.seen.append(Seen("export", exported or "*", "reexport" if specifier is not None else "local", start, end, imported=name, specifier=specifier, type_only=type_only))
    return close + (2 if source else 0)


# Go


def read_go(language: str, text: str) -> list[Seen]:
    r = Reader("go", text)
    whole, imports = (0, r.size), {}
    around: list[tuple[int, str | None, tuple[int, int]]] = [(len(r.words) + 1, None, whole)]
    i, n = 0, len(r.words)
    while i < n:
        while len(around) > 1 and i >= around[-1][0]:
            around.pop()
        if r.words[i] in ("func", "type", "import") and r.kinds[i] == "w" and (not r.starts[i] or r.text[r.starts[i] - 1] == "\n"):
            del around[1:]  # at a line's start these are the package's, whatever wasn't closed before
        w, (_, parent, scope) = r.words[i], around[-1]
        top = len(around) == 1
        begins = i == 0 or r.newline_before(i) or r.word(i - 1) in (";", "{", "}")
        if w == "package" and top and begins and r.named(i + 1):
            r.seen.append(Seen("export", r.words[i + 1], "package", r.starts[i], r.ends[i + 1]))
            i += 2
        elif w == "import" and top and begins:
            spec = i + 1
            last = r.after(spec) - 1 if r.word(spec) == "(" else spec + 2
            j = spec + (r.word(spec) == "(")
            while j < min(last, n):
                alias = r.words[j] if r.kinds[j] == "w" or r.words[j] in (".", "_") else None
                j += alias is not None
                if j < n and r.kinds[j] == "s":
                    specifier = _unquoted(r.words[j])
                    start = r.starts[j - 1] if alias else r.starts[j]
                    local = alias or specifier.rsplit("/", 1)[-1]
                    kind = "glob" if alias == "." else "side_effect" if alias == "_" else "namespace"
                    s = Seen("import", None if alias in (".", "_") else local, kind, start, r.ends[j], inner=whole, text=r.text[start : r.ends[j]], specifier=specifier, metadata={"deferred": alias is None})
                    r.seen.append(s)
                    if s.name:
                        imports[s.name] = s
                j += 1
                if r.word(spec) != "(":
                    break
            i = max(j, i + 1)
        elif w == "func" and top and begins:
            method = r.word(i + 1) == "("
            name_at = r.after(i + 1) if method else i + 1
            bracket = r.find(name_at + 1, "(", "{};") if r.word(name_at + 1) != "(" else name_at + 1
            if not r.named(name_at) or bracket < 0:
                i += 1
                continue
            j = r.after(bracket)
            if r.word(j) == "(":
                j = r.after(j)
            while j < n and r.words[j] != "{" and not r.newline_before(j):
                j = r.after(j) if r.words[j] in ("(", "[") else r.after(j + 1) if r.words[j] in ("interface", "struct") and r.word(j + 1) == "{" else j + 1
            body = j if r.word(j) == "{" else -1
            end = r.end_of(body) if body >= 0 else r.ends[min(j, n) - 1]
            receiver = next((x for x in reversed(r.words[i + 2 : r.after(i + 1) - 1]) if _NAME.match(x)), None) if method else None
            name = r.words[name_at]
            r.heads.add(r.starts[name_at])
            # Methods keep their own name; the receiver is told beside it.
            r.symbol(name, "method" if method else "function", r.starts[i], end, parent, i, metadata={"receiver": receiver} if method else None)
            r.bind(name, "method" if method else "function", r.starts[i], end, whole if not method else (r.starts[i], end), 0 if not method else r.starts[i])
            if not method:
                r.seen.append(Seen("export", name, "function", r.starts[i], end))
            inner = (r.starts[bracket], end)
            if method:
                r.parameters(i + 1, inner)
            r.parameters(bracket, inner)
            if body >= 0:
                r.owner("method" if method else "function", r.starts[i], end, (r.starts[body], end))
                around.append((r.partner[body] if r.partner[body] >= 0 else n, name, inner))
            i = bracket + 1
        elif w in ("type", "const", "var") and begins:
            grouped = r.word(i + 1) == "("
            j, last = (i + 2, r.after(i + 1) - 1) if grouped else (i + 1, n)
            fresh = True
            while j < min(last, n):
                if fresh and r.named(j):
                    stop = j + 1
                    while stop < min(last, n) and not (r.newline_before(stop) and r.word(stop - 1) not in (",", "=")) and r.words[stop] != ";":
                        stop = r.after(stop) if r.words[stop] in _PAIRS else stop + 1
                    start, end = r.starts[j], r.ends[min(stop, n) - 1]
                    kind = {"type": "type", "const": "constant", "var": "value"}[w]
                    if w != "var":
                        r.symbol(r.words[j], kind, start, end, parent, i if not grouped else j)
                    r.bind(r.words[j], kind if kind != "constant" else "value", start, end, scope, scope[0] if top else r.starts[j])
                    if top and w != "var":
                        r.seen.append(Seen("export", r.words[j], kind, start, end))
                    j = stop
                    if not grouped:
                        break
                    continue
                j += 1
            i = max(j, i + 1) if w != "var" else i + 1
        else:
            if w == ":=" and r.named(i - 1):
                k = i - 1
                while k > 0 and r.named(k):
                    if r.words[k] != "_":
                        r.bind(r.words[k], "value", r.starts[k], r.ends[k], scope, r.starts[k])
                    if r.word(k - 1) != ",":
                        break
                    k -= 2
            i += 1
    r.calls(_GO_KEYWORDS, imports)
    return r.seen


# Rust


def read_rust(language: str, text: str) -> list[Seen]:
    r = Reader("rust", text)
    whole, imports = (0, r.size), {}
    #: (end token, parent name, scope, container, modules, cfg)
    around: list[tuple] = [(len(r.words) + 1, None, whole, False, (), False)]
    i, n = 0, len(r.words)
    pending: list[tuple[str, bool]] = []  # attributes before an item: name, whether it is a condition
    while i < n:
        while len(around) > 1 and i >= around[-1][0]:
            around.pop()
        w, (_, parent, scope, container, modules, cfg) = r.words[i], around[-1]
        if w == "#" and r.word(i + 1) in ("[", "!"):
            b = i + 1 + (r.word(i + 1) == "!")
            if r.word(b) == "[":
                r.heads.update(r.starts[x] for x in range(b, r.after(b) - 1))
                if r.word(i + 1) == "[":
                    pending.append((r.word(b + 1), r.word(b + 1) in ("cfg", "cfg_attr")))
                i = r.after(b)
                continue
        first = i
        visibility, where = "private", None
        if w == "pub":
            visibility = "pub"
            i += 1
            if r.word(i) == "(" and r.word(i + 1) in ("crate", "self", "super", "in"):
                where = "".join(r.words[i + 1 : r.after(i) - 1])
                visibility = f"pub({where})" if r.word(i + 1) != "in" else f"pub(in {''.join(r.words[i + 2 : r.after(i) - 1])})"
                i = r.after(i)
        while r.word(i) in ("default", "async", "unsafe", "const", "extern") and r.word(i + 1) in ("fn", "unsafe", "async", "extern", "impl", "trait") or r.word(i) == "extern" and i + 1 < n and r.kinds[i + 1] == "s" and r.word(i + 2) == "fn":
            i += 2 if r.word(i) == "extern" and r.kinds[i + 1] == "s" else 1
        w = r.word(i)
        conditional = cfg or any(c for _, c in pending)
        meta = {"visibility": visibility, "lexical_module_path": list(modules), "configuration": "declared_possible" if conditional else "unconditional"}
        marks = tuple(a for a, _ in pending)
        start = r.starts[first] if first < n else r.size
        if w == "fn" and r.named(i + 1):
            bracket = r.find(i + 2, "(", "{};")
            if bracket < 0:
                i += 1
                continue
            j = r.after(bracket)
            while j < n and r.words[j] not in ("{", ";"):
                j = r.after(j) if r.words[j] in ("(", "[") else j + 1
            body = j if r.word(j) == "{" else -1
            end = r.end_of(body) if body >= 0 else r.ends[min(j, n - 1)]
            kind = "method" if container else "function"
            qualified = r.symbol(r.words[i + 1], kind, start, end, parent, first, marks, meta)
            r.bind(r.words[i + 1], kind, start, end, scope if not container else (start, end), scope[0] if not container else start)
            if not container and parent is None:
                r.seen.append(Seen("export", r.words[i + 1], "function", start, end, metadata=meta))
            inner = (r.starts[bracket], end)
            r.parameters(bracket, inner)
            if body >= 0:
                r.owner(kind, start, end, (r.starts[body], end))
                around.append((r.partner[body] if r.partner[body] >= 0 else n, qualified, inner, False, modules, conditional))
            i, pending = bracket + 1, []
        elif w in ("struct", "enum", "trait", "union") and r.named(i + 1):
            j = i + 2
            while j < n and r.words[j] not in ("{", ";"):
                j = r.after(j) if r.words[j] in ("(", "[") else j + 1
            end = r.end_of(j) if r.word(j) == "{" else r.ends[min(j, n - 1)]
            kind = "struct" if w == "union" else w
            r.symbol(r.words[i + 1], kind, start, end, parent, first, marks, meta)
            r.bind(r.words[i + 1], kind, start, end, scope, scope[0])
            if parent is None:
                r.seen.append(Seen("export", r.words[i + 1], kind, start, end, metadata=meta))
            if w == "trait" and r.word(j) == "{":
                around.append((r.partner[j] if r.partner[j] >= 0 else n, r.words[i + 1], (r.starts[j], end), False, modules, conditional))
                i = j + 1
            else:
                i = r.after(j) if r.word(j) == "{" else j + 1
            pending = []
        elif w == "impl" and (first == 0 or r.word(first - 1) in (";", "}", "{", "]")):
            body = r.find(i, "{", ";}")
            if body < 0:
                i += 1
                continue
            k = i + 1
            if r.word(k) == "<":
                depth = 0
                while k < body:
                    depth += (r.words[k] == "<") - (r.words[k] == ">")
                    k += 1
                    if not depth:
                        break
            line = r.words[k:body]
            line = line[: line.index("where")] if "where" in line else line
            of = line[line.index("for") + 1 :] if "for" in line else line
            name_at = k + (line.index("for") + 1 if "for" in line else 0)
            name = r.text[r.starts[name_at] : r.ends[k + len(line) - 1]] if of else ""
            end = r.end_of(body)
            qualified = r.symbol(name, "impl", start, end, parent, first, marks, meta) if name else parent
            around.append((r.partner[body] if r.partner[body] >= 0 else n, qualified, (r.starts[body], end), True, modules, conditional))
            i, pending = body + 1, []
        elif w == "mod" and r.named(i + 1):
            name = r.words[i + 1]
            inline = r.word(i + 2) == "{"
            s = Seen("import", name, "module", start, r.ends[min(i + 2, n - 1)] if not inline else r.starts[i + 2], inner=whole, text=r.text[start : r.ends[i + 1]], specifier="::".join((*modules, name)), metadata={**meta, "form": "inline_module" if inline else "module"})
            r.seen.append(s)
            r.bind(name, "module", start, s.end, scope, scope[0])
            r.seen.append(Seen("export", name, "module", start, s.end, metadata=meta))
            if inline:
                around.append((r.partner[i + 2] if r.partner[i + 2] >= 0 else n, parent, (r.starts[i + 2], r.end_of(i + 2)), False, (*modules, name), conditional))
            i, pending = i + 3, []
        elif w == "use" or w == "extern" and r.word(i + 1) == "crate":
            stop = r.find(i, ";", "}")
            stop = n - 1 if stop < 0 else stop
            end = r.ends[stop]
            if w == "extern":
                name = r.word(i + 2)
                leaves = [((name,), r.word(i + 4) if r.word(i + 3) == "as" else name, "crate")]
            else:
                leaves = [(*x, "symbol") for x in use_leaves(r.words[i + 1 : stop])]
            for path, local, kind in leaves:
                kind = "glob" if path[-1] == "*" else kind
                s = Seen("import", None if kind == "glob" or local == "_" else local, kind, start, end, inner=scope, text=r.text[start:end], path=path, imported=path[-1], specifier="::".join(path), exported=local if visibility != "private" else None, metadata={**meta, "form": "extern_crate" if w == "extern" else "use"})
                r.seen.append(s)
                if s.name:
                    imports[s.name] = s
                if visibility != "private":
                    r.seen.append(Seen("export", local if kind != "glob" else "*", "reexport", start, end, imported=path[-1], specifier="::".join(path), metadata=meta))
            i, pending = stop + 1, []
        elif w in ("const", "static") and r.named(i + 1) and r.word(i + 2) == ":" or w == "static" and r.word(i + 1) == "mut":
            at = i + 1 + (r.word(i + 1) == "mut")
            stop = r.find(i, ";", "}")
            end = r.ends[stop if stop >= 0 else n - 1]
            if w == "const":
                r.symbol(r.word(at), "constant", start, end, parent, first, marks, meta)
                if parent is None:
                    r.seen.append(Seen("export", r.word(at), "constant", start, end, metadata=meta))
            r.bind(r.word(at), "value", start, end, scope, scope[0])
            i, pending = (stop if stop >= 0 else n - 1) + 1, []
        elif w == "type" and r.named(i + 1):
            stop = r.find(i, ";", "}")
            if parent is None and stop >= 0:
                r.seen.append(Seen("export", r.words[i + 1], "type", start, r.ends[stop], metadata=meta))
            i, pending = i + 2, []
        elif w == "let":
            j = i + 1 + (r.word(i + 1) == "mut")
            if r.named(j):
                r.bind(r.words[j], "value", r.starts[j], r.ends[j], scope, r.ends[j])
            i += 1
        else:
            if w not in ("", "{"):
                pending = []
            i += 1
    r.calls(_RUST_KEYWORDS - {"crate", "super", "self", "Self"}, imports)
    return r.seen


def use_leaves(words: list[str]) -> list[tuple[tuple[str, ...], str]]:
    """Paths and local names of a use tree's leaves; ``self`` stands for its own path."""
    out: list[tuple[tuple[str, ...], str]] = []
    stack: list[tuple[str, ...]] = [()]
    now: list[str] = []
    alias: str | None = None
    i = 0

    def leaf() -> None:
        nonlocal now, alias
        if now:
            path = (*stack[-1], *now)
            if path[-1] == "self" and len(path) > 1:
                path = path[:-1]
            out.append((path, alias or path[-1]))
        now, alias = [], None

    while i < len(words):
        w = words[i]
        if w == "{":
            stack.append((*stack[-1], *now))
            now = []
        elif w == "}":
            leaf()
            if len(stack) > 1:
                stack.pop()
        elif w == ",":
            leaf()
        elif w == "as":
            alias = words[i + 1] if i + 1 < len(words) else None
            i += 1
        elif w != "::":
            now.append(w)
        i += 1
    leaf()
    return out


READERS = {"javascript": read_script, "typescript": read_script, "go": read_go, "rust": read_rust}
