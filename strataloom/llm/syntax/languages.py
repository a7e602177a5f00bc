"""The languages: their tables with lexers and the conditions that their grammars name."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from strataloom.llm.syntax import grammars
from strataloom.llm.syntax.lexers import BAD, GoLexer, PythonLexer, RustLexer, ScriptLexer
from strataloom.llm.syntax.tables import Grammar, Table


class _Conditions(dict):
    """Conditions by name; each gives the next token's index, or -1 where it doesn't hold.

    ``kinds`` is filled once the table has numbered them.
    """

    def __init__(self):
        super().__init__()
        self.kinds: dict[str, int] = {}
        self["&always"] = lambda k, i, n, p: i

    def numbers(self, words: str) -> frozenset[int]:
        return frozenset(self.kinds[w] for w in words.split() if w in self.kinds)

    def here(self, words: str, wanted: bool = True) -> Callable:
        """The token here is (or isn't) one of ``words``."""
        return self._looking(0, words, wanted)

    def next(self, words: str, wanted: bool = True) -> Callable:
        return self._looking(1, words, wanted)

    def _looking(self, by: int, words: str, wanted: bool) -> Callable:
        found: list[frozenset[int]] = []

        def check(k, i, n, p):
            if not found:
                found.append(self.numbers(words))
            at = i + by
            return i if ((k[at] if at < len(k) else 0) in found[0]) == wanted else -1

        return check


def _go() -> tuple[Table, Callable]:
    c = _Conditions()
    c["&closing"] = c.here(") }")
    c["&label"] = c.next(":")
    def names(k, i, n, p):
        # What := declares are names, behind each other.
        x, j = c.kinds, i - 1
        while k[j] == x["IDENT"] and k[j - 1] == x[","]:
            j -= 2
        return i if k[j] == x["IDENT"] and k[j - 1] not in after else -1

    c["&names"] = names
    c["&literal"] = lambda k, i, n, p: i if k[i - 1] == c.kinds["IDENT"] or k[i - 1] == c.kinds["]"] else -1
    table = Table(Grammar(grammars.GO), "File", c)
    c.kinds = table.kinds
    after = c.numbers(". + - * & ^ ! ~ <- | BINOP")
    lexer = GoLexer(table.kinds)
    return table, lambda text, path, exact=False: (not exact and lexer.quick(text)) or lexer.tokens(text)


def _rust() -> tuple[Table, Callable]:
    c = _Conditions()

    def group(k, i, n, p):
        # What is jumped over isn't parsed, but it has to be tokens.
        return p[i] + 1 if p[i] >= 0 and BAD not in k[i : p[i]] else -1

    def group_item(k, i, n, p):
        if p[i] < 0 or BAD in k[i : p[i]]:
            return -1
        after = p[i] + 1
        if k[i] == c.kinds["{"]:
            return after
        return after + 1 if k[after] == c.kinds[";"] else -1

    def macro_statement(k, i, n, p):
        x = c.kinds
        if k[i] != x["IDENT"] or k[i + 1] != x["!"] or k[i + 2] != x["{"] or p[i + 2] < 0:
            return -1
        return -1 if k[p[i + 2] + 1] in (x["."], x["?"]) else i

    def item(k, i, n, p):
        x, a, b = c.kinds, k[i], k[i + 1] if k[i] else 0
        if a in items:
            return i
        if a == x["unsafe"] or a == x["async"]:
            return i if b in (x["fn"], x["trait"], x["impl"], x["extern"], x["unsafe"]) else -1
        if a == x["const"]:
            return -1 if b == x["{"] else i
        return -1

    def struct_literal(k, i, n, p):
        x, a = c.kinds, k[i + 1] if k[i] == c.kinds["{"] else -1
        if a in (x["}"], x[".."], x["#"]):
            return i
        b = k[i + 2] if a > 0 else -1
        return i if a == x["IDENT"] and b in (x[":"], x[","], x["}"]) or a == x["NUMBER"] and b == x[":"] else -1

    c |= {"&group": group, "&groupitem": group_item, "&macrostmt": macro_statement, "&item": item, "&structlit": struct_literal}
    c["&vis"] = c.next("crate self super in")
    c["&closing"] = c.here("} EOF")
    c["&notblock"] = c.here("{", False)
    c["&fieldshort"] = lambda k, i, n, p: i if k[i] == c.kinds["IDENT"] and k[i + 1] != c.kinds[":"] else -1
    after_path = c.next(":: ! ( { ..= ... ..", False)
    c["&binding"] = lambda k, i, n, p: after_path(k, i, n, p) if k[i] == c.kinds["IDENT"] else -1
    table = Table(Grammar(grammars.RUST), "File", c)
    c.kinds = table.kinds
    items = c.numbers("use mod extern struct enum union type static fn trait impl pub macro_rules default auto")
    lexer = RustLexer(table.kinds)
    return table, lambda text, path, exact=False: (not exact and lexer.quick(text)) or lexer.tokens(text)


def _has_jsx(path: str) -> bool:
    return path.endswith((".jsx", ".tsx"))


def _script(typed: bool) -> tuple[Table, Callable]:
    c = _Conditions()
    names: set[int] = set()

    def at(k: list[int], i: int) -> int:
        return k[i] if i < len(k) else 0

    def semi(k, i, n, p):
        x = k[i]
        return i + 1 if x == c.kinds[";"] else i if x == c.kinds["}"] or x == 0 or n[i] else -1

    def arrow(k, i, n, p):
        x, a = c.kinds, k[i]
        if a == x["("]:
            return i if p[i] >= 0 and at(k, p[i] + 1) == x["=>"] else -1
        if a in names:
            if at(k, i + 1) == x["=>"]:
                return i
            if a == x["async"] and not n[i + 1]:
                b = k[i + 1]
                if b in names and at(k, i + 2) == x["=>"]:
                    return i
                if b == x["("]:
                    return i if p[i + 1] >= 0 and at(k, p[i + 1] + 1) == x["=>"] else -1
        return -1

    def arrow_maybe(k, i, n, p):
        x, a = c.kinds, k[i]
        if a == x["async"]:
            i2 = i + 1
            if k[i2] == x.get("<"):
                return i
            a = k[i2]
        else:
            i2 = i
        if a == x["("]:
            return i if p[i2] >= 0 and at(k, p[i2] + 1) == x[":"] else -1
        return i if a == x["<"] else -1

    def function_type(k, i, n, p):
        x, a = c.kinds, k[i]
        if a == x["("]:
            return i if p[i] >= 0 and at(k, p[i] + 1) == x["=>"] else -1
        return i if a == x["<"] or a == x["new"] or a == x["abstract"] and k[i + 1] == x["new"] else -1

    def type_declaration(k, i, n, p):
        x, a, b = c.kinds, k[i], at(k, i + 1)
        if a == x["enum"]:
            return i
        if a in (x["type"], x["interface"]):
            return i if b in names and not n[i + 1] else -1
        if a == x["declare"]:
            return i if b in declared and not n[i + 1] else -1
        if a in (x["namespace"], x["module"]):
            return i if (b in names or b == x["STRING"]) and not n[i + 1] else -1
        return i if a == x["global"] and b == x["{"] else -1

    def type_import(k, i, n, p):
        x, b = c.kinds, at(k, i + 1)
        if b == x["from"] and at(k, i + 2) == x["STRING"]:
            return -1
        return i if b in names or b in (x["{"], x["*"]) else -1

    def labelled(k, i, n, p):
        x = c.kinds
        return i if at(k, i + 1) == x[":"] or at(k, i + 1) == x["?"] and at(k, i + 2) == x[":"] else -1

    def mapped(k, i, n, p):
        x, j = c.kinds, i + 1
        if at(k, j) in (x["+"], x["-"]):
            j += 1
        if at(k, j) == x["readonly"]:
            j += 1
        return i if at(k, j) == x["["] and at(k, j + 1) in names and at(k, j + 2) == x["in"] else -1

    def after_types(k, i, n, p):
        return i if k[i] in calls or n[i] or k[i] not in operands else -1

    def expression_start(k, i, n, p):
        x, a = c.kinds, k[i]
        return -1 if a in (x["{"], x["function"], x["class"]) or a == x["let"] and k[i + 1] == x["["] else i

    def opener(k: list[int], i: int) -> int:
        """The opening bracket of the closing one at ``i``."""
        depth = 0
        while i >= 0:
            if k[i] in closing:
                depth += 1
            elif k[i] in opening:
                depth -= 1
                if not depth:
                    return i
            i -= 1
        return -1

    def target(k, i, n, p):
        # What is assigned to isn't a literal, a call or part of a larger expression.
        x, j = c.kinds, i - 1
        if k[i] != x["="] and k[i] != x["ASSIGN"]:
            return i
        while True:
            a, b = k[j], k[j - 1] if j else 0
            if b == x["."] or b == x["?."]:
                if b == x["?."] and j == i - 1:
                    return -1
                j -= 2
                a = k[j]
                if a in words:
                    if j and k[j - 1] in (x["."], x["?."]):
                        continue
                    break
                if a in (x[")"], x["]"], x["}"]):
                    j = opener(k, j)
                    if j > 0 and (k[j - 1] in words or k[j - 1] in (x[")"], x["]"])) and k[j - 1] not in blocks:
                        j -= 1
                        continue
                break
            if a in literals:
                return -1
            if a == x[")"]:
                j = opener(k, j)
                if j > 0 and j != i - 1 and (k[j - 1] in names or k[j - 1] in (x[")"], x["]"])) and not n[j]:
                    return -1
                return i
            if a == x["]"]:
                j = opener(k, j)
                if j > 0 and (k[j - 1] in words or k[j - 1] in (x[")"], x["]"])) and not n[j] and k[j - 1] not in blocks:
                    j -= 1
                    if k[j] in (x[")"], x["]"]):
                        return i
                    continue
                return i
            break
        before = k[j - 1] if j > 0 else 0
        return -1 if before in operators and not (n[j] and before in steps) else i

    def owner(k: list[int], brace: int) -> int:
        """The word that a block belongs to, 0 if it stands alone, -1 for a function or what may be one."""
        x = c.kinds
        b = k[brace - 1] if brace else 0
        if not brace or b in (x[";"], x["{"], x["}"]):
            return 0
        if b in (x["else"], x["do"], x["try"], x["finally"]):
            return b
        if b == x[")"]:
            j = opener(k, brace - 1)
            word = k[j - 1] if j > 0 else 0
            return word if word in blocks and k[j - 2 if j > 1 else 0] != x["."] else -1
        return -1

    def enclosed(wanted: frozenset[int], functions: bool) -> Callable:
        def check(k, i, n, p):
            x = c.kinds
            if not functions and (k[i - 1] not in (x[";"], x["{"], x["}"]) or not i or k[i + 1] in names and not n[i + 1]):
                return i
            brace = p.around(i, jumps)
            while brace >= 0:
                found = owner(k, brace)
                if found == -1:
                    # A function's body, or what isn't known to be none.
                    return i if functions or k[brace - 1] not in (x["=>"], x[")"]) else -1
                if found in wanted:
                    return i
                if not functions and found:
                    # A loop without a brace may stand before the word.
                    j = brace - 1 if found in (x["else"], x["do"], x["try"], x["finally"]) else opener(k, brace - 1) - 1
                    if j > 0 and k[j - 1] not in (x[";"], x["{"], x["}"]):
                        return i
                brace = p.around(brace, jumps)
            return -1

        return check

    sameline = lambda k, i, n, p: -1 if n[i] else i
    c |= {"&semi": semi, "&arrow": arrow, "&arrowmaybe": arrow_maybe, "&fntype": function_type, "&typedecl": type_declaration, "&typeimport": type_import, "&labelled": labelled, "&mapped": mapped, "&aftertypes": after_types, "&exprstart": expression_start, "&sameline": sameline}
    c["&target"] = target
    for name in ("&inloop", "&inswitch", "&infunction"):
        c[name] = lambda k, i, n, p, name=name: within[name](k, i, n, p)
    c["&anysemi"] = lambda k, i, n, p: i + 1 if k[i] == c.kinds[";"] else i
    c["&exprnotdecl"] = c.here("function class", False)
    c["&label"] = c.next(":")
    c["&asyncfn"] = lambda k, i, n, p: i if at(k, i + 1) == c.kinds["function"] and not n[i + 1] else -1
    c["&importdecl"] = c.next("( .", False)
    c["&typespec"] = lambda k, i, n, p: i if k[i] == c.kinds["type"] and at(k, i + 1) not in c.numbers(", } as") else -1
    c["&braceorstar"] = c.next("{ *")
    c["&nextclass"] = c.next("class")
    c["&nameafter"] = lambda k, i, n, p: i if at(k, i + 1) in names and not n[i + 1] else -1
    c["&isafter"] = lambda k, i, n, p: i if at(k, i + 1) == c.kinds["is"] and not n[i + 1] else -1
    c["&staticblock"] = c.next("{")
    c["&paramafter"] = c.next(", ) ? : =", False)
    c["&memberafter"] = c.next("( = ; } : ? ! < , EOF", False)
    c["&propafter"] = c.next("( : , } = < EOF", False)
    c["&indexsig"] = lambda k, i, n, p: i if k[i] == c.kinds["["] and at(k, i + 1) in names and at(k, i + 2) == c.kinds[":"] else -1
    c["&shorthand"] = c.next(", } =")
    c["&typeafter"] = c.next(", ) ; } = | & > ] : ? . < => EOF extends is", False)
    c["&typeend"] = lambda k, i, n, p: i if n[i] or k[i] == c.kinds["}"] else -1
    c["&typesep"] = c["&always"]
    table = Table(Grammar(grammars.SCRIPT, ("&ts",), () if typed else ("&ts",)), "File", c)
    c.kinds = table.kinds
    by_number = {v: k for k, v in table.kinds.items()}
    reserved = frozenset("var const if else for while do continue break return throw try catch finally switch case default debugger import export function class extends in instanceof typeof void delete new this super null true false enum with".split())
    names |= {v for v, k in by_number.items() if k == "IDENT" or k.isalpha() and k.islower() and k not in reserved}
    declared = c.numbers("var let const function async abstract class type interface enum namespace module global")
    calls = c.numbers("( TEMPLATE TEMPLATE_HEAD")
    opening, closing = c.numbers("( [ {"), c.numbers(") ] }")
    words = frozenset(v for k, v in table.kinds.items() if k in ("IDENT", "KEYWORD", "PRIVATE") or k.isalpha() and k.islower())
    literals = c.numbers("NUMBER STRING REGEX TEMPLATE TEMPLATE_TAIL null true false this super")
    operators = c.numbers("BINOP UNOP + - * | & ! typeof void delete await instanceof ++ --" + ("" if typed else " < >"))
    steps = c.numbers("++ --")
    blocks = c.numbers("if for while switch catch with")
    jumps = c.numbers("return break continue")
    loops = c.numbers("for while do")
    within = {"&inloop": enclosed(loops, False), "&inswitch": enclosed(loops | c.numbers("switch"), False), "&infunction": enclosed(frozenset(), True)}
    operands = names | c.numbers("NUMBER STRING REGEX this super null true false [ { function class new import PRIVATE JSX_OPEN ! + - typeof void delete ++ -- UNOP")
    lexer = ScriptLexer(table.kinds, typed)
    return table, lambda text, path, exact=False: (not exact and lexer.quick(text, _has_jsx(path))) or lexer.tokens(text, _has_jsx(path))


def _python() -> tuple[Table, Callable]:
    c = _Conditions()

    def closed(k: list[int], i: int, end: int) -> int:
        """The closing bracket of the opening one at ``i``, before ``end``."""
        depth = 0
        for j in range(i, end):
            depth += (k[j] in opening) - (k[j] in closing)
            if not depth:
                return j
        return end

    def one(k: list[int], a: int, b: int, plain: bool) -> bool:
        """Whether tokens ``a`` to ``b`` are one target; ``plain`` ones are no lists of targets."""
        x = c.kinds
        if not plain and k[a] == x["*"]:
            a += 1
        if a >= b:
            return False
        last, j = k[a], a + 1
        if k[a] in opening:
            j = closed(k, a, b) + 1
            if j >= b:
                if k[a] == x["{"]:
                    return False
                return one(k, a + 1, b - 1, True) if plain and k[a] == x["("] else not plain and several(k, a + 1, b - 1)
            last = -1
        elif k[a] != x["IDENT"]:
            if k[a] not in atoms:
                return False
            last = -1
        while j < b:
            if k[j] == x["."]:
                last, j = x["IDENT"], j + 2
            elif k[j] == x["["] or k[j] == x["("]:
                last = x["IDENT"] if k[j] == x["["] else -1
                j = closed(k, j, b) + 1
            else:
                return False
        return last == x["IDENT"]

    def several(k: list[int], a: int, b: int) -> bool:
        x, start, depth = c.kinds, a, 0
        for j in range(a, b):
            if k[j] in opening:
                depth += 1
            elif k[j] in closing:
                depth -= 1
            elif not depth and k[j] == x[","]:
                if not one(k, start, j, False):
                    return False
                start = j + 1
        return start >= b and b >= a or one(k, start, b, False)

    def assigned(plain: bool) -> Callable:
        def check(k, i, n, p):
            x, j, depth = c.kinds, i - 1, 0
            if plain and k[i] != x["AUGMENTED"] and k[i] != x[":"] or not plain and k[i] != x["="]:
                return i
            while j >= 0:
                a = k[j]
                if a in closing:
                    depth += 1
                elif a in opening:
                    depth -= 1
                elif not depth and a in edges:
                    break
                j -= 1
            if not plain and k[j + 1] == x["yield"]:
                return -1
            return i if (one(k, j + 1, i, True) if plain else several(k, j + 1, i)) else -1

        return check

    c["&single"], c["&targets"] = assigned(True), assigned(False)
    c["&walrus"] = c.next(":=")
    c["&kwarg"] = c.next("=")
    table = Table(Grammar(grammars.PYTHON), "File", c)
    c.kinds = table.kinds
    opening, closing, edges = c.numbers("( [ {"), c.numbers(") ] }"), c.numbers("NEWLINE INDENT DEDENT ; = :")
    atoms = c.numbers("STRINGS NUMBER None True False ...")
    lexer = PythonLexer(table.kinds)
    return table, lambda text, path, exact=False: (not exact and lexer.quick(text)) or lexer.tokens(text)


@lru_cache(maxsize=None)
def parser(language: str) -> tuple[Table, Callable]:
    """The table and lexer of a language, built once in each process."""
    return {"go": _go, "rust": _rust, "python": _python, "javascript": lambda: _script(False), "typescript": lambda: _script(True)}[language]()


def first_error(language: str, path: str, content: bytes) -> tuple[int, int, str] | None:
    """Line and column (from 1) and message of the first unrecoverable error, or None if valid.

    An empty content and a leading byte order mark are valid. Bytes that aren't UTF-8 are an
    error where they stand. What Python's formatted strings hold is parsed by the same table.
    """
    if content.startswith(b"\xef\xbb\xbf"):
        content = content[3:]
    if not content.strip():
        return None
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        at = content[: e.start].decode("utf-8", "replace")
        if language != "python" or not _CODING.match(content):
            return (*_place(at, len(at)), "not UTF-8")
        text = content.decode("latin-1")
    table, lexer = parser(language)
    tokens = lexer(text, path.lower())
    failed = table.parse(tokens.kinds, tokens.newline, tokens.partner)
    if failed >= 0 and not tokens.starts:
        tokens = lexer(text, path.lower(), True)
        failed = table.parse(tokens.kinds, tokens.newline, tokens.partner)
    if failed >= 0:
        return _reported(text, tokens, failed)
    if language == "python":
        for literal in tokens.strings:
            problem = _formatted(literal.lstrip(" \t\f"))
            if problem:
                return (*_place(text, text.find(literal)), problem)
        at = text.find("\0")
        if at >= 0:
            return (*_place(text, at), "null character")
    return None


#: A Python source that names its own encoding in one of its first two lines.
_CODING = re.compile(rb"(?:[^\n]*\n)?[ \t\f]*#[^\n]*?coding[:=][ \t]*[-\w.]+")


def _place(text: str, offset: int) -> tuple[int, int]:
    before = text[:offset]
    return before.count("\n") + 1, len(before) - (before.rfind("\n") + 1) + 1


def _reported(text: str, tokens, failed: int) -> tuple[int, int, str]:
    start = tokens.starts[min(failed, len(tokens.starts) - 1)]
    found = re.match(r"\S{0,24}", text[start : start + 40]).group() or "end of file"
    return (*_place(text, start), f"unexpected {found}")


_PREFIX = re.compile(r"([A-Za-z]{0,2})(\"{3}|'{3}|[\"'])")


def _formatted(literal: str) -> str | None:
    """What is wrong with the fields of a formatted string, None for other strings."""
    m = _PREFIX.match(literal)
    if not m or not {"f", "t"} & set(m[1].lower()):
        return None
    body = literal[m.end() : len(literal) - len(m[2])]
    return _fields(body.replace("\\N", "\\n") if "r" in m[1].lower() else body, False)


@lru_cache(maxsize=50_000)
def _fields(body: str, spec: bool) -> str | None:
    """What is wrong with the fields in a formatted string's body, or in a field's format."""
    i, n = 0, len(body)
    while i < n:
        c = body[i]
        if c == "\\" and not spec:
            named = body.find("}", i) if body.startswith("\\N{", i) else -1
            i = named + 1 if named > 0 else i + (1 if body[i + 1 : i + 2] in ("{", "}") else 2)
            continue
        if c in "{}" and body[i : i + 2] == c + c and not spec:
            i += 2
            continue
        if c == "}":
            return "single } in a formatted string"
        if c != "{":
            i += 1
            continue
        start = i = i + 1
        depth, quote = 0, ""
        while i < n:
            c = body[i]
            if quote:
                if c == "\\":
                    i += 1
                elif body.startswith(quote, i):
                    i += len(quote) - 1
                    quote = ""
            elif c in "\"'":
                quote = body[i : i + 3] if body[i : i + 3] == 3 * c else c
                i += len(quote) - 1
            elif c in "([{":
                depth += 1
            elif depth and c in ")]}":
                depth -= 1
            elif not depth and (c in "}:" or c == "!" and body[i + 1 : i + 2] != "="):
                break
            i += 1
        expression = body[start:i].rstrip()
        if expression.endswith("=") and not expression.endswith(("==", "!=", "<=", ">=")):
            expression = expression[:-1]
        if i >= n or not expression.strip() or not _expression(expression.strip()):
            return "invalid expression in a formatted string"
        if body[i] == "!":
            m = re.compile(r"![rsa]\s*(?=[:}])").match(body, i)
            if not m:
                return "invalid conversion in a formatted string"
            i = m.end()
        if body[i] == ":":
            start, depth = i + 1, 0
            while i + 1 < n:
                i += 1
                if body[i] == "{":
                    depth += 1
                elif body[i] == "}":
                    if not depth:
                        break
                    depth -= 1
            if i >= n or body[i] != "}" or depth:
                return "unclosed field in a formatted string"
            problem = _fields(body[start:i], True)
            if problem:
                return problem
        i += 1
    return None


@lru_cache(maxsize=50_000)
def _expression(text: str) -> bool:
    table, lexer = parser("python")
    tokens = lexer(f"({text}\n)", "", True)
    return table.parse(tokens.kinds, tokens.newline, tokens.partner) < 0 and not any(map(_formatted, tokens.strings))
