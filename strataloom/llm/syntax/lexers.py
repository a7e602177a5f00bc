"""Token kinds of source texts, for the parse tables.

Each lexer gives lists: kinds (ending with 0), starts of the tokens, whether a line ends before
each, and for brackets the index of the partner. Text that is no token of the language becomes
a token of the kind -1, which no rule accepts.

``quick`` gives the same kinds without the starts: it takes all tokens with one call of the
pattern and their kinds from a bounded memo of token texts. It gives None for texts that need
more than that (regular expressions, JSX, nested comments, words that are keywords only in some
places), and ``tokens`` then serves. Starts are wanted only where there is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

BAD = -1
#: Tokens of Rust that only macros hold.
MACRO_ONLY = -9
_OPEN = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Tokens:
    kinds: list[int]
    starts: list[int]
    newline: list[bool]
    partner: Partners | list
    #: Python's strings that hold braces, for those that are formatted.
    strings: list[str] = field(default_factory=list)


class _Memo(dict):
    """Kind by token text, found by ``classify`` and kept while the memo is small."""

    def __init__(self, fixed: dict[str, int], classify):
        super().__init__(fixed)
        self.fixed, self.classify = dict(fixed), classify

    def __missing__(self, text: str) -> int:
        kind = self.classify(text)
        if len(text) < 40:
            if len(self) > 300_000:
                self.clear()
                self.update(self.fixed)
            self[text] = kind
        return kind


class Partners:
    """Indexes of closing brackets by those of opening ones (else -1), found when first asked for.

    Wrong nesting ends the search: what is open there has no partner.
    """

    def __init__(self, kinds: list[int], table: dict[str, int]):
        self.kinds, self.table, self.found, self.braces = kinds, table, None, None

    def __getitem__(self, i: int) -> int:
        if self.found is None:
            t = self.table
            close = {t[a]: t[b] for a, b in _OPEN.items()}
            ends, waiting = frozenset(close.values()), []
            self.found = found = [-1] * len(self.kinds)
            for j, k in enumerate(self.kinds):
                if k in close:
                    waiting.append(j)
                elif k in ends:
                    if not waiting or close[self.kinds[waiting[-1]]] != k:
                        break
                    found[waiting.pop()] = j
        return self.found[i]


    def around(self, i: int, asked: frozenset[int]) -> int:
        """The innermost brace that is open at token ``i`` (one of the kinds ``asked``, or a brace), or -1."""
        if self.braces is None:
            t, self.braces, waiting = self.table, {}, [-1]
            for j, k in enumerate(self.kinds):
                if k == t["{"]:
                    self.braces[j] = waiting[-1]
                    waiting.append(j)
                elif k == t["}"]:
                    if len(waiting) > 1:
                        waiting.pop()
                elif k in asked:
                    self.braces[j] = waiting[-1]
        return self.braces.get(i, -1)


# What the memos say of texts that aren't tokens of the grammar.
_SKIP, _LINE, _SKIP_LINES, _SLOW, _PARTS = -10, -11, -12, -13, -14


# Operators that only stand between operands.
_BINARY = frozenset("|| && == != === !== < > <= >= / % << >> >>> &^ ** ?? // -> and or".split())
_ASSIGN = frozenset("+= -= *= /= %= &= |= ^= <<= >>= &^= **= >>>= &&= ||= ??= //= @=".split())


def _grouped(lead: str, parts: tuple[str, ...]) -> re.Pattern:
    """Tokens with a group for each part."""
    return re.compile(lead + "(?:" + "|".join(f"({x})" for x in parts) + ")")


def _flat(lead: str, parts: tuple[str, ...]) -> re.Pattern:
    """Tokens with one group around whichever part it is."""
    return re.compile(lead + "(" + "|".join(f"(?:{x})" for x in parts) + ")")


class GoLexer:
    _LEAD = r"[ \t\r]*"
    _PARTS = (
        r"\n",
        r"//[^\n]*",
        r"/\*[\s\S]*?\*/",
        r"[^\W\d]\w*",
        r'"(?:[^"\\\n]|\\.)*"|`[^`]*`',
        r"""'(?:\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|[abfnrtv\\'"])|[^'\\\n])'""",
        r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)i?",
        r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~]",
        r"\S",
    )
    _TOKEN, _ALL = _grouped(_LEAD, _PARTS), _flat(_LEAD, _PARTS)
    _ENDS = frozenset(("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))

    def __init__(self, table: dict[str, int]):
        self.table = table
        self.names = {k: v for k, v in table.items() if k.isalpha() and k.islower()}
        self.memo = _Memo({"\n": _LINE}, self._kind)
        self.ending = frozenset(table[x] for x in (*self._ENDS, "IDENT", "STRING", "CHAR", "NUMBER"))

    def _kind(self, word: str) -> int:
        t, c = self.table, word[0]
        if c == "/" and word[1:2] in ("/", "*"):
            return _SKIP if word[1] == "/" or "\n" not in word else _LINE
        if c == "_" or c.isalpha():
            return self.names.get(word, t["IDENT"]) if word.isidentifier() else BAD
        if c in "\"`'" and len(word) > 1:
            return t["CHAR" if c == "'" else "STRING"]
        if c.isdigit() or c == "." and word[1:2].isdigit():
            return t["NUMBER"]
        k = t.get(word)
        return k if k is not None else t["ASSIGN"] if word in _ASSIGN else t["BINOP"] if word in _BINARY else BAD

    def quick(self, text: str) -> Tokens | None:
        semi, ending, last = self.table[";"], self.ending, 0
        kinds: list[int] = []
        for k in map(self.memo.__getitem__, self._ALL.findall(text)):
            if k >= BAD:
                kinds.append(k)
                last = k
            elif k == _LINE and last in ending:
                kinds.append(semi)
                last = 0
        if last in ending:
            kinds.append(semi)
        kinds.append(0)
        return Tokens(kinds, [], [], [])

    def tokens(self, text: str) -> Tokens:
        t = self.table
        ident, semi = t["IDENT"], t[";"]
        kinds: list[int] = []
        starts: list[int] = []
        ends = False  # whether a line's end here ends a statement
        for m in self._TOKEN.finditer(text):
            g = m.lastindex
            if g == 1 or g == 3 and "\n" in m[3]:
                if ends:
                    kinds.append(semi)
                    starts.append(m.start(g))
                    ends = False
                continue
            if g is None or g in (2, 3):
                continue
            word = m[g]
            if g == 4:
                k = self.names.get(word, ident)
                ends = k == ident or word in self._ENDS
            elif g == 8:
                k = t.get(word)
                if k is None:
                    k = t["ASSIGN"] if word in _ASSIGN else t["BINOP"] if word in _BINARY else BAD
                ends = word in self._ENDS
            else:
                k = {5: t["STRING"], 6: t["CHAR"], 7: t["NUMBER"]}.get(g, BAD)
                ends = True
            kinds.append(k)
            starts.append(m.start(g))
        if ends:
            kinds.append(semi)
            starts.append(len(text))
        kinds.append(0)
        starts.append(len(text))
        return Tokens(kinds, starts, [], [])


class RustLexer:
    _LEAD = r"\s*"
    _PARTS = (
        r"//[^\n]*|/\*",
        r'(?:br|cr|r)(#*)"(?:(?!"\3)[\s\S])*"\3(?!\#)|[bc]?"(?:[^"\\]|\\[\s\S])*"',
        r"""b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}|[nrt\\0'"])|[^\\'\n\t\r])'""",
        r"'(?:r\#)?[^\W\d]\w*(?!')",
        r"(?:r\#)?[^\W\d]\w*",
        r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iuf](?:8|16|32|64|128|size))?",
        r"\.\.\.|\.\.=|==|!=|=>|->|::|\.\.|\+=|-=|\*=|/=|%=|\^=|&=|\|=|[-+*/%^!&|=<>@.,;:\#$?~()\[\]{}]",
        r"\S",
    )
    _QUICK = (r"//[^\n]*|/\*[\s\S]*?\*/", r'[bc]?"(?:[^"\\]|\\[\s\S])*"', *_PARTS[2:])
    _TOKEN, _ALL = _grouped(_LEAD, _PARTS), _flat(_LEAD, _QUICK)
    _NEXT = {"union": None, "auto": ("trait",), "default": ("fn", "const", "type", "async", "unsafe", "impl", "extern"), "raw": ("const", "mut"), "macro_rules": ("!",)}

    def __init__(self, table: dict[str, int]):
        self.table = table
        self.names = {k: v for k, v in table.items() if (k.isidentifier() and not k.isupper()) and k not in self._NEXT}
        # Raw strings and contextual keywords are left to ``tokens``.
        self.memo = _Memo(dict.fromkeys([*self._NEXT, "r", "br", "cr"], _SLOW), self._kind)

    def _kind(self, word: str) -> int:
        t, c = self.table, word[0]
        if c == "/" and word[1:2] in ("/", "*"):
            return _SLOW if "/*" in word[2:] and word[1] == "*" else _SKIP
        if c in "\"'" or c in "bc" and word[1:2] in ("\"", "'") and word[1:2]:
            if len(word) < 2:
                return BAD
            return t["STRING"] if word[-1] == '"' and c != "'" else t["CHAR"] if word[-1] == "'" else t["LIFETIME"]
        if c == "_" or c.isalpha():
            return self.names.get(word, t["IDENT"])
        if c.isdigit():
            return t["NUMBER"]
        k = t.get(word)
        return k if k is not None else t["BINOP"] if word in _BINARY or word in _ASSIGN else MACRO_ONLY if word in "$~" else BAD

    def quick(self, text: str) -> Tokens | None:
        if text.startswith("#!"):
            return None
        found = list(map(self.memo.__getitem__, self._ALL.findall(text)))
        if _SLOW in found:
            return None
        kinds = [k for k in found if k != _SKIP]
        kinds.append(0)
        return Tokens(kinds, [], [], Partners(kinds, self.table))

    def tokens(self, text: str) -> Tokens:
        t, match = self.table, self._TOKEN.match
        fixed = {2: t["STRING"], 4: t["CHAR"], 5: t["LIFETIME"], 7: t["NUMBER"]}
        kinds: list[int] = []
        starts: list[int] = []
        texts: list[str] = []
        at = 0
        if text.startswith("#!") and not re.match(r"#!\s*\[", text):
            at = (text.find("\n") + 1) or len(text)
        while m := match(text, at):
            g, at = m.lastindex, m.end()
            word = m[g]
            if g == 1:
                if word == "/*":
                    at = _nested_comment(text, at)
                    if at < 0:
                        kinds.append(BAD)
                        starts.append(m.start(g))
                        texts.append("")
                        break
                continue
            if g == 6:
                k = self.names.get(word, t["IDENT"])
            elif g == 8:
                k = t.get(word)
                if k is None:
                    k = t["BINOP"] if word in _BINARY or word in _ASSIGN else MACRO_ONLY if word in "$~" else BAD
            else:
                k = fixed.get(3 if g == 3 else g, t["STRING"] if g == 3 else BAD)
            kinds.append(k)
            starts.append(m.start(g))
            texts.append(word)
        for i, word in enumerate(texts):
            if word in self._NEXT and word in t:
                after = texts[i + 1 : i + 3]
                wanted = self._NEXT[word]
                if wanted is None:
                    fits = len(after) == 2 and kinds[i + 1] == t["IDENT"] and after[1] in ("{", "<", "where")
                else:
                    fits = bool(after) and after[0] in wanted and (word != "raw" or i > 0 and texts[i - 1] == "&")
                if fits:
                    kinds[i] = t[word]
        kinds.append(0)
        starts.append(len(text))
        return Tokens(kinds, starts, [], Partners(kinds, t))


def _nested_comment(text: str, at: int) -> int:
    """Where the comment that is open at ``at`` ends; -1 if it doesn't."""
    depth = 1
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return -1


class ScriptLexer:
    """JavaScript and TypeScript, with templates, regular expressions and JSX."""

    _LEAD = r"(?:[ \t\f\v\xa0\ufeff]|\\\r?\n)*"
    _WORD = r"(?:[^\W\d]|[$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
    _PARTS = (
        r"[\n\r\u2028\u2029]+",
        r"//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/",
        _WORD,
        r""""(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'""",
        r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)n?(?![\w$])",
        r"\#[^\W\d][\w$]*|\#\$[\w$]*",
        r"\.\.\.|\?\?=|\?\?|\?\.(?!\d)|===|!==|==|!=|=>|\*\*=|\*\*|\+\+|--|<<=|<<|<=|&&=|&&|\|\|=|\|\||\+=|-=|\*=|%=|&=|\|=|\^=|[-+*%&|^!~=<>?:;,.()\[\]{}@]",
        r"/",
        r"`",
        r"\S",
    )
    _QUICK = (*_PARTS[:7], r"/", r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}`/]*\})*`", r"\S")
    _TOKEN, _ALL = _grouped(_LEAD, _PARTS), _flat(_LEAD, _QUICK)
    _HOLE = re.compile(r"(?<!\\)\$\{([^{}`/]*)\}")
    _REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
    _OPERAND_ENDS = frozenset((")", "]", "}", "this", "super", "null", "true", "false"))
    _WORD_ENDS = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())

    def __init__(self, table: dict[str, int], typed: bool):
        self.table, self.typed = table, typed
        self.names = {k: v for k, v in table.items() if k.isalpha() and k.islower()}
        if "KEYWORD" in table:
            self.names |= {k: table["KEYWORD"] for k in ("enum", "with", "class", "extends") if k not in table}
        self.memo = _Memo({"/": _SLOW, "`": _SLOW}, self._kind)

    def _kind(self, word: str) -> int:
        t, c = self.table, word[0]
        if c in "\n\r\u2028\u2029":
            return _LINE
        if c == "/":
            return _SKIP_LINES if "\n" in word else _SKIP
        if c in "\"'" and len(word) > 1:
            return t["STRING"]
        if c == "`":
            return _SLOW if "\\${" in word else _PARTS if "${" in word else t["TEMPLATE"]
        if c == "#" and len(word) > 1:
            return t["PRIVATE"]
        if c.isdigit() or c == "." and word[1:2].isdigit():
            return t["NUMBER"]
        if c in "_$\\\u200c\u200d" or c.isalpha():
            return self.names.get(word, t["IDENT"]) if len(word) > 1 or c not in "\\" else BAD
        k = t.get(word)
        return k if k is not None else t["ASSIGN"] if word in _ASSIGN else t["BINOP"] if word in _BINARY or word == "^" else t["UNOP"] if word == "~" else BAD

    def quick(self, text: str, jsx: bool = False) -> Tokens | None:
        if jsx or text.startswith("#!"):
            return None
        kinds: list[int] = []
        newline: list[bool] = []
        if not self._collect(text, kinds, newline):
            return None
        kinds.append(0)
        newline.append(True)
        return Tokens(kinds, [], newline, Partners(kinds, self.table))

    def _collect(self, text: str, kinds: list[int], newline: list[bool]) -> bool:
        new, texts, memo = False, self._ALL.findall(text), self.memo
        for i, k in enumerate(map(memo.__getitem__, texts)):
            if k >= BAD:
                kinds.append(k)
                newline.append(new)
                new = False
            elif k == _LINE or k == _SKIP_LINES:
                new = True
            elif k == _PARTS:
                head = self.table["TEMPLATE_HEAD"]
                for hole in self._HOLE.findall(texts[i]):
                    kinds.append(head)
                    newline.append(new)
                    new, head = False, self.table["TEMPLATE_MIDDLE"]
                    if not self._collect(hole, kinds, newline):
                        return False
                kinds.append(self.table["TEMPLATE_TAIL"])
                newline.append(False)
            elif k == _SLOW:
                return False
        return True

    def tokens(self, text: str, jsx: bool = False) -> Tokens:
        self._kinds, self._starts, self._newline, self._texts = [], [], [], []
        at = 0
        if text.startswith("#!"):
            at = len(text.split("\n", 1)[0])
        self._run(text, at, len(text), jsx)
        self._kinds.append(0)
        self._starts.append(len(text))
        self._newline.append(True)
        return Tokens(self._kinds, self._starts, self._newline, Partners(self._kinds, self.table))

    def _add(self, kind: int, start: int, newline: bool, word: str) -> None:
        self._kinds.append(kind)
        self._starts.append(start)
        self._newline.append(newline)
        self._texts.append(word)

    def _run(self, text: str, at: int, end: int, jsx: bool, inside: bool = False) -> int:
        """Lexes from ``at``; ``inside`` ends before the brace that closes a template's or JSX's part."""
        t, match, names, ident = self.table, self._TOKEN.match, self.names, self.table["IDENT"]
        newline, operand = False, True  # operand: an expression may begin here
        depth: list[tuple[str, bool]] = []  # of each open bracket: itself, and whether an operand follows its end
        add, last = self._add, ""
        while at < end and (m := match(text, at)):
            g = m.lastindex
            start, at = m.start(g), m.end()
            word = m[g]
            if g == 1:
                newline = True
                continue
            if g == 2:
                newline = newline or "\n" in word
                continue
            if g == 3:
                add(names.get(word, ident), start, newline, word)
                operand = word in self._WORD_ENDS and last not in (".", "?.")
            elif g == 4:
                add(t["STRING"], start, newline, "s")
                operand = False
            elif g == 5:
                add(t["NUMBER"], start, newline, "n")
                operand = False
            elif g == 6:
                add(t["PRIVATE"], start, newline, "p")
                operand = False
            elif g == 7:
                if word == "<" and operand and jsx and not re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b|=[^>]*>\s*\()").match(text, start):
                    at = self._jsx(text, start, end, newline)
                    newline, operand, last = False, False, ">"
                    continue
                if word in _OPEN:
                    if inside and word == "{" or word == "{":
                        block = last in (")", ";", "{", "}", "", "=>", "else", "do", "try", "finally", ":") and last != ":" or not operand
                        depth.append(("{", block))
                    elif word == "(":
                        depth.append(("(", last in ("if", "while", "for", "with")))
                    else:
                        depth.append(("[", False))
                    operand = True
                elif word in (")", "]", "}"):
                    if inside and word == "}" and not depth:
                        return start
                    operand = depth.pop()[1] if depth else False
                elif word in ("++", "--"):
                    operand = operand and newline or operand
                elif word == "!" and not operand and self.typed and not newline:
                    pass
                else:
                    operand = True
                k = t.get(word)
                if k is None:
                    k = t["ASSIGN"] if word in _ASSIGN else t["BINOP"] if word in _BINARY or word == "^" else t["UNOP"] if word == "~" else BAD
                add(k, start, newline, word)
            elif g == 8:
                r = self._REGEX.match(text, start) if operand else None
                if r:
                    at = r.end()
                    add(t["REGEX"], start, newline, "r")
                    operand = False
                elif operand:
                    add(BAD, start, newline, "")
                else:
                    if text[at : at + 1] == "=":
                        at += 1
                        add(t["ASSIGN"], start, newline, "/=")
                    else:
                        add(t["BINOP"], start, newline, "/")
                    operand = True
            elif g == 9:
                at = self._template(text, start, end, newline, jsx)
                operand = False
            else:
                add(BAD, start, newline, "")
            newline, last = False, word
        return end

    def _template(self, text: str, start: int, end: int, newline: bool, jsx: bool) -> int:
        """Tokens of the template that begins at ``start``; where it ends."""
        t, part = self.table, re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
        kind, at, begin = "TEMPLATE_HEAD", start + 1, start
        while True:
            at = part.match(text, at).end()
            if text.startswith("`", at):
                self._add(t["TEMPLATE" if kind == "TEMPLATE_HEAD" else "TEMPLATE_TAIL"], begin, newline, "t")
                return at + 1
            if at >= end or not text.startswith("${", at):
                self._add(BAD, begin, newline, "")
                return end
            self._add(t[kind], begin, newline, "t")
            newline = False
            begin = self._run(text, at + 2, end, jsx, True)
            if not text.startswith("}", begin):
                self._add(BAD, begin, False, "")
                return end
            kind, at = "TEMPLATE_MIDDLE", begin + 1

    def _jsx(self, text: str, start: int, end: int, newline: bool) -> int:
        """Tokens of the JSX element that begins at ``start``; where it ends."""
        t = self.table
        self._add(t["JSX_OPEN"], start, newline, "x")
        tag = re.compile(r"<\s*(/?)\s*((?:[A-Za-z_$][\w$.:-]*)?)")
        attr = re.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\n]*)*(?:([A-Za-z_$][\w$:-]*)(\s*=\s*(?:\"[^\"]*\"|'[^']*'|(\{)|(<)))?|(\{)|(/?>))")
        names: list[str] = []
        at = start
        while True:
            m = tag.match(text, at)
            if not m or at >= end:
                self._add(BAD, at, False, "")
                return end
            closing, name, at = m[1], m[2], m.end()
            if closing:
                close = re.compile(r"\s*>").match(text, at)
                if not names or names.pop() != name or not close:
                    self._add(BAD, at, False, "")
                    return end
                at = close.end()
            else:
                if name and self.typed and text.startswith("<", at):
                    generic = re.compile(r"<[^<>(){}]*>").match(text, at)
                    at = generic.end() if generic else at
                while True:
                    a = attr.match(text, at)
                    if not a or a[1] and not name:
                        self._add(BAD, at, False, "")
                        return end
                    at = a.end()
                    if a[3] or a[5]:
                        at = self._braces(text, at, end)
                        if at < 0:
                            return end
                    elif a[4]:
                        at = self._jsx(text, at - 1, end, False)
                    elif a[6]:
                        if a[6] == ">":
                            names.append(name)
                        break
            while names:
                at = re.compile(r"[^<>{}]*").match(text, at).end()
                if text.startswith("{", at):
                    at = self._braces(text, at + 1, end)
                    if at < 0:
                        return end
                else:
                    break
            if not names:
                self._add(t["JSX_CLOSE"], at, False, "x")
                return at

    def _braces(self, text: str, at: int, end: int) -> int:
        self._add(self.table["JSX_BRACE"], at, False, "x")
        at = self._run(text, at, end, True, True)
        if not text.startswith("}", at):
            self._add(BAD, at, False, "")
            return -1
        self._add(self.table["JSX_END"], at, False, "x")
        return at + 1


class PythonLexer:
    _LEAD = r"[ \t\f]*"
    _HOLES_2 = r'"(?!"")(?:[^"\\\n\r{]|\\[\s\S]|\{\{|\{(?:[^{}"\']|"[^"\n]*"|\'[^\'\n]*\'|\{[^{}]*\})*\})*"'
    _HOLES_1 = r"'(?!'')(?:[^'\\\n\r{]|\\[\s\S]|\{\{|\{(?:[^{}\"']|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}]*\})*\})*'"
    _PARTS = (
        r"(?:\r\n|\r|\n)[ \t\f]*",
        r"\#[^\n\r]*",
        r"\\(?:\r\n|\r|\n)",
        rf"(?:[fFtT][rR]?|[rR][fFtT])(?:{_HOLES_2}|{_HOLES_1})|"
        r'''(?:[rRbBuUfFtT]{0,2})(?:"""(?:[^\\]|\\[\s\S])*?"""|"(?!"")(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*")'''
        r"""|(?:[rRbBuUfFtT]{0,2})(?:'''(?:[^\\]|\\[\s\S])*?'''|'(?!'')(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')""",
        r"[^\W\d]\w*",
        r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?",
        r"\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|==|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^~<>=()\[\]{},:.;]",
        r"\S",
    )
    _TOKEN, _ALL = _grouped(_LEAD, _PARTS), _flat(_LEAD, _PARTS)

    def __init__(self, table: dict[str, int]):
        self.table = table
        self.names = {k: v for k, v in table.items() if k.isalpha() and k not in ("match", "case", "type") and not k.isupper()}
        self.memo = _Memo(dict.fromkeys(("match", "case", "type"), _SLOW), self._kind)

    def _kind(self, word: str) -> int:
        t, c = self.table, word[0]
        if c in "\r\n":
            return _LINE
        if c == "#" or c == "\\" and len(word) > 1:
            return _SKIP
        if word[-1] in "\"'" and len(word) > 1:
            return t["STRINGS"]
        if c == "_" or c.isalpha():
            return self.names.get(word, t["IDENT"])
        if c.isdigit() or c == "." and word[1:2].isdigit():
            return t["NUMBER"]
        k = t.get(word)
        return k if k is not None else t["AUGMENTED"] if word in _ASSIGN else t["BINOP"] if word in _BINARY or word in ("^", "&") else BAD

    def quick(self, text: str) -> Tokens | None:
        t, texts = self.table, self._ALL.findall(text)
        found = list(map(self.memo.__getitem__, texts))
        if _SLOW in found or text[:1] in (" ", "\t", "\f"):
            return None
        steps = {t[x]: d for pairs, d in (("([{", 1), (")]}", -1)) for x in pairs}
        new, indent, dedent, strings = t["NEWLINE"], t["INDENT"], t["DEDENT"], t["STRINGS"]
        kinds: list[int] = []
        depth, fresh, white, indents = 0, True, "", [0]
        for i, k in enumerate(found):
            if k >= BAD:
                if fresh:
                    fresh = False
                    width = len(white.rpartition("\f")[2].expandtabs(8))
                    if width > indents[-1]:
                        indents.append(width)
                        kinds.append(indent)
                    elif width < indents[-1]:
                        while width < indents[-1]:
                            indents.pop()
                            kinds.append(dedent)
                        if width != indents[-1]:
                            kinds.append(BAD)
                elif k == strings and kinds[-1] == strings:
                    continue
                if k in steps:
                    depth = max(0, depth + steps[k])
                kinds.append(k)
            elif k == _LINE:
                if not depth and not fresh:
                    kinds.append(new)
                    fresh = True
                if fresh:
                    white = texts[i].lstrip("\r\n")
        if not fresh:
            kinds.append(new)
        kinds += [dedent] * (len(indents) - 1)
        kinds.append(0)
        return Tokens(kinds, [], [], [], [x for x, k in zip(texts, found) if k == strings and ("{" in x or "}" in x)])

    def tokens(self, text: str) -> Tokens:
        t = self.table
        kinds: list[int] = []
        starts: list[int] = []
        first: list[int] = []  # indexes of the tokens that begin logical lines
        texts: list[str] = []
        strings: list[str] = []
        depth, fresh, begin, white, indents = 0, True, int(text[:1] in (" ", "\t", "\f")), "", [0]

        def add(k: int, at: int, word: str = "") -> None:
            kinds.append(k)
            starts.append(at)
            texts.append(word)

        for m in self._TOKEN.finditer(text):
            g = m.lastindex
            if g is None:
                continue
            if g == 1:
                if not depth and not fresh:
                    add(t["NEWLINE"], m.start(1))
                    fresh = True
                if fresh:
                    white = m[1].lstrip("\r\n")
                continue
            if g in (2, 3):
                continue
            if fresh:
                fresh = False
                width = len((white or text[: m.start(g)] if begin else white).rpartition("\f")[2].expandtabs(8))
                begin = 0
                if width > indents[-1]:
                    indents.append(width)
                    add(t["INDENT"], m.start(g))
                else:
                    while width < indents[-1]:
                        indents.pop()
                        add(t["DEDENT"], m.start(g))
                    if width != indents[-1]:
                        add(BAD, m.start(g))
                first.append(len(kinds))
            word = m[g]
            if g == 5:
                k = self.names.get(word, t["IDENT"])
            elif g == 4:
                if "{" in word or "}" in word:
                    strings.append(word)
                if kinds and kinds[-1] == t["STRINGS"]:
                    continue
                k = t["STRINGS"]
            elif g == 6:
                k = t["NUMBER"]
            elif g == 7:
                if word in "([{":
                    depth += 1
                elif word in ")]}":
                    depth = max(0, depth - 1)
                k = t.get(word)
                if k is None:
                    k = t["AUGMENTED"] if word in _ASSIGN else t["BINOP"] if word in _BINARY or word == "^" or word == "&" else BAD
            else:
                k = BAD
            add(k, m.start(g), word)
        if not fresh:
            add(t["NEWLINE"], len(text))
        for _ in indents[1:]:
            add(t["DEDENT"], len(text))
        for n, i in enumerate(first):
            word, after = texts[i], texts[i + 1] if i + 1 < len(texts) else ""
            if word in ("match", "case") and after not in ("=", ".", ",", ")", ":", "", ":=", "+=") and kinds[(first[n + 1] if n + 1 < len(first) else len(kinds)) - 1] != BAD:
                stop = first[n + 1] if n + 1 < len(first) else len(kinds)
                line = [x for x in texts[i:stop] if x]
                if word == "case" and ":" in line or line[-1] == ":" and stop < len(texts) and texts[stop] == "case":
                    kinds[i] = t[word]
            elif word == "type" and i + 1 < len(kinds) and kinds[i + 1] == t["IDENT"]:
                kinds[i] = t["type"]
        kinds.append(0)
        starts.append(len(text))
        return Tokens(kinds, starts, [], [], strings)
