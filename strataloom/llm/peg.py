"""Packrat parsing of parsing-expression grammars.

A grammar is text, a rule a line: ``Name <- a b / 'c' ~regex~ (d / e)* f? !g &h``. Each rule's
outcome at a place is kept, so that no place is parsed twice by one rule. Rules with a semantic
action give a value: the action gets the text, the rule's start and end, and the values of the
rules inside; values of rules without action pass through.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

_TOKEN = re.compile(r"""\s*(?:(~(?:[^~\\]|\\.)+~)|('(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|([()/*+?!&]))""")
#: A parser of one expression: text, place, memo -> (end or -1, values).
_Parser = Callable[[str, int, dict], tuple[int, list]]
_NONE: list = []


@contextmanager
def nested(levels: int) -> Iterator[None]:
    """Room for a parse that nests ``levels`` deep.

    The parsers are plain Python calls, whose frames the interpreter keeps on the heap, so the
    limit on their number is all that bounds the depth.
    """
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 1_000 + 16 * levels))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


class Peg:
    """A compiled grammar."""

    def __init__(self, grammar: str, actions: dict[str, Callable] | None = None, flags: int = 0):
        self.flags, self.actions = flags, actions or {}
        self.rules: dict[str, _Parser] = {}
        for line in grammar.strip().splitlines():
            if line.strip() and not line.lstrip().startswith("#"):
                name, _, body = line.partition("<-")
                words = [m for m in _TOKEN.finditer(body)]
                self._words, self._at = [m.group().strip() for m in words], 0
                expression = self._choice()
                if self._at != len(self._words):
                    raise ValueError(f"{name}: {self._words[self._at :]}")
                self.rules[name.strip()] = self._remembered(name.strip(), expression)

    def parse(self, rule: str, text: str, at: int = 0) -> tuple[int, list]:
        """Where ``rule`` ends in ``text`` from ``at`` (-1 if it doesn't hold) and its values."""
        return self.rules[rule](text, at, {})

    def _remembered(self, name: str, inner: _Parser) -> _Parser:
        action = self.actions.get(name)

        def run(text, at, memo):
            key = (name, at)
            found = memo.get(key)
            if found is None:
                end, values = inner(text, at, memo)
                if action is not None and end >= 0:
                    values = action(text, at, end, values)
                found = memo[key] = (end, values)
            return found

        return run

    def _choice(self) -> _Parser:
        options = [self._sequence()]
        while self._at < len(self._words) and self._words[self._at] == "/":
            self._at += 1
            options.append(self._sequence())
        if len(options) == 1:
            return options[0]

        def run(text, at, memo):
            for option in options:
                found = option(text, at, memo)
                if found[0] >= 0:
                    return found
            return -1, _NONE

        return run

    def _sequence(self) -> _Parser:
        parts: list[_Parser] = []
        while self._at < len(self._words) and self._words[self._at] not in ("/", ")"):
            parts.append(self._part())
        if len(parts) == 1:
            return parts[0]

        def run(text, at, memo):
            values: list = []
            for part in parts:
                at, more = part(text, at, memo)
                if at < 0:
                    return -1, _NONE
                if more:
                    values = values + more if values else more
            return at, values

        return run

    def _part(self) -> _Parser:
        word = self._words[self._at]
        self._at += 1
        if word in ("!", "&"):
            inner, wanted = self._part(), word == "&"
            return lambda text, at, memo: (at, _NONE) if (inner(text, at, memo)[0] >= 0) == wanted else (-1, _NONE)
        if word == "(":
            inner = self._choice()
            self._at += 1
        elif word[0] in "~'":
            pattern = re.compile(word[1:-1].replace("\\~", "~") if word[0] == "~" else re.escape(word[1:-1]), self.flags).match
            inner = lambda text, at, memo: (m.end(), _NONE) if (m := pattern(text, at)) else (-1, _NONE)
        else:
            inner = lambda text, at, memo: self.rules[word](text, at, memo)
        mark = self._words[self._at] if self._at < len(self._words) else ""
        if mark not in ("*", "+", "?"):
            return inner
        self._at += 1
        if mark == "?":
            return lambda text, at, memo: found if (found := inner(text, at, memo))[0] >= 0 else (at, _NONE)
        least = 1 if mark == "+" else 0

        def run(text, at, memo):
            values: list = []
            n = 0
            while True:
                end, more = inner(text, at, memo)
                if end < 0 or end == at:
                    return (at, values) if n >= least else (-1, _NONE)
                at, n = end, n + 1
                if more:
                    values.extend(more)

        return run
