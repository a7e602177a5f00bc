"""Predictive parse tables built from a grammar in text, and the machine that they drive.

A grammar has a rule a paragraph: ``Name: a 'b' (c | d)* e? ;``. Quoted and upper-case words are
kinds of tokens; words that begin with ``&`` are conditions on the place. ``ONLY`` behind the
condition that an alternative begins with gives up the alternatives after it, and ``CUT`` gives
up all that were left behind. A rule whose name ends with ``~`` stands for two: the plain one, and one
in which no brace may begin a literal (alternatives with ``&brace`` are left out), which hands
the mark on to those parts of its body that carry it.

For each rule and kind of token the table holds the alternatives that can begin there, expanded
as far as there is only one. A stack of symbols, kept as linked pairs so that remembering one
costs nothing, is worked off against the tokens. Where a table entry has several alternatives
they are tried in their order; the furthest token at which all failed is the error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

_WORD = re.compile(r"\s*(?:('(?:[^'\\]|\\.)+')|(&?[A-Za-z_]\w*~?)|([()|*+?;:]))")


class Grammar:
    """Rules of one language as alternatives of symbols.

    ``without`` names conditions (like ``&ts``) whose alternatives don't belong to the language;
    the other conditions of ``tags`` are then dropped from the alternatives that they mark.
    """

    def __init__(self, text: str, tags: tuple[str, ...] = (), without: tuple[str, ...] = ()):
        self.rules: dict[str, list[tuple[str, ...]]] = {}
        self._fresh, self._tags, self._without = 0, {*tags, "&brace"}, set(without)
        for rule in re.split(r";[ \t]*\n", re.sub(r"(?m)^\s*#.*$", "", text) + "\n"):
            if not rule.strip():
                continue
            name, _, body = rule.strip().partition(":")
            name = name.strip()
            for marked in (False, True) if name.endswith("~") else (None,):
                self._marked = marked
                self._words, self._at = [m.group().strip() for m in _WORD.finditer(body)], 0
                alternatives = self._alternatives()
                if self._at != len(self._words):
                    raise ValueError(f"rule {name}: {self._words[self._at :]}")
                self.rules.setdefault(name if marked or marked is None else name[:-1], []).extend(alternatives)

    def _alternatives(self) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = []
        while True:
            found = self._sequence()
            dropped = self._without | ({"&brace"} if self._marked else set())
            if not dropped & set(found):
                out.append(tuple(x for x in found if x not in self._tags))
            if self._at < len(self._words) and self._words[self._at] == "|":
                self._at += 1
                continue
            return out

    def _sequence(self) -> tuple[str, ...]:
        out: list[str] = []
        while self._at < len(self._words) and self._words[self._at] not in ("|", ")"):
            word = self._words[self._at]
            self._at += 1
            if self._marked is False and word.endswith("~"):
                word = word[:-1]
            if word == "(":
                inner = self._alternatives()
                self._at += 1
                word = inner[0][0] if len(inner) == 1 and len(inner[0]) == 1 else self._rule(inner)
            mark = self._words[self._at] if self._at < len(self._words) else ""
            if mark in ("*", "+", "?"):
                self._at += 1
                if mark == "?":
                    word = self._rule([(word,), ()])
                else:
                    many = self._rule([])
                    self.rules[many] = [(word, many), ()]
                    if mark == "+":
                        out.append(word)
                    word = many
            out.append(word)
        return tuple(out)

    def _rule(self, alternatives: list[tuple[str, ...]]) -> str:
        self._fresh += 1
        name = f"_{self._fresh}"
        self.rules[name] = alternatives
        return name


class Eaten(tuple):
    """Symbols to be pushed after the token, which the expansion begins with."""


class Table:
    """The compiled grammar. ``kinds`` numbers the kinds of tokens; 0 is the end of the text."""

    def __init__(self, grammar: Grammar, start: str, conditions: dict[str, Callable]):
        rules = grammar.rules
        used = {s for alts in rules.values() for a in alts for s in a}
        terminals = sorted(s for s in used if s not in rules and not s.startswith("&") and s not in ("CUT", "ONLY"))
        missing = [s for s in terminals if not (s.startswith("'") or s.isupper())]
        if missing:
            raise ValueError(f"no rules for {missing}")
        self.kinds = {"EOF": 0} | {s.strip("'").replace("\\", "") if s.startswith("'") else s: i + 1 for i, s in enumerate(t for t in terminals if t != "EOF")}
        names = sorted(rules)
        # Symbols: kinds are 0 and above, rules are negative numbers, conditions are functions.
        number = {n: -i - 1 for i, n in enumerate(names)}
        symbol = lambda s: number[s] if s in number else s if s in ("CUT", "ONLY") else conditions[s] if s.startswith("&") else self.kinds[s.strip("'").replace("\\", "") if s.startswith("'") else s]
        made = {number[n]: [tuple(symbol(s) for s in a) for a in rules[n]] for n in names}
        nullable: set[int] = set()
        first: dict[int, set[int]] = {n: set() for n in made}
        changed = True
        while changed:
            changed = False
            for n, alts in made.items():
                for a in alts:
                    found, empty = self._first(a, first, nullable)
                    if not found <= first[n]:
                        first[n] |= found
                        changed = True
                    if empty and n not in nullable:
                        nullable.add(n)
                        changed = True
        self.start = number[start]
        every = range(len(self.kinds) + 1)  # the last stands for text that is no token, and has the number -1
        raw: dict[int, list[tuple[tuple, ...]]] = {}
        for n, alts in made.items():
            firsts = [self._first(a, first, nullable) for a in alts]
            raw[n] = [tuple(a for a, (f, empty) in zip(alts, firsts) if k in f or empty) for k in every]
        self._raw = raw
        # By rule (its negative number indexes from the end) and kind: None, one expansion, or a list of them.
        self.actions: list[list] = [[] for _ in range(len(names) + 1)]
        for n in made:
            self.actions[n] = [self._entry(n, k) for k in every]

    @staticmethod
    def _first(a: tuple, first: dict, nullable: set) -> tuple[set, bool]:
        out: set[int] = set()
        for s in a:
            if not isinstance(s, int):
                continue
            if s >= 0:
                return out | {s}, False
            out |= first[s]
            if s not in nullable:
                return out, False
        return out, True

    def _entry(self, n: int, k: int):
        """None, or the alternatives as tuples of symbols to be pushed, the first of them last.

        Where there is one alternative and its first symbol has one too, they are joined; a
        leading symbol that is the token itself is left out and eaten at once.
        """
        options = self._raw[n][k]
        if not options:
            return None
        if len(options) > 1:
            made = [self._expanded(a, k) for a in options]
            return [a[::-1] for a in (*made[:-1], self._alone(made[-1]))]
        found = self._expanded(self._alone(options[0]), k)
        return Eaten(found[:0:-1]) if found and found[0] == k and found[0].__class__ is int else found[::-1]

    @staticmethod
    def _alone(a: tuple) -> tuple:
        """An alternative that none is left behind of."""
        i = next((i for i, s in enumerate(a) if s == "ONLY"), -1)
        return a[:i] + a[i + 1 :] if i >= 0 else a

    def _expanded(self, a: tuple, k: int, depth: int = 0) -> tuple:
        if a and isinstance(a[0], int) and a[0] < 0 and depth < 40:
            options = self._raw[a[0]][k]
            if len(options) == 1:
                return self._expanded(self._alone(options[0]) + a[1:], k, depth + 1)
        return a

    def parse(self, kinds: Sequence[int], newline: Sequence[bool] | None = None, partner: Sequence[int] | None = None) -> int:
        """-1 if the tokens are a sentence of the grammar, else the index of the first that can't be.

        ``kinds`` ends with 0. ``newline`` tells of each token whether a line ends before it, and
        ``partner`` which token closes it; conditions look at both.
        """
        actions = self.actions
        stack: tuple | None = (self.start, None)
        choices: list[tuple] = []
        at = furthest = 0
        kind = kinds[0]
        while stack is not None:
            symbol, stack = stack
            if symbol.__class__ is int:
                if symbol >= 0:
                    if symbol == kind:
                        at += 1
                        kind = kinds[at] if kind else 0
                        continue
                else:
                    entry = actions[symbol][kind]
                    if entry.__class__ is Eaten:
                        for s in entry:
                            stack = (s, stack)
                        at += 1
                        kind = kinds[at] if kind else 0
                        continue
                    if entry is not None:
                        if entry.__class__ is list:
                            choices.append((entry, 1, stack, at))
                            entry = entry[0]
                        for s in entry:
                            stack = (s, stack)
                        continue
            elif symbol.__class__ is str:
                if symbol == "CUT":
                    choices.clear()
                else:
                    choices.pop()
                continue
            else:
                moved = symbol(kinds, at, newline, partner)
                if moved >= 0:
                    if moved != at:
                        at = moved
                        kind = kinds[at]
                    continue
            if at > furthest:
                furthest = at
            if not choices:
                return furthest
            entry, i, stack, at = choices.pop()
            kind = kinds[at]
            if i + 1 < len(entry):
                choices.append((entry, i + 1, stack, at))
            for s in entry[i]:
                stack = (s, stack)
        return -1
