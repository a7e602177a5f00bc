"""The record of one observation in a source file, shared by the languages' readers."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass
class Seen:
    """One thing seen in a file. Offsets are characters until :func:`in_bytes` turns them into bytes.

    ``what`` is symbol, import, export, binding, owner, call or reference. ``inner`` is a body, a
    scope or a callee's extent, ``active`` where a binding begins to hold.
    """

    what: str
    name: str | None = None
    kind: str | None = None
    start: int = 0
    end: int = 0
    qualified: str | None = None
    inner: tuple[int, int] | None = None
    active: int | None = None
    text: str | None = None
    path: tuple[str, ...] = ()
    form: str | None = None
    imported: str | None = None
    exported: str | None = None
    specifier: str | None = None
    type_only: bool = False
    module_level: bool = True
    doc: str | None = None
    decorators: tuple[str, ...] = ()
    metadata: dict = field(default_factory=dict)


class Offsets:
    """Bytes and lines of character offsets of one text."""

    def __init__(self, text: str):
        self.text, self.plain = text, text.isascii()
        self.lines = [0]
        at = text.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = text.find("\n", at + 1)
        self.sums = [0]
        if not self.plain:
            for a, b in zip(self.lines, [*self.lines[1:], len(text)]):
                self.sums.append(self.sums[-1] + len(text[a:b].encode("utf-8", "surrogateescape")))

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def byte(self, at: int) -> int:
        if self.plain:
            return at
        n = bisect_right(self.lines, at) - 1
        return self.sums[n] + len(self.text[self.lines[n] : at].encode("utf-8", "surrogateescape"))


def visible(bindings: list[Seen], name: str, at: int) -> list[Seen]:
    """Bindings of ``name`` in the narrowest scope around ``at`` that has one which already holds."""
    near = [b for b in bindings if b.name == name and b.inner[0] <= at < b.inner[1] and b.active <= at]
    if not near:
        return []
    width = min(b.inner[1] - b.inner[0] for b in near)
    return [b for b in near if b.inner[1] - b.inner[0] == width]


def local_state(bindings: list[Seen], path: tuple[str, ...], form: str, at: int) -> tuple[str, list[Seen]]:
    """What a callee is bound to in its own file: unsupported, absent, shadowed, definite or ambiguous."""
    if form == "dynamic":
        return "unsupported", []
    if form == "static_path":
        return "absent", []
    near = visible(bindings, path[0], at)
    if not near:
        return "absent", []
    if any(b.kind not in ("function", "method") for b in near):
        return "shadowed", []
    distinct = {(b.start, b.end): b for b in near}
    return ("definite" if len(distinct) == 1 else "ambiguous"), [distinct[k] for k in sorted(distinct)]
