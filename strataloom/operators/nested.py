"""Deeply nested records turned into related flat tables.

An event parser reads a record's text once, from left to right with a stack of its own, and
gives path-value-ordinal triples; no document is built. The triples are grouped by their nearest
repeated ancestor (a list on the path, with its positions), declared or not, and each group is
pivoted into a row of one table. As a group never leaves its record, grouping and pivoting
happen where the record is parsed, and only rows of the tables asked for leave that task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_KEYS = "record_kind string, record_id long, table_name string, child_path string, parent_path string, position int"
ROWS = f"{_KEYS}, fields map<string,string>"
_KEY_FIELDS = [("record_kind", pa.string()), ("record_id", pa.int64()), ("table_name", pa.string()), ("child_path", pa.string()), ("parent_path", pa.string()), ("position", pa.int32())]
_MAP = pa.map_(pa.string(), pa.string())

#: Members under which a list may be wrapped instead of standing at its own place.
WRAPPERS = ("items", "elements", "entries", "values", "list", "data", "records")
#: The step of a path that stands for a list's elements, and the value of an object itself.
LIST, OBJECT = "[]", object()


@dataclass(frozen=True)
class Shape:
    """What is known of an object: its child lists, single objects and plain members.

    Lists and objects named here are found in any spelling, wrapping or encoding; those that
    aren't named are taken as they stand.
    """

    name: str
    lists: dict[str, "Shape"] = field(default_factory=dict)
    objects: dict[str, "Shape"] = field(default_factory=dict)
    members: frozenset[str] = frozenset()

    def known(self) -> set[str]:
        return {*self.members, *self.lists, *self.objects}


BINDING = Shape("binding", members=frozenset({"local_name", "imported_name", "exported_name", "kind", "import_text"}))
SUPPORT = Shape("support", members=frozenset({"kind", "file", "line", "content_hash", "endpoint_id"}))
RAW = Shape("raw", lists={"candidate_bindings": BINDING}, members=frozenset({"source_file", "text", "path", "source_hash"}))
REFERENCE = Shape("symbol_reference", lists={"support": SUPPORT}, objects={"raw": RAW}, members=frozenset({"source_id", "target_id", "status"}))
EDGE = Shape("edge", members=frozenset({"from", "to", "type", "namespace", "evidence"}))
STATE = Shape("state", lists={"edges": EDGE, "symbol_references": REFERENCE})


def _plain(name: str) -> str:
    """A member's name without case, marks and plural: symbolReferences is symbol_references."""
    return re.sub(r"[^0-9a-z]", "", name.lower()).rstrip("s")


class Path:
    """A path of members and lists, with what is known of its place; paths are shared by all records.

    It is kept as its last step and the path before, so that deep records cost no more than their depth.
    """

    __slots__ = ("parent", "name", "shape", "place", "declared", "children", "item", "_label", "_names")

    def __init__(self, parent: "Path | None", name: str, shape: Shape | None, place: str, declared: bool):
        self.parent, self.name, self.shape, self.place, self.declared = parent, name, shape, place, declared
        self.children: dict[str, Path] = {}
        #: The nearest repeated ancestor, this path itself if it stands for a list's elements.
        self.item: Path | None = self if name == LIST else parent.item if parent is not None else None
        self._label: str | None = None
        self._names: tuple[str, ...] | None = None

    def child(self, name: str) -> Path:
        found = self.children.get(name)
        if found is None:
            found = self.children[name] = self._made(name)
        return found

    def _made(self, name: str) -> Path:
        if name == LIST:
            # Elements of a list at a list's place are declared; a list in a list isn't.
            known = self.place == "list"
            return Path(self, LIST, self.shape if known else None, "element" if known else "", known and self.declared)
        shape, want = self.shape, _plain(name)
        if shape is not None:
            for names, place in ((shape.lists, "list"), (shape.objects, "object")):
                for known, below in names.items():
                    if _plain(known) == want:
                        return Path(self, known, below, place, self.declared)
            if self.place == "list" and name.lower() in WRAPPERS:
                return Path(self, name, shape, "list", self.declared)
            if self.place == "list" and name.isdigit():
                return Path(self, name, shape, "element", self.declared)
        return Path(self, name, None, "", False)

    def chain(self, top: "Path | None" = None) -> list["Path"]:
        """The paths from below ``top`` (the root if not given) down to this one."""
        out: list[Path] = []
        at: Path | None = self
        while at is not top and at is not None and at.parent is not None:
            out.append(at)
            at = at.parent
        return out[::-1]

    @property
    def label(self) -> str:
        """The rest of the path behind its nearest repeated ancestor, as a field's name."""
        if self._label is None:
            self._label = ".".join(p.name for p in self.chain(self.item))
        return self._label

    @property
    def names(self) -> tuple[str, ...]:
        """All steps of the path; asked for of repeated ancestors only."""
        if self._names is None:
            self._names = tuple(p.name for p in self.chain())
        return self._names


def rooted(shape: Shape) -> Path:
    """The path of whole records of ``shape``."""
    return Path(None, "", shape, "object", True)


_BLANK = "[ \t\n\r]*"
_STRING = r'"([^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*)"'
_VALUE = rf"(?:{_STRING}|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|-?Infinity|NaN|true|false)|(null)|([{{\[])){_BLANK}"
_ELEMENT = re.compile(_VALUE, re.A)
_MEMBER = re.compile(rf"{_STRING}{_BLANK}:{_BLANK}{_VALUE}", re.A)
_NEXT = re.compile(rf"([,}}\]]){_BLANK}")
_SKIP = re.compile(_BLANK)


def _decoded(quoted: str) -> str:
    return json.loads(f'"{quoted}"') if "\\" in quoted else quoted


Triple = tuple[Path, tuple[int, ...], object]


def read(text: str, root: Path, ordinals: tuple[int, ...], out: list[Triple], special: dict) -> bool:
    """Append the triples of the document in ``text``; False if it isn't one whole document.

    Values are texts, or None for null; an object itself gives the value OBJECT when it ends.
    ``special`` gets what has to be known of objects that stand where a list belongs.
    """
    skip, element, member, follow = _SKIP.match, _ELEMENT.match, _MEMBER.match, _NEXT.match
    at, size = skip(text).end(), len(text)
    stack: list[list] = []  # [is an object, path, ordinals, next position or names]
    path, found = root, element(text, at)
    shift = 0
    try:
        while True:
            # One value, at ``path``; its groups are behind those of the member's name.
            if found is None:
                return False
            at = found.end()
            string, plain, null, opened = found.group(1 + shift, 2 + shift, 3 + shift, 4 + shift)
            if opened:
                if opened == "{":
                    top = [True, path, ordinals, []]
                    if text[at : at + 1] != "}":
                        stack.append(top)
                        found, shift = member(text, at), 1
                        if found is None:
                            return False
                        name = _decoded(found.group(1))
                        top[3].append(name)
                        path = path.child(name)
                        continue
                    at = skip(text, at + 1).end()
                    _ended(top, out, special)
                else:
                    if text[at : at + 1] != "]":
                        stack.append([False, path, ordinals, 0])
                        path, ordinals = path.child(LIST), (*ordinals, 0)
                        found, shift = element(text, at), 0
                        continue
                    at = skip(text, at + 1).end()
            elif string is not None:
                value = _decoded(string)
                if not (path.place in ("list", "object") and value.lstrip()[:1] in ("{", "[", '"') and _inside(value, path, ordinals, out, special)):
                    out.append((path, ordinals, value))
            else:
                out.append((path, ordinals, None if null else plain))
            # What follows the value.
            while True:
                if not stack:
                    return at == size
                top = stack[-1]
                mark = follow(text, at)
                if mark is None:
                    return False
                at = mark.end()
                is_object, path, ordinals, seen = top
                if mark.group(1) == ",":
                    if is_object:
                        found, shift = member(text, at), 1
                        if found is None:
                            return False
                        name = _decoded(found.group(1))
                        seen.append(name)
                        path = path.child(name)
                    else:
                        top[3] = seen + 1
                        path, ordinals = path.child(LIST), (*ordinals, seen + 1)
                        found, shift = element(text, at), 0
                    break
                if is_object != (mark.group(1) == "}"):
                    return False
                stack.pop()
                if is_object:
                    _ended(top, out, special)
    except ValueError:
        return False


def _inside(text: str, path: Path, ordinals: tuple, out: list, special: dict) -> bool:
    """Whether a text at a known place is itself a document; its triples then stand for it."""
    before = len(out)
    if read(text, path, ordinals, out, special):
        return True
    del out[before:]
    return False


def _ended(top: list, out: list, special: dict) -> None:
    """The end of an object: its triple, and what its names tell of the list that belongs there."""
    _, path, ordinals, names = top
    out.append((path, ordinals, OBJECT))
    shape = path.shape
    if shape is None:
        return
    if path.place == "list":
        known = shape.known()
        wrapped = [n for n in names if n.lower() in WRAPPERS]
        if len(wrapped) == 1 and not any(n in known for n in names):
            special[path, ordinals] = ("under", wrapped[0])
        elif names and all(n.isdigit() for n in names):
            special[path, ordinals] = ("keyed", sorted(names, key=int))
        else:
            special[path, ordinals] = ("one", None)
    if len(names) > 1:
        # Of several spellings of one list or object its own goes first, then the first one.
        spelt: dict[str, list[str]] = {}
        for n in names:
            found = path.child(n)
            if found.place in ("list", "object"):
                spelt.setdefault(found.name, []).append(n)
        if any(len(set(x)) > 1 for x in spelt.values()):
            raise _Respelt


class _Respelt(Exception):
    """Names of an object that are second spellings of its lists or objects."""


def _placed(path: Path, ordinals: tuple[int, ...], special: dict, root: Path) -> tuple[Path, tuple] | None:
    """A path and its ordinals as they would be if every list stood at its place."""
    steps = path.chain()
    at, out, found, k = root, root, [], 0
    for step in (*steps, None):
        what, how = special.get((at, ordinals[:k]), ("", None))
        if what in ("under", "keyed"):
            if step is None or what == "under" and step.name != how:
                return None
            if what == "keyed":
                out = out.child(LIST)
                found.append(how.index(step.name))
            at = step
            continue
        if what == "one":
            out = out.child(LIST)
            found.append(0)
        if step is None:
            return out, tuple(found)
        if step.name == LIST:
            found.append(ordinals[k])
            k += 1
        at, out = step, out.child(step.name)


def triples(text: str | None, root: Path) -> list[Triple] | None:
    """The triples of one whole object, also if encoded as a string; None if ``text`` isn't one."""
    if text is None:
        return None
    text = text.lstrip("﻿").strip(" \t\n\r")
    while text[:1] == '"':
        try:
            text = json.loads(text)
        except ValueError:
            return None
        if not isinstance(text, str):
            return None
        text = text.strip(" \t\n\r")
    if text[:1] != "{":
        return None
    out: list[Triple] = []
    special: dict = {}
    try:
        if not read(text, root, (), out, special):
            return None
    except _Respelt:
        return triples(_respelt(text, root), root)
    if not special:
        return out
    moved = []
    for path, ordinals, value in out:
        place = _placed(path, ordinals, special, root)
        if place is not None:
            moved.append((*place, value))
    return moved


def _respelt(text: str, root: Path) -> str:
    """``text`` without second spellings of one member (rare, so by way of the document)."""

    def kept(pairs: list[tuple[str, object]]) -> dict:
        names = [n for n, _ in pairs]
        known = {_plain(x): x for s in (STATE, REFERENCE, RAW) for x in (*s.lists, *s.objects)}
        first: dict[str, str] = {}
        for n in names:
            own = known.get(_plain(n))
            if own and (own not in first or n == own):
                first[own] = n
        return {n: v for n, v in pairs if known.get(_plain(n)) is None or first[known[_plain(n)]] == n}

    return json.dumps(json.loads(text, object_pairs_hook=kept), ensure_ascii=False)


Row = tuple[str, str, "str | None", "int | None", dict]


def shredded(found: list[Triple], root: Path, declared: bool = False) -> list[Row]:
    """Table, path, parent's path, position and fields of each row of one record's triples.

    A list's elements that aren't objects hold their position and give no row in a declared
    table; of an undeclared list each gives a row with the field ``value``. With ``declared``
    the rows of undeclared lists are left out.
    """
    rows: dict[tuple, list] = {(None, ()): [{}, True]}
    for path, ordinals, value in found:
        item = path.item
        itself = item is path
        if value is OBJECT and not itself:
            continue
        row = rows.get((item, ordinals))
        if row is None:
            row = rows[item, ordinals] = [{}, False]
        if value is OBJECT:
            row[1] = True
        else:
            row[0]["value" if itself else path.label] = value
    out: list[Row] = []
    for (item, ordinals), (fields, is_object) in rows.items():
        if item is None:
            out.append((root.shape.name, "", None, None, fields))
            continue
        if (item.declared and not is_object) or (declared and not item.declared):
            continue
        group = item.names
        spelt, n, outer = "", 0, 0
        last = inner = len(group) - 1
        while group[inner] == LIST:  # of a list in a list, the parent is the object around both
            inner -= 1
        for i, name in enumerate(group):
            if name == LIST:
                spelt += f"[{ordinals[n]}]"
                n += 1
                if i < inner:
                    outer = len(spelt)
            else:
                spelt = f"{spelt}.{name}" if spelt else name
        named = group[last - 1] if group[last - 1] != LIST else "".join(group[-3:] if last > 1 else group)
        out.append((named, spelt, spelt[:outer], ordinals[-1], fields))
    return out


def shred(records: DataFrame, kind: str, key: str, text: str, shape: Shape, fields: bool = True, tables: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None, declared: bool = False) -> DataFrame:
    """All rows of all tables in the JSON texts ``text`` of ``records``, with their parents.

    Columns: record_kind, record_id, table_name, child_path, parent_path, position and fields
    (members as text). A record that is null or not one whole object gives no row; otherwise it
    has a row of its own with an empty child_path. An object where a list belongs has position
    0; elements that aren't objects hold their position and give no row. A null key keeps its
    rows, with a null record_id. ``tables`` names those that are wanted, ``declared`` leaves out
    lists that the shape doesn't name. With ``columns`` those fields are columns of text instead
    of the map, and with ``fields`` false there are none.
    """
    wanted = set(tables) if tables is not None else None
    last = [("fields", _MAP)] if columns is None and fields else [(f"c{i}", pa.string()) for i in range(len(columns or ()))]
    arrow = pa.schema(_KEY_FIELDS + last)
    schema = ROWS if columns is None and fields else ", ".join([_KEYS, *(f"c{i} string" for i in range(len(columns or ())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = rooted(shape)
        for batch in batches:
            rows: list[tuple] = []
            for record_id, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = triples(record, root)
                if found is not None:
                    rows += [(record_id, *x) for x in shredded(found, root, declared) if wanted is None or x[0] in wanted]
            ids, names, paths, parents, positions, values = list(zip(*rows)) if rows else [()] * 6
            if columns is None and fields:
                end = [pa.array([list(v.items()) for v in values], _MAP)]
            else:
                end = [pa.array([v.get(c) for v in values], pa.string()) for c in columns or ()]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.string()), pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(parents, pa.string()), pa.array(positions, pa.int32()), *end], schema=arrow)

    return records.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


def shred_references(references: DataFrame, fields: bool = True, **how) -> DataFrame:
    """:func:`shred` of the table symbol_references; its records' own members come along."""
    used = [F.col("raw"), F.col("support")]
    if fields:
        used = [F.col(c) for c in references.columns if c not in ("ref_id", "received_at")]
    return shred(references.select("ref_id", F.to_json(F.struct(*used)).alias("text")), "reference", "ref_id", "text", REFERENCE, fields, **how)


def shred_states(states: DataFrame, fields: bool = True, **how) -> DataFrame:
    """:func:`shred` of the table graph_states."""
    return shred(states, "state", "state_id", "state_json", STATE, fields, **how)


def all_rows(references: DataFrame, states: DataFrame) -> DataFrame:
    """Rows of all tables of both sources, each once however often its record was delivered."""
    rows = shred_references(references).unionByName(shred_states(states))
    return rows.dropDuplicates(["record_kind", "record_id", "child_path"])


def child_objects(references: DataFrame, states: DataFrame) -> DataFrame:
    """record_kind, record_id and child_path of every object in a declared child list.

    They are the keys of the tables' rows: parsed, grouped and pivoted as for those.
    """
    rows = shred_references(references, False, declared=True).unionByName(shred_states(states, False, declared=True))
    return rows.where("child_path != ''").select("record_kind", "record_id", "child_path").distinct()


def flat_table(references: DataFrame | None, states: DataFrame | None, names: tuple[str, ...], columns: dict[str, str]) -> DataFrame:
    """One typed flat table: its key, its parent's path, its position and ``columns``.

    ``names`` are the table's names in both sources, either of which may be left out. Only its
    rows and columns leave the parsing task; they are typed before redeliveries are taken out.
    """
    how = {"tables": names, "columns": tuple(columns), "declared": True}
    parts = ([shred_references(references, **how)] if references is not None else []) + ([shred_states(states, **how)] if states is not None else [])
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    typed = rows.select("record_kind", "record_id", "child_path", "parent_path", "position", *(F.col(f"c{i}").try_cast(t).alias(c.replace(".", "_")) for i, (c, t) in enumerate(columns.items())))
    return typed.dropDuplicates(["record_kind", "record_id", "child_path"])
