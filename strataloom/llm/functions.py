"""Functions paired with their documentation.

A parsing-expression grammar for each language finds functions and methods with the comment or
string that documents them, at their offsets in the source. The grammars are islands: what is
no function, comment, string or bracket is water, so that files which don't parse still give
their functions. Semantic actions emit a unit for each function, and units are joined to the
symbols by place. Before that the documentation of each pair is judged where it was parsed,
again from a grammar's parts: what is left of it once marks, tags, templates, notes to tools,
licences, disabled code and pointers are gone has to hold a word that name, signature and
general talk don't. Documentation, name and signature are the grammar's own; the symbols only
lend their keys to the pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataloom.functions.languages import PROGRAMMING, language_of
from strataloom.llm.docwords import informative
from strataloom.llm.peg import Peg, nested

_BRACED = r"""
File <- (Function / Comment / String / Body / Water / ~[{}]~)*
Body <- ~\{\s*~ (Function / Comment / String / Body / Water)* ~\}|\Z~
Water <- ~[^"'`{}/\n]*\n\s*|[^"'`{}/\n]+|[^{}]~
String <- ~"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.){0,2}'~
Comment <- ~//[^\n]*\s*|/\*(?:[^*]|\*(?!/))*\*/\s*~
Paren <- ~\(~ (~[^()"'`/]+~ / String / Comment / Paren / ~[^)]~)* ~\)~
Angle <- ~<~ (~[^<>(){};=]+|=>|=~ / Angle / Paren)* ~>~
"""
_SCRIPT_HEAD = r"(?!(?:if|for|while|switch|catch|with|function|return|new|typeof|await|else|do|super|import)\b)\#?[A-Za-z_$][\w$]*[?!]?\s*(?:<[^()\n]*>)?\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\s*(?::[^;{}\n]*(?:\{[^{}\n]*\}[^;{}\n]*)?)?\{"
_SCRIPT_WORDS = r"(?:public|private|protected|static|async|override|readonly|abstract|get|set|declare|export|default)\b"
_GRAMMARS = {
    "go": _BRACED + r"""
Function <- &~func\b|//|/\*~ DocGo? ~func[ \t]+~ (Paren ~[ \t]*~)? Name ~(?:\[[^\]\n]*\])?[ \t]*~ Params Result Body
DocGo <- DocLines / DocBlock
DocLines <- ~(?://[^\n]*\n[ \t]*)+(?=func\b)~
DocBlock <- ~/\*(?:[^*]|\*(?!/))*\*/[ \t]*\n[ \t]*(?=func\b)~
Name <- ~[^\W\d]\w*~
Params <- Paren
Result <- ~[ \t]*(?:[^{}\n]|(?:interface|struct)[ \t]*\{[^{}\n]*\})*(?=\{)~
""",
    "rust": _BRACED + r"""
Function <- &~//|/\*|\#\[|(?:pub|fn|async|const|unsafe|extern|default)\b~ DocRust? Attributes ~(?:pub(?:\([^)\n]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+"[^"]*")?)\s+)*fn\s+~ Name Angle? Params Result (~;~ / Body)
DocRust <- DocLines / DocBlock
DocLines <- ~(?://[^\n]*\n[ \t]*)+(?=(?:\#\[|(?:pub|fn|async|const|unsafe|extern|default)\b))~
DocBlock <- ~/\*(?:[^*]|\*(?!/))*\*/\s*(?=(?:\#\[|(?:pub|fn|async|const|unsafe|extern|default)\b))~
Attributes <- ~(?:\#\[[^\n]*\]\s*)*~
Name <- ~(?:r\#)?[^\W\d]\w*~
Params <- Paren
Result <- ~[^{};]*(?:\[[^\]]*;[^\]]*\][^{};]*)*(?=[{;])~
""",
    "script": _BRACED.replace(r"|'(?:[^'\\\n]|\\.){0,2}'", r"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`") + rf"""
Function <- &~(?<![\w$.])(?:/|@|(?:function|const|let|var)\b|{_SCRIPT_WORDS}|\*|{_SCRIPT_HEAD})~ DocScript? Decorators Head
Head <- ~(?:(?:export|default|declare)\s+)*(?:async\s+)?function\b\s*\*?\s*~ Name Angle? Params Result (Body / ~;?~) / ~(?:export\s+)?(?:const|let|var)\s+~ Name ~[^=;{{}}()\n]*=\s*(?:async\s*)?~ Angle? Params Result ~=>\s*~ Body / ~(?:{_SCRIPT_WORDS}\s+)*\*?\s*~ &~{_SCRIPT_HEAD}~ Name ~[?!]?\s*~ Angle? Params Result Body
DocScript <- DocBlock / DocLines
DocLines <- ~(?://[^\n]*\n[ \t]*)+(?=(?:function\b|(?:const|let|var)\b[^\n]*\(|{_SCRIPT_WORDS}|@|\*|{_SCRIPT_HEAD}))~
DocBlock <- ~/\*(?:[^*]|\*(?!/))*\*/[^\S\n]*\n?[ \t]*(?=(?:function\b|(?:const|let|var)\b[^\n]*\(|{_SCRIPT_WORDS}|@|\*|{_SCRIPT_HEAD}))~
Decorators <- ~(?:@[\w$.]+(?:\([^()\n]*\))?\s+)*~
Name <- ~\#?[A-Za-z_$][\w$]*~
Params <- Paren
Result <- ~\s*(?::\s*[^{{}};=\n]*(?:\{{[^{{}}\n]*\}}[^{{}};=\n]*)?)?(?=\s*(?:\{{|=>|;))~
""",
    "python": r"""
File <- (Function / Line)*
Line <- ~(?:[^\n"'\#]|"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|["'])*(?:\#[^\n]*)?\n?~
Function <- ~[ \t]*(?:async[ \t]+)?def[ \t]+~ Name ~[ \t]*(?:\[[^\]\n]*\])?[ \t]*~ Params Result ~:[ \t]*(?:\#[^\n]*)?(?:\n[ \t]*)*~ DocString?
Name <- ~[^\W\d]\w*~
Params <- Paren
Paren <- ~\(~ (~[^()"'\#]+~ / String / Paren / ~\#[^\n]*|[^)]~)* ~\)~
String <- ~"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'~
Result <- ~[ \t]*(?:->[ \t]*[^\n:]*(?:\[[^\n]*\])?[^\n:]*)?~
DocString <- ~[rRuU]?(?:"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')[ \t]*(?=\n|;|$)~
""",
}


_BLANKS = re.compile(r"[ \t\n]*")


def _span(kind: str):
    return lambda text, start, end, values: [(kind, start, end)]


def _function(text: str, start: int, end: int, values: list) -> list:
    """A unit from the parts of one function; units of functions inside it follow."""
    own = {v[0]: v for v in reversed(values) if v[0] != "unit"}
    inner = [v for v in values if v[0] == "unit"]
    if "name" not in own or "params" not in own:
        return inner
    doc, name, params = own.get("doc"), own["name"], own["params"]
    result = own.get("result", params)
    begin = start + len(_BLANKS.match(text, start).group())
    return [("unit", begin, end, text[name[1] : name[2]], text[params[1] : params[2]], text[doc[1] : doc[2]] if doc else None, text[params[1] : max(params[2], result[2])]), *inner]


@lru_cache(maxsize=None)
def grammar(language: str) -> Peg:
    """The grammar of functions and documentation of a language, compiled once in each process."""
    name = "script" if language in ("javascript", "typescript") else language
    doc = _span("doc")
    return Peg(_GRAMMARS[name], {"Function": _function, "Name": _span("name"), "Params": _span("params"), "Result": _span("result"), "DocLines": doc, "DocBlock": doc, "DocString": doc})


def units_of(language: str, content: bytes) -> list[tuple[int, int, str, str, str | None]]:
    """:func:`signed_units` without the signatures."""
    return [u[:5] for u in signed_units(language, content)]


def signed_units(language: str, content: bytes) -> list[tuple[int, int, str, str, str | None, str]]:
    """Byte offsets (start, end), name, parameters, raw documentation and signature (parameters and result) of each function.

    Offsets count from the content's first byte; the documentation in front belongs to the unit.
    A Python unit ends where its lines' indentation does. A function that the file's end cuts off
    ends there. Nesting may be as deep as the text has brackets.
    """
    text = content.decode("utf-8", "surrogateescape")
    plain = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    with nested(sum(map(plain.count, "{([<"))):
        _, values = grammar(language).parse("File", plain)
    found = [v for v in values if v[0] == "unit"]
    if language == "python":
        found = [(v[0], v[1], _python_end(plain, v[1], v[2]), *v[3:]) for v in found]
    at = _byte_offsets(text, sorted({x for v in found for x in v[1:3]}), plain is not text)
    return [(at[v[1]], at[v[2]], *v[3:]) for v in found]


def _python_end(text: str, start: int, head: int) -> int:
    indent = start - (text.rfind("\n", 0, start) + 1)
    m = re.compile(rf"\n[ \t]{{0,{indent}}}[^\s#)\]}}]").search(text, max(head - 1, start))
    end = m.start() if m else len(text)
    return end - (len(text[start:end]) - len(text[start:end].rstrip()))


def _byte_offsets(text: str, places: list[int], folded: bool) -> dict[int, int]:
    """Bytes before each character place; with ``folded`` places count line ends as one character."""
    out, at, size = {}, 0, 0
    if folded:
        # Walk the original text line by line, as the folded one was read.
        starts, k = [m.end() for m in re.finditer(r"\r\n|\r|\n", text)], 0
        lines = [0, *starts]
        folded_starts, plain_at = [0], 0
        for a, b in zip(lines, lines[1:]):
            plain_at += b - a - (1 if text[b - 2 : b] == "\r\n" else 0)
            folded_starts.append(plain_at)
        for p in places:
            while k + 1 < len(lines) and folded_starts[k + 1] <= p:
                k += 1
            real = lines[k] + p - folded_starts[k]
            size += len(text[at:real].encode("utf-8", "surrogateescape"))
            at = real
            out[p] = size
        return out
    for p in places:
        size += len(text[at:p].encode("utf-8", "surrogateescape"))
        at, out[p] = p, size
    return out


_UNIT = "cache_key string, file_path string, language string, start long, end long, name string, params string, doc string, code string"
_UNIT_ARROW = pa.schema([("cache_key", pa.string()), ("file_path", pa.string()), ("language", pa.string()), ("start", pa.int64()), ("end", pa.int64()), *((x, pa.string()) for x in ("name", "params", "doc", "code"))])


def _text(value: str | None) -> str | None:
    """``value`` without the lone surrogates that stand for bytes that are no UTF-8."""
    return value.encode("utf-8", "replace").decode() if value else value


def extract_units(files: DataFrame, code: bool = True, documented: bool = False) -> DataFrame:
    """A row for each function in ``files``: its place, name, parameters, raw documentation and code.

    A file delivered again gives its units again. Files without a programming language and null
    contents give none. ``code`` false leaves the code null. With ``documented`` only functions
    whose documentation says something are given, so that no other leaves the parsing task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths, languages = (batch.column(i).to_pylist() for i in range(3))
            rows = []
            for i, (key, path, language) in enumerate(zip(keys, paths, languages)):
                content = batch.column(3)[i].as_py()
                for start, end, name, params, doc, signature in signed_units(language, content) if content else ():
                    params, doc = _text(params), _text(doc)
                    if documented and not informative(name, _text(signature), doc):
                        continue
                    rows.append((key, path, language, start, end, _text(name), params, doc, content[start:end].decode("utf-8", "replace") if code else None))
            columns = list(zip(*rows)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _UNIT_ARROW)], schema=_UNIT_ARROW)

    rows = files.select(F.col("cache_key").cast("string"), F.col("rel_path").cast("string").alias("file_path"), language_of(F.col("language"), F.col("rel_path")).alias("language"), F.col("content").cast("binary"))
    return rows.where(F.col("language").isin(*PROGRAMMING)).mapInArrow(run, _UNIT)


def _functions(symbols: DataFrame) -> DataFrame:
    kind = F.lower(F.trim(F.col("kind")))
    return symbols.where(kind.isin("function", "method")).select("ord", "cache_key", "file_path", "byte_offset")


def documented_functions(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs of code and documentation of functions and methods whose documentation says something.

    Columns: ord, cache_key, file_path, name, documentation and code, all but ord as the grammar
    emitted them; a symbol only lends its ord to the pair at its place. A symbol without a pair
    at its place (null places included) gives no row; one delivered again, or whose file was,
    gives one. Null contents and texts have no functions.
    """
    pairs = extract_units(files, documented=True).dropDuplicates(["cache_key", "file_path", "start"])
    asked = _functions(symbols)
    at = (asked.cache_key == pairs.cache_key) & (asked.file_path == pairs.file_path) & (asked.byte_offset == pairs.start)
    joined = pairs.join(asked.distinct(), at).select("ord", pairs.cache_key, pairs.file_path, pairs.name, pairs.doc.alias("documentation"), pairs.code)
    return joined.dropDuplicates(["ord"])


def documented_ords(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """ord of the functions and methods at whose place the grammar emits a pair that says something.

    As :func:`documented_functions`; the texts stay in the parsing task and only places are joined.
    """
    places = extract_units(files, code=False, documented=True).select("cache_key", "file_path", F.col("start").alias("byte_offset"))
    return _functions(symbols).join(places, ["cache_key", "file_path", "byte_offset"], "left_semi").select("ord").distinct()
