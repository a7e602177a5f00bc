"""Source files that were generated, minified or vendored, or that are data saved as code.

Every file and every directory of a repository's tree is a variable with five labels, of which
generated and vendored have two states: of those that leave marks in their files and of those
that leave none. A file's own evidence (name, head and shape of its content) is a unary factor;
a directory and its children, files as well as directories, are joined by a compatibility, so
that siblings tell of each other through their directory. What a directory's name says is part
of its compatibility with its parent: a name like vendor marks where something else begins. All
factors are finite and messages pass both ways along every edge. The graph is a tree, and sum-product belief propagation is exact with one pass up and one pass down, a level
of directories at a time. Messages of files are summed before they are shuffled, and the passes
run over the table of directories; files are joined to it once at the end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strataloom.functions.languages import is_programming
from strataloom.runtime import cut

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: States of a variable: the labels, and generated and vendored without marks.
STATES = (*LABELS, "generated_unmarked", "vendored_unmarked")

# Directory names and file name endings that tell of a file's origin.
VENDOR_DIRS = ("vendor", "vendored", "_vendor", "node_modules", "bower_components", "jspm_packages", "third_party", "third-party", "thirdparty", "3rdparty", "external", "extern", "site-packages", "dist-packages", "godeps")
GENERATED_DIRS = ("gen", "generated", "__generated__", "_generated", "autogen", "auto_generated", "codegen_out", "generated-sources", "gensrc")
BUILD_DIRS = ("dist", "build", "public", "static", "assets", "out")
GENERATED_ENDINGS = r"(_pb2(_grpc)?\.pyi?|[._]pb\.(js|ts|go|rs|py)|\.pb\.gw\.go|_grpc\.pb\.go|\.g\.(js|ts)|_bindgen\.rs|[._](gen|generated|autogen)\.\w+|zz_generated[^/]*)$"
MINIFIED_ENDINGS = r"([.-]min|\.bundle|\.chunk|\.prod|\.packed)\.[cm]?[jt]sx?$"
# What the heads of generated and of vendored files say.
GENERATED_HEAD = re.compile(
    r"(code generated by|generated by .{0,60}(do not|edits|changes|compiler)|do not (edit|modify)|do-not-(edit|modify)|auto-?generated (file|by|from|code)|<auto-?generated|@generated\b|machine[ -](output|made|generated)"
    r"|(edits|changes)[^\n]{0,40}(vanish|lost|overwritten)|generated from \S+|written by \w+, changes|output of \w+\. source of truth|rebuilt on every \w+ from"
    r"|(automatisch|maschinell) (erzeugt|erstellt|generiert)|nicht (von hand|manuell) (bearbeiten|ändern)|ne pas (modifier|éditer)|(produit|généré|créé) par \w+|(creado|generado|producido) por \w+|no (lo )?(edite|editar|modificar)|自動生成|自动生成)",
    re.I,
)
NOT_GENERATED = re.compile(r"(used to be|was once|were once|once|no longer|not|never|formerly)\W+(be(en)?\W+)?(auto-?)?@?generated|by hand (now|since)|written by hand|edited by hand|(generated|@generated)\W+once|generator is gone|von hand (geschrieben|gepflegt)|écrit à la main|escrito a mano", re.I)
VENDORED_HEAD = re.compile(
    r"(imported from upstream|upstream (owner|source|project)\s*:|(unmodified|verbatim) copy of|(copied|vendored|taken|adapted) from \S+[/@ ]v?\d|bundled\s*:\s*\S+-\d|\borigin\s*:\s*\w[^\n]{0,60}licen[cs]e|do not patch here"
    r"|^\W*[a-z][\w.-]*\s+v?\d+\.\d+(\.\d+)?\s*\|\s*\(c\)|^\W*[a-z][\w.-]*\s+v\d+\.\d+(\.\d+)?\s*\n\W*copyright[^\n]*\n\W*(released|licensed|distributed) under)",
    re.I | re.M,
)
_COMMENT = re.compile(r"\s*(//|#|/\*|\*|<!--|--|;)")
_WORD = re.compile(r"\w")
_PREAMBLE = re.compile(r"\s*(package|module|from __future__|[\"']use strict)")
_IMPORT = re.compile(r"\s*(package\b|module\b|[\"']use strict|import\b|from\s+\S+\s+import\b|(pub(\([^)]*\))?\s+)?use\s|extern\s+crate\b|export\b[^=;(]*\bfrom\b|(const|let|var)\s+[^=;]+=\s*require\s*\(|require\s*\()")
_BANNER = re.compile(r"^\s*/\*[^\n]*?\*/\s*")
_DOC = re.compile(r'\s*(?:[rbu]{0,2}"""[^"]*"""|[rbu]{0,2}\'\'\'[^\']*\'\'\')')
_LITERAL_LINE = re.compile(r"""^[\s\[\](){},;:|+&'"-]*(?>(?:-?0[xXbo][0-9a-fA-F_]+|-?\d[\d_.eE+-]*[a-z0-9]{0,3}|[bur]{0,2}"(?:[^"\\\n]|\\.)*"|[bur]{0,2}'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|true|false|null|None|True|False)[\s\[\](){},;:|+=>-]*+)++$""")
_DATA_START = re.compile(r"""^\s*(?:(?:pub|export|static|const|let|var|final|default)\s+)*(?:static|const|let|var)?\s*[\w$.]+(?:\s*:\s*[^=]{1,60})?\s*(?:=|:=)?\s*(?:&?\[|\{|\(|\[\]\w+\{|b?["'`])|^\s*(?:package|module|use|import|from)\b[^(){}]*$""")
_WORDS, _NUMBERS = re.compile(r"[A-Za-z_$]\w*"), re.compile(r"\d+")
_QUOTED_RUN = re.compile(r"""["'`][^"'`\n]{60,}["'`]|(?:-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?)\s*,\s*){12,}""")
_NO_VALUE = frozenset("acdeghijklmopqsvwxyzABCDEGHIJKLMOPQRSUVWXYZ_$#@/*<}")
#: Sizes from which shape tells something.
MIN_SHAPE_LINES, LONG_LINE, LONG_MEAN = 12, 400, 200


def _comments(lines: list[str], at: int, skipped: re.Pattern) -> tuple[str, int]:
    """The comments from line ``at`` on, whole, up to the first line that is neither comment nor
    skipped; and that line's number. Lines without a word are left out."""
    out: list[str] = []
    until, depth = "", 0
    while at < len(lines):
        line = lines[at]
        s = line.strip()
        if until:
            part, end, _ = line.partition(until)
            out.append(part)
            until = "" if end else until
        elif s.startswith("/*"):
            rest = s
            while rest.startswith("/*"):
                part, end, rest = rest[2:].partition("*/")
                out.append(part)
                until, rest = "" if end else "*/", rest.lstrip()
            if _COMMENT.match(rest):
                out.append(rest)
        elif s.startswith(('"""', "'''")):
            part, end, _ = s[3:].partition(s[:3])
            out.append(part)
            until = "" if end else s[:3]
        elif not s or _COMMENT.match(line):
            out.append(line)
        elif depth > 0 or skipped.match(line):
            depth = max(0, depth + sum(map(line.count, "([{")) - sum(map(line.count, ")]}")))
        else:
            break
        at += 1
    return "\n".join(x for x in out if _WORD.search(x)), at


def heads_of(text: str) -> tuple[str, str]:
    """The comments before a file's first code, also behind a module docstring, and those from
    there to the first code that is no import."""
    lines = text.split("\n")
    head, at = _comments(lines, 0, _PREAMBLE)
    return head, _comments(lines, at, _IMPORT)[0]


def tail_of(text: str) -> str:
    """The comments behind a file's last code."""
    out: list[str] = []
    inside = False
    for line in reversed(text.rstrip().split("\n")):
        s = line.strip()
        if not inside and s.endswith("*/") and "/*" not in s:
            inside = True
        elif inside:
            inside = "/*" not in s
        elif s and not _COMMENT.match(line):
            break
        if _WORD.search(line):
            out.append(line)
    return "\n".join(reversed(out))


def file_evidence(path: str | None, content: bytes | None) -> tuple[float, ...]:
    """Log evidence of a file for each state, relative to handwritten.

    Null content or an empty file has no evidence but its name's; code without any mark has a
    little for handwritten. The weights are log odds set
    by hand: about 8 where a mark tells by itself, about 3 where it tells with others.
    """
    generated = minified = vendored = blob = 0.0
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    if re.search(GENERATED_ENDINGS, name):
        generated += 8
    if re.search(MINIFIED_ENDINGS, name):
        minified += 8
    text = (content or b"").decode("utf-8", "replace").lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    head, under = heads_of(text)
    tail = tail_of(text)
    if head or under or tail:
        if any(GENERATED_HEAD.search(x) and not NOT_GENERATED.search(x) for x in (head, under, tail)):
            generated += 9
        if VENDORED_HEAD.search(head) or VENDORED_HEAD.search(under):
            vendored += 9
        if NOT_GENERATED.search(head):
            generated -= 3
    body = [x for x in text.split("\n") if x.strip()]
    code = [x for x in (_BANNER.sub("", line) if line.lstrip().startswith("/*") else line for line in body) if x and not _COMMENT.match(x)]
    size = sum(map(len, code))
    if size >= 120:
        plain = [_is_literal(x) for x in code]
        literal = sum(len(x) for x, is_it in zip(code, plain) if is_it)
        starts = 0
        if literal > 0.6 * size:
            starts = sum(len(x) for x, is_it in zip(code, plain) if not is_it and len(x) < 120 and "(" not in x and _DATA_START.match(x))
        share = (literal + starts) / size
        if share > 0.9 and literal > 0.6 * size:
            blob += 8
        elif share > 0.8 and literal > 0.6 * size:
            blob += 4
        long = sum(len(x) for x in code if len(x) > LONG_LINE and not _mostly_data(x)) / size
        mean = size / len(code)
        if blob < 8 and (long > 0.6 or mean > LONG_MEAN):
            minified += 8
        if len(code) >= MIN_SHAPE_LINES:
            shapes = _NUMBERS.sub("0", _WORDS.sub("a", "\n".join(code))).split("\n")
            distinct = len(set(shapes)) / len(shapes)
            # The names count up or repeat a pattern in whatever a tool wrote out of a table.
            if distinct < 0.25 and blob < 4:
                generated += 8 * min(1.0, (0.33 - distinct) / 0.1)
    if not (generated or minified or vendored or blob) and size >= 60:
        return UNMARKED
    return 0.0, generated, minified, vendored, blob, generated - MARKED, vendored - MARKED


def _is_literal(line: str) -> bool:
    """Whether a line is only values, marks between them and brackets, or one long literal."""
    if len(line) >= 120 and _mostly_data(line):
        return True
    first = line.lstrip()[:1]
    return first not in _NO_VALUE and _LITERAL_LINE.match(line) is not None


def _mostly_data(line: str) -> bool:
    """Whether a long line is one literal rather than code without breaks."""
    return sum(len(m) for m in _QUOTED_RUN.findall(line)) > 0.8 * len(line)


#: Log prior of a root, by state.
ROOT_PRIOR = (0.0, -7.0, -7.0, -7.0, -7.0, -7.5, -7.5)
# P(file | its directory) by states in their order. What files without marks say is nearly the
# same for directories of handwritten and of unmarked files.
_FILE = (
    (0.963, 0.008, 0.008, 0.008, 0.003, 0.005, 0.005),
    (0.020, 0.940, 0.005, 0.010, 0.005, 0.015, 0.005),
    (0.300, 0.020, 0.640, 0.010, 0.010, 0.010, 0.010),
    (0.010, 0.005, 0.005, 0.955, 0.005, 0.005, 0.015),
    (0.300, 0.020, 0.010, 0.010, 0.640, 0.010, 0.010),
    (0.020, 0.006, 0.008, 0.008, 0.003, 0.950, 0.005),
    (0.012, 0.004, 0.004, 0.008, 0.003, 0.005, 0.956),
)
# P(directory | its parent): mostly it is what its parent is.
_DIRECTORY = (
    (0.9825, 0.0020, 0.0040, 0.0040, 0.0020, 0.0025, 0.0030),
    (0.0200, 0.9630, 0.0040, 0.0040, 0.0030, 0.0020, 0.0040),
    (0.1800, 0.0100, 0.7800, 0.0100, 0.0100, 0.0050, 0.0050),
    (0.0080, 0.0020, 0.0030, 0.9800, 0.0030, 0.0020, 0.0020),
    (0.1800, 0.0100, 0.0100, 0.0100, 0.7800, 0.0050, 0.0050),
    (0.0150, 0.0008, 0.0040, 0.0012, 0.0020, 0.9750, 0.0020),
    (0.0080, 0.0008, 0.0030, 0.0012, 0.0020, 0.0020, 0.9830),
)
#: Log evidence of code that carries no mark at all: many files of the other labels carry one.
UNMARKED = (0.0, -2.5, -3.0, -0.7, -3.0, 0.0, 0.0)
_N = len(STATES)


def _balanced(rows: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """``rows`` with those states' own entries set so that files of ``evidence`` say the same of them as
    of handwritten: however many unmarked files there are, they don't speak for unmarked origins."""
    out, weight = rows.copy(), np.exp(evidence)
    for i in (STATES.index("generated_unmarked"), STATES.index("vendored_unmarked")):
        out[i, i] += (out[0] @ weight - out[i] @ weight) / weight[i]
    return out


COMPATIBLE = np.log(_balanced(np.array(_FILE), np.array(UNMARKED)))


def _named(states: tuple[str, ...], begins: float, goes_on: float, otherwise: float) -> np.ndarray:
    """P(a directory has a name of some kind | parent, directory): by whether the directory is in one
    of ``states`` and its parent isn't, whether both are, and else."""
    inside = np.array([s in states for s in STATES])
    return np.where(inside[None, :], np.where(inside[:, None], goes_on, begins), otherwise)


_VENDOR_NAMED = _named(("vendored", "vendored_unmarked"), 0.7, 0.002, 5e-5)
_GENERATED_NAMED = _named(("generated", "generated_unmarked"), 0.6, 0.002, 5e-5)
#: Log compatibility of a directory with its parent by the kind of its name: plain, vendor, generated.
COMPATIBLE_DIRS = np.log(np.array(_DIRECTORY)[None] * np.stack([1 - _VENDOR_NAMED - _GENERATED_NAMED, _VENDOR_NAMED, _GENERATED_NAMED]))
#: What a mark speaks against the states without marks.
MARKED = 7.0


def directory_evidence(name: Column) -> list[Column]:
    """Log evidence of a directory for minified files from its name, or a root's prior."""
    low = F.lower(name)
    named = [F.when(low.isin(*BUILD_DIRS), 4.0).otherwise(0.0) if s == "minified" else F.lit(0.0) for s in STATES]
    return [F.when(F.col("dir") == "", F.lit(ROOT_PRIOR[i])).otherwise(named[i]) for i in range(_N)]


def name_kind(name: Column) -> Column:
    """Which compatibility a directory's name asks for: 0 plain, 1 vendor, 2 generated."""
    low = F.lower(name)
    return F.when(low.isin(*VENDOR_DIRS), 1.0).when(low.isin(*GENERATED_DIRS), 2.0).otherwise(0.0)


def _lse(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=-1, keepdims=True)))[..., 0]


def to_parent(child: np.ndarray, compatible: np.ndarray = COMPATIBLE) -> np.ndarray:
    """Log messages of children (a row each) to each state of their directory."""
    return _lse(child[:, None, :] + compatible)


def to_child(parent: np.ndarray, compatible: np.ndarray = COMPATIBLE) -> np.ndarray:
    """Log messages of directories to each state of a child."""
    return _lse(parent[:, None, :] + np.swapaxes(compatible, -1, -2))


def of_kind(kinds: np.ndarray) -> np.ndarray:
    """The compatibility of each directory with its parent, by its name's kind (first of its row)."""
    return COMPATIBLE_DIRS[kinds[:, 0].astype(np.int64)]


def _cols(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(_N)]


def _doubles(*prefixes: str) -> str:
    return "".join(f", {p}{i} double" for p in prefixes for i in range(_N))


def _stepped(df: DataFrame, keep: list[str], step: Callable[..., list[np.ndarray]], read: str, made: str) -> DataFrame:
    """``keep`` columns of ``df`` and the vectors ``made`` that ``step`` makes of the vectors ``read``; both are letters."""
    kept = df.select(*keep, *(c for p in read for c in _cols(p)))
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in kept.schema.fields[: len(keep)]] + [pa.field(f"{p}{i}", pa.float64()) for p in made for i in range(_N)]
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = len(keep)
            vectors = [np.stack([batch.column(at + k * _N + i).to_numpy(zero_copy_only=False) for i in range(_N)], axis=1) for k in range(len(read))]
            out = [v for x in step(*vectors) for v in x.T]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(arrow.field(i).type) for i in range(at)), *(pa.array(np.ascontiguousarray(v)) for v in out)], schema=arrow)

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])
    return kept.mapInArrow(run, plain + _doubles(*made))


def evidence_table(files: DataFrame) -> DataFrame:
    """file_id, repo, dir and log evidence e0..e6 of each file, once per file_id.

    Where deliveries of one file_id differ, an arbitrary one of them counts. A null path lies
    in the root; a null repository is one of its own.
    """
    schema = "file_id long, repo string, path string, code boolean" + _doubles("e", "f")
    arrow = pa.schema([("file_id", pa.int64()), ("repo", pa.string()), ("path", pa.string()), ("code", pa.bool_()), *((f"{p}{i}", pa.float64()) for p in "ef" for i in range(_N))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            found = np.array([file_evidence(p, c) for p, c in zip(b.column(2).to_pylist(), b.column(4).to_pylist())])
            scores = [pa.array(np.ascontiguousarray(v)) for x in (found, to_parent(found)) for v in x.T]
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(arrow.field(i).type) for i in range(4)), *scores], schema=arrow)

    rows = files.select(
        F.col("file_id").cast("long"), F.coalesce(F.col("cache_key"), F.lit("")).alias("repo"), F.coalesce(F.regexp_replace("rel_path", r"\\", "/"), F.lit("")).alias("path"),
        is_programming(F.col("language"), F.col("rel_path")).alias("code"), F.col("content").cast("binary"),
    )
    found = rows.mapInArrow(run, schema).dropDuplicates(["file_id"])
    return found.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit("")))


def _with_depth(dirs: DataFrame) -> DataFrame:
    depth = F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(F.split("dir", "/")))
    parent = F.when(F.col("depth") <= 1, F.lit("")).otherwise(F.regexp_replace("dir", r"/[^/]*$", ""))
    return dirs.withColumn("depth", depth).withColumn("parent", parent)


def propagate(evidence: DataFrame) -> DataFrame:
    """Posterior of each file: the columns of ``evidence`` and probabilities handwritten .. blob, the
    states of a label together.

    A file's message to its directory is summed with its siblings' before it is shuffled.
    There are as many levels as the deepest path has. Each is needed twice, so each is written
    to the checkpoint folder, and no level is worked out again for the next.
    """
    evidence = cut(evidence)
    leaves = evidence.groupBy("repo", "dir").agg(*(F.sum(f"f{i}").alias(f"f{i}") for i in range(_N)))
    steps = F.split("dir", "/")
    up_to = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(steps))), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    paths = leaves.select("repo", F.explode(up_to).alias("dir")).distinct()
    own = directory_evidence(F.regexp_extract("dir", r"([^/]*)$", 1))
    marked = paths.join(leaves, ["repo", "dir"], "left").select("repo", "dir", *((own[i] + F.coalesce(F.col(f"f{i}"), F.lit(0.0))).alias(f"o{i}") for i in range(_N)), name_kind(F.regexp_extract("dir", r"([^/]*)$", 1)).alias("n0"), *(F.lit(0.0).alias(f"n{i}") for i in range(1, _N)))
    dirs = cut(_with_depth(marked))
    deepest = dirs.agg(F.max("depth")).first()[0] or 0
    level: dict[int, DataFrame] = {}
    sums: DataFrame | None = None
    for d in range(deepest, -1, -1):
        here = dirs.where(F.col("depth") == d)
        if sums is None:
            here = here.select("*", *(F.lit(0.0).alias(f"s{i}") for i in range(_N)))
        else:
            here = here.join(sums, (here.repo == sums.p_repo) & (here.dir == sums.p_dir), "left").select(here["*"], *(F.coalesce(F.col(f"c{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(_N)))
        here = cut(_stepped(here, ["repo", "dir", "parent"], lambda o, s, n: [o + s, to_parent(o + s, of_kind(n)), n], "osn", "tmn"))
        level[d] = here
        sums = here.groupBy(F.col("repo").alias("p_repo"), F.col("parent").alias("p_dir")).agg(*(F.sum(f"m{i}").alias(f"c{i}") for i in range(_N)))
    above: DataFrame | None = None
    beliefs: DataFrame | None = None
    for d in range(deepest + 1):
        here = level[d]
        if above is None:
            here = here.select("repo", "dir", *(F.col(f"t{i}").alias(f"b{i}") for i in range(_N)))
        else:
            up = above.select(F.col("repo").alias("p_repo"), F.col("dir").alias("p_dir"), *(F.col(f"b{i}").alias(f"p{i}") for i in range(_N)))
            joined = here.join(up, (here.repo == up.p_repo) & (here.parent == up.p_dir), "inner")
            here = cut(_stepped(joined, ["repo", "dir"], lambda t, m, n, p: [t + to_child(p - m, of_kind(n))], "tmnp", "b"))
        above = here
        beliefs = here if beliefs is None else beliefs.unionByName(here)
    at = beliefs.select(F.col("repo").alias("d_repo"), F.col("dir").alias("d_dir"), *_cols("b"))
    joined = evidence.join(at, (evidence.repo == at.d_repo) & (evidence.dir == at.d_dir), "inner")

    def posterior(e: np.ndarray, f: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        z = e + to_child(b - f)
        return [np.exp(z - _lse(z)[:, None])]

    final = _stepped(joined, ["file_id", "repo", "path", "code"], posterior, "efb", "z")
    of_label = [[i for i, s in enumerate(STATES) if s.split("_")[0] == label] for label in LABELS]
    return final.select("file_id", "repo", "path", "code", *(sum((F.col(f"z{i}") for i in at[1:]), F.col(f"z{at[0]}")).alias(label) for label, at in zip(LABELS, of_label)))


def origin_of_files(files: DataFrame) -> DataFrame:
    """Label and probabilities of every source file of a programming language, once per file.

    Columns: file_id, cache_key ('' if null), rel_path, label and one probability per label.
    Ties between labels go to the first in LABELS. An empty table gives an empty result.
    """
    found = propagate(evidence_table(files)).where("code")
    best = F.greatest(*(F.col(x) for x in LABELS))
    label = F.coalesce(*(F.when(F.col(x) == best, F.lit(x)) for x in LABELS))
    return found.select("file_id", F.col("repo").alias("cache_key"), F.col("path").alias("rel_path"), label.alias("label"), *LABELS)


def not_handwritten(files: DataFrame) -> DataFrame:
    """file_id of the source files that are more likely anything else than handwritten."""
    return origin_of_files(files).where(F.col("handwritten") < 0.5).select("file_id")
