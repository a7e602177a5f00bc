"""Observations joined to what is indexed: owners, imports and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataloom.functions.text import ancestors


#: Widths of bins of spans, as powers of two: of narrow spans, and of all that are wider than most files.
_NARROWEST, _WIDEST = 8, 32


def nearest_owner(observations: DataFrame, spans: DataFrame) -> DataFrame:
    """The narrowest span of the same file around each observation.

    observations: obs_id, cache_key, file_path, start, end; spans: cache_key, file_path, span_id,
    s_start, s_end. A span of the same extent holds too; of equally wide ones the later start and
    then the lesser id wins. Observations without a span keep a null span_id.

    A span is as wide as some power of two at most, and lies in one or two bins of that width; an
    observation looks into the one bin of each width that it lies in. So the join is on file and
    bin, and a large file's observations aren't compared with all of its spans.
    """
    width = F.greatest(F.col("s_end") - F.col("s_start"), F.lit(1 << _NARROWEST))
    level = F.least(F.ceil(F.log2(width)), F.lit(_WIDEST)).cast("int")
    shifted = lambda at: F.floor(at / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    placed = spans.withColumn("level", level).withColumn("bin", F.explode(F.array_distinct(F.array(shifted(F.col("s_start")), shifted(F.col("s_end"))))))
    asked = observations.select("obs_id", "cache_key", "file_path", "start", "end", F.explode(F.sequence(F.lit(_NARROWEST), F.lit(_WIDEST))).alias("level")).withColumn("bin", shifted(F.col("start")))
    near = asked.join(placed, ["cache_key", "file_path", "level", "bin"]).where((F.col("s_start") <= F.col("start")) & (F.col("end") <= F.col("s_end")))
    best = near.groupBy("obs_id").agg(F.min(F.struct((F.col("s_end") - F.col("s_start")).alias("width"), (-F.col("s_start")).alias("later"), "span_id")).alias("best"))
    return observations.select("obs_id").distinct().join(best, "obs_id", "left").select("obs_id", F.col("best.span_id").alias("span_id"))


def exact_span(observations: DataFrame, spans: DataFrame) -> DataFrame:
    """Observations whose own extent is that of exactly one span: definite, ambiguous or missing."""
    same = observations.join(spans, (observations.cache_key == spans.cache_key) & (observations.file_path == spans.file_path) & (observations.start == spans.s_start) & (observations.end == spans.s_end), "left")
    seen = same.groupBy("obs_id").agg(F.countDistinct("span_id").alias("n"), F.min("span_id").alias("span_id"))
    return seen.select("obs_id", F.when(F.col("n") == 1, F.col("span_id")).alias("span_id"), F.when(F.col("n") == 1, "definite").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("outcome"))


def deepest_owner(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """The deepest of the owning directories above each path, by its ancestors as join keys.

    paths: cache_key, path; owners: cache_key, directory. The longest-prefix join explodes the
    few ancestors of a path instead of comparing it with every directory.
    """
    up = paths.select("cache_key", "path", F.explode(ancestors(F.col("path"))).alias("directory"))
    found = up.join(owners.select("cache_key", "directory").distinct(), ["cache_key", "directory"])
    best = found.groupBy("cache_key", "path").agg(F.max(F.struct(F.length("directory").alias("n"), "directory")).alias("best"))
    return paths.select("cache_key", "path").distinct().join(best, ["cache_key", "path"], "left").select("cache_key", "path", F.col("best.directory").alias("owner"))


def _joined(base: Column, *rest: Column) -> Column:
    return F.concat_ws("/", F.when(base != "", base), *rest)


def python_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Targets of Python imports.

    imports: import_id, cache_key, file_path, level (dots), module, name ('' for ``import x``).
    Candidates are tried in the order submodule file, submodule package, module file, module
    package, under the importer's directory for relative imports and else under every package
    root. Outcomes: resolved, ambiguous, not_indexed (nothing found) or invalid_specifier.
    """
    py = files.where(F.col("rel_path").endswith(".py")).select("cache_key", F.col("rel_path").alias("target")).distinct()
    parts = F.split("file_path", "/")
    folder = F.slice(parts, F.lit(1), F.size(parts) - 1)
    valid = F.col("module").rlike(r"^$|^[^\W\d]\w*(\.[^\W\d]\w*)*$") & F.col("name").rlike(r"^$|^\*$|^[^\W\d]\w*$") & ((F.col("level") > 0) | (F.col("module") != ""))
    inside = F.col("level") <= F.size(folder) + 1
    asked = imports.withColumn("ok", valid & inside)
    packages = py.where(F.col("target").endswith("/__init__.py") | (F.col("target") == "__init__.py")).select("cache_key", F.regexp_replace("target", r"/?__init__\.py$", "").alias("directory"))
    above = packages.select("cache_key", "directory", F.regexp_replace("directory", r"/?[^/]*$", "").alias("parent"))
    inner = above.join(packages.select("cache_key", F.col("directory").alias("parent")), ["cache_key", "parent"], "left_semi").where("directory <> ''")
    tops = above.join(inner.select("cache_key", "directory"), ["cache_key", "directory"], "left_anti").select("cache_key", F.col("parent").alias("root"))
    roots = tops.unionByName(files.select("cache_key", F.lit("").alias("root"))).distinct()
    up = F.array_join(F.slice(folder, F.lit(1), F.greatest(F.size(folder) - F.col("level") + 1, F.lit(0))), "/")
    relative = asked.where("ok AND level > 0").withColumn("root", up)
    # Absolute imports meet files by their path below a root, so that no import is joined with all roots.
    absolute = asked.where("ok AND level = 0").withColumn("root", F.lit(""))
    based = relative.unionByName(absolute)
    place = _joined(F.col("root"), F.when(F.col("module") != "", F.replace("module", F.lit("."), F.lit("/"))))
    named = F.when((F.col("name") != "") & (F.col("name") != "*"), _joined(place, F.col("name")))
    candidates = F.filter(F.array(F.concat(named, F.lit(".py")), F.concat(named, F.lit("/__init__.py")), F.when(place != "", F.concat(place, F.lit(".py"))), F.when(place != "", F.concat(place, F.lit("/__init__.py"))).otherwise(F.lit("__init__.py"))), lambda c: c.isNotNull())
    tried = based.select("import_id", "cache_key", "root", "level", F.posexplode(candidates).alias("rank", "target"))
    inside_root = F.when(F.col("root") == "", F.col("target")).otherwise(F.expr("substring(target, length(root) + 2)"))
    rooted = py.select("cache_key", "target", F.explode(ancestors(F.col("target"))).alias("root")).join(roots, ["cache_key", "root"]).select("cache_key", "root", inside_root.alias("below"), F.col("target").alias("found"))
    below = tried.where("level = 0").select("import_id", "cache_key", "rank", F.col("target").alias("below")).join(rooted, ["cache_key", "below"]).select("import_id", "root", "rank", F.col("found").alias("target"))
    probes = tried.where("level > 0").join(py, ["cache_key", "target"]).select("import_id", "root", "rank", "target").unionByName(below)
    per_root = probes.groupBy("import_id", "root").agg(F.min_by("target", "rank").alias("target"))
    found = per_root.groupBy("import_id").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    out = asked.join(found, "import_id", "left")
    status = F.when(~F.col("ok"), "invalid_specifier").when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("not_indexed")
    return out.select("import_id", status.alias("status"), F.when(F.col("n") == 1, F.col("target")).alias("target"))


# Which endings a written or missing ending stands for, in order.
SCRIPT_ENDINGS = {".js": (".ts", ".tsx", ".js", ".jsx"), ".jsx": (".ts", ".tsx", ".js", ".jsx"), ".mjs": (".mts", ".mjs"), ".cjs": (".cts", ".cjs"), "": (".ts", ".tsx", ".js", ".jsx")}


def script_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Targets of relative JavaScript and TypeScript imports.

    imports: import_id, cache_key, file_path, specifier. A written .ts, .tsx, .mts or .cts is
    meant exactly; others stand for their sources in order; without an ending the index file of
    a directory is tried last. Specifiers that aren't relative are external.
    """
    folder = F.slice(F.split("file_path", "/"), F.lit(1), F.size(F.split("file_path", "/")) - 1)
    steps = F.filter(F.concat(folder, F.split("specifier", "/")), lambda p: (p != ".") & (p != ""))
    # '..' takes the last part off; past the root the path is null.
    walked = F.aggregate(steps, folder_start(), lambda a, p: F.when(a.isNull() | ((p == "..") & (F.size(a) == 0)), F.lit(None).cast("array<string>")).when(p == "..", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.array_append(a, p)))
    path = F.array_join(walked, "/")
    relative = F.col("specifier").rlike(r"^\.{1,2}(/|$)")
    ending = F.regexp_extract("specifier", r"(\.[cm]?[jt]sx?)$", 1)
    bare = F.regexp_replace(path, r"\.[cm]?[jt]sx?$", "")
    exact = F.array(path)
    options = F.when(ending.isin(".ts", ".tsx", ".mts", ".cts"), exact)
    for written, sources in SCRIPT_ENDINGS.items():
        if written:
            options = options.when(ending == written, F.array(*(F.concat(bare, F.lit(s)) for s in sources)))
    plain = [F.concat(path, F.lit(s)) for s in SCRIPT_ENDINGS[""]]
    options = options.otherwise(F.array(*plain, *(F.concat(path, F.lit(f"/index{s}")) for s in SCRIPT_ENDINGS[""])))
    asked = imports.withColumn("path", path).withColumn("relative", relative)
    probes = asked.where(F.col("relative") & F.col("path").isNotNull()).select("import_id", "cache_key", F.posexplode(options).alias("rank", "target"))
    known = files.select("cache_key", F.col("rel_path").alias("target")).distinct()
    found = probes.join(known, ["cache_key", "target"]).groupBy("import_id").agg(F.min_by("target", "rank").alias("target"))
    status = F.when(~F.col("relative"), "external").when(F.col("path").isNull(), "invalid_specifier").when(F.col("target").isNotNull(), "resolved").otherwise("not_indexed")
    return asked.join(found, "import_id", "left").select("import_id", status.alias("status"), "target")


def folder_start() -> Column:
    return F.array().cast("array<string>")


def go_imports(imports: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """Package directories of Go imports by the longest module path that begins them.

    imports: import_id, cache_key, file_path, specifier; modules: cache_key, module, directory.
    Outcomes: resolved (one directory with Go files), external (no module owns it),
    inaccessible (an internal directory of others), ambiguous or not_indexed.
    """
    spec = F.col("specifier")
    up = imports.where(spec != "").select("import_id", "cache_key", "file_path", "specifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(spec, "/"))), lambda n: F.array_join(F.slice(F.split(spec, "/"), F.lit(1), n), "/"))).alias("module"))
    owned = up.join(modules, ["cache_key", "module"])
    longest = Window.partitionBy("import_id").orderBy(F.length("module").desc())
    owner = owned.withColumn("n", F.rank().over(longest)).where("n = 1")
    rest = F.expr("substring(specifier, length(module) + 2)")
    placed = owner.select("import_id", "cache_key", "file_path", "specifier", _joined(F.col("directory"), F.when(rest != "", rest)).alias("target"))
    packages = files.where(F.col("rel_path").endswith(".go") & ~F.col("rel_path").endswith("_test.go")).select("cache_key", F.regexp_replace("rel_path", r"/?[^/]*$", "").alias("target")).distinct()
    found = placed.join(packages.withColumn("indexed", F.lit(True)), ["cache_key", "target"], "left")
    allowed = ~F.col("target").rlike(r"(^|/)internal(/|$)") | F.expr("startswith(file_path, regexp_replace(target, '(^|/)internal(/.*)?$', '$1'))")
    seen = found.groupBy("import_id").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"), F.bool_or(F.coalesce("indexed", F.lit(False))).alias("indexed"), F.bool_and(allowed).alias("allowed"))
    status = F.when(~F.col("specifier").rlike(r"^[A-Za-z0-9._~/-]+$"), "invalid_specifier").when((F.col("specifier") == "C") | F.col("n").isNull(), "external").when(F.col("n") > 1, "ambiguous").when(~F.col("allowed"), "inaccessible").when(F.col("indexed"), "resolved").otherwise("not_indexed")
    return imports.join(seen, "import_id", "left").select("import_id", status.alias("status"), F.when(status == "resolved", F.col("target")).alias("target"))


def rust_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Files of Rust ``crate::a::b::C`` paths: the longest prefix that is a module's file.

    imports: import_id, cache_key, file_path, specifier. Crate roots are directories of a lib.rs
    or main.rs above the importer, else the importer's top directory. Paths of other crates are
    external.
    """
    parts = F.split("specifier", "::")
    own = F.element_at(parts, 1).isin("crate", "self", "super")
    rs = files.where(F.col("rel_path").endswith(".rs")).select("cache_key", F.col("rel_path").alias("target")).distinct()
    roots = rs.where(F.col("target").rlike(r"(^|/)(lib|main)\.rs$")).select("cache_key", F.regexp_replace("target", r"/?[^/]*$", "").alias("directory"))
    owner = deepest_owner(imports.select("cache_key", F.col("file_path").alias("path")), roots).withColumnRenamed("path", "file_path")
    asked = imports.join(owner, ["cache_key", "file_path"], "left")
    tail = F.when(F.element_at(parts, 1) == "crate", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    base = F.coalesce("owner", F.regexp_extract("file_path", r"^([^/]*)/", 1))
    options = F.flatten(F.transform(F.sequence(F.size(tail), F.lit(1), F.lit(-1)), lambda n: F.array(F.concat(_joined(base, F.array_join(F.slice(tail, F.lit(1), n), "/")), F.lit(".rs")), F.concat(_joined(base, F.array_join(F.slice(tail, F.lit(1), n), "/")), F.lit("/mod.rs")))))
    probes = asked.where(F.size(tail) > 0).select("import_id", "cache_key", F.posexplode(options).alias("rank", "target")).join(rs, ["cache_key", "target"])
    found = probes.groupBy("import_id").agg(F.min_by("target", "rank").alias("target"))
    status = F.when(~own, "external").when(F.col("target").isNotNull(), "resolved").otherwise("not_indexed")
    return asked.join(found, "import_id", "left").select("import_id", status.alias("status"), "target")


def star_names(named: DataFrame, stars: DataFrame) -> DataFrame:
    """Names that star imports bring: cache_key, file_path, name and the file (target) they come from.

    named: cache_key, file_path, name of what files bind themselves, which goes before stars.
    stars: cache_key, file_path, target. Names that begin with _ aren't brought. Passes go on
    until none adds a name.
    """
    from strataloom.runtime import cut

    key = ["cache_key", "file_path", "name"]
    own = have = cut(named.select(*key).distinct())
    count = have.count()
    while True:
        brought = stars.join(have.withColumnRenamed("file_path", "target"), ["cache_key", "target"]).where(~F.col("name").startswith("_")).join(own, key, "left_anti").select(*key, "target")
        have = cut(have.unionByName(brought.select(*key)).distinct())
        now = have.count()
        if now == count:
            return brought
        count = now


def surface_fixpoint(rules: DataFrame, most_passes: int = 128) -> DataFrame:
    """Definitions that each exported name reaches through re-exports.

    rules: source, target (null for a definition of its own). Each pass reads the last one's
    result: targets known at a rule's target become known at its source. The set only grows; it
    stops when a pass adds nothing, else after ``most_passes``, when every source is ambiguous.
    Outcomes: resolved (one definition), ambiguous (several or no end) or cyclic (none).
    """
    from strataloom.runtime import cut

    links = rules.where("target IS NOT NULL").select("source", "target").distinct()
    known = cut(rules.where("target IS NULL").select("source", F.col("source").alias("definition")).distinct())
    count, settled = known.count(), False
    for _ in range(most_passes):
        more = links.join(known.withColumnRenamed("source", "target"), "target").select("source", "definition")
        known = cut(known.unionByName(more).distinct())
        now = known.count()
        if now == count:
            settled = True
            break
        count = now
    seen = known.groupBy("source").agg(F.count("*").alias("n"), F.min("definition").alias("definition"))
    status = F.when(F.lit(not settled) | (F.col("n") > 1), "ambiguous").when(F.col("n") == 1, "resolved").otherwise("cyclic")
    return rules.select("source").distinct().join(seen, "source", "left").select("source", status.alias("status"), F.when(status == "resolved", F.col("definition")).alias("definition"))


def reference_reasons(references: DataFrame) -> DataFrame:
    """Each reference with the first reason that keeps it unresolved, in order of precedence."""
    state = F.col("raw.binding_state")
    reason = (
        F.when(F.col("raw").isNull(), "observation_missing").when(state == "unsupported", "unsupported_reference").when(state == "shadowed", "binding_shadowed").when(state == "ambiguous", "ambiguous_binding")
        .when(F.col("import_unresolved_reason").isNotNull(), "import_unresolved").when(F.col("binding").isNull(), "binding_missing").when(F.col("source_id").isNull(), "ambiguous_source").when(F.col("target_id").isNull(), "target_not_indexed")
    )
    return references.select("ref_id", reason.alias("reason"))


def record_counts(references: DataFrame, file: str | None = None, status: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts of the records of ``file`` (before the status is asked for), and those of ``status``."""
    rows = references if file is None else references.where(F.col("raw.source_file") == file)
    counts = rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "resolved").alias("resolved"), F.count_if(F.col("status") == "unresolved").alias("unresolved"))
    return counts, rows if status is None else rows.where(F.col("status") == status)
