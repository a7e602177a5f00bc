"""From observations to the graph: imports to files, references to definitions, calls to callables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from strataloom.operators import resolve
from strataloom.runtime import cut

FILE_NODE = "::__file__#file"
CALLABLE = ("function", "method")
# How sure a way of resolving is, the surest first.
BASES = ("exact", "import-resolved", "declared")


def import_rows(seen: DataFrame) -> DataFrame:
    """Imports with an id of their own, the same for every delivery of a file."""
    rows = seen.where("what = 'import'").dropDuplicates(["cache_key", "file_path", "n"])
    meta = lambda key, kind: F.get_json_object("metadata", f"$.{key}").cast(kind)
    return rows.select(
        F.xxhash64("cache_key", "file_path", "n").alias("import_id"), "cache_key", "file_path", "language", "source_hash", F.col("name").alias("local_name"), "kind", "imported_name", "exported_name", "specifier", "type_only", "module_level", "line",
        "start", "end", "inner_start", "inner_end", F.coalesce(meta("level", "int"), F.lit(0)).alias("level"), F.coalesce(meta("form", "string"), F.lit("")).alias("form"), F.coalesce(meta("configuration", "string"), F.lit("unconditional")).alias("configuration"),
    )


def resolved_imports(seen: DataFrame, files: DataFrame, modules: DataFrame | None = None, configs: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """Every import with its status, target file, both file nodes and the reason where it has none.

    modules: cache_key, module, directory (Go, with replacements and workspace members as rows of
    their own); configs and packages as for :func:`script_targets`. Status is resolved or
    unresolved; reasons are external, not_indexed, ambiguous, inaccessible, invalid_specifier,
    unsupported_configuration and side_effect. The plans of the languages are put together at the end.
    """
    rows = cut(import_rows(seen))
    paths = files.select("cache_key", "rel_path").distinct()
    python = rows.where("language = 'python'")
    bare = F.regexp_replace(F.coalesce("specifier", F.lit("")), r"^\.+", "")
    asked = python.select("import_id", "cache_key", "file_path", "level", bare.alias("module"), F.when(F.col("kind") == "module", "").otherwise(F.coalesce("imported_name", F.lit(""))).alias("name"))
    parts = [resolve.python_imports(asked, paths)]
    script = rows.where("language IN ('javascript', 'typescript')").select("import_id", "cache_key", "file_path", "specifier", "type_only")
    parts.append(script_targets(script, paths, configs, packages))
    if modules is None:
        modules = paths.limit(0).select("cache_key", F.lit("").alias("module"), F.lit("").alias("directory"))
    go = resolve.go_imports(rows.where("language = 'go'").select("import_id", "cache_key", "file_path", "specifier"), paths, modules)
    # A package stands for its first file.
    first = paths.where("rel_path LIKE '%.go' AND rel_path NOT LIKE '%_test.go'").groupBy("cache_key", F.regexp_replace("rel_path", r"/?[^/]*$", "").alias("target")).agg(F.min("rel_path").alias("file"))
    placed = go.join(rows.select("import_id", "cache_key"), "import_id").join(first, ["cache_key", "target"], "left")
    parts.append(placed.select("import_id", "status", F.col("file").alias("target")))
    parts.append(rust_targets(rows.where("language = 'rust'"), paths))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    out = rows.join(found, "import_id", "left")
    done = (F.col("status") == "resolved") & F.col("target").isNotNull()
    node = lambda path: F.concat(path, F.lit(FILE_NODE))
    return out.select(
        *(c for c in rows.columns), F.when(done, "resolved").otherwise("unresolved").alias("status"), F.when(done, F.col("target")).alias("target_file"), F.when(~done, F.coalesce(F.when(F.col("status") != "resolved", F.col("status")), F.lit("not_indexed"))).alias("reason"),
        node(F.col("file_path")).alias("source_id"), F.when(done, node(F.col("target"))).alias("target_id"),
    )


def script_targets(imports: DataFrame, files: DataFrame, configs: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """Targets of JavaScript and TypeScript imports in the order: invalid, URL or builtin, relative,
    paths of the nearest config, its baseUrl, own package by # or by name, packages of the workspace.

    configs: cache_key, directory, base_url, paths (map of pattern to array of targets), unsupported
    (whether plugins or an unknown resolution keep every import of its scope unresolved);
    packages: cache_key, directory, name, exports, imports (JSON maps) and main. The nearest config
    and package are those of the deepest directory above the importer.
    """
    spec = F.col("specifier")
    kind = (
        F.when(spec.isNull() | (spec == "") | spec.rlike(r"[\s\\]"), "invalid").when(spec.rlike(r"^[a-z][a-z0-9+.-]+:"), "external").when(spec.rlike(r"^\.{1,2}(/|$)"), "relative").otherwise("bare")
    )
    rows = imports.withColumn("spec_kind", kind)
    relative = resolve.script_imports(rows.where("spec_kind = 'relative'").select("import_id", "cache_key", "file_path", "specifier"), files)
    parts = [relative, rows.where("spec_kind IN ('invalid', 'external')").select("import_id", F.when(F.col("spec_kind") == "invalid", "invalid_specifier").otherwise("external").alias("status"), F.lit(None).cast("string").alias("target"))]
    bare = rows.where("spec_kind = 'bare'")
    if configs is None and packages is None:
        parts.append(bare.select("import_id", F.when(spec.startswith("#"), "not_indexed").otherwise("external").alias("status"), F.lit(None).cast("string").alias("target")))
    else:
        parts.append(_mapped(bare, files, configs, packages))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _mapped(bare: DataFrame, files: DataFrame, configs: DataFrame | None, packages: DataFrame | None) -> DataFrame:
    """Imports by name: candidates of every stage with the stage's rank; the first that is a file is the target."""
    importers = bare.select("cache_key", F.col("file_path").alias("path")).distinct()
    candidates = None
    blocked = bare.select("import_id", F.lit(False).alias("blocked"))
    if configs is not None:
        owner = resolve.deepest_owner(importers, configs).select("cache_key", F.col("path").alias("file_path"), F.col("owner").alias("directory"))
        with_config = bare.join(owner, ["cache_key", "file_path"]).join(configs, ["cache_key", "directory"])
        blocked = with_config.select("import_id", F.coalesce("unsupported", F.lit(False)).alias("blocked"))
        base = _under(F.col("directory"), F.coalesce("base_url", F.lit(".")))
        head, tail = F.split_part("pattern", F.lit("*"), F.lit(1)), F.split_part("pattern", F.lit("*"), F.lit(2))
        fits = F.when(F.col("pattern").contains("*"), F.startswith("specifier", head) & F.endswith("specifier", tail) & (F.length("specifier") >= F.length(head) + F.length(tail))).otherwise(F.col("pattern") == F.col("specifier"))
        entries = with_config.select("*", F.posexplode_outer(F.map_entries("paths")).alias("at", "entry")).select("*", F.col("entry.key").alias("pattern"), F.col("entry.value").alias("targets")).where(fits)
        # The pattern with the longest beginning counts, of equal ones the first.
        longest = Window.partitionBy("import_id").orderBy(F.length(head).desc(), "at")
        chosen = entries.withColumn("k", F.row_number().over(longest)).where("k = 1")
        star = F.expr("substring(specifier, length(split_part(pattern, '*', 1)) + 1, length(specifier) - length(split_part(pattern, '*', 1)) - length(split_part(pattern, '*', 2)))")
        mapped = chosen.select("import_id", "cache_key", F.posexplode(F.transform("targets", lambda t: _under(base, F.replace(t, F.lit("*"), star)))).alias("k", "path")).select("import_id", "cache_key", F.col("k").alias("stage"), "path")
        based = with_config.where("base_url IS NOT NULL").select("import_id", "cache_key", F.lit(100).alias("stage"), _under(base, F.col("specifier")).alias("path"))
        candidates = mapped.unionByName(based)
    if packages is not None:
        owner = resolve.deepest_owner(importers, packages).select("cache_key", F.col("path").alias("file_path"), F.col("owner").alias("directory"))
        own = bare.join(owner, ["cache_key", "file_path"]).join(packages, ["cache_key", "directory"])
        hashed = own.where("specifier LIKE '#%'").select("import_id", "cache_key", F.lit(200).alias("stage"), _under(F.col("directory"), _package_target(F.col("imports"), F.col("specifier"))).alias("path"))
        parts = F.split("specifier", "/")
        name = F.when(F.col("specifier").startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.element_at(parts, 1))
        named = bare.withColumn("name", name).join(packages, ["cache_key", "name"])
        rest = F.expr("substring(specifier, length(name) + 1)")
        by_map = _package_target(F.col("exports"), F.concat(F.lit("."), rest))
        legacy = F.when(F.col("exports").isNull(), F.when(rest == "", F.coalesce("main", F.lit("./index.js"))).otherwise(F.concat(F.lit("."), rest)))
        space = named.select("import_id", "cache_key", F.lit(300).alias("stage"), _under(F.col("directory"), F.coalesce(by_map, legacy)).alias("path"))
        more = hashed.unionByName(space)
        candidates = more if candidates is None else candidates.unionByName(more)
    probes = candidates.where("path IS NOT NULL").select("import_id", "cache_key", "stage", F.posexplode(script_candidates(F.col("path"))).alias("k", "target"))
    known = files.select("cache_key", F.col("rel_path").alias("target")).distinct()
    found = probes.join(known, ["cache_key", "target"]).groupBy("import_id").agg(F.min_by("target", F.struct("stage", "k")).alias("target"))
    tried = candidates.select("import_id", F.lit(True).alias("tried")).distinct()
    out = bare.select("import_id", "specifier").join(found, "import_id", "left").join(tried, "import_id", "left").join(blocked.groupBy("import_id").agg(F.bool_or("blocked").alias("blocked")), "import_id", "left")
    status = F.when(F.coalesce("blocked", F.lit(False)), "unsupported_configuration").when(F.col("target").isNotNull(), "resolved").when(F.col("specifier").startswith("#"), "not_indexed").otherwise("external")
    return out.select("import_id", status.alias("status"), F.when(status == "resolved", F.col("target")).alias("target"))


@F.pandas_udf(T.StringType())
def _package_target(field, key):
    """What a package's map says of ``key``: the conditions import and require have to agree."""
    import json

    import pandas as pd

    from strataloom.sources.manifests import package_target

    def one(f: str | None, k: str | None) -> str | None:
        if f is None or k is None:
            return None
        try:
            table = json.loads(f)
        except ValueError:
            return None
        both = {package_target(table, k, {mode, "types", "node"}) for mode in ("import", "require")} - {None}
        return both.pop() if len(both) == 1 else None

    return pd.Series([one(f, k) for f, k in zip(field, key)], dtype="object")


def _under(base: Column, path: Column) -> Column:
    """``path`` below the directory ``base``, in canonical form; null if it leads out of the repository."""
    steps = F.filter(F.concat(F.split(base, "/"), F.split(path, "/")), lambda p: (p != ".") & (p != ""))
    walked = F.aggregate(steps, resolve.folder_start(), lambda a, p: F.when(a.isNull() | ((p == "..") & (F.size(a) == 0)), F.lit(None).cast("array<string>")).when(p == "..", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.array_append(a, p)))
    return F.when(base.isNull() | path.isNull(), F.lit(None)).otherwise(F.array_join(walked, "/"))


def script_candidates(path: Column) -> Column:
    """The files that a path may stand for, in order: as written, its sources, and the index of a directory."""
    ending = F.regexp_extract(path, r"(\.[cm]?[jt]sx?)$", 1)
    bare = F.regexp_replace(path, r"\.[cm]?[jt]sx?$", "")
    options = F.when(ending.isin(".ts", ".tsx", ".mts", ".cts"), F.array(path))
    for written, sources in resolve.SCRIPT_ENDINGS.items():
        if written:
            options = options.when(ending == written, F.array(*(F.concat(bare, F.lit(s)) for s in sources)))
    plain = [F.concat(path, F.lit(s)) for s in resolve.SCRIPT_ENDINGS[""]]
    return options.otherwise(F.array(*plain, *(F.concat(path, F.lit(f"/index{s}")) for s in resolve.SCRIPT_ENDINGS[""])))


def rust_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Files of Rust imports: of a ``mod x;`` its file, of a path the longest part that is a module.

    Paths begin at the crate's root (crate), at the importer's own module (self) or above it
    (super, any number of times); past the root they are invalid. Paths of other crates are external.
    """
    known = files.where("rel_path LIKE '%.rs'").select("cache_key", F.col("rel_path").alias("target")).distinct()
    roots = known.where(F.col("target").rlike(r"(^|/)(lib|main)\.rs$")).select("cache_key", F.regexp_replace("target", r"/?[^/]*$", "").alias("directory"))
    owner = resolve.deepest_owner(imports.select("cache_key", F.col("file_path").alias("path")), roots).select("cache_key", F.col("path").alias("file_path"), F.col("owner").alias("root"))
    asked = imports.join(owner, ["cache_key", "file_path"], "left").withColumn("root", F.coalesce("root", F.regexp_extract("file_path", r"^([^/]*)/", 1)))
    below = F.when(F.col("root") == "", F.col("file_path")).otherwise(F.expr("substring(file_path, length(root) + 2)"))
    # The module that a file is: its path without its ending; lib, main and mod stand for their directory.
    module = F.filter(F.split(F.regexp_replace(F.regexp_replace(below, r"\.rs$", ""), r"(^|/)(lib|main|mod)$", ""), "/"), lambda p: p != "")
    parts = F.split(F.coalesce("specifier", F.lit("")), "::")
    ups = F.size(F.filter(parts, lambda p: p == "super"))
    start = (
        F.when(F.col("form") == "module", module).when(F.col("form") == "inline_module", F.lit(None).cast("array<string>")).when(F.element_at(parts, 1) == "crate", F.array().cast("array<string>"))
        .when(F.element_at(parts, 1) == "self", module).when((F.element_at(parts, 1) == "super") & (ups <= F.size(module)), F.slice(module, F.lit(1), F.greatest(F.size(module) - ups, F.lit(0))))
    )
    rest = F.when(F.col("form") == "module", parts).otherwise(F.filter(parts, lambda p: ~p.isin("crate", "self", "super", "*")))
    route = F.concat(F.filter(F.split("root", "/"), lambda p: p != ""), start, rest)
    least = F.size(F.filter(F.split("root", "/"), lambda p: p != ""))
    at = lambda n: F.array_join(F.slice(route, F.lit(1), n), "/")
    options = F.flatten(F.transform(F.sequence(F.size(route), F.greatest(least + 1, F.lit(1)), F.lit(-1)), lambda n: F.array(F.concat(at(n), F.lit(".rs")), F.concat(at(n), F.lit("/mod.rs")))))
    probes = asked.where(start.isNotNull() & (F.size(route) > least)).select("import_id", "cache_key", F.posexplode(options).alias("rank", "target")).join(known, ["cache_key", "target"])
    found = probes.groupBy("import_id").agg(F.min_by("target", "rank").alias("target"))
    invalid = (F.element_at(parts, 1) == "super") & (ups > F.size(module))
    own = F.element_at(parts, 1).isin("crate", "self", "super") | (F.col("form") == "module")
    out = asked.join(found, "import_id", "left")
    status = F.when(F.col("form") == "inline_module", "resolved").when(invalid, "invalid_specifier").when(~own, "external").when(F.col("target").isNotNull(), "resolved").otherwise("not_indexed")
    return out.select("import_id", status.alias("status"), F.when(F.col("form") == "inline_module", F.col("file_path")).otherwise(F.col("target")).alias("target"))


def import_edges(imports: DataFrame) -> DataFrame:
    """An edge from each importing file to the file it imports, once; type-only imports are a type of their own.

    A file doesn't import itself. Of several imports of one pair the first line is the evidence.
    """
    kind = F.when(F.col("type_only"), "imports_type").otherwise("imports")
    rows = imports.where("status = 'resolved' AND source_id <> target_id").withColumn("edge_type", kind)
    first = F.min(F.struct("line", "source_hash"))
    seen = rows.groupBy("cache_key", "source_id", "target_id", "edge_type", "file_path").agg(first.alias("first"))
    return _edges(seen, F.lit("import-resolved"))


def _edges(rows: DataFrame, resolution: Column) -> DataFrame:
    return rows.select(
        "cache_key", F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"), "edge_type", F.lit(True).alias("directed"), F.lit("core").alias("namespace"), resolution.alias("resolution"),
        F.struct(F.col("file_path").alias("file"), F.col("first.line").cast("int").alias("line"), F.col("first.source_hash").alias("content_hash")).alias("evidence"),
    )


def export_rules(seen: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each file offers by name, and from which files it passes everything on.

    rules: cache_key, file_path, name, target_file and target_name of a re-export (both null for a
    definition, which has start and end). stars: cache_key, file_path, target_file. A name that a
    file exports and also imports is a re-export of what it imported.
    """
    exports = seen.where("what = 'export' AND name IS NOT NULL").dropDuplicates(["cache_key", "file_path", "n"])
    done = imports.where("status = 'resolved'")
    own = exports.where(r"kind NOT IN ('reexport', 'local', 'expression', 'package') AND (language <> 'go' OR name RLIKE '^\\p{Lu}')").select("cache_key", "file_path", "name", F.lit(None).cast("string").alias("target_file"), F.lit(None).cast("string").alias("target_name"), "start", "end")
    through = done.where("exported_name IS NOT NULL").select("cache_key", "file_path", F.col("exported_name").alias("name"), "target_file", F.col("imported_name").alias("target_name"))
    held = done.where("local_name IS NOT NULL AND language = 'python' AND module_level AND kind = 'symbol'").select("cache_key", "file_path", F.col("local_name").alias("name"), "target_file", F.col("imported_name").alias("target_name"))
    named = exports.where("kind IN ('local', 'expression') AND imported_name IS NOT NULL").select("cache_key", "file_path", "name", "imported_name")
    definitions = seen.where("what = 'symbol' AND qualified_name = name").groupBy("cache_key", "file_path", F.col("name").alias("imported_name")).agg(F.count("*").alias("n"), F.min("start").alias("start"), F.min("end").alias("end")).where("n = 1")
    listed = named.join(definitions, ["cache_key", "file_path", "imported_name"]).select("cache_key", "file_path", "name", F.lit(None).cast("string").alias("target_file"), F.lit(None).cast("string").alias("target_name"), "start", "end")
    local = done.select("cache_key", "file_path", F.col("local_name").alias("imported_name"), "target_file", F.coalesce("imported_name", F.lit("*")).alias("target_name"))
    passed = named.join(local, ["cache_key", "file_path", "imported_name"]).select("cache_key", "file_path", "name", "target_file", "target_name")
    # A Go package is known by its first file, which offers what its other files define.
    folder = F.regexp_replace("file_path", r"/?[^/]*$", "")
    go = exports.where("language = 'go' AND file_path NOT LIKE '%_test.go'").withColumn("folder", folder)
    first = go.groupBy("cache_key", "folder").agg(F.min("file_path").alias("first"))
    offered = own.withColumn("folder", folder).join(go.select("cache_key", "file_path").distinct(), ["cache_key", "file_path"], "left_semi").join(first, ["cache_key", "folder"])
    through = through.unionByName(offered.where("first <> file_path").select("cache_key", F.col("first").alias("file_path"), "name", F.col("file_path").alias("target_file"), F.col("name").alias("target_name")))
    rules = own.unionByName(listed).unionByName(through.unionByName(held).unionByName(passed), allowMissingColumns=True).distinct()
    stars = done.where("kind = 'glob' AND (language <> 'go')").select("cache_key", "file_path", "target_file").distinct()
    return rules, stars


def export_surface(rules: DataFrame, stars: DataFrame, most_passes: int = 128) -> DataFrame:
    """The definition that each name a file offers leads to: cache_key, file_path, name, status,
    def_file, def_start and def_end.

    Names travel over re-exports and stars, a pass at a time, until none is new; explicit names go
    before those of stars, and ``default`` never comes over a star. Status is resolved, ambiguous
    (several definitions, or no end within ``most_passes``) or cyclic (no definition is reached).
    """
    key = ["cache_key", "file_path", "name"]
    explicit = cut(rules.select(*key).distinct())
    known = cut(rules.where("target_file IS NULL").select(*key, F.col("file_path").alias("def_file"), F.col("start").alias("def_start"), F.col("end").alias("def_end")).distinct())
    links = cut(rules.where("target_file IS NOT NULL").select(*key, "target_file", "target_name").distinct())
    there = lambda df: df.select("cache_key", F.col("file_path").alias("target_file"), F.col("name").alias("target_name"), "def_file", "def_start", "def_end")
    count, settled = known.count(), False
    for _ in range(most_passes):
        over = links.join(there(known), ["cache_key", "target_file", "target_name"]).select(known.columns)
        starred = stars.join(there(known), ["cache_key", "target_file"]).where("target_name <> 'default'").withColumnRenamed("target_name", "name").join(explicit, key, "left_anti").select(known.columns)
        known = cut(known.unionByName(over).unionByName(starred).distinct())
        now = known.count()
        if now == count:
            settled = True
            break
        count = now
    reached = known.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("def_file", "def_start", "def_end")).alias("d"))
    every = explicit.unionByName(known.select(*key)).distinct()
    status = F.when(F.lit(not settled) | (F.col("n") > 1), "ambiguous").when(F.col("n") == 1, "resolved").otherwise("cyclic")
    one = status == "resolved"
    return every.join(reached, key, "left").select(*key, status.alias("status"), *(F.when(one, F.col(f"d.{c}")).alias(c) for c in ("def_file", "def_start", "def_end")))


def resolved_references(seen: DataFrame, imports: DataFrame, surface: DataFrame, symbols: DataFrame) -> DataFrame:
    """References that begin with an import, with the definition they lead to or the first reason why none.

    Reasons in order: unsupported_reference (import under a condition), binding_shadowed,
    ambiguous_binding (several imports of the name hold), import_unresolved, ambiguous_target,
    target_not_indexed. A name of a namespace or module is looked up in the file it stands for; a
    path of Rust by its last name.
    """
    rows = seen.where("what = 'reference'").dropDuplicates(["cache_key", "file_path", "n"]).select(F.xxhash64("cache_key", "file_path", F.lit("reference"), "n").alias("ref_id"), "cache_key", "file_path", "language", "source_hash", "start", "end", "line", "text", "path", F.col("name").alias("local_name"), F.col("kind").alias("state"))
    held = imports.where("local_name IS NOT NULL").select("cache_key", "file_path", "local_name", "import_id", F.col("kind").alias("import_kind"), "imported_name", "target_file", F.col("status").alias("import_status"), F.col("reason").alias("import_reason"), "type_only", "inner_start", "inner_end")
    near = rows.join(held, ["cache_key", "file_path", "local_name"], "left").where(F.col("import_id").isNull() | ((F.col("inner_start") <= F.col("start")) & (F.col("start") < F.col("inner_end"))))
    width = (F.col("inner_end") - F.col("inner_start")).alias("width")
    first = near.groupBy("ref_id").agg(F.min(F.struct(width, "import_id")).alias("best"), F.count_distinct("target_file", "imported_name").alias("bindings"))
    chosen = near.join(first, "ref_id").where(F.col("import_id").eqNullSafe(F.col("best.import_id")))
    # A namespace or module is one step; what it holds is named by the next.
    holder = F.col("import_kind").isin("namespace", "module")
    wanted = F.when(holder, F.get("path", F.lit(1))).when(F.col("language") == "rust", F.element_at("path", -1)).otherwise(F.col("imported_name"))
    asked = chosen.withColumn("wanted", wanted)
    looked = surface.select("cache_key", F.col("file_path").alias("target_file"), F.col("name").alias("wanted"), F.col("status").alias("surface_status"), "def_file", "def_start", "def_end")
    found = asked.join(looked, ["cache_key", "target_file", "wanted"], "left")
    target = symbols.select("cache_key", F.col("file_path").alias("def_file"), F.col("byte_offset").alias("def_start"), (F.col("byte_offset") + F.col("byte_length")).alias("def_end"), F.col("id").alias("symbol_id"), F.col("kind").alias("symbol_kind"))
    joined = found.join(target, ["cache_key", "def_file", "def_start", "def_end"], "left").dropDuplicates(["ref_id"])
    whole_file = holder & (F.size("path") == 1)
    reason = (
        F.when(F.col("state") == "unsupported", "unsupported_reference").when(F.col("state") == "shadowed", "binding_shadowed").when(F.col("bindings") > 1, "ambiguous_binding").when(F.col("import_status") != "resolved", "import_unresolved")
        .when(whole_file, F.lit(None)).when(F.col("surface_status").isin("ambiguous", "cyclic"), "ambiguous_target").when(F.col("symbol_id").isNull(), "target_not_indexed")
    )
    ok = reason.isNull()
    return joined.select(
        "ref_id", "cache_key", "file_path", "language", "source_hash", "start", "end", "line", "text", "path", "import_id", "type_only", F.when(ok, "resolved").otherwise("unresolved").alias("status"), reason.alias("reason"),
        F.when(ok, F.when(whole_file, F.concat("target_file", F.lit(FILE_NODE))).otherwise(F.col("symbol_id"))).alias("target_id"), F.when(ok, F.when(whole_file, F.lit("file")).otherwise(F.col("symbol_kind"))).alias("target_kind"),
    )


def owners(seen: DataFrame, rows: DataFrame, key: str, symbols: DataFrame) -> DataFrame:
    """``rows`` with source_id: the callable around each, or its file where none is around it.

    owner_state is module, definite, ambiguous or missing (a callable that has no symbol).
    """
    spans = seen.where("what = 'owner'").select("cache_key", "file_path", F.concat_ws(":", "start", "end", "kind").alias("span_id"), F.col("inner_start").alias("s_start"), F.col("inner_end").alias("s_end")).distinct()
    found = resolve.nearest_owner(rows.select(F.col(key).alias("obs_id"), "cache_key", "file_path", "start", "end"), spans).withColumnRenamed("obs_id", key)
    callables = symbols.where(F.col("kind").isin(*CALLABLE)).groupBy("cache_key", "file_path", F.concat_ws(":", "byte_offset", F.col("byte_offset") + F.col("byte_length"), "kind").alias("span_id")).agg(F.count("*").alias("n"), F.min("id").alias("owner_id"))
    joined = rows.join(found, key, "left").join(callables, ["cache_key", "file_path", "span_id"], "left")
    state = F.when(F.col("span_id").isNull(), "module").when(F.col("n") == 1, "definite").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return joined.withColumn("owner_state", state).withColumn("source_id", F.when(state == "module", F.concat("file_path", F.lit(FILE_NODE))).when(state == "definite", F.col("owner_id"))).drop("span_id", "n", "owner_id")


def resolved_calls(seen: DataFrame, references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call sites with their caller and the callable they lead to, or the first reason why none.

    In order: unsupported_callee; caller_missing, ambiguous_caller; local_binding_shadowed,
    local_binding_ambiguous; conflicting_resolution (bound here and imported); the local callable
    (exact); the imported one (import-resolved); reference_unresolved; target_not_callable;
    local_target_missing; callee_not_proven. The callee meets a reference of the same extent.
    """
    rows = seen.where("what = 'call'").dropDuplicates(["cache_key", "file_path", "n"]).withColumn("call_id", F.xxhash64("cache_key", "file_path", F.lit("call"), "n"))
    owned = owners(seen, rows.select("call_id", "cache_key", "file_path", "language", "source_hash", "start", "end", "line", "inner_start", "inner_end", "text", "path", "form", "local_state", "local_start", "local_end", "local_kind"), "call_id", symbols)
    same = references.select("cache_key", "file_path", F.col("start").alias("inner_start"), F.col("end").alias("inner_end"), F.col("status").alias("ref_status"), F.col("reason").alias("ref_reason"), F.col("target_id").alias("ref_target"), F.col("target_kind").alias("ref_kind"), F.coalesce("type_only", F.lit(False)).alias("ref_type_only"))
    one = same.withColumn("n", F.count("*").over(Window.partitionBy("cache_key", "file_path", "inner_start", "inner_end"))).where("n = 1").drop("n")
    local = symbols.where(F.col("kind").isin(*CALLABLE)).groupBy("cache_key", "file_path", F.col("byte_offset").alias("local_start"), (F.col("byte_offset") + F.col("byte_length")).alias("local_end"), F.col("kind").alias("local_kind")).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n").withColumnRenamed("id", "local_id")
    joined = owned.join(one, ["cache_key", "file_path", "inner_start", "inner_end"], "left").join(local, ["cache_key", "file_path", "local_start", "local_end", "local_kind"], "left")
    here = (F.col("local_state") == "definite") & F.col("local_id").isNotNull()
    there = F.coalesce((F.col("ref_status") == "resolved") & ~F.col("ref_type_only") & F.col("ref_kind").isin(*CALLABLE), F.lit(False))
    reason = (
        F.when((F.col("form") == "dynamic") | (F.col("local_state") == "unsupported"), "unsupported_callee").when(F.col("owner_state") == "missing", "caller_missing").when(F.col("owner_state") == "ambiguous", "ambiguous_caller")
        .when(F.col("local_state") == "shadowed", "local_binding_shadowed").when(F.col("local_state") == "ambiguous", "local_binding_ambiguous").when(here & there, "conflicting_resolution").when(here | there, F.lit(None))
        .when(F.col("ref_status") == "unresolved", "reference_unresolved").when(F.col("ref_status") == "resolved", "target_not_callable").when(F.col("local_state") == "definite", "local_target_missing").otherwise("callee_not_proven")
    )
    ok = reason.isNull()
    return joined.select(
        "call_id", "cache_key", "file_path", "language", "source_hash", "start", "end", "line", "text", "form", "source_id", F.when(ok, "resolved").otherwise("unresolved").alias("status"), reason.alias("reason"), F.when(reason == "reference_unresolved", F.col("ref_reason")).alias("reference_reason"),
        F.when(ok, F.coalesce(F.when(here, F.col("local_id")), F.col("ref_target"))).alias("target_id"), F.when(ok, F.when(here, "exact").otherwise("import-resolved")).alias("resolution"),
    )


def record_edges(rows: DataFrame, edge_type: str, resolution: Column, loops: bool) -> DataFrame:
    """One edge for each pair that resolved records lead from and to, the first line its evidence.

    Only calls may lead from a node to itself (``loops``).
    """
    done = rows.where("status = 'resolved' AND source_id IS NOT NULL AND target_id IS NOT NULL")
    done = done if loops else done.where("source_id <> target_id")
    best = F.min(F.struct(F.array_position(F.array(*(F.lit(b) for b in BASES)), resolution).alias("rank"), "line", "source_hash", "file_path", resolution.alias("resolution")))
    seen = done.groupBy("cache_key", "source_id", "target_id").agg(best.alias("first")).withColumn("edge_type", F.lit(edge_type)).withColumn("file_path", F.col("first.file_path"))
    return _edges(seen, F.col("first.resolution"))


def reference_edges(references: DataFrame, seen: DataFrame, symbols: DataFrame) -> DataFrame:
    return record_edges(owners(seen, references, "ref_id", symbols), "references", F.lit("import-resolved"), False)


def call_edges(calls: DataFrame) -> DataFrame:
    return record_edges(calls, "calls", F.col("resolution"), True)


def merged_contexts(outcomes: DataFrame) -> DataFrame:
    """One outcome of an import that several contexts (crates of one file) resolve: import_id,
    endpoint, reason, basis (its rank) and configuration.

    All contexts unresolved with one reason give it; one endpoint everywhere gives that, with the
    least sure basis and the widest configuration; any mixture is ambiguous.
    """
    seen = outcomes.groupBy("import_id").agg(
        F.count_distinct("endpoint").alias("ends"), F.min("endpoint").alias("endpoint"), F.count_if(F.col("endpoint").isNull()).alias("open"), F.count("*").alias("contexts"), F.count_distinct("reason").alias("reasons"), F.min("reason").alias("reason"),
        F.max("basis").alias("basis"), F.min("configuration").alias("configuration"),
    )
    one = (F.col("open") == 0) & (F.col("ends") == 1)
    none = (F.col("open") == F.col("contexts")) & (F.col("reasons") == 1)
    return seen.select("import_id", F.when(one, F.col("endpoint")).alias("endpoint"), F.when(one, F.lit(None)).when(none, F.col("reason")).otherwise("ambiguous").alias("reason"), F.when(one, F.col("basis")).alias("basis"), F.when(one, F.col("configuration")).alias("configuration"))


def visible_to(visibility: Column, defined_in: Column, importer: Column) -> Column:
    """Whether an item of Rust may be used in a module: both modules as arrays of names.

    pub and pub(crate) always; private and pub(self) below the defining module; pub(super) below its
    parent; pub(in a::b) below that path.
    """
    below = lambda scope: F.slice(importer, F.lit(1), F.size(scope)) == scope
    parent = F.slice(defined_in, F.lit(1), F.greatest(F.size(defined_in) - 1, F.lit(0)))
    named = F.filter(F.split(F.regexp_extract(visibility, r"^pub\(in (?:crate(?:::|(?=\)))|::)?(.*)\)$", 1), "::"), lambda p: p != "")
    return (
        F.when(visibility.isin("pub", "pub(crate)"), True).when(visibility.isin("private", "pub(self)"), below(defined_in)).when(visibility == "pub(super)", below(parent)).when(visibility.startswith("pub(in"), below(named)).otherwise(False)
    )


def go_modules(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """cache_key, module and directory of the Go modules of repositories.

    manifests: cache_key, directory, module, replaces (map of module to a relative path), uses (of a
    go.work, relative directories). A replaced module is bound to the directory it is replaced
    by; with a go.work only the modules that it uses and the replaced ones are bound.
    """
    mods = manifests.where("module IS NOT NULL").select("cache_key", "directory", "module")
    work = manifests.where("uses IS NOT NULL").select("cache_key", F.col("directory").alias("at"), F.explode("uses").alias("use")).select("cache_key", _under(F.col("at"), F.col("use")).alias("directory")).distinct()
    spaces = manifests.where("uses IS NOT NULL").select("cache_key").distinct()
    kept = mods.join(spaces, "cache_key", "left_anti").unionByName(mods.join(work, ["cache_key", "directory"], "left_semi"))
    replaced = manifests.where("replaces IS NOT NULL").select("cache_key", "directory", F.explode("replaces").alias("module", "to")).select("cache_key", "module", _under(F.col("directory"), F.col("to")).alias("directory"))
    return kept.join(replaced.select("cache_key", "module"), ["cache_key", "module"], "left_anti").unionByName(replaced).where("directory IS NOT NULL").distinct()
