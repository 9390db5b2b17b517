"""Names, layers, templates and idempotent text edits, over tables of names and of files' lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as X

LAYERS = ("nav", "presentation", "domain", "data")
#: The folders whose files aren't checked, unless others are given.
EXCLUDED = ("**/build/**", "**/.gradle/**", "**/iosX64Main/**", "**/showcaseApp/**", "gradle/build-logic")
#: The hints for lines that must be added by hand, by part ({0}: feature, {1}: class), and the symbol each is about.
HINTS = {
    "has_data": ("::{1}RepositoryImpl", "// в {0}Module.kt добавь: factoryOf(::{1}RepositoryImpl) bind {1}Repository::class"),
    "has_domain": ("::{1}UseCase", "// в {0}Module.kt добавь: factoryOf(::{1}UseCase)"),
    "has_presentation": ("::{1}ViewModel", "// в {0}Module.kt добавь: viewModelOf(::{1}ViewModel)"),
}
#: A module's imports in order ({0}: package, {1}: class), each with the parts that need it (none: always).
IMPORTS = (
    ("{0}.data.repository.{1}RepositoryImpl", ("has_data",)),
    ("{0}.domain.repository.{1}Repository", ("has_data",)),
    ("{0}.domain.usecase.{1}UseCase", ("has_domain",)),
    ("{0}.presentation.{1}ViewModel", ("has_presentation",)),
    ("org.koin.core.annotation.KoinExperimentalAPI", ("has_presentation",)),
    ("org.koin.core.module.Module", ()),
    ("org.koin.core.module.dsl.factoryOf", ("has_data", "has_domain")),
    ("org.koin.core.module.dsl.viewModelOf", ("has_presentation",)),
    ("org.koin.dsl.bind", ("has_data",)),
    ("org.koin.dsl.module", ()),
)


def derive_names(modules: DataFrame, root: str = "org.example") -> DataFrame:
    """Package and class names of modules (area, name: snake case); valid tells whether the name may be used."""
    name = F.col("name")
    return modules.select("area", "name", X.is_snake(name).alias("valid"), F.concat_ws(".", F.lit(root), "area", "name").alias("package"), X.snake_to_pascal(name).alias("pascal"), X.snake_to_camel(name).alias("camel"))


def resolve_layers(flags: DataFrame) -> DataFrame:
    """Layers of flags (id, layers: CSV, all_layers, with_view_model, without: array): an explicit list, then
    with_view_model, then all but `without`, then nav alone. error names a conflict or an unknown layer."""
    asked = F.filter(F.transform(F.split(F.coalesce("layers", F.lit("")), ","), X.trim), lambda x: x != "")
    listed, minus, valid = ~X.is_blank(F.col("layers")), F.size("without") > 0, F.array(*map(F.lit, LAYERS))
    error = (
        F.when(F.size(F.array_except("without", valid)) > 0, "unknown layer")
        .when(listed & (F.col("all_layers") | minus), "list with all or without")
        .when(listed & F.col("with_view_model"), "list with view model")
        .when(F.col("all_layers") & F.col("with_view_model"), "all with view model")
        .when(listed & (F.size(F.array_except(asked, valid)) > 0), "unknown layer")
    )
    chosen = (
        F.when(listed, asked)
        .when(F.col("with_view_model"), F.array(F.lit("nav"), F.lit("presentation")))
        .when(F.col("all_layers") | minus, F.array_except(valid, F.col("without")))
        .otherwise(F.array(F.lit("nav")))
    )
    return flags.select("id", error.alias("error"), *(F.when(error.isNull(), F.array_contains(chosen, layer)).alias(layer) for layer in LAYERS))


def render(templates: DataFrame) -> DataFrame:
    """Templates (id, content, package, area, feature, pascal, camel) with their placeholders filled in."""
    values = {"{{PACKAGE}}": "package", "{{AREA}}": "area", "{{FEATURE}}": "feature", "{{NAME}}": "pascal", "{{name}}": "camel"}
    return templates.select("id", X.replace_all(F.col("content"), {k: F.col(v) for k, v in values.items()}).alias("content"))


def write_plan(targets: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """CREATE or SKIP for each target path: existing files are left unless forced. By itself it is the dry run; see write()."""
    there = existing.select("path").distinct().withColumn("_there", F.lit(True))
    skip = F.coalesce("_there", F.lit(False)) & F.lit(not force)
    return targets.join(there, "path", "left").select("path", F.when(skip, "SKIP").otherwise("CREATE").alias("action"))


def write(targets: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """The tree of files (path, content) after targets (path, content; null: an empty placeholder) are written into existing ones."""
    new = targets.join(write_plan(targets, existing, force).where("action = 'CREATE'").select("path"), "path", "left_semi")
    kept = existing.select("path", "content").join(new.select("path"), "path", "left_anti")
    return kept.unionByName(new.select("path", F.coalesce("content", F.lit("")).alias("content")))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Each text file at path (a file, folder or glob), whole: path and content. A path that isn't there is an error."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def lines_of(files: DataFrame) -> DataFrame:
    """Files (path, content) as lines: file, pos from 0, line."""
    return files.select(F.col("path").alias("file"), F.posexplode(X.lines(F.col("content"))).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


def report(plan: DataFrame) -> DataFrame:
    """One text of a plan (path, action): a line for each file, in order of path."""
    verb = F.when(F.col("action") == "SKIP", "skip   ").otherwise("create ")
    said = plan.groupBy().agg(F.array_sort(F.collect_list(F.struct("path", F.concat(verb, F.col("path")).alias("line")))).alias("rows"))
    return said.select(F.array_join("rows.line", "\n").alias("report"))


def missing_bindings(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, symbol) of wanted symbols (file, symbol) that a file's content does not contain."""
    return symbols.join(files, "file").where(~F.col("content").contains(F.col("symbol"))).select("file", "symbol")


def changed_files(lists: DataFrame, existing: DataFrame | None = None, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Kotlin files of comma-separated lists (id, csv), excluded folders left out; with existing, those there."""
    each = lists.select("id", F.explode(F.split("csv", ",")).alias("path")).withColumn("path", X.trim(F.col("path")))
    kept = each.where(F.col("path").endswith(".kt"))
    for glob in excluded:
        kept = kept.where(~F.col("path").rlike(X.glob_pattern(glob)))
    return kept if existing is None else kept.join(existing.select("path").distinct(), "path", "left_semi").select("id", "path")


def _body() -> Column:
    line = lambda flag, *parts: F.when(F.col(flag), F.concat(*parts))
    p = F.col("pascal")
    made = F.array_compact(
        F.array(
            line("has_data", F.lit("    factoryOf(::"), p, F.lit("RepositoryImpl) bind "), p, F.lit("Repository::class")),
            line("has_domain", F.lit("    factoryOf(::"), p, F.lit("UseCase)")),
            line("has_presentation", F.lit("    viewModelOf(::"), p, F.lit("ViewModel)")),
        )
    )
    return F.when(F.size(made) > 0, F.array_join(made, "\n"))


def module_lines(modules: DataFrame) -> DataFrame:
    """The body of a module (pascal, has_data, has_domain, has_presentation): a line for each part, null without any."""
    return modules.select("pascal", _body().alias("body"))


def modules(wanted: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """The module file of each wanted feature (package, feature and pascal, camel: its names in use, has_data, has_domain,
    has_presentation): target, action, content, pending and created_now.

    Without a part there is no file: all null. A file that is there (existing: path, content) is left unless forced: SKIP, and
    pending are hints for the bindings that it lacks."""
    has = lambda names: F.lit(True) if not names else F.array_contains(F.array(*(F.col(n) for n in names)), True)
    fill = lambda text, zero, one: F.replace(F.replace(F.lit(text), F.lit("{0}"), F.col(zero)), F.lit("{1}"), F.col(one))
    each = wanted.withColumn("body", _body())
    imports = F.array_compact(F.array(*(F.when(has(needs), fill(f"import {name}", "package", "pascal")) for name, needs in IMPORTS)))
    title = X.snake_to_pascal(F.col("feature"))
    opt_in = F.when(F.col("has_presentation"), "@OptIn(KoinExperimentalAPI::class)\n").otherwise("")
    content = F.concat(F.lit("package "), "package", F.lit(".di\n\n"), F.array_join(imports, "\n"), F.lit("\n\n"), opt_in, F.lit("val "), X.lower_first(title), F.lit("Module: Module = module {\n"), "body", F.lit("\n}\n"))
    path = F.concat(F.lit("di/"), title, F.lit("Module.kt"))
    made = each.withColumns({"title": title, "made": content, "target": F.when(F.col("body").isNotNull(), path)})
    there = existing.select(F.col("path").alias("target"), F.col("content").alias("old"))
    both = made.join(there, "target", "left")
    skip = F.col("old").isNotNull() & F.lit(not force)
    lacking = (F.when(F.col(part) & ~F.col("old").contains(fill(symbol, "title", "pascal")), fill(hint, "title", "pascal")) for part, (symbol, hint) in HINTS.items())
    action = F.when(F.col("target").isNotNull(), F.when(skip, "SKIP").otherwise("CREATE"))
    return both.select(
        "feature",
        "pascal",
        "target",
        action.alias("action"),
        F.when(action == "CREATE", F.col("made")).alias("content"),
        F.when(action == "SKIP", F.array_compact(F.array(*lacking))).otherwise(F.array().cast("array<string>")).alias("pending"),
        F.coalesce(action == "CREATE", F.lit(False)).alias("created_now"),
    )


def _edited(lines: DataFrame, plans: DataFrame, step: Callable[[Column, Column], Column]) -> DataFrame:
    """Lines (file, pos, line) after step(lines so far, plan) of each of the file's plans, in order of new; equal plans count
    once. A file's lines are one array: as many as a source file has."""
    files = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows")).select("file", F.col("rows.line").alias("rows"))
    fields = F.struct("new", *(c for c in plans.columns if c not in ("file", "new")))
    wanted = plans.groupBy("file").agg(F.array_sort(F.collect_set(fields)).alias("plans"))
    both = files.join(wanted, "file", "left")
    edited = F.when(F.col("plans").isNull(), F.col("rows")).otherwise(F.aggregate("plans", F.col("rows"), step))
    return both.select("file", F.posexplode(edited).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


def _places(rows: Column, wanted: Callable[[Column, Column], Column]) -> Column:
    """Of each line its place, or null where wanted(line, place) isn't true."""
    return F.transform(rows, lambda x, i: F.when(wanted(x, i), i))


def _put(rows: Column, at: Column, line: Column) -> Column:
    return F.concat(F.slice(rows, F.lit(1), at), F.array(line), F.slice(rows, at + 1, F.size(rows)))


def wire_include(lines: DataFrame, includes: DataFrame) -> DataFrame:
    """Adds include lines (includes: file, section, new), each after the last include of its section, which ends at the next
    comment after an include; without the section, after the file's last include; else at the end. A line that is there is left as it is."""

    def step(rows: Column, plan: Column) -> Column:
        start = F.array_min(_places(rows, lambda x, i: X.trim(x) == plan["section"]))
        places = _places(rows, lambda x, i: X.trim(x).startswith("include(") & (i > F.coalesce(start, F.lit(-1))))
        stop = F.array_min(_places(rows, lambda x, i: X.trim(x).startswith("//") & start.isNotNull() & (i > F.array_min(places))))
        last = F.array_max(F.filter(places, lambda i: stop.isNull() | (i < stop)))
        return F.when(F.exists(rows, lambda x: X.trim(x) == plan["new"]), rows).otherwise(_put(rows, F.coalesce(last + 1, F.size(rows)), plan["new"]))

    return _edited(lines, includes, step)


def wire_import(lines: DataFrame, imports: DataFrame) -> DataFrame:
    """Adds import lines (imports: file, new), each before the first greater import, else after the last one, else after
    the package line, else first. A line that is there is left as it is."""

    def step(rows: Column, plan: Column) -> Column:
        new = plan["new"]
        greater = F.array_min(_places(rows, lambda x, i: X.trim(x).startswith("import ") & (X.trim(x) > new)))
        last = F.array_max(_places(rows, lambda x, i: X.trim(x).startswith("import ")))
        package = F.array_min(_places(rows, lambda x, i: X.trim(x).startswith("package ")))
        at = F.coalesce(greater, last + 1, package + 1, F.lit(0))
        return F.when(F.exists(rows, lambda x: X.trim(x) == new), rows).otherwise(_put(rows, at, new))

    return _edited(lines, imports, step)


def wire_entry(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds entries (entries: file, new), each as the last one of the file's includes(...) list: a comma after the one
    before it, its indent taken over. An entry that is there is left; a file without the list is an error."""

    def step(rows: Column, plan: Column) -> Column:
        new = plan["new"]
        start = F.array_min(_places(rows, lambda x, i: x.contains("includes(")))
        close = F.array_min(_places(rows, lambda x, i: X.trim(x).startswith(")") & (i >= start)))
        last = F.array_max(_places(rows, lambda x, i: (i > start) & (i < close) & (X.trim(x) != "") & ~X.trim(x).startswith("//")))
        indent = F.coalesce(X.leading_spaces(F.get(rows, last)), X.leading_spaces(F.get(rows, start)) + 4)
        comma = lambda x: F.when(X.trim_end(x).endswith(","), x).otherwise(F.concat(X.trim_end(x), F.lit(",")))
        with_comma = F.transform(rows, lambda x, i: F.when(F.coalesce(i == last, F.lit(False)), comma(x)).otherwise(x))
        added = _put(with_comma, close, F.concat(F.repeat(F.lit(" "), indent), new))
        missing = F.raise_error("no includes(...) list").cast("array<string>")
        there = F.exists(rows, lambda x: F.regexp_replace(X.trim(x), ",$", "") == new)
        return F.when(there, rows).when(close.isNull(), missing).otherwise(added)

    return _edited(lines, entries, step)


def wire_module(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Both edits of an aggregate module: wanted has file, import_line and entry."""
    imported = wire_import(lines, wanted.select("file", F.col("import_line").alias("new")))
    return wire_entry(imported, wanted.select("file", F.col("entry").alias("new")))


def wire_changes(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """What wire_module() adds to each file: file, added (lines, in order) and already_present (nothing is added: then
    added has the lines that were wanted)."""
    has = lines.groupBy("file").agg(F.collect_set(X.trim(F.col("line"))).alias("has"))
    both = wanted.join(has, "file", "left").withColumn("has", F.coalesce("has", F.array().cast("array<string>")))
    imported = F.array_contains("has", F.col("import_line"))
    entered = F.arrays_overlap(F.array("entry", F.concat("entry", F.lit(","))), F.col("has"))
    all_lines = F.array("import_line", F.concat("entry", F.lit(",")))
    added = F.array_compact(F.array(F.when(~imported, F.col("import_line")), F.when(~entered, F.concat("entry", F.lit(",")))))
    each = both.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("entry", added.alias("added"), all_lines.alias("wanted")))).alias("rows"))
    nothing = F.size(F.flatten("rows.added")) == 0
    return each.select("file", F.when(nothing, F.flatten("rows.wanted")).otherwise(F.flatten("rows.added")).alias("added"), nothing.alias("already_present"))
