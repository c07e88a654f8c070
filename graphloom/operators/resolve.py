"""Name resolution on fact tables: scopes, bases, re-exports, module trees, specifiers and overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.patterns import settled

EXTENSIONS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".json")
MOST_HOPS = 8


def prefixes(namespace: Column) -> Column:
    """A dotted namespace and all that enclose it, innermost first, the global one ('') last."""
    parts = F.split(namespace, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def in_scope(refs: DataFrame, defs: DataFrame, usings: DataFrame) -> DataFrame:
    """(ref, step, outcome, count, first): refs (ref, file, namespace, name) against defs (id, namespace, name) and usings
    (file, target). For each enclosing namespace the type declared there, then one that a using brings; the first level with a
    candidate answers, and several candidates are ambiguous, never guessed."""
    # candidates are folded to a count and the first before the join, so a common name costs one row a level, not one a candidate
    folded = defs.groupBy(F.col("namespace").alias("scope"), "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    levels = refs.select("ref", "name", F.posexplode(prefixes(F.col("namespace"))).alias("level", "scope"))
    own = levels.join(folded, ["scope", "name"]).select("ref", (F.col("level") * 2).alias("step"), "n", "id")
    brought = usings.select("file", F.col("target").alias("scope")).distinct()
    used = refs.select("ref", "file", "name").join(brought, "file").join(folded, ["scope", "name"]).select("ref", F.lit(1).alias("step"), "n", "id")
    out = own.unionByName(used).groupBy("ref", "step").agg(F.sum("n").alias("count"), F.min("id").alias("first"))
    out = out.groupBy("ref").agg(F.min(F.struct("step", "count", "first")).alias("x")).select("ref", "x.*")
    kind = F.when(F.col("count").isNull(), F.lit("not found")).when(F.col("count") == 1, F.lit("resolved")).otherwise(F.lit("ambiguous"))
    return refs.select("ref").join(out, "ref", "left").withColumn("outcome", kind)


def reachable_only(candidates: DataFrame, reach: DataFrame) -> DataFrame:
    """(ref, outcome, count): candidates (ref, unit, id, from_unit) that their unit reaches; a null unit is admitted. None left
    of some is external."""
    ok = reach.select(F.col("from_unit"), F.col("to_unit").alias("unit"), F.lit(True).alias("_r"))
    rows = candidates.join(ok, ["from_unit", "unit"], "left").withColumn("_ok", F.coalesce("_r", F.lit(False)) | F.col("unit").isNull() | F.col("from_unit").isNull())
    out = rows.groupBy("ref").agg(F.count_if(F.col("_ok")).alias("count"))
    return out.withColumn("outcome", F.when(F.col("count") == 0, F.lit("external")).when(F.col("count") == 1, F.lit("resolved")).otherwise(F.lit("ambiguous")))


def bases(inherits: DataFrame, most: int = 10_000) -> DataFrame:
    """(id, base, path): all bases of a type with their place in depth-first order, classes before interfaces, each once at its
    first place. ``inherits``: id, base, is_interface, position. Cycles end where a type would come again."""
    order = F.row_number().over(Window.partitionBy("id").orderBy("is_interface", "position", "base"))
    arcs = settled(inherits.select("id", "base", order.cast("int").alias("o")))
    level = arcs.select("id", "base", F.array("o").alias("path"), F.array("id", "base").alias("seen"))
    out = level
    for _ in range(most):
        nxt = arcs.select(F.col("id").alias("base"), F.col("base").alias("_next"), "o")
        level = settled(level.join(nxt, "base").filter(~F.array_contains("seen", F.col("_next"))).select("id", F.col("_next").alias("base"), F.concat("path", F.array("o")).alias("path"), F.concat("seen", F.array("_next")).alias("seen")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    else:
        raise RuntimeError(f"bases are still new after {most} rounds")
    return out.groupBy("id", "base").agg(F.min("path").alias("path"))


def overridden(members: DataFrame, all_bases: DataFrame) -> DataFrame:
    """(id, member, base): the first base in order that declares the member too. ``members``: id, member."""
    declared = members.select(F.col("id").alias("base"), "member")
    return members.join(all_bases, "id").join(declared, ["base", "member"]).groupBy("id", "member").agg(F.min_by("base", "path").alias("base"))


def exported(names: DataFrame, own: DataFrame, reexports: DataFrame) -> DataFrame:
    """(file, name, id, hop): what a name imported from a file means. ``names``: file, name; ``own``: file, name, id; ``reexports``:
    file, name (``*``: all), to_file, source, position. A file's own declaration first, then its re-exports in order, at most eight
    hops; the first path in depth-first order answers."""
    at = names.distinct().select("file", "name", F.col("file").alias("_at"), F.col("name").alias("_as"), F.array().cast("array<int>").alias("path"), F.array("file").alias("seen"))
    found = None
    for hop in range(MOST_HOPS + 1):
        at = settled(at)
        hits = at.join(own.select(F.col("file").alias("_at"), F.col("name").alias("_as"), "id"), ["_at", "_as"]).select("file", "name", "path", "id", F.lit(hop).alias("hop"))
        found = hits if found is None else found.unionByName(hits)
        if hop == MOST_HOPS:
            break
        arcs = reexports.select(F.col("file").alias("_at"), F.col("name").alias("_n"), "to_file", "source", "position")
        nxt = at.join(arcs, "_at").filter((F.col("_n") == F.col("_as")) | (F.col("_n") == "*")).filter(~F.array_contains("seen", F.col("to_file")))
        at = nxt.select("file", "name", F.col("to_file").alias("_at"), F.when(F.col("_n") == "*", F.col("_as")).otherwise(F.col("source")).alias("_as"), F.concat("path", F.array("position")).alias("path"), F.concat("seen", F.array("to_file")).alias("seen"))
        if at.isEmpty():
            break
    return found.groupBy("file", "name").agg(F.min_by(F.struct("id", "hop"), "path").alias("x")).select("file", "name", "x.id", "x.hop")


def probes(base: Column) -> Column:
    """The files that a specifier without or with an extension may mean, in order."""
    direct = [base, *[F.concat(base, F.lit(e)) for e in EXTENSIONS]]
    emitted = [F.regexp_replace(base, r"\.[mc]?jsx?$", e) for e in (".ts", ".tsx")]
    index = [F.concat(base, F.lit("/index" + e)) for e in EXTENSIONS]
    return F.array(*direct, *emitted, *index)


def specifiers(imports: DataFrame, aliases: DataFrame, files: DataFrame, base_url: str = "") -> DataFrame:
    """(from_file, specifier, to_file, via): relative first, then the first alias that matches with its targets in order, then
    the base directory; the first probe that is a file answers. ``aliases``: position, pattern, target_position, target."""
    own = imports.select("from_file", "specifier").distinct()
    folder = F.regexp_replace("from_file", r"/?[^/]*$", "")
    relative = own.filter(F.col("specifier").startswith(".")).select("from_file", "specifier", F.lit("relative").alias("via"), F.lit(0).alias("s"), text.joined_path(folder, F.col("specifier")).alias("base"))
    bare = own.filter(~F.col("specifier").startswith("."))
    head, tail = F.substring_index("pattern", "*", 1), F.when(F.contains(F.col("pattern"), F.lit("*")), F.substring_index("pattern", "*", -1)).otherwise(F.lit(""))
    starred = F.contains(F.col("pattern"), F.lit("*"))
    fits = F.when(starred, F.col("specifier").startswith(head) & F.col("specifier").endswith(tail)).otherwise(F.col("specifier") == F.col("pattern"))
    hit = bare.join(aliases, fits)
    hit = hit.withColumn("_first", F.min("position").over(Window.partitionBy("from_file", "specifier"))).filter("position = _first")
    rest = F.expr("substring(specifier, length(substring_index(pattern, '*', 1)) + 1, length(specifier) - length(pattern) + 1)")
    alias = hit.select("from_file", "specifier", F.lit("alias").alias("via"), (F.col("target_position") + 1).alias("s"), F.when(starred, F.replace(F.col("target"), F.lit("*"), rest)).otherwise(F.col("target")).alias("base"))
    rooted = bare.select("from_file", "specifier", F.lit("base").alias("via"), F.lit(1_000_000).alias("s"), text.joined_path(F.lit(base_url), F.col("specifier")).alias("base"))
    asked = relative.unionByName(alias).unionByName(rooted).filter("base is not null").select("from_file", "specifier", "via", "s", F.posexplode(probes(F.col("base"))).alias("p", "file"))
    return asked.join(files.select("file"), "file").groupBy("from_file", "specifier").agg(F.min_by(F.struct(F.col("file").alias("to_file"), "via"), F.struct("s", "p")).alias("x")).select("from_file", "specifier", "x.to_file", "x.via")


def module_tree(roots: DataFrame, mods: DataFrame, files: DataFrame, most: int = 10_000) -> DataFrame:
    """(file, module): the module that first reaches each file, breadth first from the crate roots (file, seq). ``mods``: file, name,
    seq. ``mod x;`` means x.rs or x/mod.rs beside it; with both there it reaches nothing. Files that no root reaches are roots."""
    known = files.select("file").distinct()
    stem = F.regexp_replace("file", r"(^|/)(mod|lib|main)\.rs$", "")
    folder = F.when(F.col("file").rlike(r"(^|/)(mod|lib|main)\.rs$"), stem).otherwise(F.regexp_replace("file", r"\.rs$", ""))
    slash = F.when(folder == "", F.lit("")).otherwise(F.concat(folder, F.lit("/")))
    want = mods.select("file", "name", "seq", F.explode(F.array(F.concat(slash, "name", F.lit(".rs")), F.concat(slash, "name", F.lit("/mod.rs")))).alias("to"))
    arcs = want.join(known.withColumnRenamed("file", "to"), "to").groupBy("file", "name", "seq").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to")).filter("n = 1")
    arcs = settled(arcs.select("file", "name", "seq", "to"))
    level = settled(roots.groupBy("file").agg(F.min(F.array("seq")).alias("order")).withColumn("module", F.lit("crate")))
    out = level
    for _ in range(most):
        nxt = level.join(arcs, "file").select(F.col("to").alias("file"), F.concat("order", F.array("seq")).alias("order"), F.concat_ws("::", "module", "name").alias("module"))
        nxt = nxt.join(out.select("file"), "file", "left_anti").groupBy("file").agg(F.min("order").alias("order"), F.min_by("module", "order").alias("module"))
        level = settled(nxt)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    else:
        raise RuntimeError(f"files are still new after {most} rounds")
    orphans = known.filter(F.col("file").endswith(".rs")).join(out.select("file"), "file", "left_anti").withColumn("module", F.lit("crate"))
    return out.select("file", "module").unionByName(orphans)


def overruled(edges: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Edges (file, line, member, to) with confirmed facts of the same place in their stead, and ``source``: a place with facts
    takes all of them and none of its own edges."""
    key = ["file", "line", "member"]
    kept = edges.join(confirmed.select(*key).distinct(), key, "left_anti").withColumn("source", F.lit("ladder"))
    shown = confirmed.join(edges.select(*key).distinct(), key, "left_semi").select(*edges.columns).withColumn("source", F.lit("semantic"))
    fresh = confirmed.join(edges.select(*key).distinct(), key, "left_anti").select(*edges.columns).withColumn("source", F.lit("semantic-discovered"))
    return kept.unionByName(shown).unionByName(fresh)


def constants(parts: DataFrame, most: int = 8) -> DataFrame:
    """(name, value): string constants folded from their parts (name, position, literal, reference). A constant whose reference is
    missing, comes back to itself or lies deeper than ``most`` has no value."""
    value = parts.filter("1 = 0").select("name", F.lit("").alias("value"))
    for _ in range(most):
        known = value.select(F.col("name").alias("reference"), F.col("value").alias("_v"))
        rows = parts.join(known, "reference", "left").withColumn("_p", F.coalesce("literal", "_v"))
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "_p"))), lambda x: x["_p"]), "")
        new = settled(rows.groupBy("name").agg(F.count_if(F.col("_p").isNull()).alias("_open"), whole.alias("value")).filter("_open = 0").select("name", "value"))
        if new.count() == value.count():
            return new
        value = new
    return value


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The reason of the first check, in order, that fails; null if all hold."""
    out = F.lit(None).cast("string")
    for reason, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)).otherwise(out)
    return out
