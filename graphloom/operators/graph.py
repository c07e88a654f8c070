"""Reference graph operators: adjacency, folds, ladders, walks, closures and ranking.

Relations: ``defs`` (id, name, namespace, kind, file, line, end_line, seq), ``def_sites`` (id, file, line), ``edges`` (seq, kind,
from_file, from_line, to, to_file, tier) where tier is null for precise edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.patterns import first_per_key, grown, meeting, ranked_table, settled, unfused

HUB_LIMIT = 34


def admitted(edges: DataFrame, guesses: bool = True, dispatch: bool = True, bus: bool = True) -> DataFrame:
    keep = F.lit(True)
    if not guesses:
        keep &= F.col("tier").isNull() | (F.col("tier") == "ext")
    if not dispatch:
        keep &= ~F.col("kind").isin("implements", "overrides")
    if not bus:
        keep &= F.col("kind") != "bus-hop"
    return edges.filter(keep)


def heuristic(tier: Column) -> Column:
    return tier.isNotNull()


def tier_fold(edges: DataFrame, key: list[str]) -> DataFrame:
    """Weakest claim of a group: ext if any is, else guess; null if all are precise."""
    rows = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("refs"), F.max((F.col("tier") == "ext").cast("int")).alias("_e"), F.max(heuristic(F.col("tier")).cast("int")).alias("_h"))
    return rows.select(*key, "refs", F.when(F.col("_h") == 0, F.lit(None).cast("string")).when(F.col("_e") == 1, F.lit("ext")).otherwise(F.lit("guess")).alias("tier"))


def inbound(edges: DataFrame, defs: DataFrame, cap: int = 30) -> DataFrame:
    """References to each definition: precise first, own project first, then place; ``cap`` rows each with totals."""
    own = defs.select(F.col("id").alias("to"), text.project(F.col("file")).alias("_home"))
    rows = edges.join(own, "to").withColumn("heuristic", heuristic(F.col("tier"))).withColumn("foreign", text.project(F.col("from_file")) != F.col("_home"))
    return ranked_table(rows, ["to"], [F.col("heuristic"), F.col("foreign"), F.col("from_file"), F.col("from_line"), F.col("seq")], cap)


def outbound(edges: DataFrame, def_files: DataFrame, cap: int = 30) -> DataFrame:
    """References out of each definition's files. Rows are capped by file before they meet the definitions."""
    rows = edges.withColumn("heuristic", heuristic(F.col("tier")))
    order = [F.col("heuristic"), F.col("from_file"), F.col("from_line"), F.col("seq")]
    per_file = rows.withColumn("_r", F.row_number().over(Window.partitionBy("from_file").orderBy(*order))).filter(F.col("_r") <= cap)
    sizes = edges.groupBy("from_file").agg(F.count(F.lit(1)).alias("_n"))
    files = def_files.select("id", F.col("file").alias("from_file")).distinct()
    total = files.join(sizes, "from_file").groupBy("id").agg(F.sum("_n").alias("total"))
    out = files.join(per_file, "from_file").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order)).cast("long")).filter(F.col("rank") <= cap)
    return out.join(total, "id").withColumn("dropped", F.greatest(F.lit(0).cast("long"), F.col("total") - cap)).drop("_r")


def file_inbound(edges: DataFrame) -> DataFrame:
    return edges.filter("tier is null and to_file <> from_file").groupBy("to_file").agg(F.count(F.lit(1)).alias("inbound"))


def in_degree(edges: DataFrame) -> DataFrame:
    """Distinct other files that point to each file, all tiers."""
    return edges.filter("to_file <> from_file").groupBy("to_file").agg(F.countDistinct("from_file").alias("in_degree"))


def sites_of(edges: DataFrame, key: str) -> DataFrame:
    return edges.groupBy(key).agg(F.countDistinct(F.struct("from_file", "from_line")).alias("sites"))


def heuristic_dedup(edges: DataFrame) -> DataFrame:
    """Precise edges all stay; of heuristic ones with equal (kind, place, target) the first."""
    key = ["kind", "from_file", "from_line", "to", "to_file"]
    once = first_per_key(edges.filter("tier is not null"), key, ["seq"])
    return edges.filter("tier is null").unionByName(once)


def occurrence_index(rows: DataFrame, fields: list[str], order: str) -> DataFrame:
    """Place among rows equal in all fields, null for single ones."""
    w = Window.partitionBy(*fields)
    n = F.row_number().over(w.orderBy(order)).cast("long") - 1
    return rows.withColumn("occurrence", F.when(F.count(F.lit(1)).over(w) > 1, n))


def hops(arcs: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(node, hop): the fewest arcs (src to dst) from a seed, for nodes within ``most``."""
    return grown(seeds, lambda newest: newest.join(arcs, newest["node"] == arcs["src"]).select(F.col("dst").alias("node")), most)


def closure(arcs: DataFrame, nodes: DataFrame, most: int = 10_000) -> DataFrame:
    """(origin, node): reflexive and transitive reachability, whole or an error after ``most`` rounds."""
    start = nodes.select(F.col("node").alias("origin"), "node")
    return grown(start, lambda newest: newest.join(arcs, newest["node"] == arcs["src"]).select("origin", F.col("dst").alias("node")), most, whole=True).drop("hop")


def impact(edges: DataFrame, defs: DataFrame, seeds: DataFrame, most: int = 2, hub_limit: int = HUB_LIMIT) -> DataFrame:
    """(file, hop, via_count, heuristic_count, ext_count, symbols, hub): files that a change of the seed definitions reaches.

    Each hop takes the inbound edges of the frontier's definitions. A file keeps the counts of the hop that first hit it; seed
    files are no rows but are expanded when hit; a file without a precise hit at that hop is not expanded, nor is a hub.
    """
    hubs = settled(in_degree(edges).filter(F.col("in_degree") >= hub_limit).select(F.col("to_file").alias("file")))
    seed_files = settled(defs.join(seeds, "id").select("file").distinct())
    frontier = settled(seeds.select("id").distinct())
    seen_defs, rows = frontier, None
    for hop in range(1, most + 1):
        hit = edges.join(frontier, edges["to"] == frontier["id"])
        by_file = hit.groupBy(F.col("from_file").alias("file")).agg(
            F.count_if(F.col("tier").isNull()).alias("via_count"), F.count_if(F.col("tier").isNotNull()).alias("heuristic_count"),
            F.count_if(F.col("tier") == "ext").alias("ext_count"), F.countDistinct("to").alias("symbols"),
        )
        by_file = by_file.join(hubs.withColumn("hub", F.lit(True)), "file", "left").withColumn("hub", F.coalesce("hub", F.lit(False)) | text.is_infra_path(F.col("file")))
        by_file = settled(by_file.withColumn("hop", F.lit(hop)))
        new = by_file.join(seed_files, "file", "left_anti")
        new = new if rows is None else new.join(rows.select("file"), "file", "left_anti")
        rows = settled(new if rows is None else rows.unionByName(new))
        if hop == most:
            break
        grow = by_file.filter("via_count > 0 and not hub").select("file")
        frontier = settled(defs.join(grow, "file", "left_semi").select("id").distinct().join(seen_defs, "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen_defs = seen_defs.unionByName(frontier)
    return rows


def page_rank(arcs: DataFrame, nodes: DataFrame, seeds: DataFrame, steps: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, score): personalized ranking over the set of arcs between ``nodes``; the start is even over the seeds, or over all
    nodes without a seed among them, and what stands on nodes without arcs returns there."""
    arcs = arcs.select("src", "dst").distinct().join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    arcs = settled(arcs.select("src", "dst"))
    degree = arcs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    marks = nodes.join(degree, "node", "left").join(seeds.select("node").distinct().withColumn("_s", F.lit(1)), "node", "left").select("node", F.coalesce("out", F.lit(0)).alias("out"), F.coalesce("_s", F.lit(0)).alias("_s"))
    total = marks.agg(F.sum("_s").alias("_n"), F.count(F.lit(1)).alias("_all"))
    start = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n").cast("double")).otherwise(F.lit(1.0) / F.col("_all"))
    rank = settled(marks.crossJoin(F.broadcast(total)).select("node", "out", start.alias("start"), start.alias("score")))
    for step in range(steps):
        loose = rank.filter("out = 0").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("loose"))
        flow = rank.filter("out > 0").join(arcs, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") / F.col("out")).alias("flow"))
        rank = rank.drop("score").join(flow, "node", "left").crossJoin(F.broadcast(loose))
        rank = rank.withColumn("score", (F.lit(1 - damping) + damping * F.col("loose")) * F.col("start") + damping * F.coalesce("flow", F.lit(0.0))).drop("flow", "loose")
        if step % 5 == 4:
            rank = settled(rank)
    return rank.select("node", "score")


def nearest_unit(files: DataFrame, units: DataFrame) -> DataFrame:
    """(file, unit): the unit of the longest directory above a file that one unit alone owns."""
    single = units.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("unit")).filter("n = 1").drop("n")
    above = files.select("file", F.explode(text.ancestors(F.col("file"))).alias("dir"))
    return above.join(single, "dir").groupBy("file").agg(F.max_by("unit", F.length("dir")).alias("unit"))


def fan_out(edges: DataFrame) -> DataFrame:
    """(edges, sites): sites with 1, 2, 3 and 4 or more edges."""
    return edges.groupBy("from_file", "from_line").agg(F.count(F.lit(1)).alias("n")).groupBy(F.least("n", F.lit(4)).alias("edges")).agg(F.count(F.lit(1)).alias("sites"))


#: Pairs of a file and a site that one task goes through, about.
PAIRS = 20_000_000


def interface_hops(implemented: DataFrame, sites: DataFrame) -> DataFrame:
    """(file, from_file, from_line, seq, interfaces): every file with every site of another file that names an interface the file
    implements; ``seq`` is the site's least among the shared interfaces, ``interfaces`` their number. ``implemented``: distinct (file,
    namespace); ``sites``: one row (from_file, from_line, namespace, seq) for each interface of a site.

    A pair is made once, by the first of the site's interfaces (by seq) that the file has: the others fail on the bits of the
    interfaces before them, so pairs are neither shuffled nor aggregated. With over 64 interfaces several share a bit, and a pair that
    fails on it is decided by the names. Sites of an interface stand in the order of the interfaces before theirs, so neighbours have
    the same files, and the written columns are runs and repetitions."""
    names = implemented.select("namespace").filter("namespace is not null").distinct()
    many = names.limit(65).count() > 64
    bit = F.pmod(F.xxhash64("namespace"), F.lit(64)).cast("int") if many else F.row_number().over(Window.orderBy("namespace")) - 1
    bits = names.select("namespace", F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    implemented = settled(implemented.join(bits, "namespace"))
    sites = settled(sites.join(bits, "namespace"))
    site = Window.partitionBy("from_file", "from_line")
    before = site.orderBy(F.col("seq").asc_nulls_last(), "namespace").rowsBetween(Window.unboundedPreceding, -1)
    own = [F.bit_or("bit").alias("has")] + [F.collect_list("namespace").alias("all_has")] * many
    asked = [F.coalesce(F.bit_or("bit").over(before), F.lit(0).cast("long")).alias("before"), F.bit_or("bit").over(site).alias("asks")]
    asked += [F.collect_list("namespace").over(before).alias("all_before"), F.collect_list("namespace").over(site).alias("all_asks")] * many
    files = implemented.drop("bit").join(implemented.groupBy("file").agg(*own), "file").select("namespace", F.bit_count("has").alias("size"), "has", "file", *["all_has"] * many)
    sites = sites.select("namespace", *asked, "from_file", "from_line", "seq").select("namespace", "before", "asks", "from_file", "from_line", "seq", *["all_before", "all_asks"] * many)
    met = meeting(sites, files, "namespace", PAIRS).select("has", F.col("file").alias("files"), *[F.col("all_has").alias("alls")] * many, F.explode("ls").alias("l"))
    pairs = unfused(met.select("l.*", "has", "files", *["alls"] * many)).select("*", F.posexplode("has").alias("at", "_has")).drop("has").withColumnRenamed("_has", "has")
    pairs = pairs.withColumns({"file": F.get("files", F.col("at"))} | ({"all_has": F.get("alls", F.col("at"))} if many else {}))
    first, shared = F.col("has").bitwiseAND(F.col("before")) == 0, F.bit_count(F.col("has").bitwiseAND(F.col("asks"))).cast("long")
    if many:
        first, shared = first | ~F.arrays_overlap("all_has", "all_before"), F.size(F.array_intersect("all_has", "all_asks")).cast("long")
    return pairs.filter(first & (F.col("file") != F.col("from_file"))).select("file", "from_file", "from_line", "seq", shared.alias("interfaces"))
