"""The operators applied to the driver's tables, each with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, export, graph, resolve, sessions
from ..sources.relations import Demo
from .patterns import first_per_key, ladder, meeting, ordered_sum, ranked_table, settled, unfused

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The relations of sources.relations.Demo in SQL.
PRELUDE = """
files AS (SELECT s_suppkey AS file_id, 'n' || s_nationkey || '/s' || s_suppkey AS file FROM supplier),
nf AS (SELECT count(*) AS n FROM supplier),
defs AS (SELECT p_partkey AS id, p_name AS name, p_brand AS namespace, p_type AS kind, f.file_id, file, p_size AS line, p_size + 5 AS end_line FROM part, nf JOIN files f ON p_partkey % n = f.file_id),
def_sites AS (SELECT d.id, d.file, d.line FROM defs d UNION ALL SELECT d.id, f.file, d.line FROM defs d, nf JOIN files f ON (d.file_id + 1) % n = f.file_id WHERE d.line % 10 = 0),
edges AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000000 + round(l_extendedprice * 100)::BIGINT AS seq, CASE WHEN l_linestatus = 'F' THEN 'uses-type' ELSE 'uses-member' END AS kind,
  f.file AS from_file, l_linenumber AS from_line, l_partkey AS "to", t.file AS to_file, CASE l_returnflag WHEN 'A' THEN 'ext' WHEN 'R' THEN 'guess' END AS tier, l_quantity AS quantity
  FROM lineitem, nf JOIN files f ON l_suppkey = f.file_id JOIN files t ON l_partkey % n = t.file_id)
"""


def query(sql: str | None = None, prelude: bool = True, recursive: bool = False):
    """Registers a query under its function's name, with its SQL after the common relations."""

    def add(f: Callable[[Demo], DataFrame]) -> Callable[[Demo], DataFrame]:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Demo(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = ("WITH " + "RECURSIVE " * recursive + PRELUDE + sql) if prelude else sql
        return f

    return add


# --- adjacency and folds -------------------------------------------------------------------------------------------


@query(""", r AS (SELECT e.*, tier IS NOT NULL AS heuristic, split_part(from_file, '/', 1) <> split_part(d.file, '/', 1) AS "foreign" FROM edges e JOIN defs d ON e."to" = d.id),
q AS (SELECT *, row_number() OVER (PARTITION BY "to" ORDER BY heuristic, "foreign", from_file, from_line, seq) AS rank, count(*) OVER (PARTITION BY "to") AS total FROM r)
SELECT "to" AS id, rank, from_file, from_line, kind, tier, total, greatest(0, total - 30) AS dropped FROM q WHERE rank <= 30""")
def refs_ranked_capped(d: Demo) -> DataFrame:
    return graph.inbound(d.edges(), d.defs()).select(F.col("to").alias("id"), "rank", "from_file", "from_line", "kind", "tier", "total", "dropped")


@query(""", df AS (SELECT DISTINCT id, file FROM def_sites), pf AS (SELECT *, row_number() OVER (PARTITION BY from_file ORDER BY tier IS NOT NULL, from_line, seq) AS r FROM edges QUALIFY r <= 30),
n AS (SELECT from_file, count(*) AS n FROM edges GROUP BY 1), t AS (SELECT id, sum(n)::BIGINT AS total FROM df JOIN n ON df.file = n.from_file GROUP BY 1),
q AS (SELECT id, pf.*, row_number() OVER (PARTITION BY id ORDER BY tier IS NOT NULL, from_file, from_line, seq) AS rank FROM df JOIN pf ON df.file = pf.from_file)
SELECT q.id, rank, from_file, from_line, "to", total, greatest(0, total - 30) AS dropped FROM q JOIN t ON q.id = t.id WHERE rank <= 30""")
def refs_outbound(d: Demo) -> DataFrame:
    return graph.outbound(d.edges(), d.def_sites()).select("id", "rank", "from_file", "from_line", "to", "total", "dropped")


@query("""SELECT kind, count(*) FILTER (tier IS NULL) AS precise, count(*) FILTER (tier = 'ext') AS ext, count(*) FILTER (tier = 'guess') AS guess FROM edges GROUP BY kind""")
def refs_kind_totals(d: Demo) -> DataFrame:
    tier = F.col("tier")
    return d.edges().groupBy("kind").agg(F.count_if(tier.isNull()).alias("precise"), F.count_if(tier == "ext").alias("ext"), F.count_if(tier == "guess").alias("guess"))


@query("""SELECT "to" AS id, from_file, count(*) AS refs, CASE WHEN bool_and(tier IS NULL) THEN NULL WHEN bool_or(coalesce(tier, '') = 'ext') THEN 'ext' ELSE 'guess' END AS tier FROM edges GROUP BY ALL""")
def tier_fold(d: Demo) -> DataFrame:
    return graph.tier_fold(d.edges(), ["to", "from_file"]).withColumnRenamed("to", "id")


@query("""SELECT to_file, count(*) AS inbound FROM edges WHERE tier IS NULL AND to_file <> from_file GROUP BY 1""")
def file_inbound(d: Demo) -> DataFrame:
    return graph.file_inbound(d.edges())


@query("""SELECT to_file, count(DISTINCT from_file) AS in_degree FROM edges WHERE to_file <> from_file GROUP BY 1""")
def hub_indegree(d: Demo) -> DataFrame:
    return graph.in_degree(d.edges())


@query("""SELECT "to" AS id, count(DISTINCT (from_file, from_line)) AS sites FROM edges GROUP BY 1""")
def fanin_sites(d: Demo) -> DataFrame:
    return graph.sites_of(d.edges(), "to").withColumnRenamed("to", "id")


@query("""SELECT from_file, count(*) AS refs, (CASE WHEN count(*) = 0 THEN 0 ELSE (count(*) FILTER (tier = 'guess') * 2000 + count(*)) // (count(*) * 2) END)::BIGINT AS tenths FROM edges GROUP BY 1""")
def ambiguous_percent(d: Demo) -> DataFrame:
    rows = d.edges().groupBy("from_file").agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("tier") == "guess").alias("g"))
    return rows.select("from_file", "refs", text.percent_tenths(F.col("g"), F.col("refs")).alias("tenths"))


@query("""SELECT least(n, 4) AS edges, count(*) AS sites FROM (SELECT count(*) AS n FROM edges GROUP BY from_file, from_line) GROUP BY 1""")
def fanout_histogram(d: Demo) -> DataFrame:
    return graph.fan_out(d.edges())


@query(""", x AS (SELECT DISTINCT to_file AS file FROM edges) SELECT file FROM x WHERE NOT EXISTS (SELECT 1 FROM defs WHERE defs.file = x.file AND kind = 'ECONOMY')""")
def manifest_gap(d: Demo) -> DataFrame:
    known = d.defs().filter("kind = 'ECONOMY'").select("file")
    return d.edges().select(F.col("to_file").alias("file")).distinct().join(known, "file", "left_anti")


@query("""SELECT id, file, line FROM def_sites""")
def def_sites(d: Demo) -> DataFrame:
    return d.def_sites()


@query("""SELECT DISTINCT id, file FROM def_sites""")
def def_files(d: Demo) -> DataFrame:
    return d.def_sites().select("id", "file").distinct()


@query("""SELECT file, min(line) AS first_line FROM def_sites GROUP BY 1""")
def first_declaration(d: Demo) -> DataFrame:
    return d.def_sites().groupBy("file").agg(F.min("line").alias("first_line"))


@query("""SELECT seq, kind, from_file, from_line, "to", tier FROM edges WHERE tier IS NULL UNION ALL
SELECT min(seq), kind, from_file, from_line, "to", arg_min(tier, (seq, tier)) FROM edges WHERE tier IS NOT NULL GROUP BY kind, from_file, from_line, "to", to_file""")
def heuristic_dedup(d: Demo) -> DataFrame:
    rows = d.edges().drop("quantity")
    return graph.heuristic_dedup(rows).select("seq", "kind", "from_file", "from_line", "to", "tier")


@query("""SELECT seq, from_file, from_line, "to", CASE WHEN count(*) OVER w > 1 THEN row_number() OVER (PARTITION BY from_file, from_line, "to" ORDER BY seq) - 1 END AS occurrence FROM edges WINDOW w AS (PARTITION BY from_file, from_line, "to")""")
def occurrence_index(d: Demo) -> DataFrame:
    return graph.occurrence_index(d.edges(), ["from_file", "from_line", "to"], "seq").select("seq", "from_file", "from_line", "to", "occurrence")


# --- seeds, search and names ---------------------------------------------------------------------------------------


@query(""", seeds AS (SELECT DISTINCT name AS seed FROM defs UNION SELECT DISTINCT upper(name) FROM defs UNION SELECT id::VARCHAR FROM defs),
c AS (SELECT seed, 0 AS step, id FROM seeds JOIN defs ON id::VARCHAR = seed UNION SELECT seed, 1, id FROM seeds JOIN defs ON name = seed UNION SELECT seed, 2, id FROM seeds JOIN defs ON lower(name) = lower(seed)),
f AS (SELECT *, min(step) OVER (PARTITION BY seed) AS m FROM c)
SELECT seed, step, count(*) AS candidate_count, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, array_to_string(list(id ORDER BY id)[1:5], ',') AS first_five FROM f WHERE step = m GROUP BY seed, step""")
def seed_ladder(d: Demo) -> DataFrame:
    defs = d.defs().select("id", "name")
    seeds = defs.select(F.col("name").alias("seed")).union(defs.select(F.upper("name"))).union(defs.select(F.col("id").cast("string"))).distinct()
    steps = [seeds.join(defs, F.col("seed") == F.col("id").cast("string")), seeds.join(defs, F.col("seed") == F.col("name")), seeds.join(defs, F.lower("seed") == F.lower("name"))]
    out = ladder(steps, "seed", "id")
    return out.select("seed", "step", "candidate_count", "outcome", F.array_join(F.transform("candidates", lambda c: c.cast("string")), ",").alias("first_five"))


@query(""", o AS (SELECT name AS member, namespace AS owner, min(id) AS first_id, count(*) AS n FROM defs GROUP BY ALL)
SELECT member, count(*) AS owners, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, arg_min(owner, (first_id, owner)) AS first_owner FROM o GROUP BY member""")
def member_owner_ladder(d: Demo) -> DataFrame:
    owners = d.defs().groupBy(F.col("name").alias("member"), F.col("namespace").alias("owner")).agg(F.min("id").alias("first_id"))
    out = owners.groupBy("member").agg(F.count(F.lit(1)).alias("owners"), F.min_by("owner", F.struct("first_id", "owner")).alias("first_owner"))
    return out.withColumn("outcome", F.when(F.col("owners") == 1, F.lit("resolved")).otherwise(F.lit("ambiguous")))


@query(""", p AS (SELECT o_orderkey AS k, 'r' || (o_orderkey % 5) || '/c' || (o_custkey % 7) || '/x' || (o_orderkey % 3) || '/f' || o_orderkey AS file FROM orders),
u AS (SELECT DISTINCT 'r' || (o_orderkey % 5) AS dir, 'u' || (o_orderkey % 5) AS unit FROM orders UNION SELECT DISTINCT 'r' || (o_orderkey % 4) || '/c' || (o_custkey % 5), 'v' || (o_custkey % 5) FROM orders UNION SELECT DISTINCT 'r0/c1', 'w' || (o_orderkey % 2) FROM orders),
s AS (SELECT dir, min(unit) AS unit FROM u GROUP BY dir HAVING count(*) = 1)
SELECT file, arg_max(s.unit, length(dir)) AS unit FROM p JOIN s ON starts_with(file, dir || '/') GROUP BY file""")
def longest_prefix_unit(d: Demo) -> DataFrame:
    o = d.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    s = lambda c: c.cast("string")
    files = o.select(F.concat(F.lit("r"), s(F.col("k") % 5), F.lit("/c"), s(F.col("c") % 7), F.lit("/x"), s(F.col("k") % 3), F.lit("/f"), s(F.col("k"))).alias("file"))
    units = o.select(F.concat(F.lit("r"), s(F.col("k") % 5)).alias("dir"), F.concat(F.lit("u"), s(F.col("k") % 5)).alias("unit"))
    units = units.union(o.select(F.concat(F.lit("r"), s(F.col("k") % 4), F.lit("/c"), s(F.col("c") % 5)), F.concat(F.lit("v"), s(F.col("c") % 5))))
    units = units.union(o.select(F.lit("r0/c1"), F.concat(F.lit("w"), s(F.col("k") % 2)))).distinct()
    return graph.nearest_unit(files, units)


@query(""", q AS (SELECT DISTINCT name AS q FROM defs), w AS (SELECT q, list_filter(string_split(lower(q), ' '), lambda x: x <> '') AS words FROM q),
n AS (SELECT "to" AS id, count(*) AS inbound FROM edges WHERE tier IS NULL GROUP BY 1),
t AS (SELECT DISTINCT name, kind FROM defs),
h AS (SELECT q, len(words) AS k, t.name, t.kind, len(list_filter(words, lambda x: contains(lower(t.name || ' ' || t.kind), x))) AS hits FROM w, t),
p AS (SELECT *, max(hits) OVER (PARTITION BY q) AS best FROM h WHERE hits > 0),
r AS (SELECT q, name, kind, hits, row_number() OVER (PARTITION BY q ORDER BY hits DESC, name, kind) AS rank, count(*) OVER (PARTITION BY q) AS total, CASE WHEN best = k THEN 25 ELSE 10 END AS cap FROM p WHERE hits = k OR best < k)
SELECT q, rank, name, kind, hits, total FROM r WHERE rank <= cap""")
def find_all_then_any(d: Demo) -> DataFrame:
    # the pool is the name vocabulary, not the definitions: its size does not follow the table
    pool = d.defs().select("name", "kind").distinct()
    seeds = d.defs().select(F.col("name").alias("q")).distinct().withColumn("words", text.tokens(F.col("q")))
    hit = seeds.select("q", F.explode("words").alias("w"), F.size("words").alias("k"))
    words = pool.select("name", "kind", F.explode(F.array_distinct(text.tokens(F.concat_ws(" ", "name", "kind")))).alias("t"))
    vocabulary = hit.select("w").distinct().join(words.select("t").distinct(), F.contains(F.col("t"), F.col("w")))
    found = hit.join(vocabulary, "w").join(words, "t").select("q", "k", "w", "name", "kind").distinct()
    found = found.groupBy("q", "k", "name", "kind").agg(F.count(F.lit(1)).alias("hits"))
    w = Window.partitionBy("q")
    found = found.withColumn("best", F.max("hits").over(w)).filter("hits = k or best < k")
    found = found.withColumn("rank", F.row_number().over(w.orderBy(F.col("hits").desc(), "name", "kind")).cast("long")).withColumn("total", F.count(F.lit(1)).over(w))
    return found.filter(F.col("rank") <= F.when(F.col("best") == F.col("k"), 25).otherwise(10)).select("q", "rank", "name", "kind", "hits", "total")


@query(""", v AS (SELECT DISTINCT name FROM defs), q AS (SELECT name AS want, replace(name, 'e', '') AS typed FROM v), c AS (SELECT typed, name, levenshtein(typed, name) AS d FROM (SELECT DISTINCT typed FROM q), v)
SELECT typed, name, d AS distance, row_number() OVER (PARTITION BY typed ORDER BY d, name) AS rank FROM c WHERE d <= 2 QUALIFY rank <= 5""")
def did_you_mean(d: Demo) -> DataFrame:
    names = d.defs().select("name").distinct()
    typed = names.select(F.replace("name", F.lit("e"), F.lit("")).alias("typed")).distinct()
    # names within two edits differ by two in length at most, so the length is an equal-join key over five offsets
    keyed = typed.select("typed", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda o: F.length("typed") + o)).alias("n"))
    rows = keyed.join(names.withColumn("n", F.length("name")), "n").withColumn("distance", text.bounded_distance(F.col("typed"), F.col("name")).cast("long")).filter("distance <= 2")
    return rows.select("typed", "name", "distance", F.row_number().over(Window.partitionBy("typed").orderBy("distance", "name")).cast("long").alias("rank")).filter("rank <= 5")


@query("""SELECT id, len(string_split(name, ' ')) AS words, lower(replace(name, ' ', '_')) AS snake FROM defs""")
def name_shapes(d: Demo) -> DataFrame:
    return d.defs().select("id", F.size(text.name_tokens(F.replace("name", F.lit(" "), F.lit("_")))).cast("long").alias("words"), F.lower(F.replace("name", F.lit(" "), F.lit("_"))).alias("snake"))


@query(""", f AS (SELECT DISTINCT file, name, namespace FROM defs), t AS (SELECT file, CASE WHEN bool_or(name LIKE '%ring%') THEN 'attribute' WHEN split_part(file, '/', 1) IN ('n0', 'n5', 'n10') THEN 'project' WHEN file LIKE '%7' THEN 'path' END AS via FROM f GROUP BY file)
SELECT t.file, via, count(*) AS refs, min(seq) AS first_seq FROM t JOIN edges e ON e.from_file = t.file WHERE via IS NOT NULL GROUP BY ALL""")
def test_files_vouch(d: Demo) -> DataFrame:
    marks = d.defs().groupBy("file").agg(F.bool_or(F.contains("name", F.lit("ring"))).alias("attribute"))
    via = F.when(F.col("attribute"), F.lit("attribute")).when(text.project(F.col("file")).isin("n0", "n5", "n10"), F.lit("project")).when(F.col("file").endswith("7"), F.lit("path"))
    vouched = marks.select("file", via.alias("via")).filter("via is not null")
    counts = d.edges().groupBy(F.col("from_file").alias("file")).agg(F.count(F.lit(1)).alias("refs"), F.min("seq").alias("first_seq"))
    return vouched.join(counts, "file")


@query(""", n AS (SELECT DISTINCT lower(replace(name, ' ', '')) AS stem, name FROM defs), t AS (SELECT DISTINCT name, lower(replace(name, ' ', '')) || 'tests' AS file_stem, kind FROM defs)
SELECT n.name, count(*) AS hints, array_to_string(list(t.kind ORDER BY t.kind)[1:5], ',') AS first_kinds FROM n JOIN t ON t.file_stem IN (n.stem || 'test', n.stem || 'tests', n.stem || 'spec') GROUP BY n.name""")
def name_hint(d: Demo) -> DataFrame:
    names = d.defs().select("name").distinct().select("name", F.lower(F.replace("name", F.lit(" "), F.lit(""))).alias("stem"))
    wanted = names.select("name", F.explode(F.array(*[F.concat("stem", F.lit(s)) for s in ("test", "tests", "spec")])).alias("key"))
    tests = d.defs().select("name", "kind").distinct().select("kind", text.stem(F.concat(F.lit("a/"), F.replace("name", F.lit(" "), F.lit("-")), F.lit("-tests.cs"))).alias("key"))
    return wanted.join(tests, "key").groupBy("name").agg(F.count(F.lit(1)).alias("hints"), F.array_join(F.slice(F.array_sort(F.collect_list("kind")), 1, 5), ",").alias("first_kinds"))


# --- messages ------------------------------------------------------------------------------------------------------


@query("""SELECT p.props AS message, p.n * c.n AS hops, p.n AS sites, c.n AS handlers, c.u AS users FROM (SELECT props, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) p
JOIN (SELECT props, count(*) AS n, count(DISTINCT user_id) AS u FROM events WHERE event_type = 'view' GROUP BY 1) c ON p.props = c.props""", prelude=False)
def bus_hop_counts(d: Demo) -> DataFrame:
    # publishers and handlers are folded by message before they meet: the product is a number, not rows
    e = d.table("events")
    sent = e.filter("event_type = 'purchase'").groupBy(F.col("props").alias("message")).agg(F.count(F.lit(1)).alias("sites"))
    taken = e.filter("event_type = 'view'").groupBy(F.col("props").alias("message")).agg(F.count(F.lit(1)).alias("handlers"), F.countDistinct("user_id").alias("users"))
    return sent.join(taken, "message").withColumn("hops", F.col("sites") * F.col("handlers"))


@query("""SELECT DISTINCT p.user_id AS publisher, c.user_id AS handler, p.props AS message FROM events p JOIN events c ON p.props = c.props WHERE p.event_type = 'purchase' AND c.event_type = 'view'""", prelude=False)
def bus_hop_pairs(d: Demo) -> DataFrame:
    # a message's pairs are dealt over a grid; neighbours in it share a publisher, and the handlers beside them repeat
    e = d.table("events").select("user_id", "event_type", F.col("props").alias("message"))
    sent = e.filter("event_type = 'purchase'").select("message", F.col("user_id").alias("publisher")).distinct()
    taken = e.filter("event_type = 'view'").select("message", F.col("user_id").alias("handler")).distinct()
    rows = unfused(meeting(settled(sent), settled(taken), "message").select("message", "handler", F.explode("ls.publisher").alias("publisher")))
    return rows.select("publisher", F.explode("handler").alias("handler"), "message")


@query("""SELECT i.event_type AS repo, h.file AS file, i.event_id AS ref FROM events i JOIN files h ON i.user_id % (SELECT n FROM nf) = h.file_id WHERE i.event_type = 'click'""")
def imported_direct(d: Demo) -> DataFrame:
    e = d.table("events").filter("event_type = 'click'").withColumn("file_id", F.col("user_id") % d.n_files())
    return e.join(d.files(), "file_id").select(F.col("event_type").alias("repo"), "file", F.col("event_id").alias("ref"))


# --- walks ---------------------------------------------------------------------------------------------------------


@query(""", arcs AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey),
r(origin, node) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT origin, dst FROM r JOIN arcs ON node = src) SELECT origin, node FROM r""", recursive=True)
def unit_reach(d: Demo) -> DataFrame:
    n = d.table("nation")
    arcs = n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("b.n_nationkey") > F.col("a.n_nationkey"))).select(F.col("a.n_nationkey").alias("src"), F.col("b.n_nationkey").alias("dst"))
    return graph.closure(settled(arcs), n.select(F.col("n_nationkey").alias("node")))


#: Two hops written out: the first hit's counts stay, seed files are no rows but are expanded, hubs are not.
IMPACT_SQL = """, hubs AS (SELECT to_file AS file FROM edges WHERE to_file <> from_file GROUP BY 1 HAVING count(DISTINCT from_file) >= 34),
s0 AS (SELECT id, file FROM defs WHERE id = 7), f1 AS (SELECT from_file AS file, count(*) FILTER (tier IS NULL) AS via_count, count(*) FILTER (tier IS NOT NULL) AS heuristic_count, count(*) FILTER (tier = 'ext') AS ext_count, count(DISTINCT "to") AS symbols FROM edges JOIN s0 ON "to" = s0.id GROUP BY 1),
d1 AS (SELECT DISTINCT defs.id FROM defs JOIN f1 ON defs.file = f1.file WHERE via_count > 0 AND f1.file NOT IN (SELECT file FROM hubs) AND defs.id NOT IN (SELECT id FROM s0)),
f2 AS (SELECT from_file AS file, count(*) FILTER (tier IS NULL) AS via_count, count(*) FILTER (tier IS NOT NULL) AS heuristic_count, count(*) FILTER (tier = 'ext') AS ext_count, count(DISTINCT "to") AS symbols FROM edges JOIN d1 ON "to" = d1.id GROUP BY 1)
SELECT *, 1 AS hop, file IN (SELECT file FROM hubs) AS hub FROM f1 WHERE file NOT IN (SELECT file FROM s0)
UNION ALL SELECT *, 2, file IN (SELECT file FROM hubs) FROM f2 WHERE file NOT IN (SELECT file FROM s0) AND file NOT IN (SELECT file FROM f1)"""


@query(""", arcs AS (SELECT DISTINCT from_file AS src, to_file AS dst FROM edges),
walk(node, hop) AS (SELECT file, 0 FROM files WHERE file_id = 7 UNION SELECT dst, hop + 1 FROM walk JOIN arcs ON walk.node = arcs.src WHERE hop < 3)
SELECT node, min(hop)::INT AS hop FROM walk GROUP BY node""", recursive=True)
def khop_min(d: Demo) -> DataFrame:
    arcs = settled(d.edges().select(F.col("from_file").alias("src"), F.col("to_file").alias("dst")).distinct())
    return graph.hops(arcs, d.files().filter("file_id = 7").select(F.col("file").alias("node")), 3)


@query(IMPACT_SQL)
def impact_walk_braked(d: Demo) -> DataFrame:
    return graph.impact(settled(d.edges()), settled(d.defs()), d.defs().filter("id = 7").select("id"))


@query(""", arcs AS MATERIALIZED (SELECT DISTINCT from_file AS src, to_file AS dst, 1 AS m FROM edges WHERE tier IS NULL AND to_file IN (SELECT file FROM files)),
deg AS MATERIALIZED (SELECT file AS node, coalesce((SELECT sum(m) FROM arcs WHERE src = file), 0) AS outn, CASE WHEN file_id = 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS seed FROM files),
r0 AS MATERIALIZED (SELECT node, outn, seed, seed AS score FROM deg)""" + "".join(f""",
f{k} AS MATERIALIZED (SELECT dst, sum(p.score * m / p.outn) AS flow FROM r{k - 1} p JOIN arcs ON p.node = src GROUP BY dst),
r{k} AS MATERIALIZED (SELECT node, outn, seed, (0.15::DOUBLE + 0.85::DOUBLE * (SELECT coalesce(sum(score), 0) FROM r{k - 1} WHERE outn = 0)) * seed + 0.85::DOUBLE * coalesce(flow, 0) AS score FROM r{k - 1} LEFT JOIN f{k} ON node = dst)""" for k in range(1, 21)) + " SELECT node, round(score, 9) AS score FROM r20")
def page_rank_20(d: Demo) -> DataFrame:
    arcs = settled(d.edges().filter("tier is null").select(F.col("from_file").alias("src"), F.col("to_file").alias("dst")))
    nodes = d.files().select(F.col("file").alias("node"))
    seeds = d.files().filter("file_id = 7").select(F.col("file").alias("node"))
    return graph.page_rank(arcs, nodes, seeds, 20).select("node", F.round("score", 9).alias("score"))


@query(""", i AS (SELECT DISTINCT file, namespace FROM defs), s AS (SELECT from_file, from_line, d.namespace AS iface, min(seq) AS seq FROM edges e JOIN defs d ON e."to" = d.id WHERE tier IS NULL GROUP BY ALL)
SELECT i.file, s.from_file, s.from_line, min(s.seq) AS seq, count(*) AS interfaces FROM i JOIN s ON i.namespace = s.iface WHERE i.file <> s.from_file GROUP BY ALL""")
def iface_hop_dedup(d: Demo) -> DataFrame:
    implemented = d.defs().select("file", "namespace").distinct()
    sites = d.edges().filter("tier is null").join(d.defs().select(F.col("id").alias("to"), "namespace"), "to").groupBy("from_file", "from_line", "namespace").agg(F.min("seq").alias("seq"))
    return graph.interface_hops(implemented, sites)


@query(""", h AS (SELECT "to", from_file, min((from_line, seq)) AS origin, bool_and(tier IS NOT NULL) AS tainted FROM edges GROUP BY ALL)
SELECT "to" AS id, count(*) AS files, count(*) FILTER (tainted) AS tainted_files, min(origin[2]) AS first_seq FROM h GROUP BY 1""")
def bus_taint(d: Demo) -> DataFrame:
    rows = d.edges().groupBy("to", "from_file").agg(F.min(F.struct("from_line", "seq")).alias("origin"), F.bool_and(F.col("tier").isNotNull()).alias("tainted"))
    return rows.groupBy(F.col("to").alias("id")).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("tainted")).alias("tainted_files"), F.min("origin.seq").alias("first_seq"))


# --- resolution ----------------------------------------------------------------------------------------------------


@query(""", p AS (SELECT e.seq, e.from_file, d.id, d.line, (CASE WHEN split_part(e.from_file, '/', 1) = split_part(d.file, '/', 1) THEN 3 WHEN e.from_line = d.line THEN 2 ELSE 1 END) AS score, count(*) OVER (PARTITION BY e.seq, e.from_file, e."to") AS pool
FROM edges e JOIN defs t ON e."to" = t.id JOIN defs d ON d.name = t.name AND d.namespace = t.namespace AND d.kind = t.kind WHERE e.tier = 'guess')
SELECT seq, from_file, id, score, pool FROM p WHERE pool <= 3 QUALIFY row_number() OVER (PARTITION BY seq, from_file ORDER BY score DESC, id) <= 3""")
def scored_pool(d: Demo) -> DataFrame:
    defs = d.defs()
    key = ["name", "namespace", "kind"]
    target = defs.select(F.col("id").alias("to"), *key)
    # the pool's size is an aggregate over definitions: groups too large are dropped before the join makes them rows
    small = defs.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).filter("members <= 3")
    sites = d.edges().filter("tier = 'guess'").drop("kind").join(target, "to").join(small, key).select("seq", "from_file", "from_line", "to", *key)
    repeated = sites.groupBy("seq", "from_file", "to").agg(F.count(F.lit(1)).alias("times"))
    rows = sites.join(defs.select("id", "file", "line", *key), key).join(repeated, ["seq", "from_file", "to"]).join(small, key)
    rows = rows.withColumn("pool", F.col("members") * F.col("times")).filter("pool <= 3")
    score = F.when(text.project(F.col("from_file")) == text.project(F.col("file")), 3).when(F.col("from_line") == F.col("line"), 2).otherwise(1)
    rows = rows.withColumn("score", score).withColumn("r", F.row_number().over(Window.partitionBy("seq", "from_file").orderBy(F.col("score").desc(), "id")))
    return rows.filter("r <= 3").select("seq", "from_file", "id", "score", "pool")


@query(""", a AS (SELECT id, line % 4 AS min_args, CASE WHEN line % 7 = 0 THEN -1 ELSE line % 4 + line % 3 END AS max_args FROM defs)
SELECT a.id, count(*) AS calls, count(*) FILTER (from_line - 1 >= min_args AND (max_args = -1 OR from_line - 1 <= max_args)) AS admitted FROM edges e JOIN a ON e."to" = a.id GROUP BY a.id""")
def arity_admit(d: Demo) -> DataFrame:
    a = d.defs().select(F.col("id").alias("to"), (F.col("line") % 4).alias("lo"), F.when(F.col("line") % 7 == 0, -1).otherwise(F.col("line") % 4 + F.col("line") % 3).alias("hi"))
    args = F.col("from_line") - 1
    ok = (args >= F.col("lo")) & ((F.col("hi") == -1) | (args <= F.col("hi")))
    return d.edges().join(a, "to").groupBy(F.col("to").alias("id")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(ok).alias("admitted"))


@query(""", g AS (SELECT id, name, list_transform(string_split(name, ' '), lambda x: CASE WHEN length(x) = 4 THEN '*' ELSE x END) AS args FROM defs), v AS (SELECT DISTINCT name, args FROM g)
SELECT a.name AS a, b.name AS b FROM v a JOIN v b ON len(a.args) = len(b.args) WHERE a.name < b.name AND len(list_filter(range(1, len(a.args) + 1), lambda i: NOT (a.args[i] = b.args[i] OR a.args[i] = '*' OR b.args[i] = '*'))) = 0""")
def generic_unify(d: Demo) -> DataFrame:
    v = d.defs().select("name").distinct().withColumn("args", F.transform(F.split("name", " "), lambda x: F.when(F.length(x) == 4, F.lit("*")).otherwise(x))).withColumn("n", F.size("args"))
    a, b = v.select(F.col("name").alias("a"), F.col("args").alias("x"), "n"), v.select(F.col("name").alias("b"), F.col("args").alias("y"), "n")
    rows = a.join(b, "n").filter("a < b")
    return rows.filter(F.forall(F.zip_with("x", "y", lambda p, q: (p == q) | (p == "*") | (q == "*")), lambda z: z)).select("a", "b")


@query(""", c AS (SELECT namespace AS iface, kind AS shape, count(*) AS n, min(id) AS one FROM defs GROUP BY ALL), p AS (SELECT *, min(CASE shape WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END) OVER (PARTITION BY iface) AS best, CASE shape WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END AS tier FROM c)
SELECT iface, sum(n)::BIGINT AS implementors, CASE WHEN sum(n) = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution, CASE WHEN sum(n) = 1 THEN min(one) END AS "to" FROM p WHERE tier = best GROUP BY iface""")
def ctor_di_outcome(d: Demo) -> DataFrame:
    tier = F.when(F.col("kind") == "ECONOMY", 0).when(F.col("kind") == "STANDARD", 1).otherwise(2)
    rows = d.defs().groupBy(F.col("namespace").alias("iface"), tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"))
    best = rows.groupBy("iface").agg(F.min_by(F.struct("n", "one"), "tier").alias("b"))
    one = F.col("b.n") == 1
    return best.select("iface", F.col("b.n").alias("implementors"), F.when(one, F.lit("resolved")).otherwise(F.lit("ambiguous")).alias("resolution"), F.when(one, F.col("b.one")).alias("to"))


@query("""SELECT name, namespace, min(id) AS service, max(id) AS implementation FROM defs GROUP BY name, namespace HAVING count(*) = 2""")
def overload_unique_pair(d: Demo) -> DataFrame:
    return d.defs().groupBy("name", "namespace").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("service"), F.max("id").alias("implementation")).filter("n = 2").drop("n")


@query("""SELECT name, line % 3 AS type_params, min(id) AS id, arg_min(file, id) AS owner_file, count(*) AS sites, count(DISTINCT file) AS files FROM defs GROUP BY ALL""")
def def_merge(d: Demo) -> DataFrame:
    return d.defs().groupBy("name", (F.col("line") % 3).alias("type_params")).agg(F.min("id").alias("id"), F.min_by("file", "id").alias("owner_file"), F.count(F.lit(1)).alias("sites"), F.countDistinct("file").alias("files"))


# --- resolution ----------------------------------------------------------------------------------------------------


@query(""", p AS (SELECT id, file, name, line, split_part(file, '/', 1) AS a, replace(file, '/', '.') AS b FROM defs),
g AS (SELECT CASE line % 3 WHEN 0 THEN '' WHEN 1 THEN a ELSE b END AS scope, name, count(*) AS n, min(id) AS first FROM p GROUP BY ALL),
c AS (SELECT id, 0 AS step, n, first FROM p JOIN g ON scope = b AND g.name = p.name UNION ALL SELECT id, 2, n, first FROM p JOIN g ON scope = a AND g.name = p.name UNION ALL SELECT id, 4, n, first FROM p JOIN g ON scope = '' AND g.name = p.name
 UNION ALL SELECT id, 1, n, first FROM p JOIN g ON scope = 'n' || (CAST(substr(a, 2) AS INT) + 1) % 25 AND g.name = p.name),
f AS (SELECT * FROM c QUALIFY step = min(step) OVER (PARTITION BY id))
SELECT p.id AS ref, f.step, f.n AS "count", f.first, CASE WHEN f.n IS NULL THEN 'not found' WHEN f.n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM p LEFT JOIN f ON p.id = f.id""")
def scope_ladder(d: Demo) -> DataFrame:
    own, folder = F.replace("file", F.lit("/"), F.lit(".")), F.substring_index("file", "/", 1)
    scope = F.when(F.col("line") % 3 == 0, F.lit("")).when(F.col("line") % 3 == 1, folder).otherwise(own)
    defs = settled(d.defs())
    usings = d.files().select("file", F.concat(F.lit("n"), (F.substring(folder, 2, 9).cast("int") + 1) % 25).alias("target"))
    return resolve.in_scope(defs.select(F.col("id").alias("ref"), "file", own.alias("namespace"), "name"), defs.select("id", scope.alias("namespace"), "name"), usings)


@query(""", c AS (SELECT from_file || ':' || from_line AS ref, f.n_regionkey = t.n_regionkey AND t.n_nationkey >= f.n_nationkey AS ok FROM edges JOIN nation f ON split_part(from_file, '/', 1) = 'n' || f.n_nationkey JOIN nation t ON split_part(to_file, '/', 1) = 'n' || t.n_nationkey)
SELECT ref, count(*) FILTER (ok) AS "count", CASE count(*) FILTER (ok) WHEN 0 THEN 'external' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM c GROUP BY ref""")
def reach_narrowing(d: Demo) -> DataFrame:
    unit = lambda file: F.substring(F.substring_index(file, "/", 1), 2, 9).cast("int")
    rows = d.edges().select(F.concat_ws(":", "from_file", "from_line").alias("ref"), F.col("to").alias("id"), unit("from_file").alias("from_unit"), unit("to_file").alias("unit"))
    reach = unit_reach(d).select(F.col("origin").alias("from_unit"), F.col("node").alias("to_unit"))
    return resolve.reachable_only(rows, reach)


BASES = """, arcs AS (SELECT a.n_nationkey AS id, b.n_nationkey AS base, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_nationkey % 2 = 0, b.n_nationkey) AS o FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey),
w(id, base, path) AS (SELECT id, base, [o] FROM arcs UNION ALL SELECT w.id, arcs.base, list_append(path, o) FROM w JOIN arcs ON w.base = arcs.id),
b AS (SELECT id, base, path FROM w QUALIFY row_number() OVER (PARTITION BY id, base ORDER BY path) = 1)"""


def _bases(d: Demo) -> DataFrame:
    a, b = (d.table("nation").select(F.col("n_nationkey").alias(k), "n_regionkey") for k in ("id", "base"))
    return resolve.bases(a.join(b, "n_regionkey").filter("base > id").select("id", "base", (F.col("base") % 2 == 0).alias("is_interface"), F.col("base").alias("position")))


@query(BASES + """ SELECT id, row_number() OVER (PARTITION BY id ORDER BY path)::INT AS place, base FROM b""", recursive=True)
def base_order(d: Demo) -> DataFrame:
    return _bases(d).select("id", F.row_number().over(Window.partitionBy("id").orderBy("path")).alias("place"), "base")


@query(BASES + """, m AS (SELECT DISTINCT s_nationkey AS id, 'm' || s_suppkey % 7 AS member FROM supplier)
SELECT m.id, m.member, b.base FROM m JOIN b ON m.id = b.id JOIN m o ON o.id = b.base AND o.member = m.member QUALIFY row_number() OVER (PARTITION BY m.id, m.member ORDER BY path) = 1""", recursive=True)
def nearest_override(d: Demo) -> DataFrame:
    members = d.table("supplier").select(F.col("s_nationkey").alias("id"), F.concat(F.lit("m"), F.col("s_suppkey") % 7).alias("member")).distinct()
    return resolve.overridden(members, _bases(d)).select("id", "member", "base")


@query(""", e AS (SELECT from_file AS file, from_line AS line, kind AS member, "to" FROM edges WHERE tier IS NULL), c AS (SELECT from_file AS file, from_line AS line, kind AS member, "to" FROM edges WHERE quantity >= 48)
SELECT *, 'ladder' AS source FROM e ANTI JOIN c USING (file, line, member) UNION ALL SELECT *, 'semantic' FROM c SEMI JOIN e USING (file, line, member) UNION ALL SELECT *, 'semantic-discovered' FROM c ANTI JOIN e USING (file, line, member)""")
def confirmed_override(d: Demo) -> DataFrame:
    shown = lambda rows: rows.select(F.col("from_file").alias("file"), F.col("from_line").alias("line"), F.col("kind").alias("member"), "to")
    edges = settled(d.edges())
    return resolve.overruled(shown(edges.filter("tier is null")), shown(edges.filter("quantity >= 48")))


@query("""WITH RECURSIVE v(id, value, depth) AS (SELECT p_partkey, p_brand, 1 FROM part WHERE p_partkey * 2 NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT p_partkey, p_brand || value, depth + 1 FROM v JOIN part ON p_partkey * 2 = id AND p_partkey <> id WHERE depth < 8)
SELECT id AS name, value FROM v""", prelude=False)
def constant_folding(d: Demo) -> DataFrame:
    p = d.table("part").select(F.col("p_partkey").alias("name"), "p_brand")
    head = p.select("name", F.lit(0).alias("position"), F.col("p_brand").alias("literal"), F.lit(None).cast("long").alias("reference"))
    tail = p.select("name", F.lit(1).alias("position"), F.lit(None).cast("string").alias("literal"), (F.col("name") * 2).alias("reference"))
    return resolve.constants(head.unionByName(tail.join(p.select(F.col("name").alias("reference")), "reference", "left_semi").select(*head.columns)))


@query(""", own AS (SELECT file_id, name, min(id) AS id FROM defs GROUP BY ALL),
w(file_id, path) AS (SELECT 1::BIGINT, []::BIGINT[] UNION ALL SELECT f.file_id, list_append(path, f.file_id % 2) FROM w JOIN files f ON f.file_id // 2 = w.file_id WHERE len(path) < 8)
SELECT name, id, len(path)::INT AS hop FROM w JOIN own ON w.file_id = own.file_id QUALIFY row_number() OVER (PARTITION BY name ORDER BY path) = 1""", recursive=True)
def barrel_exports(d: Demo) -> DataFrame:
    own = settled(d.defs().groupBy("file", "file_id", "name").agg(F.min("id").alias("id")))
    root = d.files().filter("file_id = 1").select("file")
    child = d.files().select(F.col("file").alias("to_file"), (F.col("file_id") % 2).alias("position"), F.floor(F.col("file_id") / 2).alias("file_id"))
    arcs = child.join(d.files().filter("file_id > 0"), "file_id").select("file", F.lit("*").alias("name"), "to_file", F.lit("*").alias("source"), F.col("position").cast("int").alias("position"))
    names = own.select("name").distinct().withColumn("file", F.lit(root.first()["file"]))
    return resolve.exported(names, own.select("file", "name", "id"), settled(arcs)).select("name", "id", "hop")


# --- audit ---------------------------------------------------------------------------------------------------------

AUDIT = """, o AS (SELECT DISTINCT from_file AS file, from_line AS line, "to" AS target, kind AS receiver, quantity >= 40 AS external FROM edges WHERE quantity >= 10),
e AS (SELECT DISTINCT from_file AS file, from_line AS line, "to" AS target, tier FROM edges WHERE quantity <= 45),
site AS (SELECT file, line, bool_and(external) AS ext FROM o GROUP BY ALL), hit AS (SELECT DISTINCT file, line, target FROM o WHERE NOT external),
c AS (SELECT e.*, CASE WHEN hit.file IS NOT NULL THEN 'tp' WHEN site.file IS NULL THEN 'fp:no-site' WHEN site.ext THEN 'fp:external' ELSE 'fp:wrong-target' END AS class
 FROM e LEFT JOIN site ON e.file = site.file AND e.line = site.line LEFT JOIN hit ON e.file = hit.file AND e.line = hit.line AND e.target = hit.target)"""


def _oracle(d: Demo) -> tuple[DataFrame, DataFrame]:
    rows = d.edges().select(F.col("from_file").alias("file"), F.col("from_line").alias("line"), F.col("to").alias("target"), F.col("kind").alias("receiver"), "tier", "quantity")
    oracle = rows.filter("quantity >= 10").select("file", "line", "target", "receiver", (F.col("quantity") >= 40).alias("external")).distinct()
    return rows.filter("quantity <= 45").select("file", "line", "target", "tier").distinct(), oracle


@query(AUDIT + """SELECT class, tier, count(*) AS edges FROM c GROUP BY ALL""")
def audit_classes(d: Demo) -> DataFrame:
    edges, oracle = _oracle(d)
    return audit.classify(edges, oracle).groupBy("class", "tier").agg(F.count(F.lit(1)).alias("edges"))


@query(AUDIT + """SELECT coalesce(tier, 'precise') AS tier, count(*) AS edges, count(*) FILTER (class = 'tp') AS tp, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (class = 'tp') / count(*) END AS precision FROM c GROUP BY 1""")
def audit_tiers(d: Demo) -> DataFrame:
    edges, oracle = _oracle(d)
    return audit.by_tier(audit.classify(edges, oracle))


@query(AUDIT + """, f AS (SELECT file, line, target, max((tier IS NULL)::INT) AS p, max((coalesce(tier, '') = 'ext')::INT) AS x FROM e GROUP BY ALL)
SELECT receiver, count(*) AS sites, sum(coalesce(p, 0))::BIGINT AS precise, sum(greatest(coalesce(p, 0), coalesce(x, 0)))::BIGINT AS with_ext, count(f.file) AS all_tiers, count(f.file) / count(*) AS recall
FROM (SELECT * FROM o WHERE NOT external) o LEFT JOIN f ON o.file = f.file AND o.line = f.line AND o.target = f.target GROUP BY receiver""")
def audit_recall(d: Demo) -> DataFrame:
    edges, oracle = _oracle(d)
    return audit.recall(edges, oracle, "receiver")


@query(AUDIT + """SELECT count(*) FILTER (x.file IS NULL) AS silent_correct, count(*) FILTER (x.file IS NOT NULL) AS leaks FROM (SELECT * FROM site WHERE ext) s LEFT JOIN (SELECT DISTINCT file, line FROM e) x ON s.file = x.file AND s.line = x.line""")
def audit_silent(d: Demo) -> DataFrame:
    edges, oracle = _oracle(d)
    return audit.silent(edges, oracle)


@query(""", r AS (SELECT a.n_nationkey AS u, b.n_nationkey AS v FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey >= a.n_nationkey),
x AS (SELECT split_part(from_file, '/', 1) AS f, split_part(to_file, '/', 1) AS t, count(*) AS n FROM edges GROUP BY ALL)
SELECT CASE WHEN r.u IS NULL THEN 'impossible' ELSE 'possible' END AS state, sum(n)::BIGINT AS edges FROM x LEFT JOIN r ON f = 'n' || u AND t = 'n' || v GROUP BY 1""")
def structural_impossible(d: Demo) -> DataFrame:
    n = d.table("nation")
    arcs = n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("b.n_nationkey") > F.col("a.n_nationkey"))).select(F.col("a.n_nationkey").alias("src"), F.col("b.n_nationkey").alias("dst"))
    reach = graph.closure(settled(arcs), n.select(F.col("n_nationkey").alias("node"))).select(F.concat(F.lit("n"), "origin").alias("f"), F.concat(F.lit("n"), "node").alias("t"), F.lit(True).alias("ok"))
    pairs = d.edges().groupBy(text.project(F.col("from_file")).alias("f"), text.project(F.col("to_file")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(reach, ["f", "t"], "left").groupBy(F.when(F.col("ok"), F.lit("possible")).otherwise(F.lit("impossible")).alias("state")).agg(F.sum("n").alias("edges"))


@query(""", m AS (SELECT 'kind.' || kind AS metric, count(*)::DOUBLE AS value FROM edges GROUP BY kind), t(metric, min, max) AS (VALUES ('kind.uses-type', 10.0, 1e12), ('kind.uses-member', 1e12, 1e13), ('kind.calls', 1.0, 2.0))
SELECT t.metric, CASE WHEN value IS NULL THEN 'missing' WHEN value < min THEN 'below min' WHEN value > max THEN 'above max' ELSE 'ok' END AS verdict FROM t LEFT JOIN m ON t.metric = m.metric""")
def assert_thresholds(d: Demo) -> DataFrame:
    metrics = d.edges().groupBy(F.concat(F.lit("kind."), "kind").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    limits = d.spark.sql("SELECT * FROM VALUES ('kind.uses-type', 10.0D, 1e12D), ('kind.uses-member', 1e12D, 1e13D), ('kind.calls', 1.0D, 2.0D) AS t(metric, min, max)")
    return audit.assertions(metrics, limits)


@query("""SELECT e.lang AS "case", count(*) FILTER (why IS NOT NULL) = 0 AS passed, coalesce(string_agg(why, '; ' ORDER BY why), '') AS reasons FROM (
SELECT d.lang, CASE WHEN l.quality = 1 AND d.n_chars < 200 THEN 'missing ' || d.doc_id WHEN l.quality = 0 AND d.n_chars >= 200 THEN 'forbidden ' || d.doc_id END AS why FROM documents d JOIN labels l ON d.doc_id = l.doc_id) e GROUP BY 1""", prelude=False)
def case_verdict(d: Demo) -> DataFrame:
    docs = d.table("documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(d.table("labels"), "doc_id")
    expected = rows.select(F.col("lang").alias("case"), F.col("doc_id").alias("identity"), F.when(F.col("quality") == 1, F.lit("present")).otherwise(F.lit("absent")).alias("state"))
    return audit.verdicts(expected, rows.filter("n_chars >= 200").select(F.col("lang").alias("case"), F.col("doc_id").alias("identity")))


# --- sessions and freshness ----------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT *, coalesce(lag(props) OVER w = props, false) AS same FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
i AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM s), g AS (SELECT user_id, event_type, island, count(*) AS n, max(props) AS props, arg_min(value, (ts, event_id)) AS v FROM i GROUP BY ALL)
SELECT user_id, event_type, sum(n)::BIGINT AS read_count, arg_max(n, island) - 1 AS stub_count, arg_max(props, island) AS content, sum(trunc(v)::BIGINT)::BIGINT AS bytes_delivered FROM g GROUP BY ALL""", prelude=False)
def session_stubs(d: Demo) -> DataFrame:
    e = d.table("events").withColumn("size", F.floor(F.abs("value")).cast("long") * F.signum("value").cast("long"))
    return sessions.read_state(e, ["user_id", "event_type"], "props", ["ts", "event_id"], "size")


@query("""SELECT user_id, count(*) AS reads, count(DISTINCT event_type) AS paths, sum(trunc(value)::BIGINT)::BIGINT AS bytes FROM events GROUP BY 1""", prelude=False)
def session_rollup(d: Demo) -> DataFrame:
    size = F.floor(F.abs("value")).cast("long") * F.signum("value").cast("long")
    return d.table("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("reads"), F.countDistinct("event_type").alias("paths"), F.sum(size).alias("bytes"))


@query("""SELECT user_id, event_type, count(*) - count(DISTINCT props) AS stubs FROM events GROUP BY ALL ORDER BY stubs DESC, user_id, event_type LIMIT 20""", prelude=False)
def top_stubbed(d: Demo) -> DataFrame:
    rows = d.table("events").groupBy("user_id", "event_type").agg((F.count(F.lit(1)) - F.countDistinct("props")).alias("stubs"))
    return rows.orderBy(F.col("stubs").desc(), "user_id", "event_type").limit(20)


@query("""SELECT user_id, props, arg_min(event_type, (ts, event_id)) AS first_event_type, count(*) AS copies FROM events GROUP BY ALL""", prelude=False)
def content_first_seen(d: Demo) -> DataFrame:
    return sessions.first_writer(d.table("events"), ["user_id", "props"], ["ts", "event_id"], "event_type")


@query("""SELECT event_id, CASE WHEN coalesce(lag(props) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = props, false) THEN 'stub' WHEN row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) > 1 THEN 'elsewhere' ELSE 'fresh' END AS decision FROM events""", prelude=False)
def read_decision(d: Demo) -> DataFrame:
    return sessions.decisions(d.table("events"), "user_id", "event_type", "props", ["ts", "event_id"]).select("event_id", "decision")


@query("""SELECT user_id, max(event_id) AS last_event FROM events GROUP BY 1 HAVING NOT max(event_id) < (SELECT max(event_id) FROM events) - 100""", prelude=False)
def prune_complement(d: Demo) -> DataFrame:
    e = d.table("events")
    state = e.groupBy("user_id").agg(F.max("event_id").alias("last_event")).crossJoin(F.broadcast(e.agg((F.max("event_id") - 100).alias("cutoff"))))
    return sessions.pruned(state, F.col("last_event"), F.col("cutoff")).drop("cutoff")


DIFF = """WITH a AS (SELECT user_id || '/' || event_type AS path, max(props) AS digest FROM events WHERE event_type <> 'click' GROUP BY 1), b AS (SELECT user_id || '/' || event_type AS path, max(props) AS digest FROM events WHERE event_type <> 'view' AND value >= 10 GROUP BY 1),
d AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.digest IS DISTINCT FROM b.digest THEN 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path)
"""


def _digests(d: Demo) -> tuple[DataFrame, DataFrame]:
    """Two states of an index: one before clicks were seen, one that holds no views and only events of some value."""
    e = d.table("events").withColumn("path", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    state = lambda rows: rows.groupBy("path").agg(F.max("props").alias("digest"))
    return state(e.filter("event_type <> 'click'")), state(e.filter("event_type <> 'view' and value >= 10"))


@query(DIFF + "SELECT * FROM d WHERE change IS NOT NULL", prelude=False)
def digest_diff(d: Demo) -> DataFrame:
    return sessions.diff(*_digests(d), "path", "digest")


@query(DIFF + "SELECT CASE WHEN (SELECT count(*) FROM a) = 0 THEN 'unknown' WHEN count(*) > 0 THEN 'stale' ELSE 'fresh' END AS verdict, count(*) AS changes FROM d WHERE change IS NOT NULL", prelude=False)
def freshness_verdict(d: Demo) -> DataFrame:
    old, new = _digests(d)
    return sessions.verdict(sessions.diff(old, new, "path", "digest"), old)


@query(DIFF + "SELECT path, digest, 'new' AS origin FROM b UNION ALL SELECT path, digest, 'carried' FROM a WHERE NOT path < '5' AND path NOT IN (SELECT path FROM b)", prelude=False)
def scoped_merge(d: Demo) -> DataFrame:
    return sessions.scoped_merge(*_digests(d), "path", F.col("path") < "5")


@query("""WITH s AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM s) SELECT user_id, run, max(event_type) AS event_type, count(*) AS length FROM r GROUP BY user_id, run""", prelude=False)
def run_lengths(d: Demo) -> DataFrame:
    return sessions.runs(d.table("events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(""", g AS (SELECT e.seq, e.from_file, d.id, greatest(0, d.line - e.from_line, e.from_line - d.end_line) AS gap, d.line FROM edges e JOIN defs d ON e.from_file = d.file)
SELECT seq, from_file, id, gap FROM g QUALIFY row_number() OVER (PARTITION BY seq, from_file ORDER BY gap, line, id) = 1""")
def first_read_offer(d: Demo) -> DataFrame:
    # lines are few and definitions of a file many: the nearest definition is found once for each (file, line)
    asked = d.edges().select("from_file", "from_line").distinct()
    near = asked.join(d.defs().select("id", F.col("file").alias("from_file"), "line", "end_line"), "from_file")
    gap = F.greatest(F.lit(0), F.col("line") - F.col("from_line"), F.col("from_line") - F.col("end_line"))
    best = near.groupBy("from_file", "from_line").agg(F.min(F.struct(gap.alias("gap"), "line", "id")).alias("b"))
    rows = d.edges().select("seq", "from_file", "from_line").distinct().join(best, ["from_file", "from_line"])
    return rows.select("seq", "from_file", F.col("b.id").alias("id"), F.col("b.gap").alias("gap"))


# --- text and export -----------------------------------------------------------------------------------------------


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS target FROM pages""", prelude=False)
def template_reads(d: Demo) -> DataFrame:
    return d.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), 1)).alias("target"))


@query(r"""WITH l AS (SELECT doc_id, regexp_replace(x, '^[\s\x0B\x{FEFF}]+|[\s\x0B\x{FEFF}]+$', '', 'g') AS line, n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
f AS (SELECT doc_id, arg_min(line, n) AS line FROM l WHERE n <= 15 AND line <> '' GROUP BY doc_id), c AS (SELECT doc_id, line, trim(regexp_extract(line, '^(///?|\*|#)(.*)$', 2)) AS said FROM f),
p AS (SELECT doc_id, CASE WHEN said <> '' THEN said ELSE line END AS purpose FROM c)
SELECT doc_id, CASE WHEN length(purpose) > 100 THEN substr(purpose, 1, 97) || '...' ELSE purpose END AS purpose FROM p""", prelude=False)
def purpose_line(d: Demo) -> DataFrame:
    return d.table("documents").select("doc_id", text.purpose(F.col("text")).alias("purpose")).filter("purpose is not null")


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS lines, sha256(text) AS sha, substr(sha256(text), 1, 8) AS short_sha FROM documents""", prelude=False)
def source_digests(d: Demo) -> DataFrame:
    sha = F.sha2("text", 256)
    return d.table("documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), sha.alias("sha"), F.left(sha, F.lit(8)).alias("short_sha"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages""", prelude=False)
def address_parts(d: Demo) -> DataFrame:
    return d.table("pages").select("page_id", F.expr("try_parse_url(url, 'PROTOCOL')").alias("scheme"), F.expr("try_parse_url(url, 'HOST')").alias("host"))


FACTS = """, facts AS (SELECT 'definition' AS family, 0 AS rank, file, line, '{"family":"definition","file":"' || file || '","line":' || line || ',"id":' || id || ',"name":"' || name || '"}' AS json FROM defs
UNION ALL SELECT 'edge', 1, from_file, from_line, '{"family":"edge","file":"' || from_file || '","line":' || from_line || ',"kind":"' || kind || '","to":' || "to" || '}' FROM edges)"""


def _facts(d: Demo) -> DataFrame:
    edges = d.edges().select(F.col("from_file").alias("file"), F.col("from_line").alias("line"), "kind", "to")
    return export.facts([("definition", d.defs().select("file", "line", "id", "name")), ("edge", edges)])


@query(FACTS + "SELECT family, file, line, json FROM facts")
def export_canonical(d: Demo) -> DataFrame:
    return export.ordered(_facts(d)).select("family", "file", "line", "json")


@query(FACTS + ", n(family) AS (VALUES ('definition'), ('edge'), ('test-file')) SELECT n.family, count(facts.family) AS facts FROM n LEFT JOIN facts ON n.family = facts.family GROUP BY 1")
def export_counts(d: Demo) -> DataFrame:
    return export.counts(_facts(d), ["definition", "edge", "test-file"])


@query(FACTS + """, f AS (SELECT file, sha256(string_agg(json, chr(10) ORDER BY rank, line, json) || chr(10)) AS d FROM facts GROUP BY file)
SELECT count(*) AS files, sha256(string_agg(d || ' ' || file, chr(10) ORDER BY file)) AS digest FROM f""")
def export_digest(d: Demo) -> DataFrame:
    return export.digest(_facts(d))


@query("""SELECT p_brand, round(sum(p_retailprice), 4) AS rounded FROM part GROUP BY 1""", prelude=False)
def ordered_sums(d: Demo) -> DataFrame:
    return d.table("part").groupBy("p_brand").agg(F.round(ordered_sum(F.col("p_partkey"), F.col("p_retailprice")), 4).alias("rounded"))


@query("""SELECT name, min(seq) AS seq FROM (SELECT name, id AS seq FROM defs) GROUP BY name""")
def ordered_distinct(d: Demo) -> DataFrame:
    return first_per_key(d.defs().select("name", F.col("id").alias("seq")), ["name"], ["seq"])


@query("""SELECT kind, rank, id, total, greatest(0, total - 20) AS dropped FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY line DESC, id) AS rank, count(*) OVER (PARTITION BY kind) AS total FROM defs) WHERE rank <= 20""")
def top_twenty(d: Demo) -> DataFrame:
    return ranked_table(d.defs(), ["kind"], [F.col("line").desc(), F.col("id")], 20).select("kind", "rank", "id", "total", "dropped")
