"""Queries of the network operators over the driver's tables, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import colors, geometry, scales
from .network import Network, adjacency, duplicate_edges, merge_duplicates
from .operators import blocks, cluster, community, connectivity, degree, flow, fluid, infomap, layers, layout, local, nulls, optimal, paths, resample, robustness, select, sequences, spectral, spinglass, structure, walktrap
from .plans import summary
from .session import cut
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TRADE = """q AS (SELECT sn.n_name AS src, cn.n_name AS dst, l_returnflag AS layer, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey GROUP BY 1, 2, 3),
t AS (SELECT src, dst, sum(weight) AS weight FROM q GROUP BY 1, 2),
v AS (SELECT n_name AS node FROM nation)"""
TOP = TRADE + """,
e AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM t WHERE src <> dst) WHERE r <= 3)"""
FLAT = TOP + """,
u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM e GROUP BY 1, 2),
s AS (SELECT a AS node, b AS other, w FROM u UNION ALL SELECT b, a, w FROM u)"""
LAYERS = TRADE + """,
l AS (SELECT layer, src, dst, weight FROM (SELECT *, avg(weight) OVER (PARTITION BY layer) AS m FROM q) WHERE weight > m)"""
PLACED = TRADE + """,
c AS (SELECT n_name AS node, r_name AS cluster FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT x.cluster AS ci, y.cluster AS cj, src, dst, weight FROM t JOIN c x ON x.node = src JOIN c y ON y.node = dst),
z AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1)"""
SEQ = """seq AS (SELECT user_id AS case_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, event_type AS state FROM events)"""


def query(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, without negative zeros."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def on(graph: Callable[[SparkSession, str], Network], made: Callable[[Network], DataFrame], once: bool = False) -> Query:
    """A query on a network, which is stored first, unless the operator reads it once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        net = graph(spark, sf_dir)
        return rounded(made(net if once else replace(net, nodes=cut(net.nodes), edges=cut(net.edges))))

    return run


def edges_of(net: Network) -> DataFrame:
    return net.edges.select("src", "dst", "weight")


def _seq(made: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(made(tables.event_sequences(spark, sf_dir)))


# --- sequences ---------------------------------------------------------------
query("transition_network", _seq(sequences.transition_network), f"""
WITH {SEQ}, p AS (SELECT state AS src, lead(state) OVER (PARTITION BY case_ ORDER BY t) AS dst FROM seq),
c AS (SELECT src, dst, count(*) AS count FROM p WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2)
SELECT src, dst, count, round(count / sum(count) OVER (PARTITION BY src), 6) AS weight FROM c""")
query("transition_inits", _seq(sequences.initial_states), f"""
WITH {SEQ}, f AS (SELECT case_, arg_min(state, t) AS state FROM seq WHERE state IS NOT NULL GROUP BY 1), c AS (SELECT state, count(*) AS count FROM f GROUP BY 1)
SELECT state, count, round(count / sum(count) OVER (), 6) AS share FROM c""")
#: Windows end before the first in which more than half of all cells (cases times time points) are empty.
_CELLS = """r AS (SELECT unnest(range(0, (max(t) - {size}) // {step} + 1)) AS k FROM seq), w AS (SELECT k AS "window", case_, t, {state} AS state FROM seq, r WHERE t > k * {step} AND t <= k * {step} + {size}),
h AS (SELECT r.k, 1 - count(w.state) / ((SELECT count(DISTINCT case_) FROM seq) * {size}) AS na FROM r LEFT JOIN w ON w."window" = r.k GROUP BY 1),
f AS (SELECT coalesce(min(k), 1000000000) AS first FROM h WHERE na > 0.5)"""
query("transition_windows_sliding", _seq(lambda s: sequences.window_transitions(s, 5, 1, na_threshold=None)), f"""
WITH {SEQ}, r AS (SELECT unnest(range(0, (max(t) - 5) // 1 + 1)) AS k FROM seq), w AS (SELECT k AS "window", case_, t, state FROM seq, r WHERE t > k * 1 AND t <= k * 1 + 5),
p AS (SELECT "window", state AS src, lead(state) OVER (PARTITION BY "window", case_ ORDER BY t) AS dst FROM w),
c AS (SELECT "window", src, dst, count(*) AS count FROM p WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2, 3)
SELECT "window"::INT AS "window", src, dst, count, round(count / sum(count) OVER (PARTITION BY "window", src), 6) AS weight FROM c""")
query("transition_windows_tumbling", _seq(lambda s: sequences.window_transitions(s, 5, 5)), f"""
WITH {SEQ}, {_CELLS.format(size=5, step=5, state="state")},
p AS (SELECT "window", state AS src, lead(state) OVER (PARTITION BY "window", case_ ORDER BY t) AS dst FROM w, f WHERE "window" < first),
c AS (SELECT "window", src, dst, count(*) AS count FROM p WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2, 3)
SELECT "window"::INT AS "window", src, dst, count, round(count / sum(count) OVER (PARTITION BY "window", src), 6) AS weight FROM c""")


def _gaps(seq: DataFrame) -> DataFrame:
    """Purchases from the twelfth step on count as missing."""
    return seq.withColumn("state", F.when(~((F.col("t") >= 12) & F.col("state").isin("purchase", "click", "view")), F.col("state")))


query("window_na_stop", _seq(lambda s: sequences.usable_windows(_gaps(s))), f"""
WITH {SEQ}, {_CELLS.format(size=5, step=1, state="CASE WHEN NOT (t >= 12 AND state IN ('purchase', 'click', 'view')) THEN state END")}
SELECT k::INT AS "window", round(na, 6) AS na_share, k < first AS usable FROM h, f""")
MARKS = "m AS (SELECT DISTINCT user_id AS actor, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS w, event_type AS code FROM events)"
query("cooccurrence", lambda s, d: sequences.cooccurrence(tables.event_marks(s, d).withColumn("window", F.struct("actor", "window"))), f"""
WITH {MARKS} SELECT a.code AS src, b.code AS dst, count(*) AS count FROM m a JOIN m b ON a.actor = b.actor AND a.w = b.w AND a.code <= b.code GROUP BY 1, 2""")
query("transition_onehot", lambda s, d: sequences.code_transitions(tables.event_marks(s, d)), f"""
WITH {MARKS} SELECT a.code AS src, b.code AS dst, count(*) AS count FROM m a JOIN m b ON a.actor = b.actor AND b.w = a.w + 1 GROUP BY 1, 2""")
query("alluvial_flows", _seq(sequences.flows), f"""
WITH {SEQ}, p AS (SELECT t AS step, state AS src, lead(state) OVER (PARTITION BY case_ ORDER BY t) AS dst FROM seq)
SELECT step::INT AS step, src, dst, count(*) AS count FROM p WHERE dst IS NOT NULL GROUP BY 1, 2, 3""")
query("node_positions", _seq(lambda s: sequences.node_positions(s.groupBy(F.col("t").alias("step"), "state").agg(F.count("*").alias("count")), 2.0)), f"""
WITH {SEQ}, c AS (SELECT t AS step, state, count(*) AS count FROM seq GROUP BY 1, 2),
g AS (SELECT step, 0.5 + (sum(count) + 2.0 * (count(*) - 1)) / 2 AS start FROM c GROUP BY 1),
b AS (SELECT c.*, g.start - coalesce(sum(count) OVER w, 0) - 2.0 * count(*) OVER w AS top FROM c JOIN g USING (step) WINDOW w AS (PARTITION BY step ORDER BY state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT step::INT AS step, state, count, (top - count)::DOUBLE AS bottom, top::DOUBLE AS top FROM b""")
query("trajectories", _seq(sequences.trajectories), f"""
WITH {SEQ} SELECT case_ AS "case", arg_min(state, t) AS first, arg_max(state, t) AS last, count(*) AS steps FROM seq GROUP BY 1""")

# --- edges ---------------------------------------------------------------------
query("edge_list", on(tables.trade, edges_of, once=True), f"WITH {TRADE} SELECT * FROM t")
query("adjacency_long", on(tables.trade_flat, adjacency, once=True), f"WITH {FLAT} SELECT node AS src, other AS dst, w AS weight FROM s")
query("duplicate_edges", on(tables.trade_top, lambda n: duplicate_edges(n.edges).select("a", "b", "count"), once=True), f"WITH {TOP} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS count FROM e GROUP BY 1, 2 HAVING count(*) > 1")
for _m, _f in (("sum", "sum(weight)"), ("mean", "avg(weight)"), ("max", "max(weight)"), ("min", "min(weight)"), ("first", "arg_min(weight, src)")):
    query(f"dedupe_edges_{_m}", on(tables.trade_top, lambda n, m=_m: merge_duplicates(n.edges, m, F.col("src")), once=True), f"WITH {TOP} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round({_f}, 6) AS weight FROM e GROUP BY 1, 2")

# --- degrees -------------------------------------------------------------------
for _m, _ends in (("out", "SELECT src AS node, weight FROM t"), ("in", "SELECT dst, weight FROM t"), ("all", "SELECT src AS node, weight FROM t UNION ALL SELECT dst, weight FROM t")):
    _g = f"WITH {TRADE}, x(node, weight) AS ({_ends})"
    query(f"degree_{_m}", on(tables.trade, lambda n, m=_m: degree.degree(n, m), once=True), f"{_g} SELECT node, count(weight) AS degree FROM v LEFT JOIN x USING (node) GROUP BY 1")
    query(f"strength_{_m}", on(tables.trade, lambda n, m=_m: degree.strength(n, m), once=True), f"{_g} SELECT node, coalesce(sum(weight), 0)::DOUBLE AS strength FROM v LEFT JOIN x USING (node) GROUP BY 1")
DEG = FLAT + ", k AS (SELECT v.node, count(s.other) AS k FROM v LEFT JOIN s USING (node) GROUP BY 1)"
query("diffusion", on(tables.trade_flat, degree.diffusion), f"WITH {DEG} SELECT k.node, (k.k + coalesce(sum(o.k), 0))::DOUBLE AS diffusion FROM k LEFT JOIN s ON s.node = k.node LEFT JOIN k o ON o.node = s.other GROUP BY k.node, k.k")
query("leverage", on(tables.trade_flat, degree.leverage), f"WITH {DEG} SELECT k.node, coalesce(round(avg((k.k - o.k) / (k.k + o.k)), 6) + 0.0, 'nan'::DOUBLE) AS leverage FROM k LEFT JOIN s ON s.node = k.node LEFT JOIN k o ON o.node = s.other GROUP BY k.node")
query("laplacian_centrality", on(tables.trade_flat, degree.laplacian), f"WITH {DEG} SELECT k.node, (k.k * k.k + k.k + 2 * coalesce(sum(o.k), 0))::DOUBLE AS laplacian FROM k LEFT JOIN s ON s.node = k.node LEFT JOIN k o ON o.node = s.other GROUP BY k.node, k.k")
query("degree_distribution", on(tables.trade_flat, degree.degree_distribution), f"WITH {DEG}, c AS (SELECT k AS degree, count(*) AS nodes FROM k GROUP BY 1) SELECT degree, nodes, round(sum(nodes) OVER (ORDER BY degree) / sum(nodes) OVER (), 6) AS cumulative FROM c")
query("density", on(tables.trade_top, degree.density, once=True), f"WITH {TOP} SELECT round((SELECT count(*) FROM e) / (n * (n - 1)), 6) AS density FROM (SELECT count(*) AS n FROM v)")
query("reciprocity", on(tables.trade_top, degree.reciprocity, once=True), f"WITH {TOP}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM e GROUP BY 1, 2) SELECT round(sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) / count(*), 6) AS reciprocity FROM p")
query("assortativity", on(tables.trade_flat, degree.assortativity), f"WITH {DEG} SELECT round(corr(x.k::DOUBLE, y.k::DOUBLE), 6) AS assortativity FROM s JOIN k x ON x.node = s.node JOIN k y ON y.node = s.other")
query("centralization_degree", on(tables.trade_flat, degree.centralization_degree), f"WITH {DEG} SELECT round((count(*) * max(k) - sum(k)) / (count(*) * (count(*) - 1)), 6) AS centralization FROM k")

# --- neighbourhoods --------------------------------------------------------------
TRI = DEG + """, tri AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b),
n3 AS (SELECT node, count(*) AS t FROM (SELECT unnest([a, b, c]) AS node FROM tri) GROUP BY 1)"""
query("triangle_count", on(tables.trade_flat, local.triangle_count), f"WITH {TRI} SELECT v.node, coalesce(t, 0)::BIGINT AS triangles FROM v LEFT JOIN n3 USING (node)")
query("transitivity_local", on(tables.trade_flat, local.transitivity_local), f"WITH {TRI} SELECT k.node, CASE WHEN k < 2 THEN 'nan'::DOUBLE ELSE round(2 * coalesce(t, 0) / (k * (k - 1)), 6) END AS transitivity FROM k LEFT JOIN n3 USING (node)")
query("transitivity_global", on(tables.trade_flat, local.transitivity_global), f"WITH {TRI} SELECT round(3 * (SELECT count(*) FROM tri) / (SELECT sum(k * (k - 1) / 2) FROM k), 6) AS transitivity")
query("transitivity_barrat", on(tables.trade_flat, local.transitivity_barrat), f"""
WITH {TRI}, co AS (SELECT a AS i, b AS j, c AS h FROM tri UNION ALL SELECT b, a, c FROM tri UNION ALL SELECT c, a, b FROM tri),
cl AS (SELECT i, sum(x.w + y.w) AS w FROM co JOIN s x ON x.node = i AND x.other = j JOIN s y ON y.node = i AND y.other = h GROUP BY 1),
st AS (SELECT node, sum(w) AS s, count(*) AS k FROM s GROUP BY 1)
SELECT v.node, CASE WHEN coalesce(st.k, 0) < 2 THEN 'nan'::DOUBLE ELSE round(coalesce(cl.w, 0) / (st.s * (st.k - 1)), 6) END AS transitivity FROM v LEFT JOIN st USING (node) LEFT JOIN cl ON cl.i = v.node""")
query("constraint", on(tables.trade_flat, local.constraint), f"""
WITH {FLAT}, p AS (SELECT node AS i, other AS j, w / sum(w) OVER (PARTITION BY node) AS p FROM s),
via AS (SELECT a.i, b.j, sum(a.p * b.p) AS q FROM p a JOIN p b ON a.j = b.i WHERE a.i <> b.j GROUP BY 1, 2)
SELECT v.node, coalesce(round(sum(power(p.p + coalesce(q, 0), 2)), 6), 'nan'::DOUBLE) AS "constraint" FROM v LEFT JOIN p ON p.i = v.node LEFT JOIN via ON via.i = p.i AND via.j = p.j GROUP BY 1""")
query("rich_club", on(tables.trade_flat, local.rich_club), f"""
WITH {DEG}, m AS (SELECT median(k)::DOUBLE AS lim FROM k), r AS (SELECT node FROM k, m WHERE k > lim)
SELECT lim AS "limit", n, m2 AS m, round(2 * m2 / nullif(n * (n - 1), 0), 6) AS phi FROM m, (SELECT count(*) AS n FROM r), (SELECT count(*) AS m2 FROM u WHERE a IN (SELECT node FROM r) AND b IN (SELECT node FROM r))""")
query("clique_size", on(tables.trade_flat, local.clique_size), f"""
WITH RECURSIVE {FLAT}, adj AS (SELECT node, list(other) AS others FROM s GROUP BY 1),
cl(last, members) AS (SELECT node, [node] FROM v UNION ALL SELECT a.node, list_append(cl.members, a.node) FROM cl JOIN adj a ON a.node > cl.last AND list_has_all(a.others, cl.members))
SELECT max(len(members))::BIGINT AS clique_size FROM cl""")

# --- selection -------------------------------------------------------------------
query("filter_edges", on(tables.trade, lambda n: edges_of(select.filter_edges(n, "weight > 900", "src <> dst")), once=True), f"WITH {TRADE} SELECT * FROM t WHERE weight > 900 AND src <> dst")
query("filter_nodes", on(tables.trade_top, lambda n: select.filter_nodes(n, "indegree >= 3").nodes), f"WITH {TOP}, d AS (SELECT dst AS node, count(*) AS i FROM e GROUP BY 1) SELECT node FROM d WHERE i >= 3")
query("select_top_nodes", on(tables.trade_top, lambda n: select.select_nodes(n, top=5, by="instrength").nodes), f"WITH {TOP}, d AS (SELECT node, coalesce(sum(weight), 0) AS i FROM v LEFT JOIN e ON dst = node GROUP BY 1) SELECT node FROM d ORDER BY i DESC, node LIMIT 5")
query("select_top_edges", on(tables.trade, lambda n: edges_of(select.select_edges(n, top=10)), once=True), f"WITH {TRADE} SELECT * FROM t ORDER BY weight DESC, src, dst LIMIT 10")
query("select_involving", on(tables.trade, lambda n: edges_of(select.select_edges(n, involving=["NATION_3", "NATION_7"])), once=True), f"WITH {TRADE} SELECT * FROM t WHERE src IN ('NATION_3', 'NATION_7') OR dst IN ('NATION_3', 'NATION_7')")
query("select_between", on(tables.trade, lambda n: edges_of(select.select_edges(n, between=(["NATION_3", "NATION_5"], ["NATION_7", "NATION_11"]))), once=True), f"WITH {TRADE} SELECT * FROM t WHERE (src IN ('NATION_3', 'NATION_5') AND dst IN ('NATION_7', 'NATION_11')) OR (dst IN ('NATION_3', 'NATION_5') AND src IN ('NATION_7', 'NATION_11'))")
query("select_mutual", on(tables.trade_top, lambda n: edges_of(select.select_edges(n, mutual_only=True))), f"WITH {TOP} SELECT * FROM e WHERE EXISTS (SELECT 1 FROM e x WHERE x.src = e.dst AND x.dst = e.src)")
for _k in (1, 2):
    _n1 = "SELECT 'NATION_3' AS node UNION SELECT other FROM s WHERE node = 'NATION_3'"
    query(f"select_neighbors_{_k}", on(tables.trade_flat, lambda n, k=_k: select.select_nodes(n, neighbors_of=["NATION_3"], order=k).nodes), f"WITH {FLAT}, n1 AS ({_n1}) SELECT node FROM n1" + (" UNION SELECT s.other FROM n1 JOIN s USING (node)" if _k == 2 else ""))
query("select_edges_endpoint_metrics", on(tables.trade_top, lambda n: edges_of(select.select_edges(n, "from_degree > to_degree"))), f"WITH {TOP}, d AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT e.* FROM e JOIN d x ON x.node = src JOIN d y ON y.node = dst WHERE x.k > y.k")

# --- clusters ---------------------------------------------------------------------
_BODY = {"sum": "sum(weight)", "mean": "avg(weight)", "median": "median(weight)", "max": "max(weight)", "min": "min(weight)", "density": "sum(weight) / max(x.n * y.n)", "geomean": "exp(avg(ln(weight)))"}


def _clustered(made: Callable[[Network, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(made(tables.trade(spark, sf_dir), tables.regions(spark, sf_dir)), 5)


for _m, _f in _BODY.items():
    query(f"cluster_between_{_m}", _clustered(lambda n, c, m=_m: cluster.cluster_between(n, c, m)), f"""
WITH {PLACED}, b AS (SELECT ci, cj, {_f} AS value FROM p JOIN z x ON x.cluster = ci JOIN z y ON y.cluster = cj WHERE ci <> cj GROUP BY 1, 2)
SELECT x.cluster AS ci, y.cluster AS cj, round(coalesce(value, 0)::DOUBLE, 5) AS value FROM z x, z y LEFT JOIN b ON b.ci = x.cluster AND b.cj = y.cluster""")
query("cluster_within", _clustered(lambda n, c: cluster.cluster_within(n, c)), f"WITH {PLACED}, b AS (SELECT ci, sum(weight) AS value FROM p WHERE ci = cj AND src <> dst GROUP BY 1) SELECT cluster, round(coalesce(value, 0)::DOUBLE, 5) AS value FROM z LEFT JOIN b ON ci = cluster")
query("cluster_quality", _clustered(cluster.cluster_quality), f"""
WITH {PLACED}, i AS (SELECT ci AS cluster, sum(weight) AS m FROM p WHERE ci = cj GROUP BY 1),
o AS (SELECT cluster, sum(weight) AS c FROM (SELECT ci AS cluster, weight FROM p WHERE ci <> cj UNION ALL SELECT cj, weight FROM p WHERE ci <> cj) GROUP BY 1),
a AS (SELECT z.cluster, n, coalesce(m, 0) AS m, coalesce(c, 0) AS c, (SELECT count(*) FROM c) AS total FROM z LEFT JOIN i USING (cluster) LEFT JOIN o USING (cluster))
SELECT cluster, n AS n_nodes, round(m::DOUBLE, 5) AS internal_edges, round(c::DOUBLE, 5) AS cut_edges, round(m / nullif(n * (n - 1), 0), 5) AS internal_density, round(2 * m / n, 5) AS avg_internal_degree,
round(c / n, 5) AS expansion, round(c / nullif(n * (total - n), 0), 5) AS cut_ratio, round(c / nullif(2 * m + c, 0), 5) AS conductance FROM a""")
query("modularity_directed", _clustered(cluster.modularity), f"""
WITH {PLACED}, o AS (SELECT ci AS cluster, sum(weight) AS o FROM p GROUP BY 1), i AS (SELECT cj AS cluster, sum(weight) AS i FROM p GROUP BY 1), s AS (SELECT ci AS cluster, sum(weight) AS s FROM p WHERE ci = cj GROUP BY 1), g AS (SELECT sum(weight) AS m FROM p)
SELECT round(sum(coalesce(s, 0) / m - coalesce(o, 0) * coalesce(i, 0) / (m * m)), 5) AS modularity FROM z LEFT JOIN o USING (cluster) LEFT JOIN i USING (cluster) LEFT JOIN s USING (cluster), g""")
query("coverage", _clustered(cluster.coverage), f"WITH {PLACED} SELECT round(sum(CASE WHEN ci = cj THEN weight ELSE 0 END) / sum(weight), 5) AS coverage FROM p")


def _partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = tables.table(spark, sf_dir, "customer").join(tables.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    one, two = people.select(F.col("c_custkey").alias("node"), F.col("n_regionkey").alias("cluster")), people.select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("cluster"))
    return rounded(cluster.compare_partitions(one, two))


query("compare_partitions", _partitions, """
WITH m AS (SELECT n_regionkey AS x, c_mktsegment AS y, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), g AS (SELECT sum(n)::DOUBLE AS t FROM m),
j AS (SELECT sum(-(n / t) * ln(n / t)) AS h, sum(n * (n - 1) / 2) AS p FROM m, g),
a AS (SELECT sum(-(n / t) * ln(n / t)) AS h, sum(n * (n - 1) / 2) AS p, sum(top) AS m FROM (SELECT x, sum(n) AS n, max(n) AS top FROM m GROUP BY 1), g),
b AS (SELECT sum(-(n / t) * ln(n / t)) AS h, sum(n * (n - 1) / 2) AS p, sum(top) AS m FROM (SELECT y, sum(n) AS n, max(n) AS top FROM m GROUP BY 1), g)
SELECT round(2 * j.h - a.h - b.h, 6) AS vi, round(2 * (a.h + b.h - j.h) / (a.h + b.h), 6) AS nmi, (2 * t - a.m - b.m)::BIGINT AS split_join,
round((t * (t - 1) / 2 + 2 * j.p - a.p - b.p) / (t * (t - 1) / 2), 6) AS rand, round((j.p - a.p * b.p / (t * (t - 1) / 2)) / ((a.p + b.p) / 2 - a.p * b.p / (t * (t - 1) / 2)), 6) AS adjusted_rand FROM j, a, b, g""")

# --- layers ------------------------------------------------------------------------
def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    both = tables.trade_layers(spark, sf_dir)
    return both.filter("layer = 'A'"), both.filter("layer = 'R'")


TWO = LAYERS + ", xy AS (SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, coalesce(a.weight, 0) AS x, coalesce(b.weight, 0) AS y FROM (SELECT * FROM l WHERE layer = 'A') a FULL JOIN (SELECT * FROM l WHERE layer = 'R') b ON a.src = b.src AND a.dst = b.dst)"
query("layer_similarity", lambda s, d: rounded(layers.layer_similarity(*_two(s, d), 25)), f"""
WITH {TWO}, k AS (SELECT count(*) FILTER (x > 0 AND y > 0) AS b, count(*) FILTER (x > 0 OR y > 0) AS a, count(*) FILTER (x > 0) AS nx, count(*) FILTER (y > 0) AS ny, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM xy)
SELECT round(b / a, 6) AS jaccard, round(b / least(nx, ny), 6) AS overlap, (a - b)::BIGINT AS hamming, round(sxy / sqrt(sxx * syy), 6) AS cosine, round((625 * sxy - sx * sy) / sqrt((625 * sxx - sx * sx) * (625 * syy - sy * sy)), 6) AS pearson FROM k""")
query("layer_similarity_matrix", lambda s, d: rounded(layers.layer_similarity_matrix(tables.trade_layers(s, d), 25)), f"""
WITH {LAYERS}, g AS (SELECT DISTINCT layer FROM l), d AS (SELECT g.layer, a.node AS src, b.node AS dst, coalesce(weight, 0) AS w FROM g CROSS JOIN v a CROSS JOIN v b LEFT JOIN l ON l.layer = g.layer AND l.src = a.node AND l.dst = b.node)
SELECT x.layer AS layer_a, y.layer AS layer_b, round(count(*) FILTER (x.w > 0 AND y.w > 0) / count(*) FILTER (x.w > 0 OR y.w > 0), 6) AS jaccard,
round(count(*) FILTER (x.w > 0 AND y.w > 0) / least(count(*) FILTER (x.w > 0), count(*) FILTER (y.w > 0)), 6) AS overlap,
round(sum(x.w * y.w) / sqrt(sum(x.w * x.w) * sum(y.w * y.w)), 6) AS cosine, round(corr(x.w, y.w), 6) AS pearson FROM d x JOIN d y ON x.src = y.src AND x.dst = y.dst GROUP BY 1, 2""")
query("layer_degree_correlation", lambda s, d: rounded(layers.layer_degree_correlation(tables.trade_layers(s, d), tables.nation_nodes(s, d))), f"""
WITH {LAYERS}, h AS (SELECT layer, src AS node, weight FROM l UNION ALL SELECT layer, dst, weight FROM l),
k AS (SELECT g.layer, v.node, coalesce(sum(weight), 0) AS s FROM (SELECT DISTINCT layer FROM l) g CROSS JOIN v LEFT JOIN h ON h.layer = g.layer AND h.node = v.node GROUP BY 1, 2)
SELECT a.layer AS layer_a, b.layer AS layer_b, round(corr(a.s, b.s), 6) AS correlation FROM k a JOIN k b USING (node) GROUP BY 1, 2""")
for _m, _on in (("diagonal", "SELECT node AS src, node AS dst FROM v"), ("full", "SELECT a.node AS src, b.node AS dst FROM v a, v b")):
    query(f"supra_adjacency_{_m}", lambda s, d, m=_m: rounded(layers.supra_adjacency(tables.trade_layers(s, d), tables.nation_nodes(s, d), 0.5, m)), f"""
WITH {LAYERS}, g AS (SELECT DISTINCT layer FROM l), c AS ({_on})
SELECT layer AS src_layer, src, layer AS dst_layer, dst, weight FROM l UNION ALL SELECT a.layer, src, b.layer, dst, 0.5::DOUBLE FROM g a, g b, c WHERE a.layer <> b.layer""")
for _m, _f in (("sum", "sum(weight)"), ("mean", "sum(weight) / 3"), ("max", "max(weight)"), ("min", "CASE WHEN count(*) < 3 THEN least(min(weight), 0) ELSE min(weight) END"), ("union", "1.0"), ("intersection", "CASE WHEN count(*) = 3 THEN 1.0 ELSE 0 END")):
    query(f"aggregate_layers_{_m}", lambda s, d, m=_m: rounded(layers.aggregate_layers(tables.trade_layers(s, d), m)), f"WITH {LAYERS} SELECT * FROM (SELECT src, dst, round(({_f})::DOUBLE, 6) AS weight FROM l GROUP BY 1, 2) WHERE weight <> 0")
query("network_difference", lambda s, d: rounded(layers.difference(*_two(s, d))), f"WITH {TWO} SELECT src, dst, x, y, x - y AS diff FROM xy")
query("disparity_filter", on(tables.trade, lambda n: layers.disparity(n, 0.3)), f"""
WITH {TRADE}, f AS (SELECT *, sum(weight) OVER (PARTITION BY src) AS so, count(*) OVER (PARTITION BY src) AS ko, sum(weight) OVER (PARTITION BY dst) AS si, count(*) OVER (PARTITION BY dst) AS ki FROM t),
r AS (SELECT src, dst, weight, least(power(1 - weight / so, ko - 1), power(1 - weight / si, ki - 1)) AS p FROM f WHERE src <> dst)
SELECT src, dst, weight, round(p, 6) AS p, p < 0.3 AS significant FROM r""")

# --- scales and layouts -------------------------------------------------------------
for _m, _f in (("linear", "weight / max(weight) OVER ()"), ("log", "ln(1 + weight) / ln(1 + max(weight) OVER ())"), ("sqrt", "sqrt(weight) / sqrt(max(weight) OVER ())"), ("rank", "(rank() OVER (ORDER BY weight) + (count(*) OVER (PARTITION BY weight) - 1) / 2 - 1) / (count(*) OVER () - 1)")):
    query(f"scale_edge_{_m}", on(tables.trade, lambda n, m=_m: scales.scale_edge_widths(n.edges, "weight", m).select("src", "dst", "width")), f"WITH {TRADE} SELECT src, dst, round(0.5 + 3.5 * ({_f}), 6) AS width FROM t")
query("significance_stars", on(tables.trade, lambda n: layers.disparity(n).select("src", "dst", scales.stars(F.col("p") / 20).alias("stars"))), f"""
WITH {TRADE}, f AS (SELECT *, sum(weight) OVER (PARTITION BY src) AS so, count(*) OVER (PARTITION BY src) AS ko, sum(weight) OVER (PARTITION BY dst) AS si, count(*) OVER (PARTITION BY dst) AS ki FROM t),
r AS (SELECT src, dst, least(power(1 - weight / so, ko - 1), power(1 - weight / si, ki - 1)) / 20 AS p FROM f WHERE src <> dst)
SELECT src, dst, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM r""")
#: Clockwise turns the list of angles round: the first node stands at the last of them.
_TURN = "pi() / 2 + 2 * pi() * (n - 1 - i) / n"
ROW = "o AS (SELECT n_name AS node, row_number() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS n FROM nation)"
query("layout_circle", lambda s, d: rounded(layout.layout_circle(tables.nation_nodes(s, d))), f"WITH {ROW} SELECT node, round(0.5 + 0.4 * cos({_TURN}), 6) + 0.0 AS x, round(0.5 + 0.4 * sin({_TURN}), 6) + 0.0 AS y FROM o")
query("layout_oval", lambda s, d: rounded(layout.layout_oval(tables.nation_nodes(s, d))), f"WITH {ROW} SELECT node, round(0.5 + 0.4 * sqrt(1.5) * cos({_TURN}), 6) + 0.0 AS x, round(0.5 + 0.4 / sqrt(1.5) * sin({_TURN}), 6) + 0.0 AS y FROM o")
query("layout_grid", lambda s, d: rounded(layout.layout_grid(tables.nation_nodes(s, d))), f"WITH {ROW}, g AS (SELECT *, ceil(sqrt(n))::BIGINT AS k, ceil(n / ceil(sqrt(n)))::BIGINT AS rows FROM o) SELECT node, round(0.1 + 0.8 * (i % k) / greatest(k - 1, 1), 6) AS x, round(0.9 - 0.8 * (i // k) / greatest(rows - 1, 1), 6) AS y FROM g")
query("layout_groups", lambda s, d: rounded(layout.layout_groups(tables.regions(s, d))), """
WITH g AS (SELECT r_name AS cluster, row_number() OVER (ORDER BY r_name) - 1 AS gi, count(*) OVER () AS gn FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)),
m AS (SELECT n_name AS node, r_name AS cluster, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS i, count(*) OVER (PARTITION BY r_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT node, round(0.5 + 0.35 * cos(pi() / 2 + 2 * pi() * gi / gn) + CASE WHEN n = 1 THEN 0 ELSE 0.15 * cos(pi() / 2 + 2 * pi() * i / n) END, 6) + 0.0 AS x,
round(0.5 + 0.35 * sin(pi() / 2 + 2 * pi() * gi / gn) + CASE WHEN n = 1 THEN 0 ELSE 0.15 * sin(pi() / 2 + 2 * pi() * i / n) END, 6) + 0.0 AS y FROM m JOIN g USING (cluster)""")
query("layout_spring", on(tables.trade_flat, layout.layout_spring))
query("layout_mds", on(tables.trade_flat, layout.layout_mds))
query("layout_kamada_kawai", on(tables.trade_flat, lambda n: layout.layout_kamada_kawai(n, weighted=False)))
query("layout_mds_copurchase", on(tables.co_purchases, lambda n: layout.layout_mds(n, 50)))
query("layout_tree", on(tables.trade_flat, layout.layout_tree))
query("layout_sphere", on(tables.trade_flat, lambda n: layout.layout_sphere(n.nodes)), """
WITH v AS (SELECT n_name AS node, row_number() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS n FROM nation), h AS (SELECT node, i, n, -1 + 2.0 * i / greatest(n - 1, 1) AS z FROM v),
r AS (SELECT *, sqrt(greatest(1 - z * z, 0)) AS r FROM h), a AS (SELECT *, sum(CASE WHEN i > 0 AND i < n - 1 THEN 3.6 / sqrt(n * r * r) ELSE 0 END) OVER (ORDER BY i) AS angle FROM r)
SELECT node, round(r * cos(angle), 6) + 0.0 AS x, round(r * sin(angle), 6) + 0.0 AS y, round(z, 6)::DOUBLE AS z FROM a""")
query("layout_gephi_fr", on(tables.trade_flat, layout.layout_gephi_fr))

# --- components and paths --------------------------------------------------------------
def _heavy(spark: SparkSession, sf_dir: str) -> Network:
    """Each nation's heaviest edge only: several components."""
    return tables.trade_top(spark, sf_dir, 1)


HEAVY = TRADE.replace("v AS (", "v AS (") + """, h AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM t WHERE src <> dst) WHERE r = 1),
hh AS (SELECT src AS a, dst AS b FROM h UNION SELECT dst, src FROM h UNION SELECT node, node FROM v),
reach(a, b) AS (SELECT a, b FROM hh UNION SELECT reach.a, hh.b FROM reach JOIN hh ON hh.a = reach.b),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1)"""
query("components", on(_heavy, structure.components), f"WITH RECURSIVE {HEAVY} SELECT * FROM comp")
query("component_sizes", on(_heavy, structure.component_sizes), f"WITH RECURSIVE {HEAVY} SELECT component, count(*) AS nodes FROM comp GROUP BY 1")
query("select_largest_component", on(_heavy, lambda n: structure.largest_component(n).nodes), f"WITH RECURSIVE {HEAVY} SELECT node FROM comp WHERE component = (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)")
query("components_copurchase", on(tables.co_purchase_rings, structure.component_sizes))

DIST = TOP + """, walk(source, node, d) AS (SELECT node, node, 0 FROM v UNION SELECT source, dst, d + 1 FROM walk JOIN e ON e.src = node WHERE d < 12),
dd AS (SELECT source, node, min(d)::DOUBLE AS dist FROM walk GROUP BY 1, 2), dp AS (SELECT * FROM dd WHERE source <> node)"""
_R = f"WITH RECURSIVE {DIST}"
query("distances_hops", on(tables.trade_top, paths.distances), f"{_R} SELECT * FROM dd")
query("closeness", on(tables.trade_top, lambda n: paths.closeness(n, "out")), f"{_R} SELECT v.node, coalesce(round(1 / sum(dist), 6), 'nan'::DOUBLE) AS closeness FROM v LEFT JOIN dp ON source = v.node GROUP BY 1")
query("harmonic", on(tables.trade_top, lambda n: paths.harmonic(n, "out")), f"{_R} SELECT v.node, round(coalesce(sum(1 / dist), 0), 6) AS harmonic FROM v LEFT JOIN dp ON source = v.node GROUP BY 1")
query("eccentricity", on(tables.trade_top, lambda n: paths.eccentricity(n, "out")), f"{_R} SELECT source AS node, max(dist) AS eccentricity FROM dd GROUP BY 1")
query("kreach_hops", on(tables.trade_top, lambda n: paths.kreach(n, 2, "out")), f"{_R} SELECT v.node, count(dist)::DOUBLE AS kreach FROM v LEFT JOIN dp ON source = v.node AND dist <= 2 GROUP BY 1")
query("path_summary", on(tables.trade_top, paths.path_summary), f"""{_R}, ec AS (SELECT source, max(dist) AS e FROM dd GROUP BY 1)
SELECT (SELECT min(e) FROM ec) AS radius, (SELECT max(e) FROM ec) AS diameter, round((SELECT avg(dist) FROM dp), 6) AS mean_distance, round((SELECT sum(1 / dist) FROM dp) / (n * (n - 1)), 6) AS global_efficiency FROM (SELECT count(*) AS n FROM v)""")
_RELAX = "r0 AS MATERIALIZED (SELECT node AS source, node, 0.0::DOUBLE AS d FROM v)" + "".join(f", r{i} AS MATERIALIZED (SELECT source, node, min(d) AS d FROM (SELECT * FROM r{i - 1} UNION ALL SELECT source, dst, d + 1 / weight FROM r{i - 1} JOIN e ON src = node) GROUP BY 1, 2)" for i in range(1, 25))
query("distances_weighted", on(tables.trade_top, lambda n: paths.distances(n, weighted=True, invert=True)), f"WITH {TOP}, {_RELAX} SELECT source, node, round(d, 6) AS dist FROM r24")

_SIGMA = "s0 AS (SELECT source, node, 1.0::DOUBLE AS g FROM dd WHERE dist = 0)" + "".join(f", s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT y.source, y.node, sum(x.g) FROM dd y JOIN e ON e.dst = y.node JOIN dd z ON z.source = y.source AND z.node = e.src AND z.dist = {i} - 1 JOIN s{i - 1} x ON x.source = y.source AND x.node = e.src WHERE y.dist = {i} GROUP BY 1, 2)" for i in range(1, 11))
query("betweenness", on(tables.trade_top, paths.betweenness), f"""{_R}, {_SIGMA}, b AS (SELECT m.node, sum(sm.g * mt.g / st.g) AS b FROM dp st0 JOIN s10 st ON st.source = st0.source AND st.node = st0.node
JOIN dp m ON m.source = st0.source JOIN s10 sm ON sm.source = m.source AND sm.node = m.node JOIN dp t2 ON t2.source = m.node AND t2.node = st0.node AND m.dist + t2.dist = st0.dist JOIN s10 mt ON mt.source = t2.source AND mt.node = t2.node GROUP BY 1)
SELECT v.node, round(coalesce(b, 0), 6) AS betweenness FROM v LEFT JOIN b USING (node)""")
query("edge_betweenness", on(tables.trade_top, paths.edge_betweenness), f"""{_R}, {_SIGMA}, b AS (SELECT e.src, e.dst, sum(sm.g * mt.g / st.g) AS b FROM dp st0 JOIN s10 st ON st.source = st0.source AND st.node = st0.node
JOIN dd m ON m.source = st0.source JOIN s10 sm ON sm.source = m.source AND sm.node = m.node JOIN e ON e.src = m.node JOIN dd t2 ON t2.source = e.dst AND t2.node = st0.node AND m.dist + 1 + t2.dist = st0.dist JOIN s10 mt ON mt.source = t2.source AND mt.node = t2.node GROUP BY 1, 2)
SELECT src, dst, round(b, 6) AS betweenness FROM b""")
#: The same over the undirected network, whose edges both ways take the place of e.
_F = f"WITH RECURSIVE {DIST.replace(TOP, FLAT).replace('JOIN e ON e.src = node', 'JOIN (SELECT node AS src, other AS dst FROM s) e ON e.src = node')}"
_ARC = "tight AS (SELECT x.source, s.node AS u, s.other AS w, y.dist FROM s JOIN dd x ON x.node = s.node JOIN dd y ON y.source = x.source AND y.node = s.other AND y.dist = x.dist + 1)"
_GAMMA = "g0 AS MATERIALIZED (SELECT source, node, 1.0::DOUBLE AS g FROM dd WHERE dist = 0)" + "".join(f", g{i} AS MATERIALIZED (SELECT * FROM g{i - 1} UNION ALL SELECT t.source, t.w, sum(g) FROM tight t JOIN g{i - 1} x ON x.source = t.source AND x.node = t.u WHERE t.dist = {i} GROUP BY 1, 2)" for i in range(1, 9))
_THROUGH = "b AS (SELECT m.node, sum(sm.g * mt.g / st.g) AS b FROM dp st0 JOIN g8 st ON st.source = st0.source AND st.node = st0.node JOIN dp m ON m.source = st0.source JOIN g8 sm ON sm.source = m.source AND sm.node = m.node JOIN dp t2 ON t2.source = m.node AND t2.node = st0.node AND m.dist + t2.dist = st0.dist JOIN g8 mt ON mt.source = t2.source AND mt.node = t2.node GROUP BY 1)"
_LOADS = "np AS (SELECT source, w, count(*) AS n FROM tight GROUP BY 1, 2), h8 AS MATERIALIZED (SELECT source, node, 0.0::DOUBLE AS h FROM dd WHERE dist >= 8)" + "".join(f", h{i} AS MATERIALIZED (SELECT * FROM h{i + 1} UNION ALL SELECT dd.source, dd.node, coalesce(sum((1 + h.h) / np.n), 0) FROM dd LEFT JOIN tight t ON t.source = dd.source AND t.u = dd.node LEFT JOIN h{i + 1} h ON h.source = t.source AND h.node = t.w LEFT JOIN np ON np.source = t.source AND np.w = t.w WHERE dd.dist = {i} GROUP BY 1, 2)" for i in range(7, -1, -1))
query("load", on(tables.trade_flat, paths.load), f"{_F}, {_ARC}, {_LOADS} SELECT v.node, round(sum(h) + (SELECT count(*) FROM v), 6) AS load FROM v JOIN h0 USING (node) GROUP BY 1")
query("percolation", on(tables.trade_flat, paths.percolation), f"{_F}, {_ARC}, {_GAMMA}, {_THROUGH}, n AS (SELECT count(*) AS n FROM v) SELECT v.node, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 6) AS percolation FROM n, v LEFT JOIN b USING (node)")
query("girth", on(tables.trade_flat, paths.girth), f"""
WITH RECURSIVE {FLAT}, walk(a, b, node, d) AS (SELECT a, b, a, 0 FROM u UNION SELECT walk.a, walk.b, s.other, d + 1 FROM walk JOIN s ON s.node = walk.node AND NOT (least(s.node, s.other) = a AND greatest(s.node, s.other) = b) WHERE d < 12)
SELECT coalesce(min(d) + 1, 'inf'::DOUBLE)::DOUBLE AS girth FROM walk WHERE node = b""")
query("local_efficiency", on(tables.trade_flat, paths.local_efficiency), f"""
WITH RECURSIVE {FLAT}, i AS (SELECT x.node AS z, s.node AS a, s.other AS b FROM s x JOIN s ON s.node = x.other JOIN s y ON y.node = x.node AND y.other = s.other),
walk(z, source, node, d) AS (SELECT node, other, other, 0 FROM s UNION SELECT walk.z, source, i.b, d + 1 FROM walk JOIN i ON i.z = walk.z AND i.a = walk.node WHERE d < 10),
m AS (SELECT z, source, node, min(d) AS d FROM walk GROUP BY 1, 2, 3), near AS (SELECT z, sum(1 / d) AS total FROM m WHERE d > 0 GROUP BY 1), k AS (SELECT node, count(*) AS k FROM s GROUP BY 1)
SELECT v.node, CASE WHEN k > 1 THEN round(coalesce(total, 0) / (k * (k - 1)), 6) ELSE 0 END::DOUBLE AS efficiency FROM v LEFT JOIN k USING (node) LEFT JOIN near ON z = v.node""")
#: The pseudoinverse of the Laplacian: Gauss and Jordan on (L + 1/n | I), a column a step (positive definite, so no pivots).
_PSEUDO = f"""
WITH RECURSIVE {FLAT}, nn AS (SELECT count(*) AS n FROM v), ids AS (SELECT node, row_number() OVER (ORDER BY node) AS i FROM v),
cell AS (SELECT x.i, y.i AS j, 1.0::DOUBLE / n + CASE WHEN x.i = y.i THEN coalesce(d.k, 0) ELSE 0 END - CASE WHEN s.node IS NULL THEN 0 ELSE 1 END AS a
  FROM nn, ids x CROSS JOIN ids y LEFT JOIN (SELECT node, count(*) AS k FROM s GROUP BY 1) d ON d.node = x.node LEFT JOIN s ON s.node = x.node AND s.other = y.node),
line AS (SELECT i, list_concat(list(a::DOUBLE ORDER BY j), list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY j)) AS r FROM cell GROUP BY i),
g(k, m) AS (SELECT 0::BIGINT, list(r ORDER BY i) FROM line UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / m[k + 1][k + 1]) ELSE list_transform(r, lambda x, j: x - r[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END) FROM g, nn WHERE k < n),
p AS (SELECT x.node AS source, y.node, m[x.i][n + y.i] - 1.0 / n AS p FROM g, nn, ids x, ids y WHERE k = n)"""
query("current_flow_closeness", on(tables.trade_flat, flow.current_flow_closeness), f"{_PSEUDO} SELECT node, round((n - 1) / (n * p + (SELECT sum(p) FROM p WHERE source = node)), 6) AS current_flow_closeness FROM p, nn WHERE source = node")
query("current_flow_betweenness", on(tables.trade_flat, flow.current_flow_betweenness), f"""{_PSEUDO},
d AS (SELECT s.node, s.other, x.source, x.p - y.p AS d FROM s JOIN p x ON x.node = s.node JOIN p y ON y.node = s.other AND y.source = x.source WHERE x.source <> s.node),
f AS (SELECT x.node, sum(abs(x.d - y.d)) / 2 AS f FROM d x JOIN d y ON x.node = y.node AND x.other = y.other AND x.source < y.source GROUP BY 1)
SELECT v.node, round(coalesce(2 * f / ((n - 1) * (n - 2)), 0), 6) + 0.0 AS current_flow_betweenness FROM v LEFT JOIN f USING (node), nn""")
query("voterank", on(tables.trade_top, degree.voterank), f"""
WITH RECURSIVE {TOP}, ids AS (SELECT node, row_number() OVER (ORDER BY node) AS pos FROM v), md AS (SELECT 2.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM v) AS mean),
ins AS (SELECT dst AS node, list(src) AS ins FROM e GROUP BY 1), arc AS (SELECT e.src, e.dst, pos, coalesce(ins, []) AS ins FROM e JOIN ids ON ids.node = e.dst LEFT JOIN ins ON ins.node = e.src),
it(i, el, out) AS (SELECT 0, []::VARCHAR[], false UNION ALL SELECT i + 1, list_append(el, coalesce(best, (SELECT min(node) FROM v WHERE NOT list_contains(el, node)))), best IS NULL FROM (SELECT i, el, (
  SELECT arg_max(dst, (votes, -pos)) FROM (SELECT dst, any_value(pos) AS pos, round(sum(greatest(0, 1 - len(list_intersect(ins, el)) / mean)), 9) AS votes FROM arc, md WHERE NOT list_contains(el, dst) AND NOT list_contains(el, src) GROUP BY dst) WHERE votes > 1e-12) AS best FROM it WHERE i < (SELECT count(*) FROM v))),
o AS (SELECT unnest(el) AS node, unnest(range(1, len(el) + 1)) AS rank, len(el) AS m FROM it WHERE i = (SELECT count(*) FROM v))
SELECT node, round((m + 1 - rank) / m, 6) AS voterank FROM o""")

# --- iterations ----------------------------------------------------------------------------
#: Steps of a matrix over all cells (src, dst, g), far beyond what settles to the digits shown.
def _power(cells: str, start: str, steps: int, step: str = "sum(x * g)") -> str:
    return f"g AS MATERIALIZED ({cells}), it(i, node, x) AS (SELECT 0, node, {start} FROM v UNION ALL SELECT i + 1, dst, {step} FROM it JOIN g ON src = node WHERE i < {steps} GROUP BY i + 1, dst)"


_IN = "(SELECT a.node AS src, b.node AS dst, coalesce({w}, 0)::DOUBLE AS w FROM v a CROSS JOIN v b LEFT JOIN {e} ON src = a.node AND dst = b.node)"
_DIRECTED, _LINKED = _IN.format(w="weight", e="e"), _IN.format(w="w", e="(SELECT node AS src, other AS dst, w FROM s) e")


def _rank(jump: str, steps: int = 160) -> str:
    """PageRank with the jumps r of each node; nodes without out-arcs jump."""
    cells = f"SELECT m.src, m.dst, 0.15 * r.r + 0.85 * CASE WHEN t.t > 0 THEN m.w / t.t ELSE r.r END AS g FROM {_DIRECTED} m JOIN (SELECT src, sum(w) AS t FROM {_DIRECTED} GROUP BY 1) t ON t.src = m.src JOIN ({jump}) r ON r.node = m.dst"
    return f"WITH RECURSIVE {TOP}, {_power(cells, '1.0::DOUBLE / 25', steps)} SELECT node, round(x, 6) AS pagerank FROM it WHERE i = {steps}"


query("pagerank", on(tables.trade_top, spectral.pagerank), _rank("SELECT node, 1.0::DOUBLE / 25 AS r FROM v"))
query("pagerank_personalized", on(tables.trade_top, lambda n: spectral.pagerank(n, personalized=n.nodes.filter("node < 'NATION_15'").select("node", F.lit(1.0).alias("weight")))), _rank("SELECT node, CASE WHEN node < 'NATION_15' THEN 1.0::DOUBLE / (SELECT count(*) FROM v WHERE node < 'NATION_15') ELSE 0 END AS r FROM v"))
_HUB = f"SELECT y.src AS src, x.src AS dst, sum(x.w * y.w) / (SELECT max(t) FROM (SELECT sum(x.w * y.w) AS t FROM {_DIRECTED} x JOIN {_DIRECTED} y ON x.dst = y.dst GROUP BY x.src)) AS g FROM {_DIRECTED} x JOIN {_DIRECTED} y ON x.dst = y.dst GROUP BY 1, 2"
query("hits", on(tables.trade_top, spectral.hits), f"""
WITH RECURSIVE {TOP}, {_power(_HUB, "1.0::DOUBLE", 400)}, h AS (SELECT node, x / max(x) OVER () AS x FROM it WHERE i = 400),
a AS (SELECT m.dst AS node, sum(h.x * m.w) AS y FROM h JOIN {_DIRECTED} m ON m.src = h.node GROUP BY 1)
SELECT node, round(x, 6) AS hub, round(y / max(y) OVER (), 6) AS authority FROM h JOIN a USING (node)""")
query("eigenvector", on(tables.trade_flat, spectral.eigenvector), f"""
WITH RECURSIVE {FLAT}, {_power(f"SELECT src, dst, (w / (SELECT max(t) FROM (SELECT sum(w) AS t FROM {_LINKED} GROUP BY src)) + CASE WHEN src = dst THEN 1 ELSE 0 END) / 2 AS g FROM {_LINKED}", "1.0::DOUBLE", 1500)}
SELECT node, round(x / max(x) OVER (), 6) AS eigenvector FROM it WHERE i = 1500""")
query("alpha_centrality", on(tables.trade_top, lambda n: spectral.alpha_centrality(n, 0.05)), f"WITH RECURSIVE {TOP}, {_power(f'SELECT src, dst, 0.05 * (w > 0)::INT AS g FROM {_DIRECTED}', '1.0::DOUBLE', 100, '1 + sum(x * g)')} SELECT node, round(x, 6) AS alpha FROM it WHERE i = 100")
query("power_centrality", on(tables.trade_top, lambda n: spectral.power_centrality(n, 0.05)), f"""
WITH RECURSIVE {TOP}, {_power(f'SELECT dst AS src, src AS dst, (w > 0)::INT AS g FROM {_DIRECTED}', '0.0::DOUBLE', 100, 'sum((1 + 0.05 * x) * g)')}
SELECT node, round(x * sqrt(25 / sum(x * x) OVER ()), 6) AS power FROM it WHERE i = 100""")
#: (I - scale A') x = e by Gauss and Jordan: scale 1 is beyond the spectral radius; the row of the largest entry is not sought, so pivots must not vanish.
def _linear(scale: str, edges: str, right: str) -> str:
    return f"""ids AS (SELECT node, row_number() OVER (ORDER BY node) AS i FROM v), nn AS (SELECT count(*) AS n FROM v), ee AS ({edges}),
cell AS (SELECT x.i, y.i AS j, CASE WHEN x.i = y.i THEN 1.0::DOUBLE ELSE 0.0 END - {scale} * CASE WHEN ee.src IS NULL THEN 0 ELSE 1 END AS a FROM ids x CROSS JOIN ids y LEFT JOIN ee ON ee.src = y.node AND ee.dst = x.node),
line AS (SELECT i, list_append(list(a::DOUBLE ORDER BY j), ({right})::DOUBLE) AS r FROM cell GROUP BY i),
g(k, m) AS (SELECT 0::BIGINT, list(r ORDER BY i) FROM line UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / m[k + 1][k + 1]) ELSE list_transform(r, lambda x, j: x - r[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END) FROM g, nn WHERE k < n),
sol AS (SELECT node, m[ids.i][n + 1] AS x FROM g, nn, ids WHERE k = n)"""


#: The default 1 may be one over an eigenvalue, where there is no solution; the queries, like their SQL, stay this far from it.
_NEAR_ONE = 1.0000000001
query("alpha_centrality_default", lambda s, d: rounded(spectral.alpha_centrality(tables.trade_top(s, d), _NEAR_ONE), 4), f"WITH RECURSIVE {TOP}, {_linear('1.0000000001', 'SELECT DISTINCT src, dst FROM e', '1')} SELECT node, round(x, 4) AS alpha FROM sol")
query("power_centrality_default", lambda s, d: rounded(spectral.power_centrality(tables.trade_top(s, d), _NEAR_ONE), 4), f"""WITH RECURSIVE {TOP}, {_linear('1.0000000001', 'SELECT DISTINCT dst AS src, src AS dst FROM e', '(SELECT count(*) FROM ee JOIN ids o ON o.node = ee.dst WHERE o.i = cell.i)')}
SELECT node, round(x * sqrt(25 / sum(x * x) OVER ()), 4) AS power FROM sol""")
query("subgraph_centrality", on(tables.trade_flat, spectral.subgraph_centrality), f"""
WITH RECURSIVE {FLAT}, walk(k, source, node, c) AS (SELECT 0, node, node, 1.0::DOUBLE FROM v UNION ALL SELECT k + 1, source, s.other, sum(c) / (k + 1) FROM walk JOIN s ON s.node = walk.node WHERE k < 60 GROUP BY k, source, s.other)
SELECT node, round(sum(c), 6) AS subgraph FROM walk WHERE source = node GROUP BY 1""")
query("coreness", on(tables.trade_flat, structure.coreness), f"""
WITH RECURSIVE {FLAT}, it(i, node, c) AS (SELECT 0, node, count(*) FROM s GROUP BY 2
  UNION ALL SELECT i + 1, s.node, list_sum(list_transform(list_reverse_sort(list(c)), lambda x, j: CASE WHEN x >= j THEN 1 ELSE 0 END)) FROM it JOIN s ON s.other = it.node WHERE i < 40 GROUP BY i, s.node)
SELECT v.node, coalesce(c, 0)::BIGINT AS coreness FROM v LEFT JOIN (SELECT * FROM it WHERE i = 40) USING (node)""")
HU = HEAVY.split("reach(a, b)")[0].rstrip().rstrip(",") + ", uu AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM h), once AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM h GROUP BY 1, 2 HAVING count(*) = 1), ua AS (SELECT a, b FROM uu UNION ALL SELECT b, a FROM uu)"
query("bridges_heaviest", on(_heavy, structure.bridges), f"""
WITH RECURSIVE {HU}, go(ra, rb, node) AS (SELECT a, b, a FROM once UNION SELECT ra, rb, ua.b FROM go JOIN ua ON ua.a = go.node AND NOT (least(ua.a, ua.b) = ra AND greatest(ua.a, ua.b) = rb))
SELECT a AS src, b AS dst FROM once WHERE NOT EXISTS (SELECT 1 FROM go WHERE ra = a AND rb = b AND node = b)""")
query("cut_vertices_heaviest", on(_heavy, structure.cut_vertices), f"""
WITH RECURSIVE {HU}, go(r, source, node) AS (SELECT a, b, b FROM ua UNION SELECT r, source, ua.b FROM go JOIN ua ON ua.a = go.node AND ua.b <> r)
SELECT DISTINCT x.a AS node FROM ua x JOIN ua y ON x.a = y.a AND x.b < y.b WHERE NOT EXISTS (SELECT 1 FROM go WHERE r = x.a AND source = x.b AND node = y.b)""")
query("bridges", on(tables.trade_flat, structure.bridges), f"""
WITH RECURSIVE {FLAT}, go(ra, rb, node) AS (SELECT a, b, a FROM u UNION SELECT ra, rb, s.other FROM go JOIN s ON s.node = go.node AND NOT (least(s.node, s.other) = ra AND greatest(s.node, s.other) = rb))
SELECT a AS src, b AS dst FROM u WHERE NOT EXISTS (SELECT 1 FROM go WHERE ra = a AND rb = b AND node = b)""")
query("cut_vertices", on(tables.trade_flat, structure.cut_vertices), f"""
WITH RECURSIVE {FLAT}, go(r, node) AS (SELECT node, min(other) FROM s GROUP BY 1 UNION SELECT r, s.other FROM go JOIN s ON s.node = go.node AND s.other <> r)
SELECT DISTINCT node FROM s WHERE NOT EXISTS (SELECT 1 FROM go WHERE go.r = s.node AND go.node = s.other)""")
#: Two edges are in one block if a cycle holds both: no third node parts them.
query("block_sizes", on(tables.trade_flat, lambda n: blocks.blocks(n).groupBy("block").agg(F.count("*").alias("edges")).groupBy("edges").agg(F.count("*").alias("blocks"))), f"""
WITH RECURSIVE {FLAT}, go(r, f, node) AS (SELECT node, other, other FROM s UNION SELECT r, f, s.other FROM go JOIN s ON s.node = go.node AND s.other <> r),
near AS (SELECT x.a AS xa, x.b AS xb, y.a AS ya, y.b AS yb FROM u x JOIN u y ON x.a IN (y.a, y.b) OR x.b IN (y.a, y.b)),
tie AS (SELECT * FROM near WHERE (xa = ya AND xb = yb) OR EXISTS (SELECT 1 FROM go WHERE r = CASE WHEN xa IN (ya, yb) THEN xa ELSE xb END AND f = CASE WHEN xa IN (ya, yb) THEN xb ELSE xa END AND node = CASE WHEN ya IN (xa, xb) THEN yb ELSE ya END)),
one(a, b, c, d) AS (SELECT xa, xb, ya, yb FROM tie UNION SELECT one.a, one.b, tie.ya, tie.yb FROM one JOIN tie ON tie.xa = one.c AND tie.xb = one.d),
named AS (SELECT a, b, min(c || '/' || d) AS block FROM one GROUP BY 1, 2)
SELECT edges, count(*) AS blocks FROM (SELECT block, count(*) AS edges FROM named GROUP BY 1) GROUP BY 1""")
query("bridges_copurchase", on(tables.co_purchase_rings, structure.bridges))
query("cut_vertices_copurchase", on(tables.co_purchase_rings, structure.cut_vertices))

# --- communities, robustness, resampling -----------------------------------------------------
query("communities_louvain", on(tables.trade_flat, community.louvain))
query("communities_label_propagation", on(tables.trade_flat, community.label_propagation))
query("communities_fast_greedy", on(tables.trade_flat, community.fast_greedy))
query("communities_leiden", on(tables.trade_flat, lambda n: community.leiden(n, objective="modularity")))
query("communities_leiden_cpm", on(tables.trade_flat, lambda n: community.leiden(n, weighted=False, resolution=0.3)))
query("communities_walktrap", on(tables.trade_flat, walktrap.walktrap))
query("walktrap_merges", on(tables.trade_flat, walktrap.merges))
query("communities_infomap", on(tables.trade_flat, infomap.infomap))
query("communities_optimal", on(tables.trade_flat, optimal.optimal))
query("communities_fluid", on(tables.trade_flat, lambda n: fluid.fluid(n, 5)))
query("communities_spinglass", on(tables.trade_flat, lambda n: spinglass.spinglass(n, spins=10, cool_fact=0.8)))
query("communities_leading_eigenvector", on(tables.trade_flat, community.leading_eigenvector))
query("robustness_random", on(tables.trade_flat, lambda n: robustness.random_attack(n)))
query("robustness_random_edges", on(tables.trade_flat, lambda n: robustness.random_attack(n, by="edge")))
_ATTACK = f"""
WITH RECURSIVE {FLAT}, it(step, gone) AS (SELECT 0, []::VARCHAR[] UNION ALL SELECT step + 1, list_append(gone, coalesce(
    (SELECT arg_max(node, (k, -pos)) FROM (SELECT node, count(*) AS k, any_value(i) AS pos FROM s JOIN (SELECT node, row_number() OVER (ORDER BY node) AS i FROM v) USING (node) WHERE NOT list_contains(gone, node) AND NOT list_contains(gone, other) GROUP BY node)),
    (SELECT min(node) FROM v WHERE NOT list_contains(gone, node)))) FROM it WHERE step < (SELECT count(*) FROM v)),
go(step, a, b) AS (SELECT step, node, node FROM it, v WHERE NOT list_contains(gone, node) UNION SELECT go.step, go.a, s.other FROM go JOIN s ON s.node = go.b JOIN it ON it.step = go.step WHERE NOT list_contains(gone, s.other)),
size AS (SELECT it.step, coalesce(max(n), 0)::DOUBLE AS m FROM it LEFT JOIN (SELECT step, a, count(*) AS n FROM go GROUP BY 1, 2) c ON c.step = it.step GROUP BY 1),
curve AS (SELECT step::INT AS step, round(step / (SELECT count(*) FROM v), 6) AS removed_pct, m AS comp_size, round(m / (SELECT m FROM size WHERE step = 0), 6) AS comp_pct FROM size)"""
query("robustness_degree", on(tables.trade_flat, robustness.robustness), f"{_ATTACK} SELECT * FROM curve")
query("robustness_betweenness", on(tables.trade_flat, lambda n: robustness.robustness(n, "betweenness")))
query("robustness_auc", on(tables.trade_flat, lambda n: robustness.summary(robustness.random_attack(n))))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.case_transitions(tables.event_sequences(spark, sf_dir))


query("bootstrap_edges", lambda s, d: rounded(resample.bootstrap_edges(_cases(s, d))))
query("permutation_edges", lambda s, d: rounded(resample.permutation_edges(_cases(s, d), tables.table(s, d, "events").select(F.col("user_id").alias("case"), (F.col("user_id") % 2).alias("grp")).distinct())))
query("centrality_stability", lambda s, d: resample.stability(_cases(s, d)))

# --- several measures together -------------------------------------------------------------
_ENDS = "k AS (SELECT v.node, count(e.src) AS k, coalesce(sum(weight), 0) AS w FROM v LEFT JOIN (SELECT src AS node, * FROM e UNION ALL SELECT dst, * FROM e) e USING (node) GROUP BY 1), near AS (SELECT src AS node, dst AS other FROM e UNION SELECT dst, src FROM e)"
query("centrality", on(tables.trade_top, lambda n: summary.centrality(n, ["indegree", "outdegree", "strength", "diffusion", "leverage"], digits=6)), f"""
WITH {TOP}, {_ENDS}, f AS (SELECT k.node, k.k + sum(o.k) AS diffusion, avg((k.k - o.k) / (k.k + o.k)) AS leverage FROM k JOIN near USING (node) JOIN k o ON o.node = near.other GROUP BY k.node, k.k)
SELECT k.node, (SELECT count(*) FROM e WHERE dst = k.node) AS indegree, (SELECT count(*) FROM e WHERE src = k.node) AS outdegree, round(w, 6)::DOUBLE AS strength, round(diffusion, 6)::DOUBLE AS diffusion, round(leverage, 6) + 0.0 AS leverage FROM k JOIN f USING (node)""")
query("network_summary", on(tables.trade_top, summary.network_summary))
query("partition_summary", lambda s, d: rounded(summary.partition_summary(tables.trade(s, d), tables.regions(s, d)), 5), f"""
WITH {PLACED}, o AS (SELECT ci AS cluster, sum(weight) AS o FROM p GROUP BY 1), i AS (SELECT cj AS cluster, sum(weight) AS i FROM p GROUP BY 1), w AS (SELECT ci AS cluster, sum(weight) AS s FROM p WHERE ci = cj GROUP BY 1), g AS (SELECT sum(weight) AS m FROM p)
SELECT round(sum(coalesce(s, 0) / m - coalesce(o, 0) * coalesce(i, 0) / (m * m)), 5) AS modularity, round(sum(coalesce(s, 0)) / max(m), 5) AS coverage, count(*) AS clusters FROM z LEFT JOIN o USING (cluster) LEFT JOIN i USING (cluster) LEFT JOIN w USING (cluster), g""")
query("layout_star", lambda s, d: rounded(layout.layout_star(tables.nation_nodes(s, d))), f"WITH {ROW} SELECT node, CASE WHEN i = 0 THEN 0.5 ELSE round(0.5 + 0.4 * cos(pi() / 2 + 2 * pi() * (i - 1) / (n - 1)), 6) + 0.0 END AS x, CASE WHEN i = 0 THEN 0.5 ELSE round(0.5 + 0.4 * sin(pi() / 2 + 2 * pi() * (i - 1) / (n - 1)), 6) + 0.0 END AS y FROM o")
query("layout_bipartite", lambda s, d: rounded(layout.layout_bipartite(tables.nation_nodes(s, d))), f"WITH {ROW} SELECT node, CASE WHEN i % 2 = 0 THEN 0.2 ELSE 0.8 END::DOUBLE AS x, round(0.9 - 0.8 * (i // 2) / (CASE WHEN i % 2 = 0 THEN ceil(n / 2) ELSE floor(n / 2) END - 1), 6) AS y FROM o")
query("layout_rescaled", lambda s, d: rounded(layout.rescale(layout.layout_oval(tables.nation_nodes(s, d)))), f"""
WITH {ROW}, c AS (SELECT node, 0.5 + 0.4 * sqrt(1.5) * cos({_TURN}) AS x, 0.5 + 0.4 / sqrt(1.5) * sin({_TURN}) AS y FROM o), r AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM c)
SELECT node, round((x - (a + b) / 2) / greatest(b - a, d - c) * 1.8, 6) + 0.0 AS x, round((y - (c + d) / 2) / greatest(b - a, d - c) * 1.8, 6) + 0.0 AS y FROM c, r""")

# --- cuts and random networks ----------------------------------------------------------
#: Every node here has three edges at least, and one has three (FLAT keeps three a nation), so sets of two and the least degree decide.
query("min_cut", on(tables.trade_flat, connectivity.min_cut), f"""
WITH RECURSIVE {FLAT}, cuts AS (SELECT x.a AS a1, x.b AS b1, y.a AS a2, y.b AS b2 FROM u x JOIN u y ON (x.a, x.b) <= (y.a, y.b) UNION ALL SELECT '', '', '', ''),
go(a1, b1, a2, b2, node) AS (SELECT *, (SELECT min(node) FROM v) FROM cuts UNION SELECT a1, b1, a2, b2, s.other FROM go JOIN s ON s.node = go.node AND NOT (least(s.node, s.other) = a1 AND greatest(s.node, s.other) = b1) AND NOT (least(s.node, s.other) = a2 AND greatest(s.node, s.other) = b2)),
bad AS (SELECT CASE WHEN a1 = '' THEN 0 WHEN a1 = a2 AND b1 = b2 THEN 1 ELSE 2 END AS size FROM go GROUP BY a1, b1, a2, b2 HAVING count(*) < (SELECT count(*) FROM v))
SELECT least((SELECT min(k) FROM (SELECT count(*) AS k FROM s GROUP BY node)), coalesce((SELECT min(size) FROM bad), 1000))::BIGINT AS min_cut""")
query("vertex_connectivity", on(tables.trade_flat, connectivity.vertex_connectivity), f"""
WITH RECURSIVE {FLAT}, cuts AS (SELECT x.node AS x, y.node AS y FROM v x JOIN v y ON x.node <= y.node UNION ALL SELECT '', ''),
go(x, y, node) AS (SELECT x, y, (SELECT min(node) FROM v WHERE node NOT IN (x, y)) FROM cuts UNION SELECT x, y, s.other FROM go JOIN s ON s.node = go.node AND s.other NOT IN (x, y)),
bad AS (SELECT CASE WHEN x = '' THEN 0 WHEN x = y THEN 1 ELSE 2 END AS size FROM go GROUP BY x, y HAVING count(*) < (SELECT count(*) FROM v) - CASE WHEN x = '' THEN 0 WHEN x = y THEN 1 ELSE 2 END)
SELECT least((SELECT min(k) FROM (SELECT count(*) AS k FROM s GROUP BY node)), coalesce((SELECT min(size) FROM bad), 1000))::BIGINT AS vertex_connectivity""")
query("small_world", on(tables.trade_flat, nulls.small_world))
query("rich_club_normalized", on(tables.trade_flat, nulls.rich_club_ratio))

# --- edges and layers side by side -------------------------------------------------------
query("edge_centrality", on(tables.trade_top, lambda n: summary.edge_centrality(n, weighted=False)), ORACLE_SQL["edge_betweenness"].replace("SELECT src, dst, round(b, 6) AS betweenness FROM b", "SELECT src, dst, 1.0::DOUBLE AS weight, round(b, 6) AS betweenness FROM b"))
query("layer_differences", lambda s, d: rounded(layers.differences(tables.trade_layers(s, d))), f"""
WITH {LAYERS}, p AS (SELECT DISTINCT a.layer AS layer_a, b.layer AS layer_b FROM l a JOIN l b ON a.layer < b.layer), c AS (SELECT DISTINCT layer_a, layer_b, src, dst FROM p JOIN l ON layer IN (layer_a, layer_b))
SELECT layer_a, layer_b, c.src, c.dst, coalesce(a.weight, 0)::DOUBLE AS x, coalesce(b.weight, 0)::DOUBLE AS y, (coalesce(a.weight, 0) - coalesce(b.weight, 0))::DOUBLE AS diff
FROM c LEFT JOIN l a ON a.layer = layer_a AND a.src = c.src AND a.dst = c.dst LEFT JOIN l b ON b.layer = layer_b AND b.src = c.src AND b.dst = c.dst""")
query("mixed_network", lambda s, d: layers.mixed(adjacency(tables.trade_flat(s, d)), adjacency(tables.trade_top(s, d))), f"""
WITH {FLAT} SELECT a AS src, b AS dst, w AS weight, 'undirected' AS kind, false AS mutual FROM u
UNION ALL SELECT src, dst, weight, 'directed', EXISTS (SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src) FROM e""")
query("edge_curvatures", lambda s, d: scales.curvatures(edges_of(tables.trade_top(s, d))), f"""
WITH {TOP} SELECT src, dst, weight, CASE WHEN EXISTS (SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src) THEN 0.2 ELSE 0 END::DOUBLE AS curve FROM e""")

# --- colours, sizes and points ---------------------------------------------------------------
_STRENGTH = "k AS (SELECT node, sum(weight) AS strength FROM (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY 1)"
query("node_sizes", on(tables.trade_top, lambda n: summary.node_sizes(n, "strength")), f"""
WITH {TOP}, {_STRENGTH}, a AS (SELECT v.node, coalesce(strength, 0)::DOUBLE AS value FROM v LEFT JOIN k USING (node)) SELECT node, value, round(2 + 6 * (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS size FROM a""")
_MIX = "printf('%02X', floor(({a}) + (({b}) - ({a})) * (s - step))::INT)"
_RAMP = "'#' || " + " || ".join(_MIX.format(a=f"CASE step WHEN 0 THEN {x} ELSE {y} END", b=f"CASE step WHEN 0 THEN {y} ELSE {z} END") for x, y, z in ((255, 230, 0), (255, 159, 0), (255, 0, 0)))
query("node_colors", lambda s, d: colors.scale_color(degree.strength(tables.trade_top(s, d)).select("node", F.col("strength").cast("double").alias("strength")), "strength", ["#FFFFFF", "#E69F00", "#000000"]), f"""
WITH {TOP}, {_STRENGTH}, a AS (SELECT v.node, coalesce(strength, 0)::DOUBLE AS strength FROM v LEFT JOIN k USING (node)), b AS (SELECT *, (strength - min(strength) OVER ()) / (max(strength) OVER () - min(strength) OVER ()) * 2 AS s FROM a), c AS (SELECT *, least(floor(s), 1)::INT AS step FROM b)
SELECT node, strength, {_RAMP} AS color FROM c""")
_WONG = "[" + ", ".join(f"'{c}'" for c in colors.COLORBLIND) + "]"
_GROUPED = f"g AS (SELECT n_name AS node, r_name AS cluster FROM nation JOIN region ON n_regionkey = r_regionkey), i AS (SELECT cluster, ({_WONG})[row_number() OVER (ORDER BY cluster)] AS color FROM (SELECT DISTINCT cluster FROM g)), c AS (SELECT node, cluster, color FROM g JOIN i USING (cluster))"
query("group_colors", lambda s, d: colors.color_levels(tables.regions(s, d), "cluster"), f"WITH {_GROUPED} SELECT * FROM c")
_HEX = ", ".join(f"('0x' || substr(color, {at}, 2))::INT AS {name}" for at, name in ((2, "r"), (4, "g"), (6, "b")))
query("color_arithmetic", lambda s, d: colors.color_levels(tables.regions(s, d), "cluster").select("node", colors.with_alpha(F.col("color"), 0.5).alias("faint"), colors.brighten(F.col("color"), 0.25).alias("light"), colors.brighten(F.col("color"), -0.5).alias("dark"), colors.text_on(F.col("color")).alias("label")), f"""
WITH {_GROUPED}, h AS (SELECT *, {_HEX} FROM c)
SELECT node, color || '80' AS faint, '#' || printf('%02X', floor(r + (255 - r) * 0.25::DOUBLE)::INT) || printf('%02X', floor(g + (255 - g) * 0.25::DOUBLE)::INT) || printf('%02X', floor(b + (255 - b) * 0.25::DOUBLE)::INT) AS light,
'#' || printf('%02X', floor(r / 2)::INT) || printf('%02X', floor(g / 2)::INT) || printf('%02X', floor(b / 2)::INT) AS dark, CASE WHEN (0.299 * r + 0.587 * g + 0.114 * b) / 255 > 0.5 THEN 'black' ELSE 'white' END AS label FROM h""")


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with where they leave, bend and arrive, nodes of 0.05 on a circle."""
    at = layout.layout_circle(tables.nation_nodes(spark, sf_dir))
    ends = edges_of(tables.trade_top(spark, sf_dir)).join(at.toDF("src", "x1", "y1"), "src").join(at.toDF("dst", "x2", "y2"), "dst")
    a, b = (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2"))
    points = {"from": geometry.border(a, b, 0.05), "mid": geometry.control(a, b, 0.2, shape=0.5), "to": geometry.toward(b, a, 0.05)}
    return ends.select("src", "dst", geometry.distance(a, b).alias("length"), geometry.angle(a, b).alias("angle"), *[p[i].alias(f"{name}_{c}") for name, p in points.items() for i, c in enumerate("xy")])


query("edge_geometry", lambda s, d: rounded(_drawn(s, d), 5), f"""
WITH {TOP}, {ROW}, pt AS (SELECT node, 0.5 + 0.4 * cos({_TURN}) AS x, 0.5 + 0.4 * sin({_TURN}) AS y FROM o),
p AS (SELECT src, dst, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS len FROM e JOIN pt a ON a.node = src JOIN pt b ON b.node = dst)
SELECT src, dst, round(len, 5) + 0.0 AS length, round(atan2(y2 - y1, x2 - x1), 5) + 0.0 AS angle, round(x1 + 0.05 * (x2 - x1) / len, 5) + 0.0 AS from_x, round(y1 + 0.05 * (y2 - y1) / len, 5) + 0.0 AS from_y,
round((x1 + x2) / 2 - 0.15 * (y2 - y1), 5) + 0.0 AS mid_x, round((y1 + y2) / 2 + 0.15 * (x2 - x1), 5) + 0.0 AS mid_y, round(x2 + 0.05 * (x1 - x2) / len, 5) + 0.0 AS to_x, round(y2 + 0.05 * (y1 - y2) / len, 5) + 0.0 AS to_y FROM p""")
query("community_colors", on(tables.trade_flat, summary.community_colors))
