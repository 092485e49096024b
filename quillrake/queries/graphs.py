"""Graph queries over edge tables derived from the whole tables.

trade: customer to supplier of its order lines. chain: an order to the customer's next order; ring: and the last to the first.
tree: region to nation to customer to order. deals: trade, and nations to their customers and suppliers. circles: all orders of one
customer with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrake.operators import graph
from quillrake.operators.graph.drift import community_summaries, drift_search, graph_rag_local, regional_drift
from quillrake.operators.graph.entities import update_communities
from quillrake.operators.graph.groups import with_communities
from quillrake.operators.retrieval import knn

from .registry import Register, table
from .vectors import PROBE

R = Register()

SUPPLIER, NATION, CUSTOMER, ORDER = 10_000_000, 100, 1_000, 100_000_000


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("o_custkey").alias("source"), (F.col("l_suppkey") + SUPPLIER).alias("target")).distinct()


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.lead("o_orderkey").over(w).alias("target")).where("target IS NOT NULL")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = lambda a, b: (a.cast("long").alias("source"), b.cast("long").alias("target"))
    n, c, o = (table(spark, sf_dir, x) for x in ("nation", "customer", "orders"))
    parts = n.select(*ends(F.col("n_regionkey"), F.col("n_nationkey") + NATION)), c.select(*ends(F.col("c_nationkey") + NATION, F.col("c_custkey") + CUSTOMER)), o.select(*ends(F.col("o_custkey") + CUSTOMER, F.col("o_orderkey") + ORDER))
    return parts[0].union(parts[1]).union(parts[2])


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    first = F.min(F.struct("o_orderdate", "o_orderkey")).over(Window.partitionBy("o_custkey")).getField("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.coalesce(F.lead("o_orderkey").over(w), first).alias("target"))


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    own = c.select((F.col("c_nationkey") + NATION).cast("long").alias("source"), (F.col("c_custkey") + CUSTOMER).alias("target")).union(s.select((F.col("s_nationkey") + NATION).cast("long"), F.col("s_suppkey") + SUPPLIER))
    return trade(spark, sf_dir).select((F.col("source") + CUSTOMER).alias("source"), "target").union(own)


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    pairs = o.join(o.toDF("o_custkey", "other"), "o_custkey").where("o_orderkey < other")  # a customer has a few dozen orders
    return pairs.select(F.col("o_orderkey").alias("source"), F.col("other").alias("target"))


TRADE = "trade AS MATERIALIZED (SELECT DISTINCT o_custkey AS source, l_suppkey + 10000000 AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
CHAIN = "chain AS MATERIALIZED (SELECT * FROM (SELECT o_orderkey AS source, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target FROM orders) WHERE target IS NOT NULL)"
TREE = "tree AS MATERIALIZED (SELECT n_regionkey::BIGINT AS source, n_nationkey::BIGINT + 100 AS target FROM nation UNION ALL SELECT c_nationkey::BIGINT + 100, c_custkey + 1000 FROM customer UNION ALL SELECT o_custkey + 1000, o_orderkey + 100000000 FROM orders)"
DEALS = f"{TRADE}, deals AS MATERIALIZED (SELECT source + 1000 AS source, target FROM trade UNION ALL SELECT c_nationkey::BIGINT + 100, c_custkey + 1000 FROM customer UNION ALL SELECT s_nationkey::BIGINT + 100, s_suppkey + 10000000 FROM supplier)"
RINGS = "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS {0}, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders"
NODES = "nodes AS MATERIALIZED (SELECT source AS node FROM {0} UNION SELECT target FROM {0})"


@R.add(f"WITH {TRADE} SELECT node, sum(n)::BIGINT AS degree FROM (SELECT source AS node, 1 AS n FROM trade UNION ALL SELECT target, 0 FROM trade) GROUP BY node")
def graph_degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(trade(spark, sf_dir))


def _around(node: int, name: str) -> str:
    return f"{name} AS (SELECT target AS z FROM trade WHERE source = {node} UNION SELECT source FROM trade WHERE target = {node})"


_PAIR = (10_000_001, 10_000_002)
_BOTH = f"{TRADE}, {_around(_PAIR[0], 'na')}, {_around(_PAIR[1], 'nb')}, deg AS (SELECT z, count(*) AS d FROM (SELECT source AS z FROM trade UNION ALL SELECT target FROM trade) GROUP BY z), common AS (SELECT z, d FROM na JOIN nb USING (z) JOIN deg USING (z))"


@R.add(f"WITH {_BOTH} SELECT round((SELECT count(*) FROM common) / (SELECT count(*) FROM (SELECT z FROM na UNION SELECT z FROM nb)), 9) AS score")
def graph_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.jaccard(trade(spark, sf_dir), *_PAIR).select(F.round("score", 9).alias("score"))


@R.add(f"WITH {_BOTH} SELECT round(coalesce(sum(1.0 / ln(d::DOUBLE)), 0.0), 6) AS score FROM common WHERE d > 1")
def graph_adamic_adar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adamic_adar(trade(spark, sf_dir), *_PAIR).select(F.round("score", 6).alias("score"))


@R.add(f"WITH {_BOTH} SELECT round(coalesce(sum(1.0 / d::DOUBLE), 0.0), 6) AS score FROM common")
def graph_resource_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resource_allocation(trade(spark, sf_dir), *_PAIR).select(F.round("score", 6).alias("score"))


@R.add(f"WITH {_BOTH} SELECT ((SELECT d FROM deg WHERE z = {_PAIR[0]}) * (SELECT d FROM deg WHERE z = {_PAIR[1]}))::DOUBLE AS score")
def graph_preferential_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.preferential_attachment(trade(spark, sf_dir), *_PAIR)


_U = f"{DEALS}, u AS MATERIALIZED (SELECT source AS a, target AS b FROM deals UNION SELECT target, source FROM deals), deg AS MATERIALIZED (SELECT a, count(*) AS d FROM u GROUP BY a)"


@R.add(f"""
    WITH {_U}, p AS (SELECT s_suppkey + 10000000 AS a, s_suppkey + 10000001 AS b FROM supplier WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)),
    met AS (SELECT p.a, p.b, count(*) AS common, sum(CASE WHEN d > 1 THEN 1.0 / ln(d) ELSE 0 END) AS aa, sum(1.0 / d) AS ra FROM p JOIN u x ON x.a = p.a JOIN u y ON y.a = p.b AND y.b = x.b JOIN deg ON deg.a = x.b GROUP BY p.a, p.b)
    SELECT p.a, p.b, coalesce(common, 0) AS common, round(coalesce(common / (x.d + y.d - common), 0), 6) AS jaccard, round(coalesce(aa, 0), 6) AS adamic_adar, round(coalesce(ra, 0), 6) AS resource_allocation
    FROM p JOIN deg x ON x.a = p.a JOIN deg y ON y.a = p.b LEFT JOIN met ON met.a = p.a AND met.b = p.b""")
def graph_similarity_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier and the next."""
    ids = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIER).alias("a"))
    pairs = ids.withColumn("b", F.col("a") + 1).join(ids.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
    out = graph.common_neighbor_scores(deals(spark, sf_dir), pairs)
    return out.select("a", "b", "common", *[F.round(c, 6).alias(c) for c in ("jaccard", "adamic_adar", "resource_allocation")])


@R.add(f"WITH {DEALS} SELECT count(*) AS triangles FROM deals x JOIN deals y ON x.target = y.source JOIN deals z ON z.source = x.source AND z.target = y.target WHERE x.source < x.target AND y.source < y.target")
def graph_triangle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangle_count(deals(spark, sf_dir))


@R.add(f"WITH {DEALS}, v AS MATERIALIZED (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM deals) SELECT count(*) AS triangles FROM v x JOIN v y ON x.b = y.a JOIN v z ON z.a = x.a AND z.b = y.b")
def graph_triangle_count_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangle_count(deals(spark, sf_dir), directed=False)


@R.add(f"""
    WITH {_U}, v AS MATERIALIZED (SELECT a, b FROM u WHERE a < b), k AS MATERIALIZED (SELECT x.a, x.b, y.b AS c FROM v x JOIN v y ON x.b = y.a JOIN v z ON z.a = x.a AND z.b = y.b), t AS (SELECT z, count(*) AS n FROM (SELECT a AS z FROM k UNION ALL SELECT b FROM k UNION ALL SELECT c FROM k) GROUP BY z)
    SELECT deg.a AS node, round(CASE WHEN d > 1 THEN 2 * coalesce(n, 0) / (d * (d - 1)) ELSE 0 END, 6) AS coefficient FROM deg LEFT JOIN t ON t.z = deg.a""")
def graph_clustering_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.clustering_coefficient(deals(spark, sf_dir)).select("node", F.round("coefficient", 6).alias("coefficient"))


@R.add(f"WITH {TRADE}, {NODES.format('trade')} SELECT round(2.0 * (SELECT count(*) FROM trade) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 9) AS density")
def graph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.density(trade(spark, sf_dir)).select(F.round("density", 9).alias("density"))


@R.add(f"""
    WITH {TREE}, l AS MATERIALIZED (SELECT n_regionkey::BIGINT AS node, n_regionkey::BIGINT AS c FROM nation UNION SELECT n_nationkey + 100, n_regionkey FROM nation UNION SELECT c_custkey + 1000, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT o_orderkey + 100000000, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    e AS (SELECT a.c AS x, b.c AS y, (source % 3 + 1)::DOUBLE AS w FROM tree JOIN l a ON source = a.node JOIN l b ON target = b.node), ends AS (SELECT x AS c, w FROM e UNION ALL SELECT y, w FROM e)
    SELECT round((SELECT sum(w) FROM e WHERE x = y) / (SELECT sum(w) FROM e) - (SELECT sum(t * t) FROM (SELECT sum(w) AS t FROM ends GROUP BY c)) / (4 * (SELECT sum(w) FROM e) * (SELECT sum(w) FROM e)), 6) AS modularity""")
def graph_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the regions as communities of all below them."""
    n, c, o = (table(spark, sf_dir, x) for x in ("nation", "customer", "orders"))
    region = F.col("n_regionkey").cast("long").alias("community")
    cn = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    parts = n.select(F.col("n_regionkey").cast("long").alias("node"), region).distinct(), n.select((F.col("n_nationkey") + NATION).cast("long"), region), cn.select(F.col("c_custkey") + CUSTOMER, region), o.join(cn, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey") + ORDER, region)
    edges = tree(spark, sf_dir).withColumn("weight", (F.col("source") % 3 + 1).cast("double"))
    return graph.modularity(with_communities(edges, parts[0].union(parts[1]).union(parts[2]).union(parts[3])), weight="weight").select(F.round("modularity", 6).alias("modularity"))


# Walks.
_WALK = "w AS (SELECT {seed}::BIGINT AS node, 0::BIGINT AS hop UNION SELECT e.target, w.hop + 1 FROM w JOIN {edges} e ON e.source = w.node WHERE w.hop < {hops})"


@R.add(f"WITH RECURSIVE {TREE}, {_WALK.format(seed=0, edges='tree', hops=2)} SELECT node, min(hop) AS hop, 0::BIGINT AS seed FROM w GROUP BY node")
def graph_neighbors_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through SQL: a graph function in FROM."""
    from quillrake.session import Engine

    engine = Engine(spark)
    engine.register("tree", tree(spark, sf_dir))
    return engine.sql("SELECT node, hop, seed FROM graph_neighbors('tree', '0', 2, 'auto')")


@R.add(f"WITH RECURSIVE {TREE}, {_WALK.format(seed=1, edges='tree', hops=2)} SELECT DISTINCT node FROM w WHERE node <> 1")
def graph_neighbors_out_of_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(tree(spark, sf_dir), 1, 2, mode="out_of_core")


@R.add(f"""
    WITH RECURSIVE {TREE}, both_ways AS MATERIALIZED (SELECT source, target FROM tree UNION ALL SELECT target, source FROM tree), {_WALK.format(seed=102, edges='both_ways', hops=2)}, near AS (SELECT DISTINCT node FROM w)
    SELECT DISTINCT source, target FROM tree WHERE source IN (FROM near) AND target IN (FROM near)""")
def graph_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subgraph(tree(spark, sf_dir), [102], 2, directed=False)


@R.add(f"""
    WITH RECURSIVE {TREE}, leaf AS (SELECT max(target) AS node FROM tree), p AS (SELECT node, 0 AS back FROM leaf UNION ALL SELECT t.source, p.back + 1 FROM p JOIN tree t ON t.target = p.node)
    SELECT node, (3 - back)::BIGINT AS hop FROM p""")
def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the region down to the last order."""
    e = tree(spark, sf_dir)
    last = table(spark, sf_dir, "orders").orderBy(F.col("o_orderkey").desc()).limit(1)
    way = last.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "o_orderkey").first()
    return graph.shortest_path(e, way[0], way[1] + ORDER)


@R.add(f"WITH {DEALS}, goal AS (SELECT min(s_suppkey) + 10000000 AS s FROM supplier WHERE s_nationkey <> 3 AND s_suppkey + 10000000 IN (SELECT y.target FROM deals x JOIN deals y ON x.target = y.source WHERE x.source = 103)) SELECT '103>' || x.target || '>' || y.target AS path FROM deals x JOIN deals y ON x.target = y.source JOIN goal ON y.target = s WHERE x.source = 103")
def graph_all_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a nation over its customers to the first supplier elsewhere whom they deal with."""
    e, start = deals(spark, sf_dir), NATION + 3
    two = e.alias("x").join(e.alias("y"), F.col("x.target") == F.col("y.source")).where(F.col("x.source") == start).select(F.col("y.target").alias("t"))
    goal = table(spark, sf_dir, "supplier").where("s_nationkey <> 3").join(two, F.col("s_suppkey") + SUPPLIER == F.col("t"), "left_semi").agg(F.min("s_suppkey")).first()[0] + SUPPLIER
    return graph.all_shortest_paths(e, start, goal).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@R.add(f"""
    WITH {TREE} SELECT source, target FROM tree WHERE source = 0 AND target = 100 UNION ALL SELECT source, target FROM tree WHERE source = 100 AND target = (SELECT min(target) FROM tree WHERE source = 100)""")
def graph_connecting_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between a region, its first nation and that nation's first customer."""
    first = table(spark, sf_dir, "customer").where("c_nationkey = 0").agg(F.min("c_custkey")).first()[0]
    return graph.connecting_paths(tree(spark, sf_dir), [0, NATION, first + CUSTOMER])


# Rank: the steps unrolled, each a CTE of its own.
def _pagerank_sql(edges: str, base: str, damping: float, steps: int, prefix: str) -> str:
    parts = [f"deg AS MATERIALIZED (SELECT source, count(*) AS n FROM {edges} GROUP BY source), r0 AS MATERIALIZED (SELECT node, base, base AS score FROM ({base}))"]
    for i in range(steps):
        parts.append(f"""r{i + 1} AS MATERIALIZED (SELECT r.node, r.base, {1 - damping} * r.base + {damping} * (coalesce(m.moved, 0) + (SELECT coalesce(sum(score), 0) FROM r{i} WHERE node NOT IN (SELECT source FROM deg)) * r.base) AS score
            FROM r{i} r LEFT JOIN (SELECT e.target, sum(x.score / deg.n) AS moved FROM {edges} e JOIN r{i} x ON x.node = e.source JOIN deg ON deg.source = e.source GROUP BY e.target) m ON m.target = r.node)""")
    return f"WITH {prefix}, {', '.join(parts)} SELECT node, round(score, 9) AS score FROM r{steps}"


@R.add(_pagerank_sql("edges", "SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS base FROM nodes", 0.85, 10, f"{TREE}, {TRADE}, edges AS MATERIALIZED (SELECT source + 1000 AS source, target FROM trade UNION SELECT target, source + 1000 FROM trade UNION SELECT source, target FROM tree), {NODES.format('edges')}"))
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers both ways, and the tree of regions, nations, customers and orders."""
    t = trade(spark, sf_dir).select((F.col("source") + CUSTOMER).alias("source"), "target")
    edges = graph.edges.both_ways(t).union(tree(spark, sf_dir))
    return graph.pagerank(edges, 0.85, 10).select("node", F.round("score", 9).alias("score"))


@R.add(_pagerank_sql("deals", "SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS base FROM nodes", 0.9, 6, f"{DEALS}, {NODES.format('deals')}"))
def graph_pagerank_out_of_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(deals(spark, sf_dir), 0.9, 6, mode="out_of_core").select("node", F.round("score", 9).alias("score"))


@R.add(_pagerank_sql("edges", "SELECT node, CASE node WHEN 10000001 THEN 0.25 WHEN 10000002 THEN 0.75 ELSE 0 END::DOUBLE AS base FROM nodes", 0.85, 8, f"{TRADE}, edges AS MATERIALIZED (SELECT source, target FROM trade UNION ALL SELECT target, source FROM trade), {NODES.format('trade')}"))
def graph_personalized_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.personalized_pagerank(trade(spark, sf_dir), _PAIR, 0.85, 8, seed_weights=[1.0, 3.0])
    return out.select("node", F.round("score", 9).alias("score"))


# Groups.
@R.add(f"""
    WITH RECURSIVE {CHAIN}, b AS MATERIALIZED (SELECT source, target FROM chain UNION ALL SELECT target, source FROM chain), r AS (SELECT source AS node, source AS root FROM b UNION SELECT b.target, r.root FROM r JOIN b ON b.source = r.node)
    SELECT node, min(root) AS component FROM r GROUP BY node""")
def graph_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that one customer's chain joins."""
    return graph.connected_components(chain(spark, sf_dir))


@R.add(f"WITH {CHAIN}, c AS (SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT node, component FROM c WHERE n > 1")
def graph_connected_components_out_of_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(chain(spark, sf_dir), mode="out_of_core")


@R.add(f"SELECT node, component FROM ({RINGS.format('component')})")
def graph_strongly_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer, on a ring."""
    return graph.strongly_connected_components(ring(spark, sf_dir))


@R.add(f"WITH {TREE}, {NODES.format('tree')} SELECT node, node AS component FROM nodes")
def graph_strongly_connected_components_of_a_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strongly_connected_components(tree(spark, sf_dir))


@R.add(f"WITH RECURSIVE {CHAIN}, l AS (SELECT source AS node, 0::BIGINT AS level FROM chain WHERE source NOT IN (SELECT target FROM chain) UNION ALL SELECT e.target, l.level + 1 FROM l JOIN chain e ON e.source = l.node) SELECT node, max(level) AS level FROM l GROUP BY node")
def graph_topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topological_levels(chain(spark, sf_dir))


def _labels_sql(steps: int) -> str:
    parts = ["l0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS c FROM u)"]
    for i in range(steps):
        parts.append(f"l{i + 1} AS MATERIALIZED (SELECT node, c FROM (SELECT node, c, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, c) AS rn FROM (SELECT node, c FROM l{i} UNION ALL SELECT u.b, l.c FROM u JOIN l{i} l ON l.node = u.a) GROUP BY node, c) WHERE rn = 1)")
    return f"WITH {TREE}, u AS MATERIALIZED (SELECT source AS a, target AS b FROM tree UNION SELECT target, source FROM tree), {', '.join(parts)} SELECT node, c AS community FROM l{steps}"


@R.add(_labels_sql(5))
def graph_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_propagation(tree(spark, sf_dir), 5)


_ALL_HOPS = f"{NODES.format('tree')}, w AS (SELECT node AS s, node AS t, 0 AS hop FROM nodes UNION ALL SELECT w.s, e.target, w.hop + 1 FROM w JOIN tree e ON e.source = w.t), d AS MATERIALIZED (SELECT s, t, hop FROM w)"


@R.add(f"WITH RECURSIVE {TREE}, {_ALL_HOPS} SELECT s AS node, round(CASE WHEN sum(hop) > 0 THEN count(*) FILTER (WHERE hop > 0) / sum(hop) ELSE 0 END, 6) AS closeness FROM d GROUP BY s")
def graph_closeness_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closeness(tree(spark, sf_dir)).select("node", F.round("closeness", 6).alias("closeness"))


@R.add(f"""
    WITH RECURSIVE {TREE}, {_ALL_HOPS}, up AS (SELECT t AS node, count(*) AS n FROM d WHERE hop > 0 GROUP BY t), down AS (SELECT s AS node, count(*) AS n FROM d WHERE hop > 0 GROUP BY s)
    SELECT node, coalesce(up.n * down.n, 0)::DOUBLE AS betweenness FROM nodes LEFT JOIN up USING (node) LEFT JOIN down USING (node)""")
def graph_betweenness_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a tree each pair of a node above and one below has one path."""
    return graph.betweenness(tree(spark, sf_dir)).select("node", F.round("betweenness", 6).alias("betweenness"))


@R.add(f"WITH RECURSIVE {TREE}, {_ALL_HOPS} SELECT count(*) AS pairs, round(avg(hop), 6) AS average FROM d WHERE hop > 0")
def graph_average_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.average_path_length(tree(spark, sf_dir)).select("pairs", F.round("average", 6).alias("average"))


# The ways without a bound on the graph, against the same rows.
@R.add(_labels_sql(3))
def graph_label_propagation_out_of_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_propagation(tree(spark, sf_dir), 3, mode="out_of_core")


@R.add(R.oracle["graph_strongly_connected_components_of_a_tree"])
def graph_strongly_connected_components_out_of_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles are held by tests: a ring takes a round for each of its nodes."""
    return graph.strongly_connected_components(tree(spark, sf_dir), mode="out_of_core")


@R.add(R.oracle["graph_subgraph"])
def graph_subgraph_out_of_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subgraph(tree(spark, sf_dir), [102], 2, directed=False, mode="out_of_core")


@R.add(R.oracle["graph_connecting_paths"])
def graph_connecting_paths_out_of_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").where("c_nationkey = 0").agg(F.min("c_custkey")).first()[0]
    return graph.connecting_paths(tree(spark, sf_dir), [0, NATION, first + CUSTOMER], mode="out_of_core")


@R.add(R.oracle["graph_topological_levels"])
def graph_topological_levels_out_of_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topological_levels(chain(spark, sf_dir), mode="out_of_core")


@R.add(R.oracle["graph_shortest_path"])
def graph_shortest_path_out_of_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").orderBy(F.col("o_orderkey").desc()).limit(1)
    way = last.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "o_orderkey").first()
    return graph.shortest_path(tree(spark, sf_dir), way[0], way[1] + ORDER, mode="out_of_core")


@R.add(R.oracle["graph_personalized_pagerank"])
def graph_personalized_pagerank_out_of_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.personalized_pagerank(trade(spark, sf_dir), _PAIR, 0.85, 8, seed_weights=[1.0, 3.0], mode="out_of_core")
    return out.select("node", F.round("score", 9).alias("score"))


# Greedy methods find complete graphs that are apart whole; on others their invariants are held by tests.
@R.add(f"SELECT node, community FROM ({RINGS.format('community')}) WHERE n > 1")
def graph_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.louvain(circles(spark, sf_dir))


@R.add(f"SELECT node, community FROM ({RINGS.format('community')}) WHERE n > 1")
def graph_leiden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.leiden(circles(spark, sf_dir))


@R.add(f"SELECT node, community FROM ({RINGS.format('community')}) WHERE n > 1")
def graph_update_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that communities had before are kept."""
    before = circles(spark, sf_dir).groupBy(F.col("target").alias("node")).agg(F.min("source").alias("community"))
    return update_communities(circles(spark, sf_dir), before)


@R.add()
def graph_drift_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_search(graph.edges.both_ways(trade(spark, sf_dir)))


@R.add()
def graph_regional_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regional_drift(graph.edges.both_ways(trade(spark, sf_dir)), [SUPPLIER + 1], hops=1)


@R.add()
def graph_community_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community_summaries(circles(spark, sf_dir), [3, 4])


@R.add()
def graph_rag_around_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers around those whose vectors are nearest, through the suppliers they share."""
    e = trade(spark, sf_dir)
    near = knn(table(spark, sf_dir, "embeddings"), "embedding", PROBE, 5, "vec_id").select(F.col("vec_id").alias("c_custkey"))
    return graph_rag_local(table(spark, sf_dir, "customer"), "c_custkey", e, near).select("c_custkey", "c_name", F.round("score", 9).alias("score"))
