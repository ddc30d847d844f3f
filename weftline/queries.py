"""The catalogue: every graph and ordering operator as a query over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.hashing import MODULUS, pseudo_sql
from weftline.operators import generators as gen
from weftline.operators import graph as g
from weftline.operators import isomorphism as iso
from weftline.operators import ordering as order
from weftline.operators import pagerank as pr
from weftline.operators import paths
from weftline.operators import point_to_point as p2p
from weftline.plans.stages import Stages
from weftline.plans.workloads import EVENT_HOPS, ORDER_HOPS, event_hops, order_hops
from weftline.sources import text

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _source(edges: DataFrame) -> int:
    return edges.agg(F.min("src")).first()[0]


def _hops(body: str, base: str = ORDER_HOPS, recursive: bool = False, more: str = "") -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{base}{more} {body}"


def _marks(spark: SparkSession, edges: DataFrame, k: int = 4) -> DataFrame:
    return Stages(spark).write(p2p.landmarks(edges, k))


#: The 4 vertices of greatest out-degree.
_MARKS = ", m AS (SELECT src AS landmark FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 4)"
_VERTICES = ", vs AS (SELECT src AS v FROM e UNION SELECT dst FROM e)"


# sources and sinks


def _as_text(spark: SparkSession, lines: DataFrame) -> str:
    path = f"{Stages(spark).folder}/text"
    lines.write.text(path)
    return path


@_query(_hops("SELECT src, dst, w FROM e"))
def src_edge_list(spark, sf_dir):
    """The graph written as an edge list with comments, self loops and bad lines, and read again."""
    edges = order_hops(spark, sf_dir)
    lines = edges.select(F.concat_ws(" ", "src", "dst", "w").alias("value"))
    noise = spark.createDataFrame([("# comment",), ("% comment",), ("7 7 3",), ("a bad line of six tokens",)], "value string")
    return text.read_edge_list(spark, _as_text(spark, lines.unionByName(noise))).edges


@_query(_hops(f"SELECT src, dst, (src + dst + {pseudo_sql('src * 31 + dst', 5)} % 100) % 3 + 1 AS w FROM e"))
def synth_weight(spark, sf_dir):
    lines = order_hops(spark, sf_dir).select(F.concat_ws("\t", "src", "dst").alias("value"))
    return text.read_edge_list(spark, _as_text(spark, lines)).edges


@_query(_hops("SELECT src, dst, CAST(1 AS BIGINT) AS w FROM e"))
def src_unweighted(spark, sf_dir):
    lines = order_hops(spark, sf_dir).select(F.concat_ws(" ", "src", "dst").alias("value"))
    return text.read_unweighted(spark, _as_text(spark, lines))


_PAIRS = f""", ids AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM vs), q AS (
  SELECT k AS qid, a.v AS src, b.v AS dst FROM (SELECT unnest(range(100)) AS k) JOIN ids a ON a.i = {pseudo_sql("k")} % a.n
    JOIN ids b ON b.i = {pseudo_sql("k", 1)} % b.n
)"""


def _pairs(spark, edges, n=100):
    return Stages(spark).write(gen.random_pairs(g.vertices(edges), n))


@_query(_hops("SELECT qid, src, dst FROM q", more=_VERTICES + _PAIRS))
def src_query_pairs(spark, sf_dir):
    pairs = _pairs(spark, order_hops(spark, sf_dir))
    path = _as_text(spark, pairs.orderBy("qid").coalesce(1).select(F.concat_ws(" ", "src", "dst").alias("value")))
    return text.read_query_pairs(spark, path)


def _from_one(edges: DataFrame) -> DataFrame:
    """Ids of adjacency files begin with 1."""
    return edges.withColumns({"src": F.col("src") + 1, "dst": F.col("dst") + 1})


@_query(_hops("SELECT src + 1 AS src, dst + 1 AS dst, w FROM e"))
def src_adjacency(spark, sf_dir):
    """The graph as an adjacency file, written and read again."""
    edges = _from_one(order_hops(spark, sf_dir))
    n = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    path = f"{Stages(spark).folder}/text"
    text.write_adjacency(edges, n, _source(edges), path)
    return text.read_adjacency(spark, path).edges


_LINES = """SELECT x AS v, CASE WHEN n IS NULL THEN '0' ELSE CAST(n AS VARCHAR) || ' ' || body END AS line
FROM (SELECT unnest(range(1, (SELECT max(greatest(src, dst)) FROM e) + 2)) AS x)
LEFT JOIN (SELECT src + 1 AS a, count(*) AS n, string_agg(dst || ' ' || w, ' ' ORDER BY dst) AS body FROM e GROUP BY src) ON a = x"""


@_query(_hops(_LINES))
def sink_adjacency(spark, sf_dir):
    edges = _from_one(order_hops(spark, sf_dir))
    return text.adjacency_lines(edges, edges.agg(F.max(F.greatest("src", "dst"))).first()[0])


@_query(_hops("SELECT src AS v, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS line FROM e GROUP BY src"))
def adjacency_list(spark, sf_dir):
    return g.adjacency_text(order_hops(spark, sf_dir), weighted=False)


@_query(_hops("SELECT src AS v, string_agg('(' || dst || ',' || w || ')', ' ' ORDER BY dst) AS line FROM e GROUP BY src"))
def adjacency_list_weighted(spark, sf_dir):
    return g.adjacency_text(order_hops(spark, sf_dir), weighted=True)


@_query(
    f"""SELECT row_number() OVER (ORDER BY v) - 1 AS pos, CAST(v AS VARCHAR) AS line
FROM (SELECT CAST({pseudo_sql("i")} % 100 + 1 AS INTEGER) AS v FROM (SELECT unnest(range(1000)) AS i))"""
)
def sink_array(spark, sf_dir):
    """A sorted array written as lines and read again in their order."""
    path = f"{Stages(spark).folder}/text"
    text.write_array(gen.array(spark, 1000), "value", path)
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return order.rank(lines, F.col("at"), name="pos", start=0).select("pos", "line")


# generators


def _undirected_sql(v: int, seed: int = 0) -> str:
    need = 5 * v - 1 - (v - 1)
    w = f"{pseudo_sql('(a * 31 + b * 17)', seed + 2)} % 20 + 1"
    return f"""WITH c AS (
  SELECT i, {pseudo_sql("i", seed)} % {v} + 1 AS x, {pseudo_sql(f"(i + {MODULUS // 3})", seed + 1)} % {v} + 1 AS y
  FROM (SELECT unnest(range({2 * need + 16})) AS i)
), d AS (
  SELECT least(x, y) AS a, greatest(x, y) AS b, min(i) AS i FROM c WHERE greatest(x, y) - least(x, y) > 1 GROUP BY ALL
), h AS (
  SELECT a, b FROM (SELECT *, row_number() OVER (ORDER BY i) AS k FROM d) WHERE k <= {need}
  UNION ALL SELECT i, i + 1 FROM (SELECT unnest(range(1, {v})) AS i)
), w AS (SELECT a, b, {w} AS w FROM h)
SELECT a AS src, b AS dst, w FROM w UNION ALL SELECT b, a, w FROM w"""


@_query(_undirected_sql(2000))
def gen_undirected(spark, sf_dir):
    return gen.undirected(spark, 2000)


def _directed_sql(v: int, seed: int = 0) -> str:
    need = 5 * v - 1
    return f"""WITH c AS (
  SELECT i, {pseudo_sql("i", seed)} % {v} + 1 AS a, {pseudo_sql(f"(i + {MODULUS // 3})", seed + 1)} % {v} + 1 AS b
  FROM (SELECT unnest(range({2 * need + 16})) AS i)
), d AS (SELECT a, b, min(i) AS i FROM c WHERE a <> b GROUP BY ALL),
h AS (SELECT a, b FROM (SELECT *, row_number() OVER (ORDER BY i) AS k FROM d) WHERE k <= {need})
SELECT a AS src, b AS dst, {pseudo_sql("(a * 31 + b * 17)", seed + 2)} % 20 + 1 AS w FROM h"""


@_query(_directed_sql(2000))
def gen_directed(spark, sf_dir):
    return gen.directed(spark, 2000)


_K = "SELECT i AS src, j AS dst FROM (SELECT unnest(range(1, {n} + 1)) AS i), (SELECT unnest(range(1, {n} + 1)) AS j) WHERE i <> j"


@_query(f"SELECT 1 AS g, src, dst FROM ({_K.format(n=40)}) UNION ALL SELECT 2, src, dst FROM ({_K.format(n=39)})")
def gen_complete_pair(spark, sf_dir):
    return gen.complete_pair(spark, 40)


@_query(
    f"SELECT 1 AS g, src, dst FROM ({_K.format(n=40)}) WHERE src = 1 OR dst = 1 OR (src % 2 = 0 AND dst % 2 = 0) "
    f"UNION ALL SELECT 2, src, dst FROM ({_K.format(n=40)})"
)
def gen_skew_pair(spark, sf_dir):
    return gen.skew_pair(spark, 40)


@_query(f"SELECT i AS pos, CAST({pseudo_sql('i')} % 100 + 1 AS INTEGER) AS value FROM (SELECT unnest(range(100000)) AS i)")
def gen_array(spark, sf_dir):
    return gen.array(spark, 100_000)


@_query(_hops("SELECT qid, src, dst FROM q", more=_VERTICES + _PAIRS))
def gen_pairs(spark, sf_dir):
    return _pairs(spark, order_hops(spark, sf_dir))


@_query(_hops("SELECT qid, src, dst FROM q", EVENT_HOPS, more=_VERTICES + _PAIRS))
def pairs_random(spark, sf_dir):
    return _pairs(spark, event_hops(spark, sf_dir))


def _pool_sql(spec: str, place: str, name: str) -> str:
    kind, pool = spec.split()
    own = "src" if kind == "out" else "dst"
    low = "sum(CASE WHEN degree = 0 THEN 1 ELSE 0 END) OVER ()"
    where = {
        "low": ("r - z", "r >= z AND r < z + greatest(1, n // 20)"),
        "high": ("n - 1 - r", "r >= n - greatest(1, n // 25)"),
        "median": ("r - (n // 2 - n // 40)", "r >= n // 2 - n // 40 AND r < n // 2 - n // 40 + greatest(1, n // 15)"),
    }[pool]
    return f"""{name} AS (SELECT {where[0]} AS {place}, v, count(*) OVER () AS size FROM (
  SELECT v, row_number() OVER (ORDER BY degree, v) - 1 AS r, count(*) OVER () AS n, {low} AS z FROM (
    SELECT v, count({own}) AS degree FROM vs LEFT JOIN e ON {own} = v GROUP BY v)) WHERE {where[1]})"""


def _add_pairs_by_degree(choice: int) -> None:
    a, b = p2p.CHOICES[choice]
    sql = _hops(
        f"""SELECT k AS qid, a.v AS src, b.v AS dst FROM (SELECT unnest(range(100)) AS k)
JOIN a ON a.i = {pseudo_sql("k")} % a.size JOIN b ON b.j = {pseudo_sql("k", 1)} % b.size""",
        more=f"{_VERTICES}, {_pool_sql(a, 'i', 'a')}, {_pool_sql(b, 'j', 'b')}",
    )

    def run(spark, sf_dir):
        return p2p.pairs_by_degree(order_hops(spark, sf_dir), choice)

    run.__name__ = f"pairs_by_degree_{choice}"
    _query(sql)(run)


for _choice in p2p.CHOICES:
    _add_pairs_by_degree(_choice)


@_query(_hops("SELECT qid, src, dst FROM q UNION ALL SELECT qid + 100, src, dst FROM q", more=_VERTICES + _PAIRS))
def pairs_by_degree_12(spark, sf_dir):
    """Pairs of a file before random ones."""
    return p2p.file_and_random(src_query_pairs(spark, sf_dir), gen_pairs(spark, sf_dir))


# primitives


@_query(_hops("SELECT e.* FROM e JOIN m ON src = landmark", more=_MARKS))
def expand_one_hop(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return g.expand(p2p.landmarks(edges, 4).select(F.col("landmark").alias("v")), edges)


@_query(_hops("SELECT e.* FROM e JOIN m ON dst = landmark", more=_MARKS))
def expand_one_hop_reverse(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return g.expand_reverse(p2p.landmarks(edges, 4).select(F.col("landmark").alias("v")), edges)


@_query(
    _hops(
        "SELECT v, min(d) AS d FROM (SELECT landmark AS v, 0 AS d FROM m UNION ALL SELECT dst, w FROM e JOIN m ON src = landmark) GROUP BY v",
        more=_MARKS,
    )
)
def relax_once(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return g.relax(p2p.landmarks(edges, 4).select(F.col("landmark").alias("v"), F.lit(0).cast("long").alias("d")), edges)


@_query(_hops("SELECT v, CAST(count(src) AS BIGINT) AS degree FROM vs LEFT JOIN e ON src = v GROUP BY v", more=_VERTICES))
def out_degree(spark, sf_dir):
    return g.out_degree(order_hops(spark, sf_dir))


@_query(_hops("SELECT v, CAST(count(dst) AS BIGINT) AS degree FROM vs LEFT JOIN e ON dst = v GROUP BY v", more=_VERTICES))
def in_degree(spark, sf_dir):
    return g.in_degree(order_hops(spark, sf_dir))


def _groups_sql(own: str) -> str:
    return _hops(
        f"""SELECT degree, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY v) AS vertices FROM (
SELECT v, CAST(count({own}) AS BIGINT) AS degree FROM vs LEFT JOIN e ON {own} = v GROUP BY v) GROUP BY degree""",
        more=_VERTICES,
    )


def _spelled(groups: DataFrame) -> DataFrame:
    return groups.withColumn("vertices", F.concat_ws(" ", F.transform("vertices", lambda v: v.cast("string"))))


@_query(_groups_sql("src"))
def degree_groups_out(spark, sf_dir):
    return _spelled(g.degree_groups(g.out_degree(order_hops(spark, sf_dir))))


@_query(_groups_sql("dst"))
def degree_groups_in(spark, sf_dir):
    return _spelled(g.degree_groups(g.in_degree(order_hops(spark, sf_dir))))


@_query(_hops("SELECT src AS v, CAST(count(*) AS BIGINT) AS degree FROM e GROUP BY src ORDER BY degree DESC, v LIMIT 10"))
def top_out_degree(spark, sf_dir):
    return g.top_degree(g.out_degree(order_hops(spark, sf_dir)), 10)


@_query(
    _hops(
        "SELECT v, degree, row_number() OVER (ORDER BY degree, v) - 1 AS rank FROM (SELECT v, CAST(count(src) AS BIGINT) AS degree FROM vs LEFT JOIN e ON src = v GROUP BY v)",
        more=_VERTICES,
    )
)
def degree_rank(spark, sf_dir):
    return p2p.degree_rank(g.out_degree(order_hops(spark, sf_dir)))


@_query(_hops("SELECT DISTINCT src, dst, 1 + (7 * src + 13 * dst) % 20 AS w FROM (SELECT src, dst FROM e UNION ALL SELECT src, dst FROM e)"))
def dedup_edges(spark, sf_dir):
    """Every edge twice, the second time heavier."""
    edges = order_hops(spark, sf_dir)
    return g.dedup_edges(edges.unionByName(edges.withColumn("w", F.col("w") + 5)))


@_query(_hops("SELECT src, dst, min(w) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY src, dst"))
def symmetrize(spark, sf_dir):
    return g.symmetrize(order_hops(spark, sf_dir))


@_query(
    "SELECT CAST(o_custkey AS BIGINT) AS src, CAST(lead(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS dst, "
    "CAST(1 AS BIGINT) AS w FROM orders QUALIFY dst IS NOT NULL AND src <> dst"
)
def drop_self_loops(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("src", F.col("o_custkey"))
    pairs = order.lead(orders, "src", F.col("o_orderdate"), F.col("o_orderkey"), name="dst").where("dst is not null")
    return g.drop_self_loops(g.edges_of(pairs, w=None))


@_query(_hops("SELECT v FROM vs", more=_VERTICES))
def vertices(spark, sf_dir):
    return g.vertices(order_hops(spark, sf_dir))


# shortest paths


def _search_sql(seeds: str, edges: str = "e", name: str = "r") -> str:
    """Least distances r(q, v, d) from seeds (q, v, d) along edges (src, dst, w)."""
    return f""", {name}(q, v, d) USING KEY (q, v) AS (
  {seeds}
  UNION
  SELECT r.q, e.dst, min(r.d + e.w) FROM {name} r JOIN {edges} e ON e.src = r.v LEFT JOIN recurring.{name} o ON o.q = r.q AND o.v = e.dst
  WHERE o.d IS NULL OR r.d + e.w < o.d GROUP BY r.q, e.dst
)"""


_SOURCE = "SELECT CAST(0 AS BIGINT) AS q, min(src) AS v, CAST(0 AS BIGINT) AS d FROM e"
_BACK = ", b AS (SELECT dst AS src, src AS dst, w FROM e)"
_UNDIRECTED = ", u AS (SELECT src, dst, min(w) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY src, dst)"
_ONES = ", o1 AS (SELECT src, dst, CAST(1 AS BIGINT) AS w FROM e)"
_ALL = "SELECT vs.v, r.d FROM vs LEFT JOIN r ON r.v = vs.v"


@_query(_hops(_ALL, recursive=True, more=_VERTICES + _search_sql(_SOURCE)))
def sssp_directed(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return paths.sssp(edges, _source(edges))


@_query(_hops(_ALL, recursive=True, more=_VERTICES + _UNDIRECTED + _search_sql(_SOURCE, "u")))
def sssp_undirected(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return paths.sssp(g.symmetrize(edges), _source(edges))


@_query(_hops(_ALL, recursive=True, more=_VERTICES + _BACK + _search_sql(_SOURCE, "b")))
def sssp_to_vertex(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return paths.sssp_to(edges, _source(edges))


@_query(_hops(_ALL, recursive=True, more=_VERTICES + _ONES + _search_sql(_SOURCE, "o1")))
def bfs_hops(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return paths.bfs_hops(edges, _source(edges))


_PRED = "LEFT JOIN (SELECT b.v, min(a.v) AS pred FROM r a JOIN e ON e.src = a.v JOIN r b ON b.v = e.dst AND a.d + e.w = b.d GROUP BY b.v) p ON p.v = r.v"


@_query(_hops(f"SELECT r.v, r.d, p.pred FROM r {_PRED}", recursive=True, more=_search_sql(_SOURCE)))
def sssp_tree(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return paths.tree(edges, _source(edges))


@_query(_hops("SELECT vs.v FROM vs JOIN r ON r.v = vs.v", EVENT_HOPS, recursive=True, more=_VERTICES + _search_sql(_SOURCE)))
def reachable(spark, sf_dir):
    edges = event_hops(spark, sf_dir)
    return paths.reachable(edges, _source(edges))


#: Edges towards greater ids, from the middle of these.
_UPWARD = ", up AS (SELECT * FROM e WHERE src < dst), vu AS (SELECT src AS v FROM up UNION SELECT dst FROM up)"
_MIDDLE = "SELECT CAST(0 AS BIGINT) AS q, (min(src) + max(src)) // 2 AS v, CAST(0 AS BIGINT) AS d FROM up"


@_query(_hops("SELECT vu.v FROM vu LEFT JOIN r ON r.v = vu.v WHERE r.v IS NULL", EVENT_HOPS, recursive=True, more=_UPWARD + _search_sql(_MIDDLE, "up")))
def unreachable(spark, sf_dir):
    """Along edges to greater ids alone, what is below the middle can't be reached from it."""
    edges = event_hops(spark, sf_dir).where("src < dst")
    low, high = edges.agg(F.min("src"), F.max("src")).first()
    return paths.unreachable(edges, (low + high) // 2)


@_query(_hops("SELECT (SELECT min(src) FROM e) AS source, max(d) AS eccentricity FROM r", recursive=True, more=_search_sql(_SOURCE)))
def eccentricity(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return paths.eccentricity(edges, _source(edges))


_ROUNDS = f""", r(v, d, k) USING KEY (v) AS (
  SELECT min(src), CAST(0 AS BIGINT), 0 FROM e
  UNION
  SELECT e.dst, min(r.d + e.w), max(r.k) + 1 FROM r JOIN e ON e.src = r.v LEFT JOIN recurring.r o ON o.v = e.dst
  WHERE o.d IS NULL OR r.d + e.w < o.d GROUP BY e.dst
)"""


@_query(_hops("SELECT k AS round, CAST(count(*) AS BIGINT) AS settled FROM r GROUP BY k", recursive=True, more=_ROUNDS))
def sssp_rounds(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return paths.rounds(edges, _source(edges))


@_query(_hops("SELECT v, d FROM r WHERE d > 0 ORDER BY d, v LIMIT 1", recursive=True, more=_search_sql(_SOURCE)))
def closest_vertex(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return g.closest(paths.sssp(edges, _source(edges)), F.col("d") > 0)


@_query(_hops("SELECT vs.v || ' ' || coalesce(r.d, 10000000) AS line FROM vs LEFT JOIN r ON r.v = vs.v", recursive=True, more=_VERTICES + _search_sql(_SOURCE)))
def sink_distances(spark, sf_dir):
    return text.distance_lines(sssp_directed(spark, sf_dir)).select("line")


# point to point

_FROM_PAIRS = _VERTICES + _PAIRS + _search_sql("SELECT qid, src, CAST(0 AS BIGINT) FROM q")
_DISTANCES = "SELECT q.qid, q.src, q.dst, r.d AS distance FROM q LEFT JOIN r ON r.q = q.qid AND r.v = q.dst"


@_query(_hops(_DISTANCES, recursive=True, more=_FROM_PAIRS))
def p2p_distance(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return p2p.distance(edges, _pairs(spark, edges))


_TO_PAIRS = _BACK + _search_sql("SELECT qid, dst, CAST(0 AS BIGINT) FROM q", "b", "t")


@_query(
    _hops(
        """SELECT q.qid, q.src, q.dst, min(r.d + t.d) AS distance, arg_min(r.v, (r.d + t.d, r.v)) AS joining_vertex
FROM q LEFT JOIN (r JOIN t ON r.q = t.q AND r.v = t.v) ON r.q = q.qid GROUP BY ALL""",
        recursive=True,
        more=_FROM_PAIRS + _TO_PAIRS,
    )
)
def p2p_bidirectional(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return p2p.bidirectional(edges, _pairs(spark, edges))


_PATHS = """, pred AS MATERIALIZED (
  SELECT b.q, b.v, min(a.v) AS p FROM r a JOIN e ON e.src = a.v JOIN r b ON b.q = a.q AND b.v = e.dst AND a.d + e.w = b.d GROUP BY b.q, b.v
), walk AS (
  SELECT q.qid, q.src, q.dst, q.dst AS v, CAST(q.dst AS VARCHAR) AS path, r.d FROM q JOIN r ON r.q = q.qid AND r.v = q.dst
  UNION ALL
  SELECT walk.qid, walk.src, walk.dst, pred.p, pred.p || ';' || walk.path, walk.d FROM walk JOIN pred ON pred.q = walk.qid AND pred.v = walk.v WHERE walk.v <> walk.src
)"""


@_query(
    _hops(
        """SELECT q.qid, q.src || '->' || q.dst || ', ' || coalesce(walk.d, 10000000) || ', ' || coalesce(path || ';', '') AS line
FROM q LEFT JOIN walk ON walk.qid = q.qid AND walk.v = walk.src""",
        recursive=True,
        more=_FROM_PAIRS + _PATHS,
    )
)
def p2p_path(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return text.path_lines(p2p.paths(edges, _pairs(spark, edges)))


@_query(_hops("SELECT landmark FROM m", more=_MARKS))
def landmarks(spark, sf_dir):
    return p2p.landmarks(order_hops(spark, sf_dir), 4)


_OUT = _search_sql("SELECT landmark, landmark, CAST(0 AS BIGINT) FROM m", "e", "lo")
_IN = _BACK + _search_sql("SELECT landmark, landmark, CAST(0 AS BIGINT) FROM m", "b", "li")


@_query(_hops("SELECT q AS landmark, v, d AS dist FROM lo", recursive=True, more=_MARKS + _OUT))
def landmark_out(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return p2p.landmark_out(edges, _marks(spark, edges))


@_query(_hops("SELECT q AS landmark, v, d AS dist FROM li", recursive=True, more=_MARKS + _IN))
def landmark_in(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return p2p.landmark_in(edges, _marks(spark, edges))


_BOUND = """, ub AS (SELECT q.qid, min(li.d + lo.d) AS bound, arg_min(li.q, (li.d + lo.d, li.q)) AS landmark
  FROM q JOIN li ON li.v = q.src JOIN lo ON lo.v = q.dst AND lo.q = li.q GROUP BY q.qid)"""


@_query(
    _hops(
        "SELECT q.qid, q.src, q.dst, ub.bound, ub.landmark FROM q LEFT JOIN ub USING (qid)",
        recursive=True,
        more=_MARKS + _VERTICES + _PAIRS + _OUT + _IN + _BOUND,
    )
)
def landmark_upper_bound(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    marks = _marks(spark, edges)
    return p2p.upper_bound(_pairs(spark, edges), p2p.landmark_in(edges, marks), p2p.landmark_out(edges, marks))


@_query(
    _hops(
        "SELECT q.qid, q.src, q.dst, r.d AS distance, ub.bound FROM q LEFT JOIN ub USING (qid) LEFT JOIN r ON r.q = q.qid AND r.v = q.dst",
        recursive=True,
        more=_MARKS + _FROM_PAIRS + _OUT + _IN + _BOUND,
    )
)
def p2p_with_bounds(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return p2p.with_bounds(edges, _pairs(spark, edges), 4)


_STRATEGIES = ", ".join(f"('{s}')" for s in p2p.STRATEGIES)


@_query(
    _hops(
        f"SELECT q.qid, q.src, q.dst, s.strategy, r.d AS distance FROM q LEFT JOIN r ON r.q = q.qid AND r.v = q.dst, (VALUES {_STRATEGIES}) s(strategy)",
        recursive=True,
        more=_FROM_PAIRS,
    )
)
def p2p_batch(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return p2p.batch(edges, _pairs(spark, edges), 4)


@_query(
    _hops(
        """SELECT q.qid, coalesce(any_value(o.d), -1) = coalesce(min(r.d + t.d), -1) AS agree
FROM q LEFT JOIN r o ON o.q = q.qid AND o.v = q.dst LEFT JOIN (r JOIN t ON r.q = t.q AND r.v = t.v) ON r.q = q.qid GROUP BY q.qid""",
        recursive=True,
        more=_FROM_PAIRS + _TO_PAIRS,
    )
)
def p2p_strategies_agree(spark, sf_dir):
    return p2p.strategies_agree(p2p_batch(spark, sf_dir))


@_query(
    _hops(
        f"""SELECT qid, src, dst, distance FROM (SELECT *, coalesce(sum((distance IS NOT NULL)::INT) OVER w, 0) AS y,
coalesce(sum((distance IS NULL)::INT) OVER w, 0) AS n FROM ({_DISTANCES})
WINDOW w AS (ORDER BY qid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE y < 50 AND n < 30""",
        recursive=True,
        more=_FROM_PAIRS,
    )
)
def p2p_batch_limited(spark, sf_dir):
    """As a driver that stops after 50 answers: the limit is the feature."""
    return p2p.limited(p2p_distance(spark, sf_dir), 50)


@_query()
def p2p_rounds(spark, sf_dir):
    """Counters of the search; what pruning leaves depends on rounds, so a test in plain Python takes the place of SQL."""
    edges = order_hops(spark, sf_dir)
    return p2p.search_rounds(edges, _pairs(spark, edges))


# PageRank


def _pagerank_sql(stop: str, result: str) -> str:
    return _hops(
        f"{result}",
        recursive=True,
        more=_VERTICES
        + f""", l AS MATERIALIZED (SELECT e.src, e.dst, 1.0::DOUBLE / o.n AS share FROM e JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) o USING (src)),
r(k, v, pr, delta) AS (
  SELECT 0, v, 1.0::DOUBLE, 1e9::DOUBLE FROM vs
  UNION ALL
  SELECT k, v, pr, max(abs(pr - was)) OVER () FROM (
    SELECT max(r.k) OVER () + 1 AS k, r.v, 0.15 + 0.85 * coalesce(s.s, 0) AS pr, r.pr AS was, r.delta
    FROM r LEFT JOIN (SELECT l.dst, sum(r.pr * l.share) AS s FROM r JOIN l ON l.src = r.v GROUP BY l.dst) s ON s.dst = r.v
  ) WHERE {stop}
)""",
    )


_ROUNDED = "SELECT v, round(pr, 6) AS pr FROM r WHERE k = "


@_query(_pagerank_sql("k <= 1", _ROUNDED + "1"))
def pagerank_step(spark, sf_dir):
    edges = order_hops(spark, sf_dir)
    return pr.pagerank_step(pr.initial(edges), edges).select("v", F.round("pr", 6).alias("pr"))


@_query(_pagerank_sql("k <= 10", _ROUNDED + "10"))
def pagerank_fixed(spark, sf_dir):
    run = pr.pagerank(order_hops(spark, sf_dir), eps=None, steps=10)
    return run.ranks.select("v", F.round("pr", 6).alias("pr"))


@_query(_pagerank_sql("delta > 0.001", _ROUNDED + "(SELECT max(k) - 1 FROM r)"))
def pagerank(spark, sf_dir):
    return pr.pagerank(order_hops(spark, sf_dir)).ranks.select("v", F.round("pr", 6).alias("pr"))


@_query(_pagerank_sql("delta > 0.001", "SELECT k AS step, round(max(delta), 6) AS delta FROM r WHERE k > 0 GROUP BY k"))
def pagerank_trace(spark, sf_dir):
    return pr.pagerank(order_hops(spark, sf_dir)).trace.select("step", F.round("delta", 6).alias("delta"))


# isomorphism

#: Literal graph pairs (fixed values): the neighbours of vertices 1, 2, ... of both graphs.
LITERALS = {
    "six": (
        [[4, 5], [4, 6], [5, 6], [1, 2], [1, 3], [2, 3]],
        [[3, 5], [4, 6], [1, 5], [2, 6], [1, 3], [2, 4]],
    ),
    "eight": (
        [[5, 6, 7], [5, 6, 8], [5, 7, 8], [6, 7, 8], [1, 2, 3], [1, 2, 4], [1, 3, 4], [2, 3, 4]],
        [[2, 4, 5], [1, 3, 6], [2, 4, 7], [1, 3, 8], [1, 6, 8], [2, 5, 7], [3, 6, 8], [4, 5, 7]],
    ),
    "three": (
        [[2], [1, 3], [2]],
        [[2, 3], [1], [1]],
    ),
}


def literal_pairs(spark: SparkSession) -> DataFrame:
    """(pair, g, src, dst)."""
    rows = [(name, g, v, u) for name, both in LITERALS.items() for g, graph in enumerate(both, 1) for v, near in enumerate(graph, 1) for u in near]
    return spark.createDataFrame(rows, "pair string, g int, src long, dst long")


def _all_pairs(spark: SparkSession) -> DataFrame:
    made = gen.complete_pair(spark, 12).withColumn("pair", F.lit("complete")), gen.skew_pair(spark, 12).withColumn("pair", F.lit("skew"))
    out = literal_pairs(spark)
    for rows in made:
        out = out.unionByName(rows.select("pair", "g", "src", "dst"))
    return out


#: The literal edges as (pair, g, src, dst).
_LITERAL_EDGES = "SELECT * FROM (VALUES {}) t(pair, g, src, dst)".format(
    ", ".join(f"('{name}', {g}, {v}, {u})" for name, both in LITERALS.items() for g, graph in enumerate(both, 1) for v, near in enumerate(graph, 1) for u in near)
)
_MADE_EDGES = f"""{_LITERAL_EDGES}
UNION ALL SELECT 'complete', 1, src, dst FROM ({_K.format(n=12)}) UNION ALL SELECT 'complete', 2, src, dst FROM ({_K.format(n=11)})
UNION ALL SELECT 'skew', 1, src, dst FROM ({_K.format(n=12)}) WHERE src = 1 OR dst = 1 OR (src % 2 = 0 AND dst % 2 = 0)
UNION ALL SELECT 'skew', 2, src, dst FROM ({_K.format(n=12)})"""


def _isomorphic_sql(edges: str) -> str:
    """Mappings of vertices 1, 2, ... grow by a vertex, all of whose edges and non-edges to those before have to agree."""
    return f"""WITH RECURSIVE e AS ({edges}), s AS (
  SELECT pair, max(n) FILTER (g = 1) AS n1, max(n) FILTER (g = 2) AS n2, max(m) FILTER (g = 1) AS m1, max(m) FILTER (g = 2) AS m2
  FROM (SELECT pair, g, count(DISTINCT src) AS n, list(src * 100 + dst) AS m FROM e GROUP BY pair, g) GROUP BY pair
), m(pair, k, f) AS (
  SELECT pair, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM s WHERE n1 = n2
  UNION ALL
  SELECT m.pair, k + 1, list_append(f, w) FROM m JOIN s USING (pair), (SELECT unnest(range(1, 13)) AS w)
  WHERE k < n1 AND w <= n2 AND NOT list_contains(f, w)
    AND len(list_filter(f, lambda u, j: list_contains(m1, j * 100 + k + 1) <> list_contains(m2, u * 100 + w))) = 0
)
SELECT pair, coalesce(bool_or(k = n1), FALSE) AS isomorphic FROM s LEFT JOIN m USING (pair) GROUP BY pair"""


@_query(_isomorphic_sql(_LITERAL_EDGES))
def giso_literals(spark, sf_dir):
    return iso.is_isomorphic(literal_pairs(spark))


@_query(_isomorphic_sql(_MADE_EDGES))
def is_isomorphic(spark, sf_dir):
    return iso.is_isomorphic(_all_pairs(spark))


@_query("SELECT i AS g1v, j AS g2v FROM (SELECT unnest(range(1, 41)) AS i), (SELECT unnest(range(1, 40)) AS j)")
def giso_seed_pairs(spark, sf_dir):
    both = gen.complete_pair(spark, 40)
    return iso.seed_pairs(*(both.where(F.col("g") == k).select(F.col("src").alias("v")).distinct() for k in (1, 2)))


#: Vertices that begin a simple path through all vertices of their graph; two such paths exist side by side if the graphs have as many vertices.
_WALKS = f"""WITH RECURSIVE e AS ({_LITERAL_EDGES}), p(pair, g, s, v, path) AS (
  SELECT DISTINCT pair, g, src, src, [src] FROM e
  UNION ALL
  SELECT p.pair, p.g, s, e.dst, list_append(path, e.dst) FROM p JOIN e ON e.pair = p.pair AND e.g = p.g AND e.src = p.v WHERE NOT list_contains(path, e.dst)
), n AS (SELECT pair, g, count(DISTINCT src) AS n FROM e GROUP BY pair, g),
h AS (SELECT pair, g, s, n, bool_or(len(path) = n) AS whole FROM p JOIN n USING (pair, g) GROUP BY pair, g, s, n),
w AS (SELECT a.pair, CAST(a.s AS BIGINT) AS g1v, CAST(b.s AS BIGINT) AS g2v, a.whole AND b.whole AND a.n = b.n AS walk FROM h a JOIN h b ON a.pair = b.pair AND a.g = 1 AND b.g = 2)"""


def _seeds(edges: DataFrame) -> DataFrame:
    ends = edges.select("pair", "g", F.col("src").alias("v")).distinct()
    return ends.where("g = 1").select("pair", F.col("v").alias("g1v")).join(ends.where("g = 2").select("pair", F.col("v").alias("g2v")), "pair")


@_query(f"{_WALKS} SELECT * FROM w")
def paired_walk(spark, sf_dir):
    """The heuristic on the literal pairs, from all seed pairs; exponential, so on these small graphs only."""
    edges = literal_pairs(spark)
    return iso.paired_walk(edges, _seeds(edges))


@_query(f"{_WALKS} SELECT pair, bool_or(walk) AS walk FROM w GROUP BY pair")
def any_walk(spark, sf_dir):
    edges = literal_pairs(spark)
    return iso.any_walk(edges, _seeds(edges))


# order


def _orders(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
def sort_global(spark, sf_dir):
    return order.sort_global(_orders(spark, sf_dir), "o_totalprice", "o_orderkey")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
def sort_partitioned(spark, sf_dir):
    return order.sort_partitioned(_orders(spark, sf_dir), 8, "o_totalprice", "o_orderkey")


@_query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank, o_orderkey, o_totalprice FROM orders")
def sort_rank(spark, sf_dir):
    return order.rank(_orders(spark, sf_dir), F.col("o_totalprice"), F.col("o_orderkey")).select("rank", "o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_topk(spark, sf_dir):
    return order.top_k(_orders(spark, sf_dir), 20, F.desc("o_totalprice"), "o_orderkey")


@_query(
    """SELECT 0 AS run, l_orderkey * 10 + l_linenumber AS pos, l_quantity AS value FROM lineitem
UNION ALL SELECT 1, o_orderkey, floor(o_totalprice / 10000) FROM orders"""
)
def merge_runs(spark, sf_dir):
    """Quantities and prices as two runs."""
    left = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").alias("value"))
    right = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("pos"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("value"))
    return order.merge_runs(left, right, "value", "pos")
