"""The registered queries: every operator over clouds made of the driver's tables, and the same in SQL where SQL can say it.

Cloud E: embeddings, position = dimensions 0 to 2, normal = dimensions 3 to 5. Cloud V: events, x = seconds since 2024-01-01,
y = value, z = user. Cloud L: lineitem, x = price, y = quantity, z = discount.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.operators import compare, components, forest, graph, growing, knn, normals, ordered, ranking, refine, roof, segment, stats, transform, trust
from pointweave.plans import orient
from pointweave.schema import COLOR, NORMAL, XYZ, from_table
from pointweave.shared import shared_dir, stored
from pointweave.sources import clouds, sinks
from pointweave.streaming import orient as stream_orient
from pointweave.streaming import sweep

K, RADIUS = 6, 0.1
FLAGSHIP = "orient_global"
DAY = 86_400.0
STREAM_FILES = 3
ROTATION = [[0.36, 0.48, -0.8], [-0.8, 0.6, 0.0], [0.48, 0.64, 0.6]]
SHIFT = (1.5, -2.25, 0.125)


def cloud_e(spark: SparkSession, sf: str) -> DataFrame:
    dims = dict(zip([*XYZ, *NORMAL], (f"embedding[{k}]" for k in range(6)), strict=True))
    return from_table(spark.read.parquet(f"{sf}/embeddings.parquet"), id="vec_id", **dims)


def cloud_v(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return from_table(events, id="event_id", px="(us - 1704067200000000) / 1e6", py="value", pz="user_id", nx="value - 250", ny="user_id - 75", nz="1")


def cloud_l(spark: SparkSession, sf: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf}/lineitem.parquet"), id="l_orderkey", px="l_extendedprice", py="l_quantity", pz="l_discount")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Reals to so many digits, as double; counts and ids to long."""
    return df.select(*(F.round(F.col(c).cast("double"), digits).alias(c) if t in ("float", "double") else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "bigint") else F.col(c) for c, t in df.dtypes))


def near_e(spark: SparkSession, sf: str, causal: bool = False) -> DataFrame:
    return knn.neighbours(transform.normalized(cloud_e(spark, sf)), K, RADIUS, causal)


def edges_e(spark: SparkSession, sf: str, criterion: str = "hoppe") -> DataFrame:
    return graph.edges_global(cloud_e(spark, sf), K, RADIUS, criterion)


def points_e(spark: SparkSession, sf: str) -> DataFrame:
    """Cloud E with component."""
    cloud = cloud_e(spark, sf)
    return cloud.join(components.of_points(cloud, edges_e(spark, sf)), "id")


def boxes_e(spark: SparkSession, sf: str) -> DataFrame:
    return components.large_enough(components.boxes(points_e(spark, sf)), RADIUS)


def segments_e(spark: SparkSession, sf: str) -> DataFrame:
    """A segmentation that needs no search: by id."""
    return cloud_e(spark, sf).select("id", F.pmod("id", F.lit(7)).alias("segment"), F.when(F.pmod("id", F.lit(2)) == 0, 1).otherwise(-1).alias("flip"))


def cell_key() -> Column:
    x = [F.col(c).cast("double") + F.lit(1.0) for c in XYZ]
    return F.floor(x[0] / 0.4).cast("long") * F.lit(2**32) + transform.morton(F.floor(x[1] / 0.2), F.floor(x[2] / 0.2))


def solved_e(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = stored(edges_e(spark, sf), "edges")
    return edges, *forest.spanning_forest(edges)


def grown_e(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Forest and solution of cloud E's graph that came in three parts: edges among a third of the points, then those from it to the others, then the rest."""
    edges, path = stored(edges_e(spark, sf), "edges"), f"{shared_dir(spark)}/growing-{uuid.uuid4().hex}"
    inside = (F.pmod("hi", F.lit(3)) == 0).cast("int") + (F.pmod("lo", F.lit(3)) == 0).cast("int")
    for part in (2, 1, 0):
        forest_, solution = growing.grow(edges.where(inside == part), path)
    return forest_, solution


def mst_signs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(solved_e(spark, sf)[2])


def mst_unorientable(spark: SparkSession, sf: str) -> DataFrame:
    edges, _, solution = solved_e(spark, sf)
    return graph.unorientable(edges, solution)


def model_energy(spark: SparkSession, sf: str) -> DataFrame:
    edges, _, solution = solved_e(spark, sf)
    return rounded(graph.model_energy(edges, solution))


def apply_orientation(spark: SparkSession, sf: str) -> DataFrame:
    _, _, solution = solved_e(spark, sf)
    return rounded(transform.signed(transform.normalized(cloud_e(spark, sf)), solution).select("id", "component", *NORMAL))


def orient_refine(spark: SparkSession, sf: str) -> DataFrame:
    """Energies of the labelling as it comes, after the forest and after refinement."""
    edges, _, solution = solved_e(spark, sf)
    better = refine.refined(edges, solution)
    plain = solution.withColumn("sign", F.lit(1))
    parts = [graph.model_energy(edges, s).withColumn("step", F.lit(name)) for name, s in (("as it came", plain), ("forest", solution), ("refined", better))]
    return parts[0].union(parts[1]).union(parts[2]).select("step", "energy", "edges")


def forest_energies(spark: SparkSession, sf: str) -> DataFrame:
    """Energies of the labelling as it comes and after the forest."""
    edges, _, solution = solved_e(spark, sf)
    parts = [rounded(graph.model_energy(edges, s)).withColumn("step", F.lit(name)) for name, s in (("as it came", solution.withColumn("sign", F.lit(1))), ("forest", solution))]
    return parts[0].union(parts[1])


def edge_stats_resigned(spark: SparkSession, sf: str) -> DataFrame:
    edges, _, solution = solved_e(spark, sf)
    return graph.edge_stats(graph.resigned(edges, solution))


def orient_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Flipped by coins, cloud E is oriented again: energies of its graph before and after, by both ways."""
    cloud = transform.randomized(cloud_e(spark, sf))
    energy = lambda c, name: graph.energy(graph.edges_global(c, K, RADIUS)).withColumn("step", F.lit(name))
    parts = [energy(cloud, "flipped"), energy(orient.orient_global(cloud, K, RADIUS), "global"), energy(orient.orient_stream(cloud, K, RADIUS), "stream")]
    return parts[0].union(parts[1]).union(parts[2]).select("step", "energy", "edges")


def slice_size(spark: SparkSession, sf: str) -> DataFrame:
    cloud = cloud_v(spark, sf)
    return cloud.agg(F.lit(stats.slice_size(cloud, DAY)).cast("long").alias("slice_size"))


def scan_ply(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/cloud-{uuid.uuid4().hex}.ply"
    sinks.write_ply(cloud_e(spark, sf), path)
    return rounded(clouds.read_ply(spark, path).select("id", *XYZ, *NORMAL))


def scan_bin(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/cloud-{uuid.uuid4().hex}.bin"
    sinks.write_bin(cloud_e(spark, sf), path)
    return rounded(clouds.read_bin(spark, path).select("id", *XYZ, *NORMAL))


def knn_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The causal neighbours of cloud E, found by a stream that reads the points in x order, a file a batch: the sweep's state is dropped behind it."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    cloud = cloud_e(spark, sf)
    n = cloud.count()
    ranks = stored(ranking.ranked(cloud, [F.col("px"), F.col("id")], "ord"), "ranks")
    for k in range(1, STREAM_FILES + 1):  # files are taken in the order of their times
        ranks.where((F.col("ord") > n * (k - 1) // STREAM_FILES) & (F.col("ord") <= n * k // STREAM_FILES)).drop("ord").write.mode("append").parquet(f"{base}/points")
    stream = spark.readStream.schema(cloud.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/points")
    low = cloud.agg(F.min("px")).first()[0]
    return rounded(knn.as_knn(sweep.run_sweep(stream, f"sweep-{uuid.uuid4().hex}", K, RADIUS, low)))


def records_e(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, float]:
    """Cloud E as a stream of binary records in x order, the ids that its records' numbers stand for, and its least x."""
    cloud, path = cloud_e(spark, sf), f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    ranks = stored(ranking.ranked(cloud, [F.col("px"), F.col("id")], "ord").withColumn("ord", F.col("ord") - 1), "ranks")
    sinks.write_bin(ranks.drop("id").withColumnRenamed("ord", "id"), path)
    row = ranks.agg(F.count("*"), F.min("px")).first()
    return clouds.read_bin_stream(spark, path, max(64, row[0] // STREAM_FILES)), ranks.select("id", "ord"), row[1]


def knn_records(spark: SparkSession, sf: str) -> DataFrame:
    """As knn_stream, from a stream of binary records: so many a batch."""
    stream, ids, low = records_e(spark, sf)
    near = knn.as_knn(sweep.run_sweep(stream, f"sweep-{uuid.uuid4().hex}", K, RADIUS, low))
    for end in ("src", "dst"):
        near = near.withColumnRenamed(end, "ord").join(ids.withColumnRenamed("id", end), "ord").drop("ord")
    return rounded(near.select("src", "dst", "d2", "rank"))


def segments_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Segments and flips of cloud E by the stream's keyed state, batch after batch of records."""
    stream, ids, low = records_e(spark, sf)
    base, _ = stream_orient.run_segments(stream, f"segments-{uuid.uuid4().hex}", K, RADIUS, low)
    points = spark.read.schema(stream_orient.POINTS + ", batch int").parquet(f"{base}/points").select(F.col("id").alias("ord"), F.col("segment").alias("first"), "flip")
    named = points.join(ids, "ord").join(ids.select(F.col("ord").alias("first"), F.col("id").alias("segment")), "first")
    return rounded(named.select("id", "segment", "flip"))


def segments_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Segments and flips of cloud E, as one sweep gives them."""
    near = stored(near_e(spark, sf, causal=True), "near")
    return rounded(segment.segmented(cloud_e(spark, sf), near, "hoppe", RADIUS))


def orient_solvers(spark: SparkSession, sf: str) -> DataFrame:
    """Energies of cloud E's graph after refinement, and after roof duality and the trust region have gone on from there."""
    edges = stored(edges_e(spark, sf), "edges")
    start = orient.forest_refined(edges)
    found = {"refined": start, "roof": roof.improved(edges, start, rounds=2), "trust region": refine.refined(edges, trust.trusted(edges, start, most_steps=3))}
    return reduce(DataFrame.union, [rounded(graph.model_energy(edges, s)).select(F.lit(name).alias("step"), "energy", "edges") for name, s in found.items()])


def prepare_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What turning leaves as it is: each point's distance from the centre and its normal's length; and whether places go by x."""
    done = orient.prepare(cloud_v(spark, sf)).cloud
    size = lambda names: F.sqrt(sum((F.col(c) * F.col(c) for c in names[1:]), F.col(names[0]) * F.col(names[0])))
    ahead = done.select((F.col("ord") + 1).alias("ord"), F.col("px").alias("before"))
    done = done.join(ahead, "ord", "left")
    return done.select("id", F.round(size(XYZ), 3).alias("from_centre"), F.round(size(NORMAL), 6).alias("length"), F.coalesce(F.col("px") >= F.col("before"), F.col("ord") == 1).alias("in_order"))


def normal_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """How far the neighbourhood extends along the axis that is the normal: the least such extent."""
    found = normals.axes(normals.local_covariance(cloud_e(spark, sf), 0.15))
    e = dict(zip("xyz", ("ex", "ey", "ez"), strict=True))
    extent = sum((F.lit(1.0 if a == b else 2.0) * F.col(f"c{a[1]}{b[1]}") * F.col(e[a[1]]) * F.col(e[b[1]]) for a, b in normals.PAIRS), F.lit(0.0))
    length = sum((F.col(x) * F.col(x) for x in e.values()), F.lit(0.0))
    return found.select("id", F.round(extent, 5).alias("extent"), F.round(length, 6).alias("length"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cloud_count": lambda s, d: cloud_l(s, d).agg(F.count("*").alias("n")),
    "bbox": lambda s, d: stats.bbox(cloud_l(s, d)),
    "centroid": lambda s, d: rounded(stats.centroid(cloud_l(s, d)), 4),
    "covariance": lambda s, d: rounded(stats.covariance(cloud_l(s, d)), 1),
    "filter_valid_normal": lambda s, d: transform.valid_normals(cloud_v(s, d)).select("id"),
    "project_position": lambda s, d: rounded(transform.narrowed(cloud_v(s, d), ["id", *XYZ])),
    "normalize_normals": lambda s, d: rounded(transform.normalized(cloud_v(s, d)).select("id", *NORMAL)),
    "align_translate": lambda s, d: rounded(transform.moved(cloud_v(s, d), SHIFT).select("id", *XYZ, *NORMAL)),
    "align_rotate": lambda s, d: rounded(transform.transformed(cloud_e(s, d), ROTATION).select("id", *XYZ, *NORMAL)),
    "grid_cell": lambda s, d: transform.grid_cells(cloud_v(s, d), 12.5, 0.0, 0.0, 500.0).select("id", "cy", "cz", "cell_id"),
    "morton_index": lambda s, d: cloud_v(s, d).select("id", transform.binned_morton(transform.dbl("py"), transform.dbl("pz"), 0.0, 0.0, 2.5).alias("morton")),
    "segment_color": lambda s, d: rounded(cloud_v(s, d).select("id").withColumns(transform.segment_color(F.col("id")))),
    "sort_by_x": lambda s, d: ranking.ranked(cloud_v(s, d).select("id", "px"), [F.col("px"), F.col("id")], "ord").select("id", "ord"),
    "knn_global": lambda s, d: rounded(knn.knn_global(cloud_e(s, d), K, RADIUS)),
    "knn_causal": lambda s, d: rounded(knn.knn_causal(cloud_e(s, d), K, RADIUS)),
    "knn_cell": lambda s, d: rounded(knn.knn_cell(cloud_e(s, d), 20, 0.2, cell_key())),
    "knn_stream": knn_stream,
    "knn_records": knn_records,
    "segments_batch": segments_batch,
    "segments_stream": segments_stream,
    "knn_candidates": lambda s, d: rounded(knn.candidate_counts(cloud_e(s, d), RADIUS)),
    "edges_global": lambda s, d: rounded(edges_e(s, d)),
    "edge_rank": lambda s, d: ranking.ranked(edges_e(s, d).withColumn("size", F.abs("weight")), [F.desc("size"), F.asc("hi"), F.asc("lo")], "edge_rank").select("hi", "lo", "edge_rank"),
    "edge_stats": lambda s, d: graph.edge_stats(edges_e(s, d)),
    "energy_hoppe": lambda s, d: rounded(graph.energy(edges_e(s, d))),
    "energy_xie": lambda s, d: rounded(graph.energy(edges_e(s, d, "xie"))),
    "connected_components": lambda s, d: components.of_points(cloud_e(s, d), edges_e(s, d)),
    "component_bbox": lambda s, d: rounded(components.boxes(points_e(s, d))),
    "component_filter": lambda s, d: rounded(boxes_e(s, d).select("component", "n", "kept")),
    "component_rank": lambda s, d: rounded(components.by_size(boxes_e(s, d)).select("component", "n", "comp_rank")),
    "largest_component": lambda s, d: orient.finished(points_e(s, d), RADIUS, strict=False).where("comp_rank = 0").select("id"),
    "max_spanning_forest": lambda s, d: rounded(solved_e(s, d)[1]),
    "grown_forest": lambda s, d: rounded(grown_e(s, d)[0]),
    "grown_signs": lambda s, d: rounded(grown_e(s, d)[1]),
    "mst_signs": mst_signs,
    "mst_unorientable": mst_unorientable,
    "model_energy": model_energy,
    "apply_orientation": apply_orientation,
    "segment_votes": lambda s, d: rounded(graph.segment_votes(near_e(s, d, True), segments_e(s, d), "hoppe", RADIUS)),
    "edges_segment": lambda s, d: rounded(graph.segment_edges(near_e(s, d, True), segments_e(s, d), "hoppe", RADIUS)),
    "compare_normals": lambda s, d: compare.compare_normals(cloud_e(s, d), cloud_e(s, d).where("id % 10 != 0").withColumns({c: F.when(F.col("id") % 3 == 0, -F.col(c)).otherwise(F.col(c)) for c in NORMAL})),
    "local_covariance": lambda s, d: rounded(normals.local_covariance(cloud_e(s, d), 0.15)),
    "slice_size": slice_size,
    "scan_ply": scan_ply,
    "scan_bin": scan_bin,
    "ply_lines": lambda s, d: sinks.ply_lines(cloud_e(s, d).drop(*COLOR)),
    "slices": lambda s, d: ordered.sliced(cloud_v(s, d), DAY, 400).select("id", "place", "slice"),
    "ordered_gaps": lambda s, d: rounded(ordered.gaps(cloud_v(s, d))),
    "normal_residuals": normal_residuals,
    "estimate_normals": lambda s, d: normals.estimated(cloud_e(s, d), 0.15).select("id", *NORMAL),
    "prepare_streaming": lambda s, d: orient.prepare(cloud_v(s, d)).cloud.select("id", "ord", *XYZ),
    "randomize_normals": lambda s, d: transform.randomized(cloud_v(s, d)).select("id", *NORMAL),
    "randomize_sizes": lambda s, d: rounded(transform.randomized(cloud_v(s, d)).select("id", *(F.abs(F.col(c)).alias(c) for c in NORMAL), F.signum(F.col("nx") * F.col("nz")).alias("turn"))),
    "prepare_sorted": lambda s, d: rounded(orient.prepare(cloud_v(s, d), realign=False).cloud.select("id", "ord", *XYZ)),
    "morton_sorted": lambda s, d: transform.morton_sorted(cloud_v(s, d), F.floor(transform.dbl("px") / DAY), 0.0, 0.0, 2.5).select("id", "slice", "morton", "nth"),
    "prepare_invariants": prepare_invariants,
    "mst_first_tree": lambda s, d: rounded(orient.solve(edges_e(s, d), "first tree")),
    "forest_energies": forest_energies,
    "edge_stats_resigned": edge_stats_resigned,
    "orient_accuracy": orient_accuracy,
    "orient_refine": orient_refine,
    "orient_solvers": orient_solvers,
    "orient_global": lambda s, d: orient.orient_global(cloud_e(s, d), K, RADIUS),
    "orient_stream": lambda s, d: orient.orient_stream(cloud_e(s, d), K, RADIUS),
}

R2 = f"{RADIUS * RADIUS!r}::DOUBLE"
NORM = "sqrt(nx * nx + ny * ny + nz * nz)"
E0 = "e0 AS (SELECT vec_id AS id, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS {c}" for k, c in enumerate([*XYZ, *NORMAL])) + " FROM embeddings)"
E1 = E0 + ", e AS (SELECT id, px, py, pz, " + ", ".join(f"CASE WHEN {NORM} > 0 THEN {c} / {NORM} ELSE {c} END AS {c}" for c in NORMAL) + " FROM e0)"
V = "v AS (SELECT event_id AS id, ((epoch_us(ts) - 1704067200000000) / 1e6)::FLOAT::DOUBLE AS px, value::FLOAT::DOUBLE AS py, user_id::FLOAT::DOUBLE AS pz, (value - 250)::FLOAT::DOUBLE AS nx, (user_id - 75)::FLOAT::DOUBLE AS ny, 1::DOUBLE AS nz FROM events)"
L = "l AS (SELECT l_extendedprice::FLOAT::DOUBLE AS px, l_quantity::FLOAT::DOUBLE AS py, l_discount::FLOAT::DOUBLE AS pz FROM lineitem)"
D2 = "(a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz)"
DOT = "(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz)"
ALONG = "((a.px - b.px) * {0}.nx + (a.py - b.py) * {0}.ny + (a.pz - b.pz) * {0}.nz)"
XIE = f"(CASE WHEN {D2} > 0 THEN {DOT} - 2.0::DOUBLE * {ALONG.format('a')} * {ALONG.format('b')} / ({D2}) ELSE {DOT} END)"
BEFORE = "(b.px < a.px OR (b.px = a.px AND b.id < a.id))"


def knn_sql(where: str = "a.id <> b.id", k: int = K, r2: str = R2, cloud: str = "e") -> str:
    pairs = f"SELECT a.id AS src, b.id AS dst, {D2} AS d2, {DOT} AS dot, {XIE} AS xie FROM {cloud} a JOIN {cloud} b ON {where}"
    return f"near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM ({pairs}) WHERE d2 < {r2} QUALIFY rank <= {k})"


def edges_sql(vote: str = "dot") -> str:
    return f"{knn_sql()}, edges AS (SELECT greatest(src, dst) AS hi, least(src, dst) AS lo, min(d2) AS d2, min({vote} * (1 - d2 / {R2})) AS weight FROM near GROUP BY 1, 2)"


A_LABEL, B_LABEL = "comp[r.a]", "comp[r.b]"
KRUSKAL = f"""{E1}, {edges_sql()},
nodes AS (SELECT node, row_number() OVER (ORDER BY node) AS ix FROM (SELECT hi AS node FROM edges UNION SELECT lo FROM edges)),
r AS (SELECT row_number() OVER (ORDER BY abs(weight) DESC, hi, lo) AS q, h.ix AS a, l.ix AS b, weight, hi, lo FROM edges JOIN nodes h ON h.node = hi JOIN nodes l ON l.node = lo),
k(q, comp, sgn, taken) AS (
  SELECT 0::BIGINT, (SELECT list(ix ORDER BY ix) FROM nodes), (SELECT list(1 ORDER BY ix) FROM nodes), false
  UNION ALL
  SELECT r.q,
    CASE WHEN {A_LABEL} <> {B_LABEL} THEN list_transform(comp, lambda x: CASE WHEN x = greatest({A_LABEL}, {B_LABEL}) THEN least({A_LABEL}, {B_LABEL}) ELSE x END) ELSE comp END,
    CASE WHEN {A_LABEL} <> {B_LABEL} AND sgn[r.a] * sgn[r.b] <> (CASE WHEN r.weight < 0 THEN -1 ELSE 1 END)
      THEN list_transform(sgn, lambda x, i: CASE WHEN comp[i] = greatest({A_LABEL}, {B_LABEL}) THEN -x ELSE x END) ELSE sgn END,
    {A_LABEL} <> {B_LABEL}
  FROM k JOIN r ON r.q = k.q + 1),
ended AS (SELECT comp, sgn FROM k ORDER BY q DESC LIMIT 1),
solution AS (SELECT n.node, c.node AS component, ended.sgn[n.ix] AS sign FROM ended, nodes n JOIN nodes c ON c.ix = (SELECT comp[n.ix] FROM ended)),
points AS (SELECT e0.*, coalesce(component, id) AS component FROM e0 LEFT JOIN solution ON node = id),
boxes AS (SELECT component, count(*) AS n, min(px) AS min_x, max(px) AS max_x, min(py) AS min_y, max(py) AS max_y, min(pz) AS min_z, max(pz) AS max_z FROM points GROUP BY 1),
judged AS (SELECT *, least(max_x - min_x, max_y - min_y, max_z - min_z) >= {RADIUS!r}::DOUBLE AS kept FROM boxes),
ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, component) - 1 AS comp_rank FROM judged WHERE kept),
signed AS (SELECT edges.*, h.sign * l.sign AS turn FROM edges JOIN solution h ON h.node = hi JOIN solution l ON l.node = lo)"""


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def rotate_sql(names: list[str]) -> str:
    return ", ".join(f"round({m[0]!r}::DOUBLE * {names[0]} + {m[1]!r}::DOUBLE * {names[1]} + {m[2]!r}::DOUBLE * {names[2]}, 6) AS {c}" for c, m in zip(names, ROTATION, strict=True))


def spread_sql(x: str) -> str:
    x = f"(({x})::BIGINT & 65535)"
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = f"(({x} | ({x} << {shift})) & {mask})"
    return x


def morton_sql(u: str, v: str) -> str:
    return f"({spread_sql(u)} | ({spread_sql(v)} << 1))"


def color_sql(shift: int) -> str:
    hue = "((id * 3) % 13)::DOUBLE / 13.0 * 6.0"
    turned = f"({hue} - {shift} + 3.0)"
    far = f"abs(({turned} - 6.0 * floor({turned} / 6.0)) - 3.0)"
    return f"floor(greatest(0.0, least(1.0, 2.0 - {far})) * (0.5 + 0.5 * (id % 2)::DOUBLE) * 255.0)::BIGINT"


SEGMENTS = f"WITH {E1}, {knn_sql(BEFORE)}, seg AS (SELECT id, id % 7 AS segment, CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS flip FROM e)"
G6 = "format('{:.6g}', %s)"

COVARIANCE = f"WITH {E1}, {knn_sql(k=20, r2=f'{0.15 * 0.15!r}::DOUBLE')}, m AS (SELECT src, count(*) AS n, avg(px) AS mx, avg(py) AS my, avg(pz) AS mz FROM near JOIN e ON id = dst GROUP BY 1), u AS (SELECT src, px - mx AS x, py - my AS y, pz - mz AS z, sqrt((px - mx) * (px - mx) + (py - my) * (py - my) + (pz - mz) * (pz - mz)) AS s FROM near JOIN m USING (src) JOIN e ON id = dst), w AS (SELECT src, " + ", ".join(f"sum(CASE WHEN s > 0 THEN ({a[1]} / s) * ({b[1]} / s) ELSE 0 END) AS w{a[1]}{b[1]}" for a, b in stats.PAIRS) + " FROM u GROUP BY 1)"
SUMS = [f"(({a} - m{a[1]}) * ({b} - m{b[1]}) + w{a[1]}{b[1]})" for a, b in stats.PAIRS]
#: The least eigenvalue of a symmetric matrix by the roots of its polynomial.
LEAST_EXTENT = (
    COVARIANCE + ", c AS (SELECT id, " + ", ".join(f"{x} AS c{a[1]}{b[1]}" for (a, b), x in zip(stats.PAIRS, SUMS, strict=True)) + " FROM m JOIN w USING (src) JOIN e ON id = src WHERE n >= 3), "
    "t AS (SELECT *, (cxx + cyy + czz) / 3 AS q FROM c), s AS (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p FROM t), "
    "d AS (SELECT *, ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * p * p * p) AS r FROM s) "
    "SELECT id, round(q + 2 * p * cos(acos(greatest(-1, least(1, r))) / 3 + 2 * pi() / 3), 5) AS extent, 1.0::DOUBLE AS length FROM d"
)

ORACLES: dict[str, str] = {
    "cloud_count": "SELECT count(*) AS n FROM lineitem",
    "bbox": f"WITH {L} SELECT " + ", ".join(f"{n}({c}) AS {n}_{c[1]}" for c in XYZ for n in ("min", "max")) + " FROM l",
    "centroid": f"WITH {L} SELECT " + ", ".join(f"round(avg({c}), 4) AS c{c[1]}" for c in XYZ) + " FROM l",
    "covariance": f"WITH {L} SELECT " + ", ".join(f"round(covar_pop({a}, {b}), 1) AS c{a[1]}{b[1]}" for a, b in stats.PAIRS) + " FROM l",
    "filter_valid_normal": f"WITH {V} SELECT id FROM v WHERE nx * nx + ny * ny + nz * nz > 0.5",
    "project_position": f"WITH {V} SELECT id, {r6(*XYZ)} FROM v",
    "normalize_normals": f"WITH {V} SELECT id, " + ", ".join(f"round({c} / {NORM}, 6) AS {c}" for c in NORMAL) + " FROM v",
    "align_translate": f"WITH {V} SELECT id, " + ", ".join(f"round({c} + {x!r}::DOUBLE, 6) AS {c}" for c, x in zip(XYZ, SHIFT, strict=True)) + f", {r6(*NORMAL)} FROM v",
    "align_rotate": f"WITH {E0} SELECT id, {rotate_sql(XYZ)}, {rotate_sql(NORMAL)} FROM e0",
    "grid_cell": f"WITH {V} SELECT id, floor(py / 12.5)::BIGINT AS cy, floor(pz / 12.5)::BIGINT AS cz, floor(py / 12.5)::BIGINT + 41 * floor(pz / 12.5)::BIGINT AS cell_id FROM v",
    "morton_index": f"WITH {V} SELECT id, {morton_sql('trunc(py / 2.5)', 'trunc(pz / 2.5)')} AS morton FROM v",
    "segment_color": f"WITH {V} SELECT id, {color_sql(0)} AS red, {color_sql(2)} AS green, {color_sql(4)} AS blue FROM v",
    "sort_by_x": f"WITH {V} SELECT id, row_number() OVER (ORDER BY px, id) AS ord FROM v",
    "knn_global": f"WITH {E1}, {knn_sql()} SELECT src, dst, round(d2, 6) AS d2, rank FROM near",
    "knn_causal": f"WITH {E1}, {knn_sql(BEFORE)} SELECT src, dst, round(d2, 6) AS d2, rank FROM near",
    "knn_stream": f"WITH {E1}, {knn_sql(BEFORE)} SELECT src, dst, round(d2, 6) AS d2, rank FROM near",
    "knn_records": f"WITH {E1}, {knn_sql(BEFORE)} SELECT src, dst, round(d2, 6) AS d2, rank FROM near",
    "knn_cell": f"WITH {E1}, c AS (SELECT *, floor((px + 1) / 0.4)::BIGINT * 4294967296 + {morton_sql('floor((py + 1) / 0.2)', 'floor((pz + 1) / 0.2)')} AS key FROM e), {knn_sql('a.id <> b.id AND a.key = b.key', 20, f'{0.2 * 0.2!r}::DOUBLE', 'c')} SELECT src, dst, round(d2, 6) AS d2, rank FROM near",
    "knn_candidates": f"WITH {E0}, c AS (SELECT id, floor(px / {RADIUS!r}::DOUBLE) AS x, floor(py / {RADIUS!r}::DOUBLE) AS y, floor(pz / {RADIUS!r}::DOUBLE) AS z FROM e0) SELECT (SELECT count(*) FROM c) AS points, count(*) AS candidates FROM c a JOIN c b ON a.id <> b.id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1",
    "edges_global": f"WITH {E1}, {edges_sql()} SELECT hi, lo, {r6('d2', 'weight')} FROM edges",
    "edge_rank": f"WITH {E1}, {edges_sql()} SELECT hi, lo, row_number() OVER (ORDER BY abs(weight) DESC, hi, lo) AS edge_rank FROM edges",
    "edge_stats": f"WITH {E1}, {edges_sql()} SELECT count(*) AS edges, count(*) FILTER (weight < 0) AS negative, count(*) FILTER (weight = 0) AS zero FROM edges",
    "energy_hoppe": f"WITH {E1}, {edges_sql()} SELECT round(sum(-least(weight, 0)), 6) AS energy, count(*) AS edges FROM edges",
    "energy_xie": f"WITH {E1}, {edges_sql('xie')} SELECT round(sum(-least(weight, 0)), 6) AS energy, count(*) AS edges FROM edges",
    "connected_components": f"WITH RECURSIVE {KRUSKAL} SELECT id, component FROM points",
    "component_bbox": f"WITH RECURSIVE {KRUSKAL} SELECT component, n, {r6('min_x', 'max_x', 'min_y', 'max_y', 'min_z', 'max_z')} FROM boxes",
    "component_filter": f"WITH RECURSIVE {KRUSKAL} SELECT component, n, kept FROM judged",
    "component_rank": f"WITH RECURSIVE {KRUSKAL} SELECT component, n, comp_rank FROM ranked",
    "largest_component": f"WITH RECURSIVE {KRUSKAL} SELECT id FROM points JOIN ranked USING (component) WHERE comp_rank = 0",
    "max_spanning_forest": f"WITH RECURSIVE {KRUSKAL} SELECT hi, lo, round(weight, 6) AS weight FROM r JOIN k USING (q) WHERE taken",
    "mst_signs": f"WITH RECURSIVE {KRUSKAL} SELECT node, component, sign::BIGINT AS sign FROM solution",
    "grown_forest": f"WITH RECURSIVE {KRUSKAL} SELECT hi, lo, round(weight, 6) AS weight FROM r JOIN k USING (q) WHERE taken",
    "grown_signs": f"WITH RECURSIVE {KRUSKAL} SELECT node, component, sign::BIGINT AS sign FROM solution",
    "mst_unorientable": f"WITH RECURSIVE {KRUSKAL} SELECT count(*) FILTER (turn <> (CASE WHEN weight < 0 THEN -1 ELSE 1 END)) AS unorientable, count(*) AS edges FROM signed",
    "model_energy": f"WITH RECURSIVE {KRUSKAL} SELECT round(sum(-least(weight * turn, 0)), 6) AS energy, count(*) AS edges FROM signed WHERE weight <> 0",
    "apply_orientation": f"WITH RECURSIVE {KRUSKAL} SELECT id, coalesce(component, id) AS component, " + ", ".join(f"round({c} * coalesce(sign, 1), 6) AS {c}" for c in NORMAL) + " FROM e LEFT JOIN solution ON node = id",
    "randomize_sizes": f"WITH {V} SELECT id, " + ", ".join(f"round(abs({c}), 6) AS {c}" for c in NORMAL) + ", sign(nx * nz)::DOUBLE AS turn FROM v",
    "prepare_sorted": f"WITH {V} SELECT id, row_number() OVER (ORDER BY px, id) AS ord, {r6(*XYZ)} FROM v",
    "morton_sorted": f"WITH {V}, m AS (SELECT id, floor(px / {DAY!r}::DOUBLE)::BIGINT AS slice, {morton_sql('trunc(py / 2.5)', 'trunc(pz / 2.5)')} AS morton FROM v) SELECT *, row_number() OVER (PARTITION BY slice ORDER BY morton, id) AS nth FROM m",
    "prepare_invariants": f"WITH {V}, c AS (SELECT avg(px) AS x, avg(py) AS y, avg(pz) AS z FROM v) SELECT id, round(sqrt((px - x) * (px - x) + (py - y) * (py - y) + (pz - z) * (pz - z)), 3) AS from_centre, round(sqrt(nx * nx + ny * ny + nz * nz), 6) AS length, true AS in_order FROM v, c",
    "mst_first_tree": f"WITH RECURSIVE {KRUSKAL} SELECT node, component, CASE WHEN component = (SELECT min(component) FROM solution) THEN sign ELSE 1 END::BIGINT AS sign FROM solution",
    "forest_energies": f"WITH RECURSIVE {KRUSKAL} SELECT 'as it came' AS step, round(sum(-least(weight, 0)), 6) AS energy, count(*) AS edges FROM signed WHERE weight <> 0 UNION ALL SELECT 'forest', round(sum(-least(weight * turn, 0)), 6), count(*) FROM signed WHERE weight <> 0",
    "edge_stats_resigned": f"WITH RECURSIVE {KRUSKAL} SELECT count(*) AS edges, count(*) FILTER (weight * turn < 0) AS negative, count(*) FILTER (weight * turn = 0) AS zero FROM signed WHERE weight <> 0",
    "segment_votes": f"{SEGMENTS}, votes AS (SELECT src, segment, d2, dot * (1 - d2 / {R2}) AS vote FROM near JOIN seg ON id = dst) SELECT src, segment, round(sum(greatest(vote, 0)), 6) AS pos, round(sum(least(vote, 0)), 6) AS neg, round(min(d2), 6) AS min_d2 FROM votes GROUP BY 1, 2",
    "edges_segment": f"{SEGMENTS} SELECT greatest(s.segment, t.segment) AS hi, least(s.segment, t.segment) AS lo, round(sum(dot * (1 - d2 / {R2}) * s.flip * t.flip), 6) AS weight FROM near JOIN seg s ON s.id = src JOIN seg t ON t.id = dst WHERE s.segment <> t.segment GROUP BY 1, 2",
    "compare_normals": f"WITH {E0}, a AS (SELECT *, row_number() OVER (PARTITION BY px, py, pz ORDER BY id) AS nth FROM e0), b AS (SELECT px, py, pz, row_number() OVER (PARTITION BY px, py, pz ORDER BY id) AS nth, " + ", ".join(f"CASE WHEN id % 3 = 0 THEN -{c} ELSE {c} END AS {c}" for c in NORMAL) + f" FROM e0 WHERE id % 10 <> 0) SELECT count(*) FILTER ({DOT} > 0) AS correct, count(*) FILTER (a.nth IS NOT NULL AND b.nth IS NOT NULL AND NOT {DOT} > 0) AS wrong, count(*) FILTER (b.nth IS NULL) AS skipped1, count(*) FILTER (a.nth IS NULL) AS skipped2 FROM a FULL JOIN b ON a.px = b.px AND a.py = b.py AND a.pz = b.pz AND a.nth = b.nth",
    "local_covariance": COVARIANCE + " SELECT id, n, " + ", ".join(f"round({x}, 6) AS c{a[1]}{b[1]}" for (a, b), x in zip(stats.PAIRS, SUMS, strict=True)) + " FROM m JOIN w USING (src) JOIN e ON id = src",
    "normal_residuals": LEAST_EXTENT,
    "ordered_gaps": f"WITH {V} SELECT id, row_number() OVER (ORDER BY px, id) AS ord, coalesce(round(px - lag(px) OVER (ORDER BY px, id), 6), 0) AS gap FROM v",
    "slices": f"WITH RECURSIVE {V}, x AS (SELECT id, px, row_number() OVER (ORDER BY px, id) AS place FROM v), nxt AS (SELECT place, least(place + 400, coalesce(min(place) OVER (ORDER BY px RANGE BETWEEN {DAY!r}::DOUBLE FOLLOWING AND UNBOUNDED FOLLOWING), place + 400)) AS next FROM x), s(place, slice) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT next, slice + 1 FROM s JOIN nxt USING (place) WHERE next <= (SELECT count(*) FROM v)) SELECT id, x.place, max(slice) AS slice FROM x JOIN s ON s.place <= x.place GROUP BY 1, 2",
    "slice_size": f"WITH RECURSIVE {V}, x AS (SELECT px, min(place) AS place FROM (SELECT px, row_number() OVER (ORDER BY px, id) AS place FROM v) GROUP BY 1), nxt AS (SELECT place, min(place) OVER (ORDER BY px RANGE BETWEEN {DAY!r}::DOUBLE FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM x), s(place, size) AS (SELECT 1::BIGINT, 0::BIGINT UNION ALL SELECT next, next - nxt.place FROM s JOIN nxt USING (place) WHERE next IS NOT NULL) SELECT CASE WHEN max(size) > 0 THEN max(size) ELSE (SELECT count(*) FROM v) END AS slice_size FROM s",
    "scan_ply": f"WITH {E0} SELECT row_number() OVER (ORDER BY id) - 1 AS id, " + ", ".join(f"round({G6 % c}::FLOAT::DOUBLE, 6) AS {c}" for c in [*XYZ, *NORMAL]) + " FROM e0",
    "scan_bin": f"WITH {E0} SELECT row_number() OVER (ORDER BY id) - 1 AS id, {r6(*XYZ, *NORMAL)} FROM e0",
    "ply_lines": f"WITH {E0}, head AS (SELECT unnest(['ply', 'format ascii 1.0', 'element vertex ' || (SELECT count(*) FROM e0), 'property float x', 'property float y', 'property float z', 'property float nx', 'property float ny', 'property float nz', 'end_header']) AS value, generate_subscripts(range(10), 1) - 1 AS place) SELECT place, value FROM head UNION ALL SELECT row_number() OVER (ORDER BY id) + 9, " + " || ' ' || ".join(G6 % c for c in [*XYZ, *NORMAL]) + " FROM e0",
}
