"""Hand-computed and property tests of the engine's operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaflux.functions import geometry as G
from viaflux.functions import scalars as S
from viaflux.operators import assignment as A
from viaflux.operators import counts as C
from viaflux.operators import evaluate as E
from viaflux.operators import gravity as GR
from viaflux.operators import network as N
from viaflux.operators import propagation as P
from viaflux.params import BOUNDS, Params
from viaflux.plans import estimate, fixtures
from viaflux.sources import files
from viaflux.storage import Scratch

SF = "/root/testdata/sf0.001"
EDGES = "edge_seq long, src long, dst long, key string, sre string, direction string, capacity double, free_flow_time double, observed_vmd double, volume double, fixed boolean, regional int, is_urban boolean, is_federal boolean"


def edges(spark, rows):
    full = [(i, u, v, f"e{i}", f"s{i}", d, cap, t, vol if fixed else None, vol, fixed, i % 3, False, False) for i, (u, v, cap, t, vol, fixed, d) in enumerate(rows)]
    return spark.createDataFrame(full, EDGES)


def road(u, v, cap=1000.0, t=1.0, vol=None, fixed=False, d="CRESCENTE"):
    return (u, v, cap, t, vol, fixed, d)


def test_propagate_splits_by_capacity(spark):
    e = edges(spark, [road(1, 2, vol=900.0, fixed=True), road(2, 3, cap=1000.0), road(2, 4, cap=2000.0)])
    got = {r.key: r.volume for r in P.propagate_step(e, 1.0).collect()}
    assert got == {"e0": 900.0, "e1": pytest.approx(300.0), "e2": pytest.approx(600.0)}


def test_propagate_single_unknown(spark):
    e = edges(spark, [road(1, 2, vol=900.0, fixed=True), road(5, 2), road(2, 3, vol=200.0, fixed=True), road(2, 4)])
    got = {r.key: r.volume for r in P.propagate_step(e, 1.0).collect()}
    assert got["e3"] == pytest.approx(700.0)  # 900 - 200, one side of the node is half known
    assert got["e1"] == pytest.approx(1.0) or got["e1"] is not None


def test_propagation_keeps_known_and_grows(spark):
    scratch = Scratch(spark)
    rng = np.random.default_rng(7)
    rows = [road(int(u), int(v), cap=float(rng.integers(1, 9) * 500), vol=float(rng.integers(50, 900)) if rng.random() < 0.3 else None, fixed=True) for u, v in rng.integers(0, 15, (50, 2)) if u != v]
    rows = [(u, v, c, t, vol, vol is not None, d) for u, v, c, t, vol, _, d in rows]
    e = scratch.write(edges(spark, rows), "e")
    before = {r.key: r.volume for r in e.collect()}
    out, frames = P.propagate(e, Params(propagation_steps=5), scratch)
    after = {r.key: r.volume for r in out.collect()}
    assert all(after[k] == v for k, v in before.items() if v is not None)
    known = [r.edges_known for r in frames.orderBy("iteration").collect()]
    assert known == sorted(known) and known[-1] == sum(v is not None for v in after.values())
    assert all(v is None or v >= 1 for k, v in after.items() if before[k] is None)


def test_smoothing_counts_reverse_edge_twice(spark):
    e = edges(spark, [road(1, 2, vol=100.0), road(2, 1, vol=200.0), road(2, 3, vol=50.0)])
    got = {r.key: r.volume for r in P.smooth_step(e, 0.5).collect()}
    assert got["e0"] == pytest.approx(0.5 * 100 + 0.5 * (200 + 50 + 200) / 3)


def test_connectors_do_not_flow(spark):
    e = edges(spark, [road(1, 2, vol=900.0, fixed=True), road(2, 3, d="CONN"), road(2, 4)])
    got = {r.key: r.volume for r in P.propagate_step(e, 1.0).collect()}
    assert got["e1"] is None and got["e2"] == pytest.approx(900.0)


def test_gravity_rows_sum_to_production(spark):
    t = spark.createDataFrame([(i, -15.0 - i * 0.1, -48.0 + i * 0.07, 100.0 * (i + 1), 50.0 + i) for i in range(8)], "node_id long, lat double, lon double, production double, attraction double")
    od = GR.gravity(GR.impedance(t, Params()))
    got = {r.origin: r.s for r in od.groupBy("origin").agg(F.sum("flow").alias("s")).collect()}
    assert got == {i: pytest.approx(100.0 * (i + 1)) for i in range(8)}


def dijkstra(adj, o):
    best = {o: 0.0}
    todo = [o]
    while todo:
        u = min(todo, key=best.get)
        todo.remove(u)
        for v, c in adj.get(u, ()):
            if best[u] + c < best.get(v, math.inf):
                best[v] = best[u] + c
                todo.append(v)
    return best


def graph(spark, seed, n=12, m=40):
    rng = np.random.default_rng(seed)
    rows = {(int(u), int(v)): float(rng.integers(1, 20)) for u, v in rng.integers(0, n, (m, 2)) if u != v}
    df = spark.createDataFrame([(u, v, f"{u}-{v}", c) for (u, v), c in rows.items()], "src long, dst long, key string, cost double")
    adj = {}
    for (u, v), c in rows.items():
        adj.setdefault(u, []).append((v, c))
    return df, adj


@pytest.mark.parametrize("limit", [0, 1000])
def test_shortest_paths(spark, limit):
    df, adj = graph(spark, 3)
    o = spark.createDataFrame([(0,), (5,), (5,)], "origin long")
    got = {(r.origin, r.node): r.cost for r in A.shortest_paths(df, o, Scratch(spark), limit).collect()}
    assert got == {(s, n): c for s in (0, 5) for n, c in dijkstra(adj, s).items()}


def test_loading_conserves_and_both_ways_agree(spark):
    df, adj = graph(spark, 4)
    od = spark.createDataFrame([(0, 7, 10.0), (0, 3, 5.0), (2, 9, 1.0), (2, 2, 99.0), (4, 77, 3.0)], "origin long, dest long, flow double")
    a = {(r.src, r.dst): r.flow for r in A.all_or_nothing(df, od, Scratch(spark)).collect()}
    b = {(r.src, r.dst): r.flow for r in A.all_or_nothing(df, od, Scratch(spark), 0).collect()}
    assert a == pytest.approx(b)
    net = {}
    for (u, v), f in a.items():
        net[u] = net.get(u, 0) - f
        net[v] = net.get(v, 0) + f
    want = {}
    for o, d, f in ((0, 7, 10.0), (0, 3, 5.0), (2, 9, 1.0)):
        if d in dijkstra(adj, o):
            want[o] = want.get(o, 0) - f
            want[d] = want.get(d, 0) + f
    assert {k: v for k, v in net.items() if abs(v) > 1e-9} == pytest.approx({k: v for k, v in want.items() if v})


def test_merge_sources_labels(spark):
    e = edges(spark, [road(1, 2, vol=5.0, fixed=True), road(1, 3, vol=5.0), road(1, 4), road(1, 5), road(1, 6, d="CONN")]).withColumn("assigned_volume", F.when(F.col("edge_seq") == 2, 7.0))
    got = {r.key: (r.vmd_source, r.volume, r.vc_ratio) for r in A.merge_sources(e).collect()}
    assert got["e0"][0] == "observed" and got["e1"][0] == "propagated" and got["e2"][:2] == ("assigned", 7.0)
    assert got["e3"][0] == "estimated" and got["e3"][1] == pytest.approx(150.0) and got["e4"] == (None, None, None)
    assert got["e3"][2] == pytest.approx(0.15)


def test_clusters_do_not_depend_on_order_and_chain(spark):
    pts = [(i, -15.0 + i * 0.004, -48.0) for i in range(10)] + [(20, 0.0, 0.0)]  # 445 m apart: one chain
    df = spark.createDataFrame([(p, 0, "start", la, lo) for p, la, lo in reversed(pts)], "point_seq long, seg_idx long, endpoint string, lat double, lon double")
    got = {r.point_seq: r.node_id for r in N.cluster_nodes(df, 500.0, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(10)}, 20: 20}


def test_wkt_cases(spark):
    cases = {"LINESTRING (1 2, 3 4)": 2, "LINESTRING Z (1 2 9, 3 4 9, 5 6 9)": 3, "MULTILINESTRING ((1 2, 3 4), (5 6, 7 8))": 4, "LINESTRING (1 2, 3 ": None, "MULTILINESTRING ((1 2, 3 4), (5 6": None, "": None, "nan": None, "LINESTRING EMPTY": None}
    df = spark.createDataFrame(list(cases.items()) + [(None, None)], "w string, n int")
    g = G.from_wkt(F.col("w"))
    for r in df.select("w", "n", F.when(g.isNotNull(), F.size(F.flatten(g["parts"]))).alias("got")).collect():
        assert r.got == r.n, r.w


def test_centroid_and_ends(spark):
    df = spark.createDataFrame([("LINESTRING (0 0, 4 0, 4 2)",)], "w string").select(G.from_wkt(F.col("w")).alias("g"))
    r = df.select(G.centroid(F.col("g")).alias("c"), G.last_point(F.col("g")).alias("l"), G.middle_vertex(F.col("g")).alias("m"), G.to_geojson(F.col("g")).alias("j")).first()
    assert (r.c.x, r.c.y) == (pytest.approx((4 * 2 + 2 * 4) / 6), pytest.approx(2 * 1 / 6))
    assert (r.l.x, r.l.y) == (4.0, 2.0) and (r.m.x, r.m.y) == (4.0, 0.0)
    assert json.loads(r.j)["coordinates"] == [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0]]


def test_simplify_drops_near_points(spark):
    df = spark.createDataFrame([("LINESTRING (0 0, 1 0.0001, 2 0)",)], "w string").select(G.from_wkt(F.col("w")).alias("g"))
    assert json.loads(df.select(G.to_geojson(G.simplified(F.col("g"))).alias("j")).first().j)["coordinates"] == [[0.0, 0.0], [2.0, 0.0]]


def test_counts_traps(spark):
    rows = [
        (0, "DPL", " A ", "2024-01-01", "CRESCENTE", None, 1.0, None, 10.0, 1.0),
        (1, "DPL", "A", "2024-01-02", "DECRESCENTE", 5.0, 2.0, 3, 30.0, None),
        (2, "X", "A", "2024-01-02", "DECRESCENTE", 9.0, 9.0, 9, 99.0, 9.0),
        (3, "DPL", None, "2024-01-02", "DECRESCENTE", 9.0, 9.0, 9, 99.0, 9.0),
        (4, "DPL", "Z", "2024-01-02", "CRESCENTE", None, None, None, None, None),
    ]
    raw = spark.createDataFrame(rows, "row_seq long, origem string, codigo_rodovia string, data string, sentido string, latitude_km_inicial double, longitude_km_inicial double, regional int, passeio double, `2c` double")
    clean = C.cleaned(raw)
    got = {r.sre: r for r in C.segment_totals(clean).collect()}
    assert set(got) == {"A", "Z"} and got["A"].vmd == pytest.approx(20.5)
    assert got["A"].latitude == 5.0 and got["A"].longitude == 1.0 and got["A"].pct_light == pytest.approx(40 / 41)
    assert got["Z"].vmd == 0 and got["Z"].pct_heavy is None
    assert {(r.sre, r.sentido): r.vmd for r in C.daily_volume_directional(clean).collect()}[("A", "CRESCENTE")] == 11.0


def test_geh_symmetric(spark):
    df = spark.createDataFrame([(3.0, 9.0), (0.0, 0.0), (5.0, 5.0)], "a double, b double")
    got = [(r.x, r.y) for r in df.select(S.geh(F.col("a"), F.col("b")).alias("x"), S.geh(F.col("b"), F.col("a")).alias("y")).collect()]
    assert got[0][0] == got[0][1] > 0 and got[1] == (0, 0) and got[2] == (0, 0)


def test_fit_metrics_by_hand(spark):
    rng = np.random.default_rng(3)
    o = rng.integers(100, 9000, 60).astype(float)
    e = o * rng.uniform(0.7, 1.3, 60)
    geh = np.sqrt(2 * (e - o) ** 2 / (e + o))
    df = spark.createDataFrame([(i, f"s{i}", *map(float, x)) for i, x in enumerate(zip(o, e, geh, e - o))], "edge_seq long, sre string, observed double, estimated double, geh double, residual double")
    r = E.fit_metrics(df).first()
    assert r.n_observations == 60 and r.mean_observed == pytest.approx(o.mean()) and r.mean_estimated == pytest.approx(e.mean())
    assert r.rmse == pytest.approx(np.sqrt(((e - o) ** 2).mean())) and r.mae == pytest.approx(np.abs(e - o).mean()) and r.mape == pytest.approx(100 * (np.abs(e - o) / o).mean())
    assert r.r2 == pytest.approx(1 - ((e - o) ** 2).sum() / ((o - o.mean()) ** 2).sum()) and r.geh_pct_under_5 == pytest.approx(100 * (geh < 5).mean())


def test_search_finds_a_minimum():
    best, value = E.differential_evolution(lambda pop: [sum((x[n] - (lo + hi) / 3) ** 2 for n, (lo, hi) in BOUNDS.items()) for x in pop], generations=40, tol=0)
    assert value < 0.05


def test_missing_estimates_are_empty(spark, tmp_path):
    assert files.read_estimates(spark, f"file://{tmp_path}/none.json").count() == 0


def test_whole_estimation_and_files(spark, tmp_path):
    v = fixtures.load(spark, SF)
    seg = files.with_geometry(fixtures.inventory(v).drop("lat_inicial", "lon_inicial", "lat_final", "lon_final"), fixtures.json_geometries(v))
    scratch = Scratch(spark)
    ready = estimate.prepare(fixtures.raw_counts(v), seg, scratch)
    e = estimate.run(ready, Params(propagation_steps=1, fill_sweeps=1, assign_steps=1, max_zones=10), scratch)
    estimate.publish(e, f"file://{tmp_path}/out", {"gravity_gamma": 1.5})
    read = lambda n: json.loads("".join(p.read_text() for p in (tmp_path / "out" / n).glob("part-*")))
    assert len(read("segments.geojson")["features"]) == e.segments.count()
    assert set(read("network_graph.json")) == {"nodes", "edges"}
    assert read("propagation_frames.json")[0]["iteration"] == 0
    assert read("calibration_report.json")["parameters"] == {"gravity_gamma": 1.5}
    assert len(read("gravity_model.json")["zones"]) == 10
    assert e.edges.where("direction <> 'CONN' AND (vmd_source IS NULL OR volume IS NULL)").count() == 0
