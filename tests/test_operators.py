"""Operators on small hand-made frames: nulls, ties, empty tables and the invariants of the domain."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from furrow.functions import scalars as X
from furrow.operators import filters as P
from furrow.operators import geometry as G
from furrow.operators import joins as J
from furrow.operators import metrics as M
from furrow.operators import spatial as S
from furrow.operators.graph import components
from furrow.operators.series import interpolated
from furrow.sources.geopackage import decode_header, encode_box, envelope, rings
from furrow.sources.sheets import header_row


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components_of_chains_stars_and_loops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (None, 1), (2, 1)], "src long, dst long")
    assert rows(components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7)]


def test_components_of_nothing(spark):
    assert rows(components(spark.createDataFrame([], "src long, dst long"))) == []


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {c for _, c in rows(components(edges))} == {0}


@settings(max_examples=5, deadline=None)
@given(pairs=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components_do_not_depend_on_row_order(spark, pairs):
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    named = {x for a, b in pairs if a != b for x in (a, b)}
    got = components(spark.createDataFrame(pairs[::-1], "src long, dst long"))
    assert rows(got) == sorted((x, find(x)) for x in named)


def test_first_reason_takes_the_first_and_skips_null(spark):
    df = spark.createDataFrame([(1.0, None), (None, 5.0), (9.0, 9.0)], "a double, b double")
    got = df.select(P.first_reason([(F.col("a") > 5, "a"), (F.col("b") > 3, "b")]).alias("r"))
    assert [r.r for r in got.collect()] == ["", "b", "a"]


def test_value_map_refuses_unknown_values(spark):
    df = spark.createDataFrame([("x",), ("?",)], "k string")
    with pytest.raises(PySparkException, match="unmapped"):
        df.select(P.value_map(F.col("k"), {"x": 1}, strict=True)).collect()


def test_missing_input_guard(spark):
    share = spark.createDataFrame([(0.5,)], "share double")
    df = spark.range(3)
    assert P.require_present(df, share, 0.6).count() == 3
    with pytest.raises(PySparkException, match="missing input"):
        P.require_present(df, share, 0.4).collect()


def test_left_join_that_would_repeat_rows_fails(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(PySparkException, match="occurs twice"):
        J.unique_left_join(left, right, ["k"]).collect()
    assert rows(J.unique_left_join(left, right.where("v = 'a'"), ["k"]).na.fill("-")) == [(1, "a"), (2, "-")]


def test_boxes_and_pixels_agree(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 4, 3), (2, 2, 1, 6, 5), (3, -20, -20, -18, -15)], "poly_id long, x0 long, y0 long, x1 long, y1 long")
    px = G.pixels(boxes)
    by_box = S.box_pairs(boxes, boxes, cell=4, condition=F.col("a_poly_id") < F.col("b_poly_id")).select("a_poly_id", "b_poly_id", "inter_px")
    by_px = G.overlaps(px, px, "poly_id", "poly_id", F.col("a_poly_id") < F.col("b_poly_id"))
    assert rows(by_box) == rows(by_px) == [(1, 2, 4)]
    shape = {r.poly_id: r for r in G.shape(px).collect()}
    assert shape[1].perimeter_m == 140 and abs(shape[1].compactness - 14 / 12**0.5) < 1e-9
    assert rows(G.areas(G.eroded(px)))[0] == (1, 2)
    assert {r.poly_id for r in G.eroded_or_whole(px).collect()} == {1, 2, 3}


def test_union_area_is_at_most_the_sum_and_iou_is_symmetric(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 5, 5), (2, 1, 1, 7, 4)], "poly_id long, x0 long, y0 long, x1 long, y1 long")
    px = G.pixels(boxes)
    assert G.union(px.withColumn("g", F.lit(1)), "g").count() <= px.count()
    both = G.with_areas(G.overlaps(px, px, "poly_id", "poly_id", F.col("a_poly_id") != F.col("b_poly_id")), G.areas(px), G.areas(px)).collect()
    assert both[0].iou == both[1].iou and all(r.contain >= r.iou for r in both)


def test_parts_over_blocks_match_a_flood_fill_and_join_few_pixels(spark, monkeypatch):
    from furrow.operators import graph

    rng = random.Random(3)
    cells = {(g, x, y) for g in (None, -5, 7) for x in range(-20, 20) for y in range(-15, 15) if rng.random() < 0.6}
    cells |= {(7, x, 100) for x in range(-300, 300)}
    left, want = set(cells), []
    while left:
        todo, n = [left.pop()], 0
        g = todo[0][0]
        while todo:
            _, x, y = todo.pop()
            n += 1
            for near in ((g, x + 1, y), (g, x - 1, y), (g, x, y + 1), (g, x, y - 1)):
                if near in left:
                    left.remove(near)
                    todo.append(near)
        want.append((g or 0, n))
    seen = []
    whole = graph.components
    monkeypatch.setattr(graph, "components", lambda edges: seen.append(edges.count()) or whole(edges))
    monkeypatch.setattr(G, "BLOCK", 256)
    px = spark.createDataFrame(sorted(cells, key=str), "g long, px long, py long").repartition(5)
    got = [(r.g or 0, r.n_px) for r in G.parts(px.unionAll(px), "g").collect()]
    assert sorted(got) == sorted(want)
    assert seen[0] < 200 < len(cells)


def test_coverage_by_others_joins_no_pairs_of_pixels(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 4, 4), (2, 2, 0, 6, 4), (3, 2, 0, 4, 2), (4, 250, 250, 262, 252)], "poly_id long, x0 long, y0 long, x1 long, y1 long")
    px = G.pixels(boxes)
    got = G.coverage(px, px.select(F.col("poly_id").alias("own"), "px", "py"))
    assert {r.poly_id: (r.n_px, r.n_covered) for r in got.collect()} == {1: (16, 8), 2: (16, 8), 3: (4, 4), 4: (24, 0)}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_means_of_blocks_do_not_depend_on_the_order_of_rows(spark):
    cells = spark.createDataFrame([(i, 0, 0.8 if i < 183 else 0.3) for i in range(192)], "px long, py long, v double").coalesce(1)
    for order in (F.col("px"), F.col("px").desc(), F.xxhash64("px")):
        assert G.resample(cells.orderBy(order), "v", 200).first()["mean"] == 0.7765625
    odd = spark.createDataFrame([(0, 0, 1e300), (1, 0, 1e300), (9, 0, float("inf"))], "px long, py long, v double")
    assert sorted(r["mean"] for r in G.resample(odd, "v", 5).collect()) == [1e300, float("inf")]


def test_parts_of_two_islands_and_a_corner_touch(spark):
    px = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 9, 9)], "g long, px long, py long")
    assert sorted(r.n_px for r in G.parts(px, "g").collect()) == [1, 1, 2]


def test_gaps_are_filled_on_lines_and_flat_at_the_ends(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, 4.0), (1, 4, None), (2, 0, None)], "k int, m int, v double")
    assert [r.v for r in interpolated(df, ["v"], "k", "m").orderBy("k", "m").collect()] == [2.0, 2.0, 3.0, 4.0, 4.0, None]


def test_auc_of_ties_and_of_too_few(spark):
    df = spark.createDataFrame([(1, 0.5, i < 4) for i in range(8)] + [(2, 0.1, True)], "k int, s double, y boolean")
    assert rows(M.auc(df, "s", "y", ["k"]).select("k", "auc").na.fill(-1.0)) == [(1, 0.5), (2, -1.0)]


def test_wilson_of_no_trials_is_null(spark):
    got = spark.createDataFrame([(0, 0), (5, 10)], "k int, n int").select(*M.wilson(F.col("k"), F.col("n"))).collect()
    assert tuple(got[0]) == (None, None) and 0 < got[1][0] < 0.5 < got[1][1] < 1


def test_names_and_dates(spark):
    df = spark.createDataFrame([("nsw_a_2019_r3c4", "2020–21", "01:02:03"), ("bad", "total", "00:00:09")], "s string, y string, t string")
    got = df.select(*(c.alias(n) for n, c in X.stub_parts(F.col("s")).items()), X.crop_year(F.col("y")).alias("cy"), X.clock_seconds(F.col("t")).alias("sec")).collect()
    assert tuple(got[0]) == ("nsw_a", "2019", "r3c4", 2020, 3723)
    assert tuple(got[1]) == ("", "", "", None, 9)


def test_geopackage_blob_round_trip():
    blob = encode_box(1, 2, 5, 9)
    assert decode_header(blob) == (3577, (1.0, 2.0, 5.0, 9.0), 40)
    assert rings(blob) == [[(1, 2), (5, 2), (5, 9), (1, 9), (1, 2)]]
    bare = b"GP" + bytes([0, 1]) + blob[4:8] + blob[40:]
    assert decode_header(bare)[1] is None and envelope(bare) == (1, 2, 5, 9)
    with pytest.raises(ValueError):
        decode_header(b"XX000000")


def test_header_row_needs_seasons():
    with pytest.raises(ValueError):
        header_row([["a", "2019-20"]])


def test_nearest_other_label_at_all_distances(spark):
    import math

    pts = [(1, 2020, 0, 140.0, -30.0), (2, 2020, 1, 140.001, -30.0), (3, 2020, 0, 115.0, -39.0), (4, 2021, 0, 140.0, -30.0), (5, 2020, 1, 117.9, -39.0), (6, 2020, 0, 150.0, -20.0)]
    df = spark.createDataFrame(pts, "k int, yr int, crop int, lon double, lat double")

    def metres(a, b):
        la, lb = math.radians(a[4]), math.radians(b[4])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371000.0 * math.asin(math.sqrt(h))

    want = {a[0]: min((metres(a, b) for b in pts if a[1] == b[1] and a[2] != b[2]), default=None) for a in pts}
    got = {r.k: r.nearest_m for r in S.nearest_different(df, "k", "yr", "crop").collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-3 for k in want)


def test_albers_keeps_the_axis_and_areas(spark):
    """The central meridian is the y axis, and a small cell keeps its ellipsoidal area."""
    d = 0.01
    corners = [(140.0, -30.0), (140.0 + d, -30.0), (140.0 + d, -30.0 - d), (140.0, -30.0 - d), (132.0, -25.0)]
    df = spark.createDataFrame(corners, "lon double, lat double")
    xy = [tuple(r) for r in df.select(*X.albers(F.col("lon"), F.col("lat"))).collect()]
    area = abs(sum(xy[i][0] * xy[(i + 1) % 4][1] - xy[(i + 1) % 4][0] * xy[i][1] for i in range(4))) / 2
    want = df.select(X.ellipsoid_cell_area(F.col("lat"), d).alias("a")).first().a
    assert abs(xy[4][0]) < 1e-6 and abs(area / want - 1) < 1e-4


def test_claims_are_kept_in_order(spark):
    rows = [(1, 10, "Canola", 5), (2, 10, "Cereal", 5), (2, 11, "Cereal", 6), (3, 12, "Canola", 5)]
    df = spark.createDataFrame([(0, t, k, p) for t, _, k, p in rows], "aoi int, trial long, kind string, poly long")
    got = J.claim_matching(df, ["aoi"], ["trial", "poly"], "trial", "poly", "kind", "aoi int, trial long, kind string, poly long")
    assert {r.trial: r.poly for r in got.collect()} == {1: 5, 2: 6, 3: 5}


def test_greedy_choice_keeps_its_distance_and_groups(spark):
    from furrow.operators.sampling import greedy_apart, row_index

    df = spark.createDataFrame([(1, 9.0, 0.0, 0.0, "a"), (2, 8.0, 1.0, 0.0, "b"), (3, 7.0, 9.0, 0.0, "a"), (4, 6.0, 9.0, 9.0, "c"), (5, 6.0, 20.0, 0.0, "d")], "k int, s double, x double, y double, g string")
    assert [r["k"] for r in greedy_apart(df, "s", "k", "x", "y", "g", 5.0, 3)] == [1, 4, 5]
    assert sorted((r.k, r.row_index) for r in row_index(df.repartition(3), "k").collect()) == [(i + 1, i) for i in range(5)]
    assert row_index(df.where("false"), "k").count() == 0


def test_greedy_choice_goes_on_after_a_hot_site(spark):
    """The best 1,500 rows are one site's; the next ones lie close to it or to each other."""
    from furrow.operators.sampling import greedy_apart

    rows = [(i, 9000.0 - i, 0.0, 0.0, 0) for i in range(1500)] + [(2000 + i, 5000.0 - i, i * 0.01, 50.0, 1 + i) for i in range(1500)] + [(4000, 1.0, 90.0, 0.0, 9999)]
    df = spark.createDataFrame(rows, "k long, s double, x double, y double, g long")
    want: list = []
    for r in sorted(rows, key=lambda r: -r[1]):
        if all((r[2] - c[2]) ** 2 + (r[3] - c[3]) ** 2 >= 25 and r[4] != c[4] for c in want):
            want.append(r)
    for k in (2, 4, 50):
        assert [r["k"] for r in greedy_apart(df, "s", "k", "x", "y", "g", 5.0, k)] == [r[0] for r in want[:k]]


def test_two_sided_p_of_rank_sums(spark):
    got = spark.createDataFrame([(50.0, 10, 10), (23.0, 10, 10), (0.0, 10, 10)], "u double, n int, m int").select(M.mann_whitney_p(F.col("u"), F.col("n"), F.col("m")).alias("p")).collect()
    assert got[0].p == pytest.approx(1.0, abs=1e-6) and got[1].p == pytest.approx(0.0413, abs=1e-3) and got[2].p < 2e-4
