"""Invariants of merges, identity and grafts on small hand-made maps."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from furrow.operators import geometry as G
from furrow.operators import identity as I
from furrow.operators import merge as M
from furrow.operators import spatial as S

_SCHEMA = "poly_id long, kx long, ky long, x0 long, y0 long, x1 long, y1 long, pred string, abstain_reason string, p_canola double, p_cereal double, p_legume double"


def field_map(spark, boxes):
    """Polygons from (id, kx, ky, x0, y0, x1, y1, class, reason) with probabilities that favour the class."""
    rows = []
    for *box, pred, reason in boxes:
        p = {"Canola": 0.2, "Cereal": 0.2, "Legume": 0.2} | {pred: 0.6}
        rows.append((*box, pred, reason, p["Canola"], p["Cereal"], p["Legume"]))
    df = spark.createDataFrame(rows, _SCHEMA)
    return df.withColumn("area_ha", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * G.HA_PER_PIXEL)


def decisions(df, px, **options):
    return {r.fid: (r.decision, r.reason) for r in M.away_decisions(df, px, **options).collect()}


def test_away_polygons_are_rescued_dropped_or_united(spark):
    df = field_map(spark, [
        (1, 0, 0, 22, 2, 30, 10, "Canola", ""),      # away, nobody holds its ground
        (2, 0, 0, 21, 12, 29, 18, "Cereal", ""),     # away, the owner holds it all
        (3, 1, 0, 20, 11, 31, 19, "Cereal", ""),
        (4, 0, 1, 22, 22, 32, 30, "Legume", ""),     # away, its twin holds most of it
        (5, 1, 1, 24, 22, 36, 30, "Legume", ""),
        (6, 0, 2, 22, 42, 32, 50, "Canola", "no_crop_signal"),
        (7, 1, 2, 24, 42, 36, 50, "Canola", ""),
    ])
    got = decisions(df, G.pixels(df))
    assert got == {1: ("rescue", "uncovered"), 2: ("drop_duplicate", "fully_covered"), 4: ("union_into_twin", "same_class"), 6: ("drop_partial", "not_both_classified")}


def test_classes_that_disagree_surely_are_not_united(spark):
    df = field_map(spark, [(4, 0, 0, 22, 2, 32, 10, "Legume", ""), (5, 1, 0, 24, 2, 36, 10, "Canola", "")])
    assert decisions(df, G.pixels(df))[4] == ("union_into_twin", "class_conflict_reconciled")
    assert decisions(df, G.pixels(df), conflict_pmin=0.3)[4] == ("drop_partial", "conflict_confident_disagreement")


def test_overlap_groups_leave_no_overlap_and_lose_no_ground(spark):
    rng = random.Random(8)
    boxes = []
    for i in range(60):
        x, y = rng.randint(0, 60), rng.randint(0, 60)
        boxes.append((i, 0, 0, x, y, x + rng.randint(3, 9), y + rng.randint(3, 9), rng.choice(M.CLASSES), rng.choice(["", None, "no_crop_signal"])))
    df = field_map(spark, boxes)
    px = G.pixels(df)
    out = M.overlap_groups(df, px, more_than_px=0)
    folded = sum(r.merge_n - 1 for r in out.collect())
    assert out.count() == df.count() - folded
    ground = px.select("px", "py").distinct().count()
    assert abs(sum(r.area_ha for r in out.collect()) - ground * G.HA_PER_PIXEL) < 1e-6


def test_pieces_of_overlapping_polygons_hold_every_pixel_once(spark):
    rng = random.Random(5)
    edge = G.BLOCK
    boxes = []
    for i in range(40):
        x, y = rng.choice([-edge, -9, 0, edge - 6]) + rng.randint(0, 12), rng.randint(-12, 12)
        boxes.append((i % 37, x, y, x + rng.randint(1, 9), y + rng.randint(1, 9)))
    px = G.pixels(spark.createDataFrame(boxes, "poly_id long, x0 long, y0 long, x1 long, y1 long"))
    here: dict = {}
    for r in px.collect():
        here.setdefault((r.px, r.py), set()).add(r.poly_id)
    want = Counter(tuple(sorted(v)) for v in here.values())
    got = Counter()
    for r in G.stacks(px).collect():
        got[tuple(r["keys"])] += r["n"]
    assert got == want and max(map(len, want)) > 2


def test_groups_over_the_largest_area_abstain(spark):
    df = field_map(spark, [(1, 0, 0, 0, 0, 10, 10, "Canola", ""), (2, 0, 0, 5, 0, 15, 10, "Cereal", ""), (3, 0, 0, 40, 40, 44, 44, "Cereal", "")])
    got = {r.poly_id: (r.merge_n, r.merged_from, r.pred, r.abstain_reason) for r in M.overlap_groups(df, G.pixels(df), max_ha=1.2).collect()}
    assert got == {1: (2, "2", None, "unsegmented_blob"), 3: (1, "", "Cereal", "")}


def test_contested_pixels_go_to_the_owner_and_only_once(spark):
    df = field_map(spark, [(1, 0, 0, 10, 0, 22, 10, "Canola", ""), (2, 1, 0, 18, 0, 30, 10, "Canola", "")])
    got = {r.poly_id: r for r in M.clipped(df, G.pixels(df)).collect()}
    assert got[1].left_px + got[2].left_px == 200 and got[1].lost_px == 20 and got[2].lost_px == 20


def test_a_cut_polygon_is_made_whole_from_another_year(spark):
    whole = spark.createDataFrame([(1, 0, 0, 12, 10)], "poly_id long, x0 long, y0 long, x1 long, y1 long")
    cut = whole.withColumn("x1", F.lit(9).cast("long"))
    donors = whole.withColumn("rank", F.lit(1))
    got = M.grafts(cut, G.pixels(cut), donors, G.pixels(donors)).first()
    assert (got.reason, got.added_px, got.donor_rank) == ("repaired", 30, 1)
    far = donors.withColumn("x0", F.lit(100).cast("long")).withColumn("x1", F.lit(110).cast("long"))
    assert M.grafts(cut, G.pixels(cut), far, G.pixels(far)).first().reason == "no_donor_overlap"


def test_identity_over_years_and_unmatched_years_count_as_zero(spark):
    polygons = spark.createDataFrame([(1, 2017), (1, 2018), (2, 2018)], "poly_id long, yr int")
    pairs = spark.createDataFrame([(1, 2017, 1, 2018, 0.9), (1, 2018, 1, 2017, 0.9), (1, 2017, 2, 2018, 0.1), (2, 2018, 1, 2017, 0.1)], "a long, yr int, b long, other int, iou double")
    got = {(r.a, r.yr): r for r in I.stability(pairs, polygons, [2017, 2018, 2019]).collect()}
    assert got[1, 2017].paddock_id == got[1, 2018].paddock_id != got[2, 2018].paddock_id
    assert got[1, 2017].median_iou == 0.45 and got[2, 2018].n_years == 0 and got[2, 2018].mean_iou_hits is None


def test_a_polygon_given_twice_matches_each_year_once(spark):
    polygons = spark.createDataFrame([(1, 2017), (1, 2017), (1, 2018)], "poly_id long, yr int")
    pairs = spark.createDataFrame([(1, 2017, 1, 2018, 0.9), (1, 2018, 1, 2017, 0.9)], "a long, yr int, b long, other int, iou double")
    got = {(r.a, r.yr): (r.n_years, r.median_iou, r.mean_iou_hits) for r in I.stability(pairs, polygons, [2017, 2018, 2019]).collect()}
    assert got == {(1, 2017): (1, 0.45, 0.9), (1, 2018): (1, 0.45, 0.9)}


def test_the_crop_of_most_years_is_the_first_by_name_of_ties(spark):
    rows = [(1, 2017, 5, 1.0, "Legume", 0.5), (1, 2018, 5, 1.0, "Canola", 0.5), (2, 2017, 6, 1.0, "Canola", 0.5), (2, 2018, 6, 1.0, "Legume", 0.5), (2, 2019, 6, 1.0, "Legume", 0.5)]
    members = spark.createDataFrame(rows, "paddock_id long, yr int, id long, area_ha double, crop string, conf double")
    assert {r.paddock_id: r.modal_crop for r in I.consensus(members, [2017, 2018, 2019]).collect()} == {1: "Canola", 2: "Legume"}


def test_constrained_groups_refuse_what_grows_too_far(spark):
    boxes = spark.createDataFrame([(i, 0, 8 * i, 0, 8 * i + 10, 10, 100) for i in range(4)], "id long, region int, x0 long, y0 long, x1 long, y1 long, area long")
    pairs = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.8), (2, 3, 0.7)], "a long, b long, iou double")
    got = dict(I.constrained_groups(pairs, boxes, "region", max_diagonal=22, max_ratio=2).collect())
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}


def test_nearest_box_prefers_the_holder_then_the_nearer(spark):
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 12.0, 5.0), (3, 90.0, 90.0)], "p long, x double, y double")
    boxes = spark.createDataFrame([(7, 0, 0, 10, 10), (8, 15, 0, 20, 10)], "b long, x0 long, y0 long, x1 long, y1 long")
    got = {r.p: (r.b, r.dist) for r in S.nearest_box(points, boxes, "p", "b", 5.0).collect()}
    assert got == {1: (7, 0.0), 2: (7, 2.0)}
