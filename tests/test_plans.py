"""Plans that scale: what is pushed down, how often rows are dealt, and which joins must not appear."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from furrow.functions import indices as X
from furrow.operators import geometry as G
from furrow.operators import identity as I
from furrow.operators import merge as M
from furrow.operators import series as S
from furrow.operators import spatial as J
from furrow.operators.graph import _least
from furrow.plans.catalog import Tables
from furrow.plans.registry import QUERIES
from furrow.sources.files import within_bbox
from tests.conftest import SF


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def dealt(text: str) -> list[str]:
    return re.findall(r"Arguments: (hashpartitioning\([^)]*\))", text)


def sent_whole(df) -> list[str]:
    """The plan below every broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    deep = lambda line: len(line) - len(line.lstrip(" :+-"))
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = lines[i + 1 :]
            end = next((k for k, x in enumerate(below) if deep(x) <= deep(line)), len(below))
            out.append("\n".join(below[:end]))
    return out


def test_box_filters_reach_the_parquet_scan(spark, tmp_path):
    path = str(tmp_path / "boxes.parquet")
    spark.range(10).select("id", F.struct(F.col("id").alias("xmin"), F.col("id").alias("xmax"), F.col("id").alias("ymin"), F.col("id").alias("ymax")).alias("bbox"), F.lit("x").alias("heavy")).write.parquet(path)
    text = plan(within_bbox(spark.read.parquet(path), 2, 2, 5, 5).select("id"))
    assert "LessThanOrEqual(bbox.xmin" in text and "GreaterThanOrEqual(bbox.ymax" in text
    assert "heavy" not in text.split("ReadSchema")[1].split("\n")[0]


def test_features_of_a_series_deal_the_rows_once(spark):
    text = plan(S.feature_table(Tables(spark, SF).ts, {"ndvi": X.ndvi()}))
    assert len(dealt(text)) == 1 and "trial_id" in dealt(text)[0]


def test_scans_read_only_the_columns_they_need(spark):
    text = plan(S.clear_season(Tables(spark, SF).ts))
    schema = re.search(r"ReadSchema: (\S+)", text)[1]
    assert "l_discount" not in schema and "l_returnflag" not in schema


@pytest.mark.parametrize("name", ["j14_overlap_pairs", "j15_cross_tile_pairs", "j11_point_in_polygon", "j13_intersects_aoi", "j18_match_other_years", "j19_nearest_within", "j22_nearest_different_crop", "j27_neighbour_join", "c16_map_versus_map", "c20_cross_year_repair"])
def test_spatial_joins_are_equi_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_pairs_need_no_distinct(spark):
    boxes = Tables(spark, SF).poly.select("poly_id", "x0", "y0", "x1", "y1")
    assert "HashAggregate" not in plan(J.box_pairs(boxes, boxes))


def test_overlaps_count_before_they_shuffle_pairs(spark):
    px = Tables(spark, SF).px.select("poly_id", "px", "py")
    assert "partial_count" in plan(G.overlaps(px, px, "poly_id", "poly_id")).lower()


@pytest.mark.parametrize("name", ["c1_wall_to_wall_classify", "c2_feature_builder", "c13_regional_comparison", "c30_window_placement_scan", "a32_rank_auc", "a42_bootstrap_rows", "c3_away_decisions", "c12_consensus"])
def test_hot_paths_hold_no_python(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(QUERIES[name](spark, SF)))


def test_rounds_of_components_without_hubs_join_nothing(spark):
    edges = spark.createDataFrame([(3, 1), (3, 2)], "u long, v long")
    assert "Join" not in plan(_least(edges, 2, False))


def test_consensus_takes_one_join_of_identities(spark):
    members = spark.createDataFrame([], "paddock_id long, yr int, id long, area_ha double, crop string, conf double")
    text = plan(I.consensus(members, [2017, 2018]))
    assert len(set(re.findall(r"\((\d+)\) \w*Join", text))) == 1


def test_pairs_to_unite_need_no_components(spark, monkeypatch):
    monkeypatch.setattr(M, "components", lambda edges: pytest.fail("components of pairs that nobody asked to unite"))
    assert "decision" in QUERIES["c4_union_pairs"](spark, SF).columns


def test_overlap_groups_read_pixels_once(spark):
    # The pieces of polygons are kept; what comes after them makes no pixels again.
    assert "sequence(" not in plan(QUERIES["c6_overlap_groups"](spark, SF))


#: Queries over exploded pixels, cells or years, whose estimated size is that of the rows before.
DEALT = [
    "c18_seam_audit",
    "c3_away_decisions",
    "c4_union_features",
    "c4_union_pairs",
    "j18_match_other_years",
    "g12_difference_area",
    "g28_tree_fraction",
    "j11_point_in_rings",
    "j20_nearest_with_upgrade",
    "c20_cross_year_repair",
    "c19_cut_continuity",
    "c10_stability_report",
    "c12_consensus",
    "c11_rotation_plausibility",
    "c37_flat_attribute_table",
    "c8_constrained_identity",
    "c9_stability",
]


@pytest.mark.parametrize("name", DEALT)
def test_exploded_rows_are_never_broadcast(spark, name):
    assert not [x for x in sent_whole(QUERIES[name](spark, SF)) if "Generate" in x or "p_partkey" in x and "Aggregate" not in x]
