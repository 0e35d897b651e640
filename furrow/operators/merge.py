"""Removing duplicates between tiles: away polygons, unions, clips and overlap groups.

All of it works on pixel sets, and every decision is taken on the geometries as they came in, so
that no result depends on an order of rows; where several views of one field meet, the components of
their links are united at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furrow.operators import geometry as G
from furrow.operators.graph import components
from furrow.session import cut

CLASSES = ("Canola", "Cereal", "Legume")


def reconciled(a: str, b: str) -> dict[str, Column]:
    """Winner, its least probability and the verdict of the class rule for two views with columns a_*, b_*."""
    w = {c: (F.col(f"{a}_area") * F.col(f"{a}_p_{c.lower()}") + F.col(f"{b}_area") * F.col(f"{b}_p_{c.lower()}")) / (F.col(f"{a}_area") + F.col(f"{b}_area")) for c in CLASSES}
    best = F.greatest(*(F.round(x, 9) for x in w.values()))
    winner = F.coalesce(*(F.when(F.round(x, 9) == best, F.lit(c)) for c, x in w.items()))
    least = F.coalesce(*(F.when(winner == c, F.least(F.col(f"{a}_p_{c.lower()}"), F.col(f"{b}_p_{c.lower()}"))) for c in CLASSES))
    return {"winner": winner, "pmin": least}


def class_rule(a: str, b: str, winner: Column, pmin: Column, conflict_pmin: float) -> Column:
    """same_class, class_conflict_reconciled, or why two classes can't be merged."""
    p, q = F.col(f"{a}_pred"), F.col(f"{b}_pred")
    return (
        F.when(p == q, "same_class")
        .when((winner != p) & (winner != q), "conflict_no_majority_class")
        .when(pmin < conflict_pmin, "conflict_confident_disagreement")
        .otherwise("class_conflict_reconciled")
    )


def _said(decision: str, reason: Column | str) -> Column:
    return F.struct(F.lit(decision).alias("d"), (F.lit(reason) if isinstance(reason, str) else reason).alias("r"))


_MERGEABLE = ("same_class", "class_conflict_reconciled")


def with_home(poly: DataFrame, size: int = 20) -> DataFrame:
    """Polygons with the cell that owns their centre, and whether that is another than their own."""
    hx, hy = F.floor((F.col("x0") + F.col("x1")) / 2.0 / size), F.floor((F.col("y0") + F.col("y1")) / 2.0 / size)
    return G.dealt(poly).withColumns({"home_kx": hx, "home_ky": hy, "away": (hx != F.col("kx")) | (hy != F.col("ky")), "reason": F.coalesce("abstain_reason", F.lit(""))})


def _pairs(px_a: DataFrame, px_b: DataFrame) -> DataFrame:
    return G.overlaps(px_a.select("poly_id", "px", "py"), px_b.select("poly_id", "px", "py"), "poly_id", "poly_id", F.col("a_poly_id") != F.col("b_poly_id"))


def _union_shape(pairs: DataFrame, px: DataFrame) -> DataFrame:
    """Compactness of the union of each pair (a, b)."""
    both = pairs.select(F.concat_ws(":", "a", "b").alias("pair"), F.explode(F.array("a", "b")).alias("poly_id"))
    joined = both.join(px.select("poly_id", "px", "py"), "poly_id").select("pair", "px", "py").distinct()
    edges = sum((F.col(c).cast("int") for c in ("left", "right", "below", "above")), F.lit(0))
    return G.exposed(joined, "pair").groupBy("pair").agg(F.count("*").alias("union_px"), (F.sum(edges) / F.sqrt(F.count("*").cast("double"))).alias("union_comp"))


def _attributes(poly: DataFrame, prefix: str) -> DataFrame:
    cols = ["pred", "reason", "p_canola", "p_cereal", "p_legume", "kx", "ky"]
    return poly.select(F.col("poly_id").alias(f"{prefix}_id"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double").alias(f"{prefix}_area"), *(F.col(c).alias(f"{prefix}_{c}") for c in cols))


def away_decisions(poly: DataFrame, px: DataFrame, cover_min: float = 0.5, dup_full: float = 0.95, dup_frac: float = 0.6, max_ha: float = 300, max_comp: float = 8, conflict_pmin: float = 0.15, decided: tuple[str, ...] = ("", "no_crop_signal")) -> DataFrame:
    """One decision per polygon that lies in a tile other than the one it came from.

    rescue where the owner's polygons leave it uncovered, drop_duplicate where they cover it, else
    union_into_twin if the polygon it shares most with may take it in, or drop_partial with a reason.
    A classified view is held only against owners that were decided.
    """
    rows = with_home(poly)
    away, kept = rows.where("away"), rows.where(~F.col("away"))
    a, b = _attributes(away, "a"), _attributes(kept, "b")
    met = _pairs(px.join(away.select("poly_id"), "poly_id", "left_semi"), px.join(kept.select("poly_id"), "poly_id", "left_semi"))
    met = met.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id")).where((F.col("a_reason") != "") | F.col("b_reason").isin(*decided))
    cover = (
        px.join(met.select(F.col("a").alias("poly_id"), F.col("b").alias("cover_id")), "poly_id")
        .join(px.select(F.col("poly_id").alias("cover_id"), "px", "py"), ["cover_id", "px", "py"], "left_semi")
        .select("poly_id", "px", "py").distinct().groupBy(F.col("poly_id").alias("a")).agg(F.count("*").alias("covered"))
    )
    best = Window.partitionBy("a").orderBy(F.col("inter_px").desc(), "b")
    twin = met.withColumn("_rn", F.row_number().over(best)).withColumn("n_covering", F.count("*").over(Window.partitionBy("a"))).where("_rn = 1")
    shape = _union_shape(twin, px)
    rule = reconciled("a", "b")
    twin = twin.withColumns(rule).withColumn("pair", F.concat_ws(":", "a", "b")).join(shape, "pair", "left")
    full = a.join(twin.drop(*a.columns), F.col("a_id") == F.col("a"), "left").drop("a").join(cover, F.col("a_id") == F.col("a"), "left")
    coverage = F.coalesce("covered", F.lit(0)) / F.col("a_area")
    frac = F.col("inter_px") / F.col("a_area")
    why = class_rule("a", "b", F.col("winner"), F.col("pmin"), conflict_pmin)
    both = (F.col("a_reason") == "") & (F.col("b_reason") == "")
    decision = (
        F.when(coverage < cover_min, _said("rescue", "uncovered"))
        .when(F.col("b").isNull(), _said("drop_partial", "no_twin_no_rescue"))
        .when(coverage >= dup_full, _said("drop_duplicate", "fully_covered"))
        .when(~both, _said("drop_partial", "not_both_classified"))
        .when(frac < dup_frac, _said("drop_partial", "no_single_twin"))
        .when(F.col("union_px") * G.HA_PER_PIXEL > max_ha, _said("drop_partial", "union_over_max_area"))
        .when(F.col("union_comp") > max_comp, _said("drop_partial", "union_over_max_compactness"))
        .when(why.isin(*_MERGEABLE), _said("union_into_twin", why))
        .otherwise(_said("drop_partial", why))
    )
    return full.withColumn("_d", decision).select(
        F.col("a_id").alias("fid"), F.coalesce("n_covering", F.lit(0)).alias("n_covering"), coverage.alias("coverage"), F.col("b").alias("twin_fid"), frac.alias("twin_frac"),
        (F.col("inter_px") / (F.col("a_area") + F.col("b_area") - F.col("inter_px"))).alias("twin_iou"), F.col("_d.d").alias("decision"), F.col("_d.r").alias("reason"),
        F.when(F.col("_d.d").isin("drop_partial", "drop_duplicate"), F.col("a_area") * G.HA_PER_PIXEL * (1 - coverage)).otherwise(0.0).alias("lost_ha"),
    )


def union_pairs(poly: DataFrame, px: DataFrame, ovl_min: float = 0.5, max_ha: float = 300, max_comp: float = 8, conflict_pmin: float = 0.15) -> DataFrame:
    """Pairs of polygons of different tiles with a decision each."""
    rows = with_home(poly).where(~F.col("away"))
    own = px.join(rows.select("poly_id"), "poly_id", "left_semi")
    a, b = _attributes(rows, "a"), _attributes(rows, "b")
    met = _pairs(own, own).where("a < b").join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id")).where("a_kx <> b_kx or a_ky <> b_ky")
    met = met.withColumns(reconciled("a", "b")).withColumn("pair", F.concat_ws(":", "a", "b"))
    met = met.join(_union_shape(met, px), "pair")
    small = F.col("inter_px") / F.least("a_area", "b_area")
    why = class_rule("a", "b", F.col("winner"), F.col("pmin"), conflict_pmin)
    decision = (
        F.when(small < ovl_min, _said("leave", "sliver_below_ovl_min"))
        .when((F.col("a_reason") != "") | (F.col("b_reason") != ""), _said("leave", "not_both_classified"))
        .when(F.col("union_px") * G.HA_PER_PIXEL > max_ha, _said("leave", "union_over_max_area"))
        .when(F.col("union_comp") > max_comp, _said("leave", "union_over_max_compactness"))
        .when(why.isin(*_MERGEABLE), _said("merge", why))
        .otherwise(_said("leave", why))
    )
    return met.withColumn("_d", decision).select("a", "b", "inter_px", small.alias("ovl_small"), "union_comp", F.col("winner").alias("merged_class"), F.col("pmin").alias("pmin_winner"), F.col("_d.d").alias("decision"), F.col("_d.r").alias("reason"))


def union_merges(poly: DataFrame, px: DataFrame, ovl_min: float = 0.5, max_ha: float = 300, max_comp: float = 8, conflict_pmin: float = 0.15, max_n: int = 4) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``union_pairs``, and the merged features of accepted components."""
    rows = with_home(poly).where(~F.col("away"))
    pairs = union_pairs(poly, px, ovl_min, max_ha, max_comp, conflict_pmin)
    named = G.dealt(components(pairs.where("decision = 'merge'").select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    members = named.join(rows, F.col("node") == F.col("poly_id"))
    area = F.col("area_ha")
    summed = members.groupBy("component").agg(
        F.count("*").alias("merge_n"), F.concat_ws(";", F.array_sort(F.collect_list(F.col("poly_id")))).alias("merged_from_fid"), F.sum(area).alias("frag_area_ha"), F.count_distinct("pred").alias("n_classes"),
        *((F.sum(area * F.col(f"p_{c.lower()}")) / F.sum(area)).alias(f"p_{c.lower()}") for c in CLASSES), *(F.min(f"p_{c.lower()}").alias(f"m_{c.lower()}") for c in CLASSES), F.collect_set("pred").alias("preds"),
    )
    best = F.greatest(*(F.round(f"p_{c.lower()}", 9) for c in CLASSES))
    summed = summed.withColumn("pred", F.coalesce(*(F.when(F.round(f"p_{c.lower()}", 9) == best, F.lit(c)) for c in CLASSES)))
    pmin = F.coalesce(*(F.when(F.col("pred") == c, F.col(f"m_{c.lower()}")) for c in CLASSES))
    ground = G.union(named.join(px.select(F.col("poly_id").alias("node"), "px", "py"), "node"), "component").groupBy("component").agg((F.count("*") * G.HA_PER_PIXEL).alias("area_ha"))
    conflict = (F.col("n_classes") > 1) & (~F.array_contains("preds", F.col("pred")) | (pmin < conflict_pmin))
    kept = (F.col("merge_n") <= max_n) & (F.col("area_ha") <= max_ha) & ~conflict
    merged = summed.join(ground, "component").where(kept).select("component", "merge_n", "merged_from_fid", "frag_area_ha", "area_ha", "pred", (F.col("n_classes") > 1).alias("class_conflict"))
    return pairs, merged


def clipped(poly: DataFrame, px: DataFrame, max_frac: float = 0.5, size: int = 20) -> DataFrame:
    """Every contested pixel goes to the polygon of the tile that owns it, else to the larger one.

    The winner of a pixel is decided pixel by pixel, so the result does not depend on the order of
    pairs; a polygon that would lose more than a share of its area keeps all of it.
    """
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    cells = px.select("poly_id", "px", "py").join(poly.select("poly_id", "kx", "ky", area.alias("n_px")), "poly_id")
    owns = (F.floor(F.col("px") / size) == F.col("kx")) & (F.floor(F.col("py") / size) == F.col("ky"))
    w = Window.partitionBy("px", "py").orderBy(owns.desc(), F.col("n_px").desc(), "poly_id")
    lost = cells.withColumn("_rn", F.row_number().over(w)).groupBy("poly_id", "n_px").agg(F.count_if(F.col("_rn") > 1).alias("lost_px"))
    small = F.col("lost_px") <= max_frac * F.col("n_px")
    return lost.select("poly_id", "n_px", "lost_px", (small & (F.col("lost_px") > 0)).alias("clipped"), F.when(small, F.col("n_px") - F.col("lost_px")).otherwise(F.col("n_px")).alias("left_px"))


def overlap_groups(poly: DataFrame, px: DataFrame, more_than_px: int = 1, max_ha: float = 300) -> DataFrame:
    """Polygons after folding every group of overlapping ones into its largest, which takes the union's area.

    Pixels are read once: pairs and unions are counted on the pieces that the polygons cut each other into.
    """
    pieces = cut(G.stacks(px).withColumn("piece", F.monotonically_increasing_id()))
    twos = pieces.where("size(keys) > 1").select("n", "keys", F.explode("keys").alias("a")).select("n", "a", F.explode(F.filter("keys", lambda k: k > F.col("a"))).alias("b"))
    pairs = twos.groupBy("a", "b").agg(F.sum("n").alias("inter_px")).where(F.col("inter_px") > more_than_px)
    named = G.dealt(components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    rows = poly.join(named, F.col("poly_id") == F.col("node"), "left").withColumn("group", F.coalesce("component", "poly_id"))
    largest = Window.partitionBy("group").orderBy(F.col("area_ha").desc(), "poly_id")
    ranked = rows.withColumn("_rn", F.row_number().over(largest))
    folded = ranked.groupBy("group").agg(F.count("*").alias("merge_n"), F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("_rn") > 1, F.col("poly_id"))))).alias("merged_from"))
    held = G.dealt(pieces.select("piece", "n", F.explode("keys").alias("node"))).join(named, "node", "left").select("piece", "n", F.coalesce("component", "node").alias("group"))
    ground = held.distinct().groupBy("group").agg((F.sum("n") * G.HA_PER_PIXEL).alias("union_ha"))
    out = ranked.where("_rn = 1").join(G.dealt(folded), "group").join(G.dealt(ground), "group")
    blob = (F.col("merge_n") > 1) & (F.col("union_ha") > max_ha)
    return out.select("poly_id", "merge_n", "merged_from", F.col("union_ha").alias("area_ha"), F.when(~blob, F.col("pred")).alias("pred"), F.when(blob, F.lit("unsegmented_blob")).otherwise(F.col("abstain_reason")).alias("abstain_reason"))


def seam_audit(poly: DataFrame, px: DataFrame, min_cut: float = 40, probe: int = 3, size: int = 20) -> DataFrame:
    """Per polygon its length along the tile edge and, where that is long, what fills the strip beyond it."""
    rows = with_home(poly, size)
    cut = G.edge_touch(px, size)
    truncated = cut.where(F.col("edge_m") >= min_cut).select("poly_id")
    ring = G.ring(px.join(truncated, "poly_id", "left_semi"), rings=probe).join(rows.select("poly_id", "kx", "ky", "pred"), "poly_id").where((F.floor(F.col("px") / size) != F.col("kx")) | (F.floor(F.col("py") / size) != F.col("ky")))
    other = px.select(F.col("poly_id").alias("o_id"), "px", "py").join(rows.select(F.col("poly_id").alias("o_id"), F.col("pred").alias("o_pred"), F.col("reason").alias("o_reason")), "o_id")
    met = ring.join(other, ["px", "py"], "left").where(F.col("o_id").isNull() | (F.col("o_id") != F.col("poly_id")))
    kind = F.when(F.col("o_id").isNull(), 0).when(F.col("o_reason") != "", 1).when(F.col("o_pred") != F.col("pred"), 2).otherwise(3)
    per_px = met.groupBy("poly_id", "px", "py").agg(F.max(kind).alias("k"))
    share = lambda v: F.avg((F.col("k") == v).cast("double"))
    strips = per_px.groupBy("poly_id").agg(F.count("*").alias("strip_px"), share(3).alias("fill_same"), share(2).alias("fill_other"), share(1).alias("fill_abst"), share(0).alias("fill_none"))
    out = cut.join(strips, "poly_id", "left")
    bucket = F.when(F.col("strip_px").isNull(), "").otherwise(F.coalesce(*(F.when(F.col(f"fill_{k}") >= 0.5, F.lit(k)) for k in ("same", "other", "abst", "none")), F.lit("mixed")))
    return out.withColumn("truncated", F.col("edge_m") >= min_cut).withColumn("beyond_cut", bucket)


def grafts(target: DataFrame, target_px: DataFrame, donors: DataFrame, donor_px: DataFrame, cover: float = 0.8, min_add_px: int = 4, max_ratio: float = 3, max_px: int = 30000) -> DataFrame:
    """For every target polygon the part of another year's best-covering polygon that it lacks, or why none is taken.

    Donors rank by their year's order, then by coverage; added ground that any other target holds is
    left to it. The first donor that passes all rules is used.
    """
    pairs = target_px.select("poly_id", "px", "py").join(donor_px.select(F.col("poly_id").alias("donor"), "rank", "px", "py"), ["px", "py"]).groupBy("poly_id", "donor", "rank").agg(F.count("*").alias("inter"))
    area = target_px.groupBy("poly_id").agg(F.count("*").alias("own_px"))
    best = Window.partitionBy("poly_id", "rank").orderBy(F.col("inter").desc(), "donor")
    chosen = pairs.join(area, "poly_id").withColumn("_rn", F.row_number().over(best)).where("_rn = 1").withColumn("cov", F.col("inter") / F.col("own_px").cast("double"))
    taken = G.dealt(target_px.select("px", "py").distinct())
    added = chosen.join(donor_px.select(F.col("poly_id").alias("donor"), "rank", "px", "py"), ["donor", "rank"]).join(taken, ["px", "py"], "left_anti").groupBy("poly_id", "rank").agg(F.count("*").alias("added_px"))
    tried = chosen.join(added, ["poly_id", "rank"], "left").withColumn("added_px", F.coalesce("added_px", F.lit(0)))
    reason = (
        F.when(F.col("cov") < cover, "donor_cover_below_min").when(F.col("added_px") == 0, "nothing_to_add").when(F.col("added_px") < min_add_px, "added_below_min")
        .when(F.col("added_px") > max_ratio * F.col("own_px"), "added_over_ratio").when(F.col("own_px") + F.col("added_px") > max_px, "result_over_max_area").otherwise("repaired")
    )
    first = Window.partitionBy("poly_id").orderBy((F.col("reason") != "repaired").cast("int"), F.when(F.col("reason") == "repaired", F.col("rank")).otherwise(-F.col("rank")))
    won = tried.withColumn("reason", reason).withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    out = target.select("poly_id").join(won.select("poly_id", "donor", "rank", "cov", "added_px", "reason"), "poly_id", "left")
    fixed = F.col("reason") == "repaired"
    return out.select("poly_id", F.when(fixed, F.col("donor")).alias("donor"), F.when(fixed, F.col("rank")).alias("donor_rank"), F.when(fixed, F.col("added_px")).otherwise(0).alias("added_px"), F.coalesce("reason", F.lit("no_donor_overlap")).alias("reason"))
