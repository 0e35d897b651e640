"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions several times, each time by other directions and with
another shift, and ordered along a Hilbert curve. Spark range-partitions each ordering; windows of
neighbouring keys give every query its candidates, whose union is reranked by the exact inner
product. Vectors without low-dimensional structure have near neighbours far away on any one curve, so
there are many curves with wide windows, and an exact check may follow: the first curve cuts the
vectors into blocks, the windows' k-th score bounds what a block must offer, and every block whose
centre and radius allow that much is compared with the block of queries. With that check the result
is the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furrow.session import cut

#: Bytes of descriptions of groups of blocks that go to every task; more blocks make larger groups.
MOST_DESCRIBED = 8 << 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points with integer coordinates below 2**bits.

    The coordinates are turned into the curve's transposed form, from the highest bit down, and their
    bits interleaved; rows are points, and rows times bits may not exceed 63.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            set_bit = (x[i] & q) != 0
            swap = np.where(set_bit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_bit, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


@lru_cache(maxsize=4)
def _directions(size: int, curves: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Orthonormal directions and the shift of every curve."""
    rng = np.random.default_rng(seed)
    drawn = []
    for _ in range(curves):
        ways = np.linalg.qr(rng.standard_normal((size, min(dims, size))))[0]
        drawn.append((ways, rng.uniform(0, 0.5, ways.shape[1])))
    return drawn


def curve_keys(vectors: np.ndarray, curves: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """One Hilbert key per vector and curve, from the vectors' directions."""
    size = vectors.shape[1]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.empty((len(vectors), curves), dtype=np.int64)
    for c, (ways, shift) in enumerate(_directions(size, curves, dims, seed)):
        # Most directions' projections lie within three deviations; the cube leaves room for the shift.
        place = np.clip(unit @ ways * np.sqrt(size) / 12 + 0.25, 0, 0.4999) + shift
        out[:, c] = hilbert_keys((place * (1 << bits)).astype(np.int64), bits)
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed from the first component to the last: equal rows score equal."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each query, ties to smaller ids; each candidate of a query once."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    fresh = np.r_[True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])] if len(query) else np.zeros(0, bool)
    query, ids, score = query[fresh], ids[fresh], score[fresh]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    keep = rank < k
    return pa.RecordBatch.from_arrays([pa.array(query[keep]), pa.array(ids[keep]), pa.array(score[keep])], schema=_FOUND)


def _windows(width: int, k: int):
    """Over rows sorted by (curve, key): the best candidates of each query among ``width`` rows on either side."""
    step = max(width, 256)

    def score(curve, ids, asks, vectors, lo, hi) -> Iterator[pa.RecordBatch]:
        for start in range(lo, hi, step):
            at = start + np.flatnonzero(asks[start : min(start + step, hi)])
            if not len(at):
                continue
            near = np.arange(max(0, start - width), min(len(ids), start + step + width))
            rough = vectors[at] @ vectors[near].T
            out = (np.abs(near[None, :] - at[:, None]) > width) | (curve[near][None, :] != curve[at][:, None]) | (ids[near][None, :] == ids[at][:, None])
            rough[out] = -np.inf
            least = np.full(len(at), -np.inf)
            if len(near) > k:
                slack = 1e-9 * (1 + np.linalg.norm(vectors[at], axis=1) * np.abs(vectors[near]).sum(axis=1).max())
                least = np.partition(rough, len(near) - k, axis=1)[:, len(near) - k] - slack
            who, what = np.nonzero((rough >= least[:, None]) & ~out)
            if len(who):
                yield _best(ids[at[who]], ids[near[what]], exact_scores(vectors[at[who]], vectors[near[what]]), k)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), _matrix(batch.column(3)))
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            ready = len(held[0]) - width
            if ready > done:
                yield from score(*held, done, ready)
                drop = max(0, ready - width)
                held, done = tuple(x[drop:] for x in held), ready - drop
        if held is not None:
            yield from score(*held, done, len(held[0]))

    return over


def _blocks(rows: int):
    """Rows in curve order to one row per block: ids, vectors, centre and radius."""
    schema = pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary()), ("more", pa.binary()), ("vectors", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("floor", pa.float64())])

    def pack(nth, ids, more, vectors) -> pa.RecordBatch:
        centre = vectors.mean(axis=0)
        radius = float(np.sqrt(((vectors - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9)
        row = [TaskContext.get().partitionId(), nth, ids.astype("<i8").tobytes(), more.astype("<f8").tobytes(), vectors.astype("<f8").tobytes(), centre.tolist(), radius, float(more.min())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nth = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)), _matrix(batch.column(2)))
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            while len(held[0]) >= rows:
                yield pack(nth, *(x[:rows] for x in held))
                held, nth = tuple(x[rows:] for x in held), nth + 1
        if held is not None and len(held[0]):
            yield pack(nth, *held)

    return over


_BLOCK = "part int, nth long, ids binary, more binary, vectors binary, centre array<double>, radius double, floor double"


def _numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Blocks with dense numbers; the driver sees one count per partition."""
    counts = sorted((r["part"], r["count"]) for r in blocks.groupBy("part").count().collect())
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    if not counts:
        return blocks.withColumn("block", F.lit(0).cast("long")), 0
    start = F.create_map(*(F.lit(x) for (part, _), at in zip(counts, starts, strict=False) for x in (part, at)))
    return blocks.withColumn("block", start[F.col("part")].cast("long") + F.col("nth")), starts[-1]


def _compare(k: int):
    """Pairs of blocks to the pairs of rows that reach the query's floor."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid, qfloor = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_more"], "<f8")
                ids = np.frombuffer(row["ids"], "<i8")
                asked = np.frombuffer(row["q_vectors"], "<f8").reshape(len(qid), -1)
                vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
                length = np.linalg.norm(asked, axis=1)
                slack = 1e-9 * (1 + length * np.abs(vectors).sum(axis=1).max())
                may = asked @ np.array(row["centre"]) + length * row["radius"] >= qfloor - slack
                for at in range(0, int(may.sum()), 256):
                    own = np.flatnonzero(may)[at : at + 256]
                    rough = asked[own] @ vectors.T
                    rough[qid[own][:, None] == ids[None, :]] = -np.inf
                    least = qfloor[own] - slack[own]
                    if len(ids) > k:
                        least = np.maximum(least, np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - slack[own])
                    who, what = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
                    if len(who):
                        yield _best(qid[own[who]], ids[what], exact_scores(asked[own[who]], vectors[what]), k)

    return over


def _reachable(groups: list[int], centres: np.ndarray, radii: np.ndarray) -> Column:
    """The groups of blocks that may hold something for a block of queries."""
    names = np.array(groups, dtype=np.int64)

    @F.arrow_udf("array<bigint>")
    def of(centre: pa.Array, radius: pa.Array, floor: pa.Array) -> pa.Array:
        out = []
        for c, r, least in zip(centre.to_pylist(), radius.to_pylist(), floor.to_pylist(), strict=True):
            c = np.array(c)
            most = centres @ c + np.linalg.norm(c) * radii + np.linalg.norm(centres, axis=1) * r + r * radii
            out.append(names[most >= least - 1e-6 * (1 + abs(least) if np.isfinite(least) else 1)].tolist())
        return pa.array(out, pa.list_(pa.int64()))

    return of("q_centre", "q_radius", "q_floor")


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _grouped(base: DataFrame, n_blocks: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(block, group, centre, radius) of the blocks, and (group, centre, radius) of groups of neighbouring blocks.

    A group's ball holds those of its blocks; there are as many groups as may be described at once.
    """
    per = -(-n_blocks // max(1, MOST_DESCRIBED // (8 * size + 16))) or 1
    blocks = base.select("block", F.floor(F.col("block") / per).alias("group"), "centre", "radius")
    middle = blocks.groupBy("group").agg(F.min_by("centre", "block").alias("_middle"))
    gap = F.zip_with("centre", "_middle", lambda x, y: x - y)
    reach = F.sqrt(_dot(gap, gap)) + F.col("radius")
    groups = blocks.join(middle, "group").groupBy("group").agg(F.first("_middle").alias("centre"), (F.max(reach) * (1 + 1e-9)).alias("radius"))
    return blocks, groups


def _may_hold() -> Column:
    """Whether a block may hold something for a block of queries."""
    length = lambda c: F.sqrt(_dot(c, c))
    most = _dot("centre", "q_centre") + length("q_centre") * F.col("radius") + length("centre") * F.col("q_radius") + F.col("q_radius") * F.col("radius")
    return most >= F.col("q_floor") - 1e-6 * (1 + F.when(F.col("q_floor") > float("-inf"), F.abs("q_floor")).otherwise(0.0))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def windows(keyed: DataFrame, k: int, width: int) -> DataFrame:
    """The method itself: (query_id, vec_id, score) of the windows of all curves, k per query and curve."""
    rows = keyed.select(F.posexplode("keys").alias("curve", "key"), "vec_id", "asks", "vector")
    ordered = rows.repartitionByRange("curve", "key").sortWithinPartitions("curve", "key", "vec_id")
    return ordered.select("curve", "vec_id", "asks", "vector").mapInArrow(_windows(width, k), "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = found.repartition("query_id").distinct()  # one shuffle serves both
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(
    df: DataFrame,
    asks: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    curves: int = 32,
    width: int = 512,
    dims: int = 12,
    bits: int = 5,
    block: int = 4096,
    query_block: int = 2048,
    exact: bool = True,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products of each row that asks.

    ``asks`` says of a row whether it is a query. Candidates are all rows but the query's own; fewer
    than ``k`` give all, ties go to smaller ids, and scores are summed in double precision on the
    vectors as they are. Vectors that are null, empty or zero, or hold null or non-finite components,
    take no part, nor do rows with a null id or of another length than most; rows that repeat an id
    count once, with the smallest of its vectors. An empty table gives no rows.

    The defaults find 92 % of the true neighbours among 50,000 vectors without any structure of 64
    dimensions by the windows alone, and more among fewer or structured ones; each row travels once
    per curve. ``exact`` adds the check after the windows; it compares a query with every block that
    its bound can't leave out, on vectors without structure all of them.
    """
    # Floats stay floats in the shuffles, scores are summed as doubles.
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    # Rows that repeat an id meet in one; the arrays of one id are compared in order.
    clean = (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
        .where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        .groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    )
    clean = cut(clean)
    lengths = clean.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    size = lengths["n"] if lengths else 1

    @F.arrow_udf("array<bigint>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            got = curve_keys(_matrix(rows), curves, dims, bits, seed) if len(rows) else np.zeros((0, curves))
            yield pa.array(got.tolist(), pa.list_(pa.int64()))

    keyed = clean.where(F.size("vector") == size).withColumn("keys", keys("vector"))
    near = cut(_top(windows(keyed, k, width), k))
    if not exact:
        return near.select("query_id", "rank", "vec_id", "score")
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("_floor"))
    line = keyed.withColumn("key", F.col("keys")[0])
    ordered = line.repartitionByRange("key").sortWithinPartitions("key", "vec_id")
    base, n_blocks = _numbered(cut(ordered.select("vec_id", F.lit(0.0).alias("more"), "vector").mapInArrow(_blocks(block), _BLOCK)))
    asking = line.where("asks").join(floors, F.col("vec_id") == F.col("_q"), "left").withColumn("more", F.coalesce("_floor", F.lit(float("-inf"))))
    asking = asking.repartitionByRange("key").sortWithinPartitions("key", "vec_id")
    queries = cut(asking.select("vec_id", "more", "vector").mapInArrow(_blocks(query_block), _BLOCK))
    queries = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    blocks, groups = _grouped(base, n_blocks, size)
    known = groups.orderBy("group").collect()
    reach = _reachable([r["group"] for r in known], np.array([r["centre"] for r in known]).reshape(-1, size), np.array([r["radius"] for r in known]))
    own = ("q_part", "q_nth")
    meets = queries.select(*own, "q_centre", "q_radius", "q_floor", F.explode(reach).alias("group")).join(blocks, "group").where(_may_hold()).select(*own, "block")
    pairs = meets.join(queries, list(own)).join(base.select("block", "ids", "vectors", "centre", "radius"), "block")
    pairs = pairs.select("q_ids", "q_more", "q_vectors", "ids", "vectors", "centre", "radius")
    checked = pairs.mapInArrow(_compare(k), "query_id long, vec_id long, score double")
    found = _top(checked.unionByName(near.select("query_id", "vec_id", "score")), k)
    return found.select("query_id", "rank", "vec_id", "score")
