"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into two halves of 32 bits. Fingerprints that differ in at most three
bits differ in at most one bit of some half. The anchors of a half are the words of a covering
code: the perfect Hamming code of length 31 (covering radius 1) times the one free bit. Every
fingerprint goes to all anchors within covering radius plus threshold, 1 + 1 = 2, of each half, at
most 17 of 2^27; two linked fingerprints meet at the anchor nearest to either. Fingerprints are
compared per anchor on all 64 bits.

``similar_groups`` is for looser likeness, where three bits are too few: texts meet by bands of
min-wise hashes of their shingles, a 128-bit fingerprint leaves out pairs that are far from alike,
an estimate by more such hashes all that are hardly alike enough, and the Jaccard similarity of the
shingle sets decides every pair that is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.graph import components, with_least
from furrow.session import cut


def _majority(hashes: np.ndarray) -> bytes:
    """The bits set in over half of the rows of a byte matrix."""
    total = np.zeros(hashes.shape[1] * 8, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[at : at + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").tobytes()


def _shingles(words: list[bytes], shingle: int) -> Iterator[bytes]:
    n = min(shingle, len(words))
    return map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))


def simhash(words: list[bytes], shingle: int, seed: int = 42) -> int:
    """The fingerprint of a word sequence as an unsigned integer; no words give zero."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, seed) for x in _shingles(words, shingle)), dtype="<u8")
    return int.from_bytes(_majority(hashes.view(np.uint8).reshape(-1, 8)), "little")


#: Bands of min-wise hashes and hashes per band: two texts of Jaccard similarity s meet with
#: probability 1 - (1 - s^5)^24, at 0.8 in all but 7 of 100,000 cases.
BANDS, BAND_ROWS = 24, 5
#: Min-wise hashes by which the similarity of two texts that met is estimated, those of the bands among them.
HASHES = 300
_DRAWN = np.random.default_rng(42).integers(0, 1 << 64, (2, HASHES), dtype=np.uint64)
_DRAWN[0] |= np.uint64(1)


def _distinct(words: list[bytes], shingle: int) -> np.ndarray:
    """128-bit hashes of the distinct shingles as rows of two words; no words give no rows."""
    digest = xxhash.xxh3_128_digest
    hashes = b"".join([digest(x, 42) for x in set(_shingles(words, shingle))]) if words else b""
    return np.frombuffer(hashes, dtype="<u8").reshape(-1, 2)


def _minima(hashes: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """The min-wise hashes of some shingles."""
    least = np.full(drawn.shape[1], np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * drawn[0] + drawn[1]).min(axis=0), out=least)
    return least


def _bands(least: np.ndarray) -> np.ndarray:
    """One key per band of the min-wise hashes."""
    rows = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh3_64_intdigest(band.tobytes(), k) for k, band in enumerate(rows)], dtype=np.uint64)


def _sketch(hashes: np.ndarray) -> bytes:
    """Four bytes of each band's key, then the low byte of each min-wise hash."""
    least = _minima(hashes, _DRAWN)
    return _bands(least).astype("<u4").tobytes() + least.astype(np.uint8).tobytes()


def fingerprint(text: Column | str, shingle: int = 3) -> Column:
    """The SimHash of a text as a signed long: A-Z lower-cased, words split at space and \\t..\\r.

    Word shingles count as often as they occur; shorter texts are one shingle; null, empty and
    blank texts give zero. Whole texts are read, whatever their length.
    """

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = [simhash(t.as_py().lower().split(), shingle) if t.is_valid else 0 for t in texts]
            yield pa.array(np.array(got, dtype=np.uint64).view(np.int64))

    return of((F.col(text) if isinstance(text, str) else text).cast("binary"))


def _anchors(part: Column, which: int, bits: int) -> Column:
    """All anchors of a part of 32 or 16 bits within distance 2, as longs that also name the part.

    Positions 1 to bits - 1 of the Hamming code are the low bits of the part; its top bit is free.
    """
    checks = bits.bit_length() - 1
    masks = [sum(1 << (p - 1) for p in range(1, bits) if p >> j & 1) for j in range(checks)]
    syndrome = sum((F.bit_count(part.bitwiseAND(F.lit(m))) % 2 * (1 << j) for j, m in enumerate(masks)), F.lit(0)).cast("int")
    # part ^ bit(i) ^ bit(j) is a code word when the positions i and j xor to the syndrome; position 0 flips nothing.
    flip = lambda p: F.when(p == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), p - 1))
    pairs = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: i < i.bitwiseXOR(syndrome))
    words = F.transform(pairs, lambda i: part.bitwiseXOR(flip(i)).bitwiseXOR(flip(i.bitwiseXOR(syndrome))))
    near = F.when(syndrome == 0, F.array(part)).otherwise(words)
    every = F.concat(near, F.array(part.bitwiseXOR(flip(syndrome)).bitwiseXOR(F.lit(1 << (bits - 1)))))
    return F.transform(every, lambda a: a + F.lit(which << 32))


def _covered(print_col: str, bits: int) -> Column:
    """The anchors of all parts of a 64-bit fingerprint."""
    cell = lambda k: F.call_function("shiftrightunsigned", F.col(print_col), F.lit(bits * k)).bitwiseAND(F.lit((1 << bits) - 1))
    return F.concat(*(_anchors(cell(k), k, bits) for k in range(64 // bits)))


def _linked(prints: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the link graph of fingerprints (rows of 64-bit words), as index pairs.

    A large set of single words under a threshold of 3 is first cut by four bands of 16 bits, of
    which linked fingerprints share one at least.
    """
    if len(prints) > 4096 and threshold <= 3 and prints.shape[1] == 1:
        found: list[tuple[int, int]] = []
        for band in range(4):
            key = prints[:, 0] >> np.uint64(16 * band) & np.uint64(0xFFFF)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for own in np.split(order, cuts):
                if len(own) > 1:
                    found += [(int(own[a]), int(own[b])) for a, b in _forest(prints[own], threshold)]
        return found
    return _forest(prints, threshold)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, words along the last axis."""
    total = np.bitwise_count(a[..., 0] ^ b[..., 0])
    for k in range(1, a.shape[-1]):
        total = total + np.bitwise_count(a[..., k] ^ b[..., k])
    return total


def _forest(prints: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Those that link to any other are found block by block; the forest grows over them alone."""
    some = np.zeros(len(prints), dtype=bool)
    for at in range(0, len(prints), 512):
        own = prints[at : at + 512]
        near = _apart(own[:, None, :], prints[None, at:, :]) <= threshold
        near[np.arange(len(own)), np.arange(len(own))] = False
        some[at : at + 512] |= near.any(axis=1)
        some[at:] |= near.any(axis=0)
    left, found = np.flatnonzero(some), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = _apart(prints[left], prints[at][None, :]) <= threshold
            if near.any():
                hit, left = left[near], left[~near]
                found += [(int(at), int(x)) for x in hit]
                todo += hit.tolist()
    return found


def _edges(threshold: int):
    """Rows (anchor, node, fingerprint) sorted by anchor to the edges of a spanning forest per anchor."""

    def runs(anchor: np.ndarray, node: np.ndarray, word: np.ndarray) -> Iterator[pa.RecordBatch]:
        prints = word.view(np.uint64)[:, None]
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = np.diff(np.r_[first, len(anchor)])
        two = first[size == 2]
        two = two[_apart(prints[two], prints[two + 1]) <= threshold]
        src, dst = [node[two]], [node[two + 1]]
        for at, n in zip(first[size > 2], size[size > 2], strict=True):
            own = node[at : at + n]
            if pairs := _linked(prints[at : at + n], threshold):
                a, b = np.array(pairs).T
                src.append(own[a])
                dst.append(own[b])
        pairs = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_PAIR)

    return _by_run(runs)


def _first_met(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first band that the texts of two rows of sketches share."""
    a, b = (np.ascontiguousarray(s[:, : 4 * BANDS]).view("<u4") for s in (x, y))
    return (a == b).argmax(axis=1)


def _promising(least: float, best: bool):
    """Rows (run, node, part, band, block, low, high, sketch) sorted by run to pairs (src, dst, alike) of different parts.

    Pairs differ in at most ``POSSIBLE`` bits and agree in ``least`` or more of the min-wise hashes;
    each is made in the first band that it shares alone. ``best`` keeps every node's best pair of a run.
    """

    def compared(part, band, block, prints, sketch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, one = len(part), (block == block[0]).all()
        for at in range(0, n, 256):
            own, rest = slice(at, at + 256), slice(at, n)
            near = (_apart(prints[own, None, :], prints[None, rest, :]) <= POSSIBLE) & (part[own, None] != part[None, rest])
            if not one:
                near &= block[own, None] != block[None, rest]
            a, b = np.nonzero(np.triu(near, 1))
            for k in range(0, len(a), 32768):
                i, j = at + a[k : k + 32768], at + b[k : k + 32768]
                x, y = sketch[i], sketch[j]
                alike = (x[:, 4 * BANDS :] == y[:, 4 * BANDS :]).mean(axis=1)
                good = alike >= least
                good[good] = _first_met(x[good], y[good]) == band
                if good.any():
                    yield i[good], j[good], alike[good]

    def runs(run, node, part, band, block, low, high, sketch) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        size = np.diff(np.r_[first, len(run)])
        mixed = np.minimum.reduceat(part, first) < np.maximum.reduceat(part, first)
        for start, n in zip(first[mixed], size[mixed], strict=True):
            s = slice(start, start + n)
            prints = np.stack([low[s].view(np.uint64), high[s].view(np.uint64)], axis=1)
            sketches = np.frombuffer(b"".join(sketch[s]), dtype=np.uint8).reshape(n, -1)
            pairs = compared(part[s], band[start], block[s], prints, sketches)
            if not best:
                for i, j, alike in pairs:
                    yield _pairs(node[s][i], node[s][j], alike)
                continue
            most, who = np.zeros(n), np.full(n, -1)
            for i, j, alike in pairs:
                src, dst, new = np.r_[i, j], np.r_[j, i], np.r_[alike, alike]
                order = np.lexsort((dst, new, src))
                last = order[np.r_[src[order][1:] != src[order][:-1], True]]
                last = last[new[last] > most[src[last]]]
                most[src[last]], who[src[last]] = new[last], dst[last]
            some = np.flatnonzero(who >= 0)
            yield _pairs(node[s][some], node[s][who[some]], most[some])

    return _by_run(runs)


def _pairs(src: np.ndarray, dst: np.ndarray, alike: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(alike)], names=["src", "dst", "alike"])


_PAIR = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _by_run(runs):
    """Batches sorted by their first column to what ``runs`` makes of whole runs of it."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last, perhaps unfinished run of a batch waits for the next batch."""
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
            cut_at = int(np.searchsorted(new[0], new[0][-1]))
            if cut_at or (kept and kept[-1][0][-1] != new[0][0]):
                done = [*kept, tuple(x[:cut_at] for x in new)]
                whole = tuple(np.concatenate(x) for x in zip(*done, strict=True))
                if len(whole[0]):
                    yield from runs(*whole)
                kept = []
            kept.append(tuple(x[cut_at:] for x in new))
        if kept:
            yield from runs(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    return over


def links(prints: DataFrame, threshold: int = 3) -> DataFrame:
    """(src, dst) between the nodes of distinct fingerprints (node long, fingerprint long).

    The edges are a spanning forest per anchor of all pairs at ``threshold`` (at most 3) or fewer
    differing bits: as they join the same components, no link is lost, and no group emits all pairs.
    """
    if threshold > 3:
        raise ValueError("the anchors cover thresholds up to 3 bits")
    return (
        prints.select(F.explode(_covered("fingerprint", 32)).alias("anchor"), "node", "fingerprint")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_edges(threshold), "src long, dst long")
        .distinct()
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 3, groups: bool = False) -> DataFrame:
    """One row per input row: id, fingerprint (signed long) and component_id; with ``groups`` text_key and group too.

    component_id is the smallest id reachable over links of at most ``threshold`` differing bits.
    Exact copies share one fingerprint and so cost one row per fingerprint in every later step,
    however many they are. Null texts have fingerprint zero and link like any other; null ids keep
    a row, take part in the links and get the component's smallest id (null if it has none);
    repeated rows stay; an empty table gives no rows; other columns, whatever their names, are
    left out. group is a number of the component's own (see ``similar_groups``).
    """
    keys = [text_key(text_col).alias("text_key")] if groups else []
    marked = cut(df.select(F.col(id_col).alias("_id"), fingerprint(text_col, shingle).alias("_print"), *keys))
    prints = marked.groupBy("_print").agg(F.min("_id").alias("_least"))
    # Fingerprints whose rows all lack an id still join others: their node is below any id's place.
    rows = marked.count()
    nodes = cut(prints.select(F.col("_print").alias("fingerprint"), "_least", F.col("_print").alias("node")), rows)
    part = components(links(nodes.select("fingerprint", "node"), threshold), rows)
    named = (
        nodes.join(part, "node", "left")
        .select("fingerprint", "_least", F.coalesce("component", "node").alias("_part"))
    )
    # One row per fingerprint; a hot fingerprint's rows are split by adaptive execution.
    by_print = with_least(named, "_part", "_least", "component_id", rows).select(F.col("fingerprint").alias("_print"), "component_id", F.col("_part").alias("group"))
    also = ["text_key", "group"] if groups else []
    return marked.join(by_print, "_print").select(F.col("_id").alias(id_col), F.col("_print").alias("fingerprint"), "component_id", *also)


def as_hex(print_col: Column | str) -> Column:
    """16 lower-case hex digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(print_col)), 16, "0")


#: Differing bits of 128 that a candidate pair may have. Jaccard 0.8 is a cosine of 0.89 or more, for
#: which 19.4 bits are expected (standard deviation 4.1); unrelated texts differ in 64 (5.7).
POSSIBLE = 44
#: Share of equal min-wise hashes from which on a pair is checked: at Jaccard 0.8 the standard
#: deviation of 300 is 0.023, and 1 of 100,000 pairs falls below.
ESTIMATE = 0.7
#: Rows of a band that are compared in one task; a larger band is dealt out as pairs of its blocks.
RUN_ROWS = 20_000
#: Most promising pairs of every text that are checked before all that are left are.
FIRST = 4


def _crowded(nodes: DataFrame) -> DataFrame:
    """(run, node, part, band, block) of (node, bands, part): the bands that hold different parts."""
    rows = nodes.select("node", "part", F.posexplode("bands").alias("band", "_key"))
    per = rows.groupBy("_key").agg(F.count("*").alias("_n"), F.min("part").alias("_low"), F.max("part").alias("_high"))
    per = per.where("_low < _high").select(F.col("_key").alias("_k"), F.ceil(F.col("_n") / RUN_ROWS).alias("_blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("_blocks"))
    run = F.xxhash64("_key", F.least("block", "_other"), F.greatest("block", "_other"))
    return (
        rows.join(per, F.col("_key") == F.col("_k"))
        .withColumn("block", block)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        .select(run.alias("run"), "node", "part", "band", "block")
    )


def _meetings(nodes: DataFrame, sets: DataFrame, best: bool) -> DataFrame:
    """(src, dst, alike) of the promising pairs of ``nodes`` (node, low, high, bands, part) that differ in part."""
    rows = _crowded(nodes).join(nodes.select("node", "low", "high"), "node").join(sets.select("node", "sketch"), "node")
    return (
        rows.select("run", "node", "part", "band", "block", "low", "high", "sketch")
        .repartition("run")
        .sortWithinPartitions("run")
        .mapInArrow(_promising(ESTIMATE, best), "src long, dst long, alike double")
    )


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have at least this Jaccard similarity, the smaller node last."""
    a, b = (sets.select(F.col("node").alias(end), F.col("shingles").alias(name)) for end, name in (("src", "_a"), ("dst", "_b")))
    once = pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    both = once.join(a, "src").join(b, "dst").withColumn("_n", F.size(F.array_intersect("_a", "_b")))
    return both.where(F.col("_n") / (F.size("_a") + F.size("_b") - F.col("_n")) >= similarity).select("src", "dst")


def text_key(text_col: Column | str) -> Column:
    """The hash by which rows of one text are known."""
    return F.xxhash64((F.col(text_col) if isinstance(text_col, str) else text_col).cast("binary"))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: id, text_key, component_id and group, over links of texts alike to ``similarity`` or more.

    The likeness of two texts is the Jaccard similarity of their sets of shingles, each a 64-bit hash;
    every link is checked on the whole sets. Candidates are pairs that share a band (see ``BANDS``),
    differ in at most ``POSSIBLE`` bits and whose similarity is estimated at ``ESTIMATE`` or more; all
    three are set for a ``similarity`` of 0.8 or more, below which it may not lie. The ``FIRST`` most
    promising candidates of each text are checked first; then all candidates that their links leave in
    different components are, so that no failed link hides another. That second step grows with the
    pairs of texts that are candidates and not linked.
    component_id is the smallest id of the component, group a number of its own, as components of rows
    that share an id can share their component_id too. Nulls, blank texts, repeated rows and empty
    tables are as with ``near_duplicates``; texts with the same set of shingles are one node.
    """
    if similarity < 0.8:
        raise ValueError("the candidates are complete for similarities of 0.8 or more")
    kind = pa.struct([("node", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("bands", pa.list_(pa.int64()))])
    drawn = _DRAWN[:, : BANDS * BAND_ROWS]

    @F.arrow_udf("node long, low long, high long, bands array<long>")
    def prints_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            prints, bands = [], []
            for t in texts:
                hashes = _distinct(t.as_py().lower().split() if t.is_valid else [], shingle)
                wide = _majority(hashes.view(np.uint8).reshape(-1, 16)) if len(hashes) else bytes(16)
                prints.append((xxhash.xxh3_64_intdigest(np.sort(hashes[:, 0]).tobytes()), int.from_bytes(wide[:8], "little"), int.from_bytes(wide[8:], "little")))
                bands.append(_bands(_minima(hashes[:, 0], drawn)).view(np.int64).tolist() if len(hashes) else [])
            columns = np.array(prints, dtype=np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.StructArray.from_arrays([*(pa.array(columns[:, i]) for i in range(3)), pa.array(bands, pa.list_(pa.int64()))], fields=list(kind))

    @F.arrow_udf("shingles array<long>, sketch binary")
    def set_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets = [_distinct(t.as_py().lower().split(), shingle)[:, 0] for t in texts]
            columns = [pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([_sketch(x) for x in sets], pa.binary())]
            yield pa.StructArray.from_arrays(columns, names=["shingles", "sketch"])

    text = F.col(text_col).cast("binary")
    marked = df.select(F.col(id_col).alias("_id"), text_key(text_col).alias("text_key"), prints_of(text).alias("_p"))
    marked = cut(marked.select("_id", "text_key", "_p.*"))
    rows = marked.count()
    nodes = cut(marked.groupBy("node").agg(F.min("_id").alias("_least"), F.min("text_key").alias("_text"), F.min("low").alias("low"), F.min("high").alias("high"), F.first("bands").alias("bands")), rows)
    met = _crowded(nodes.withColumn("part", F.col("node"))).select("node").distinct()
    met = cut(nodes.join(met, "node", "left_semi").select("node", "_text", "low", "high", "bands"), rows)
    # Only texts that met another go on as sets; copies are reduced before the shuffle.
    texts = df.select(text_key(text_col).alias("_text"), text.alias("_own")).groupBy("_text").agg(F.first("_own").alias("_own"))
    sets = cut(texts.join(met.select("node", "_text"), "_text").select("node", set_of("_own").alias("_s")).select("node", "_s.*"))
    parted = met.withColumn("part", F.col("node"))
    # A text has one pair for each of its bands at most.
    ranked = _meetings(parted, sets, best=True).groupBy("src").agg(F.sort_array(F.collect_set(F.struct("alike", "dst")), asc=False).alias("_all"))
    first = cut(_alike(ranked.select("src", F.explode(F.slice("_all", 1, FIRST)).alias("_p")).select("src", "_p.dst"), sets, similarity), rows)
    parted = met.join(components(first, rows), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    rest = cut(_alike(_meetings(parted, sets, best=False), sets, similarity), rows)
    part = components(first.unionAll(rest), rows)
    named = nodes.join(part, "node", "left").select("node", "_least", F.coalesce("component", "node").alias("group"))
    by_node = with_least(named, "group", "_least", "component_id", rows).select("node", "component_id", "group")
    return marked.select("_id", "text_key", "node").join(by_node, "node").select(F.col("_id").alias(id_col), "text_key", "component_id", "group")


def keep_one(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each group of ``found`` (id, text_key, group per row): that with the smallest id.

    Of rows that repeat the id within a group the text with the smallest key stays, and of rows that
    repeat id and text the first by all their columns as JSON, so reruns agree; a group whose id another
    group has too keeps its own row. Rows without an id can't be named as a group's member: of those one
    per text stays. Only the keys that go or occur more than once are joined to the texts. Other columns
    stay as they are; an empty table gives no rows.
    """
    known = found.where(F.col(id_col).isNotNull())
    first = known.groupBy("group").agg(F.min(F.struct(id_col, "text_key")).alias("s")).select(F.col(f"s.{id_col}").alias("id"), F.col("s.text_key").alias("key"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("first"))
    every = known.groupBy(F.col(id_col).alias("id"), F.col("text_key").alias("key")).agg(F.count("*").alias("n")).withColumn("first", F.lit(0))
    per_key = every.unionByName(first).groupBy("id", "key").agg(F.sum("n").alias("n"), F.max("first").alias("first"))
    odd = cut(per_key.where("n > 1 or first = 0"), found.count())
    named = df.where(F.col(id_col).isNotNull())
    meets = lambda keys: (named[id_col] == keys["id"]) & (text_key(named[text_col]) == keys["key"])
    again = odd.where("first = 1")
    repeats = named.join(again, meets(again), "left_semi").unionByName(df.where(F.col(id_col).isNull()))
    rows = repeats.select(F.struct(*df.columns).alias("row"), F.xxhash64(id_col, text_key(text_col)).alias("key"))
    once = rows.groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return named.join(odd, meets(odd), "left_anti").unionByName(once)
