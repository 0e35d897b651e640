"""Quality rules, token counts, BPE, SimHash and mixing on awkward tables, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import bpe, mixing, quality_rules, simhash, token_counts
from furrow.llm.queries import ORACLES, QUERIES
from tests.conftest import SF, assert_same
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

LONG = " ".join(f"word{i % 997}" for i in range(30_000))
TEXTS = [
    None, "", "   \n\t", "one", "one two", "a b c a b c", "A B C d e f", "a b c d e f", "same line\nsame line\n\nsame line", LONG, LONG + " end",
    "don't I'll  <|endoftext|>x y z 日本語🎉 \x00\x1c\x85", "###$$$ a|b <c>", "x" * 3000, " " * 500 + "y", "a b c", "naïve café\r\nÜber", "1234 5678 90",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 4}", "clash") for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "s3", "clash"), (None, "one", "en", None, "clash"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").repartition(3)


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def empty(docs):
    return docs.where("false")


def test_rule_features(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality_rules.features(docs).select("text", *names).collect()
    for r in got:
        assert tuple(r[n] for n in names) == brute.rule_features(r.text), (r.text or "")[:40]


def test_rules_without_labels_keep_what_passes_the_base(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules.judge(empty(docs), labels).count() == 0


def test_binomial_tail(spark):
    cases = [(0, 50, 0.1), (3, 50, 0.1), (10, 400, 0.05), (900, 60_000, 0.02), (20, 400, 0.05)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.log_binomial_cdf(F.lit(k), F.lit(n), p).alias("x")).first().x
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
        assert abs(got - math.log(want)) < 1e-7


def test_cutoffs_hold_their_risk(spark):
    """The cutoff is the strictest one whose exact bound still holds, per stratum and before the first failure."""
    rng = random.Random(3)
    rows = [("a", 100, int(rng.random() < 0.002) * 30, 0, 0) for _ in range(3000)] + [("b", 100, 0, 0, 0) for _ in range(20)]
    frame = spark.createDataFrame(rows, "stratum string, n_words long, n_symbols long, n_dup_lines long, n_repeat_words long")
    got = {(r.stratum, r.rule): r for r in quality_rules.cutoffs(frame, risk=0.03, error=0.05).collect()}
    assert ("b", "symbols") not in got
    assert got["a", "symbols"].cutoff == 0.1 and got["a", "symbols"].n_good == 3000
    assert got["a", "symbols"].n_rejected < 0.01 * 3000


def test_rules_reject_junk_that_the_base_lets_pass(spark):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en") for i in range(900)]
    junk = [(10_000 + i, " ".join(f"j{i}x{k}###" for k in range(60)), "en") for i in range(30)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 10_000)) for i, *_ in good + junk], "doc_id long, quality int")
    got = quality_rules.judge(docs, labels).select("doc_id", "kept", "base_failed").collect()
    assert all(r.kept == (r.doc_id < 10_000) and not r.base_failed for r in got)


def test_token_counts(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in docs.select("text", token_counts.n_tokens("text", PIECES).alias("n")).collect():
        assert r.n == len(model.encode(r.text or "")), (r.text or "")[:40]


def test_split_texts_count_as_whole_ones(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(token_counts, "SPLIT_BYTES", 40)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 100)
    own, model = token_counts.Counter(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(5)
    made = ["".join(rng.choice("abc XY12  \n▁é.,'") for _ in range(rng.randint(0, 400))) for _ in range(300)]
    assert own.seams and own.counts(made) == [len(x) for x in model.encode(made)]


def test_counts_with_the_other_library(docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    for r in docs.select("text", token_counts.n_tokens("text", BPE).alias("n")).collect():
        assert r.n == len(model.encode(r.text or "", add_special_tokens=False).ids)


def test_bpe_gives_the_librarys_ids_and_text(docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    got = docs.select("text", bpe.encode("text", BPE).alias("ids")).withColumn("back", bpe.decode("ids", BPE)).withColumn("both", bpe.round_trip("text", BPE)).collect()
    for r in got:
        ids = model.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == r.both.ids == ids and r.back == r.both.decoded == model.decode(ids, skip_special_tokens=False)


def test_bpe_on_random_bytes_and_forgetful_workers(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    own, model, rng = bpe.Codec(BPE), Tokenizer.from_file(BPE), random.Random(7)
    alphabet = "etaoin shrdlu  \n'THE0123.,!?éß日🎉­\x00"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))
        ids = np.frombuffer(own.encode(text), "<i4").tolist()
        assert ids == model.encode(text, add_special_tokens=False).ids
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert own.decode(np.array(ids)).decode("utf-8", "replace") == model.decode(ids, skip_special_tokens=False)


def test_bpe_query_digests(spark):
    r = QUERIES["op7_bpe"](spark, SF).orderBy("doc_id").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id = {r.doc_id}").first().text
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_simhash_components(docs):
    got = simhash.near_duplicates(docs.withColumn("component_id", F.lit("clash"))).collect()
    want = brute.simhash_components(texts(docs))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or -1)
    assert sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_anchors_miss_no_pair_of_three_bits(spark):
    """Random fingerprints with planted neighbours at every distance up to three, in all bit places."""
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(200)]
    pairs = {b: b ^ sum(1 << k for k in rng.sample(range(64), 1 + i % 3)) for i, b in enumerate(base)}
    prints = [*pairs, *pairs.values()]
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(prints)], "fingerprint long, node long")
    got = {tuple(sorted(r)) for r in simhash.links(frame).collect()}
    assert {(i, i + 200) for i in range(200)} <= got
    assert all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in got)


def test_large_sets_are_cut_into_bands_without_loss(monkeypatch):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    cluster = sorted({centre ^ sum(1 << k for k in rng.sample(range(64), 3)) for _ in range(9000)})
    prints = np.array(cluster, dtype=np.uint64)[:, None]
    assert len(prints) > 4096

    def parts(edges):
        parent = list(range(len(prints)))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        return len({find(i) for i in range(len(prints))})

    assert parts(simhash._linked(prints, 3)) == parts(simhash._forest(prints, 3))


def test_keep_one_per_group(spark):
    body = [f"tok{i}" for i in range(400)]
    near = list(body)
    near[100] = "changed"
    other = [f"else{i}" for i in range(400)]
    rows = [(5, " ".join(body)), (2, " ".join(near)), (9, " ".join(body)), (2, " ".join(near)), (7, " ".join(other)), (8, None), (None, ""), (None, " ".join(other)), (None, "lone words here"), (None, "lone words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one(docs, simhash.similar_groups(docs))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 7), (False, 8), (True, 0), (True, 0), (True, 0)]
    assert simhash.keep_one(docs.where("false"), simhash.similar_groups(docs.where("false"))).count() == 0


def test_every_labelled_document_counts_for_the_cutoffs(spark):
    """A language of 1,500 labelled good documents keeps its rules among four million labels."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "xx") for i in range(1500)]
    rows.append((-1, " ".join(f"w{k}#" for k in range(60)), "xx"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.range(4_000_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    assert got[-1].rejected_by == ["symbols"] and not got[-1].kept
    assert sum(r.kept for r in got.values()) == 1500


def test_similar_groups_match_brute_force_around_the_bound(spark):
    rng = random.Random(8)
    rows, sets = [], []
    for i in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((12, 60, 250)))]
        for copy in range(3):
            words = list(base)
            for _ in range(rng.randrange(max(2, len(base) // 25)) if copy else 0):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            words += [f"tail{rng.randrange(10**6)}" for _ in range(rng.choice((0, len(base) // 8)) if copy else 0)]
            rows.append((3 * i + copy, " ".join(words)))
            sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    least, pairs, close = list(range(len(rows))), 0, 0
    for i in range(len(rows)):
        for j in range(i - i % 3, i):
            likeness = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            pairs, close = pairs + (likeness >= 0.8), close + (0.6 <= likeness < 0.8)
            if likeness >= 0.8:
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = [new if x == old else x for x in least]
    assert pairs > 60 and close > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert got == dict(enumerate(least))


def test_targets_match_resharing(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes: dict = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + brute.rule_features(r.text)[0]
    want = brute.targets(sizes)
    by = {r.source: r for r in docs.collect()}
    assert set(by) == set(want)
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(v, 6) for v in want.values()})
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    assert mixing.mix(empty(docs)).count() == 0


def test_taken_words_reach_the_target_and_training_rows_hold_them(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 90)), f"s{i % 7}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    mixed = mixing.mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in mixed)
    out = mixing.training_rows(docs)
    assert out.columns == docs.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in mixed)
    assert mixing.training_rows(empty(docs)).count() == 0


def test_curriculum_inverts_its_integral(spark):
    schedules = spark.createDataFrame([("=a", [(0.0, 0.0), (0.5, 2.0), (1.0, 2.0)]), ("=b", [(0.0, 3.0), (1.0, 3.0)])], "source string, knots array<struct<t:double,w:double>>")
    sizes = spark.createDataFrame([("=a", 100), ("=b", 300)], "source string, source_size long")
    plan = mixing.plan(sizes, schedules)
    for part, want in ((0.0, 0.0), (1 / 3, 0.5), (2 / 3, 0.75), (1.0, 1.0)):
        got = {r.source: r.t for r in plan.select("source", mixing.time_at(F.lit(part), F.col("segments")).alias("t")).collect()}
        assert abs(got["=a"] - want) < 1e-9 and abs(got["=b"] - part) < 1e-9


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df())


def test_keep_one_keeps_every_text_of_a_repeated_id(spark):
    """Two rows of one id with unlike texts are two groups; which row stays doesn't depend on the order of rows."""
    one, two = (" ".join(f"{w}{i}" for i in range(300)) for w in ("one", "two"))
    rows = [(7, one, "a"), (7, two, "b"), (7, two, "a"), (9, one, "c"), (3, two + " more", "d"), (8, one + " more", "e")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, id string").repartition(3)
        kept = simhash.keep_one(docs, simhash.similar_groups(docs))
        assert sorted(map(tuple, kept.collect())) == [(3, two + " more", "d"), (7, one, "a")]


def test_a_crowded_band_is_dealt_out_without_loss(spark, monkeypatch):
    """A band with more rows than a task takes finds the same groups as one task."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in rows]
    least = list(range(90))
    for i in range(90):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = [new if x == old else x for x in least]
    assert 5 < len(set(least)) < 80
    for most in (20_000, 13):
        monkeypatch.setattr(simhash, "RUN_ROWS", most)
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == dict(enumerate(least))


def test_the_pipeline_drops_what_links_by_fingerprint(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words).upper(), " ".join(words[::-1]), None, " ", " ".join([*words[:399], "other"])]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    prints = [simhash.simhash((t or "").lower().encode().split(), 3) for t in texts]
    far = lambda i, j: bin(prints[i] ^ prints[j]).count("1")
    want = [i for i in range(len(texts)) if not any(far(i, j) <= 3 for j in range(i))]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want
    linked = spark.createDataFrame([(i, f"a{i} b c d e") for i in range(300)], "doc_id long, text string")
    marks = [simhash.simhash(f"a{i} b c d e".encode().split(), 3) for i in range(300)]
    part = list(range(300))
    for _ in range(300):
        new = [min(part[j] for j in range(300) if bin(marks[i] ^ marks[j]).count("1") <= 3) for i in range(300)]
        if new == part:
            break
        part = new
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, linked, "").collect()) == sorted(set(part))
