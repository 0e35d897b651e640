"""Nearest neighbours, secrets, toxicity, quality, archives and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from furrow.llm import hilbert_ann, quality_pu, secrets, toxicity, warc
from furrow.llm.queries import QUERIES
from furrow.session import scratch
from tests.conftest import SF
from tests.llm import brute

SMALL = "/root/testdata/sf0.01"


def test_hilbert_keys_walk_the_cube():
    """All cells get keys of their own, and neighbours on the curve differ in one coordinate by one."""
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert_ann.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_nearest_with_ties_nulls_and_odd_rows(spark):
    rng = random.Random(1)
    rows = {i: [round(rng.gauss(0, 1), 2) for _ in range(8)] for i in range(0, 300)}
    rows[41] = list(rows[40])
    rows[43] = list(rows[40])
    bad = [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None] + [1.0] * 6), (404, [float("nan")] + [1.0] * 7), (405, [float("inf")] + [1.0] * 7), (406, [1.0] * 3), (None, [1.0] * 8)]
    frame = spark.createDataFrame([*rows.items(), (7, rows[7]), *bad], "vec_id long, embedding array<double>").withColumn("label", F.lit("clash"))
    got = hilbert_ann.search(frame, F.col("vec_id") % 20 == 0, k=5, width=8, block=64, query_block=8).collect()
    want = brute.nearest({k: np.array(v) for k, v in rows.items()}, [q for q in rows if q % 20 == 0], 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_fewer_candidates_than_asked_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = hilbert_ann.search(frame, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert hilbert_ann.search(frame.where("false"), F.lit(True)).count() == 0


def test_windows_alone_find_planted_neighbours(spark):
    """Where vectors have neighbours at all, the curves find most of them without the check."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((150, 32))
    rows = [(i, (centres[i % 150] + 0.05 * rng.standard_normal(32)).tolist()) for i in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = {i: np.array(v) for i, v in rows}
    want = {(q, v) for q, _, v, _ in brute.nearest(vectors, [q for q in vectors if q % 20 == 0], 5)}
    got = {(r.query_id, r.vec_id) for r in hilbert_ann.search(frame, F.col("vec_id") % 20 == 0, k=5, exact=False).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_windows_alone_reach_their_recall_without_structure(spark):
    """On the table of embeddings, as registered, 9 of 10 neighbours come from the windows."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in table.collect()}
    asked = [q for q in vectors if q % 20 == 0]
    want = {(q, v) for q, _, v, _ in brute.nearest(vectors, asked, 20)}
    got = {(r.query_id, r.vec_id) for r in hilbert_ann.search(table, F.col("vec_id") % 20 == 0, exact=False).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_groups_of_blocks_lose_nothing(spark, monkeypatch):
    """Many blocks under few descriptions give the same rows as all of them described."""
    monkeypatch.setattr(hilbert_ann, "MOST_DESCRIBED", 3 * (8 * 6 + 16))
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute.nearest({i: np.array(v) for i, v in rows}, list(range(0, 500, 20)), 5)
    got = hilbert_ann.search(frame, F.col("vec_id") % 20 == 0, k=5, curves=2, width=8, block=16, query_block=4).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


@pytest.fixture(scope="module")
def trees(spark):
    return secrets.train(secrets.labelled_findings(spark))


def test_secret_scan_finds_keys_and_leaves_look_alikes(spark, trees):
    key = hashlib.sha1(b"key").hexdigest()
    rows = [
        (1, f'text token = "{key}" more', "src1", True), (2, f"deploy api_key: '{base64.b32encode(b'secretsecretsecret12').decode()}9' now", "src1", True),
        (3, "call 2669109448945250 today", "src1", False), (4, f"commit {key} fixes it", "src1", False), (5, "order 123e4567-e89b-12d3-a456-426614174000 shipped", "src2", False),
        (6, None, "s", False), (7, "", None, False), (8, "nothing here", None, False), (9, f'token = "{key}"', None, True),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, secret boolean").withColumn("findings", F.lit("clash"))
    found = secrets.scan(docs, trees).where("is_secret").collect()
    assert {r.doc_id for r in found} == {d for d, *_, s in rows if s}
    texts = {d: t for d, t, *_ in rows}
    assert all(texts[r.doc_id][r.start : r.end] == r.candidate for r in found)
    clean = {r.doc_id: r.text for r in secrets.redact(docs.drop("findings"), trees).collect()}
    assert clean[1] == f'text token = "{secrets.MASK}" more' and clean[4] == texts[4] and clean[6] is None and clean[7] == ""
    assert secrets.scan(docs.where("false"), trees).count() == 0


def test_offsets_of_many_findings_in_a_long_text(spark, trees):
    parts = []
    for i in range(300):
        parts += [f"word{i} é", f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"']
    text = " ".join(parts)
    got = secrets.scan(spark.createDataFrame([(1, text, "s"), (1, text, "s")], "doc_id long, text string, source string"), trees).collect()
    assert len(got) == 600 and all(text[r.start : r.end] == r.candidate and r.is_secret for r in got)


def test_assigned_keys_are_cut_from_their_names(spark, trees):
    """The name and what stands before an earlier candidate are context, and a digit may come late."""
    key = hashlib.sha1(b"assigned").hexdigest()
    late = "aZ" * 150 + "7"
    rows = [(1, f"set token={key} now"), (2, f"SECRET_KEY={key}"), (3, f"commit {key}"), (4, f"APP_2_ACCESS_TOKEN={key}"), (5, f"see {late} there")]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("web")), trees).collect()
    by = {(r.doc_id, r.candidate): r for r in found}
    assert all(by[d, key].is_secret for d in (1, 2, 4)) and not by[3, key].is_secret
    assert (5, late) in by
    assert all(rows[r.doc_id - 1][1][r.start : r.end] == r.candidate for r in found)


def test_forest_on_findings_it_has_not_seen(spark, trees):
    fresh = secrets.labelled_findings(spark, 6000).orderBy("candidate")
    made = fresh.select(F.monotonically_increasing_id().alias("doc_id"), F.concat("left", "candidate", "right").alias("text"), F.col("path").alias("source"), "label", "candidate").where("length(candidate) >= 16").cache()
    found = secrets.scan(made, trees).groupBy("doc_id").agg(F.max(F.col("is_secret").cast("int")).alias("said"))
    wrong = made.join(found, "doc_id").where("said <> label").count()
    assert wrong <= 0.1 * made.count()


def test_expression_equals_the_forest(spark, trees):
    """The conditions vote as MLlib's own trees do."""
    import re

    def vote(tree: str, seen: list[float]) -> float:
        lines = [x for x in tree.split("\n")[1:] if x.strip()]
        depth, want = 0, None
        for line in lines:
            indent = (len(line) - len(line.lstrip()) - 1) // 1
            if want is not None and indent > depth:
                continue
            body = line.strip()
            if m := re.match(r"(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", body):
                holds = seen[int(m[2])] <= float(m[4]) if m[3] == "<=" else seen[int(m[2])] > float(m[4])
                want, depth = (None, depth) if holds else (indent, indent)
            elif body.startswith("Predict"):
                return float(body.split(":")[1])
        raise AssertionError("no leaf")

    values = [30.0, 0.4, 0.0, 0.6, 0.3, 1.0, 0.0, 0.4, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0]
    got = spark.range(1).select(secrets._score(trees, [F.lit(v) for v in values]).alias("s")).first().s
    assert abs(got - sum(vote(t, values) for t in trees) / len(trees)) < 1e-9


def labelled(spark, sf=SMALL):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_toxicity_on_texts_that_training_did_not_see(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    labels = labels.withColumn("junk", 1 - F.col("quality"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0
    chain = toxicity.train(docs, labels.where(~held), ["junk", "toxic"])
    some = docs.join(labels.where(held), "doc_id").select("toxic", toxicity.probabilities("text", chain)[1].alias("p")).collect()
    caught = [r.p >= 0.5 for r in some if r.toxic]
    assert sum(caught) >= 0.88 * len(caught) and len(caught) > 30
    assert sum(r.p >= 0.5 for r in some if not r.toxic) <= 0.01 * len(some)


def test_toxicity_of_odd_rows_and_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (1, "idiot " * 3000), (2, "fine words")], "doc_id long, text string").withColumn("p_toxic", F.lit("clash"))
    none = toxicity.classify(docs, spark.createDataFrame([], "doc_id long, toxic int"), ["toxic"]).collect()
    assert all(r.p_toxic is None and r.is_toxic is False for r in none)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.classify(docs, labels, ["toxic"]).count() == 4
    assert toxicity.classify(docs.where("false"), labels, ["toxic"]).count() == 0


def test_later_links_learn_from_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    first = rng.integers(0, 2, 400)
    hits = [np.array([0]) if f else np.array([1]) for f in first]
    chain = toxicity.fit_chain(["a", "b"], {"x": 0, "y": 1}, hits, np.column_stack([first, first]).astype(float))
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][2] > 0
    assert chain([0])[1] > 0.9 and chain([1])[1] < 0.1


def test_quality_on_held_out_labels(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    got = quality_pu.classify(docs, labels).join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.quality == r.predicted for r in got) >= 0.97 * len(got)
    assert all(r.predicted == 1 for r in got if r.quality == 1 and r.score >= 0.3)


def test_quality_never_reads_held_out_labels(spark):
    docs, labels = labelled(spark)
    turned = labels.withColumn("quality", F.when(quality_pu.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_pu.train(docs, x) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_quality_of_odd_rows(spark):
    docs, labels = labelled(spark, SF)
    odd = spark.createDataFrame([(None, None), (5, ""), (5, ""), (6, "x " * 60_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = quality_pu.classify(odd, labels).collect()
    assert len(got) == 4 and all(r.score is not None for r in got)
    assert quality_pu.classify(odd.where("false"), labels).count() == 0
    assert {r.score for r in quality_pu.classify(odd, labels.where("false")).collect()} == {0.5}


def test_negative_risk_is_held_at_zero():
    """With a prior far too high the plain estimate would go below zero; the fit stays finite and orders the classes."""
    rng = np.random.default_rng(1)
    good = rng.normal(1, 0.3, (200, 2))
    mixed = np.vstack([rng.normal(1, 0.3, (100, 2)), rng.normal(-1, 0.3, (100, 2))])
    model = quality_pu.fit_nnpu(good, mixed, 0.7)
    assert np.isfinite(model.weights).all()
    assert model(good).mean() > model(rng.normal(-1, 0.3, (50, 2))).mean()


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_lines_of_both_versions(version):
    body = b"HTTP/1.1 200 OK\r\nX-Source-Id: 7\r\n\r\n<p>\n\nhttp://x 0 0 0 5\n</p>"
    data = warc.arc_version_block("a.arc", version) + warc.arc_record("http://ex.org/a b?q=é", body, version) + b"\n" + warc.arc_record("", b"", version, "20200102")
    first, second = warc.read_arc(io.BytesIO(data))
    assert first.url == "http://ex.org/a%20b?q=%C3%A9" and first.body == body and first.http()[2].endswith(b"</p>")
    assert second.url == "about:blank" and second.body == b"" and warc.iso_date(second.date) == "2020-01-02T00:00:00Z"


def test_cut_off_arc_is_an_error():
    data = warc.arc_record("http://x", b"12345")
    with pytest.raises(ValueError, match="declares"):
        list(warc.read_arc(io.BytesIO(data[:-4])))


def test_archives_round_trip(spark):
    long = "<p>" + "lang und breit " * 20_000 + "</p>"
    same = "x" * 1200
    rows = [(1, "http://a/1", same), (2, "http://a/2", same), (9, "http://a/9", same), (3, None, None), (4, "", ""), (5, "http://a b/é", "short"), (6, "http://a/6", "short"), (7, "http://a/7", long), (None, "http://n", same), (7, "http://a/7", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("clash")).repartition(3)
    manifest, folder = warc.archive_pages(pages)
    got = warc.warc_records(manifest, folder, with_payload=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert by["9"][0].record_type == "response" and {by[k][0].refers_to_source for k in ("1", "2", None) if by[k][0].payload_bytes == 1200} == {"9"}
    assert sorted(r.record_type for r in by["7"]) == ["response", "revisit"]
    assert by["5"][0].record_type == by["6"][0].record_type == "response" and by["3"][0].payload_bytes == 0
    for source, html in ((str(i) if i is not None else None, h or "") for i, _, h in rows):
        assert any(r.payload_digest == hashlib.sha1(html.encode()).hexdigest() and r.payload_bytes == len(html.encode()) for r in by[source])
    stream = warc._Folder(folder).read(manifest.first().archive)
    assert next(warc.read_warc(stream)).kind == "warcinfo"
    assert warc.archive_pages(pages.where("false"))[0].count() == 0


def test_archives_are_members_of_their_own(spark):
    manifest, folder = warc.archive_pages(spark.createDataFrame([(1, "http://a", "a" * 50), (2, "http://b", "b" * 50)], "page_id long, url string, html string").coalesce(1))
    where, path = warc._Folder(folder).open()
    raw = where.open_input_stream(f"{path}/{manifest.first().archive}", compression=None).read()
    assert raw.count(b"\x1f\x8b\x08") >= 3 and gzip.decompress(raw).count(b"WARC/1.0") == 3


def test_pipeline_stages_one_by_one(spark):
    """Each stage on what the one before kept, against what it must do."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    columns, now = docs.columns, docs
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        path = scratch(spark, "test-stage")
        stage(spark, now, SMALL).write.parquet(path)
        now = spark.read.parquet(path)
        frames.append(now)
    quality, dedup, clean, mixed, coded = frames
    assert all(f.columns == columns for f in frames[:-1])
    kept = {r.doc_id for r in quality.collect()}
    assert sum(q == 1 and d not in kept for d, q in labels.items()) == 0
    assert sum(q == 0 and d in kept for d, q in labels.items()) <= 3
    texts = [r.text for r in dedup.collect()]
    assert len(texts) == len(set(texts)) and {r.doc_id for r in dedup.collect()} <= kept
    assert len({r.text for r in quality.collect()} - set(texts)) < 0.2 * len(texts)
    assert clean.count() == dedup.count() and not [r for r in clean.collect() if 'token = "' in r.text and secrets.MASK not in r.text]
    assert all(r.n_chars == len(r.text) for r in mixed.collect())
    sizes: dict = {}
    for r in clean.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.WORD.findall(r.text))
    taken: dict = {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(brute.WORD.findall(r.text))
    assert all(abs(taken.get(s, 0) - v) <= 1 for s, v in brute.targets(sizes).items())
    assert coded.count() == mixed.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in coded.collect())


def test_pipeline_stages_on_awkward_documents(spark):
    """Nulls everywhere, blank and very long texts, repeated rows, no rows at all, and columns named like results."""
    long = " ".join(f"w{i % 5003}" for i in range(40_000))
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "plain words of a text without an id", None, "s", 9), (4, f'set token = "{key}" here', "en", None, 5), (None, None, None, None, None)]
    names = ["score", "predicted", "held_out", "findings", "_pieces", "size", "target", "position", "component_id", "fingerprint", "words", "node", "ids", "n_tokens", "b"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in names:
        docs = docs.withColumn(n, F.lit("clash"))
    for now in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            path = scratch(spark, "test-stage")
            out = stage(spark, now, SF)
            assert name == "bpe" or out.columns == docs.columns
            assert name == "bpe" or all(r.score == r.findings == r.size == "clash" for r in out.collect())
            out.write.parquet(path)
            now = spark.read.schema(out.schema).parquet(path)
            if name == "secret scan" and docs.count() and now.count():
                assert not now.where(F.col("text").contains(key)).count()


def test_run_gives_what_the_stages_give(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and "op6_quality_classifier" in QUERIES


def test_captures_of_hot_digests_point_to_the_same_one(spark, monkeypatch):
    """Hot, shared, lone and small payloads: the decision doesn't depend on what counts as hot."""
    rng = random.Random(6)
    rows = [("a" if i % 2 else "b", i, f"http://x/{i}", "20240101", rng.choice([str(i), str(i), None, "7"]), rng.choice([10, 5000, None]), rng.choice(["hot", "hot", "hot", f"d{i % 9}", f"lone{i}"])) for i in range(120)]
    captures = spark.createDataFrame(rows, "archive string, offset long, url string, date string, source string, n_bytes long, digest string")
    rank = lambda r: (r[4] is not None, int(r[4] or 0), r[0], r[1])
    want = {}
    for r in rows:
        own = [x for x in rows if x[6] == r[6] and (x[5] or 0) >= warc.LEAST_SHARED] if (r[5] or 0) >= warc.LEAST_SHARED else []
        best = max(own, key=rank, default=None)
        want[r[1]] = best[2] if best is not None and best[:2] != r[:2] else None
    for most in (10**6, 3):
        monkeypatch.setattr(warc, "hot_from", lambda rows, most=most: most)
        got = warc.revisits(captures).collect()
        assert len(got) == len(rows)
        assert {r.offset: r.of_url for r in got} == want and all(r.again == (r.of_url is not None) for r in got)


def test_toxicity_folds_keep_copies_and_repeated_ids_together(spark):
    """Marks of a fold come from the others alone: a word that one text's copies hold is no mark without them."""
    rows = [(i, f"fine words here number{i % 7} again and more") for i in range(60)] + [(100 + i, "zork blarg said fine words") for i in range(8)]
    labels = spark.createDataFrame([(i, int(i >= 100), int(i >= 100)) for i, _ in rows], "doc_id long, junk int, toxic int")
    chain = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, ["junk", "toxic"])
    zork = chain.vocabulary["zork"]
    # Out of fold the copies' own words were unknown, so the first link's probability tells the second little.
    assert chain.weights[0][zork] > 0 and chain.weights[1][zork] > 0
    assert chain(sorted(chain.vocabulary[m] for m in toxicity.marks("zork blarg") if m in chain.vocabulary))[1] > 0.5
