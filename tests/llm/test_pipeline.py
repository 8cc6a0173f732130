"""The pipeline's stages against brute force, stage by stage, and as a whole."""

import hashlib
import os

import numpy as np
import public_tokenizers as P
import tiktoken
from .test_jaccard import brute

import corpus_pipeline
from wefthread.llm import bpe, common, mixing, quality, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = docs.columns
    steps = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        steps.append(docs.collect())
        if i < 4:
            assert docs.columns == names
    raw = spark.read.parquet(f"{SF}/documents.parquet").collect()
    kept = {r.doc_id for r in quality.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect() if r.predicted}
    assert {r.doc_id for r in steps[0]} == kept and len(steps[0]) == len(kept)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good - kept) <= 1
    by = {r.doc_id: r for r in raw}
    assert all(r == by[r.doc_id] for r in steps[0])
    groups = brute([(r.doc_id, r.text) for r in steps[0]])
    assert sorted(r.doc_id for r in steps[1]) == sorted(i for i, _, c in groups if i == c)
    assert {r.doc_id for r in steps[2]} == {r.doc_id for r in steps[1]}
    assert sum(a.text != by[a.doc_id].text for a in steps[2]) == sum("[SECRET]" in a.text for a in steps[2])
    copies = {r.doc_id: r.copies if r.size else 1 for r in mixing.mix(spark.read.parquet(f"{tmp_path}/2")).collect()}
    counts = {}
    for r in steps[3]:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {i: c for i, c in copies.items() if c}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})
    text = {r.doc_id: r.text for r in steps[3]}
    assert len(steps[4]) == len(steps[3])
    for r in steps[4]:
        assert r.ids == np.array(library.encode_ordinary(text[r.doc_id]), "<u4").tobytes()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == sorted((r.doc_id, r.ids_sha256) for r in steps[4])


def test_take_repeated_rows(spark):
    rows = [(1, "a b", "en", "x", 3)] * 5 + [(2, None, None, None, None), (None, "q r s", "en", "y", 5), (3, "c d", "en", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.take(docs).collect()
    want = sum(r.copies if r.size else 1 for r in mixing.mix(docs).collect())
    assert len(got) == want and sum(r.doc_id == 2 for r in got) == 1
    assert mixing.take(docs.limit(0)).collect() == []


def redacted(text, network):
    parts, end = [], 0
    for s, e, _, _ in secret_scan.scan([text], network)[0]:
        if s >= end:
            parts += [text[end:s], "[SECRET]"]
        end = max(end, e)
    return "".join(parts) + text[end:]


def test_run_odd_rows(spark, tmp_path):
    """Nulls in any column, blank and repeated rows, an empty table; nothing left behind but the result."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    names = base.columns
    some = [tuple(r) for r in base.collect()]
    one = dict(zip(names, some[0]))
    odd = [tuple({**one, **change}[c] for c in names) for change in ({"doc_id": None}, {"doc_id": 90001, "text": None}, {"doc_id": 90002, "text": "", "source": None}, {"doc_id": 90003, "lang": None, "n_chars": None}, {"doc_id": 90004, "text": one["text"] * 50})]
    docs = spark.createDataFrame(some + some[:10] + odd, base.schema)
    for name, rows in (("odd", docs), ("empty", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    folder = common.shared_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    new = set(os.listdir(folder)) - before
    assert len(new) == 1 and os.listdir(f"{folder}/{new.pop()}") == ["4"]
    text = {}
    for r in docs.collect():
        text.setdefault(r.doc_id, set()).add(r.text or "")
    network = secret_scan.model()
    digests = {i: {hashlib.sha256(redacted(t, network).encode()).hexdigest() for t in ts} for i, ts in text.items()}
    assert got and all(r.decoded_sha256 in digests[r.doc_id] for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []


def test_dropping(spark):
    with common.dropping(spark):
        kept = common.cut(spark.range(5).toDF("x"))
        assert kept.count() == 5
        path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert os.path.isdir(path)
    assert not os.path.exists(path)
    assert common._FOLDERS == []


def test_every_stage_begins_with_heaps_given_back(spark, monkeypatch):
    """A stage of itself, without its operator, collects what the steps before left in the executors' heaps."""
    for module, name in ((corpus_pipeline.quality, "keep_good"), (corpus_pipeline.jaccard, "keep_one"), (secret_scan, "redact"), (mixing, "take"), (bpe, "encode_documents")):
        monkeypatch.setattr(module, name, lambda docs, *_, **__: docs)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    whole = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    for name, stage in corpus_pipeline.STAGES:
        before = whole()
        stage(spark, docs, SF)
        assert whole() > before, name
