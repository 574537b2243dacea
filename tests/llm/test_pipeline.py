import hashlib
import os
import random

import corpus_pipeline
from fluxlane.llm import decontamination, quality, secrets
from samples import ODD, words
from test_secrets import brute
from test_simhash import stay


def test_stages_against_plain_code(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [decontamination.normalized(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in docs.collect()}
        assert k == 4 or docs.columns == columns
        if k == 0:
            model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            good = quality.score_texts([r.text for r in before.values()], model) >= 0.3
            assert set(after) == {i for i, g in zip(before, good) if g} and 0 < len(after) < len(before)
        elif k == 1:
            assert sorted(((i, r.text) for i, r in after.items()), key=str) == stay([(i, r.text) for i, r in sorted(before.items())])
        elif k == 2:
            matcher = decontamination.Matcher(items)
            assert set(after) == {i for i, r in before.items() if not matcher.find(decontamination.normalized(r.text))}
            assert not any(x in decontamination.normalized(r.text) for x in items for r in after.values())
        elif k == 3:
            assert set(after) == set(before) and all(after[i].text == secrets.redact(r.text) for i, r in before.items())
            assert not any(brute(r.text) for r in after.values())
        else:
            assert set(after) == set(before) and all(r.taken <= 3 * r["size"] and r["size"] == len(before[i].text.encode().split()) for i, r in after.items())


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and rows.count() > 0
    digest = lambda d: hashlib.sha256(str(sorted(map(tuple, d.collect()))).encode()).hexdigest()
    assert digest(rows) == digest(corpus_pipeline.run(spark, "/root/testdata/sf0.001"))


def test_odd_rows_and_empty_tables(spark, make_docs, tmp_path):
    rng = random.Random(2)
    good = [(100 + i, words(rng, 60), "en", [None, "a", "b"][i % 3]) for i in range(40)]
    rows = [*good, good[3], (None, words(rng, 70), "en", None), *ODD]
    sf = "/root/testdata/sf0.001"
    for name, docs in (("odd", make_docs(rows)), ("none", make_docs([]))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            if k:  # each stage by itself, and all in a row
                out = stage(spark, docs, sf)
                assert out.count() == {"none": 0}.get(name, out.count()) and (k == 4 or out.columns == docs.columns)
        kept = corpus_pipeline.near_duplicates(spark, docs, sf)
        assert sum(r.doc_id == 103 for r in kept.collect()) == (name == "odd")
        folder = tmp_path / name
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
        assert corpus_pipeline.run(spark, str(folder)).count() == 0  # no labels: nothing is good


def test_only_the_last_stage_is_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "scratch", lambda spark: str(tmp_path))
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [sorted(os.listdir(tmp_path / x)) for x in os.listdir(tmp_path)] == [["4"]] and rows.count() > 0
