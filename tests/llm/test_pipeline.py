"""The pipeline's stages, one by one, against plain definitions."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from ebbflow.llm import quality_classifier

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = before
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "quality_classifier":
            model = quality_classifier.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
            scores = {i: float(model.score(quality_classifier._matrix(_text(r["text"])))[0]) for i, r in before.items()}
            assert set(after) == {i for i, s in scores.items() if s >= corpus_pipeline.LEAST_SCORE}
            good = {r["doc_id"] for r in labels.where("quality = 1").collect()} & set(before)
            assert len(good & set(after)) >= 0.9 * len(good)
        elif name == "quality_rules":
            failed = {i for i, r in before.items() if brute.rule_counts(r["text"])[5]}
            assert not failed & set(after) and len(after) >= 0.9 * (len(before) - len(failed))
        elif name == "simhash":
            found = brute.components_of_rows([(i, r["text"]) for i, r in sorted(before.items())])
            assert set(after) == {component for _, _, component in found}
        elif name == "substring":
            ids = sorted(before)
            for i, (n, gone, digest) in zip(ids, brute.repeats([before[i]["text"] for i in ids]), strict=True):
                text = after[i]["text"]
                if gone:
                    assert brute.sha((text or "").encode()) == digest and after[i]["n_chars"] == len(text)
                else:
                    assert text == before[i]["text"] and len(brute.words(text)) == n
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces: dict = {}
    for r in docs.orderBy("doc_id", "start").collect():
        pieces.setdefault(r["doc_id"], []).extend(r["ids"])
    for i, r in kept["packing"].items():
        assert pieces[i] == [*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 1]


def _text(text):
    import pyarrow as pa

    return pa.array([text], pa.string())


def test_run_equals_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(rows.columns)
    assert rows.agg(F.max(F.size("ids"))).first()[0] <= 2048
