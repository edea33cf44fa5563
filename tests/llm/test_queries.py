"""The registered queries on the smallest tables, against brute force."""

from __future__ import annotations

import base64
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

import brute
from ebbflow.llm import queries, quality_classifier

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    table = pq.read_table(f"{SF}/documents.parquet")
    return list(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True))


def collected(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def run(spark, name):
    found = queries.queries()
    key = next(k for k in found if k.startswith(name))
    return found[key](spark, SF)


def test_quality_rules(spark, documents):
    out = run(spark, "op1_")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert collected(out, "doc_id", *columns) == sorted((i, *brute.rule_counts(t)) for i, t in documents)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = sorted(out.columns)
    expected = con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op1_quality_rules']}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in out.select(*names).orderBy("doc_id").collect()] == expected


@pytest.mark.parametrize("name", ["op5_substring", "op8_chat_format"])
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    out = run(spark, name)
    names = sorted(out.columns)
    expected = con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in out.select(*names).collect()) == sorted(expected)


def test_simhash(spark, documents):
    assert collected(run(spark, "op2_"), "doc_id", "fingerprint", "component_id") == sorted(brute.components_of_rows(documents))


def test_token_output(spark, documents):
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, expected = 0, []
    for doc_id, text in sorted(documents, key=lambda d: d[0]):
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), brute.crc(ids)))
        start += len(ids)
    assert collected(run(spark, "op3_"), "doc_id", "start", "n_tokens", "ids_crc32") == expected


def test_byte_bpe(spark, documents):
    path = Path(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.open("rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for doc_id, text in documents:
        ids = encoding.encode_ordinary(text or "")
        expected.append((doc_id, len(ids), brute.sha(np.array(ids, dtype="<u4").tobytes()), brute.sha((text or "").encode())))
    assert collected(run(spark, "op4_"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected)


def test_substring(spark, documents):
    expected = sorted((i, *found) for (i, _), found in zip(documents, brute.repeats([t for _, t in documents]), strict=True))
    assert collected(run(spark, "op5_"), "doc_id", "n_words", "n_removed", "kept_sha256") == expected


def test_token_counts(spark, documents):
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    langs = pq.read_table(f"{SF}/documents.parquet").column("lang").to_pylist()
    lengths: dict = {}
    for (_, text), lang in zip(documents, langs, strict=True):
        lengths.setdefault(lang, []).append(len(encoder.encode(text or "", add_special_tokens=False).ids))
    expected = []
    for lang, found in lengths.items():
        for n in set(found):
            above = [v for v in found if v >= n]
            expected.append((lang, n, found.count(n), len(above), sum(above), len(found), sum(found), sum(min(v, n) for v in found)))
    columns = ["lang", "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "group_docs", "group_tokens", "truncated_tokens"]
    assert collected(run(spark, "op6_"), *columns) == sorted(expected)


def test_quality_classifier(spark, documents):
    out = {r["doc_id"]: r for r in run(spark, "op7_").collect()}
    assert sorted(out) == sorted(i for i, _ in documents)
    import zlib

    labels = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    right = total = 0
    for doc_id, quality in zip(labels["doc_id"], labels["quality"], strict=True):
        row = out[doc_id]
        assert row["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.7)
        if row["held_out"]:
            total += 1
            right += (row["score"] >= 0.5) == quality
    assert right / total > 0.8


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality_classifier.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_classifier.fit(docs, labels), quality_classifier.fit(docs, turned)
    assert a.n_rows == b.n_rows and np.array_equal(a.threshold, b.threshold) and np.array_equal(a.leaf, b.leaf)


def test_chat(spark):
    table = pq.read_table(f"{SF}/conversations.parquet").to_pydict()
    turns: dict = {}
    for conv, turn, role, text in sorted(zip(*(table[c] for c in ("conv_id", "turn", "role", "text")), strict=True), key=lambda r: r[:2]):
        turns.setdefault(conv, []).append((role, text or ""))
    said = "\\### Assistant: </turn> ok"
    turns[-7] = [("user", said), ("assistant", said)]
    out = run(spark, "op8_")
    assert collected(out, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted((c, *brute.chat_digest(t)) for c, t in turns.items())


def test_packing(spark, documents):
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = run(spark, "op9_").collect()
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 for r in rows)
    for doc_id, text in documents:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces.pop(doc_id), key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == brute.crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    assert not pieces


def test_nearest_neighbours(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet")
    ids = table.column("vec_id").to_numpy()
    vectors = np.array(table.column("embedding").to_pylist(), dtype=np.float64)
    expected = brute.nearest(ids, vectors)
    found: dict = {}
    for r in run(spark, "op10_").orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(found) == sorted(expected)
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert hits / sum(map(len, expected.values())) >= 0.9
    exact = {(q, v): s for q in expected for v, s in expected[q]}
    for q, near in found.items():
        assert len(near) == 5 and near == sorted(near, key=lambda n: (-n[1], n[0]))
        assert all(abs(exact[q, v] - s) < 1e-12 for v, s in near if (q, v) in exact)
