"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import random
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from ebbflow.llm import ann, byte_bpe, chat, packing, quality_classifier, quality_rules, simhash, substring, token_counts, token_output
from ebbflow.llm.shared import ensure_checkpoint_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
JSON, RANKS, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
rng = random.Random(4)
VOCABULARY = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
PASSAGE = " ".join(rng.choices(VOCABULARY, k=60))
LONG = " ".join(rng.choices(VOCABULARY, k=30_000)) + " " + "x" * 50_000
ODD = "Ünï cödé  \x1c\x85 \t\r\n\n  ẞ İ 漢字かな 🙂‍🙂 é ﻿\x00 ends"
TEXTS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, f"a b {PASSAGE} c d"), (6, f"{PASSAGE} e"), (7, f"a b {PASSAGE} c d"), (7, f"a b {PASSAGE} c d"), (None, PASSAGE), (None, "lone words here"),
    (8, LONG), (9, LONG + " tail"), (10, ODD), (11, ODD.replace(" ", "\n")), (12, "the the " * 200), (13, "\n".join(["same line"] * 30)), (14, "###" * 400),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 5 == 0 else "en" if k % 2 else "xx", None, None if t is None else len(t)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    """Columns that the operators use inside."""
    names = ["k1", "k2", "h1", "marks", "fp", "kept", "n_words", "row", "id", "root", "words", "place", "h", "score", "start", "ids"]
    return docs.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((v is not None, v) if not isinstance(v, list) else (True, tuple(v)) for v in row)


def collected(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=key)


def test_quality_rules(docs, clashing, none):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    expected = sorted(((i, *brute.rule_counts(t)) for i, t in TEXTS), key=key)
    assert collected(quality_rules.quality_rules(docs), *columns) == expected
    assert collected(quality_rules.quality_rules(clashing), *columns) == expected
    assert quality_rules.quality_rules(none).count() == 0 and quality_rules.keep_good(none).columns == none.columns
    assert quality_rules.keep_good(clashing).columns == clashing.columns


def test_simhash(docs, clashing, none):
    for frame in (docs, clashing):
        found = simhash.near_duplicates(frame).collect()
        assert sorted(r["fingerprint"] for r in found) == sorted(f"{brute.fingerprint(t):016x}" for _, t in TEXTS)
        by_mark = {}
        for r in found:
            by_mark.setdefault(r["fingerprint"], set()).add(r["component_id"])
        assert all(len(v) == 1 for v in by_mark.values())
        assert by_mark["0" * 16] == {1}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns and collected(kept.where("doc_id in (1, 2, 3)"), "doc_id") == [(1,)]
    assert simhash.keep_one(none).count() == 0


def test_simhash_keeps_rows_without_duplicates(spark):
    """An id that occurs on a copy and on another text: the other text stays."""
    a, b = " ".join(VOCABULARY[:40]), " ".join(VOCABULARY[100:140])
    rows = [(1, a), (7, a), (7, b), (1, b[::-1]), (None, a), (None, "alone in the world"), (9, "alone in the world"), (None, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = collected(simhash.keep_one(frame), "doc_id", "text")
    # a null text is an empty one, so the last two rows are alike
    assert kept == sorted([(1, a), (7, b), (1, b[::-1]), (9, "alone in the world"), (None, None), (None, "")], key=key)


def test_hub_joins_are_split(spark):
    """A node with very many edges: Spark splits the join that hands it its least neighbour."""
    from ebbflow.llm import components

    settings = {"adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "adaptive.advisoryPartitionSizeInBytes": "64k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "8"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in settings}
    for k, v in settings.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        edges = spark.range(1, 200_001).select(F.col("id").alias("hi"), F.lit(0).cast("long").alias("lo"))
        out = components._star(edges, True)
        assert out.count() == 200_000
        rows = out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString() and len(rows) == 200_000
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)


def test_simhash_links_all_near_pairs(spark):
    """Random fingerprints in clusters of every shape, with a crowd that no bucket may gather."""
    from ebbflow.llm.components import components

    draw = random.Random(9)
    fps = set()
    for _ in range(40):
        centre = draw.getrandbits(64)
        for _ in range(12):
            v = centre
            for b in draw.sample(range(64), draw.randint(0, 3)):
                v ^= 1 << b
            fps.add(v)
    crowd = draw.getrandbits(64)
    for a in range(64):
        for b in range(a, 64, 3):
            fps.add(crowd ^ 1 << a ^ (1 << b if a != b else 0))
    fps = sorted(fps)
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(nodes, most_candidates=8)).collect()}
    expected = brute.components(dict(enumerate(fps)))
    groups: dict = {}
    for k, v in enumerate(signed):
        groups.setdefault(found.get(v, v), set()).add(k)
    plain: dict = {}
    for k, r in expected.items():
        plain.setdefault(r, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_encoders_equal_the_library():
    """Random strings of letters with odd lower cases, marks, digits and every kind of white space."""
    import numpy as np

    from ebbflow.llm.shared import library_encoder

    draw = random.Random(17)
    letters, marks, digits = "abIZéßñİıŉǰΣσςΐΰẞﬁªºǅՙ漢字かàÁ\u0307\u0301ȩŽҐ", ".,!?;:*$%&#'\"-()<|>_", "0123456789²½Ⅷ٣"
    spaces = ["  ", *"\n\t\r\x0b\x0c\x85\xa0\u2003\u2028\u202f\u3000\x1c\x1f\u200b\ufeff"]
    kinds = [lambda: "".join(draw.choices(letters, k=draw.randint(1, 5))), lambda: "".join(draw.choices(marks, k=draw.randint(1, 3)))]
    kinds += [kinds[0], lambda: draw.choice(["'s", "'re", "ALİ.", "🙂", "\u200d", "".join(draw.choices(digits, k=2))]), lambda: draw.choice(spaces), lambda: " "]
    for path, drops_space in ((WORDS, True), (JSON, False)):
        library, own = Tokenizer.from_file(path), library_encoder(path, drops_space)
        for _ in range(60_000):
            text = "".join(draw.choice(kinds)() for _ in range(draw.randint(1, 8)))
            assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(library_encoder(WORDS, True).encode("ALİ. geldi"), dtype="<u4").tolist() == [3558, 136, 229, 269, 7343, 1618]


def test_token_output(spark, docs, clashing, none):
    encoder = Tokenizer.from_file(WORDS)
    for frame, texts in ((docs, TEXTS), (clashing, TEXTS), (none, [])):
        path = f"{ensure_checkpoint_dir(spark)}/tokens-{random.random()}"
        token_output.write_token_files(frame, path, WORDS, end_id=2, drops_space=True)
        found = token_output.token_digests(spark, path).collect()
        expected = []
        for i, t in texts:
            ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 2]
            expected.append((i, len(ids), brute.crc(ids)))
        assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found), key=key) == sorted(expected, key=key)
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        if texts:
            by_place = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
            assert by_place == sorted(by_place, key=lambda v: (v is not None, v or 0))
            assert {r["doc_id"] for r in token_output.lookup(spark, path, [7, 12]).collect()} == {7, 12}


def test_byte_bpe(docs, clashing, none):
    import tiktoken

    ranks = byte_bpe.load_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = sorted(((i, tuple(encoding.encode_ordinary(t or ""))) for i, t in TEXTS), key=key)
    for frame in (docs, clashing):
        encoded = byte_bpe.encode_documents(frame, RANKS, public_tokenizers.PATTERN)
        assert sorted(((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()), key=key) == expected
    decoded = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(((r["doc_id"], bytes(r["bytes"])) for r in decoded.collect()), key=key) == sorted(((i, (t or "").encode()) for i, t in TEXTS), key=key)
    assert byte_bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_merges_like_the_definition():
    """Ranks over two letters: every order of merges occurs."""
    draw = random.Random(3)
    for trial in range(60):
        parts = [b"a", b"b", b"c"]
        tokens = set(parts)
        while len(tokens) < 30:
            tokens.add(draw.choice(sorted(tokens)) + draw.choice(sorted(tokens)))
        order = sorted(tokens - set(parts), key=lambda t: (len(t), draw.random()))
        ranks = {t: k for k, t in enumerate([*parts, *order])} | {bytes([v]): 1000 + v for v in range(256) if bytes([v]) not in tokens}
        bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
        text = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 120)))
        pieces = [text[i : i + 1] for i in range(len(text))]
        while len(pieces) > 1 and text not in ranks:
            best = min(((ranks.get(pieces[i] + pieces[i + 1], 1 << 60), i) for i in range(len(pieces) - 1)))
            if best[0] == 1 << 60:
                break
            pieces[best[1] : best[1] + 2] = [pieces[best[1]] + pieces[best[1] + 1]]
        assert bpe.merge(text) == ([ranks[text]] if text in ranks else [ranks[p] for p in pieces]), trial


def test_substring(spark, docs, clashing, none):
    expected = sorted(((i, *found) for (i, _), found in zip(TEXTS, brute.repeats([t for _, t in TEXTS]), strict=True)), key=key)
    for frame in (docs, clashing):
        assert collected(substring.repeat_digests(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == expected
    assert substring.repeat_digests(none).count() == 0
    cut = substring.remove_repeats(clashing)
    assert cut.columns == clashing.columns and cut.count() == len(TEXTS)
    assert collected(cut.where("doc_id = 6"), "text", "k1") == [("e", "clash")]


def test_substring_random_overlaps(spark):
    draw = random.Random(12)
    texts = []
    for i in range(60):
        parts = []
        for _ in range(draw.randint(1, 4)):
            a = draw.randint(0, 300)
            parts += draw.choice([VOCABULARY[:], VOCABULARY[::-1]])[a : a + draw.randint(5, 90)]
        texts.append((i, " ".join(parts)))
    texts.append((60, "w " * 150))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for window, part in ((35, 14), (10, 10), (12, 3)):
        expected = sorted((i, *found) for (i, _), found in zip(texts, brute.repeats([t for _, t in texts], window), strict=True))
        assert collected(substring.repeat_digests(frame, window=window, part=part), "doc_id", "n_words", "n_removed", "kept_sha256") == expected


def test_substring_incremental(spark):
    """Two batches through one index: the second sees the first, and compaction changes nothing."""
    draw = random.Random(5)
    texts = [(i, " ".join(draw.choices(VOCABULARY, k=40)) + " " + (PASSAGE if i % 3 == 0 else "")) for i in range(30)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    old, new = frame.where("doc_id < 15"), frame.where("doc_id >= 15")
    whole = dict((r[0], r) for r in collected(substring.repeat_digests(frame), "doc_id", "n_words", "n_removed", "kept_sha256"))
    for most_runs in (4, 1):
        index = substring.FingerprintIndex(spark, f"{ensure_checkpoint_dir(spark)}/index-{most_runs}-{random.random()}", most_runs=most_runs)
        index.add(old)
        found = collected(substring.repeat_digests(new, index, old), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert found == sorted(whole[i] for i in range(15, 30))
        assert len(index.runs) == (3 if most_runs == 4 else 1) and len(index.positions) == 3


def test_index_is_taken_up_from_its_folder(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"{VOCABULARY[i]} {PASSAGE} {VOCABULARY[-i]}") for i in (1, 2, 3)], "doc_id long, text string")
    alone = spark.createDataFrame([(4, PASSAGE)], "doc_id long, text string")
    for most_runs in (4, 1):
        path = str(tmp_path / f"reopened-{most_runs}")
        first = substring.FingerprintIndex(spark, path, most_runs=most_runs)
        first.add(frame.where("doc_id = 1"))
        first.add(frame.where("doc_id > 1"))
        again = substring.FingerprintIndex(spark, path, most_runs=most_runs)
        assert again.entries().count() == first.entries().count() and sorted(again.runs) == sorted(first.runs)
        # a batch that was written but not committed is not part of the index
        (Path(path) / "run_lost").mkdir()
        assert sorted(substring.FingerprintIndex(spark, path).runs) == sorted(first.runs)
        assert {p.name for p in Path(path).glob("run_*")} == {*first.runs, "run_lost"}
        assert substring.repeat_digests(alone, again, frame).first()["n_removed"] == 60
        with pytest.raises(ValueError):
            substring.FingerprintIndex(spark, path, window=20)


def test_runs_are_merge_joined_as_they_lie(spark):
    """No shuffle and no sort between the sorted runs of an index."""
    index = substring.FingerprintIndex(spark, f"{ensure_checkpoint_dir(spark)}/merged-{random.random()}")
    for k in range(2):
        index.add(spark.createDataFrame([(k, f"{VOCABULARY[k]} {PASSAGE}")], "doc_id long, text string"))
    with substring._file_order_trusted(spark):
        plan = index.recurring(index.runs[1])._jdf.queryExecution().executedPlan().toString()
        assert index.recurring(index.runs[1]).count() > 0
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


@pytest.mark.parametrize("full", [0.25, -1.0])
def test_substring_with_and_without_sieves(spark, monkeypatch, full):
    """Sieves that are full are left out; the result is the same."""
    monkeypatch.setattr(substring, "FULL", full)
    draw = random.Random(31)
    texts = [(i, " ".join(draw.choices(VOCABULARY, k=30)) + " " + " ".join(PASSAGE.split()[draw.randint(0, 9) :]) + f" end{i}") for i in range(20)]
    texts += [(i, None) for i in (20, 21)] + [(None, f"x{PASSAGE}"), (None, f"y{PASSAGE}"), (3, texts[3][1])]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    expected = sorted(((i, *found) for (i, _), found in zip(texts, brute.repeats([t for _, t in texts]), strict=True)), key=key)
    assert collected(substring.repeat_digests(frame), "doc_id", "n_words", "n_removed", "kept_sha256") == expected


def test_null_ids_are_told_apart(spark):
    """Many rows without an id: each is judged by its own words, whatever 32-bit hashes they share."""
    frame = spark.range(150_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    long = spark.createDataFrame([(None, f"{PASSAGE} {k}") for k in range(2)] + [(None, " ".join(VOCABULARY[:60]))], "doc_id long, text string")
    out = substring.repeat_digests(frame.unionByName(long))
    assert collected(out.where("n_removed > 0"), "n_words", "n_removed") == [(61, 60), (61, 60)] and out.count() == 150_003
    from ebbflow.llm.shared import row_key

    # two texts whose 32-bit hashes are equal
    rows = frame.select("text", F.hash("text").alias("h"), *row_key(F.col("doc_id"), F.col("text")))
    assert rows.agg(F.count_distinct("h")).first()[0] < 150_000 and rows.select("k1", "k2").distinct().count() == 150_000


def test_token_counts(docs, clashing, none):
    encoder = Tokenizer.from_file(JSON)
    lengths = [len(encoder.encode(t or "", add_special_tokens=False).ids) for _, t in TEXTS]
    for frame in (docs, clashing):
        histogram = token_counts.length_histogram(frame.withColumn("lang", F.lit("x")), JSON)
        assert {r["n_tokens"]: r["n_docs"] for r in histogram.collect()} == {n: lengths.count(n) for n in lengths}
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs.withColumn("lang", F.lit("x")), JSON))
    totals = {r["context"]: r["total"] for r in token_counts.truncated_totals(sums, [1, 64, 10**6]).collect()}
    assert totals == {c: sum(min(n, c) for n in lengths) for c in (1, 64, 10**6)}
    median = token_counts.quantiles(sums, [0.5]).first()["n_tokens"]
    assert median == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.suffix_sums(token_counts.length_histogram(none, JSON)).count() == 0
    assert token_counts.length_histogram(docs, JSON).where("group is null").count() > 0


def test_quality_classifier(spark, docs, clashing, none):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 12)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    for frame in (docs, clashing):
        out = quality_classifier.score(frame, model).collect()
        assert len(out) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in out)
    assert quality_classifier.score(none, model).count() == 0
    untrained = quality_classifier.fit(docs, labels.limit(0))
    assert not untrained.trained and quality_classifier.keep_good(clashing, untrained).count() == len(TEXTS)
    assert quality_classifier.keep_good(clashing, model).columns == clashing.columns


def test_trees_learn_a_rule():
    import numpy as np

    draw = np.random.default_rng(1)
    x = draw.random((2000, len(quality_classifier.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality_classifier.train(x, y)
    fresh = draw.random((500, x.shape[1]))
    assert (((model.score(fresh) > 0.5) == ((fresh[:, 3] > 0.5) ^ (fresh[:, 7] > 0.5))).mean()) > 0.95
    # the flat walk says what a walk node by node says
    for row, margin in zip(fresh[:20], model.margin(fresh[:20]), strict=True):
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
            total += model.leaf[t, node - model.feature.shape[1]]
        assert abs(total - margin) < 1e-9


def test_chat(spark):
    template = chat.Template()
    hostile = ["", "\\", "### user: ", " </turn>\n", "\\### Assistant: </turn> ok", "#" * 9, "<<>>\\\\", LONG[:5000], "é🙂\n"]
    for text in hostile:
        whole = "".join(t for t, _ in template.render("user", text)) + "".join(t for t, _ in template.render("assistant", text))
        assert list(template.parse(whole)) == [("user", text), ("assistant", text)]
    with pytest.raises(ValueError):
        list(template.parse("nonsense"))
    rows = [(1, 2, "assistant", "x"), (1, 1, "user", None), (1, 2, "assistant", "x"), (2, None, None, None), (None, 1, "user", "a"), (None, 2, "assistant", "b"), (3, 1, "assistant", "early"), (3, 2, "user", "late")]
    rows += [(4, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(1, 3001)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash")).repartition(3)
    out = {r["conv_id"]: r for r in chat.formatted_digests(chat.format_conversations(frame, template), template).collect()}
    turns = {1: [("user", ""), ("assistant", "x"), ("assistant", "x")], 2: [("", "")], None: [("user", "a"), ("assistant", "b")], 3: [("assistant", "early"), ("user", "late")]}
    turns[4] = [("user" if k % 2 else "assistant", f"turn {k}") for k in range(1, 3001)]
    for conv, said in turns.items():
        r = out.pop(conv)
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == brute.chat_digest(said)
        assert r["valid"] == (conv in (None, 4))
    assert not out
    assert chat.format_conversations(frame.limit(0), template).count() == 0


def test_packing(docs, clashing, none):
    encoder = Tokenizer.from_file(JSON)
    expected = sorted(((i, len(encoder.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in TEXTS), key=key)
    for frame in (docs, clashing):
        pieces = packing.pack(frame, JSON, 1)
        rows = pieces.collect()
        assert all(len(r["ids"]) == r["length"] == 1 << r["bucket"] and r["length"] <= 2048 for r in rows)
        assert sorted(((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0), key=key) == expected
        assert sum(r["length"] for r in rows) == sum(n for _, n in expected)
    assert packing.pack(none, JSON, 1).count() == 0
    assert packing.decompose(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    with pytest.raises(ValueError):
        packing.decompose(5, 1000)


def test_buckets_hold_one_length_each(spark, docs, tmp_path):
    pieces = packing.pack(docs, JSON, 1)
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.where(F.size("ids") != F.expr("shiftleft(1, bucket)")).count() == 0
    assert collected(back, "doc_id", "start", "ids") == collected(pieces, "doc_id", "start", "ids")


def test_token_files_follow_the_size_and_lookups_skip_stripes(spark, tmp_path, monkeypatch):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(token_output, "FILE_BYTES", 1 << 14)
    path = str(tmp_path / "tokens")
    token_output.write_token_files(docs, path, WORDS, end_id=2, drops_space=True)
    files = list((tmp_path / "tokens").glob("*.orc"))
    assert len(files) == token_output.file_count(docs.select("doc_id", "text")) > 4
    found = token_output.lookup(spark, path, [777])
    assert found.count() == 1
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,777)], ReadSchema" in scan
    import pyarrow.orc as orc

    # ranges of ids don't overlap, so a stripe's own least and greatest id rule it out
    spans = sorted((min(ids), max(ids)) for ids in (orc.ORCFile(str(f)).read(columns=["doc_id"]).column(0).to_pylist() for f in files) if ids)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert any(b"doc_id" in f.read_bytes() for f in files)


def test_nearest_neighbours(spark):
    import numpy as np

    draw = np.random.default_rng(2)
    vectors = draw.standard_normal((400, 8))
    rows = [(int(i), [float(v) for v in vec], "clash") for i, vec in enumerate(vectors)]
    rows += [(400, rows[0][1], "copy"), (401, rows[0][1], "copy"), (403, None, ""), (404, [0.0] * 8, ""), (405, [1.0] * 7 + [None], ""), (406, [float("nan")] * 8, ""), (407, [float("inf")] + [0.0] * 7, ""), (408, [1.0, 2.0], ""), (None, [1.0] * 8, ""), (450, None, "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(4)
    found: dict = {}
    for r in ann.nearest(frame).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([*range(400), 400, 401])
    expected = brute.nearest(ids, np.concatenate((vectors, vectors[:1], vectors[:1])))
    assert sorted(found) == sorted(expected)
    assert [v for _, v, _ in found[0]][:2] == [400, 401]
    hits = sum(len({v for _, v, _ in found[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 5 * len(expected)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(few.limit(0)).count() == 0
    assert ann.nearest(few.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("plan_blocks", [2, 32])
def test_nearest_neighbours_in_several_blocks(spark, monkeypatch, plan_blocks):
    """Several blocks of queries and of rows, with vectors from 1e-300 to 1e300."""
    import numpy as np

    monkeypatch.setattr(ann, "PLAN_BLOCKS", plan_blocks)
    monkeypatch.setattr(ann, "ROW_BLOCK", 500)
    draw = np.random.default_rng(8)
    vectors = draw.standard_normal((4000, 16))
    power = np.full(4000, 0)
    power[::7], power[3::7], power[5::70] = -990, 660, 1010
    sizes = np.ldexp(vectors, power[:, None])
    frame = spark.createDataFrame([(i, [float(v) for v in vec]) for i, vec in enumerate(sizes)], "vec_id long, embedding array<double>").coalesce(1)
    model, index = ann.build_index(frame)
    out = ann.search(model, index, frame.where("vec_id % 20 = 0"), rerank=40, block=60)
    found: dict = {}
    for r in out.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    expected = brute.nearest(np.arange(4000), vectors, every=20)
    assert sorted(found) == sorted(expected) and all(len(v) == 5 for v in found.values())
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 5 * len(expected)
    exact = {(q, v): s for q in expected for v, s in expected[q]}
    assert all(abs(exact[q, v] - s) < 1e-12 for q, near in found.items() for v, s in near if (q, v) in exact)


def test_cosines_of_very_large_and_small_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e-200, 2e-200]), (2, [1e200, 2e200]), (3, [5e-324, 0.0]), (4, [1.7e308, 1.7e308]), (5, [-1e-310, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["score"] for r in ann.nearest(frame).collect()}
    expected = {1: 1.0, 2: 1.0, 3: 5**-0.5, 4: 3 / 10**0.5, 5: -(5**-0.5)}
    assert found.keys() == expected.keys() and all(abs(found[v] - s) < 1e-12 for v, s in expected.items())


def test_nearest_neighbours_of_many_copies(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    vectors = draw.standard_normal((3000, 8))
    ids = draw.permutation(3000)
    vectors[ids % 3 == 0] = vectors[0]
    rows = [(int(i), [float(v) for v in vec]) for i, vec in zip(ids, vectors, strict=True)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    found: dict = {}
    for r in ann.nearest(frame).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    copies = [i for i in range(0, 30, 3)]
    asked = [q for q in range(0, 3000, 50) if q % 3 == 0]
    assert {q: found[q] for q in asked} == {q: [i for i in copies if i != q][:5] for q in asked}


def test_pipeline_stages_on_odd_rows(spark, docs, none, tmp_path):
    for k, frame in enumerate((docs, none)):
        rows = frame
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, rows, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{k}-{name}")
            rows = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        assert {"doc_id", "ids"} <= set(rows.columns)
