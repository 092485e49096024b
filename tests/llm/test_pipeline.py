"""The pipeline's stages against brute force, each on its own input."""

from collections import defaultdict

import corpus_pipeline
import pytest
from quillrake.llm.language_id import ngram_counts
from test_contract import least


@pytest.fixture(scope="module")
def outputs(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, sf).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def as_rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_columns_and_rows_are_kept_as_they_were(outputs):
    want = as_rows(outputs["input"])
    for name in ("language", "exact", "near", "mixture"):
        assert outputs[name].columns == outputs["input"].columns
        got = as_rows(outputs[name])
        assert all(want[d] == r for d, r in got.items())
        assert outputs[name].count() == len(got)


def test_language_rejects_no_clean_document(outputs):
    kept, before = as_rows(outputs["language"]), as_rows(outputs["input"])
    for d, r in before.items():
        if d not in kept:
            assert not len(ngram_counts(r["text"])[0])


def test_exact_keeps_the_smallest_of_equal_texts(outputs):
    same = defaultdict(list)
    for d, r in as_rows(outputs["language"]).items():
        same[r["text"]].append(d)
    assert set(as_rows(outputs["exact"])) == {min(x) for x in same.values()}


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_is_brute_force(outputs):
    docs = {d: shingles(r["text"]) for d, r in as_rows(outputs["exact"]).items()}
    links = [(a, b) for a in docs for b in docs if a < b and docs[a] & docs[b] and len(docs[a] & docs[b]) >= 0.8 * len(docs[a] | docs[b])]
    first = least(links, docs)
    assert set(as_rows(outputs["near"])) == {d for d in docs if first[d] == d} != set(docs)


def test_near_finds_pairs_at_the_threshold_and_links_none_below(spark):
    """Scattered changes and appended passages, at similarities from 0.7 to 0.95."""
    import random

    from quillrake.llm.simhash_dedup import simhash_dedup

    r = random.Random(3)
    rows, want = [], {}
    for i in range(700):
        words = [f"w{i}x{k}" for k in range(r.randrange(60, 400))]
        copy = list(words)
        if i % 2:
            for k in r.sample(range(len(copy)), max(1, round(len(copy) * r.uniform(0.005, 0.04)))):
                copy[k] = f"o{i}x{k}"
        else:
            copy += [f"t{i}x{k}" for k in range(round(len(words) * r.uniform(0.05, 0.4)))]
        rows += [(i, " ".join(words)), (1000 + i, " ".join(copy))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        want[i] = len(a & b) / len(a | b)
    kept = {x["doc_id"] for x in simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {*range(700)} <= kept and all(1000 + i in kept for i, j in want.items() if j < 0.8)
    close = [i for i, j in want.items() if 0.8 <= j < 0.85]
    assert len(close) > 50 and sum(1000 + i not in kept for i in close) >= 0.98 * len(close)
    assert all(1000 + i not in kept for i, j in want.items() if j >= 0.88)


def odd_documents(spark):
    from pyspark.sql import functions as F

    passage = " ".join(f"word{i}" for i in range(300))
    rows = [(1, passage, "en", "a", 5), (1, passage, "en", "a", 5), (2, passage, "en", None, 5), (3, None, "en", "", 5), (4, "", None, "a", 0), (None, "some text", "fr", "a", 9), (5, passage + " end", "de", "b", 7), (6, "x y z " * 50_000, "en", "a", 9), (7, "0 1", "en", "c", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("node", "__at", "shard", "sketch", "c0")})


@pytest.mark.parametrize("name, kept", [("language", {1, 2, None, 5, 6}), ("exact", {1, 3, None, 5, 6, 7}), ("near", {1, 3, None, 6, 7}), ("mixture", {1, 2, 3, 4, None, 5, 6, 7}), ("packed", {1, 2, 3, 4, None, 5, 6, 7})])
def test_stages_take_nulls_repeats_and_empty_tables(spark, sf, name, kept):
    docs = odd_documents(spark)
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf)
    if name != "packed":
        assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == kept
    assert stage(spark, docs.where("false"), sf).count() == 0


def test_mixture_drops_nothing_and_packing_covers_it(outputs):
    assert set(as_rows(outputs["mixture"])) == set(as_rows(outputs["near"]))
    assert {r["doc_id"] for r in outputs["packed"].select("doc_id").collect()} == set(as_rows(outputs["near"]))
    lengths = outputs["packed"].groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in lengths) <= 2048


def test_run_is_the_stages_in_order(spark, sf, outputs):
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf).drop("sequence_id").collect()))
    assert len(got) == outputs["packed"].count()


def test_packed_sequences_follow_the_target_weights(spark, monkeypatch):
    from quillrake.llm import mixing, packing

    monkeypatch.setattr(packing, "SHARD_PIECES", 64)
    rows = [(i, f"document {i} of this table " * (1 + i % 7), "abc"[i % 3]) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {r[0]: r[2] for r in rows}
    for weights in ({"a": 6, "b": 3, "c": 1}, {"a": 1, "b": 3, "c": 6}):
        packed = packing.pack_documents(docs, order=mixing.mixed_places(docs, weights)).collect()
        shards = defaultdict(list)
        for r in packed:
            shards[r["sequence_id"] >> packing.WINDOW_BITS].append(source[r["doc_id"]])
        seen, total = dict.fromkeys("abc", 0), 0
        for k in sorted(shards)[:9]:  # the first source runs out after some 670 documents
            total += len(shards[k])
            for s in shards[k]:
                seen[s] += 1
            assert all(abs(n - weights[s] * total / 10) < 16 for s, n in seen.items())
        assert total > 500


def test_run_packs_along_the_mixture(spark, sf, outputs, monkeypatch):
    from quillrake.llm import mixing, packing

    monkeypatch.setattr(packing, "SHARD_PIECES", 32)
    slots = {r["__id"]: r["__at"] for r in mixing.mixed_places(outputs["near"]).collect()}
    met = defaultdict(set)
    for r in corpus_pipeline.run(spark, sf).collect():
        met[r["sequence_id"] >> packing.WINDOW_BITS].add(slots[r["doc_id"]])
    assert len(met) > 2
    ordered = [met[k] for k in sorted(met)]
    assert all(max(a) < min(b) for a, b in zip(ordered, ordered[1:]))
