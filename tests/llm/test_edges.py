"""Every training-data operator on nulls, empty and very long texts, ties, repeated rows, empty tables and odd columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillrake.llm import chat, exact_dedup, fingerprint_log, language_id, lattice_dedup, mixing, packing, shared, simhash_dedup, substring_dedup, token_files, vantage, warc
from quillrake.llm.simple8b import decode_block, encode_block
from quillrake.llm.tokens import encoder, public_path

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
SAME = "one two three four five six seven eight nine ten"
ROWS = [(1, SAME, "en", "a"), (2, SAME, "en", "a"), (3, None, None, None), (4, "", "fr", "b"), (5, LONG, "en", "a"), (5, LONG, "en", "a"), (6, " \n\t ", "de", "c"), (None, "no id", "en", "a"), (7, "퟿\U0001f600 ünï", "fr", "b"), (8, "12 34", None, "b")]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = {"id": "x", "code": 1, "node": 2, "n": 3, "h": 4, "sha": "y", "keep_id": 5, "shard": 6, "slot": 7, "key": 8, "a": 9, "b": 10, "gone": 11, "starts": 12, "block": 13}


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    for name, v in CLASHING.items():
        df = df.withColumn(name, F.lit(v))
    return df.cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def ids_of(text):
    return Tokenizer.from_file(public_path()).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_packing(docs, none):
    got = packing.pack_documents(docs).collect()
    assert packing.pack_documents(none).count() == 0
    want = Counter((r[0], len(ids_of(r[1])) + 1) for r in ROWS)
    firsts = Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0)
    assert firsts == want
    whole = [*ids_of(LONG), 1]
    for r in got:
        if r["doc_id"] == 5:
            assert r["ids_crc32"] == crc(whole[r["start"] : r["start"] + r["length"]])
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_best_fit_is_the_tightest_window():
    r = np.random.default_rng(4)
    lengths = r.integers(1, 101, 300).tolist()
    placed = packing.best_fit_decreasing(lengths, 100)
    rooms, want = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [room for room in rooms if room >= lengths[k]]
        if fits:
            rooms[rooms.index(min(fits))] -= lengths[k]
        else:
            rooms.append(100 - lengths[k])
        want[k] = None
    used = Counter()
    for (w, _), n in zip(placed, lengths, strict=True):
        used[w] += n
    assert len(used) == len(rooms) and sorted(100 - u for u in used.values()) == sorted(rooms)


def test_lattice(spark):
    nan, inf = float("nan"), float("inf")
    v = [float(i % 5 - 2) for i in range(64)]
    rows = [(1, v), (2, v), (3, None), (4, [0.0] * 64), (5, [nan] + v[1:]), (6, [None] + v[1:]), (7, [inf] + v[1:]), (8, [2 * x for x in v]), (9, v[:32]), (10, []), (None, v), (11, [-x for x in v]), (2, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS rep", "1 AS cell")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in lattice_dedup.embedding_links(df).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 9, 10, 11)]
    assert got == Counter([*alone, (1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (8, 4, 1, False), (None, 4, None, False)])
    assert lattice_dedup.embedding_links(df.where("false")).count() == 0


def test_lattice_decoder_finds_the_nearest_point():
    r = np.random.default_rng(1)
    x = r.normal(0, 2, (200, 8))
    near, other, cost = lattice_dedup.decode_e8(x)
    for p in (near, other):
        assert ((2 * p) % 1 == 0).all() and (p.sum(1) % 2 == 0).all()
    roots = [np.array(v) for v in ([1, 1, 0, 0, 0, 0, 0, 0], [0.5] * 8, [0.5] * 6 + [-0.5] * 2, [1, 0, 0, -1, 0, 0, 0, 0])]
    d = ((x - near) ** 2).sum(1)
    assert all((((x - near - s * v) ** 2).sum(1) >= d - 1e-9).all() for v in roots for s in (1, -1)) and (cost >= 0).all()


def test_one_dense_cell_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lattice_dedup, "BLOCK", 8)
    r = np.random.default_rng(3)
    base = r.normal(size=64)
    rows = [(i, (base + 0.02 * r.normal(size=64)).tolist()) for i in range(40)]
    got = lattice_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(39, 0)}


def test_simhash(spark, docs, none):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_dedup.simhash_components(docs).collect()]
    assert len(got) == len(ROWS)
    by = {d: (f, c) for d, f, c in got}
    assert by[1][0] == by[2][0] and by[2][1] == 1
    assert {by[i] for i in (3, 4, 6)} == {("0" * 16, 3)}
    assert by[None][1] is None and by[None][0] != "0" * 16
    assert simhash_dedup.simhash_components(none).count() == 0


def linked(spark, codes, **settings):
    """Components by the trees and by brute force."""
    radius, rows = settings.get("radius", 2), list(enumerate(codes))
    links = vantage.code_links(spark.createDataFrame([(i, vantage.signed(c)) for i, c in rows], "node long, code long"), **settings)
    roots = {x["node"]: x["root"] for x in shared.components(links, "a", "b").collect()}
    forest, c = shared.Forest(), np.array(codes, np.uint64)
    for i, _ in rows:
        for j in np.flatnonzero(np.bitwise_count(c ^ c[i]) <= radius).tolist():
            forest.join(i, j)
    return {i: roots.get(i, i) for i, _ in rows}, {i: forest.find(i) for i, _ in rows}


@pytest.mark.parametrize("dense", [8, 10**9])
def test_dense_codes_link_as_by_brute_force(spark, dense):
    r = np.random.default_rng(5)
    codes = sorted({int(sum(1 << int(b) for b in r.choice(20, r.integers(0, 4), replace=False))) for _ in range(150)})
    for radius in (1, 2, 3):
        got, want = linked(spark, codes, radius=radius, leaf=8, dense=dense)
        assert got == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_trees_find_links_across_their_boundaries(spark, radius):
    r = np.random.default_rng(8)
    base = [int(x) for x in r.integers(0, 2**63, 400)]
    codes = sorted({b ^ int(sum(1 << int(k) for k in r.choice(64, r.integers(0, radius + 3), replace=False))) for b in base for _ in range(3)})
    got, want = linked(spark, codes, radius=radius, leaf=24)
    assert got == want and (not radius or any(k != v for k, v in want.items()))
    code = np.array(codes, np.uint64)
    for mask in vantage._HALVES:
        tree = vantage.VantageTree.grown(code, mask, radius // 2, 24)
        row, leaf, home = tree.search(code)
        assert tree.leaves > 8 and home.sum() == len(code)
        if radius == 2:  # some codes stand at a boundary and visit other leaves, and most branches are pruned
            assert len(code) < len(row) < 3 * len(code)
        assert {(x, y) for x, y in zip(row, leaf)} >= {(x, y) for x, y in zip(row[home], leaf[home])}


def test_a_tree_splits_codes_near_the_median_and_leaves_equal_distances_whole():
    r = np.random.default_rng(2)
    tree = vantage.VantageTree.grown(r.integers(0, 2**63, 5000).astype(np.uint64), vantage._HALVES[0], 1, 100)
    _, leaf, home = tree.search(r.integers(0, 2**63, 50_000).astype(np.uint64))
    assert np.bincount(leaf[home]).max() < 5000 and tree.leaves >= 50
    assert vantage.VantageTree.grown(np.array([1 << k for k in range(32)], np.uint64), vantage._HALVES[0], 1, 4).leaves == 1


def test_near_duplicates_keep_one_of_each_group(spark):
    from pyspark.sql import functions as F

    words = [f"v{i}" for i in range(400)]
    near = words[:200] + ["changed"] + words[201:]
    other = [f"u{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(other)), (4, None), (5, ""), (6, "short"), (None, " ".join(words)), (1, " ".join(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sketch", F.lit(0)).withColumn("node", F.lit(0))
    got = simhash_dedup.simhash_dedup(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got.collect()) == [(False, 1), (False, 1), (False, 3), (False, 4), (False, 6), (True, None)]
    assert simhash_dedup.simhash_dedup(df.where("false")).count() == 0


def test_token_files(spark, docs, none):
    listed = token_files.write_token_files(docs, shared.new_path(spark, "t"))
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, listed).collect()))
    at = 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert len(got) == len(order)
    for (start, d, n, c), r in zip(got, order, strict=True):
        want = [*ids_of(r[1]), 0]
        assert (start, d, n, c) == (at, r[0], len(want), crc(want))
        at += n
    listed = token_files.write_token_files(none, shared.new_path(spark, "t"))
    assert token_files.read_token_files(spark, listed).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_simple8b_round_trip(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(0, 3000))
    kinds = [r.integers(0, 2, n), r.integers(0, 50257, n), r.integers(0, 2**32, n), np.where(r.random(n) < 0.02, r.integers(0, 2**32, n), r.integers(0, 300, n)), np.full(n, 2**32 - 1), (2 ** r.integers(0, 33, n).astype(object) - 1).astype(np.uint64) % 2**32]
    for ids in kinds:
        ids = ids.astype("<u4")
        words, exceptions = encode_block(ids)
        assert (decode_block(words, exceptions, n) == ids).all()
    if n:
        words, exceptions = encode_block(kinds[0].astype("<u4"))
        assert words.nbytes + exceptions.nbytes < n


@pytest.mark.parametrize("text", ["", " ", "  ", "a  b", " a", "a ", "\n\n a\n\n\n b", "it's  don't", "<|endoftext|> x", "a b　c", "tab\tand \t mix", "é à́ 中文 字", "1234 5.6-7", "\r\n x \r\n", "a" * 3000, "😀 😀😀", "x​z    y", "'S 'll 're"])
def test_pieces_are_whole_text_ids(text):
    assert np.frombuffer(encoder(public_path()).ids(text), "<u4").tolist() == ids_of(text)


def test_warc(spark):
    rows = [(1, "http://a/b?c=1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "bad url \x01", None), (4, "http://[oops", ""), (None, "http://n", "<p>x</p>"), (None, None, None), (2, "http://again", "<p>x</p>"), (6, "http://long", "y" * 3_000_000), (5, "http://crlf", "a\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS kind", "1 AS sha", "2 AS record_id")
    listed = warc.write_warc(pages, shared.new_path(spark, "w"))
    caps = warc.assemble_captures(warc.read_warc_records(spark, listed)).collect()
    main = Counter((c["metadata"]["page_id"], c["response"]["payload_bytes"], c["response"]["kind"]) for c in caps)
    want = [(1, 8, "revisit"), (2, 8, "response"), (2, 8, "revisit"), (3, 0, "revisit"), (4, 0, "response"), (6, 3_000_000, "response"), (5, 15, "response"), (None, 8, "revisit"), (None, 0, "revisit")]
    assert main == Counter(want)
    ids = {c["record_id"]: c["metadata"]["page_id"] for c in caps}
    assert len(ids) == len(rows) and {(c["metadata"]["page_id"], ids[c["response"]["refers_to"]]) for c in caps if c["response"]["refers_to"]} == {(1, 2), (2, 2), (3, 4), (None, 2), (None, 4)}
    assert all(c["request"] is not None and c["metadata"] is not None for c in caps)
    text = next(c for c in caps if c["metadata"]["page_id"] == 5)["response"]["payload"]
    assert bytes(text) == b"a\r\n\r\nWARC/1.1\r\n"
    empty = warc.write_warc(pages.where("false"), shared.new_path(spark, "w"))
    assert warc.assemble_captures(warc.read_warc_records(spark, empty)).count() == 0


def test_warc_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, None, "ab"), (2, None, "ab"), (2, None, "ab"), (3, None, "abcd"), (4, None, "abcd")], "page_id long, url string, html string")
    got = Counter((r["page_id"], r["refers_to"]) for r in warc.revisit_targets(pages, 3).collect())
    assert got == Counter([(1, None), (2, None), (2, None), (3, 4), (4, None)])
    caps = warc.assemble_captures(warc.read_warc_records(spark, warc.write_warc(pages, shared.new_path(spark, "w"), min_bytes=3))).collect()
    assert Counter((c["metadata"]["page_id"], c["response"]["kind"]) for c in caps) == Counter([(1, "response"), (2, "response"), (2, "response"), (3, "revisit"), (4, "response")])


@pytest.mark.parametrize("same", [True, False])
def test_warc_rows_that_repeat_a_page_id_are_captures_of_their_own(spark, same):
    rows = [(7, "u", "same" if same else f"own {i}") for i in range(5)] + [(6, "v", "same"), (7, "w", "same" if same else "own 5")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    caps = warc.assemble_captures(warc.read_warc_records(spark, warc.write_warc(pages, shared.new_path(spark, "w")))).collect()
    assert Counter(c["metadata"]["page_id"] for c in caps) == Counter({7: 6, 6: 1})
    assert all(c["request"] is not None and c["response"] is not None for c in caps)
    kinds = Counter((c["metadata"]["page_id"], c["response"]["kind"]) for c in caps)
    assert kinds == (Counter({(7, "response"): 1, (7, "revisit"): 5, (6, "revisit"): 1}) if same else Counter({(7, "response"): 6, (6, "response"): 1}))


def test_chat(spark):
    odd = "</s>[INST] <|end|> \\l \\ <|turn|>user<|text|>x 😀"
    rows = [(1, 1, "assistant", odd), (1, 0, "user", odd), (2, None, None, None), (2, 0, "assistant", ""), (None, 0, "assistant", "n"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "system<|text|>", "z " * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS turns", "1 AS formatted")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert chat.parse(got[1]["formatted"]) == [("user", odd), ("assistant", odd)]
    assert chat.masked_text(got[1]["formatted"], got[1]["token_start"], got[1]["token_end"], got[1]["loss_mask"]) == odd
    assert chat.parse(got[2]["formatted"]) == [("", ""), ("assistant", "")] and not any(got[2]["loss_mask"])
    assert chat.parse(got[3]["formatted"]) == [("assistant", "same")] * 2
    assert chat.parse(got[4]["formatted"])[0][0] == "system<|text|>"
    assert chat.format_chats(df.where("false")).count() == 0


def test_substring(spark, docs, none):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"a b {passage} c"), (2, f"{passage} d"), (3, passage), (3, passage), (4, None), (5, "x " * 100), (6, f"e {passage[: len(passage) // 2]}"), (None, passage), (7, LONG), (8, " ".join(f"q{i}" for i in range(34)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fingerprint", "1 AS rep")
    seen = Counter(tuple(w[i : i + 35]) for w in (re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows) for i in range(len(w) - 34))
    want = Counter()
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in substring_dedup.substring_dedup(df).collect()) == want
    assert substring_dedup.substring_dedup(docs).count() == len(ROWS) and substring_dedup.substring_dedup(none).count() == 0


def test_fingerprint_log_knows_earlier_batches(spark):
    log = fingerprint_log.FingerprintLog(spark)
    prints = lambda xs: spark.createDataFrame([(list(set(xs)), [xs.count(x) for x in set(xs)])], "anchors array<long>, times array<byte>")
    again = [sorted(r[0] for r in log.append(prints(x)).collect()) for x in ([1, 2, 2, -9], [2, 3], [4, 5], [1, 6, -9], [6, 5, 7])]
    assert again == [[2], [2], [], [-9, 1], [5, 6]]
    opened = fingerprint_log.FingerprintLog(spark, log.folder)
    assert opened.runs == log.runs and [r["level"] for r in opened.runs] == [1, 0, 0]
    assert sorted(r[0] for r in opened.append(prints([7, 8])).collect()) == [7]
    assert [r["level"] for r in opened.runs] == [1, 1]
    with pytest.raises(RuntimeError, match="another writer"):
        log.append(prints([1]))


def removed(now, past=()):
    """What brute force keeps of ``now`` by windows that occur again in it or in ``past``."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(tuple(w[i : i + 35]) for w in (split(t) for _, t in [*past, *now]) for i in range(len(w) - 34))
    out = Counter()
    for d, t in now:
        w = split(t)
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out[d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    return out


def test_substring_by_batches_counts_history(spark):
    passage = lambda k, n=50: " ".join(f"p{k}w{i}" for i in range(n))
    first = [(1, f"a {passage(1)} b"), (2, f"{passage(2)} c {passage(2)}"), (3, passage(3)), (4, passage(3)), (None, passage(4))]
    second = [(1, f"x {passage(1)} y {passage(9)}"), (6, passage(3)), (7, f"q {passage(5)}"), (8, None), (9, passage(4, 40)), (10, passage(4, 30))]
    third = [(11, f"{passage(5)} z"), (12, passage(6))]
    log = fingerprint_log.FingerprintLog(spark)
    past = []
    for name, rows in (("a", first), ("b", second), ("c", third)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        log = fingerprint_log.FingerprintLog(spark, log.folder)
        for _ in range(2 if name == "b" else 1):  # the same batch again adds nothing
            assert Counter(tuple(r) for r in substring_dedup.substring_dedup(df, log=log, batch=name, batches=2).collect()) == removed(rows, past)
        past += rows
    assert [b["name"] for b in log.batches] == ["a", "b", "c"] and max(r["level"] for r in log.runs) > 0


def test_a_log_ignores_what_no_manifest_names(spark):
    log = fingerprint_log.FingerprintLog(spark)
    docs = lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    text = " ".join(f"w{i}" for i in range(40))
    substring_dedup.substring_dedup(docs(text), log=log, batch="a").collect()
    died = fingerprint_log.FingerprintLog(spark, log.folder)
    died._publish = lambda: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        substring_dedup.substring_dedup(docs("z " + text), log=died, batch="b").collect()
    again = fingerprint_log.FingerprintLog(spark, log.folder)
    assert [b["name"] for b in again.batches] == ["a"] and len(again.runs) == len(log.runs)
    got = substring_dedup.substring_dedup(docs("z " + text), log=again, batch="b").collect()
    assert [(r["n_words"], r["n_removed"]) for r in got] == [(41, 40)]


def test_language(spark, docs, none):
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify_languages(docs).collect()]
    assert len(got) == len(ROWS)
    by = {d: (p, s) for d, p, s in got}
    assert {by[i] for i in (3, 4, 6, 8)} == {("und", 0.0)}
    assert by[1][0] in ("en", "fr", "de") and 0 < by[1][1] <= 1
    assert language_id.identify_languages(none).count() == 0
    kept = language_id.language_filter(docs, min_score=0.0)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 5, 7, None}
    unlabelled = docs.selectExpr(*[c if c != "lang" else "cast(NULL AS string) AS lang" for c in docs.columns])
    assert {r["lang_pred"] for r in language_id.identify_languages(unlabelled).collect()} == {"und"}


def test_exact(docs, none):
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs, keep="largest").collect())
    assert got == Counter({(1, 2, 2, False): 1, (2, 2, 2, True): 1, (3, 4, 2, False): 1, (4, 4, 2, True): 1, (5, 5, 2, True): 2, (6, 6, 1, True): 1, (None, None, 1, True): 1, (7, 7, 1, True): 1, (8, 8, 1, True): 1})
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "5", "5", "6", "7", "8", "None"]
    assert exact_dedup.exact_groups(none).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(docs, keep="any")


def test_mixing(docs, none):
    got = mixing.pfair_schedule(docs, {"a": 3, "b": 2, "c": 1, None: 1}, block_docs=1, period=70).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    assert len({r["slot"] for r in got}) == len(ROWS)
    out = mixing.mixed_order(docs)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in ROWS)
    assert mixing.pfair_schedule(none).count() == 0 and mixing.mixed_order(none).count() == 0
    with pytest.raises(Exception, match="no weight for source"):
        mixing.pfair_schedule(docs, {"a": 1}).collect()


def test_null_is_a_source_of_its_own(spark):
    rows = [(i, (None, "", "a")[i % 3], 1, 2, 3) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, source string, __at long, __part int, __id int")
    got = mixing.pfair_schedule(df, {None: 2, "": 1, "a": 1}, block_docs=1).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(by) == 90 and all(by[r[0]]["source"] == r[1] for r in rows)
    assert all(sum(r["slot"] < n for r in got if r["source"] is None) == n // 2 for n in range(4, 60, 4))
    out = mixing.mixed_order(df)
    assert out.columns == df.columns and sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, rows))


def test_components_of_hubs_chains_and_loops(spark):
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in shared.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 60)} | {i: 100 for i in range(101, 141)} | {201: 200}



def test_texts_with_one_dominating_line_are_not_copies(spark):
    bars = " |" * 300
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(80)) + bars) for i in range(4)]
    assert len({simhash_dedup.simhash(t) for _, t in rows}) == 1
    got = simhash_dedup.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == {0, 1, 2, 3}


def test_near_copies_of_any_member_of_a_code_are_found(spark):
    bars = " |" * 900
    words = {i: [f"d{i}w{k}" for k in range(80)] for i in (1, 2)}
    rows = [(i, " ".join(w) + bars) for i, w in words.items()] + [(3, " ".join([*words[2][:79], "other"]) + " |" * 9)]
    codes = [simhash_dedup.simhash(t) for _, t in rows]
    assert codes[0] == codes[1] and bin(codes[1] ^ codes[2]).count("1") > 2
    got = simhash_dedup.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == {1, 2}


def test_appended_passages_and_repeated_lines_are_found(spark):
    rows, n = [], 150
    for i in range(n):
        words = [f"a{i}x{k}" for k in range(200)]
        rows += [(i, " ".join(words)), (1000 + i, " ".join(words + [f"b{i}x{k}" for k in range(27)]))]  # 196 of 223 shingles: 0.88
    line = [f"line{k}" for k in range(12)]
    base = [f"t{k}" for k in range(200)]
    rows += [(5000, " ".join(base + line * 2)), (5001, " ".join(base + line * 500))]
    kept = {r["doc_id"] for r in simhash_dedup.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {*range(n), 5000} <= kept and 5001 not in kept
    assert sum(1000 + i not in kept for i in range(n)) >= 0.97 * n


def test_large_buckets_of_bands_are_linear_and_keep_groups_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BUCKET", 8)
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(base[:5 * i] + [f"own{i}"] + base[5 * i + 1 :])) for i in range(50)] + [(100 + i, " ".join(f"u{i}v{k}" for k in range(60))) for i in range(20)]
    kept = {r["doc_id"] for r in simhash_dedup.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, *range(100, 120)}


def test_partners_in_other_blocks_of_large_buckets_are_found(spark, monkeypatch):
    """Pairs of a similarity of 0.82 among texts that share most words, 0.75 alike: only large buckets join many of them."""
    monkeypatch.setattr(simhash_dedup, "BUCKET", 8)
    common, rows, n = [f"c{k}" for k in range(160)], [], 300
    for i in range(n):
        both = common + [f"b{i}x{k}" for k in range(8)]
        rows += [(i, " ".join([f"p{i}x{k}" for k in range(18)] + both)), (1000 + i, " ".join([f"q{i}x{k}" for k in range(18)] + both))]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows[:4])]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert 0.8 <= alike(sets[0], sets[1]) < 0.85 and max(alike(a, b) for a in sets[:2] for b in sets[2:]) < 0.8
    kept = {r["doc_id"] for r in simhash_dedup.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {*range(n)}


@pytest.mark.parametrize("block, frequent", [(1024, 1 << 16), (4, 1 << 16), (4, 0)], ids=["blocks", "small", "unordered"])
def test_prefixes_miss_no_pair(spark, monkeypatch, block, frequent):
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    monkeypatch.setattr(simhash_dedup, "PART", block << 8)
    r = np.random.default_rng(5)
    sets = []
    for i in range(60):
        base = np.unique(np.concatenate([r.integers(0, 2**63, r.integers(1, 60)), np.arange(r.integers(0, 30))]).astype(np.uint64))
        sets += [base] + [np.unique(np.concatenate([base[r.random(len(base)) < 0.93], r.integers(0, 2**63, r.integers(0, 4)).astype(np.uint64)])) for _ in range(3)]
    sets.append(np.zeros(0, np.uint64))
    h, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    keys, count = np.unique(h, return_counts=True)
    ranks = 1 + np.argsort(np.argsort(count[count > 3], kind="stable"))
    common = (keys[count > 3], ranks) if frequent else (keys[:0], ranks[:0])
    size, prefix = simhash_dedup._prefixes(doc, h, len(sets), common, 0.8)
    label = [i // 2 for i in range(len(sets))]
    rows = [(i, label[i], int(size[i]), prefix[i].as_py()) for i in range(len(sets))]
    got = {(x["a"], x["b"]) for x in simhash_dedup.apart(spark.createDataFrame(rows, "node long, label long, size long, prefix array<long>"), 0.8).collect()}
    all_sets = [set(x.tolist()) for x in sets]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if all_sets[i] & all_sets[j] and len(all_sets[i] & all_sets[j]) >= 0.8 * len(all_sets[i] | all_sets[j])}
    assert len(want) > 50 and {(i, j) for i, j in want if label[i] != label[j]} <= got and all(a < b and label[a] != label[b] for a, b in got)


def test_a_worker_of_the_near_stage_holds_little_between_batches():
    """Tables of powers, and the encoder of another stage, stay no longer than they are of use; hashes do not depend on the tables."""
    import gc
    import tracemalloc

    import pyarrow as pa
    from quillrake.llm import tokens, words

    r = np.random.default_rng(2)
    texts = pa.array([" ".join(f"w{k}" for k in r.integers(0, 9999, 300)) for _ in range(1000)] + ["x" * 200_000, "", None, "a b " * 200_000])
    whole = words.Words(texts, lower=True)
    for i in (0, 7, 999, 1000, 1003):
        one = words.Words(texts.slice(i, 1), lower=True)
        assert (one.hash == whole.hash[whole.doc == i]).all() and one.whole(words.BASES[1])[0] == whole.whole(words.BASES[1])[i]
    words._powers_to.cache_clear()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), texts], ["id", "text"])
    features = simhash_dedup._features((np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0.8)
    tokens.encoder(public_path(), 1000)
    tracemalloc.start()
    try:
        assert sum(x.num_rows for x in features(iter([batch]))) == len(texts)
        gc.collect()
        assert tracemalloc.get_traced_memory()[0] < 32 << 20
    finally:
        tracemalloc.stop()
    assert tokens.encoder.cache_info().currsize == 0


def test_newlines_before_a_space_and_at_the_end_are_whole_text_ids():
    enc = encoder(public_path())
    for n in range(7):
        gap = "\n" * n
        for text in (f"a foo{gap}", f"a foo{gap} bar", f"a foo{gap}  bar", f"a foo{gap}bar", f"a foo,{gap} bar{gap}", f"{gap} a{gap}", f"a 12{gap} b\n c{gap}d{gap}"):
            assert np.frombuffer(enc.ids(text), "<u4").tolist() == ids_of(text), repr(text)


@pytest.mark.parametrize("weights", [{"a": 0.31830988, "b": 0.41421356, "c": 0.26747656}, {"a": 1e-6, "b": 1, "c": 2}, {f"s{i:04d}": 1 + i % 5 for i in range(5000)}], ids=["odd", "tiny", "many"])
def test_pfair_follows_the_weights_past_many_periods(spark, weights):
    from fractions import Fraction

    slots, blocks = 40_000, {s: 50_000 for s in weights}
    total, count = sum(map(Fraction, weights.values())), Counter()
    for t, (s, j, release, deadline, slot) in zip(range(slots), mixing.pfair_blocks(weights, blocks), strict=False):
        assert slot == t and j == count[s] and release <= slot < deadline
        count[s] += 1
        if t % 999 == 0 or t == slots - 1:
            assert all(abs(count[k] * total - Fraction(weights[k]) * (t + 1)) < total for k in weights)


def test_schedule_takes_more_sources_than_a_period_has_slots(spark):
    rows = [(i, f"s{i % 5000}") for i in range(10_000)]
    got = mixing.pfair_schedule(spark.createDataFrame(rows, "doc_id long, source string"), block_docs=1).collect()
    assert len({r["slot"] for r in got}) == len(rows) and all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    long = mixing.pfair_schedule(spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(30_000)], "doc_id long, source string"), {"a": 2, "b": 1.0003}, block_docs=1).collect()
    mine = sorted(r["slot"] for r in long if r["source"] == "b")
    assert all(-1 < (t + 1) * 1.0003 / 3.0003 - n < 2 for n, t in enumerate(mine))
