"""The queries op1 to op9 against brute force in plain Python, over whole tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from quillrake.llm.queries import QUERIES
from quillrake.llm.tokens import public_path


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    t = Tokenizer.from_file(public_path())
    return {d: t.encode(x, add_special_tokens=False).ids for d, x in docs.items()}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def least(links, nodes):
    """node: smallest node it reaches."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def rows(spark, sf, name):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def test_packing(spark, sf, ids):
    got, seqs = defaultdict(list), defaultdict(list)
    for r in rows(spark, sf, "op1_packing"):
        got[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(got) == set(ids)
    for d, parts in got.items():
        want, at = [*ids[d], 1], 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(want))
            at += r["length"]
            assert r["ids_crc32"] == crc(want[r["start"] : at])
        assert at == len(want)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        assert {r["sequence_length"] for r in parts} == {at if at & (at - 1) == 0 else 2048}
    assert sum(len(x) + 1 for x in ids.values()) > 0.97 * 2048 * len(seqs)


def test_token_files(spark, sf, ids):
    got, at = {r["doc_id"]: r for r in rows(spark, sf, "op4_token_files")}, 0
    assert set(got) == set(ids)
    for d in sorted(ids):
        want = [*ids[d], 0]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(want), crc(want))
        at += len(want)


def code(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(spark, sf, docs):
    codes = {d: code(x) for d, x in docs.items()}
    links = [(a, b) for a in docs for b in docs if a < b and bin(codes[a] ^ codes[b]).count("1") <= 2]
    want = least(links, docs)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, sf, "op3_simhash")}
    assert got == {d: (f"{codes[d]:016x}", want[d]) for d in docs}
    assert len(links) > 5


def test_warc(spark, sf):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    last = {}
    for p, x in pages.items():
        last[x] = max(p, last.get(x, p))
    want = {p: (len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if last[x] == p else "revisit", None if last[x] == p else last[x]) for p, x in pages.items()}
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(spark, sf, "op5_warc")}
    assert got == want


def test_chat(spark, sf):
    said = "</s>[INST] ok [/INST]"
    convs = defaultdict(list, {-1: [(0, "user", said), (1, "assistant", said)]})
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        convs[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in rows(spark, sf, "op6_chat")}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] > sum(len(t) for *_, t in turns)


def test_exact(spark, sf, docs):
    same = defaultdict(list)
    for d, x in docs.items():
        same[x].append(d)
    want = {d: (max(same[x]), len(same[x]), d == max(same[x]), hashlib.sha256(x.encode()).hexdigest()) for d, x in docs.items()}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(spark, sf, "op9_exact_dedup")} == want


def test_mixing(spark, sf):
    """Against exact fractions of the target weights: each source within one block of its share at every slot, while it lasts."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows(spark, sf, "op10_mixing")
    source = {r["doc_id"]: r["source"] for r in table.select("doc_id", "source").collect()}
    assert Counter(r["doc_id"] for r in got) == Counter(list(source)) and all(source[r["doc_id"]] == r["source"] for r in got)
    sizes = Counter(source.values())
    weights = {s: Fraction(float(n) ** 0.5) for s, n in sizes.items()}
    total, blocks = sum(weights.values()), {}
    for r in got:
        share = weights[r["source"]] / total
        assert r["release"] == r["block"] // share <= r["slot"] < r["deadline"] == -(-(r["block"] + 1) // share)
        blocks.setdefault((r["source"], r["block"]), set()).add((r["slot"], r["turn"]))
    assert all(len(s) == 1 for s in blocks.values()) and Counter(s for s, _ in blocks) == {s: -(-n // 16) for s, n in sizes.items()}
    at = {s.pop(): k for k, s in blocks.items()}
    assert [turn for _, turn in sorted(at)] == list(range(len(blocks)))
    for source in sizes:
        mine = sorted(slot for (slot, _), (s, _) in at.items() if s == source)
        for j, slot in enumerate(mine):
            assert abs(slot * weights[source] / total - j) < 1 and abs((slot + 1) * weights[source] / total - (j + 1)) < 1


def test_lattice(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = [r["vec_id"] for r in table]
    x = np.array([r["embedding"] for r in table], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    links = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    want = least(links, ids)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(spark, sf, "op2_lattice")}
    exact = {v: (int(near[i].sum()) - 1, want[v], want[v] == v) for i, v in enumerate(ids)}
    assert set(got) == set(ids)
    assert all(got[v][0] <= exact[v][0] for v in ids)
    assert sum(g[0] for g in got.values()) >= 0.95 * sum(e[0] for e in exact.values())
    assert sum(got[v] == exact[v] for v in ids) >= 0.95 * len(ids)


def test_substring(spark, sf, docs):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", x) for d, x in docs.items()}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(spark, sf, "op7_substring")}
    assert got == want
    assert any(0 < w[1] < w[0] for w in want.values())


def test_language(spark, sf):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows(spark, sf, "op8_language")
    assert {r["doc_id"] for r in got} == set(langs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)
