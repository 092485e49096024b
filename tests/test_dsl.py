import pytest

from quillrake.operators import dsl, quantize


@pytest.mark.parametrize(
    "text, want",
    [
        ("a:x", {"match": {"a": "x"}}),
        ('"two words"', {"match_phrase": {"f": "two words"}}),
        ("a:x AND b:y", {"bool": {"must": [{"match": {"a": "x"}}, {"match": {"b": "y"}}]}}),
        ("x y", {"bool": {"should": [{"match": {"f": "x"}}, {"match": {"f": "y"}}]}}),
        ("+x y -z", {"bool": {"must": [{"match": {"f": "x"}}], "must_not": [{"match": {"f": "z"}}]}}),
        ("NOT x", {"bool": {"must_not": [{"match": {"f": "x"}}]}}),
        ("n:>=5", {"range": {"n": {"gte": 5}}}),
        ("n:[1 TO *]", {"range": {"n": {"gte": 1}}}),
        ("n:{1 TO 2.5}", {"range": {"n": {"gt": 1, "lt": 2.5}}}),
        ("te*t", {"wildcard": {"f": "te*t"}}),
        ("rome~1", {"fuzzy": {"f": {"value": "rome", "fuzziness": 1}}}),
        ("_exists_:n", {"exists": {"field": "n"}}),
        ("a:*", {"exists": {"field": "a"}}),
    ],
)
def test_query_strings(text, want):
    assert dsl.parse_query_string(text, ["f"]) == want


def test_bad_queries():
    for bad in ({"nonsense": {}}, {"term": {"a": 1, "b": 2}}, {"range": {"a": {"above": 1}}}, {"term": {"a; DROP": 1}}, {"ids": {"values": [1]}}, {"bool": {"perhaps": []}}):
        with pytest.raises(dsl.DslError):
            dsl.to_filter(bad)
    with pytest.raises(dsl.DslError):
        dsl.parse_query_string("a) b", ["f"])
    with pytest.raises(dsl.DslError):
        dsl.aggregate(None, {"a": {"nonsense": {"field": "x"}}})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "Red fox", 1.0, [1.0, 0.0]), (2, "red dog barks", 2.0, [0.0, 1.0]), (3, None, None, None), (4, "a 100% fox", 9.0, [0.9, 0.1])], "id int, t string, x double, v array<float>")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_nulls_and_wildcards_in_text(docs):
    assert sorted(ids(docs.where(dsl.to_filter({"bool": {"must_not": {"match": {"t": "fox"}}}})))) == [2, 3]
    assert ids(docs.where(dsl.to_filter({"match": {"t": "100%"}}))) == [4]
    assert ids(docs.where(dsl.to_filter({"wildcard": {"t": "*0%*"}}))) == [4]
    assert ids(docs.where(dsl.to_filter({"term": {"t": None}}))) == [3]
    assert ids(docs.where(dsl.to_filter({"terms": {"id": []}}))) == []


def test_search(docs):
    assert ids(dsl.search(docs, {"query": {"match": {"t": "red fox"}}}, "id")) == [1, 2, 4] or ids(dsl.search(docs, {"query": {"match": {"t": "red fox"}}}, "id"))[0] == 1
    assert ids(dsl.search(docs, {"query": {"match_phrase": {"t": "red dog"}}}, "id")) == [2]
    assert ids(dsl.search(docs, {"query": {"multi_match": {"query": "dog", "fields": ["t^2"]}}}, "id")) == [2]
    assert ids(dsl.search(docs, {"knn": {"field": "v", "query_vector": [1, 0], "k": 2, "filter": {"range": {"id": {"gt": 1}}}}}, "id")) == [4, 2]
    assert ids(dsl.search(docs, {"sort": [{"x": "desc"}]}, "id")) == [4, 2, 1, 3]
    assert ids(dsl.search(docs, {"size": 2, "search_after": 1}, "id")) == [2, 3]


def test_nested_aggregations(docs):
    out = dsl.aggregate(docs, {"h": {"histogram": {"field": "x", "interval": 5}, "aggs": {"m": {"max": {"field": "x"}}, "by": {"terms": {"field": "t"}}}}, "n": {"value_count": {"field": "x"}}})
    assert sorted(tuple(r) for r in out["h"].collect()) == [(0.0, 2, 2.0), (5.0, 1, 9.0)]
    assert out["h.by"].count() == 3 and out["metrics"].first()["n"] == 3


def test_codes_only_choose_candidates(spark):
    import random

    r = random.Random(2)
    df = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(400)] + [(1000, None)], "id int, v array<float>")
    q = [r.gauss(0, 1) for _ in range(16)]
    from quillrake.operators.retrieval import knn

    exact = ids(knn(df, "v", q, 10, "id"))
    pq = quantize.ProductQuantizer.fit(df, "v", parts=4, codes=32)
    got = ids(quantize.refined(pq.encode(df, "v"), pq.distance("pq_code", q), "v", q, 10, "id", refine=6))
    assert len(set(got) & set(exact)) >= 8
    assert len(set(ids(quantize.binary_search(df, "v", q, 10, "id", "l2", refine=12))) & set(exact)) >= 7
    sq = quantize.ScalarQuantizer.fit(df, "v")
    row = df.where("id = 3").select("v", sq.decode(sq.encode("v")).alias("w")).first()
    assert max(abs(a - b) for a, b in zip(row["v"], row["w"])) < 0.02


def test_pages_follow_an_order_with_ties_and_nulls(spark):
    rows = [(i, (None, 3.0, 1.0, 3.0)[i % 4], "ab"[i % 2]) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, x double, s string")
    for sort in ([{"x": "desc"}], [{"x": "asc"}, {"s": "desc"}], ["s", {"x": {"order": "desc"}}], [{"_id": "desc"}]):
        whole = ids(dsl.search(df, {"sort": sort, "size": 50}, "id"))
        for by in (lambda r: r["id"], lambda r: [r[next(iter(s)) if isinstance(s, dict) else s] if (next(iter(s)) if isinstance(s, dict) else s) != "_id" else r["id"] for s in sort] + ([] if sort == [{"_id": "desc"}] else [r["id"]])):
            got, last = [], None
            while True:
                page = dsl.search(df, {"sort": sort, "size": 5} | ({"search_after": by(last)} if last else {}), "id").collect()
                if not page:
                    break
                got += [r["id"] for r in page]
                last = page[-1]
            assert got == whole and len(whole) == 12


def test_full_text_scores_inside_bool(spark):
    df = spark.createDataFrame([(1, "red fox", "x"), (2, "red wine", "y"), (3, "green fox", "x"), (4, "blue", "x")], "id long, text string, kind string")
    top = {r["id"]: r["_score"] for r in dsl.search(df, {"query": {"match": {"text": "red fox"}}}, "id").collect()}
    must = {r["id"]: r["_score"] for r in dsl.search(df, {"query": {"bool": {"must": [{"match": {"text": "red fox"}}, {"term": {"kind": "x"}}]}}}, "id").collect()}
    assert must == {i: top[i] for i in (1, 3)}
    should = {r["id"]: r["_score"] for r in dsl.search(df, {"query": {"bool": {"should": [{"match": {"text": "red"}}, {"term": {"kind": "x"}}]}}}, "id").collect()}
    assert set(should) == {1, 2, 3, 4} and should[4] == 1.0 and should[1] > 1.0
    both = dsl.search(df, {"query": {"bool": {"should": [{"match": {"text": "red"}}, {"term": {"kind": "x"}}], "minimum_should_match": 2}}}, "id")
    assert ids(both) == [1]
    filtered = dsl.search(df, {"query": {"bool": {"must": [{"match": {"text": "fox"}}], "must_not": [{"term": {"id": 3}}], "filter": [{"term": {"kind": "x"}}]}}}, "id")
    assert ids(filtered) == [1]
