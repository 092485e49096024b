"""A declarative query DSL: filters as Columns, aggregations as DataFrames.

A query is a dict like ``{"bool": {"must": [{"term": {"f": 1}}], "must_not": [...]}}``. Every clause becomes a built-in
expression, so simple ones are pushed into the scan. Aggregations of any depth are groupings; nothing is collected.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fulltext import bm25, phrase_search
from .retrieval import knn


class DslError(ValueError):
    pass


def _one(spec: Mapping, clause: str) -> tuple[str, Any]:
    if not isinstance(spec, Mapping) or len(spec) != 1:
        raise DslError(f"{clause}: one field is expected")
    return next(iter(spec.items()))


def _col(field: str) -> Column:
    if not re.fullmatch(r"[\w.\-]+", field):
        raise DslError(f"not a field name: {field!r}")
    return F.col(".".join(f"`{p}`" for p in field.split(".")))


def _value(x: Any, *names: str) -> Any:
    if isinstance(x, Mapping):
        for n in names:
            if n in x:
                return x[n]
        raise DslError(f"one of {names} is expected")
    return x


def _any(parts: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, parts, F.lit(False)) if parts else F.lit(True)


def _all(parts: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _listed(x: Any) -> list:
    return list(x) if isinstance(x, list | tuple) else [x]


def _has(field: str, text: str) -> Column:
    return F.lower(_col(field)).contains(text.lower())


def _term(spec: Mapping) -> Column:
    field, v = _one(spec, "term")
    v = _value(v, "value")
    return _col(field).isNull() if v is None else _col(field) == F.lit(v)


def _range(spec: Mapping) -> Column:
    field, bounds = _one(spec, "range")
    ops = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
    if not bounds or set(bounds) - set(ops):
        raise DslError(f"range: bounds are {sorted(ops)}")
    return _all([ops[k](_col(field), F.lit(v)) for k, v in bounds.items()])


def _wildcard(spec: Mapping) -> Column:
    field, v = _one(spec, "wildcard")
    pattern = _value(v, "value", "wildcard")
    like = re.sub(r"([%_\\])", r"\\\1", pattern).replace("*", "%").replace("?", "_")
    return _col(field).like(like)


def _regexp(spec: Mapping) -> Column:
    field, v = _one(spec, "regexp")
    return _col(field).rlike(f"^(?:{_value(v, 'value')})$")


def _fuzzy(spec: Mapping) -> Column:
    field, v = _one(spec, "fuzzy")
    v = v if isinstance(v, Mapping) else {"value": v}
    term, most, prefix = str(v["value"]), v.get("fuzziness", 2), int(v.get("prefix_length", 0))
    most = (0 if len(term) < 3 else 1 if len(term) < 6 else 2) if str(most).upper() == "AUTO" else int(most)
    near = F.levenshtein(_col(field), F.lit(term)) <= most
    return _col(field).startswith(term[:prefix]) & near if prefix else near


def _match(spec: Mapping) -> Column:
    def one(field: str, v: Any) -> Column:
        words = str(_value(v, "query")).split()
        joined = _all if isinstance(v, Mapping) and str(v.get("operator", "or")).lower() == "and" else _any
        return joined([_has(field, w) for w in words])

    if not spec:
        raise DslError("match: a field is expected")
    return _all([one(f, v) for f, v in spec.items()])


def _match_phrase(spec: Mapping) -> Column:
    return _all([_has(f, str(_value(v, "query", "phrase"))) for f, v in spec.items()])


def _multi_match(spec: Mapping) -> Column:
    words = str(spec["query"]).split()
    return _any([_any([_has(f.split("^")[0], w) for w in words]) for f in spec["fields"]])


def _qualified(query: Any, path: str) -> Any:
    """Field names inside a nested query get the path in front unless they have it."""
    leaves = {"term", "terms", "range", "prefix", "wildcard", "regexp", "fuzzy", "match", "match_phrase"}
    named = lambda f: f if f.startswith(path + ".") else f"{path}.{f}"
    if isinstance(query, list):
        return [_qualified(q, path) for q in query]
    out = {}
    for k, v in query.items():
        if k in leaves:
            out[k] = {named(f): x for f, x in v.items()}
        elif k == "exists":
            out[k] = {"field": named(v["field"])}
        elif k == "bool":
            out[k] = {occur: _qualified(q, path) if occur != "minimum_should_match" else q for occur, q in v.items()}
        else:
            out[k] = v
    return out


def _nested(spec: Mapping, id_col: str | None) -> Column:
    return to_filter(_qualified(spec["query"], spec["path"]) if spec.get("path") else spec["query"], id_col)


def _bool(spec: Mapping, id_col: str | None) -> Column:
    clauses = lambda k: [to_filter(q, id_col) for q in _listed(spec.get(k, []))]
    unknown = set(spec) - {"must", "filter", "should", "must_not", "minimum_should_match"}
    if unknown:
        raise DslError(f"bool: {sorted(unknown)}")
    parts = clauses("must") + clauses("filter")
    should = clauses("should")
    if should:
        least = int(spec.get("minimum_should_match", 0 if parts else 1)) if "minimum_should_match" in spec else 1
        parts.append(_any(should) if least == 1 else sum((F.coalesce(c, F.lit(False)).cast("int") for c in should), F.lit(0)) >= least)
    return _all(parts + [~F.coalesce(c, F.lit(False)) for c in clauses("must_not")])


def to_filter(query: Mapping, id_col: str | None = None) -> Column:
    """A query as a boolean Column. Several clauses in one dict must all hold."""
    if not query:
        return F.lit(True)
    out = []
    for kind, spec in query.items():
        if kind == "match_all":
            out.append(F.lit(True))
        elif kind == "terms":
            field, values = _one({k: v for k, v in spec.items() if k != "boost"}, "terms")
            out.append(_col(field).isin(*values) if values else F.lit(False))
        elif kind == "exists":
            out.append(_col(spec["field"]).isNotNull())
        elif kind == "prefix":
            field, v = _one(spec, "prefix")
            out.append(_col(field).startswith(str(_value(v, "value"))))
        elif kind == "ids":
            if id_col is None:
                raise DslError("ids: the table has no key column")
            out.append(_col(id_col).isin(*spec["values"]) if spec["values"] else F.lit(False))
        elif kind == "bool":
            out.append(_bool(spec, id_col))
        elif kind == "nested":
            out.append(_nested(spec, id_col))
        elif kind in ("query_string", "simple_query_string"):
            out.append(to_filter(parse_query_string(spec["query"], spec.get("fields") or ([spec["default_field"]] if "default_field" in spec else []), spec.get("default_operator", "or"), kind[0] == "s"), id_col))
        elif kind in _LEAVES:
            out.append(_LEAVES[kind](spec))
        else:
            raise DslError(f"unknown clause {kind!r}")
    return _all(out)


_LEAVES = {"term": _term, "range": _range, "wildcard": _wildcard, "regexp": _regexp, "fuzzy": _fuzzy, "match": _match, "match_phrase": _match_phrase, "multi_match": _multi_match}

_QUERY_TOKEN = re.compile(r'\s*(?:(\()|(\))|(AND\b|&&)|(OR\b|\|\|)|(NOT\b|!)|([+\-|](?=\S))|(?:([\w.]+):)?(?:"([^"]*)"(?:~\d+)?|([\[{][^\]}]*\sTO\s[^\]}]*[\]}])|((?:\\.|[^\s()"])+)))')


def parse_query_string(text: str, fields: list[str], default: str = "or", simple: bool = False) -> dict:
    """``a AND (b OR field:c*) NOT "some words"`` as a query; unfielded words search ``fields``.

    ``simple`` knows + | - and quotes instead of words as operators. Ranges are field:[a TO b] or {a TO b}.
    """
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _QUERY_TOKEN.match(text, at)
        if not m:
            raise DslError(f"query string: cannot read {text[at:]!r}")
        tokens.append(m.groups())
        at = m.end()

    def leaf(field: str | None, phrase: str | None, span: str | None, word: str | None) -> dict:
        names = [field] if field else list(fields)
        if not names:
            raise DslError("query string: no field to search")
        if field == "_exists_":
            return {"exists": {"field": word}}

        def on(f: str) -> dict:
            f = f.split("^")[0]
            if phrase is not None:
                return {"match_phrase": {f: phrase}}
            if span is not None:
                lo, hi = re.split(r"\sTO\s", span[1:-1])
                bounds = {("gte" if span[0] == "[" else "gt"): _number(lo.strip()), ("lte" if span[-1] == "]" else "lt"): _number(hi.strip())}
                return {"range": {f: {k: v for k, v in bounds.items() if v != "*"}}}
            if m := re.fullmatch(r"(>=|<=|>|<)(.+)", word):
                return {"range": {f: {{">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[m[1]]: _number(m[2])}}}
            if word.endswith("~") or re.search(r"~\d$", word):
                base, _, n = word.partition("~")
                return {"fuzzy": {f: {"value": base, "fuzziness": int(n or 2)}}}
            if "*" in word or "?" in word:
                return {"exists": {"field": f}} if word == "*" else {"wildcard": {f: word}}
            return {"match": {f: re.sub(r"\\(.)", r"\1", word)}}

        parts = [on(f) for f in names]
        return parts[0] if len(parts) == 1 else {"bool": {"should": parts}}

    pos = 0

    def group() -> dict:
        nonlocal pos
        alternatives: list[list[tuple[str, dict]]] = [[]]
        sign, joined = "", ""
        while pos < len(tokens):
            opened, closed, and_, or_, not_, mark, field, phrase, span, word = tokens[pos]
            if closed:
                break
            pos += 1
            if and_ and not simple:
                joined = "and"
                continue
            if (or_ and not simple) or (mark == "|" and simple):
                joined = "or"
                continue
            if (not_ and not simple) or mark == "-":
                sign = "-"
                continue
            if mark == "+":
                sign = "+"
                continue
            if opened:
                node = group()
                pos += 1
            else:
                word = word or next((x for x in (and_, or_, not_, mark) if x), word)
                node = leaf(field, phrase, span, word)
            how = joined or default.lower()
            if how == "or" and sign == "" and alternatives[-1]:
                alternatives.append([])
            alternatives[-1].append((sign, node))
            sign, joined = "", ""
        return combined(alternatives)

    def combined(alternatives: list[list[tuple[str, dict]]]) -> dict:
        must = [n for a in alternatives for s, n in a if s == "+"]
        must_not = [n for a in alternatives for s, n in a if s == "-"]
        rest = [[n for s, n in a if s == ""] for a in alternatives]
        rest = [a[0] if len(a) == 1 else {"bool": {"must": a}} for a in rest if a]
        if must:
            rest = []  # required words decide; optional ones would only rank
        if not must and not must_not and len(rest) == 1:
            return rest[0]
        spec: dict[str, Any] = {}
        if must:
            spec["must"] = must
        if must_not:
            spec["must_not"] = must_not
        if rest:
            spec["should" if len(rest) > 1 else "must"] = rest
        return {"bool": spec} if spec else {"match_all": {}}

    out = group()
    if pos < len(tokens):
        raise DslError("query string: a bracket is closed that was not opened")
    return out


def _number(text: str) -> Any:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def _sort_keys(spec: Any, id_col: str | None) -> list[tuple[str, bool]]:
    """(field, descending) of each column of an order; the id settles ties."""
    out = []
    for s in _listed(spec or []):
        field, how = (s, "asc") if isinstance(s, str) else next(iter(s.items()))
        how = how.get("order", "asc") if isinstance(how, Mapping) else how
        out.append((id_col if field == "_id" and id_col else field, how == "desc"))
    return out + ([(id_col, False)] if id_col and id_col not in [f for f, _ in out] else [])


def _after(keys: list[tuple[str, bool]], values: list) -> Column:
    """Rows that stand after ``values`` in an order with nulls last: equal in the first columns and beyond in the next."""
    out, same = F.lit(False), F.lit(True)
    for (field, down), v in zip(keys, values, strict=True):
        c = _col(field)
        beyond = F.lit(False) if v is None else ((c < F.lit(v)) if down else (c > F.lit(v))) | c.isNull()
        out = out | (same & F.coalesce(beyond, F.lit(False)))
        same = same & c.eqNullSafe(F.lit(v))
    return out


_SCORED = ("match", "multi_match", "match_phrase")


def _scores(df: DataFrame, kind: str, spec: Mapping, id_col: str) -> DataFrame:
    """(id, _score) of the documents that a full-text clause hits; statistics are those of ``df``."""
    parts = [(f, str(_value(v, "query", "phrase"))) for f, v in spec.items()] if kind != "multi_match" else [(f.split("^")[0], spec["query"]) for f in spec["fields"]]
    scores = None
    for f, text in parts:
        one = phrase_search(df, id_col, f, text).withColumnRenamed("freq", "_score") if kind == "match_phrase" else bm25(df, id_col, f, text).withColumnRenamed("score", "_score")
        one = one.select(F.col(id_col), F.col("_score").cast("double"))
        scores = one if scores is None else scores.unionByName(one)
    return scores.groupBy(id_col).agg(F.sum("_score").alias("_score")) if len(parts) > 1 else scores


def _holds_text(clause: Mapping) -> bool:
    return next(iter(clause)) in _SCORED


def _bool_scores(df: DataFrame, spec: Mapping, id_col: str) -> DataFrame | None:
    """(id, _score) of a bool query with full-text clauses in must or should; None if it has none.

    Full-text clauses under must are needed and add their scores, those under should add theirs; other clauses filter, and under should
    they add one where they hold. filter and must_not never score.
    """
    must, should = _listed(spec.get("must") or []), _listed(spec.get("should") or [])
    if not any(map(_holds_text, [*must, *should])):
        return None
    rest = {k: v for k, v in spec.items() if k in ("filter", "must_not")} | {"must": [c for c in must if not _holds_text(c)]}
    rest = {k: v for k, v in rest.items() if v}
    out = (df.where(to_filter({"bool": rest}, id_col)) if rest else df).withColumns({"__score": F.lit(0.0), "__met": F.lit(0)})
    for c in filter(_holds_text, must):
        kind = next(iter(c))
        out = out.join(_scores(df, kind, c[kind], id_col), id_col).withColumn("__score", F.col("__score") + F.col("_score")).drop("_score")
    for c in should:
        kind = next(iter(c))
        if kind in _SCORED:
            out = out.join(_scores(df, kind, c[kind], id_col), id_col, "left")
        else:
            out = out.withColumn("_score", F.when(to_filter(c, id_col), 1.0))
        out = out.withColumns({"__score": F.col("__score") + F.coalesce("_score", F.lit(0.0)), "__met": F.col("__met") + F.col("_score").isNotNull().cast("int")}).drop("_score")
    least = spec.get("minimum_should_match", 0 if must or spec.get("filter") else 1) if should else 0
    if isinstance(least, str):
        least = int(len(should) * int(least[:-1]) / 100) if least.endswith("%") else int(least)
    least = len(should) + least if least < 0 else least
    return out.where(F.col("__met") >= least).select(id_col, F.col("__score").alias("_score"))


def search(df: DataFrame, request: Mapping, id_col: str) -> DataFrame:
    """Rows of a request: query, knn, sort, from, size, _source, search_after.

    ``match``, ``multi_match`` and ``match_phrase`` score by BM25 or counts of the phrase, at the top or in a bool's must and should;
    ``knn`` scores by distance. Other queries filter. Scored results come best first with ``_score``.
    ``search_after`` is where the page before ended: its last row's values of all sort columns (and its id), or its id alone.
    """
    query, size, skip = dict(request.get("query") or {}), int(request.get("size", 10)), int(request.get("from", 0))
    near = query.pop("knn", None) or request.get("knn")
    ranked = next((k for k in _SCORED if k in query), None)
    spec = query.pop(ranked) if ranked else None
    mixed = _bool_scores(df, query["bool"], id_col) if list(query) == ["bool"] and not near and not ranked else None
    rows = df.where(to_filter(query, id_col)) if query and mixed is None else df
    if near:
        k = int(near.get("k", size))
        rows = rows.where(to_filter(near["filter"], id_col)) if near.get("filter") else rows
        out, keys = knn(rows, near["field"], near["query_vector"], k, id_col, near.get("metric", "l2"), score="_score"), [("_score", False), (id_col, False)]
    elif ranked or mixed is not None:
        scores = mixed if mixed is not None else _scores(rows, ranked, spec, id_col)
        out, keys = rows.join(scores, id_col), [("_score", True), (id_col, False)]
    else:
        out, keys = rows, _sort_keys(None, id_col)
    if request.get("sort"):
        keys = _sort_keys(request["sort"], id_col)
    if "search_after" in request:
        last = request["search_after"]
        if not isinstance(last, (list, tuple)):
            found = None if keys == [(id_col, False)] else out.where(_col(id_col) == F.lit(last)).select(*[_col(f) for f, _ in keys]).first()
            last = list(found) if found is not None else [last]
        if len(last) == 1 < len(keys):  # an id whose row is gone says no more than its place among ids
            keys = [(id_col, False)]
        elif len(last) == len(keys) - 1:
            keys = keys[:-1]
        out = out.where(_after(keys, list(last)))
        keys = keys if (id_col, False) in keys else [*keys, (id_col, False)]
    out = out.orderBy(*[_col(f).desc_nulls_last() if down else _col(f).asc_nulls_last() for f, down in keys])
    out = out.offset(skip).limit(size) if skip else out.limit(size)
    wanted = request.get("_source")
    if wanted:
        out = out.select(*[_col(c) for c in _listed(wanted)], *(["_score"] if "_score" in out.columns else []))
    return out


METRICS = {
    "avg": lambda c: F.avg(c),
    "sum": lambda c: F.sum(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "value_count": lambda c: F.count(c),
    "cardinality": lambda c: F.count_distinct(c),
}


def _metric_columns(name: str, kind: str, spec: Mapping) -> list[Column]:
    c = _col(spec["field"])
    if kind in METRICS:
        return [METRICS[kind](c).alias(name)]
    base = [F.count(c).alias(f"{name}_count"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c).alias(f"{name}_avg"), F.sum(c).alias(f"{name}_sum")]
    if kind == "stats":
        return base
    if kind == "extended_stats":
        return [*base, F.sum(c * c).alias(f"{name}_sum_of_squares"), F.var_pop(c).alias(f"{name}_variance"), F.stddev_pop(c).alias(f"{name}_std_deviation")]
    if kind == "percentiles":
        percents = spec.get("percents", [1, 5, 25, 50, 75, 95, 99])
        exact = spec.get("exact", False)
        return [(F.percentile(c, F.lit(p / 100)) if exact else F.percentile_approx(c, p / 100, 10_000)).alias(f"{name}_p{p:g}".replace(".", "_")) for p in percents]
    raise DslError(f"unknown aggregation {kind!r}")


_DATE_UNITS = {"1m": "minute", "minute": "minute", "1h": "hour", "hour": "hour", "1d": "day", "day": "day", "1w": "week", "week": "week", "1M": "month", "month": "month", "1q": "quarter", "quarter": "quarter", "1y": "year", "year": "year"}


def _bucket(kind: str, spec: Mapping) -> Column | None:
    """The key expression of a bucket aggregation that is one grouping."""
    if kind == "terms":
        return _col(spec["field"])
    if kind == "histogram":
        step = float(spec["interval"])
        return F.floor(_col(spec["field"]) / F.lit(step)) * F.lit(step)
    if kind == "date_histogram":
        unit = spec.get("calendar_interval") or spec.get("fixed_interval") or spec.get("interval", "day")
        if unit not in _DATE_UNITS:
            raise DslError(f"date_histogram: unit {unit!r}")
        return F.date_trunc(_DATE_UNITS[unit], _col(spec["field"]))
    return None


def aggregate(df: DataFrame, aggs: Mapping, keys: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Name (path of names for sub-aggregations) to DataFrame.

    Metrics of one level are one pass. A bucket aggregation gives key, doc_count and the metrics below it as columns; bucket
    aggregations below it have frames of their own, whose rows begin with the keys of the levels above.
    """
    out: dict[str, DataFrame] = {}
    metrics: list[Column] = []
    for name, spec in aggs.items():
        below = spec.get("aggs") or spec.get("aggregations") or {}
        kind, body = next((k, v) for k, v in spec.items() if k not in ("aggs", "aggregations"))
        inner = [c for n, s in below.items() for k, v in s.items() if k in METRICS or k in ("stats", "extended_stats", "percentiles") for c in _metric_columns(n, k, v)]
        deeper = {n: s for n, s in below.items() if not any(k in METRICS or k in ("stats", "extended_stats", "percentiles") for k in s)}
        if kind in ("filter", "missing"):
            rows = df.where(to_filter(body)) if kind == "filter" else df.where(_col(body["field"]).isNull())
            out[name] = _grouped(rows, keys, inner)
            for n, frame in aggregate(rows, deeper, keys).items():
                out[f"{name}.{n}"] = frame
        elif kind == "range":
            labelled = _ranges(df, body)
            out[name] = _grouped(labelled, (*keys, "key"), inner).orderBy(*keys, "key") if deeper or inner else _grouped(labelled, (*keys, "key"), inner)
            for n, frame in aggregate(labelled.withColumnRenamed("key", f"{name}_key"), deeper, (*keys, f"{name}_key")).items():
                out[f"{name}.{n}"] = frame
        elif kind == "composite":
            out[name] = _composite(df, body, keys, inner)
        elif kind == "significant_terms":
            out[name] = significant_terms(df, body["field"], to_filter(body["foreground"]), int(body.get("size", 10)), int(body.get("min_doc_count", 3)))
        elif (key := _bucket(kind, body)) is not None:
            labelled = df.withColumn(f"{name}_key", key).where(F.col(f"{name}_key").isNotNull())
            rows = _grouped(labelled, (*keys, f"{name}_key"), inner).where(F.col("doc_count") >= int(body.get("min_doc_count", 1)))
            rows = rows.withColumnRenamed(f"{name}_key", "key")
            if kind == "terms" and not keys:
                rows = rows.orderBy(F.col("doc_count").desc(), "key").limit(int(body.get("size", 10)))
            out[name] = rows
            for n, frame in aggregate(labelled, deeper, (*keys, f"{name}_key")).items():
                out[f"{name}.{n}"] = frame
        else:
            metrics += _metric_columns(name, kind, body)
    if metrics:
        out["metrics"] = df.groupBy(*keys).agg(*metrics) if keys else df.agg(*metrics)
    return out


def _grouped(rows: DataFrame, keys: tuple[str, ...], inner: list[Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("doc_count"), *inner)


def _ranges(df: DataFrame, spec: Mapping) -> DataFrame:
    """A row for each range (from <= x < to) that a value lies in; ranges may overlap."""
    c = _col(spec["field"])
    hit = []
    for r in spec["ranges"]:
        lo, hi = r.get("from"), r.get("to")
        name = r.get("key") or f"{'*' if lo is None else f'{lo:g}'}-{'*' if hi is None else f'{hi:g}'}"
        inside = _all([*([c >= F.lit(lo)] if lo is not None else []), *([c < F.lit(hi)] if hi is not None else []), c.isNotNull()])
        hit.append(F.when(inside, F.lit(name)))
    return df.withColumn("key", F.explode(F.array_compact(F.array(*hit))))


def _composite(df: DataFrame, spec: Mapping, keys: tuple[str, ...], inner: list[Column]) -> DataFrame:
    """Groups of several sources, sorted, one page after the key ``after``."""
    names, order = [], []
    rows = df
    for s in spec["sources"]:
        name, body = next(iter(s.items()))
        kind, field = next(iter(body.items()))
        rows = rows.withColumn(name, _bucket(kind, field))
        names.append(name)
        order.append(field.get("order", "asc"))
    rows = rows.where(_all([F.col(n).isNotNull() for n in names]))
    after = spec.get("after")
    if after:
        past, same = F.lit(False), F.lit(True)
        for n, o in zip(names, order, strict=True):
            v = F.lit(after[n])
            past = past | (same & (F.col(n) < v if o == "desc" else F.col(n) > v))
            same = same & (F.col(n) == v)
        rows = rows.where(past)
    by = [F.col(n).desc() if o == "desc" else F.col(n).asc() for n, o in zip(names, order, strict=True)]
    return _grouped(rows, (*keys, *names), inner).orderBy(*keys, *by).limit(int(spec.get("size", 10)))


def significant_terms(df: DataFrame, field: str, foreground: Column, size: int = 10, least: int = 3) -> DataFrame:
    """(key, doc_count, bg_count, score): terms more common in the foreground than in all rows, by the JLH score.

    One pass counts both sides; their totals are sums over the same groups.
    """
    inside = F.coalesce(foreground, F.lit(False)).cast("long")
    by = df.groupBy(_col(field).alias("key")).agg(F.sum(inside).alias("doc_count"), F.count("*").alias("bg_count"))
    totals = by.agg(F.sum("doc_count").alias("f"), F.sum("bg_count").alias("b"))
    rows = by.where(F.col("key").isNotNull() & (F.col("doc_count") >= least)).crossJoin(F.broadcast(totals))  # one row
    pf, pb = F.col("doc_count") / F.col("f"), F.col("bg_count") / F.col("b")
    score = F.when((pf > pb) & (pb < 1), (pf - pb) / (1 - pb) * (pf / pb))
    return rows.withColumn("score", score).where("score > 0").select("key", "doc_count", "bg_count", "score").orderBy(F.col("score").desc(), "key").limit(size)
