"""The rest of the interface, each part as a query with the same rows in SQL: keys, splits, deletes on read, indexes, points, bulk
writes, definitions, settings, quantised and indexed search, entities, graph functions in SQL."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrake.functions import vector
from quillrake.operators import documents, dsl, fulltext, quantize, retrieval
from quillrake.operators.graph import entities, exchange
from quillrake.plans.durable import new_path
from quillrake.session import Engine
from quillrake.sources import ingest
from quillrake.sources.table import ConstraintError, Table

from .graphs import CUSTOMER, TREE, _pagerank_sql, _WALK, chain, tree
from .registry import Register, table
from .tables import _BASE, _orders
from .vectors import _BITS, _DISTANCES, _QUERY, _W, PROBE, E, _bm25_sql, _cos, _lit, _pairs

R = Register()


def _engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    engine = Engine(spark, new_path(spark, "warehouse"))
    for n in names:
        engine.register(n, table(spark, sf_dir, n))
    return engine


def _customers(spark: SparkSession, sf_dir: str, **options) -> Table:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return Table.from_dataframe(rows, new_path(spark, "customers"), **options)


_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer"


def _refused(*attempts) -> int:
    """How many of the calls a constraint refuses."""
    n = 0
    for attempt in attempts:
        try:
            attempt()
        except ConstraintError:
            n += 1
    return n


# Tables.
@R.add(f"{_BASE} WHERE o_orderkey = 100")
def table_lookup_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, primary_key=["o_orderkey"]).lookup(100)


@R.add("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def table_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of a table cover it once."""
    t = _orders(spark, sf_dir, partition_by=["o_orderstatus"])
    rows = None
    for s in t.splits(1):
        part = t.read_split(s)
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.add(f"{_BASE} WHERE o_totalprice >= 100000 AND o_custkey % 7 <> 0")
def table_merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete files by position and by key are applied as the table is read."""
    t = _orders(spark, sf_dir)
    t.delete_on_read("o_totalprice < 100000")
    t.delete_on_read(keys=table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("o_custkey")))
    return t.df()


@R.add("SELECT * FROM customer")
def table_mounted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that stay where they are; what arrives later is taken up by a sync."""
    rows, path = table(spark, sf_dir, "customer"), new_path(spark, "files")
    rows.where("c_custkey % 2 = 0").write.parquet(path)
    t = Table.mount(spark, path, new_path(spark, "mounted"))
    rows.where("c_custkey % 2 = 1").write.mode("append").parquet(path)
    t.sync()
    return t.df()


@R.add("SELECT count(*) AS n, 0 AS inversions FROM orders")
def table_write_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each file stand in the order that the table asks for."""
    t = _orders(spark, sf_dir)
    t.set_sort_order(["o_custkey", "o_orderkey"])
    t.overwrite(t.df())
    names = {c["name"]: c["physical"] for c in t.state["columns"]}
    rows = spark.read.parquet(*[t.storage.full(f["path"]) for f in t.state["files"]]).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"), F.struct(F.col(names["o_custkey"]), F.col(names["o_orderkey"])).alias("k"))
    before = F.lag("k").over(Window.partitionBy("f").orderBy("i"))
    return rows.withColumn("b", before).agg(F.count("*").alias("n"), F.count_if(F.col("b") > F.col("k")).cast("int").alias("inversions"))


@R.add("SELECT count(*) AS n, 3 AS refused FROM orders")
def table_primary_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys are refused by appends, merges and overwrites, before anything is committed."""
    t = _orders(spark, sf_dir, primary_key=["o_orderkey"])
    rows, v = t.df(), t.version
    refused = _refused(lambda: t.append(rows.limit(5)), lambda: t.overwrite(rows.union(rows.limit(1))), lambda: t.merge(rows.where("o_orderkey > 100").withColumn("o_orderkey", F.lit(100).cast("long")).withColumn("k", F.col("o_custkey") + 10**9).dropDuplicates(["k"]), {"o_custkey": "k"}, not_matched=[(None, None)]))
    return t.refresh().df(version=v).agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@R.add("SELECT count(*) AS n, 2 AS refused FROM embeddings")
def table_write_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls in a required column and vectors of another dimension are refused."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    t = Table.from_dataframe(rows, new_path(spark, "vectors"))
    t.set_not_null("vec_id")
    t.set_properties({"vector_dimensions": {"embedding": 64}})
    refused = _refused(lambda: t.append(rows.limit(1).withColumn("vec_id", F.lit(None).cast("long"))), lambda: t.append(rows.limit(1).withColumn("embedding", F.slice("embedding", 1, 3))))
    return t.df().agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@R.add("SELECT c_nationkey, count(*) AS n, 1 AS freed FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def table_expire_and_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old versions go, their files are freed, and the rows there are now stay."""
    t = _customers(spark, sf_dir)
    t.delete("NOT c_acctbal > 0")
    t.compact()
    freed = int(bool(t.expire(1)) and bool(t.vacuum(0)) and not t.verify())
    return t.df().groupBy("c_nationkey").agg(F.count("*").alias("n")).withColumn("freed", F.lit(freed))


@R.add(f"{_CUSTOMER} WHERE c_nationkey < 10 UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey >= 10")
def table_branch_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writers of two branches leave each other's versions alone, also when they take turns."""
    t = _customers(spark, sf_dir)
    trial = t.create_branch("trial")
    trial.delete("c_nationkey < 10")
    t.refresh().delete("c_nationkey >= 10")
    trial.refresh().update({"c_custkey": "c_custkey + 10000000"})
    return Table(spark, t.path).df().unionByName(Table(spark, t.path, "trial").df())


# Sources and sinks.
@R.add("SELECT * FROM nation")
def source_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of the Arrow IPC format, written by another program."""
    rows, path = ingest.to_arrow(table(spark, sf_dir, "nation")), new_path(spark, "ipc")
    data = pa.BufferOutputStream()
    with pa.ipc.new_file(data, rows.schema) as out:
        out.write_table(rows)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/nation.arrow")
    stream = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    stream.write(bytearray(data.getvalue().to_pybytes()))
    stream.close()
    return ingest.read_files(spark, path, "ipc")


@R.add("SELECT * FROM nation")
def arrow_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.from_arrow(spark, ingest.to_arrow(table(spark, sf_dir, "nation")))


@R.add("SELECT n_regionkey::BIGINT AS source, n_nationkey::BIGINT + 100 AS target FROM nation")
def graph_edge_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("source"), (F.col("n_nationkey").cast("long") + 100).alias("target"))
    path = new_path(spark, "edges")
    spark.createDataFrame([(x,) for x in exchange.to_edge_list(e).split("\n")], "value string").write.text(path)
    return exchange.from_edge_list(spark, path)


# Definitions, settings, policies.
@R.add("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir, "lineitem")
    engine.sql("CREATE VIEW large AS SELECT * FROM lineitem WHERE l_quantity > 25")
    return engine.sql("SELECT l_returnflag, count(*) AS n FROM large GROUP BY 1")


@R.add("SELECT o_orderkey AS k, [o_custkey, 1][1] AS c, epoch(o_orderdate - TIMESTAMP '1990-01-01')::BIGINT AS s FROM orders WHERE o_orderstatus = 'F'")
def sql_hints_and_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, optimizer hints, a closing semicolon and other engines' spellings."""
    return _engine(spark, sf_dir, "orders").sql("SELECT /*+ ef_search(40) probes(3) use_index(v) */ arrow_cast(o_orderkey, 'Int64') AS k, make_array(o_custkey, 1)[0] AS c, EXTRACT(EPOCH FROM (o_orderdate - TIMESTAMP_NTZ '1990-01-01')) AS s -- ; SELECT 1\nFROM orders /* x <-> y */ WHERE o_orderstatus = 'F';")


@R.add("SELECT * FROM (VALUES ('default', 'customer', 'c_custkey', 1), ('s', 'kept', 'k', 1), ('s', 'kept', 'note', 2)) t(table_schema, table_name, column_name, ordinal_position)")
def sql_schemas_and_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE and DROP of schemas and tables, seen by another engine of the same warehouse through information_schema."""
    engine = _engine(spark, sf_dir)
    engine.sql("CREATE SCHEMA s")
    engine.sql("CREATE SCHEMA gone")
    engine.sql("CREATE TABLE s.kept (k BIGINT PRIMARY KEY, note TEXT)")
    engine.sql("CREATE TABLE s.gone AS SELECT 1 AS a")
    engine.sql("DROP TABLE s.gone")
    engine.sql("DROP SCHEMA gone")
    other = Engine(spark, engine.warehouse)
    if other.schemas != {"default", "s"}:
        raise AssertionError(other.schemas)
    other.register("customer", table(spark, sf_dir, "customer").select("c_custkey"))
    return other.sql("SELECT table_schema, table_name, column_name, ordinal_position FROM information_schema.columns")


@R.add("SELECT * FROM (VALUES ('default_index_algorithm', 'bloom', 1)) t(key, value, refused)")
def sql_settings_and_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET, SHOW, and a table that may only be read."""
    engine = _engine(spark, sf_dir)
    engine.sql("SET default_index_algorithm = 'bloom'")
    engine.sql("CREATE TABLE t AS SELECT 1 AS a")
    engine.read_only.add("t")
    try:
        engine.sql("DELETE FROM t")
        refused = 0
    except PermissionError:
        refused = 1
    return engine.sql("SHOW default_index_algorithm").withColumn("refused", F.lit(refused))


@R.add("SELECT * FROM (VALUES ('b', 'bloom', 'c_name', TRUE), ('f', 'bm25', 'c_name', TRUE), ('m', 'bitmap', 'c_nationkey', TRUE), ('c', 'composite', 'c_nationkey,c_name', TRUE)) t(name, kind, \"column\", fresh)")
def sql_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of several kinds: made, outdated by a write, rebuilt, dropped."""
    engine = _engine(spark, sf_dir)
    engine.tables["c"] = _customers(spark, sf_dir)
    for name, kind, columns in (("b", "bloom", "c_name"), ("f", "bm25", "c_name"), ("m", "bitmap", "c_nationkey"), ("c", "composite_bitmap", "c_nationkey, c_name"), ("x", "inverted", "c_name")):
        engine.sql(f"CREATE INDEX {name} ON c USING {kind} ({columns})")
    engine.sql("DELETE FROM c WHERE c_acctbal < 0")
    engine.sql("ALTER TABLE c EXECUTE recover_indexes")
    engine.table("c").drop_index("x")
    return engine.sql("SHOW INDEXES ON c")


# Functions by their SQL names.
@R.add(f"""
    SELECT vec_id, round(list_inner_product({E}, {_lit(PROBE)}), 6) AS dot, round(list_inner_product({E}, {_lit(PROBE)}), 6) AS sparse_dot, round(0.25 * list_distance({E}, {_lit(PROBE)}) + 0.75 * label, 6) AS mixed,
           round(1.0 / 61 + 1.0 / (60 + label), 9) AS fused, round(sqrt(list_sum(list_transform(list_zip({E}, {_lit(PROBE)}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS apart FROM embeddings""")
def vector_functions_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = f"'{PROBE}'::vector"
    return _engine(spark, sf_dir, "embeddings").sql(f"""
        SELECT vec_id, round(dot_product(embedding, {v}), 6) AS dot, round(sparse_dot_product(vector_to_sparse(embedding), vector_to_sparse({v})), 6) AS sparse_dot, round(hybrid_score(l2_distance(embedding, {v}), cast(label AS DOUBLE), 0.25D), 6) AS mixed,
               round(reciprocal_rank_fusion(array(1D, cast(label AS DOUBLE)), 60D), 9) AS fused, round(vector_norm(vector_sub(embedding, {v})), 6) AS apart FROM embeddings""")


@R.add(f"SELECT vec_id, round({_DISTANCES['l2']}, 6) AS l2, round({_DISTANCES['ip']}, 6) AS ip FROM embeddings")
def functions_registered_in_a_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain Spark SQL knows the functions once they are registered."""
    from quillrake.functions.registry import register_functions

    register_functions(spark)
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("registered_embeddings")
    v = f"cast(array({', '.join(f'{x}D' for x in PROBE)}) AS ARRAY<DOUBLE>)"
    return spark.sql(f"SELECT vec_id, round(vector_distance(cast(embedding AS ARRAY<DOUBLE>), {v}), 6) AS l2, round(dist_ip(cast(embedding AS ARRAY<DOUBLE>), {v}), 6) AS ip FROM registered_embeddings")


@R.add(f"SELECT vec_id, round(list_sum(list_transform(list_zip({E}, {_lit(PROBE)}), lambda p: p[1] - p[2])), 6) AS total, round(1 - bit_count({_BITS.format(0, '>')} & 170) / bit_count({_BITS.format(0, '>')} | 170), 9) AS jaccard, 64 AS dims FROM embeddings")
def vector_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    first = F.slice(vector.binary_quantize(v), 1, 1)
    total = F.aggregate(vector.vector_sub(v, PROBE), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 6).alias("total"), F.round(vector.packed_jaccard(first, F.array(F.lit(170))), 9).alias("jaccard"), vector.sparse_dims(vector.vector_to_sparse(v)).alias("dims"))


_OPERATORS = {"cosine": "<=>", "ip": "<#>", "l1": "<+>"}


def _by_operator(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = f"embedding {_OPERATORS[metric]} '{PROBE}'::vector"
        return _engine(spark, sf_dir, "embeddings").sql(f"SELECT vec_id, round({d}, 6) AS distance FROM embeddings ORDER BY {d}, vec_id LIMIT 10")

    run.__name__ = f"knn_{metric}"
    return run


for _metric in _OPERATORS:
    R.add(f"SELECT vec_id, round({_DISTANCES[_metric]}, 6) AS distance FROM embeddings ORDER BY {_DISTANCES[_metric]}, vec_id LIMIT 10")(_by_operator(_metric))

_SIGNS = [float(x > 0) for x in PROBE]
_OF = f"list_transform({E}, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


@R.add(f"SELECT vec_id, {_pairs(_OF, _lit(_SIGNS), 'abs(p[1] - p[2])')} AS hamming, round(1 - {_pairs(_OF, _lit(_SIGNS), 'p[1] * p[2]')} / {_pairs(_OF, _lit(_SIGNS), 'greatest(p[1], p[2])')}, 9) AS jaccard FROM embeddings")
def binary_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    bits = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    engine.register("signs", table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("bits")))
    return engine.sql(f"SELECT vec_id, bits <~> '{_SIGNS}'::vector AS hamming, round(bits <%> '{_SIGNS}'::vector, 9) AS jaccard FROM signs")


# Search.
def _vectors(spark: SparkSession, sf_dir: str) -> Table:
    return Table.from_dataframe(table(spark, sf_dir, "embeddings"), new_path(spark, "vectors"), primary_key=["vec_id"])


@R.add(f"SELECT vec_id, round({_DISTANCES['cosine']}, 6) AS distance FROM embeddings WHERE label <> 4 ORDER BY {_DISTANCES['cosine']}, vec_id LIMIT 15")
def table_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).vector_search("embedding", PROBE, 15, metric="cosine", where="label <> 4")
    return rows.select("vec_id", F.round("distance", 6).alias("distance"))


def _recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Whether at least 0.9 of the exact rows are found."""
    both = exact.select("vec_id").join(found.select("vec_id"), "vec_id", "left_semi").agg(F.count("*").alias("hits"))
    return both.crossJoin(exact.agg(F.count("*").alias("n"))).select((F.col("hits") >= 0.9 * F.col("n")).alias("enough"))


_ENOUGH = "SELECT TRUE AS enough"


@R.add(_ENOUGH)
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of two of the table's vectors, by a fresh index that probes 13 of 16 cells (the vectors hardly cluster), against the exact search."""
    t, e = _vectors(spark, sf_dir), table(spark, sf_dir, "embeddings")
    t.create_index("cells", "ivf", "embedding", cells=16)
    asked = [list(r["embedding"]) for r in e.where("vec_id IN (0, 100)").collect()]
    exact = [retrieval.knn(e, "embedding", q, 10, "vec_id").select("vec_id", F.lit(i).alias("q")) for i, q in enumerate(asked)]
    found = [t.vector_search("embedding", q, 10, "cells", probes=13).select("vec_id", F.lit(i).alias("q")) for i, q in enumerate(asked)]
    key = F.concat_ws("/", "q", "vec_id").alias("vec_id")
    return _recall(exact[0].union(exact[1]).select(key), found[0].union(found[1]).select(key))


def _quantised(name: str, search):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings")
        return _recall(retrieval.knn(e, "embedding", PROBE, 10, "vec_id", "cosine" if name == "binary" else "l2"), search(e))

    run.__name__ = f"quantised_recall_{name}"
    R.add(_ENOUGH)(run)


def _sq8(e: DataFrame) -> DataFrame:
    q = quantize.ScalarQuantizer.fit(e, "embedding")
    return quantize.refined(e, vector.dist_l2(q.decode(q.encode("embedding")), PROBE), "embedding", PROBE, 10, "vec_id")


def _pq(e: DataFrame) -> DataFrame:
    q = quantize.ProductQuantizer.fit(e, "embedding", parts=16)
    return quantize.refined(q.encode(e, "embedding"), q.distance("pq_code", PROBE), "embedding", PROBE, 10, "vec_id", refine=8)


_quantised("sq8", _sq8)
_quantised("pq", _pq)
_quantised("binary", lambda e: quantize.binary_search(e, "embedding", PROBE, 10, "vec_id", refine=16))


def _texts(spark: SparkSession, sf_dir: str) -> Table:
    t = Table.from_dataframe(table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "texts"), primary_key=["doc_id"])
    t.create_index("words", "bm25", "text")
    return t


@R.add(f"{_bm25_sql()} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY score DESC, doc_id LIMIT 20")
def bm25_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the postings of the query's terms; the scores are those of a scan."""
    return _texts(spark, sf_dir).keyword_search("text", _QUERY, 20, "words").select("doc_id", F.round("score", 6).alias("score"))


@R.add(f"SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS freq FROM (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL) WHERE freq > 0")
def phrase_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).phrase_search("text", "of the", index="words")


@R.add(f"""{_bm25_sql()}, k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label < 8) ORDER BY score DESC, doc_id LIMIT 20),
    v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_DISTANCES['l2']}, vec_id) AS r FROM embeddings WHERE label < 8 AND vec_id IN (SELECT doc_id FROM documents) ORDER BY {_DISTANCES['l2']}, vec_id LIMIT 20)
    SELECT id AS doc_id, round(sum(1.0 / (60 + r)), 9) AS rrf_score FROM (SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT 10""")
def hybrid_search_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the engine, put together step by step; statistics of the text are those of the whole table."""
    engine = _engine(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    engine.register("both", docs.join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "left"))
    found = engine.hybrid_search("both", "text", _QUERY, "embedding", PROBE, 10, where="label < 8")
    return found.select("doc_id", F.round("rrf_score", 9).alias("rrf_score"))


# Documents and points.
_SCORES = [{"o_orderpriority": "desc"}, "o_orderstatus"]


@R.add("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders ORDER BY o_orderpriority DESC, o_orderstatus, o_orderkey LIMIT 30 OFFSET 40")
def dsl_search_after_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by several columns, after the last row of the one before."""
    orders, ask = table(spark, sf_dir, "orders"), {"sort": _SCORES, "_source": ["o_orderkey", "o_orderpriority", "o_orderstatus"]}
    last = dsl.search(orders, ask | {"size": 40}, "o_orderkey").collect()[-1]
    after = [last["o_orderpriority"], last["o_orderstatus"], last["o_orderkey"]]
    return dsl.search(orders, ask | {"size": 30, "search_after": after}, "o_orderkey")


@R.add(f"{_bm25_sql()} SELECT doc_id, round(score, 6) AS _score FROM b ORDER BY score DESC, doc_id LIMIT 10")
def dsl_match_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dsl.search(table(spark, sf_dir, "documents"), {"query": {"match": {"text": _QUERY}}, "_source": "doc_id"}, "doc_id")
    return found.select("doc_id", F.round("_score", 6).alias("_score"))


@R.add(f"{_bm25_sql()} SELECT doc_id, round(score + CASE WHEN source = 'src1' THEN 1 ELSE 0 END, 6) AS _score FROM b JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars <= 5000 ORDER BY score + CASE WHEN source = 'src1' THEN 1 ELSE 0 END DESC, doc_id LIMIT 15")
def dsl_bool_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full text under must scores, a term under should adds one, filter and must_not only decide."""
    query = {"bool": {"must": [{"match": {"text": _QUERY}}], "should": [{"term": {"source": "src1"}}], "filter": [{"term": {"lang": "en"}}], "must_not": [{"range": {"n_chars": {"gt": 5000}}}]}}
    found = dsl.search(table(spark, sf_dir, "documents"), {"query": query, "size": 15, "_source": "doc_id"}, "doc_id")
    return found.select("doc_id", F.round("_score", 6).alias("_score"))


@R.add("SELECT item_id, regexp_replace(text, '\\b(the|of)\\b', '<em>\\1</em>', 'gi') AS marked FROM benchmark")
def highlighted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", fulltext.highlight(F.col("text"), ["the", "of"]).alias("marked"))


@R.add(f"{_CUSTOMER} WHERE c_custkey NOT IN (1, 2, 3, 4) UNION ALL SELECT 1, 'one', 7, 1.5 UNION ALL SELECT c_custkey, 'two', c_nationkey, c_acctbal FROM customer WHERE c_custkey = 2 UNION ALL SELECT 90000000, 'new', NULL, 0.25 UNION ALL {_CUSTOMER} WHERE c_custkey = 4")
def documents_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _customers(spark, sf_dir, primary_key=["c_custkey"])
    lines = [{"index": {"_id": 1}}, {"c_name": "one", "c_nationkey": 7, "c_acctbal": 1.5}, {"update": {"_id": 2}}, {"doc": {"c_name": "two"}}, {"delete": {"_id": 3}}, {"index": {"_id": 90_000_000}}, {"c_name": "new", "c_acctbal": 0.25}]
    documents.bulk(t, "\n".join(map(json.dumps, lines)))
    return t.df()


@R.add("SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN 'five' ELSE c_name END AS c_name, c_nationkey, c_acctbal FROM customer WHERE NOT c_acctbal < 100 AND c_nationkey >= 3")
def documents_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update and delete by query, then a copy of what another query finds."""
    t = _customers(spark, sf_dir, primary_key=["c_custkey"])
    documents.update_by_query(t, {"term": {"c_nationkey": 5}}, {"c_name": "five"})
    documents.delete_by_query(t, {"range": {"c_acctbal": {"lt": 100}}})
    copy = Table.create(spark, new_path(spark, "copy"), t.schema, primary_key=["c_custkey"])
    documents.reindex(t, copy, {"range": {"c_nationkey": {"gte": 3}}})
    return copy.df()


@R.add(f"SELECT vec_id, round({_cos(PROBE)}, 6) AS score FROM embeddings WHERE label IN (2, 3) AND vec_id NOT IN (1, 2) ORDER BY {_cos(PROBE)} DESC, vec_id LIMIT 10 OFFSET 2")
def points_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = documents.Points(_vectors(spark, sf_dir), "embedding")
    found = p.search(PROBE, 10, {"should": [{"key": "label", "match": {"value": 2}}, {"key": "label", "range": {"gt": 2, "lt": 4}}], "must_not": [{"has_id": [1, 2]}]}, offset=2)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@R.add("SELECT vec_id, CASE WHEN label = 1 THEN 100 WHEN label = 2 THEN NULL ELSE label END AS label FROM embeddings WHERE label <> 3 AND vec_id > 50 ORDER BY vec_id LIMIT 200")
def points_payload_and_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = documents.Points(_vectors(spark, sf_dir), "embedding")
    has = lambda n: {"must": [{"key": "label", "match": {"value": n}}]}
    p.set_payload({"label": 100}, has(1))
    p.delete_payload(["label"], has(2))
    p.delete(has(3))
    return p.scroll(200, after=50).select("vec_id", "label")


@R.add("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_lookup_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table.from_dataframe(table(spark, sf_dir, "events").select("event_id", "props"), new_path(spark, "events"), primary_key=["event_id"])
    t.create_index("paths", "json", "props")
    return t.json_lookup("props", "$.k", "7", "paths").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# Entities.
@R.add("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '01') ORDER BY lower(c_name) = '01' DESC, length(c_name), c_custkey LIMIT 25")
def entities_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.find_entities(table(spark, sf_dir, "customer"), "01", 25, "c_name", "c_custkey")


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 8)")
def entities_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.lookup_entities(table(spark, sf_dir, "customer"), [3, 5, 8, -1], "c_name", "c_custkey")


@R.add("WITH c AS (SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS canonical, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT node, canonical FROM c WHERE n > 1")
def entities_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = chain(spark, sf_dir).withColumn("relation", F.lit("same_as"))
    other = same.select((F.col("source") * 0).alias("source"), "target").withColumn("relation", F.lit("knows"))
    return entities.resolve_entities(same.unionByName(other))


@R.add("SELECT a.title AS source, b.title AS target, 1.0::DOUBLE AS weight FROM (SELECT n_name AS title, n_regionkey AS k FROM nation) a JOIN (SELECT r_name AS title, r_regionkey AS k FROM region) b USING (k)")
def extracted_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples that a callback finds in texts, as nodes and edges."""
    texts = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("|", "n_name", F.lit("in"), "r_name").alias("text"))
    nodes, edges = entities.graph_of_triples(entities.extract_graph(texts, "n_nationkey", "text", lambda t: [tuple(t.split("|"))]))
    name = lambda side: nodes.select(F.col("id").alias(side), F.col("title").alias(f"{side}_title"))
    return edges.join(name("source"), "source").join(name("target"), "target").select(F.col("source_title").alias("source"), F.col("target_title").alias("target"), F.col("weight").cast("double").alias("weight"))


# Graph functions in SQL.
def _tree(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark)
    engine.register("tree", tree(spark, sf_dir))
    return engine


_FIRST = f"(SELECT min(c_custkey) + {CUSTOMER} FROM customer WHERE c_nationkey = 0)"


@R.add(f"SELECT * FROM (SELECT 0::BIGINT AS node, 0::BIGINT AS hop UNION ALL SELECT 100, 1 UNION ALL SELECT {_FIRST}, 2) WHERE (SELECT n_regionkey FROM nation WHERE n_nationkey = 0) = 0")
def sql_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").where("c_nationkey = 0").agg(F.min("c_custkey")).first()[0] + CUSTOMER
    return _tree(spark, sf_dir).sql(f"SELECT node, hop FROM graph_shortest_path('tree', 0, {first})")


@R.add(f"SELECT '0>100>' || {_FIRST} AS path WHERE (SELECT n_regionkey FROM nation WHERE n_nationkey = 0) = 0")
def sql_all_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").where("c_nationkey = 0").agg(F.min("c_custkey")).first()[0] + CUSTOMER
    return _tree(spark, sf_dir).sql(f"SELECT array_join(cast(path AS ARRAY<STRING>), '>') AS path FROM graph_all_shortest_paths('tree', 0, {first})")


@R.add(f"WITH RECURSIVE {TREE}, {_WALK.format(seed=1, edges='tree', hops=2)}, near AS (SELECT DISTINCT node FROM w) SELECT source, target FROM tree WHERE source IN (FROM near) AND target IN (FROM near)")
def sql_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).sql("SELECT source, target FROM graph_subgraph('tree', '1', 2)")


@R.add(f"WITH {TREE} SELECT source, target FROM tree WHERE source = 0 AND target = 100 UNION ALL SELECT source, target FROM tree WHERE source = 100 AND target = {_FIRST}")
def sql_connecting_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").where("c_nationkey = 0").agg(F.min("c_custkey")).first()[0] + CUSTOMER
    return _tree(spark, sf_dir).sql(f"SELECT source, target FROM graph_connecting_paths('tree', '0,100,{first}')")


@R.add(_pagerank_sql("tree", "SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS base FROM nodes", 0.85, 5, f"{TREE}, nodes AS MATERIALIZED (SELECT source AS node FROM tree UNION SELECT target FROM tree)").replace("AS score FROM r5", "AS rank FROM r5"))
def sql_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).sql("SELECT node, round(rank, 9) AS rank FROM graph_pagerank('tree', 0.85, 5)")


@R.add("WITH c AS (SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT component, count(*) AS nodes FROM c WHERE n > 1 GROUP BY 1")
def sql_graph_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph function as an aggregate gives one row with a list."""
    engine = Engine(spark)
    engine.register("chain", chain(spark, sf_dir))
    c = engine.sql("SELECT graph_connected_components(source, target) AS c FROM chain")
    return c.select(F.explode("c").alias("x")).select(F.col("x.component").alias("component")).groupBy("component").agg(F.count("*").alias("nodes"))



