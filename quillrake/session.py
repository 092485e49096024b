"""The engine: tables by name and SQL over them, in the dialect of ``plans.dialect``."""

from __future__ import annotations

import itertools
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.registry import macros, register_functions
from .operators import graph
from .operators.fluent import Search
from .operators.graph.drift import DriftSettings, drift_search, regional_drift
from .operators.vector_aggs import AGGS
from .plans import commands, dialect
from .plans.durable import shared_folder
from .sources.storage import Storage
from .sources.table import Table

GRAPH_FUNCTIONS = ("graph_neighbors", "neighbors", "graph_shortest_path", "shortest_path", "graph_all_shortest_paths", "all_shortest_paths", "graph_subgraph", "subgraph", "graph_connecting_paths", "connecting_paths", "graph_pagerank", "pagerank", "graph_louvain", "louvain", "subscribe_events")
SETTINGS = {"warehouse": None, "default_index_algorithm": "bitmap"}
_views = itertools.count()


#: Aggregate forms: SELECT f(source, target, ...) FROM edges gives one row with a list (or number) of what the table forms give.
GRAPH_AGGREGATES = (
    "graph_pagerank", "graph_personalized_pagerank", "graph_label_propagation", "graph_neighbors", "graph_subgraph", "graph_connecting_paths", "graph_shortest_path", "graph_all_shortest_paths", "graph_connected_components",
    "graph_strongly_connected_components", "graph_degree_centrality", "graph_closeness_centrality", "graph_betweenness_centrality", "graph_jaccard_coefficient", "graph_preferential_attachment", "graph_triangle_count",
    "graph_modularity", "graph_louvain_communities", "graph_leiden_communities", "drift_search", "regional_drift",
)


class Engine:
    """``tables`` maps names to versioned tables and to views of DataFrames. A name in SQL is the table's latest version."""

    def __init__(self, spark: SparkSession, warehouse: str | None = None) -> None:
        self.spark = spark
        self.settings: dict[str, Any] = dict(SETTINGS) | {"warehouse": warehouse or f"{shared_folder(spark)}/quillrake/warehouse"}
        self.tables: dict[str, Table | DataFrame] = {}
        self.read_only: set[str] = set()
        self.macros = macros()
        register_functions(spark)

    @property
    def warehouse(self) -> str:
        return str(self.settings["warehouse"])

    @property
    def schemas(self) -> set[str]:
        """Schemas are kept in the warehouse, so another session knows them too."""
        return {"default"} | {n.removesuffix(".json") for n in Storage(self.spark, self.warehouse).names("_schemas")}

    def create_schema(self, name: str) -> None:
        Storage(self.spark, self.warehouse).replace(f"_schemas/{name}.json", {"name": name})

    def drop_schema(self, name: str) -> None:
        Storage(self.spark, self.warehouse).delete(f"_schemas/{name}.json")

    def register(self, name: str, source: Table | DataFrame | str) -> None:
        """A table, a DataFrame or the path of Parquet files."""
        self.tables[name] = self.spark.read.parquet(source) if isinstance(source, str) else source

    def table(self, name: str) -> Table:
        t = self.tables.get(name)
        if isinstance(t, Table):
            return t.refresh()
        if t is None and Table.exists(self.spark, self.location(name)):
            self.tables[name] = Table(self.spark, self.location(name))
            return self.tables[name]
        raise ValueError(f"{name!r} is not a versioned table" if t is not None else f"no table {name!r}")

    def location(self, name: str) -> str:
        return f"{self.warehouse}/{name.replace('.', '/')}"

    def df(self, name: str) -> DataFrame:
        t = self.tables.get(name)
        return t if isinstance(t, DataFrame) else self.table(name).df()

    def writable(self, name: str) -> Table:
        if name in self.read_only or name.rpartition(".")[0] in self.read_only:
            raise PermissionError(f"{name} is read-only")
        return self.table(name)

    def view(self, df: DataFrame, hint: str) -> str:
        name = f"__{re.sub(r'\W', '_', hint)}_{next(_views)}"
        df.createOrReplaceTempView(name)
        return name

    def _vector_columns(self, names: set[str]) -> dict[str, str]:
        """Lower-case column name to table, of the arrays of numbers in the tables that a statement names."""
        out = {}
        for n in names & set(self.tables):
            t = self.tables[n]
            for f in t.schema.fields:
                if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.FloatType | T.DoubleType):
                    out[f.name.lower()] = n
        return out

    def _graph_function(self, name: str, args: list) -> str:
        """The result of a function in FROM as a view: f('table', ..., mode [, source column, target column])."""
        f = name.removeprefix("graph_")
        if f == "subscribe_events":
            from .streaming.feed import poll_events

            return self.view(poll_events(self.table(args[0]), *args[1:]), f)
        table, rest = args[0], list(args[1:])
        ends: dict[str, str] = {}
        mode = "auto"
        for i, x in enumerate(rest):
            if isinstance(x, str) and x in ("auto", "in_memory", "out_of_core", "cached"):
                mode = "in_memory" if x == "cached" else x
                ends = dict(zip(("source", "target"), rest[i + 1 : i + 3], strict=False))
                rest = rest[:i]
                break
        edges = graph.edge_table(self.df(table), **ends)
        listed = lambda x: [int(v) for v in str(x).split(",")]
        if f == "neighbors":
            out = graph.bfs(edges, listed(rest[0]), int(rest[1]) if len(rest) > 1 else 1, mode=mode).select("node", "hop", "seed")
        elif f == "shortest_path":
            out = graph.shortest_path(edges, int(rest[0]), int(rest[1]), mode=mode)
        elif f == "all_shortest_paths":
            out = graph.all_shortest_paths(edges, int(rest[0]), int(rest[1]), mode=mode)
        elif f == "subgraph":
            out = graph.subgraph(edges, listed(rest[0]), int(rest[1]) if len(rest) > 1 else 1, mode=mode)
        elif f == "connecting_paths":
            out = graph.connecting_paths(edges, listed(rest[0]), mode=mode)
        elif f == "pagerank":
            out = graph.pagerank(edges, *rest[:2], mode=mode).withColumnRenamed("score", "rank")
        else:
            out = graph.louvain(edges, resolution=float(rest[0]) if rest else 1.0)
        return self.view(out, f)

    def _element_wise(self, tokens: list[dialect.Token], vectors: Mapping[str, str]) -> list[dialect.Token]:
        """``vector_sum(v)`` and its like as one aggregate for each element, with the dimension of the column."""
        plain = {"vector_sum": "sum", "vector_avg": "avg", "centroid": "avg", "vector_min": "min", "vector_max": "max", "vector_stddev": "stddev_pop", "vector_median": "median"}
        out: list[dialect.Token] = []
        i = 0
        while i < len(tokens):
            t = tokens[i]
            if t.kind == "word" and t.text.lower() in AGGS and i + 1 < len(tokens) and tokens[i + 1] == "(":
                end = dialect._operand_end(tokens, i + 1)
                arg = tokens[i + 2 : end - 1]
                column = dialect.unquoted(arg[-1]).lower() if arg else ""
                if column not in vectors:
                    raise dialect.SqlError(f"{t.text} takes a vector column")
                size = self.df(vectors[column]).agg(F.max(F.size(column))).first()[0] or 0
                text, f = dialect.joined(arg), plain[t.text.lower()]
                parts = ", ".join(f"{f}(cast(get({text}, {k}) AS DOUBLE))" for k in range(size))
                check = f"CASE WHEN min(size({text})) <> max(size({text})) THEN raise_error('vectors of a group have different dimensions') ELSE max(size({text})) END"
                out.append(dialect.Token("vector", f"CASE WHEN count({text}) > 0 THEN slice(array({parts}), 1, {check}) END"))
                i = end
            else:
                out.append(t)
                i += 1
        return out

    def _graph_aggregate(self, tokens: list[dialect.Token]) -> DataFrame | None:
        """The result of ``SELECT graph_f(source, target, ...) [AS name] FROM ...``, or None for other statements."""
        t = dialect.solid(tokens)
        if len(t) < 4 or not t[0] == "SELECT" or t[1].text.lower() not in GRAPH_AGGREGATES or not t[2] == "(":
            return None
        f, end = t[1].text.lower(), dialect._operand_end(t, 2)
        parts, name, at = dialect.split(t[3 : end - 1]), f, end
        if t[at] == "AS":
            name, at = dialect.unquoted(t[at + 1]), at + 2
        if not t[at] == "FROM":
            return None
        literal = [len(p) <= 2 and p[-1].kind in ("string", "number") or p[0].text.upper() in ("TRUE", "FALSE", "ARRAY") or p[0].text.lower() in ("make_array", "array") for p in parts]
        columns = ["source", "target", "c3", "c4", "c5"][: literal.index(True) if True in literal else len(parts)]
        chosen = ", ".join(f"{dialect.joined(p)} AS {c}" for p, c in zip(parts, columns, strict=False))
        rows = self.query(dialect.Statement(dialect.tokenize(f"SELECT {chosen} ") + t[at:]))
        args = [self._graph_argument(p) for p in parts[len(columns) :]]
        out = self._run_graph_aggregate(f, rows, columns, args)
        if f in ("graph_shortest_path", "graph_jaccard_coefficient", "graph_preferential_attachment", "graph_triangle_count", "graph_modularity"):
            return out.toDF(name)
        item = F.col(out.columns[0]) if len(out.columns) == 1 else F.struct(*out.columns)
        return out.agg(F.sort_array(F.collect_list(item)).alias(name))

    @staticmethod
    def _graph_argument(part: list[dialect.Token]) -> Any:
        if part[0].text.lower() in ("array", "make_array"):
            return dialect.arguments(part[2:-1])
        return dialect.arguments(part)[0]

    @staticmethod
    def _run_graph_aggregate(f: str, rows: DataFrame, columns: list[str], args: list) -> DataFrame:
        if f == "graph_modularity":
            if len(columns) == 3:  # weight, communities of both ends
                return graph.modularity(rows.toDF("w", "source_community", "target_community"), weight="w")
            named = rows.toDF(*(["source", "target", "source_community", "target_community"] if len(columns) == 4 else ["source", "target", "w", "source_community", "target_community"]))
            return graph.modularity(named, weight="w" if len(columns) == 5 else None)
        edges = graph.edge_table(rows, weight="c3" if len(columns) > 2 else None)
        seeds = lambda x: x if isinstance(x, list) else [int(v) for v in str(x).split(",")]
        get = lambda i, default: args[i] if len(args) > i and args[i] is not None else default
        path = lambda df: df.agg(F.when(F.count("*") > 0, F.transform(F.sort_array(F.collect_list(F.struct("hop", "node"))), lambda s: s["node"])).alias("path"))
        calls = {
            "graph_pagerank": lambda: graph.pagerank(edges, float(get(0, 0.85)), int(get(1, 30))),
            "graph_personalized_pagerank": lambda: graph.personalized_pagerank(edges, seeds(args[0]), float(get(1, 0.85)), int(get(2, 30)), bool(get(3, False)), get(4, None)),
            "graph_label_propagation": lambda: graph.label_propagation(edges, int(get(0, 10))),
            "graph_neighbors": lambda: graph.neighbors(edges, int(args[0]), int(get(1, 1))),
            "graph_subgraph": lambda: graph.subgraph(edges, seeds(args[0]), int(get(1, 1)), bool(get(2, True))),
            "graph_connecting_paths": lambda: graph.connecting_paths(edges, seeds(args[0]), bool(get(1, True))),
            "graph_shortest_path": lambda: path(graph.shortest_path(edges, int(args[0]), int(args[1]))),
            "graph_all_shortest_paths": lambda: graph.all_shortest_paths(edges, int(args[0]), int(args[1])),
            "graph_connected_components": lambda: graph.connected_components(edges),
            "graph_strongly_connected_components": lambda: graph.strongly_connected_components(edges),
            "graph_degree_centrality": lambda: graph.degrees(edges),
            "graph_closeness_centrality": lambda: graph.closeness(edges),
            "graph_betweenness_centrality": lambda: graph.betweenness(edges),
            "graph_jaccard_coefficient": lambda: graph.jaccard(edges, int(args[0]), int(args[1]), directed=True),
            "graph_preferential_attachment": lambda: graph.preferential_attachment(edges, int(args[0]), int(args[1])),
            "graph_triangle_count": lambda: graph.triangle_count(edges),
            "graph_louvain_communities": lambda: graph.louvain(edges, "weight" if len(columns) > 2 else None, float(get(0, 1.0))),
            "graph_leiden_communities": lambda: graph.leiden(edges, "weight" if len(columns) > 2 else None, float(get(0, 1.0))),
            "drift_search": lambda: drift_search(edges, seeds(args[1]) if len(args) > 1 else None, DriftSettings(n_depth=int(get(2, 2)))),
            "regional_drift": lambda: regional_drift(edges, seeds(args[1]), int(get(2, 1)), DriftSettings(n_depth=int(get(3, 1)))),
        }
        return calls[f]()

    def sql(self, text: str, **args: Any) -> DataFrame:
        """One statement. Queries are lazy; commands run at once and return a row about what they did."""
        s = dialect.statement(text)
        done = commands.run(self, s)
        if done is None:
            done = self._graph_aggregate(s.tokens)
        if done is not None:
            return done
        return self.query(s, **args)

    def query(self, s: dialect.Statement, **args: Any) -> DataFrame:
        names = s.names() | {".".join(x) for x in itertools.pairwise([dialect.unquoted(t) for t in s.tokens if t.kind in ("word", "quoted")])}
        for n in names:
            if n not in self.tables and re.fullmatch(r"[\w.]+", n) and n.lower() not in ("select", "from", "where") and n in self.known():
                self.table(n)
        tokens = dialect.rewrite_vectors(s.tokens, self._vector_columns(names))
        tokens = dialect.rewrite_names(tokens)
        tokens = dialect.rewrite_table_functions(tokens, GRAPH_FUNCTIONS, self._graph_function)
        tokens = self._element_wise(tokens, self._vector_columns(names))
        tokens = self._versions(dialect.expand(tokens, self.macros))
        for n in names & set(self.tables):
            if "." not in n:
                self.df(n).createOrReplaceTempView(n)
            else:
                tokens = self._qualified(tokens, n)
        if "information_schema" in {x.lower() for x in names}:
            tokens = self._information_schema(tokens)
        return self.spark.sql(dialect.joined(tokens), **args)

    def known(self) -> set[str]:
        """Names of the tables in the warehouse, with their schema if it is not the default one."""
        store = Storage(self.spark, self.warehouse)
        out = set()
        for n in store.names(""):
            if store.exists(f"{n}/_log"):
                out.add(n)
            else:
                out |= {f"{n}.{m}" for m in store.names(n) if store.exists(f"{n}/{m}/_log")}
        return out

    def _qualified(self, tokens: list[dialect.Token], name: str) -> list[dialect.Token]:
        a, b = name.split(".", 1)
        out, i = [], 0
        while i < len(tokens):
            if i + 2 < len(tokens) and dialect.unquoted(tokens[i]) == a and tokens[i + 1] == "." and dialect.unquoted(tokens[i + 2]) == b:
                out.append(dialect.Token("word", self.view(self.df(name), name)))
                i += 3
            else:
                out.append(tokens[i])
                i += 1
        return out

    def _versions(self, tokens: list[dialect.Token]) -> list[dialect.Token]:
        """``t VERSION AS OF n`` and ``t TIMESTAMP AS OF '...'`` as views of those snapshots."""
        out: list[dialect.Token] = []
        i = 0
        while i < len(tokens):
            t = tokens
            if out and i + 3 < len(t) and (t[i] == "VERSION" or t[i] == "TIMESTAMP") and t[i + 1] == "AS" and t[i + 2] == "OF":
                name = dialect.unquoted(out.pop())
                if t[i] == "VERSION":
                    rows = self.table(name).df(version=int(t[i + 3].text))
                else:
                    import datetime

                    rows = self.table(name).df(timestamp=datetime.datetime.fromisoformat(dialect.string_value(t[i + 3])).timestamp())
                out.append(dialect.Token("word", self.view(rows, name)))
                i += 4
            else:
                out.append(t[i])
                i += 1
        return out

    def _information_schema(self, tokens: list[dialect.Token]) -> list[dialect.Token]:
        rows = [(n.rpartition(".")[0] or "default", n.rpartition(".")[2], f.name, i + 1, f.dataType.simpleString()) for n in sorted(set(self.tables) | self.known()) for i, f in enumerate(self.df(n).schema.fields)]
        columns = self.spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string")
        views = {"tables": self.view(columns.select("table_schema", "table_name").distinct(), "tables"), "columns": self.view(columns, "columns")}
        out, i = [], 0
        while i < len(tokens):
            if tokens[i].text.lower() == "information_schema" and i + 2 < len(tokens) and tokens[i + 1] == ".":
                out.append(dialect.Token("word", views[tokens[i + 2].text.lower()]))
                i += 3
            else:
                out.append(tokens[i])
                i += 1
        return out

    def row(self, **values: Any) -> DataFrame:
        kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
        return self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))

    def sql_multi(self, tables: Mapping[str, Table | DataFrame | str], text: str) -> DataFrame:
        """A query over tables under aliases that hold for this query only."""
        before = dict(self.tables)
        try:
            for alias, source in tables.items():
                self.register(alias, source)
            return self.sql(text)
        finally:
            self.tables = before

    def search(self, name: str, id_col: str | None = None) -> Search:
        """A search over a table by name, to be put together step by step."""
        source = self.tables.get(name)
        source = source if isinstance(source, DataFrame) else self.table(name)
        key = id_col or (source.columns[0] if isinstance(source, DataFrame) else (source.state["primary_key"] or source.columns)[0])
        return Search(source, key)

    def hybrid_search(self, name: str, text_col: str, query: str, vector_col: str, vector: Sequence[float], k: int = 10, metric: str = "l2", where: str | None = None, id_col: str | None = None) -> DataFrame:
        """Rows of a table by text and vector together, fused by reciprocal ranks."""
        s = self.search(name, id_col)
        s = s.where(where) if where else s
        return s.text(text_col, query).vector(vector_col, vector, metric).limit(k).df()

    def list_graph_tables(self) -> list[str]:
        out = []
        for n in sorted(set(self.tables) | self.known()):
            cols = set(self.df(n).columns)
            if cols & set(graph.edges.SOURCE_NAMES) and cols & set(graph.edges.TARGET_NAMES):
                out.append(n)
        return out
