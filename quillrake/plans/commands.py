"""Statements that are not queries: definitions, changes of rows, maintenance and settings."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillrake.sources.table import Table

from . import dialect
from .dialect import SqlError, Statement, Token, joined, split, unquoted

if TYPE_CHECKING:
    from quillrake.session import Engine

#: Names of column types in definitions that Spark spells otherwise; fixed values.
DDL_TYPES = {"INT64": "BIGINT", "INT32": "INT", "INTEGER": "INT", "FLOAT4": "FLOAT", "FLOAT8": "DOUBLE", "REAL": "FLOAT", "TEXT": "STRING", "VARCHAR": "STRING", "BYTEA": "BINARY", "TIMESTAMPTZ": "TIMESTAMP", "DATETIME": "TIMESTAMP_NTZ", "BOOL": "BOOLEAN", "UUID": "STRING", "NUMERIC": "DECIMAL"}
#: Names of maintenance actions, statements and index kinds; fixed values.
ACTIONS = ("remove_orphan_files", "recover_indexes", "rollback", "rollback_to_snapshot", "preload_indexes", "verify_integrity", "checkpoint", "rewrite_data_files", "compact", "expire_snapshots", "rebuild_cluster_index", "warmup", "cluster", "statistics")
STATEMENTS = ("CREATE DATABASE", "CREATE SCHEMA", "CREATE TABLE", "CREATE INDEX", "DROP TABLE", "DROP SCHEMA", "DROP DATABASE", "ALTER TABLE", "OPTIMIZE TABLE", "TRUNCATE TABLE", "VACUUM")
INDEX_KINDS = {
    "hnsw": "ivf", "hnsw_pq": "ivf", "hnsw_tq4": "ivf", "hnsw_tq8": "ivf", "hnsw_sq8": "ivf", "ivfflat": "ivf", "ivf": "ivf",
    "bm25": "bm25", "fulltext": "bm25", "bloom": "bloom", "bitmap": "bitmap", "composite_bitmap": "composite", "inverted": "inverted", "csr_graph": "graph", "json_path": "json",
}


class Reader:
    """A cursor over the tokens of a statement."""

    def __init__(self, tokens: list[Token]) -> None:
        self.t, self.i = tokens, 0

    def more(self) -> bool:
        return self.i < len(self.t)

    def take(self, *words: str) -> bool:
        """Whether the next tokens are these words; moves on if so."""
        here = self.t[self.i : self.i + len(words)]
        if len(here) == len(words) and all(a == b for a, b in zip(here, words, strict=True)):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SqlError(f"{' '.join(words)} is expected before {joined(self.t[self.i : self.i + 5])!r}")

    def next(self) -> Token:
        if not self.more():
            raise SqlError("the statement ends too soon")
        self.i += 1
        return self.t[self.i - 1]

    def name(self) -> str:
        out = unquoted(self.next())
        while self.take("."):
            out += "." + unquoted(self.next())
        return out

    def brackets(self) -> list[Token]:
        self.need("(")
        end = dialect._operand_end(self.t, self.i - 1)
        inner, self.i = self.t[self.i : end - 1], end
        return inner

    def rest(self) -> list[Token]:
        out, self.i = self.t[self.i :], len(self.t)
        return out

    def until(self, *words: str) -> list[Token]:
        """Tokens up to one of the words outside of brackets and CASE."""
        start, depth, cases = self.i, 0, 0
        while self.more():
            t = self.t[self.i]
            if depth == 0 and cases == 0 and any(t == w for w in words):
                break
            depth += (t.kind == "op") * ((t.text in "([") - (t.text in ")]"))
            cases += (t == "CASE") - (t == "END" and cases > 0)
            self.i += 1
        return self.t[start : self.i]


def parse_type(tokens: list[Token]) -> T.DataType:
    text = joined(tokens)
    if m := re.fullmatch(r"(?i)(?:vector|halfvec)\s*(?:\(\s*\d+\s*\))?", text):
        return T.ArrayType(T.FloatType())
    if m := re.fullmatch(r"(.*)\[\s*\]", text):
        return T.ArrayType(parse_type(dialect.solid(dialect.tokenize(m[1]))))
    base = re.match(r"\w+", text)
    if base and base[0].upper() in DDL_TYPES:
        text = DDL_TYPES[base[0].upper()] + ("" if base[0].upper() in ("VARCHAR", "TEXT") else text[base.end() :])
    try:
        return T._parse_datatype_string(text)
    except Exception:
        raise SqlError(f"unknown type {text!r}") from None


def _assignments(tokens: list[Token]) -> dict[str, str]:
    out = {}
    for part in split(tokens):
        at = next(i for i, t in enumerate(part) if t == "=")
        out[unquoted(part[at - 1])] = joined(part[at + 1 :])
    return out


def _options(tokens: list[Token]) -> dict[str, object]:
    out: dict[str, object] = {}
    for part in split(tokens):
        at = next(i for i, t in enumerate(part) if t == "=")
        key = "".join(dialect.string_value(t) if t.kind == "string" else unquoted(t) for t in part[:at])
        v = part[at + 1 :]
        out[key] = dialect.arguments(v)[0] if len(v) <= 2 else joined(v)
    return out


def run(engine: Engine, s: Statement) -> DataFrame | None:
    """The result of a command, or None if the statement is a query."""
    r = Reader(dialect.rewrite_names(dialect.solid(s.tokens)))
    if r.take("CREATE"):
        return _create(engine, s, r)
    if r.take("DROP"):
        return _drop(engine, r)
    if r.take("ALTER", "TABLE"):
        return _alter(engine, r)
    if r.take("INSERT"):
        over = r.take("OVERWRITE")
        over or r.need("INTO")
        r.take("TABLE")
        name = r.name()
        t = engine.writable(name)
        columns = [unquoted(c[0]) for c in split(r.brackets())] if r.more() and r.t[r.i] == "(" and not (r.i + 1 < len(r.t) and r.t[r.i + 1] == "SELECT") else t.columns
        rows = engine.query(Statement(r.rest())).toDF(*columns)
        before = t.row_count()
        (t.overwrite if over else t.append)(rows)
        return engine.row(count=t.row_count() - (0 if over else before))
    if r.take("DELETE", "FROM"):
        t = engine.writable(r.name())
        return engine.row(count=t.delete(joined(r.rest()) if r.take("WHERE") else None))
    if r.take("UPDATE"):
        t = engine.writable(r.name())
        r.need("SET")
        values = _assignments(r.until("WHERE"))
        return engine.row(count=t.update(values, joined(r.rest()) if r.take("WHERE") else None))
    if r.take("TRUNCATE"):
        r.take("TABLE")
        t = engine.writable(r.name())
        n = t.row_count()
        t.truncate()
        return engine.row(count=n)
    if r.take("MERGE", "INTO"):
        return _merge(engine, r)
    if r.take("SET"):
        return _set(engine, r)
    if r.take("SHOW"):
        return _show(engine, r)
    if r.take("DESCRIBE") or r.take("DESC"):
        r.take("TABLE")
        rows = [(f.name, f.dataType.simpleString()) for f in engine.df(r.name()).schema.fields]
        return engine.spark.createDataFrame(rows, "col_name string, data_type string")
    if r.take("COMPACT") or r.take("OPTIMIZE"):
        r.take("TABLE")
        t = engine.writable(r.name())
        if r.take("ZORDER", "BY"):
            return engine.row(version=t.cluster([unquoted(c[-1]) for c in split(r.brackets() if r.t[r.i] == "(" else r.rest())]))
        return engine.row(version=t.compact())
    if r.take("VACUUM"):
        t = engine.writable(r.name())
        hours = float(r.next().text) if r.take("RETAIN") else 168.0
        return engine.row(files_deleted=len(t.vacuum(hours * 3600)))
    if r.take("MSCK", "REPAIR"):
        r.take("TABLE")
        return engine.row(problems=len(engine.table(r.name()).verify()))
    if r.take("EXPLAIN"):
        plan = engine.query(Statement(r.rest()))
        return engine.row(plan=plan._jdf.queryExecution().toString())
    return None


def _create(engine: Engine, s: Statement, r: Reader) -> DataFrame:
    replace = r.take("OR", "REPLACE")
    if r.take("SCHEMA") or r.take("DATABASE"):
        r.take("IF", "NOT", "EXISTS")
        engine.create_schema(name := r.name())
        return engine.row(created=name)
    if r.take("TEMPORARY", "VIEW") or r.take("TEMP", "VIEW") or r.take("VIEW"):
        name = r.name()
        r.need("AS")
        engine.tables[name] = engine.query(Statement(r.rest()))
        return engine.row(created=name)
    if r.take("INDEX"):
        r.take("IF", "NOT", "EXISTS")
        name = r.name()
        r.need("ON")
        t = engine.writable(r.name())
        kind = str(engine.settings["default_index_algorithm"])
        if r.take("USING"):
            kind = r.next().text.lower()
        columns = [unquoted(c[0]) for c in split(r.brackets())]
        if r.take("USING"):
            kind = r.next().text.lower()
        if kind not in INDEX_KINDS:
            raise SqlError(f"unknown index kind {kind!r}; known are {sorted(INDEX_KINDS)}")
        options = _options(r.brackets()) if r.take("WITH") else {}
        return engine.row(version=t.create_index(name, INDEX_KINDS[kind], ",".join(columns), **options))
    r.need("TABLE")
    quiet = r.take("IF", "NOT", "EXISTS")
    name = r.name()
    if Table.exists(engine.spark, engine.location(name)):
        if quiet:
            return engine.row(created=name)
        if not replace:
            raise SqlError(f"there is a table {name!r}")
        engine.table(name).storage.delete("")
    fields, key, required = [], [], []
    if r.more() and r.t[r.i] == "(":
        for part in split(r.brackets()):
            if part[0] == "PRIMARY":
                key = [unquoted(c[0]) for c in split(part[3:-1])]
                continue
            words = [t.text.upper() for t in part]
            end = min([i for i, w in enumerate(words) if w in ("NOT", "NULL", "PRIMARY", "DEFAULT", "COMMENT") and i > 0] or [len(part)])
            column = unquoted(part[0])
            if "PRIMARY" in words:
                key = [column]
            if "NOT" in words:
                required.append(column)
            fields.append(T.StructField(column, parse_type(part[1:end]), "NOT" not in words))
    spec: list[tuple[str, str]] = []
    properties: dict[str, object] = {}
    while r.more() and not r.take("AS"):
        if r.take("USING"):
            r.next()
        elif r.take("PARTITIONED", "BY") or r.take("PARTITION", "BY"):
            spec = [_transform(p) for p in split(r.brackets())]
        elif r.take("TBLPROPERTIES") or r.take("OPTIONS") or r.take("WITH"):
            properties |= _options(r.brackets())
        else:
            raise SqlError(f"unexpected {joined(r.rest())!r}")
    rows = engine.query(Statement(r.rest())) if r.more() else None
    schema = T.StructType(fields) if fields else rows.schema
    t = Table.create(engine.spark, engine.location(name), schema, spec, key, properties)
    engine.tables[name] = t
    if rows is not None:
        t.append(rows.toDF(*t.columns))
    return engine.row(created=name)


def _transform(part: list[Token]) -> tuple[str, str]:
    if len(part) == 1:
        return unquoted(part[0]), "identity"
    how, args = part[0].text.lower().removesuffix("s"), split(part[2:-1])
    numbers = [a[0].text for a in args if a[0].kind == "number"]
    column = next(unquoted(a[0]) for a in args if a[0].kind != "number")
    return column, f"{how}[{numbers[0]}]" if numbers else how


def _drop(engine: Engine, r: Reader) -> DataFrame:
    if r.take("SCHEMA") or r.take("DATABASE"):
        quiet = r.take("IF", "EXISTS")
        name = r.name()
        if name not in engine.schemas and not quiet:
            raise SqlError(f"no schema {name!r}")
        engine.drop_schema(name)
        return engine.row(dropped=name)
    if r.take("INDEX"):
        r.take("IF", "EXISTS")
        name = r.name()
        r.need("ON")
        return engine.row(version=engine.writable(r.name()).drop_index(name))
    r.take("TABLE") or r.need("VIEW")
    quiet = r.take("IF", "EXISTS")
    name = r.name()
    if name in engine.tables and not isinstance(engine.tables[name], Table):
        del engine.tables[name]
        return engine.row(dropped=name)
    if not Table.exists(engine.spark, engine.location(name)):
        if not quiet:
            raise SqlError(f"no table {name!r}")
        return engine.row(dropped=name)
    engine.writable(name).storage.delete("")
    engine.tables.pop(name, None)
    return engine.row(dropped=name)


def _alter(engine: Engine, r: Reader) -> DataFrame:
    t = engine.writable(r.name())
    if r.take("ADD", "PRIMARY", "KEY"):
        v = t.set_primary_key([unquoted(c[0]) for c in split(r.brackets())])
    elif r.take("DROP", "PRIMARY", "KEY"):
        v = t.set_primary_key([])
    elif r.take("DROP", "INDEX"):
        v = t.drop_index(r.name())
    elif r.take("ADD"):
        r.take("COLUMN")
        name = r.name()
        kind = parse_type(r.until("DEFAULT", "AFTER", "FIRST"))
        default = dialect.arguments(r.until("AFTER", "FIRST"))[0] if r.take("DEFAULT") else None
        after = r.name() if r.take("AFTER") else None
        v = t.add_column(name, kind, default, after, r.take("FIRST"))
    elif r.take("DROP"):
        r.take("COLUMN")
        v = t.drop_column(r.name())
    elif r.take("RENAME"):
        r.take("COLUMN")
        old = r.name()
        r.need("TO")
        v = t.rename_column(old, r.name())
    elif r.take("ALTER"):
        r.take("COLUMN")
        name = r.name()
        if r.take("SET", "NOT", "NULL"):
            v = t.set_not_null(name)
        elif r.take("DROP", "NOT", "NULL"):
            v = t.set_not_null(name, False)
        elif r.take("AFTER"):
            v = t.move_column(name, r.name())
        elif r.take("FIRST"):
            v = t.move_column(name, first=True)
        else:
            r.take("SET", "DATA")
            r.need("TYPE")
            v = t.change_type(name, parse_type(r.rest()).simpleString())
    elif r.take("SET", "TBLPROPERTIES"):
        v = t.set_properties(_options(r.brackets()))
    elif r.take("SET", "PARTITIONED", "BY"):
        v = t.set_partitioning([_transform(p) for p in split(r.brackets())])
    elif r.take("WRITE", "ORDERED", "BY"):
        v = t.set_sort_order([unquoted(c[0]) for c in split(r.rest())])
    elif r.take("EXECUTE"):
        return _execute(engine, t, r)
    else:
        raise SqlError(f"unknown change {joined(r.rest())!r}")
    return engine.row(version=v)


def _action_arguments(tokens: list[Token], names: tuple[str, ...]) -> dict[str, object]:
    """Arguments by place or as ``name => value``."""
    out: dict[str, object] = {}
    for i, part in enumerate(split(tokens)):
        if len(part) > 2 and part[1] == "=":
            out[unquoted(part[0]).lower()] = dialect.arguments(part[3:] if part[2] == ">" else part[2:])[0]
        elif i < len(names):
            out[names[i]] = dialect.arguments(part)[0]
        else:
            raise SqlError("too many arguments")
    return out


def _execute(engine: Engine, t: Table, r: Reader) -> DataFrame:
    action = r.next().text.lower()
    names = {"rewrite_data_files": ("target_bytes",), "compact": ("target_bytes",), "expire_snapshots": ("retention",), "remove_orphan_files": ("older_than_ms",), "rollback": ("snapshot_id",), "rollback_to_snapshot": ("snapshot_id",), "cluster": ("columns", "curve"), "rebuild_cluster_index": ("column", "k")}
    args = _action_arguments(r.brackets(), names.get(action, ())) if r.more() else {}
    if action in ("compact", "rewrite_data_files"):
        return engine.row(version=t.compact(*([int(args["target_bytes"])] if "target_bytes" in args else [])))
    if action == "expire_snapshots":
        return engine.row(expired=len(t.expire(int(args.get("retention", 1)))))
    if action == "remove_orphan_files":
        return engine.row(files_deleted=len(t.vacuum(float(args.get("older_than_ms", 7 * 86_400_000)) / 1000)))
    if action in ("rollback", "rollback_to_snapshot"):
        if "snapshot_id" not in args:
            raise SqlError(f"{action} needs a snapshot id")
        return engine.row(version=t.rollback(int(args["snapshot_id"])))
    if action == "cluster":
        return engine.row(version=t.cluster(str(args["columns"]).split(","), str(args.get("curve", "z-order"))))
    if action == "verify_integrity":
        return engine.row(problems=len(t.verify()))
    if action == "statistics":
        return engine.row(**t.statistics())
    if action in ("warmup", "preload_indexes"):
        return engine.row(rows=t.df().cache().count())
    if action == "checkpoint":
        return engine.row(version=t.version)
    if action == "recover_indexes":
        stale = [(n, e) for n, e in t.state["indexes"].items() if t.index(n) is None]
        for n, e in stale:
            t.create_index(n, e["kind"], e["column"], id_col=e["id_col"], **({} if e["kind"] == "ivf" else e["options"]))
        return engine.row(rebuilt=len(stale))
    if action == "rebuild_cluster_index":
        column = str(args.get("column", "embedding"))
        return engine.row(version=t.create_index(f"{column}_cells", "ivf", column, cells=int(args.get("k", 64))))
    raise SqlError(f"unknown action {action!r}; known are {ACTIONS}")


def _merge(engine: Engine, r: Reader) -> DataFrame:
    name = r.name()
    t = engine.writable(name)
    r.take("AS")
    target = r.name() if not (r.t[r.i] == "USING") else name
    r.need("USING")
    if r.t[r.i] == "(":
        source = engine.query(Statement(r.brackets()))
        alias = "s"
    else:
        alias = r.name()
        source = engine.df(alias)
    r.take("AS")
    if not (r.t[r.i] == "ON"):
        alias = r.name()
    r.need("ON")
    sides = {target: "t", name: "t", alias: "s"}

    def sided(tokens: list[Token]) -> str:
        return joined([Token("word", sides[unquoted(x)]) if x.kind in ("word", "quoted") and unquoted(x) in sides and i + 1 < len(tokens) and tokens[i + 1] == "." else x for i, x in enumerate(tokens)])

    on: dict[str, str] = {}
    for part in _split_and(r.until("WHEN")):
        part = part[1:-1] if part and part[0] == "(" else part
        if len(part) != 7 or not part[3] == "=":
            raise SqlError("MERGE matches on equal columns: t.a = s.a AND ...")
        (a, b), (c, d) = (unquoted(part[0]), unquoted(part[2])), (unquoted(part[4]), unquoted(part[6]))
        if sides.get(a) == "s":
            b, d = d, b
        on[b] = d
    matched, inserts, by_source = [], [], []
    while r.take("WHEN"):
        negated = r.take("NOT")
        r.need("MATCHED")
        from_source = negated and r.take("BY", "SOURCE")
        negated and not from_source and r.take("BY", "TARGET")
        cond = sided(r.until("THEN")) if r.take("AND") else None
        r.need("THEN")
        if r.take("DELETE"):
            (by_source if from_source else matched).append((cond, "delete", None))
        elif r.take("UPDATE"):
            r.need("SET")
            body = r.until("WHEN")
            values = None if joined(body) == "*" else {k: v for k, v in ((unquoted(p[next(i for i, x in enumerate(p) if x == "=") - 1]), sided(p[next(i for i, x in enumerate(p) if x == "=") + 1 :])) for p in split(body))}
            (by_source if from_source else matched).append((cond, "update", values))
        else:
            r.need("INSERT")
            if r.take("*") or r.take("ROW"):
                inserts.append((cond, None))
            else:
                columns = [unquoted(c[0]) for c in split(r.brackets())] if r.t[r.i] == "(" else t.columns
                r.need("VALUES")
                inserts.append((cond, dict(zip(columns, (sided(v) for v in split(r.brackets())), strict=True))))
    if r.more():
        raise SqlError(f"unexpected {joined(r.rest())!r}")
    return engine.row(rows_affected=sum(t.merge(source, on, matched, inserts, by_source).values()))


def _split_and(tokens: list[Token]) -> list[list[Token]]:
    return split(tokens, "AND")


def _set(engine: Engine, r: Reader) -> DataFrame:
    key = unquoted(r.next())
    while r.take("."):
        key += "." + unquoted(r.next())
    r.take("=") or r.need("TO")
    value = r.rest()
    if key not in engine.settings:
        if key.startswith("spark."):
            engine.spark.conf.set(key, joined(value))
            return engine.row(key=key, value=joined(value))
        raise SqlError(f"unknown setting {key!r}; known are {sorted(engine.settings)}")
    engine.settings[key] = dialect.arguments(value)[0]
    return engine.row(key=key, value=str(engine.settings[key]))


def _show(engine: Engine, r: Reader) -> DataFrame:
    if r.take("TABLES"):
        return engine.spark.createDataFrame([(n,) for n in sorted(set(engine.tables) | engine.known())], "table_name string")
    if r.take("SCHEMAS") or r.take("DATABASES"):
        return engine.spark.createDataFrame([(n,) for n in sorted(engine.schemas)], "schema_name string")
    if r.take("SNAPSHOTS") or r.take("HISTORY"):
        r.take("FROM") or r.take("OF")
        rows = [(h["version"], h["operation"], h["rows"], h["files"]) for h in engine.table(r.name()).history()]
        return engine.spark.createDataFrame(rows, "version long, operation string, rows long, files long")
    if r.take("INDEXES"):
        r.take("FROM") or r.take("ON")
        t = engine.table(r.name())
        rows = [(n, e["kind"], e["column"], t.index(n) is not None) for n, e in sorted(t.state["indexes"].items())]
        return engine.spark.createDataFrame(rows, "name string, kind string, column string, fresh boolean")
    key = joined(r.rest()).lower()
    if key == "all":
        return engine.spark.createDataFrame([(k, str(v)) for k, v in sorted(engine.settings.items())], "key string, value string")
    if key not in engine.settings:
        raise SqlError(f"unknown setting {key!r}")
    return engine.row(key=key, value=str(engine.settings[key]))


__all__ = ["ACTIONS", "Reader", "parse_type", "run"]
