"""The engine: statements of the dialect over Spark.

DQL becomes one Spark SQL text and a lazy DataFrame. DML makes a table's next state in the shared folder. The engine
works in a session of its own (its views, its time zone and its case rules are no one else's), on the context of the
session that it is given.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .errors import NotSupported, QueryError
from .functions.bucket import BUCKETS, bucket_id
from .operators import dml, relational
from .plans import nodes as n
from .plans.emit import BUCKET, SPARK, Column, Emitter, Source, quoted
from .plans.parser import parse
from .sources.catalog import MOST_PARTS, Catalog, Table
from .sources.storage import read_table, settled

CONFS = {"spark.sql.ansi.enabled": "true", "spark.sql.caseSensitive": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
#: Settings of the given session that hold here, too.
INHERITED = ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes")


@dataclass
class Result:
    """Rows and their metadata, or the number of changed rows."""

    df: DataFrame | None = None
    row_count: int | None = None
    metadata: list[dict[str, str]] = field(default_factory=list)

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()] if self.df is not None else []


class Engine:
    def __init__(self, spark: SparkSession, *, buckets: int = BUCKETS) -> None:
        self.spark = spark.newSession()
        for name in INHERITED:
            if (value := spark.conf.get(name, None)) is not None:
                self.spark.conf.set(name, value)
        for name, value in CONFS.items():
            self.spark.conf.set(name, value)
        self.catalog, self.buckets = Catalog(), buckets
        self._paths: dict[str, tuple[str, dict, DataFrame]] = {}

    # tables and functions

    def register(self, name: str, frame: DataFrame, **keys) -> Table:
        """A DataFrame of this engine's session as a table; keys: primary_key, shard_key, columns."""
        return self.catalog.put(name, frame, **keys)

    def read(self, name: str, path: str, **keys) -> Table:
        """A Parquet path as a table."""
        found = self.register(name, read_table(self.spark, path), **keys)
        self._paths[name] = (path, keys, found.frame)
        return found

    def refresh(self, name: str | None = None) -> None:
        """Reads a table's path anew, columns included, after files there have changed; without a name, all such tables.

        A table that was changed by statements here, or was made from a DataFrame, has no files elsewhere to follow.
        """
        own = {k for k, (_, _, frame) in self._paths.items() if self.catalog.has(k) and self.catalog.table(k).frame is frame}
        if name is not None and name not in own:
            raise QueryError(f"{self.catalog.table(name).name!r} doesn't follow a path")
        for k in own if name is None else (name,):
            path, keys, _ = self._paths[k]
            unique = self.catalog.table(k).unique
            self.spark.catalog.refreshByPath(path)
            self.read(k, path, **keys).unique.update(unique)

    def register_function(self, name: str, function: Any, returns: str) -> None:
        """A stable scalar function: the name of a function of Spark, or a UDF; returns: a type of the dialect."""
        if isinstance(function, str):
            self.catalog.functions[name] = (function, returns)
        else:
            self.spark.udf.register(f"__{name}", function)
            self.catalog.functions[name] = (f"__{name}", returns)

    def statistics(self, name: str) -> DataFrame:
        t = self.catalog.table(name)
        return relational.statistics(t.frame, [c for c, kind, _ in t.columns if kind not in ("array", "map", "any")])

    def calculate_bucket_id(self, value: Any, space: str | None = None) -> int:
        """Of a text, a tuple in the order of a table's columns, or a mapping by column."""
        if isinstance(value, str):
            return bucket_id(value, self.buckets)
        if space is None:
            raise QueryError("a tuple or a mapping needs the name of its table")
        t = self.catalog.table(space)
        if not isinstance(value, dict):
            if len(value) != len(t.columns):
                raise QueryError(f"{space!r} has {len(t.columns)} columns")
            value = {c: v for (c, _, _), v in zip(t.columns, value, strict=True)}
        missing = [c for c in t.shard_key or () if c not in value]
        if missing:
            raise QueryError(f"the key of {space!r} needs {', '.join(missing)}")
        return bucket_id([value[c] for c in t.shard_key or ()], self.buckets)

    # statements

    def sql(self, text: str, params: tuple | list = ()) -> DataFrame:
        """The rows of a query."""
        out = self.execute(text, params)
        if out.df is None:
            raise QueryError("this statement has no rows")
        return out.df

    def to_spark(self, text: str, params: tuple | list = ()) -> str:
        """What a query is to Spark."""
        statement, _ = parse(text)
        if not isinstance(statement, n.Dql):
            raise QueryError("only a query has a Spark text")
        return self._emitter(params).query(statement.query)[0]

    def parameter_types(self, text: str) -> list[str]:
        """The types that $n parameters are used as; 'scalar' where nothing tells."""
        statement, count = parse(text)
        emitter = self._emitter((None,) * count)
        if isinstance(statement, n.Dql):
            emitter.query(statement.query)
        elif isinstance(statement, (n.Insert, n.Update, n.Delete)):
            t = self.catalog.table(statement.table)
            kinds = {c: k for c, k, _ in t.columns}
            if isinstance(statement, n.Insert):  # a bare parameter is of its column's type
                for values in emitter.bare_rows(statement.query):
                    emitter.want(values, [kinds[c] for c in statement.columns or kinds if c in kinds])
            elif isinstance(statement, n.Update):
                emitter.want([e for _, e in statement.sets], [kinds.get(c, "scalar") for c, _ in statement.sets])
            self._source_text(statement, emitter)
        return [emitter.wanted.get(i + 1, "scalar") for i in range(count)]

    def explain(self, text: str, params: tuple | list = ()) -> str:
        out = self.sql(text if text.strip()[:7].lower() == "explain" else f"EXPLAIN {text}", params)
        return "\n".join(r[0] for r in out.collect())

    def execute(self, text: str, params: tuple | list = ()) -> Result:
        statement, count = parse(text)
        if len(params) < count:
            raise QueryError(f"{count} parameters are needed, {len(params)} given")
        params = tuple(params)
        options = {k: params[v.number - 1] if isinstance(v, n.Param) else v for k, v in statement.options}
        for name, value in options.items():
            if not isinstance(value, int) or isinstance(value, bool) or value < 0:
                raise QueryError(f"{name} takes a whole number")
        try:
            return self._run(statement, params, options)
        except AnalysisException as e:
            raise QueryError(str(e).partition("\n")[0]) from e

    def _run(self, s: n.Statement, params: tuple, options: dict[str, int]) -> Result:
        match s:
            case n.Empty():
                return Result(self.spark.createDataFrame([], StructType([])))
            case n.Dql():
                return self._dql(s, params, options)
            case n.Insert() | n.Update() | n.Delete():
                run = {n.Insert: self._insert, n.Update: self._update, n.Delete: self._delete}[type(s)]
                if s.explain:
                    emitter = self._emitter(params)
                    plan = self._frame(emitter, f"EXPLAIN FORMATTED {self._source_text(s, emitter)}").head()[0]
                    return Result(self.spark.createDataFrame([(f"{type(s).__name__} {s.table}\n{plan}",)], "plan string"), metadata=[{"name": "plan", "type": "string"}])
                return Result(row_count=run(s, params))
            case n.CallProc():
                return self._call(s, params)
            case n.Administration():
                raise NotSupported(f"{s.what} is not supported")
            case n.SetOption():
                if s.time_zone is not None:
                    self.spark.conf.set("spark.sql.session.timeZone", s.time_zone)
                return Result(row_count=0)
        return Result(row_count=self._define(s))

    def _emitter(self, params: tuple | list) -> Emitter:
        return Emitter(self.catalog, tuple(params), buckets=self.buckets)

    def _frame(self, emitter: Emitter, text: str) -> DataFrame:
        return self.spark.sql(text, args=emitter.args) if emitter.args else self.spark.sql(text)

    def _dql(self, s: n.Dql, params: tuple, options: dict[str, int]) -> Result:
        emitter = self._emitter(params)
        text, columns = emitter.query(s.query)
        if s.explain:
            return Result(self._frame(emitter, f"EXPLAIN FORMATTED {text}").toDF("plan"), metadata=[{"name": "plan", "type": "string"}])
        df = self._frame(emitter, text)
        most = options.get("vtable_max_rows", 0)
        if most:  # the rows are made once, for the count and for the caller
            df = settled(df.limit(most + 1))
            if df.count() > most:
                raise QueryError(f"the result has more than {most} rows")
        return Result(df, metadata=[{"name": c.name, "type": c.type} for c in columns])

    def _changed(self, name: str, new: DataFrame, n_rows: int) -> int:
        self.catalog.change(name, settled(new))
        return n_rows

    @staticmethod
    def _typed(name: str, kind: str) -> Any:
        return F.col(name).cast(SPARK[kind]) if kind not in ("array", "map", "any", "scalar") else F.col(name)

    @staticmethod
    def _source(t: Table, alias: str | None, emitted: str = "_t") -> Source:
        return Source(alias or t.name, emitted, tuple(Column(c, k) for c, k, _ in t.columns), t.shard_key)

    def _insert(self, s: n.Insert, params: tuple) -> int:
        t = self.catalog.table(s.table)
        names = s.columns or tuple(c for c, _, _ in t.columns)
        kinds = {c: (k, null) for c, k, null in t.columns}
        for c in names:
            if c == BUCKET and c not in kinds:
                raise QueryError("bucket_id can't be given")
            if c not in kinds:
                raise QueryError(f"column {c!r} not found")
        if len(set(names)) < len(names):
            raise QueryError("a column is given twice")
        for c, (_, null) in kinds.items():
            if c not in names and not null:
                raise QueryError(f"column {c!r} can't be null and has no value")
        emitter = self._emitter(params)
        text, columns = emitter.query(s.query)
        if len(columns) != len(names):
            raise QueryError(f"INSERT has {len(names)} columns and {len(columns)} values")
        rows = self._frame(emitter, text).toDF(*[f"c{i}" for i in range(len(names))]).withColumn("__at", F.monotonically_increasing_id())
        given = {c: f"c{i}" for i, c in enumerate(names)}
        rows = rows.select(*[(self._typed(given[c], k) if c in given else F.lit(None).cast(SPARK[k])).alias(c) for c, k, _ in t.columns], "__at")
        new, n_rows = dml.inserted(t, settled(rows), s.conflict)
        if s.conflict == "REPLACE" and t.primary_key or t.parts + 1 >= MOST_PARTS:
            return self._changed(s.table, new, n_rows)
        self.catalog.change(s.table, new, parts=t.parts + 1)
        return n_rows

    def _source_text(self, s: n.Insert | n.Update | n.Delete, emitter: Emitter) -> str:
        """The query whose rows a statement inserts, changes or deletes."""
        if isinstance(s, n.Insert):
            return emitter.query(s.query)[0]
        t = self.catalog.table(s.table)
        sources, text = [self._source(t, s.alias)], f"{quoted(t.view)} AS _t"
        if isinstance(s, n.Delete):
            items = [f"_t.{quoted(c)}" for c in t.primary_key] or ["*"]
        else:
            if s.source is not None:
                right, source = emitter.scan(s.source, {})
                text, sources = f"{text} INNER JOIN {right}", [*sources, source]
            values = [emitter.scalar(e, sources, {}) for _, e in s.sets]
            items = [f"_t.{quoted(c)}" for c in self._key(t, "UPDATE")] + [f"{e.text} AS _v{i}" for i, e in enumerate(values)]
        where = f" WHERE {emitter.condition(s.where, sources, {}, 'WHERE')}" if s.where is not None else ""
        return f"SELECT {', '.join(items)} FROM {text}{where}"

    def _key(self, t: Table, what: str) -> tuple[str, ...]:
        if not t.primary_key:
            raise QueryError(f"{what} needs a primary key: {t.name!r}")
        return t.primary_key

    def _update(self, s: n.Update, params: tuple) -> int:
        t = self.catalog.table(s.table)
        key, kinds = self._key(t, "UPDATE"), {c: k for c, k, _ in t.columns}
        names = [c for c, _ in s.sets]
        if len(set(names)) < len(names):
            raise QueryError("a column is set twice")
        for c in names:
            if c in key:
                raise QueryError(f"the primary key column {c!r} can't be set")
            if c == BUCKET and c not in kinds:
                raise QueryError("bucket_id can't be set")
            if c not in kinds:
                raise QueryError(f"column {c!r} not found")
        emitter = self._emitter(params)
        found = self._frame(emitter, self._source_text(s, emitter))
        found = found.select(*[f"`{c}`" for c in key], *[self._typed(f"_v{i}", kinds[c]).alias(f"_v{i}") for i, c in enumerate(names)])
        return self._changed(s.table, *dml.updated(t, settled(found), {c: f"_v{i}" for i, c in enumerate(names)}))

    def _delete(self, s: n.Delete, params: tuple) -> int:
        t = self.catalog.table(s.table)
        if s.where is None:
            return self._changed(s.table, t.frame.limit(0), t.frame.count())
        self._key(t, "DELETE")
        emitter = self._emitter(params)
        keys = self._frame(emitter, self._source_text(s, emitter))
        return self._changed(s.table, *dml.deleted(t, settled(keys)))

    def _call(self, s: n.CallProc, params: tuple) -> Result:
        if s.name not in self.catalog.procedures:
            raise QueryError(f"no such procedure: {s.name}")
        found = self.catalog.procedures[s.name]
        values = tuple(params[a.number - 1] if isinstance(a, n.Param) else a.value for a in s.args)
        if len(values) != len(found.types):
            raise QueryError(f"{s.name} takes {len(found.types)} arguments")
        return self.execute(found.body, values)

    def _define(self, s: n.Statement) -> int:
        c = self.catalog
        match s:
            case n.CreateTable():
                if c.has(s.name):
                    if s.if_not_exists:
                        return 0
                    raise QueryError(f"a table named {s.name!r} is there already")
                kinds = {x: k for x, k, _ in s.columns}
                for x in s.shard_key or ():
                    if kinds[x] in ("array", "map", "any"):
                        raise QueryError(f"a key can't have the column {x!r} of type {kinds[x]}")
                schema = ", ".join(f"{quoted(x)} {SPARK[k]}" for x, k, _ in s.columns)
                self.register(s.name, self.spark.createDataFrame([], schema), primary_key=s.primary_key, shard_key=s.shard_key, columns=s.columns)
            case n.DropTable():
                if not c.has(s.name):
                    if s.if_exists:
                        return 0
                    raise QueryError(f"no such table: {s.name}")
                self.spark.catalog.dropTempView(c.tables.pop(s.name).view)
            case n.CreateIndex():
                t = c.table(s.table)
                for x in s.columns:
                    if x not in [name for name, _, _ in t.columns]:
                        raise QueryError(f"column {x!r} not found")
                if s.unique:
                    c.tables[s.table] = replace(t, unique={**t.unique, s.name: s.columns})
            case n.DropIndex():
                for name, t in c.tables.items():
                    c.tables[name] = replace(t, unique={k: v for k, v in t.unique.items() if k != s.name})
            case n.CreateProc():
                if s.name in c.procedures and not s.if_not_exists:
                    raise QueryError(f"a procedure named {s.name!r} is there already")
                c.procedures.setdefault(s.name, s)
            case n.DropProc():
                found = c.procedures.get(s.name)
                if found is None or s.types not in (None, found.types):
                    if s.if_exists:
                        return 0
                    raise QueryError(f"no such procedure: {s.name}")
                del c.procedures[s.name]
            case n.RenameProc():
                if s.name not in c.procedures:
                    raise QueryError(f"no such procedure: {s.name}")
                c.procedures[s.new_name] = replace(c.procedures.pop(s.name), name=s.new_name)
        return 1
