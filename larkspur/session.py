"""The engine: SQL statements over versioned tables, with transactions.

SELECT goes to Spark, each table it names being a view of the transaction's snapshot. DDL and DML make the next state of a
table; nothing is visible before the whole statement has been checked and, outside a transaction, published.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur import dialect as D
from larkspur import naming
from larkspur.catalog import Catalog, Column, Manifest, Part, Table
from larkspur.constraints import check_keys, check_new_keys, check_rows, key_sets, within
from larkspur.errors import CatalogError, ConstraintError, EngineError, SerializationError, SyntaxError_
from larkspur.sources.delimited import read_delimited
from larkspur.sources.store import Store


@dataclass
class Transaction:
    """A pinned manifest, the tables changed since, the tables read, and the folders written."""

    pinned: Manifest
    serializable: bool
    changed: dict[str, Table | None] = field(default_factory=dict)
    appended: dict[str, list[Part]] = field(default_factory=dict)  # tables that were only appended to
    read: set[str] = field(default_factory=set)
    written: list[str] = field(default_factory=list)

    def saved(self) -> tuple:
        return dict(self.changed), {k: list(v) for k, v in self.appended.items()}, len(self.written)

    def restore(self, saved: tuple) -> list[str]:
        """Undoes what has changed since; the folders written since."""
        self.changed, self.appended, n = saved
        late = self.written[n:]
        del self.written[n:]
        return late

    def tables(self) -> dict[str, Table]:
        out = dict(self.pinned.tables)
        for name, t in self.changed.items():
            if t is None:
                out.pop(name, None)
            else:
                out[name] = t
        return dict(sorted(out.items()))

    def get(self, name: str) -> Table:
        found = self.tables().get(name)
        if found is None:
            raise CatalogError(f"no table {name}")
        self.read.add(name)
        return found

    def put(self, name: str, table: Table | None, part: Part | None = None) -> None:
        if part is not None and (name not in self.changed or name in self.appended):
            self.appended.setdefault(name, []).append(part)
        else:
            self.appended.pop(name, None)
        self.changed[name] = table


PUBLISH_ATTEMPTS = 50


def _renamed(df: DataFrame, names: list[str | None]) -> DataFrame:
    """Columns of a plain SELECT list under their generated names."""
    if len(names) != len(df.columns) or not any(names):
        return df
    return df.toDF(*(n or c for n, c in zip(names, df.columns, strict=True)))


KEPT_MANIFESTS, KEPT_SECONDS = 20, 3600.0
#: Parts a table may have before the small ones are merged, and the bytes below which a part is small.
MANY_PARTS, SMALL_BYTES = 32, 64 << 20


class Engine:
    """`Engine(spark, folder).sql(text)`; isolation is "snapshot" or "serializable"."""

    def __init__(self, spark: SparkSession, root: str, isolation: str = "snapshot") -> None:
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.ansi.enabled", "true")
        self.store = Store(self.spark, root)
        self.catalog = Catalog(self.store)
        self.serializable = isolation == "serializable"
        self.open: Transaction | None = None

    def session(self) -> Engine:
        """Another session over the same tables."""
        return Engine(self.spark, self.store.root, "serializable" if self.serializable else "snapshot")

    # transactions

    def begin(self) -> None:
        if self.open is not None:
            raise EngineError("a transaction is open")
        self.open = Transaction(self.catalog.latest(), self.serializable)

    def commit(self) -> None:
        if self.open is None:
            raise EngineError("no transaction is open")
        done, self.open = self.open, None
        self._publish(done)  # on failure nothing refers to what it wrote

    def rollback(self) -> None:
        if self.open is None:
            raise EngineError("no transaction is open")
        self._drop_folders(self.open.restore(({}, {}, 0)))
        self.open = None

    def _drop_folders(self, paths: list[str]) -> None:
        for path in paths:
            self.store.delete(path)

    @contextmanager
    def _whole(self, txn: Transaction) -> Iterator[None]:
        """What a failing statement has changed and written goes; outside a transaction a statement is published."""
        saved = txn.saved()
        try:
            yield
        except BaseException:
            self._drop_folders(txn.restore(saved))
            raise
        if self.open is None:
            self._publish(txn)

    @contextmanager
    def transaction(self) -> Iterator[Engine]:
        self.begin()
        try:
            yield self
        except BaseException:
            if self.open is not None:
                self.rollback()
            raise
        self.commit()

    def _publish(self, txn: Transaction) -> None:
        """First committer wins: a table this transaction changed must not have changed since it began, unless both only
        appended and no key can clash; under serializable isolation no table it read may have changed."""
        if not txn.changed:
            return
        try:
            self._try_publish(txn)
        except BaseException:
            self._drop_folders(txn.restore(({}, {}, 0)))
            raise

    def _try_publish(self, txn: Transaction) -> None:
        for attempt in range(PUBLISH_ATTEMPTS):
            if attempt:  # another writer was faster
                time.sleep(min(2.0, 0.01 * 2 ** min(attempt, 8)) * random.random())
            now = self.catalog.latest()
            moved = {n for n in {*now.tables, *txn.pinned.tables} if (a := now.tables.get(n)) is None or (b := txn.pinned.tables.get(n)) is None or a.changed != b.changed}
            tables = dict(now.tables)
            version = now.version + 1
            if txn.serializable and (late := moved & txn.read):
                raise SerializationError(f"{', '.join(sorted(late))} changed since the transaction began")
            for name, table in txn.changed.items():
                if name in moved:
                    free = name in txn.appended and name in now.tables and table is not None and not key_sets(table) and now.tables[name].columns == table.columns
                    if not free:
                        raise SerializationError(f"{name} changed since the transaction began")
                    tables[name] = replace(now.tables[name], parts=now.tables[name].parts + tuple(txn.appended[name]), changed=version)
                elif table is None:
                    tables.pop(name, None)
                else:
                    tables[name] = replace(table, changed=version)
            if self.catalog.publish(Manifest(version, tables)):
                return
        raise SerializationError(f"{PUBLISH_ATTEMPTS} attempts to publish have failed")

    # statements

    def sql(self, text: str) -> DataFrame:
        """Runs statements; the result of the last one."""
        out = None
        if (plain := D.number_insert(text)) is not None:
            return self._done(lambda txn: self._insert_rows(*plain, txn))
        for tokens in D.statements(text):
            out = self._statement(tokens)
        if out is None:
            raise SyntaxError_("no statement")
        return out

    def _statement(self, tokens: list[D.Token]) -> DataFrame:
        r = D.Reader(tokens)
        if r.take("begin") or r.take("start", "transaction"):
            self.begin()
            return self._text("OK", ["BEGIN"])
        if r.take("commit"):
            self.commit()
            return self._text("OK", ["COMMIT"])
        if r.take("rollback"):
            self.rollback()
            return self._text("OK", ["ROLLBACK"])
        return self._done(lambda txn: self._run(r, txn))

    def _done(self, statement: Callable[[Transaction], DataFrame]) -> DataFrame:
        """Runs a statement in the open transaction, or one of its own."""
        txn = self.open or Transaction(self.catalog.latest(), self.serializable)
        with self._whole(txn):
            out = statement(txn)
        if self.open is None:
            for name in txn.appended:
                self._tidy(name)
        return out

    def _run(self, r: D.Reader, txn: Transaction) -> DataFrame:
        for words, f in (
            (("create", "table"), self._create), (("drop", "table"), self._drop), (("alter", "table"), self._alter), (("create", "index"), self._create_index),
            (("create", "unique", "index"), self._create_index), (("drop", "index"), self._drop_index), (("insert",), self._insert), (("update",), self._update),
            (("delete", "from"), self._delete), (("copy",), self._copy), (("set",), self._set), (("show", "tables"), self._show), (("describe",), self._describe), (("explain",), self._explain),
        ):
            if r.take(*words):
                return f(r, txn)
        if r.peek() in ("select", "with", "values", "("):
            return self._select(r.rest(), txn)
        raise SyntaxError_(f"unsupported statement {r.peek()!r}")

    def _text(self, name: str, rows: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in rows], f"`{name}` string")

    def _count(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "count long")

    # queries

    def _select(self, tokens: list[D.Token], txn: Transaction) -> DataFrame:
        known = txn.tables()
        views: list[str] = []
        named = D.sources(tokens)
        for k in named:
            name = tokens[k].text.strip("`").lower()
            if name in known and name not in views:
                txn.get(name).read(self.spark).createOrReplaceTempView(name)
                views.append(name)
        plain = D.parse_select(tokens)
        names = [naming.name_of(i) for i in plain.items] if plain else []
        tokens = D.to_spark(tokens, " ".join(known))
        s = D.parse_select(tokens)
        attempts = [tokens]
        if s is not None:
            base = s.clauses.get("from", [])
            keys = [c.name for c in known[base[0].low].primary] if len(base) == 1 and base[0].low in known else []
            limited = D.order_limited(s, keys)
            first = limited or s
            attempts = [first.render(), D.inline_aliases(first).render()]
            if covered := D.drop_covered_keys(s):
                attempts.append(covered.render())
        try:
            error: AnalysisException | None = None
            for t in attempts:
                try:
                    return _renamed(self.spark.sql(D.render(t)), names)
                except AnalysisException as e:
                    error = error or e
            raise error
        finally:
            for v in views:
                self.spark.catalog.dropTempView(v)

    def _explain(self, r: D.Reader, txn: Transaction) -> DataFrame:
        df = self._select(r.rest(), txn)
        return self._text("PLAN", [df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))])

    def _show(self, r: D.Reader, txn: Transaction) -> DataFrame:
        r.end()
        return self._text("TABLE", list(txn.tables()))

    def _describe(self, r: D.Reader, txn: Transaction) -> DataFrame:
        t = txn.get(r.name())
        r.end()
        rows = [(c.name, c.type.name, str(c.nullable).lower(), "PRIMARY" if c.primary else "UNIQUE" if c in t.unique else "EMPTY", c.default if c.default is not None else "null") for c in t.columns]
        return self.spark.createDataFrame(rows, "FIELD string, TYPE string, `NULL` string, Key string, DEFAULT string")

    def _set(self, r: D.Reader, txn: Transaction) -> DataFrame:
        r.name()
        if not r.take("="):
            r.expect("to")
        txn.serializable = r.next().text.strip("'`").lower() == "serializable"
        if self.open is None:
            self.serializable = txn.serializable
        r.end()
        return self._text("OK", ["SET"])

    # definitions

    def _column(self, r: D.Reader, number: int) -> Column:
        c = Column(number, r.name(), r.type())
        while not r.done:
            if r.take("not", "null"):
                c = replace(c, nullable=False)
            elif r.take("null"):
                c = replace(c, nullable=True)
            elif r.take("primary", "key"):
                c = replace(c, primary=True, nullable=False)
            elif r.take("unique"):
                c = replace(c, unique=True)
            elif r.take("default"):
                value = [r.next()]
                if value[0].text in ("-", "+"):
                    value.append(r.next())
                c = replace(c, default=D.literal(value))
                if c.default is not None:  # refuses what the type can't hold
                    check_rows(self.spark.range(1).select(F.lit(c.default).cast(c.type.spark).alias(c.name)), [replace(c, nullable=True, primary=False)])
            else:
                raise SyntaxError_(f"unexpected {r.peek()!r} in column {c.name}")
        return c

    def _create(self, r: D.Reader, txn: Transaction) -> DataFrame:
        quiet = r.take("if", "not", "exists")
        name = r.name()
        body = D.split(r.parens())
        r.end()
        if name in txn.tables():
            if quiet:
                return self._text("OK", [name])
            raise CatalogError(f"table {name} exists")
        columns: list[Column] = []
        for item in body:
            x = D.Reader(item)
            kind = "primary" if x.take("primary", "key") else "unique" if x.peek(1) == "(" and x.take("unique") else ""
            if kind:
                wanted = [t.text.strip("`").lower() for t in x.parens() if t.text != ","]
                if missing := set(wanted) - {c.name for c in columns}:
                    raise CatalogError(f"no column {', '.join(sorted(missing))}")
                more = {"primary": True, "nullable": False} if kind == "primary" else {"unique": True}
                columns = [replace(c, **more) if c.name in wanted else c for c in columns]
            else:
                columns.append(self._column(x, len(columns)))
        if len({c.name for c in columns}) < len(columns):
            raise CatalogError(f"table {name} names a column twice")
        txn.put(name, Table(name, tuple(columns), len(columns)))
        return self._text("OK", [name])

    def _drop(self, r: D.Reader, txn: Transaction) -> DataFrame:
        quiet = r.take("if", "exists")
        name = r.name()
        if name in txn.tables():
            txn.put(name, None)
        elif not quiet:
            raise CatalogError(f"no table {name}")
        return self._text("OK", [name])

    def _alter(self, r: D.Reader, txn: Transaction) -> DataFrame:
        t = txn.get(r.name())
        if r.take("add"):
            r.take("column")
            quiet = r.take("if", "not", "exists")
            c = self._column(r, t.next_id)
            if any(x.name == c.name for x in t.columns):
                if quiet:
                    return self._text("OK", [t.name])
                raise CatalogError(f"{t.name} has a column {c.name}")
            if c.primary or (not c.nullable and c.default is None):
                raise ConstraintError(f"{c.name} must be nullable or have a default")
            c = replace(c, fill=c.default)
            new = t.with_columns([*t.columns, c], next_id=t.next_id + 1)
            if c.unique and c.default is not None:
                check_keys(new.read(self.spark), [c.name])
            txn.put(t.name, new)
        else:
            r.expect("drop")
            r.take("column")
            quiet = r.take("if", "exists")
            name = r.name()
            if not any(c.name == name for c in t.columns):
                if quiet:
                    return self._text("OK", [t.name])
                raise CatalogError(f"{t.name} has no column {name}")
            if t.column(name).primary:
                raise ConstraintError("a primary key can't be dropped")
            txn.put(t.name, t.with_columns([c for c in t.columns if c.name != name], indexes={k: v for k, v in t.indexes.items() if v != name}))
        r.end()
        return self._text("OK", [t.name])

    def _create_index(self, r: D.Reader, txn: Transaction) -> DataFrame:
        quiet = r.take("if", "not", "exists")
        index = r.name()
        r.expect("on")
        t = txn.get(r.name())
        columns = [x.text.strip("`").lower() for x in r.parens() if x.text != ","]
        r.end()
        if len(columns) != 1:
            raise EngineError("an index has one column")
        if index in t.indexes:
            if quiet:
                return self._text("OK", [index])
            raise CatalogError(f"{t.name} has an index {index}")
        c = t.column(columns[0])
        check_keys(t.read(self.spark), [c.name])
        txn.put(t.name, replace(t, indexes=t.indexes | {index: c.name}))
        return self._text("OK", [index])

    def _drop_index(self, r: D.Reader, txn: Transaction) -> DataFrame:
        quiet = r.take("if", "exists")
        table = r.next().text.strip("`").lower()
        r.expect(".")
        index = r.next().text.strip("`").lower()
        r.end()
        t = txn.get(table)
        if index in t.indexes:
            txn.put(table, replace(t, indexes={k: v for k, v in t.indexes.items() if k != index}))
        elif not quiet:
            raise CatalogError(f"{table} has no index {index}")
        return self._text("OK", [index])

    # rows

    def _write(self, df: DataFrame, t: Table, txn: Transaction, ranged: bool = False) -> Part:
        """Rows of the table's columns, in key order within each file for the sake of row-group statistics (between files too
        if ranged), with a bloom filter for each key."""
        path = f"{self.store.root}/data/{t.name}/{uuid.uuid4().hex}"
        keys = [c.name for c in t.primary]
        if keys:
            df = (df.repartitionByRange(*keys) if ranged else df).sortWithinPartitions(*keys)
        writer = df.select(*(F.col(c.name).alias(c.stored) for c in t.columns)).write
        for c in dict.fromkeys([*t.primary, *t.unique]):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c.stored}", "true")
        txn.written.append(path)
        writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.candidates.number", "12").parquet(path)
        return Part(path, tuple(c.id for c in t.columns))

    def append(self, name: str, df: DataFrame, txn: Transaction | None = None, upsert: bool = False) -> int:
        """Appends (or upserts by primary key) rows of a DataFrame that has some of the table's columns; the others get
        their defaults. Returns the number of rows."""
        if txn is None:
            own = self.open or Transaction(self.catalog.latest(), self.serializable)
            with self._whole(own):
                n = self._append(name, df, own, upsert)
            if self.open is None:
                self._tidy(name)
            return n
        return self._append(name, df, txn, upsert)

    def _append(self, name: str, df: DataFrame, own: Transaction, upsert: bool) -> int:
        t = own.get(name)
        given = {c.lower() for c in df.columns}
        if unknown := given - {c.name for c in t.columns}:
            raise CatalogError(f"{name} has no column {', '.join(sorted(unknown))}")
        df = df.select(*((F.col(c.name) if c.name in given else F.lit(c.default)).cast(c.type.spark).alias(c.name) for c in t.columns))
        part = self._write(df, t, own)  # written once; the checks read the files, and nothing refers to them if one fails
        new = replace(t, parts=(part,)).read(self.spark)
        n = check_rows(new, list(t.columns))
        if upsert:
            self._upsert(t, new, part, own)
        else:
            check_new_keys(new, t.read(self.spark) if t.parts else None, key_sets(t))
            own.put(name, replace(t, parts=(*t.parts, part)), part)
        return n

    def _upsert(self, t: Table, new: DataFrame, part: Part, txn: Transaction) -> None:
        keys = [c.name for c in t.primary]
        if not keys:
            raise EngineError(f"{t.name} has no primary key")
        check_keys(new, keys)
        touched, rest, _ = self._parts(t, within(t.read(self.spark, part=True), new, keys[0]).join(new.select(*keys), keys, "left_semi"))
        kept = replace(t, parts=tuple(touched)).read(self.spark).join(new.select(*keys), keys, "left_anti").select(*(c.name for c in t.columns))
        after = replace(t, parts=(*rest, *([self._write(kept, t, txn)] if touched else []), part))
        for other in key_sets(t):
            if other != keys:
                check_keys(after.read(self.spark), other)
        txn.put(t.name, after)

    def _parts(self, t: Table, rows: DataFrame) -> tuple[list[Part], list[Part], int]:
        """The files that rows (with their `_part`) come from, the others, and the number of rows. One job."""
        files: dict[str, set[str]] = {}
        n = 0
        for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
            folder, _, file = r["_part"].rpartition("/")
            files.setdefault(folder, set()).add(file)
            n += r["n"]
        hit, rest = [], []
        for p in t.parts:
            own = files.get(p.path.rpartition("/")[2])
            if own is None:
                rest.append(p)
                continue
            hit.append(replace(p, files=tuple(sorted(own))))
            others = set(p.files if p.files is not None else (x for x in self.store.names(p.path) if x.endswith(".parquet"))) - own
            if others:
                rest.append(replace(p, files=tuple(sorted(others))))
        return hit, rest, n

    def _insert(self, r: D.Reader, txn: Transaction) -> DataFrame:
        upsert = r.take("overwrite")
        r.take("into")
        r.take("table")
        name = r.name()
        listed = [x.text.strip("`") for x in r.parens() if x.text != ","] if r.peek() == "(" else None
        if r.take("values"):
            return self._insert_rows(upsert, name, listed, D.constant_rows(r.rest()), txn)
        t = txn.get(name)
        names = [t.column(x).name for x in listed] if listed else [c.name for c in t.columns]
        df = self._select(r.rest(), txn)
        if len(df.columns) != len(names):
            raise SyntaxError_("the query has the wrong number of columns")
        return self._count(self.append(t.name, df.toDF(*names), txn, upsert))

    def _insert_rows(self, upsert: bool, name: str, listed: list[str] | None, rows: list[list[str | None]], txn: Transaction) -> DataFrame:
        t = txn.get(name)
        names = [t.column(x).name for x in listed] if listed else [c.name for c in t.columns]
        if not rows or any(len(x) > len(names) or (listed and len(x) != len(names)) for x in rows):
            raise SyntaxError_("a row has the wrong number of values")
        width = max(map(len, rows))
        # a short row takes the columns' defaults
        rows = [x if len(x) == width else x + [t.column(n).default for n in names[len(x) : width]] for x in rows]
        data = pa.table({n: pa.array([x[i] for x in rows], pa.string()) for i, n in enumerate(names[:width])})
        return self._count(self.append(t.name, self.spark.createDataFrame(data), txn, upsert))

    def _where(self, tokens: list[D.Token]) -> str:
        return D.render(D.to_spark(tokens, "")) if tokens else "true"

    def _change(self, t: Table, where: str, make, txn: Transaction) -> tuple[Table, int]:
        """The table with those files rewritten that hold rows for which where is true, and the number of these; make gets the
        files' rows and the condition."""
        hit, rest, n = self._parts(t, t.read(self.spark, part=True).where(where))
        if not n:
            return t, 0
        rows = replace(t, parts=tuple(hit)).read(self.spark)
        part = self._write(make(rows, F.coalesce(F.expr(where), F.lit(False))), t, txn)
        return replace(t, parts=(*rest, part)), n

    def _update(self, r: D.Reader, txn: Transaction) -> DataFrame:
        t = txn.get(r.name())
        r.expect("set")
        sets = {}
        for item in D.split(r.until("where")):
            x = D.Reader(item)
            c = t.column(x.name())
            x.expect("=")
            sets[c.name] = F.expr(D.render(D.to_spark(x.rest(), ""))).cast(c.type.spark)
        where = self._where(r.rest()[1:] if r.peek() == "where" else r.rest())

        def make(rows: DataFrame, hit) -> DataFrame:
            return rows.select(*(F.when(hit, sets[c.name]).otherwise(F.col(c.name)).alias(c.name) if c.name in sets else F.col(c.name) for c in t.columns))

        new, n = self._change(t, where, make, txn)
        if n:  # checked before the transaction sees it
            check_rows(replace(new, parts=new.parts[-1:]).read(self.spark).select(*sets), [c for c in t.columns if c.name in sets])
            for keys in key_sets(t):
                if set(keys) & set(sets):
                    check_keys(new.read(self.spark), keys)
            txn.put(t.name, new)
        return self._count(n)

    def _delete(self, r: D.Reader, txn: Transaction) -> DataFrame:
        t = txn.get(r.name())
        where = self._where(r.rest()[1:] if r.peek() == "where" else r.rest())
        new, n = self._change(t, where, lambda rows, hit: rows.where(~hit), txn)
        if n:
            txn.put(t.name, new)
        return self._count(n)

    def _copy(self, r: D.Reader, txn: Transaction) -> DataFrame:
        t = txn.get(r.name())
        columns = [t.column(x.text.strip("`")) for x in r.parens() if x.text != ","] if r.peek() == "(" else list(t.columns)
        r.expect("from")
        path = D.literal([r.next()])
        options = {"delimiter": "|", "header": "false", "quote": '"', "escape": "\\", "format": "csv"}
        r.take("with")
        for item in D.split(r.parens()) if r.peek() == "(" else []:
            key = item[0].low
            if key not in options:
                raise SyntaxError_(f"unknown option {key}")
            options[key] = D.literal(item[1:]) if item[1:] and item[1].kind == "string" else item[1].low if item[1:] else "true"
        r.end()
        if options["format"] != "csv":
            raise EngineError(f"unknown format {options['format']}")
        fields = T.StructType([T.StructField(c.name, c.type.data_type) for c in columns])
        df = read_delimited(self.spark, path, fields, options["delimiter"], options["header"] == "true", options["quote"], options["escape"])
        return self._text("COPY", [f"import {self.append(t.name, df, txn)} rows"])

    def _size(self, part: Part) -> int:
        return self.store.size(part.paths)

    def compact(self, name: str, small: int | None = None) -> None:
        """Rewrites the parts of a table that have fewer than `small` bytes (all of them if None) as one, in key order over all
        its files."""
        own = self.open or Transaction(self.catalog.latest(), self.serializable)
        with self._whole(own):
            t = own.get(name)
            parts = [p for p in t.parts if small is None or self._size(p) < small]
            if len(parts) > 1:
                part = self._write(replace(t, parts=tuple(parts)).read(self.spark), t, own, ranged=True)
                own.put(name, replace(t, parts=(*(p for p in t.parts if p not in parts), part)))

    def _tidy(self, name: str) -> None:
        """Merges small parts once there are many. Losing the race against another writer does no harm."""
        t = self.catalog.latest().tables.get(name)
        if t is not None and len(t.parts) > MANY_PARTS:
            try:
                self.compact(name, SMALL_BYTES)
            except SerializationError:
                pass

    def vacuum(self, keep: int = KEPT_MANIFESTS, seconds: float = KEPT_SECONDS) -> int:
        """Removes old manifests, and folders and files that no remaining one refers to (those of dropped tables, replaced or
        left by crashed writers), unless they changed within `seconds`: a running transaction may still publish them. Returns
        how many folders and files went."""
        used: dict[str, set[str] | None] = {}
        for m in self.catalog.forget(keep, seconds):
            for t in m.tables.values():
                for p in t.parts:
                    known = used.get(p.path, set())
                    used[p.path] = None if p.files is None or known is None else known | set(p.files)
        gone = 0
        for table in self.store.names("data"):
            for folder in self.store.names(f"data/{table}"):
                path = f"{self.store.root}/data/{table}/{folder}"
                if self.store.age(path) < seconds:
                    continue
                if path not in used:
                    self.store.delete(path)
                    gone += 1
                elif used[path] is not None:
                    for f in self.store.names(path):
                        if f.endswith(".parquet") and f not in used[path]:
                            self.store.delete(f"{path}/{f}")
                            gone += 1
            if not self.store.names(f"data/{table}"):
                self.store.delete(f"data/{table}")
        return gone
