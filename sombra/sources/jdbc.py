"""JDBC sources and sinks.

Reads are split by the primary key, or by another column that can be ordered:
numbers and dates by Spark's own ranges, texts by predicates between quantiles,
so a large table is read by many tasks without naming a column.  Loads go
through a staging table in which every row knows the task attempt that wrote
it; one attempt per partition is moved to the target in one transaction, so a
task that ran twice leaves no row twice.  Tests use embedded Derby
(``jdbc:derby:memory:…``), which ships with Spark: no server, no port.
"""

from __future__ import annotations

import contextlib
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "derby": "org.apache.derby.jdbc.EmbeddedDriver",
}
# Schemas never listed as user schemas.
SYSTEM_SCHEMAS = {"information_schema", "pg_catalog", "sys", "mysql", "performance_schema",
                  "SYS", "SYSCAT", "SYSCS_DIAG", "SYSCS_UTIL", "SYSFUN", "SYSIBM", "SYSPROC",
                  "SYSSTAT", "NULLID", "SQLJ"}
BIND_BUDGET = 30000          # K2: bound parameters per insert batch
ROWS_PER_TASK = 1000         # a read is not split finer than this
KEY_SAMPLE = 20_000          # keys drawn for quantiles of a text column (balance only)


def build_url(db_type: str, host: str = "", port: int | str = "", db: str = "",
              trusted: bool = False) -> str:
    """S3: JDBC URL for PostgreSQL, MySQL, SQL Server (incl. integrated
    auth) and Derby.  Credentials go in ``user``/``password`` options, not
    in the URL."""
    if db_type == "postgresql":
        return f"jdbc:postgresql://{host}:{port}/{urllib.parse.quote(db)}"
    if db_type == "mysql":
        return f"jdbc:mysql://{host}:{port}/{urllib.parse.quote(db)}?characterEncoding=utf8"
    if db_type == "mssql":
        url = f"jdbc:sqlserver://{host}:{port};databaseName={db};encrypt=false"
        return url + (";integratedSecurity=true" if trusted else "")
    if db_type == "derby":
        return f"jdbc:derby:memory:{db};create=true"
    raise ValueError(f"unknown database type {db_type!r}")


def target_database(source_db: str, given: str | None = None) -> str:
    """The default target namespace is ``<source>_anon``."""
    return given or f"{source_db}_anon"


def quote(url: str, name: str) -> str:
    """Dialect quoting of one identifier (Spark quotes the names it creates)."""
    return f"`{name}`" if url.startswith("jdbc:mysql") else f'"{name}"'


def _options(url: str, props: dict | None) -> dict:
    opts = {"url": url}
    opts.update(props or {})
    if "driver" not in opts:
        for k, drv in DRIVERS.items():
            if url.startswith(f"jdbc:{k}") or (k == "mssql" and url.startswith("jdbc:sqlserver")):
                opts["driver"] = drv
    return opts


def read_table(spark: SparkSession, url: str, table: str, props: dict | None = None,
               partition_column: str | None = None, num_partitions: int | None = None,
               fetch_size: int = 1000, temporal_as_text: bool = False) -> DataFrame:
    """S1 (+S2): full-table read, paged by ``fetchsize``, in up to
    ``num_partitions`` parts (default: the session's parallelism).

    Without ``partition_column`` the first column of the primary key is taken,
    else the first number or date, else the first text.  Every row is read once
    whatever the column holds, nulls included.  By default tables of less
    than ``ROWS_PER_TASK`` rows per part are read in fewer parts."""
    rows = query(spark, url, f"SELECT COUNT(*) AS n FROM {table}", props).first()[0]
    if num_partitions is None:
        num_partitions = max(1, min(spark.sparkContext.defaultParallelism, -(-int(rows) // ROWS_PER_TASK)))
    reader = lambda: spark.read.format("jdbc").options(**_options(url, props)).option("fetchsize", fetch_size)
    schema = describe(spark, url, table, props)
    column = None
    if num_partitions > 1:
        column = split_column(spark, url, table, schema, props, partition_column)
    if column is None:
        df = reader().option("dbtable", table).load()
    elif isinstance(schema[column].dataType, (T.StringType, T.VarcharType, T.CharType)):
        parts = text_predicates(spark, url, table, column, num_partitions, int(rows), props)
        df = _read_predicates(spark, url, table, parts, props, fetch_size)
    else:
        name = quote(url, column)
        lo, hi = query(spark, url, f"SELECT MIN({name}) AS lo, MAX({name}) AS hi FROM {table}", props).first()
        r = reader().option("dbtable", table)
        if lo is not None and lo != hi:
            numeric = isinstance(schema[column].dataType, T.NumericType)
            bounds = (int(lo), int(hi) + 1) if numeric else (str(lo), str(hi))
            r = (r.option("partitionColumn", column).option("lowerBound", bounds[0])
                 .option("upperBound", bounds[1]).option("numPartitions", num_partitions))
        df = r.load()
    return temporal_to_text(df) if temporal_as_text else df


def split_column(spark: SparkSession, url: str, table: str, schema: T.StructType, props: dict | None = None,
                 wanted: str | None = None) -> str | None:
    """The column a read is split by."""
    names = {f.name.lower(): f.name for f in schema.fields}
    kind = {f.name: f.dataType for f in schema.fields}
    ranged = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    texts = (T.StringType, T.VarcharType, T.CharType)
    if wanted is not None:
        if wanted.lower() not in names or not isinstance(kind[names[wanted.lower()]], ranged + texts):
            raise ValueError(f"cannot split {table} by {wanted!r}")
        return names[wanted.lower()]
    owner, _, bare = table.rpartition(".")
    with contextlib.suppress(Exception):           # a source without metadata is split by what its rows hold
        key = primary_key(spark, url, owner or None, bare, props)
        if key and isinstance(kind.get(names.get(key[0].lower())), ranged + texts):
            return names[key[0].lower()]
    for group in (ranged, texts):
        for f in schema.fields:
            if isinstance(f.dataType, group):
                return f.name
    return None


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_predicates(spark: SparkSession, url: str, table: str, column: str, parts: int, rows: int,
                    props: dict | None = None) -> list[str]:
    """Conditions that cut a table by a text column, each row in exactly one.

    Bounds are quantiles of a sample of the keys (they only balance).  Whether
    the database's order agrees with the ranges is checked there, in one scan;
    where it does not (a collation of its own), the parts are told apart by a
    chain of comparisons, which is exclusive under any order."""
    name = quote(url, column)
    keys = query(spark, url, f"SELECT {name} AS k FROM {table} WHERE {name} IS NOT NULL", props)
    drawn = sorted(r[0] for r in keys.sample(min(1.0, KEY_SAMPLE / max(rows, 1)), seed=1).collect())
    cuts = sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)} if drawn else set())
    cuts = [c for c in cuts if drawn and c > drawn[0]]
    if not cuts:
        return ["1 = 1"]
    ranges = [f"{name} < {literal(cuts[0])} OR {name} IS NULL"]
    ranges += [f"{name} >= {literal(a)} AND {name} < {literal(b)}" for a, b in zip(cuts, cuts[1:], strict=False)]
    ranges.append(f"{name} >= {literal(cuts[-1])}")
    times = " + ".join(f"CASE WHEN {r} THEN 1 ELSE 0 END" for r in ranges)
    least, most = query(spark, url, f"SELECT MIN(c) AS lo, MAX(c) AS hi FROM (SELECT {times} AS c FROM {table}) t", props).first()
    if (least, most) == (1, 1):
        return ranges
    chain = "CASE " + " ".join(f"WHEN {name} < {literal(c)} THEN {i}" for i, c in enumerate(cuts)) + f" ELSE {len(cuts)} END"
    return [f"({chain}) = {i}" for i in range(len(cuts) + 1)]


def _read_predicates(spark: SparkSession, url: str, table: str, predicates: list[str], props: dict | None,
                     fetch_size: int) -> DataFrame:
    opts = {k: str(v) for k, v in _options(url, props).items() if k != "url"}
    return spark.read.jdbc(url, table, predicates=predicates, properties={**opts, "fetchsize": str(fetch_size)})


def temporal_to_text(df: DataFrame) -> DataFrame:
    """Date, timestamp and time columns cast to string (opt-in; SURVEY Q7)."""
    kinds = tuple(k for k in (T.DateType, T.TimestampType, T.TimestampNTZType, getattr(T, "TimeType", None)) if k)
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, kinds)
                       else F.col(f.name) for f in df.schema.fields])


def query(spark: SparkSession, url: str, sql: str, props: dict | None = None) -> DataFrame:
    return spark.read.format("jdbc").options(**_options(url, props)).option("query", sql).load()


def list_schemas(spark: SparkSession, url: str, props: dict | None = None) -> list[str]:
    """Sorted user schemas (system schemas and ``pg_*`` dropped)."""
    if url.startswith("jdbc:derby"):
        df = query(spark, url, "SELECT SCHEMANAME AS s FROM SYS.SYSSCHEMAS", props)
    else:
        df = query(spark, url, "SELECT schema_name AS s FROM information_schema.schemata", props)
    names = [r[0] for r in df.collect()]
    return sorted(n for n in names if n not in SYSTEM_SCHEMAS and not n.lower().startswith("pg_"))


def list_tables(spark: SparkSession, url: str, schema: str, props: dict | None = None) -> list[str]:
    """Sorted table names of a schema."""
    if url.startswith("jdbc:derby"):
        sql = ("SELECT t.TABLENAME AS n FROM SYS.SYSTABLES t JOIN SYS.SYSSCHEMAS s "
               f"ON t.SCHEMAID = s.SCHEMAID WHERE s.SCHEMANAME = '{schema}' AND t.TABLETYPE = 'T'")
    else:
        sql = ("SELECT table_name AS n FROM information_schema.tables "
               f"WHERE table_schema = '{schema}' AND table_type = 'BASE TABLE'")
    return sorted(r[0] for r in query(spark, url, sql, props).collect())


def table_exists(spark: SparkSession, url: str, schema: str, table: str,
                 props: dict | None = None) -> bool:
    """S12."""
    return table in list_tables(spark, url, schema, props)


def describe(spark: SparkSession, url: str, table: str, props: dict | None = None) -> T.StructType:
    """S11 (columns): the schema, read without fetching rows."""
    return query(spark, url, f"SELECT * FROM {table} WHERE 1 = 0", props).schema


def batch_size(n_columns: int) -> int:
    """K2: rows per insert so one statement binds at most 30,000 values."""
    return max(1, BIND_BUDGET // max(n_columns, 1))


def append(df: DataFrame, url: str, table: str, props: dict | None = None,
           num_partitions: int | None = None) -> None:
    """Plain batched append, for targets that may hold a repeated task's rows
    twice; :func:`load` holds each once."""
    w = df if num_partitions is None else df.coalesce(num_partitions)
    (w.write.format("jdbc").options(**_options(url, props)).option("dbtable", table)
      .option("batchsize", batch_size(len(df.columns))).mode("append").save())


def truncate(df_schema_like: DataFrame, url: str, table: str, props: dict | None = None,
             cascade: bool = True) -> None:
    """K5: empty the target, keeping its definition (TRUNCATE … CASCADE where
    the dialect supports it)."""
    (df_schema_like.limit(0).write.format("jdbc").options(**_options(url, props))
     .option("dbtable", table).option("truncate", True).option("cascadeTruncate", cascade)
     .mode("overwrite").save())


def clone_structure(df: DataFrame, url: str, table: str, props: dict | None = None,
                    column_types: str | None = None) -> None:
    """K6: create the target table from a schema if it is missing (no rows,
    no server-side defaults)."""
    w = df.limit(0).write.format("jdbc").options(**_options(url, props)).option("dbtable", table)
    if column_types:
        w = w.option("createTableColumnTypes", column_types)
    w.mode("ignore").save()


# ---------------------------------------------------------------------------
# Keys, from the driver's own metadata
# ---------------------------------------------------------------------------

@contextlib.contextmanager
def connection(spark: SparkSession, url: str, props: dict | None = None) -> Iterator:
    """A JDBC connection of the Spark driver, for metadata and single statements."""
    jvm = spark.sparkContext._jvm
    opts = _options(url, props)
    if "driver" in opts:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(opts["driver"])
    login = jvm.java.util.Properties()
    for k, v in opts.items():
        if k not in ("url", "driver", "dbtable", "query"):
            login.setProperty(k, str(v))
    con = jvm.java.sql.DriverManager.getConnection(url, login)
    try:
        yield con
    finally:
        con.close()


def _rows(result, names: list[str]) -> list[tuple]:
    out = []
    while result.next():
        out.append(tuple(result.getObject(n) for n in names))
    result.close()
    return out


def _place(url: str, schema: str | None) -> tuple[str | None, str | None]:
    """(catalog, schema) as the driver's metadata knows them."""
    return (schema, None) if url.startswith("jdbc:mysql") else (None, schema)


def primary_key(spark: SparkSession, url: str, schema: str | None, table: str, props: dict | None = None) -> list[str]:
    """The columns of the primary key, in key order."""
    with connection(spark, url, props) as con:
        found = _rows(con.getMetaData().getPrimaryKeys(*_place(url, schema), table), ["KEY_SEQ", "COLUMN_NAME"])
    return [c for _, c in sorted(found)]


def foreign_keys(spark: SparkSession, url: str, schema: str | None, table: str,
                 props: dict | None = None) -> list[tuple[str, str, int, str, str]]:
    """(key name, parent table, position, child column, parent column) of a
    table's foreign keys; a key of several columns has a row for each."""
    names = ["FK_NAME", "PKTABLE_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "PKCOLUMN_NAME"]
    with connection(spark, url, props) as con:
        return sorted(_rows(con.getMetaData().getImportedKeys(*_place(url, schema), table), names))


def table_info(spark: SparkSession, url: str, schema: str, table: str, props: dict | None = None) -> dict:
    """Columns, primary key and foreign keys of a table."""
    edges: dict[tuple[str, str], list] = {}
    for name, parent, _, child_col, parent_col in foreign_keys(spark, url, schema, table, props):
        edges.setdefault((name, parent), []).append((child_col, parent_col))
    return {"columns": describe(spark, url, f"{schema}.{table}", props),
            "primary_key": primary_key(spark, url, schema, table, props),
            "foreign_keys": [{"name": n, "parent": p, "child_columns": [c for c, _ in cols], "parent_columns": [c for _, c in cols]}
                             for (n, p), cols in edges.items()]}


def fk_edges_from(spark: SparkSession, url: str, schema: str, props: dict | None = None) -> DataFrame:
    """S11 (foreign keys) of all tables of a schema as an edge frame (child,
    parent, child_cols, parent_cols); the columns of a key stay paired."""
    rows = []
    for t in list_tables(spark, url, schema, props):
        rows += [(t, k["parent"], k["child_columns"], k["parent_columns"])
                 for k in table_info(spark, url, schema, t, props)["foreign_keys"]]
    return spark.createDataFrame(rows, "child string, parent string, child_cols array<string>, parent_cols array<string>")


# ---------------------------------------------------------------------------
# K1: loads that survive repeated tasks
# ---------------------------------------------------------------------------

PART, ATTEMPT = "SOMBRA_PART", "SOMBRA_ATTEMPT"


def with_attempt(df: DataFrame) -> DataFrame:
    """``df`` with its partition and the task attempt that handles it."""
    ship_package(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(PART, T.IntegerType()), T.StructField(ATTEMPT, T.LongType())])

    def run(batches):
        at = TaskContext.get()
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([at.partitionId()] * n, pa.int32()), pa.array([at.taskAttemptId()] * n, pa.int64())],
                names=[*b.schema.names, PART, ATTEMPT])

    return df.mapInArrow(run, schema)


def load(df: DataFrame, url: str, table: str, props: dict | None = None) -> int:
    """K1: append ``df`` to an existing table, each row exactly once; returns
    the rows added.

    Rows are written to a staging table beside the target, with the partition
    and task attempt they come from.  A task that failed half-way, was lost
    after its commit or ran twice leaves several attempts there; the fullest
    one of each partition is kept, then one statement moves them to the target
    in one transaction.  If anything fails, the target is as it was."""
    spark = df.sparkSession
    stage = f"{table}_S{uuid.uuid4().hex[:10].upper()}"
    target = {f.name.lower(): f.name for f in describe(spark, url, table, props).fields}
    missing = [c for c in df.columns if c.lower() not in target]
    if missing:
        raise ValueError(f"{table} has no column {missing[0]!r}")
    write = (with_attempt(df).write.format("jdbc").options(**_options(url, props)).option("dbtable", stage)
             .option("batchsize", batch_size(len(df.columns) + 2)))
    try:
        write.mode("errorifexists").save()
        return move_staged(spark, url, stage, table, df.columns, props)
    finally:
        with connection(spark, url, props) as con, contextlib.suppress(Exception):
            con.createStatement().executeUpdate(f"DROP TABLE {stage}")


def move_staged(spark: SparkSession, url: str, stage: str, table: str, columns: list[str], props: dict | None = None) -> int:
    """One attempt of each partition of ``stage`` into ``table``, in one
    transaction.  What is read here is one row per partition and attempt."""
    part, attempt = quote(url, PART), quote(url, ATTEMPT)
    per = query(spark, url, f"SELECT {part} AS p, {attempt} AS a, COUNT(*) AS n FROM {stage} GROUP BY {part}, {attempt}", props)
    best: dict[int, tuple[int, int]] = {}
    attempts = [(int(p), int(a), int(n)) for p, a, n in per.collect()]
    for p, a, n in attempts:
        best[p] = max(best.get(p, (0, 0)), (n, -a))
    names = {f.name.lower(): f.name for f in describe(spark, url, table, props).fields}
    into = ", ".join(quote(url, names[c.lower()]) for c in columns)
    with connection(spark, url, props) as con:
        owner, _, bare = table.rpartition(".")
        widths = {c.lower(): n for c, t, n in _rows(con.getMetaData().getColumns(*_place(url, owner or None), bare, None),
                                                    ["COLUMN_NAME", "TYPE_NAME", "COLUMN_SIZE"]) if t == "VARCHAR"}
        if not url.startswith("jdbc:derby"):
            widths = {}                # only Derby stages texts as CLOB, which it will not store as VARCHAR by itself
        take = ", ".join(f"CAST({quote(url, c)} AS VARCHAR({widths[c.lower()]}))" if c.lower() in widths else quote(url, c)
                         for c in columns)
        con.setAutoCommit(False)
        try:
            run = con.createStatement()
            for c in columns:
                if c.lower() in widths:       # such a cast would cut silently
                    long = run.executeQuery(f"SELECT COUNT(*) FROM {stage} WHERE LENGTH({quote(url, c)}) > {widths[c.lower()]}")
                    long.next()
                    if long.getInt(1):
                        raise ValueError(f"values of {c!r} longer than {widths[c.lower()]}")
                    long.close()
            for p, a, _ in attempts:
                if best[p][1] != -a:
                    run.executeUpdate(f"DELETE FROM {stage} WHERE {part} = {p} AND {attempt} = {a}")
            moved = run.executeUpdate(f"INSERT INTO {table} ({into}) SELECT {take} FROM {stage}")
            if moved != sum(n for n, _ in best.values()):
                raise RuntimeError(f"{moved} rows moved to {table}, {sum(n for n, _ in best.values())} staged")
            con.commit()
        except BaseException:
            con.rollback()
            raise
    return moved
