"""Registered queries for the engine's own operators, each over whole tables, with equivalent SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import any_date, iso_date
from ..functions.frames import as_frame
from ..functions.text import folded
from ..operators.codelist import ExplosiveMatch, match_codelist, predict_exact
from ..operators.combine import append_distinct, row_counts
from ..operators.concepts import Rule, extract_concepts, rules_from_wide
from ..operators.conform import blanks_to_null, conform, repair_dates
from ..operators.identity import assign_ids
from ..operators.inventory import InventorySpec, code_inventory
from ..operators.layout import Layout, apply_layout
from ..operators.provenance import origin_rows, origin_values
from ..operators.quality import COPIES, dedup, dedup_split, drop_missing
from ..sources.files import fresh_path, move, put
from ..sources.ingest import load_tables
from ..sources.sinks import add_to_table, append_parquet, save_removed, write_report
from ..sources.text_import import clean_text
from ..spec import ColumnSpec, Config, TableSpec, read_metadata
from ..store import ROW_SEQ, Store
from .flow import Engine, RemoveDuplicates

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str | Callable[[], str]] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    """Registers a query with its SQL (a function, where that needs what is defined further below)."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v if isinstance(v, str) else v() for k, v in _SQL.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- loading and conforming --------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_mktsegment, CAST(NULL AS VARCHAR) AS c_phone FROM customer")
def conform_columns(spark, sf_dir):
    spec = TableSpec("CUSTOMER", (ColumnSpec("c_custkey", True, "other"), ColumnSpec("c_name", True), ColumnSpec("c_mktsegment"), ColumnSpec("c_phone", True)))
    return conform(table(spark, sf_dir, "customer"), spec, "parquet")


@query("""
SELECT o_orderkey,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS from_csv,
    CASE WHEN o_orderkey % 3 IN (0, 2) THEN CAST(o_orderdate AS DATE) END AS from_parquet,
    CAST(o_orderdate AS DATE) AS all_iso
FROM orders
""")
def repair_dates_by_column(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    kind = F.col("o_orderkey") % 3
    text = F.when(kind == 0, F.date_format(day, "yyyyMMdd")).when(kind == 1, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("from_csv"), text.alias("from_parquet"), F.date_format(day, "yyyy-MM-dd").alias("all_iso"))
    return repair_dates(repair_dates(df, ["from_csv", "all_iso"], "csv"), ["from_parquet"], "parquet")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 1 THEN CAST(o_orderdate AS DATE) END AS day FROM orders
""")
def repair_dates_by_row(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    kind = F.col("o_orderkey") % 3
    text = F.when(kind == 0, F.date_format(day, "yyyyMMdd")).when(kind == 1, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", any_date(text).alias("day"))


@query("""
SELECT event_id, TRY_CAST(CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y/%m/%d')
    WHEN 2 THEN strftime(ts, '%Y%m%d') ELSE event_type END AS DATE) AS day FROM events
""")
def date_try_cast(spark, sf_dir):
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd")).when(kind == 1, F.date_format("ts", "yyyy/MM/dd")).when(kind == 2, F.date_format("ts", "yyyyMMdd")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", iso_date(text).alias("day"))


_EVENT_TEXT = "CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN NULL ELSE event_type END"


def _sparse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, "").when(kind == 1, "NA").when(kind == 2, F.lit(None)).otherwise(F.col("event_type"))
    number = F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("label"), number.alias("amount"))


@query(f"SELECT event_id, NULLIF(label, '') AS label FROM (SELECT event_id, {_EVENT_TEXT} AS label FROM events)")
def blank_to_null(spark, sf_dir):
    return blanks_to_null(_sparse_events(spark, sf_dir).select("event_id", "label"), ["label"])


@query("SELECT p_partkey, trim(p_name) AS part, CAST(DATE '2024-01-01' + p_size AS DATE) AS day FROM part WHERE p_size > 5")
def trim_import(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(
        F.col("p_partkey"), F.concat(F.lit(" \t"), F.col("p_name"), F.lit(" \n")).alias("p_name"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyyyMMdd").alias("day"), "p_size"
    )
    out = clean_text(raw, {"p_partkey": "p_partkey", "p_name": "part", "day": "day", "p_size": "size"}, ["day"], F.col("size").cast("int") > 5)
    return out.select(F.col("p_partkey").cast("long").alias("p_partkey"), "part", "day")


@query("SELECT p_partkey, upper(p_name) AS folded FROM part")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", folded(F.col("p_name")).alias("folded"))


# ---- files in ----------------------------------------------------------------------------------


def _csv(df: DataFrame, folder: str, name: str) -> None:
    """One more CSV file (or folder of parts) of an instance; quoted fields may hold line ends."""
    df.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).option("quoteAll", True).option("escape", '"').option("nullValue", "NA").csv(f"{folder}/{name}.csv")


#: Rows of a file in order, at most about so many: what one task sorts. Some 140 MB of ``load_split_csv``, more than Spark's largest split.
FILE_ROWS = 6_000_000


def _in_order(df: DataFrame, key: str, files: int = 1) -> DataFrame:
    """Sorted by a key, in ranges of which each is written as one file, whose names ascend with them: no task takes the whole table, more rows make more files."""
    by = F.col(key).asc_nulls_last()
    return df.repartitionByRange(max(files, -(-df.count() // FILE_ROWS)), by).sortWithinPartitions(by)


def _instance(spark: SparkSession, sf_dir: str) -> str:
    """An instance folder: customers in two CSV files with other columns in another order, notes with line ends and quotes
    inside, dates as yyyymmdd; a file that only ends like the table's name; orders in two parquet files whose dates
    are timestamps; and parts in both formats."""
    folder = fresh_path(spark, "instance")
    customer = table(spark, sf_dir, "customer")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "yyyyMMdd")
    note = F.concat(F.lit('he said "'), F.col("c_mktsegment"), F.lit('",\nthen left'))
    even, odd = customer.where("c_custkey % 2 = 0"), customer.where("c_custkey % 2 = 1")
    _csv(even.select("c_custkey", note.alias("note"), day.alias("since"), F.lit("x").alias("odd_one")), folder, "CUSTOMER_A")
    _csv(odd.select(F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("c_name"), day.alias("since"), "c_custkey"), folder, "CUSTOMER_B")
    _csv(customer.select("c_custkey"), folder, "OLD_CUSTOMER")
    orders = table(spark, sf_dir, "orders")
    orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderdate").write.parquet(f"{folder}/ORDERS_1.parquet")
    orders.where("o_orderkey % 2 = 1").select("o_orderstatus", "o_orderdate", "o_orderkey").write.parquet(f"{folder}/ORDERS_2.parquet")
    part = table(spark, sf_dir, "part")
    part.select("p_partkey").write.parquet(f"{folder}/PART.parquet")
    _csv(part.select(F.lit("wrong").alias("p_partkey")), folder, "PART")
    return folder


METADATA = [
    {"TABLE": t, "Variable": v, "Mandatory": m, "Format": f}
    for t, v, m, f in [
        ("CUSTOMER", "c_custkey", "Yes", "Character"), ("CUSTOMER", "c_name", "Yes", "Character"), ("CUSTOMER", "note", "No", "Character"),
        ("CUSTOMER", "since", "Yes", "Character yyyymmdd"), ("CUSTOMER", "sex", "Yes", "Character"), ("ORDERS", "o_orderkey", "Yes", "Numeric"),
        ("ORDERS", "o_orderstatus", "No", "Character"), ("ORDERS", "o_orderdate", "Yes", "yyyymmdd"), ("PART", "p_partkey", "Yes", "Numeric"),
    ]
]


def _loaded(spark: SparkSession, sf_dir: str, tables: list[str], file_format: str = "auto", save: bool = False) -> Store:
    store, folder = Store(spark), _instance(spark, sf_dir)
    load_tables(store, folder, read_metadata(METADATA), tables, file_format, save_to=fresh_path(spark, "loaded") if save else None)
    return store


_LOADED = """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 2 = 1 AND c_custkey % 3 <> 0 THEN c_name END AS c_name,
    CASE WHEN c_custkey % 2 = 0 THEN 'he said "' || c_mktsegment || '",' || chr(10) || 'then left' END AS note,
    CAST(DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) AS DATE) AS since, CAST(NULL AS VARCHAR) AS sex FROM customer
"""


@query(_LOADED)
def load_csv(spark, sf_dir):
    """Discovery, CSV scan matched by name, line ends in quotes, and conforming, end to end."""
    return _loaded(spark, sf_dir, ["CUSTOMER"], "csv").get("CUSTOMER").drop(ROW_SEQ)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def load_parquet(spark, sf_dir):
    """Parquet files with other columns, matched by name; timestamps become dates."""
    return _loaded(spark, sf_dir, ["ORDERS"], "parquet", save=True).get("ORDERS").drop(ROW_SEQ)


@query("SELECT p_partkey FROM part")
def load_auto(spark, sf_dir):
    """A table in both formats is read from parquet, one without files is skipped."""
    return _loaded(spark, sf_dir, ["PART", "NOWHERE"]).get("PART").drop(ROW_SEQ)


@query("""
SELECT 'PART' AS name, p_brand AS variable, max(p_size) > 25 AS mandatory, CASE CAST(min(p_partkey) % 3 AS INTEGER) WHEN 0 THEN 'date' WHEN 1 THEN 'text' ELSE 'other' END AS kind, f AS source
FROM part, (VALUES ('csv'), ('json'), ('parquet')) AS t(f) GROUP BY p_brand, f
""")
def metadata_sources(spark, sf_dir):
    """Metadata, a row per brand of the parts, read from files of each kind."""
    form = F.element_at(F.array(F.lit("yyyymmdd"), F.lit("Character"), F.lit("Numeric")), (F.min("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("Variable")).agg(F.when(F.max("p_size") > 25, "Yes").otherwise("No").alias("Mandatory"), form.alias("Format")).withColumn("TABLE", F.lit("PART"))
    found = []
    for f in ("csv", "json", "parquet"):
        path = f"{fresh_path(spark, 'metadata')}.{f}"
        (rows.write.option("header", True).csv if f == "csv" else getattr(rows.write, f))(path)
        found += [(t, c.name, c.mandatory, c.kind, f) for t, spec in read_metadata(path, spark).items() for c in spec.columns]
    return spark.createDataFrame(found, "name string, variable string, mandatory boolean, kind string, source string")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def frames_as_tables(spark, sf_dir):
    """Tables in other forms (pandas, Arrow) put into a store; regions and nations are a few rows at every size."""
    store = Store(spark)
    store.put("nation", as_frame(spark, table(spark, sf_dir, "nation").toPandas()))
    store.put("region", as_frame(spark, table(spark, sf_dir, "region").toArrow()))
    return store.get("nation").join(store.get("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


_FLOW = """
WITH kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer) WHERE n = 1),
named AS (SELECT * FROM kept WHERE c_name IS NOT NULL AND c_name NOT IN ('', 'NA'))
"""


def _flow(spark: SparkSession, sf_dir: str) -> tuple[Engine, str]:
    """A configured run (its configuration in a file) over customers, ordered by key: the first of each nation, complete rows, ids, report."""
    root = fresh_path(spark, "flow")
    _in_order(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey", 4).write.parquet(f"{root}/in/CUSTOMER.parquet")
    config = {
        "file_format": "parquet", "cdm_tables_names": ["CUSTOMER"],
        "operations": {"DuplicateRemover": True, "MissingRemover": True, "UniqueIdGenerator": True, "ReportGenerator": True, "Unknown": True, "Off": False},
        "duplicate_remover": {"cdm_tables_columns": {"CUSTOMER": ["c_nationkey"]}, "save_deleted": True, "save_path": f"{root}/removed", "add_postfix": "x"},
        "missing_remover": {"columns": {"CUSTOMER": ["c_name"]}},
        "report_generator": {"report_path": root, "report_name": "counts.csv"},
    }
    put(spark, f"{root}/config.json", json.dumps(config).encode())
    text = "\n".join(r.value for r in spark.read.text(f"{root}/config.json").collect())
    meta = [{"TABLE": "CUSTOMER", "Variable": v, "Mandatory": "Yes", "Format": "Numeric" if v != "c_name" else "Character"} for v in ("c_custkey", "c_name", "c_nationkey")]
    engine = Engine(spark, Config.of(json.loads(text)), meta)
    load_tables(engine.store, f"{root}/in", engine.specs, list(engine.config.tables), engine.config.file_format, save_to=f"{root}/work", notes=engine.notes)
    return engine.run(), root


@query(_FLOW + "SELECT 'CUSTOMER' AS ori_table, c_custkey, c_name, c_nationkey FROM named")
def engine_run(spark, sf_dir):
    """Load, duplicates by key, missing values and ids, as a configuration file says."""
    engine, _ = _flow(spark, sf_dir)
    out = engine.table("CUSTOMER")
    return out.where("unique_id IS NOT NULL").select("ori_table", "c_custkey", "c_name", "c_nationkey")


@query(_FLOW + "SELECT 'CUSTOMER' AS name, CAST(count(*) AS VARCHAR) AS row_count FROM named")
def engine_report(spark, sf_dir):
    """The report file of that run."""
    _, root = _flow(spark, sf_dir)
    return spark.read.option("header", True).csv(f"{root}/counts.csv")


@query("SELECT user_id, min(event_type) AS event_type, count(*) - 1 AS removed FROM events GROUP BY user_id")
def dedup_ties(spark, sf_dir):
    """Orders that repeat within and between keys: one row of each key is kept all the same."""
    kept, removed = dedup(table(spark, sf_dir, "events"), ["user_id"], "keep_first", "event_type")
    gone = removed.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("user_id", "other")
    return kept.join(gone, F.col("user_id") == F.col("other"), "left").select("user_id", "event_type", F.coalesce("n", F.lit(0)).cast("long").alias("removed"))


# ---- databases, runs that go on, counts, splits ---------------------------------------------------


def _database(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a database: two versions of the orders, the second without those that are finished, and events."""
    store, sources = Store.open(spark, fresh_path(spark, "database")), _sources(spark, sf_dir)
    store.put("ORDERS", sources["ORDERS"])
    store.save("ORDERS")
    store.put("ORDERS", sources["ORDERS"].where("o_orderstatus <> 'F'"))
    store.put("EVENTS", sources["EVENTS"])
    store.add_step("open_urgent", "SELECT o.* FROM %s o WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'", base="ORDERS")
    store.commit()
    return store.root


@query(lambda: f"SELECT * FROM ({_union(PAIRED[:2])}) WHERE concept_id = 'o_urgent' UNION ALL {_sql_rule(MULTI[1])}")
def database_attached(spark, sf_dir):
    """Concepts from a database that another session wrote, attached from its folder."""
    root = _database(spark.newSession(), sf_dir)
    store = Store(spark)
    store.attach("origin", root)
    return extract_concepts(store, [*PAIRED[:2], MULTI[1]], namespace="origin")


@query("""
SELECT CAST(version AS INTEGER) AS version, o_orderstatus, count(*) AS n, false AS view FROM orders, (VALUES (0), (1)) AS t(version) WHERE version = 0 OR o_orderstatus <> 'F' GROUP BY ALL
UNION ALL SELECT -1, o_orderstatus, count(*), true FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' GROUP BY o_orderstatus
""")
def database_versions(spark, sf_dir):
    """Older versions and a kept pipeline of a database that was opened from its folder."""
    root = _database(spark, sf_dir)
    store = Store.open(spark.newSession(), root)
    parts = [(v, store.get("ORDERS", version=v), False) for v in range(store.versions("ORDERS"))] + [(-1, store.get("open_urgent"), True)]
    each = [df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("version"), "o_orderstatus", "n", F.lit(w).alias("view")) for v, df, w in parts]
    return each[0].unionAll(each[1]).unionAll(each[2])


@query("""
SELECT p_partkey, p_brand, n, s_name AS supplier FROM part JOIN (SELECT l_partkey, count(*) AS n, min(l_suppkey) AS first FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey
LEFT JOIN supplier ON s_suppkey = first WHERE p_size > 10 AND p_type NOT LIKE '%{x}%'
""")
def pipeline_joins(spark, sf_dir):
    """Steps in SQL that join the step before with another table, another pipeline and an attached table."""
    store = Store(spark)
    for t in ("part", "lineitem"):
        store.put(t, table(spark, sf_dir, t))
    store.attach("origin", {"supplier": table(spark, sf_dir, "supplier")})
    store.add_step("busy", "SELECT l_partkey, count(*) AS n, min(l_suppkey) AS first FROM %s GROUP BY l_partkey", base="lineitem")
    store.add_step("parts", "SELECT p_partkey FROM %s WHERE p_size > 10", base="part")
    store.add_step("parts", "WITH kinds AS (SELECT * FROM Part WHERE p_type NOT LIKE '%{x}%') SELECT kinds.p_partkey, p_brand FROM {prev} JOIN kinds USING (p_partkey)")
    store.add_step("parts", "SELECT p.*, n, first FROM %s p JOIN busy ON busy.l_partkey = p.p_partkey")
    store.add_step("parts", "SELECT p_partkey, p_brand, n, supplier.s_name AS supplier FROM %s LEFT JOIN origin.supplier ON supplier.s_suppkey = first")
    return store.get("parts")


@query("""
WITH found AS (SELECT o_orderpriority AS code, o_custkey % 3 AS source FROM orders), study AS (SELECT o_orderpriority AS code FROM orders WHERE o_orderkey % 5 = 0),
each AS (SELECT code, sum(n) AS n, sum(m) AS m FROM (SELECT code, count(*) AS n, 0 AS m FROM found GROUP BY code UNION ALL SELECT code, 0, count(*) FROM study GROUP BY code) GROUP BY code),
whole AS (SELECT 'whole' AS codelist, CAST(sum(n) AS BIGINT) AS data_rows, CAST(sum(m) AS BIGINT) AS study_rows, CAST(sum(n * m) AS BIGINT) AS predicted FROM each),
once AS (SELECT 'once' AS codelist, CAST(sum(n) AS BIGINT) AS data_rows, count(*) FILTER (m > 0) AS study_rows, CAST(sum(n) FILTER (m > 0) AS BIGINT) AS predicted FROM each)
SELECT *, predicted > data_rows + study_rows AS refused FROM whole UNION ALL SELECT *, predicted > data_rows + study_rows FROM once
""")
def match_guard(spark, sf_dir):
    """What an exact match of the orders' priorities would have, and whether it is refused: with a list that repeats codes, and with each once."""
    orders = table(spark, sf_dir, "orders")
    found = orders.select(F.lit("X").alias("coding_system"), F.col("o_orderpriority").alias("code"), F.lit(1).alias("COUNT"), (F.col("o_custkey") % 3).cast("string").alias("source_column"))
    study = orders.where("o_orderkey % 5 = 0").select(F.lit("X").alias("coding_system"), F.col("o_orderpriority").alias("code"), F.col("o_orderkey").cast("string").alias("concept_id"))
    parts = []
    for name, own in (("whole", study), ("once", study.dropDuplicates(["coding_system", "code"]))):
        try:
            match_codelist(found, own)
            refused = False
        except ExplosiveMatch:
            refused = True
        parts.append(predict_exact(found, own).select(F.lit(name).alias("codelist"), *[F.col(c).cast("long").alias(c) for c in ("data_rows", "study_rows", "predicted")], F.lit(refused).alias("refused")))
    return parts[0].unionAll(parts[1])


_DIRTY = """
SELECT o_orderkey, CASE CAST(o_orderkey % 5 AS INTEGER) WHEN 0 THEN '20240231' WHEN 1 THEN 'soon' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y%m%d') END AS ordered,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS priority FROM orders
"""


@query(f"""
WITH dirty AS ({_DIRTY})
SELECT what, CAST(n AS BIGINT) AS n FROM (
    SELECT 'rows' AS what, count(*) AS n FROM dirty UNION ALL SELECT 'blanks in priority', count(*) FROM dirty WHERE priority = ''
    UNION ALL SELECT 'impossible dates in ordered', count(*) FROM dirty WHERE ordered IN ('20240231', 'soon')
    UNION ALL SELECT 'rows before', count(*) FROM dirty UNION ALL SELECT 'incomplete rows removed', count(*) FROM dirty WHERE priority = ''
    UNION ALL SELECT 'saved rows', count(*) FROM dirty WHERE priority <> '')
""")
def load_counts(spark, sf_dir):
    """What a load and the removal of incomplete rows changed, counted by the jobs that write, and found again in the database's journal."""
    orders, folder, root = table(spark, sf_dir, "orders"), fresh_path(spark, "instance"), fresh_path(spark, "database")
    kind = F.col("o_orderkey") % 5
    day = F.when(kind == 0, "20240231").when(kind == 1, "soon").when(kind == 2, "").when(kind == 3, F.lit(None)).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    _csv(orders.select("o_orderkey", day.alias("ordered"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("priority")), folder, "ORDERS")
    meta = [{"TABLE": "ORDERS", "Variable": v, "Mandatory": "Yes", "Format": f} for v, f in (("o_orderkey", "Numeric"), ("ordered", "yyyymmdd"), ("priority", "Character"))]
    config = {"cdm_tables_names": ["ORDERS"], "file_format": "csv", "operations": {"MissingRemover": True}, "missing_remover": {"columns": {"ORDERS": ["priority"]}}}
    run = lambda s: Engine(s, config, meta, store=Store.open(s, root)).load(folder).run()
    run(spark)
    again = run(spark.newSession())  # takes everything from the journal
    counts = [*again.notes.counts["ORDERS"].items(), ("saved rows", again.table("ORDERS").count())]
    return spark.createDataFrame(counts, "what string, n long")


_NOTES = "CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN o_orderpriority || chr(10) || '\"second\" line,' || chr(10) WHEN 1 THEN '5\" pipe' WHEN 2 THEN '' ELSE o_orderpriority END"


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, {_NOTES} AS note, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS place FROM orders")
def load_split_csv(spark, sf_dir):
    """CSV files in order of keys (one, up to so many rows) whose quoted fields hold line ends, read in splits: rows and their places, which go on from file to file."""
    kind, folder = F.col("o_orderkey") % 4, fresh_path(spark, "instance")
    note = F.when(kind == 0, F.concat("o_orderpriority", F.lit('\n"second" line,\n'))).when(kind == 1, F.lit('5" pipe')).when(kind == 2, "").otherwise(F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"))
    _csv(_in_order(orders, "o_orderkey"), folder, "ORDERS")
    store = Store(spark)
    load_tables(store, folder, {}, ["ORDERS"], "csv", save_to=fresh_path(spark, "loaded"))
    loaded = store.get("ORDERS").select("o_orderkey", "note", f"{ROW_SEQ}.file", f"{ROW_SEQ}.row")
    files = loaded.groupBy("file").agg(F.max("row").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))  # a row per file
    return loaded.join(F.broadcast(before), "file").select("o_orderkey", "note", (F.col("before") + F.col("row")).alias("place"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, true AS same FROM customer")
def ids_free_of_paths(spark, sf_dir):
    """Ids of an instance before and after its folder was moved."""
    folder, elsewhere, found = _instance(spark, sf_dir), fresh_path(spark, "moved"), []
    for where in (folder, elsewhere):
        if where == elsewhere:
            move(spark, folder, elsewhere)
        store = Store(spark)
        load_tables(store, where, read_metadata(METADATA), ["CUSTOMER"], "csv", save_to=fresh_path(spark, "loaded"))
        found.append(assign_ids(store.get("CUSTOMER"), "CUSTOMER").select("c_custkey", "unique_id"))
    both = found[0].join(found[1].withColumnsRenamed({"unique_id": "other", "c_custkey": "key"}), F.col("unique_id") == F.col("other"), "left")
    return both.select("c_custkey", F.coalesce(F.col("key") == F.col("c_custkey"), F.lit(False)).alias("same"))


@query("""
SELECT o_orderkey, o_custkey, n = 1 AS kept, CAST((SELECT count(*) FROM orders) - (SELECT count(DISTINCT o_custkey) FROM orders) AS BIGINT) AS copies
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
""")
def dedup_both_sides(spark, sf_dir):
    """The first order of each customer and the others, written by one job that counts them."""
    kept, removed, counts = dedup_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], fresh_path(spark, "sides"), "o_orderkey")
    return kept.withColumn("kept", F.lit(True)).unionByName(removed.withColumn("kept", F.lit(False))).withColumn("copies", F.lit(counts[COPIES]).cast("long"))


@query(_FLOW + "SELECT 'CUSTOMER' AS ori_table, c_custkey, c_name, c_nationkey, 'RemoveDuplicates,Unsteady,Unsteady' AS ran FROM named")
def engine_resumed(spark, sf_dir):
    """A durable run that fails in its third step, and another session's run that goes on there."""
    root, ran = fresh_path(spark, "durable"), []

    class Unsteady:
        def run(self, engine: Engine) -> None:
            ran.append("Unsteady")
            if len(ran) == 2:
                raise RuntimeError("lost")

    class Counted(RemoveDuplicates):
        def run(self, engine: Engine) -> None:
            ran.append("RemoveDuplicates")
            super().run(engine)

    _in_order(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey", 4).write.parquet(f"{root}/in/CUSTOMER.parquet")
    config = {
        "file_format": "parquet", "cdm_tables_names": ["CUSTOMER"], "operations": {"DuplicateRemover": True, "MissingRemover": True, "Unsteady": True, "UniqueIdGenerator": True},
        "duplicate_remover": {"cdm_tables_columns": {"CUSTOMER": ["c_nationkey"]}, "save_deleted": True, "save_path": f"{root}/removed"}, "missing_remover": {"columns": {"CUSTOMER": ["c_name"]}},
    }
    meta = [{"TABLE": "CUSTOMER", "Variable": v, "Mandatory": "Yes", "Format": "Numeric" if v != "c_name" else "Character"} for v in ("c_custkey", "c_name", "c_nationkey")]
    run = lambda s: Engine(s, config, meta, {"DuplicateRemover": Counted, "Unsteady": Unsteady}, Store.open(s, f"{root}/base")).load(f"{root}/in").run()
    try:
        run(spark)
    except RuntimeError:
        run(spark.newSession())
    out = Store.open(spark, f"{root}/base").get("CUSTOMER")
    return out.where("unique_id IS NOT NULL").select("ori_table", "c_custkey", "c_name", "c_nationkey", F.lit(",".join(ran)).alias("ran"))


# ---- quality -----------------------------------------------------------------------------------


@query(f"SELECT event_id, label FROM (SELECT event_id, {_EVENT_TEXT} AS label FROM events) WHERE label IS NOT NULL AND label NOT IN ('', 'NA')")
def drop_missing_text(spark, sf_dir):
    return drop_missing(_sparse_events(spark, sf_dir).select("event_id", "label"), ["label"])


@query("SELECT event_id, amount FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS amount FROM events) WHERE amount IS NOT NULL")
def drop_missing_numeric(spark, sf_dir):
    return drop_missing(_sparse_events(spark, sf_dir).select("event_id", "amount"), ["amount"])


@query("SELECT DISTINCT text, lang FROM documents")
def dedup_full_row(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents").select("text", "lang"))[0]


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_keep_first(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"), ["text"], "keep_first", "doc_id")[0].select("doc_id")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT min(doc_id) FROM documents GROUP BY text)")
def dedup_removed(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"), ["text"], "keep_first", "doc_id")[1].select("doc_id", "lang", "source")


@query("""
SELECT (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS n_ids,
    (SELECT count(*) FROM lineitem) AS n_shaped, 'LINEITEM' AS ori_table
""")
def assign_ids_counts(spark, sf_dir):
    ids = assign_ids(table(spark, sf_dir, "lineitem"), "LINEITEM")
    shaped = F.col("unique_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return ids.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("unique_id").alias("n_ids"), F.count_if(shaped).alias("n_shaped"), F.max("ori_table").alias("ori_table"))


# ---- store -------------------------------------------------------------------------------------


@query("SELECT p_brand, p_type, CAST(length(p_type) AS INTEGER) AS type_length FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 10)")
def pipeline_steps(spark, sf_dir):
    store = Store(spark)
    store.put("part", table(spark, sf_dir, "part"))
    store.add_step("parts", "SELECT p_brand, p_type FROM %s WHERE p_size > 10", base="part")
    store.add_step("parts", lambda df: df.distinct())
    store.add_step("parts", "SELECT p_brand, p_type, length(p_type) AS type_length FROM {prev}")
    return store.get("parts")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS row_count FROM {t}" for t in TABLES))
def count_rows(spark, sf_dir):
    store = Store(spark)
    for t in TABLES:
        store.put(t, table(spark, sf_dir, t))
    return row_counts(store)


@query("SELECT c_nationkey AS nation, c_mktsegment AS label FROM customer UNION SELECT s_nationkey, 'SUPPLIER' FROM supplier")
def append_tables(spark, sf_dir):
    store = Store(spark)
    store.put("customer", table(spark, sf_dir, "customer").withColumnsRenamed({"c_nationkey": "nation", "c_mktsegment": "label"}))
    store.put("supplier", table(spark, sf_dir, "supplier").withColumn("kind", F.lit("SUPPLIER")))
    return append_distinct(store, {"customer": ["nation", "label"], "supplier": ["s_nationkey", "kind"]}, "all")


@query("""
SELECT CAST(o_orderdate AS DATE) AS day FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem
""")
def append_day_numbers(spark, sf_dir):
    store = Store(spark)
    for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        store.put(t, table(spark, sf_dir, t).select(F.unix_date(F.col(c).cast("date")).alias("day")))
    return append_distinct(store, {"orders": ["day"], "lineitem": ["day"]}, date_columns=["day"])


# ---- vocabulary --------------------------------------------------------------------------------


@query("""
SELECT p_type AS code, p_brand AS vocabulary, count(*) AS n, 'p_type' AS source_column FROM part GROUP BY ALL
UNION ALL SELECT event_type, CAST(NULL AS VARCHAR), count(*), 'event_type' FROM events GROUP BY event_type
""")
def inventory(spark, sf_dir):
    get = lambda t: table(spark, sf_dir, t)
    parts, events = code_inventory(get, [InventorySpec("part", ("p_brand", "p_type"), ("vocabulary", "code")), InventorySpec("events", ("event_type",), ("code",))])
    return parts.unionByName(events, allowMissingColumns=True).withColumnRenamed("COUNT", "n").select("code", "vocabulary", "n", "source_column")


#: Study rows: system, code, concept, tags, priority.
STUDY = [
    ("ATC", "PRO", "promo", "narrow", 1), ("ATC", "PROM", "promo", "broad", 2), ("ATC", "PROM", "promo", "narrow", 1),
    ("ATC", "ECON", "economy", "narrow", 1), ("ATC", "S", "s_any", "broad", 2), ("ATC", "STANDARD", "s_any", "narrow", 1),
    ("ATC", "ZZZ", "none", "narrow", 1), ("PRODCODEID", "Brand#1", "b1", "narrow", 1), ("PRODCODEID", "Brand#1", "b1alt", "broad", 2),
    ("PRODCODEID", "Brand#999", "bx", "narrow", 1),
]


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda t: table(spark, sf_dir, t)
    types, brands = code_inventory(get, [InventorySpec("part", ("p_type",), ("code",)), InventorySpec("part", ("p_brand",), ("code",))])
    found = types.withColumn("coding_system", F.lit("ATC")).unionByName(brands.withColumn("coding_system", F.lit("PRODCODEID")))
    study = spark.createDataFrame([(k, *r) for k, r in enumerate(STUDY)], "place int, coding_system string, code string, concept_id string, tags string, priority int")
    return match_codelist(found, study, position="place").select(
        "coding_system", F.col("COUNT").alias("n"), "source_column", F.col("`code.dap_codes`").alias("data_code"), "concept_id", F.col("`code.codelist`").alias("study_code"), "tags", "priority", "length_str", "code", "match_status"
    )


_MATCH_SQL = f"""
WITH found AS (
    SELECT 'ATC' AS coding_system, p_type AS code, count(*) AS n, 'p_type' AS source_column FROM part GROUP BY p_type
    UNION ALL SELECT 'PRODCODEID', p_brand, count(*), 'p_brand' FROM part GROUP BY p_brand
), study(place, coding_system, code, concept_id, tags, priority) AS (
    VALUES {", ".join(f"({k}, '{s}', '{c}', '{i}', '{t}', {p})" for k, (s, c, i, t, p) in enumerate(STUDY))}
), ranked AS (
    SELECT f.coding_system, f.n, f.source_column, f.code AS data_code, s.concept_id, s.code AS study_code, s.tags, s.priority,
        row_number() OVER (PARTITION BY f.coding_system, f.code, s.concept_id ORDER BY length(s.code) DESC, s.priority, s.place) AS best
    FROM found f JOIN study s ON f.coding_system = s.coding_system AND (CASE WHEN f.coding_system = 'ATC' THEN starts_with(f.code, s.code) ELSE f.code = s.code END)
), matched AS (
    SELECT * EXCLUDE (best) FROM ranked WHERE best = 1 OR coding_system <> 'ATC'
), labelled AS (
    SELECT *, 'MATCHED' AS match_status FROM matched
    UNION ALL SELECT coding_system, n, source_column, code, NULL, NULL, NULL, NULL, 'ONLY_IN_DATA' FROM found f
        WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.coding_system = f.coding_system AND m.data_code = f.code)
    UNION ALL SELECT coding_system, NULL, NULL, NULL, concept_id, code, tags, priority, 'ONLY_IN_CODELIST' FROM study s
        WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.coding_system = s.coding_system AND m.study_code = s.code)
)
SELECT coding_system, n, source_column, data_code, concept_id, study_code, tags, priority, length(study_code) AS length_str, CASE WHEN match_status = 'MATCHED' THEN data_code END AS code, match_status
FROM labelled
"""


# Numbers that may be NULL come as text: what reads both results may turn them into floating point.
@query(f"SELECT * REPLACE (CAST(n AS VARCHAR) AS n, CAST(priority AS VARCHAR) AS priority, CAST(length_str AS VARCHAR) AS length_str) FROM ({_MATCH_SQL})")
def match_status(spark, sf_dir):
    return _matched(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in ("n", "priority", "length_str")})


@query(f"SELECT data_code, concept_id, study_code, n FROM ({_MATCH_SQL}) WHERE match_status = 'MATCHED' AND coding_system = 'ATC'")
def match_prefix(spark, sf_dir):
    return _matched(spark, sf_dir).where("match_status = 'MATCHED' AND coding_system = 'ATC'").select("data_code", "concept_id", "study_code", "n")


@query(f"SELECT data_code, concept_id, study_code, n FROM ({_MATCH_SQL}) WHERE match_status = 'MATCHED' AND coding_system = 'PRODCODEID'")
def match_exact(spark, sf_dir):
    return _matched(spark, sf_dir).where("match_status = 'MATCHED' AND coding_system = 'PRODCODEID'").select("data_code", "concept_id", "study_code", "n")


@query(f"SELECT coding_system, coalesce(data_code, study_code) AS code, match_status FROM ({_MATCH_SQL}) WHERE match_status <> 'MATCHED'")
def match_leftovers(spark, sf_dir):
    return _matched(spark, sf_dir).where("match_status <> 'MATCHED'").select("coding_system", F.coalesce("data_code", "study_code").alias("code"), "match_status")


# ---- concepts ----------------------------------------------------------------------------------


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Source tables with record ids that SQL can make, too."""
    ids = lambda t, key, person: table(spark, sf_dir, t).withColumns({"ori_table": F.lit(t.upper()), "unique_id": F.col(key).cast("string"), "person_id": F.col(person).cast("string")})
    return {
        "EVENTS": ids("events", "event_id", "user_id").withColumns({"day": F.col("ts").cast("date"), "amount": F.col("value").cast("decimal(18,2)"), "meaning_of_event": F.concat(F.lit("m_"), "event_type")}),
        "ORDERS": ids("orders", "o_orderkey", "o_custkey").withColumns({"day": F.col("o_orderdate").cast("date"), "total": F.col("o_totalprice").cast("decimal(18,2)")}),
        "CUSTOMER": ids("customer", "c_custkey", "c_custkey").withColumn("day", F.lit(None).cast("date")),
    }


def _sql_rule(rule: Rule, cutoff: str | None = None, meaning: str | None = None) -> str:
    source = {
        "EVENTS": "(SELECT *, 'EVENTS' AS ori_table, event_id AS rid, user_id AS pid, CAST(ts AS DATE) AS day, CAST(value AS DECIMAL(18,2)) AS amount FROM events)",
        "ORDERS": "(SELECT *, 'ORDERS' AS ori_table, o_orderkey AS rid, o_custkey AS pid, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders)",
        "CUSTOMER": "(SELECT *, 'CUSTOMER' AS ori_table, c_custkey AS rid, c_custkey AS pid FROM customer)",
    }[rule.table]
    value = f"CAST({rule.value} AS VARCHAR)" if rule.value else "'true'"
    where = " AND ".join(f"upper(CAST({c} AS VARCHAR)) = upper('{v}')" for c, v in rule.where)
    late = f" AND {rule.date} >= DATE '{cutoff}'" if cutoff and rule.date else ""
    code = f"'{rule.code}'" if rule.code else "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT ori_table, CAST(rid AS VARCHAR) AS unique_id, CAST(pid AS VARCHAR) AS person_id, {code} AS code, {code} AS coding_system, {value} AS value, "
        f"'{rule.concept_id}' AS concept_id, {rule.date or 'CAST(NULL AS DATE)'} AS date{f', {meaning} AS meaning' if meaning else ''} FROM {source} WHERE {where}{late}"
    )


def _union(rules: list[Rule], cutoff: str | None = None, meaning: str | None = None) -> str:
    return " UNION ALL ".join(_sql_rule(r, cutoff, meaning) for r in rules)


MULTI = [
    Rule("c_purchase", "EVENTS", (("event_type", "purchase"),), "amount", "day", "D1"),
    Rule("c_error", "EVENTS", (("event_type", "Error"),), None, "day", "D2"),
    Rule("c_click", "EVENTS", (("event_type", "CLICK"),), "props", None, "D3"),
    Rule("c_any_purchase", "EVENTS", (("event_type", "purchase"),), None, None, "D4"),
]
PAIRED = [
    Rule("o_urgent", "ORDERS", (("o_orderstatus", "O"), ("o_orderpriority", "1-URGENT")), "total", "day", "P1"),
    Rule("o_low", "ORDERS", (("o_orderpriority", "5-low"), ("o_orderstatus", "f")), "o_orderpriority", "day", "P2"),
    Rule("c_building", "CUSTOMER", (("c_mktsegment", "building"),), None, None, "P3"),
    Rule("e_view", "EVENTS", (("event_type", "view"),), "event_type", "day", "P4"),
]
WIDE = [
    {"concept_id": "w_signup", "cdm_table_name": "EVENTS", "column_name_1": "event_type", "expected_value_1": "signup", "column_name_2": None, "expected_value_2": None, "keep_value_column_name": "amount", "keep_date_column_name": "day", "dap_spec_id": "W1"},
    {"concept_id": "w_done", "cdm_table_name": "ORDERS", "column_name_1": "o_orderstatus", "expected_value_1": "F", "column_name_2": "NA", "expected_value_2": "NA", "keep_value_column_name": None, "keep_date_column_name": "day", "dap_spec_id": "W2"},
    {"concept_id": "w_both", "cdm_table_name": "ORDERS", "column_name_1": "o_orderstatus", "expected_value_1": "o", "column_name_2": "o_orderpriority", "expected_value_2": "2-HIGH", "keep_value_column_name": "total", "keep_date_column_name": None, "dap_spec_id": "W3"},
]


@query(_union(PAIRED))
def concept_extract(spark, sf_dir):
    return extract_concepts(_sources(spark, sf_dir), PAIRED)


@query(_union(PAIRED, "1997-01-01"))
def concept_cutoff(spark, sf_dir):
    return extract_concepts(_sources(spark, sf_dir), PAIRED, cutoff="1997-01-01")


@query(_union([r for r in MULTI + PAIRED if r.value is None]))
def concept_flag(spark, sf_dir):
    return extract_concepts(_sources(spark, sf_dir), [r for r in MULTI + PAIRED if r.value is None])


@query(_union(MULTI, "2024-01-15"))
def concept_multi_rule(spark, sf_dir):
    return extract_concepts(_sources(spark, sf_dir), MULTI, cutoff="2024-01-15")


@query(_union(MULTI, meaning="'m_' || event_type"))
def concept_meaning(spark, sf_dir):
    return extract_concepts(_sources(spark, sf_dir), MULTI, meaning=True)


@query(_union(rules_from_wide(WIDE)))
def concept_wide_map(spark, sf_dir):
    return extract_concepts(_sources(spark, sf_dir), rules_from_wide(WIDE))


@query(_union(PAIRED[:2]))
def concept_attached(spark, sf_dir):
    """From tables of an attached namespace."""
    store = Store(spark)
    store.attach("origin", _sources(spark, sf_dir))
    return extract_concepts(store, PAIRED[:2], namespace="origin")


@query(f"SELECT concept_id, count(*) AS n, count(DISTINCT person_id) AS persons, min(date) AS first_day, max(date) AS last_day FROM ({_union(MULTI + PAIRED)}) GROUP BY concept_id")
def concept_summary(spark, sf_dir):
    found = extract_concepts(_sources(spark, sf_dir), MULTI + PAIRED)
    return found.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("person_id").alias("persons"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


# ---- files out ---------------------------------------------------------------------------------


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_concepts(_sources(spark, sf_dir), PAIRED)


@query(f"SELECT *, CAST(NULL AS VARCHAR) AS meaning FROM ({_union(PAIRED)}) UNION ALL SELECT *, CAST(NULL AS VARCHAR) FROM ({_union(PAIRED[:1])})")
def insert_concepts(spark, sf_dir):
    """Rows put behind those of a concept table that has a column more."""
    store = Store(spark)
    store.put("concepts", _concepts(spark, sf_dir).withColumn("meaning", F.lit(None).cast("string")))
    return add_to_table(store, "concepts", extract_concepts(_sources(spark, sf_dir), PAIRED[:1]))


def _appended(spark: SparkSession, sf_dir: str, partition: str | None) -> DataFrame:
    folder = fresh_path(spark, "concepts")
    append_parquet(_concepts(spark, sf_dir), folder, partition)
    append_parquet(extract_concepts(_sources(spark, sf_dir), PAIRED[:1]), folder, partition)
    return spark.read.parquet(folder)


_APPENDED = f"SELECT *, 1 AS tag FROM ({_union(PAIRED)}) UNION ALL SELECT *, 1 AS tag FROM ({_union(PAIRED[:1])})"


@query(_APPENDED)
def append_partitioned(spark, sf_dir):
    """Two appends to a folder with a folder below it for each concept."""
    return _appended(spark, sf_dir, "concept_id")


@query(_APPENDED)
def append_plain(spark, sf_dir):
    return _appended(spark, sf_dir, None)


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, 'ORDERS_20240131_late.csv' AS file
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1
""")
def removed_rows_file(spark, sf_dir):
    """The CSV of removed rows, and its name; without rows there is none."""
    kept, removed = dedup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], "keep_first", "o_orderkey")
    folder = fresh_path(spark, "removed")
    path = save_removed(removed, folder, "ORDERS", "late", date(2024, 1, 31))
    none = save_removed(kept.where("false"), folder, "NONE")
    return spark.read.option("header", True).csv(path).withColumn("file", F.lit(path.rsplit("/", 1)[1] if none is None else "?"))


_COUNTS = ("nation", "part", "supplier")


def _report(spark: SparkSession, sf_dir: str, name: str) -> str:
    store, folder = Store(spark), fresh_path(spark, "reports")
    for t in _COUNTS:
        store.put(t, table(spark, sf_dir, t))
    put(spark, f"{folder}/readme", b"")
    return write_report(row_counts(store), folder, name)


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, CAST(count(*) AS VARCHAR) AS row_count FROM {t}" for t in _COUNTS))
def report_csv(spark, sf_dir):
    return spark.read.option("header", True).csv(_report(spark, sf_dir, "counts.csv"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS row_count FROM {t}" for t in _COUNTS))
def report_substitute(spark, sf_dir):
    """The extension without a writer of its own is written as parquet."""
    return spark.read.parquet(_report(spark, sf_dir, "counts.fst"))


@query(f"""
SELECT name, outcome, CASE WHEN outcome NOT LIKE '%Error' THEN CAST({" + ".join(f"(SELECT count(*) FROM {t})" for t in _COUNTS)} AS VARCHAR) END AS rows_in_report
FROM (VALUES ('', 'ValueError'), ('.csv', 'ValueError'), ('counts', 'ValueError'), ('counts.xyz', 'ValueError'), ('counts.CSV', 'counts.csv'), ('a.b.parquet', 'a.b.parquet'), ('no folder', 'FileNotFoundError')) AS t(name, outcome)
""")
def report_dispatch(spark, sf_dir):
    """Which writer a report's name finds, and the sum of the counts in the report that it wrote."""
    found = []
    for name in ("", ".csv", "counts", "counts.xyz", "counts.CSV", "a.b.parquet", "no folder"):
        try:
            path = _report(spark, sf_dir, name) if name != "no folder" else write_report(spark.range(1), f"{fresh_path(spark, 'no')}/such", "a.csv")
            written = spark.read.parquet(path) if path.endswith("parquet") else spark.read.option("header", True).csv(path)
            found.append((name, path.rsplit("/", 1)[1], str(written.agg(F.sum(F.col("row_count").cast("long"))).first()[0])))
        except (ValueError, FileNotFoundError) as e:
            found.append((name, type(e).__name__, None))
    return spark.createDataFrame(found, "name string, outcome string, rows_in_report string")


@query("SELECT l_orderkey, l_linenumber, true AS sorted FROM lineitem")
def sorted_layout(spark, sf_dir):
    """Tables laid out by columns: every file of the saved version ascends."""
    store = Store(spark)
    store.put("LINEITEM", table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))
    apply_layout(store, [Layout("LINEITEM", ("l_orderkey", "l_linenumber"))])
    saved = store.save("LINEITEM", fresh_path(spark, "layout"))
    file, row = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    before = F.lag(F.struct("l_orderkey", "l_linenumber")).over(Window.partitionBy("file").orderBy("row"))
    return saved.select("*", file, row).select("l_orderkey", "l_linenumber", F.coalesce(before <= F.struct("l_orderkey", "l_linenumber"), F.lit(True)).alias("sorted"))


@query(_union([MULTI[2]]))
def concept_folded_pair(spark, sf_dir):
    """A rule that names a column twice, with values that are alike in upper case."""
    rule = MULTI[2]
    return extract_concepts(_sources(spark, sf_dir), [Rule(rule.concept_id, rule.table, (("event_type", "click"), ("event_type", "CLICK")), rule.value, rule.date, rule.code)])


# ---- provenance --------------------------------------------------------------------------------


def _cases(spark: SparkSession, sf_dir: str, store: Store) -> DataFrame:
    """The records behind two concepts, and a table that doesn't exist."""
    for t, df in _sources(spark, sf_dir).items():
        store.put(t, df)
    found = extract_concepts(store, [PAIRED[0], MULTI[1]]).select("ori_table", "unique_id")
    return found.unionByName(spark.createDataFrame([("NOWHERE", "1")], "ori_table string, unique_id string"))


_URGENT = "o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'"


@query(f"""
SELECT 'ORDERS' AS ori_table, CAST(o_orderkey AS VARCHAR) AS unique_id, 'o_orderpriority' AS column_origin, o_orderpriority AS value FROM orders WHERE {_URGENT}
UNION SELECT 'ORDERS', CAST(o_orderkey AS VARCHAR), 'total', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM orders WHERE {_URGENT}
UNION SELECT 'EVENTS', CAST(event_id AS VARCHAR), 'event_type', event_type FROM events WHERE event_type = 'error'
""")
def trace_values(spark, sf_dir):
    store = Store(spark)
    cases = _cases(spark, sf_dir, store)
    return origin_values(store, cases, [("ORDERS", "o_orderpriority"), ("ORDERS", "total"), ("EVENTS", "event_type"), ("EVENTS", "no_such"), ("NOWHERE", "x")])


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, 'ORDERS' AS ori_table, CAST(o_orderkey AS VARCHAR) AS unique_id FROM orders WHERE {_URGENT}")
def trace_rows(spark, sf_dir):
    store = Store(spark)
    cases = _cases(spark, sf_dir, store)
    return origin_rows(store, cases.unionByName(cases), ["ORDERS", "EVENTS"])["ORDERS"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "ori_table", "unique_id")


def _laid_out(spark: SparkSession, sf_dir: str, buckets: int, lookups: tuple[str, ...], wanted: str) -> DataFrame:
    """The orders of a database laid out by id, and those of some ids."""
    store = Store.open(spark, fresh_path(spark, "database"))
    store.put("ORDERS", _sources(spark, sf_dir)["ORDERS"])
    store.put("CASES", store.get("ORDERS").where(wanted).select("ori_table", "unique_id"))
    store.commit()
    apply_layout(store, [Layout("ORDERS", ("unique_id",), buckets, lookups), Layout("CASES", ("unique_id",), buckets)])
    store = Store.open(spark.newSession(), store.root)
    return origin_rows(store, store.get("CASES"), ["ORDERS"])["ORDERS"].select("o_orderkey", "o_custkey", "ori_table", "unique_id")


_BY_ID = "SELECT o_orderkey, o_custkey, 'ORDERS' AS ori_table, CAST(o_orderkey AS VARCHAR) AS unique_id FROM orders"


@query(f"{_BY_ID} WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_orderpriority)")
def trace_lookups(spark, sf_dir):
    """A few ids, searched for by statistics and bloom filters."""
    last = [str(r[0]) for r in table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max("o_orderkey")).select("max(o_orderkey)").collect()]  # one per priority
    return _laid_out(spark, sf_dir, 0, ("unique_id",), f"unique_id IN ({', '.join(last)})")


@query(f"{_BY_ID} WHERE {_URGENT}")
def trace_bucketed(spark, sf_dir):
    """Many ids, joined bucket by bucket."""
    return _laid_out(spark, sf_dir, 8, (), _URGENT)
