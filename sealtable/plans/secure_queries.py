"""Registered queries on encrypted tables, each with the SQL that gives the same rows.

Every query reads whole given tables, stores them encrypted under the shared
folder, and works on the stored ciphertext.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.functions import payload
from sealtable.functions.cipher import AES_CBC, PLAIN_TEXT
from sealtable.operators.keyring import Keyring
from sealtable.operators.relational import count_matching, first_rows, young_developers
from sealtable.operators.skipping import Between, Equal, build_index, read_where
from sealtable.plans import archive, jobs, runs
from sealtable.session import work_path
from sealtable.sources.columns import count_rows, open_columns, scan_columns
from sealtable.sources.files import find_files, named_files, open_files, read_files
from sealtable.sources.people import people_columns
from sealtable.sources.readers import open_sealed, read_table, scan_sealed
from sealtable.sources.writers import write_table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_keyrings: dict[str, Keyring] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_keyring(spark: SparkSession) -> Keyring:
    """One keyring per application, with keys made on the spot."""
    app = spark.sparkContext.applicationId
    if app not in _keyrings:
        _keyrings[app] = new_keyring(spark)
    return _keyrings[app]


def new_keyring(spark: SparkSession) -> Keyring:
    return Keyring.create(spark, work_path(spark, "primary"), work_path(spark, "ring"), "analytics")


def stored(df: DataFrame, keyring: Keyring, layout: str = "line", **options) -> str:
    """Write ``df`` encrypted; the path."""
    path = work_path(df.sparkSession, "sealed")
    write_table(df, path, keyring, layout=layout, **options)
    return path


def sealed_copy(df: DataFrame, layout: str = "line", **options) -> DataFrame:
    """``df`` after a trip through an encrypted table."""
    spark, keyring = df.sparkSession, session_keyring(df.sparkSession)
    path = stored(df, keyring, layout, **options)
    return read_table(spark, path, df.schema, keyring, layout=layout, codec=options.get("codec"))


def _building(segment: str = "c_mktsegment", balance: str = "c_acctbal"):
    return (F.col(segment) == "BUILDING") & F.col(balance).between(0, 5000)


def secure_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted in, filter, encrypted out; the output is then opened for the caller."""
    customer, keyring = table(spark, sf_dir, "customer"), session_keyring(spark)
    source, target = stored(customer, keyring), work_path(spark, "result")
    jobs.query_table(spark, source, target, keyring, customer.schema, keep=_building())
    return read_table(spark, target, customer.schema, keyring)


def secure_filter_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = (F.col("l_returnflag") == "R") & F.col("l_quantity").between(10, 20)
    return sealed_copy(table(spark, sf_dir, "lineitem"), "parquet").where(keep)


def secure_count_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_matching(sealed_copy(table(spark, sf_dir, "customer")), _building())


def secure_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sealed_copy(table(spark, sf_dir, "orders")).select("o_orderkey", "o_orderdate", "o_orderpriority")


def secure_projection_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of eleven columns of the columnar layout; the other bodies are not read."""
    lineitem, keyring = table(spark, sf_dir, "lineitem"), session_keyring(spark)
    path = stored(lineitem, keyring, "columns")
    return read_table(spark, path, lineitem.schema, keyring, layout="columns", columns=["l_orderkey", "l_shipdate"])


def secure_count_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count of all rows that opens nothing."""
    keyring = session_keyring(spark)
    return count_rows(spark, stored(table(spark, sf_dir, "lineitem"), keyring, "columns"))


def skipping(name: str, cluster_by: str, indexed: list[str], tests: list[Equal | Between], block_rows: int, columns: list[str] | None = None):
    """Rows of a clustered and indexed table; blocks without a match stay closed."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, keyring = table(spark, sf_dir, name), session_keyring(spark)
        path, index = stored(df, keyring, "columns", cluster_by=[cluster_by], block_rows=block_rows), work_path(spark, "index")
        build_index(spark, path, index, keyring, df.schema, indexed)
        return read_where(spark, path, index, keyring, df.schema, tests, columns)

    return query


def skipping_to_ciphertext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query on the columnar layout: skip, open, filter, seal again, open for the caller."""
    customer, keyring = table(spark, sf_dir, "customer"), session_keyring(spark)
    path = stored(customer, keyring, "columns", cluster_by=["c_mktsegment", "c_acctbal"], block_rows=256)
    index, target = work_path(spark, "index"), work_path(spark, "result")
    build_index(spark, path, index, keyring, customer.schema, ["c_mktsegment", "c_acctbal"])
    tests = [Equal("c_mktsegment", "BUILDING"), Between("c_acctbal", 0.0, 5000.0)]
    jobs.query_table(
        spark, path, target, keyring, customer.schema, input_layout="columns", output_layout="columns", index=index, tests=tests
    )
    return read_table(spark, target, customer.schema, keyring, layout="columns")


def rekey_columns_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A columnar table under a new key, read by its old index through what lies under that key."""
    orders, keyring = table(spark, sf_dir, "orders"), new_keyring(spark)
    source, target, index = stored(orders, keyring, "columns"), work_path(spark, "rekeyed"), work_path(spark, "index")
    build_index(spark, source, index, keyring, orders.schema, ["o_orderstatus"])
    keyring = keyring.add_key()
    jobs.rekey_table(spark, source, target, keyring, layout="columns")
    moved = scan_columns(spark, target, range(len(orders.columns))).where(F.col("key_id") == keyring.active_id)
    late = read_where(spark, target, index, keyring, orders.schema, [Equal("o_orderstatus", "O")])
    other = open_columns(moved, keyring, orders.schema).where("o_orderstatus <> 'O'")
    return late.unionByName(other)


def roundtrip(name: str, layout: str = "line", **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sealed_copy(table(spark, sf_dir, name), layout, **options)

    return query


def roundtrip_embeddings(spark: SparkSession, sf_dir: str, layout: str = "line") -> DataFrame:
    vectors = sealed_copy(table(spark, sf_dir, "embeddings"), layout)
    return vectors.select("vec_id", "label", F.posexplode("embedding").alias("pos", "v")).select(
        "vec_id", "label", "pos", F.col("v").cast("double").alias("v")
    )


def bulk_encrypt_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain CSV files to ciphertext."""
    orders, keyring = table(spark, sf_dir, "orders"), session_keyring(spark)
    plain, target = work_path(spark, "plain"), work_path(spark, "sealed")
    write_table(orders, plain, crypto_mode=PLAIN_TEXT)
    jobs.encrypt_table(spark, plain, target, orders.schema, keyring)
    return read_table(spark, target, orders.schema, keyring)


def bulk_decrypt_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ciphertext to plain CSV files, 8 partitions in and out."""
    orders, keyring = table(spark, sf_dir, "orders"), session_keyring(spark)
    target = work_path(spark, "plain")
    jobs.decrypt_table(
        spark, stored(orders, keyring), target, orders.schema, keyring, input_partitions=8, output_partitions=8
    )
    return read_table(spark, target, orders.schema, crypto_mode=PLAIN_TEXT)


def bulk_encrypt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain CSV files whose values have line breaks, to ciphertext."""
    docs, keyring = table(spark, sf_dir, "documents"), session_keyring(spark)
    plain, target = work_path(spark, "plain"), work_path(spark, "sealed")
    write_table(docs, plain, crypto_mode=PLAIN_TEXT, multi_line=True)
    jobs.encrypt_table(spark, plain, target, docs.schema, keyring, multi_line=True)
    return read_table(spark, target, docs.schema, keyring)


def bulk_decrypt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ciphertext to plain CSV files whose values have line breaks."""
    docs, keyring = table(spark, sf_dir, "documents"), session_keyring(spark)
    target = work_path(spark, "plain")
    jobs.decrypt_table(spark, stored(docs, keyring), target, docs.schema, keyring, multi_line=True)
    return read_table(spark, target, docs.schema, crypto_mode=PLAIN_TEXT, multi_line=True)


def transcode_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every input mode to every output mode; what arrives is counted and summed."""
    orders, keyring = table(spark, sf_dir, "orders"), session_keyring(spark)
    results = None
    for source_mode in (AES_CBC, PLAIN_TEXT):
        source = work_path(spark, "source")
        write_table(orders, source, keyring, source_mode)
        for target_mode in (AES_CBC, PLAIN_TEXT):
            target = work_path(spark, "target")
            jobs.transcode(spark, source, target, orders.schema, source_mode, target_mode, keyring)
            row = read_table(spark, target, orders.schema, keyring, target_mode).agg(
                F.lit(source_mode).alias("input_mode"),
                F.lit(target_mode).alias("output_mode"),
                F.count("*").alias("n"),
                F.sum("o_custkey").alias("custkeys"),
                F.max("o_orderdate").alias("last_date"),
            )
            results = row if results is None else results.unionByName(row)
    return results


def rekey_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotate a table to a new data key, then read what lies under that key."""
    orders = table(spark, sf_dir, "orders")
    keyring = new_keyring(spark)
    source, target = stored(orders, keyring), work_path(spark, "rekeyed")
    keyring = keyring.add_key()
    jobs.rekey_table(spark, source, target, keyring)
    rotated = scan_sealed(spark, target).where(F.col("key_id") == keyring.active_id)
    return open_sealed(rotated, keyring, orders.schema)


def two_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ring with the keys of two applications; each opens what it has sealed."""
    ring, parts = work_path(spark, "ring"), None
    for app, name, key in (("sales", "customer", "c_custkey"), ("buying", "supplier", "s_suppkey")):
        keyring = Keyring.create(spark, work_path(spark, "primary"), ring, app, shared=True)
        df = table(spark, sf_dir, name).select(F.lit(app).alias("app"), F.col(key).alias("id"))
        part = read_table(spark, stored(df, keyring), df.schema, keyring.reopened())
        parts = part if parts is None else parts.unionByName(part)
    return parts


def key_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written half under an old key and half under a new one is read as a whole."""
    orders = table(spark, sf_dir, "orders")
    keyring = new_keyring(spark)
    path = work_path(spark, "sealed")
    late = F.col("o_orderstatus") == "O"
    write_table(orders.where(~late), path, keyring)
    first = keyring.active_id
    keyring = keyring.add_key()
    write_table(orders.where(late), path, keyring, save_mode="append")
    by_key = None
    for age, key_id in ((1, first), (2, keyring.active_id)):
        part = open_sealed(scan_sealed(spark, path).where(F.col("key_id") == key_id), keyring, orders.schema)
        part = part.groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("key_id", F.lit(age))
        by_key = part if by_key is None else by_key.unionByName(part)
    return by_key


def rewrap_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change the primary key; data written before stays readable."""
    part, keyring = table(spark, sf_dir, "part"), new_keyring(spark)
    path = stored(part, keyring)
    keyring = keyring.rewrap(work_path(spark, "primary"), work_path(spark, "ring"))
    return read_table(spark, path, part.schema, keyring)


def file_layout(name: str):
    """Whole encrypted CSV files, found by name pattern beside a plain file that must be skipped."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, keyring = table(spark, sf_dir, name), session_keyring(spark)
        folder = stored(df, keyring, "file")
        write_table(df, f"{folder}/plain", crypto_mode=PLAIN_TEXT)
        return read_table(spark, folder, df.schema, keyring, layout="file")

    return query


def file_layout_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files under two keys, read as one table."""
    orders, keyring, folder = table(spark, sf_dir, "orders"), new_keyring(spark), work_path(spark, "files")
    late = F.col("o_orderstatus") == "O"
    write_table(orders.where(~late), f"{folder}/early", keyring, layout="file")
    keyring = keyring.add_key()
    write_table(orders.where(late), f"{folder}/late", keyring, layout="file")
    return read_table(spark, folder, orders.schema, keyring, layout="file")


def file_layout_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of any size read in splits, as files above 128 MB are."""
    lineitem, keyring = table(spark, sf_dir, "lineitem"), session_keyring(spark)
    return read_files(spark, stored(lineitem, keyring, "file"), keyring, lineitem.schema, whole_bytes=0)


def rekey_files_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotate whole files, in two runs as after a stop; read what is under the new key."""
    orders, keyring = table(spark, sf_dir, "orders"), new_keyring(spark)
    source, target = work_path(spark, "files"), work_path(spark, "rotated")
    for name, part in (("a", orders.where("o_orderkey % 2 = 0")), ("b", orders.where("o_orderkey % 2 = 1"))):
        write_table(part, f"{source}/{name}", keyring, layout="file")
    keyring = keyring.add_key()
    jobs.rekey_table(spark, f"{source}/a", f"{target}/a", keyring, layout="file")
    jobs.rekey_table(spark, source, target, keyring, layout="file")
    named = named_files(find_files(spark, target), keyring).where(F.col("key_id") == keyring.active_id)
    return open_files(find_files(spark, target).join(named.select("path"), "path", "left_semi"), keyring, orders.schema)


def repartition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an encrypted table written in 8, read in 8 and written plain in 8.  However large
    the table is, 8 tasks carry it; so its blocks are compressed before they are sealed."""
    lineitem, keyring = table(spark, sf_dir, "lineitem"), session_keyring(spark)
    source, target = work_path(spark, "sealed"), work_path(spark, "plain")
    write_table(lineitem, source, keyring, partitions=8, block_bytes=4096, codec="zstd")
    jobs.decrypt_table(
        spark, source, target, lineitem.schema, keyring, input_partitions=8, output_partitions=8, codec="zstd"
    )
    opened = read_table(spark, source, lineitem.schema, keyring, partitions=8, codec="zstd")
    tasks = opened.select(F.spark_partition_id().alias("task")).agg(F.count_distinct("task").alias("n")).select(F.lit("tasks_in").alias("what"), "n")
    plain = read_table(spark, target, lineitem.schema, crypto_mode=PLAIN_TEXT)
    files = plain.select(F.input_file_name().alias("file"))
    files = files.agg(F.count_distinct("file").alias("n")).select(F.lit("files_out").alias("what"), "n")
    rows = plain.agg(F.count("*").alias("n")).select(F.lit("rows").alias("what"), "n")
    return tasks.unionByName(files).unionByName(rows)


def people_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    jobs_by_key = F.array(F.lit("Developer"), F.lit("Engineer"), F.lit("Researcher"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        (F.lit(18) + key % 43).cast("int").alias("age"),
        F.element_at(jobs_by_key, (key % 3 + 1).cast("int")).alias("job"),
    )


def people_from_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people query on encrypted data whose values follow from the customers."""
    return sealed_copy(people_of_customers(spark, sf_dir)).where(young_developers()).select("name", "age", "job")


def people_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_matching(sealed_copy(people_of_customers(spark, sf_dir)), young_developers())


def people_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One drawn person per customer, with draws another engine can recompute."""
    key = F.col("c_custkey")
    drawn = table(spark, sf_dir, "customer").select(key.alias("id"), *people_columns(key, seed=7, portable=True))
    return sealed_copy(drawn)


def people_generated_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default, cheaper draws: per job, how many rows keep the promised bounds."""
    drawn = table(spark, sf_dir, "orders").select(*people_columns(F.col("o_orderkey"), seed=7))
    named = F.col("name").rlike("^[a-z]{3,7}$")
    return drawn.agg(
        F.count("*").alias("n"),
        F.count_if(named).alias("named"),
        F.min("age").alias("youngest"),
        F.max("age").alias("oldest"),
        F.count_distinct("job").alias("jobs"),
        F.min(F.length("name")).alias("shortest"),
        F.max(F.length("name")).alias("longest"),
    )


def people_csv_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row formatting: integers to text, fields joined by commas."""
    people = people_of_customers(spark, sf_dir)
    return people.select(payload.csv_line(people.schema).alias("line"))


def first_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 87 rows by key: the bound of the sample data, applied to a table."""
    return first_rows(sealed_copy(table(spark, sf_dir, "customer")), 87, "c_custkey")


def archive_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events filed under the run named in their path, archived twice, read back from the archive."""
    path = F.concat(
        F.lit("/out/"),
        F.when(F.col("event_type") == "error", "stdout").otherwise("spark-application"),
        F.lit("-run"),
        (F.col("user_id") % 8).cast("string"),
    )
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value", path.alias("path"))
    target = work_path(spark, "archive")
    runs.archive_runs(events, target, "path")
    runs.archive_runs(events.where("user_id % 8 < 3"), target, "path")
    return spark.read.option("basePath", target).parquet(target).select(
        "event_id", "ts", "value", F.col("app_id").cast("string").alias("app_id")
    )


def archive_whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with ciphertext, event log, printed lines and hidden files, each archived as a
    whole and decrypted from the archive; all lines and rows as they are found there."""
    keyring, found = session_keyring(spark), None
    archived, plain = work_path(spark, "archive"), work_path(spark, "plain")
    orders = table(spark, sf_dir, "orders")
    texts = {
        "spark-application-": table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.concat_ws(" ", "event_id", "event_type").alias("line")),
        "job-stdout": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("line")),
        ".state": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("line")),
    }
    for run in (0, 1):
        outputs, name = work_path(spark, "outputs"), f"run{run}"
        for entry, lines in texts.items():
            target = f"{outputs}/{entry}{name}" if entry.endswith("-") else f"{outputs}/{entry}"
            lines.where(F.col("k") % 2 == run).select("line").write.text(target)
        write_table(orders.where(F.col("o_custkey") % 2 == run), f"{outputs}/simplequery", keyring, layout="file")
        archive.archive_and_decrypt(spark, outputs, archived, plain, keyring, orders.schema)
        rows = read_table(spark, f"{plain}/{name}", orders.schema, crypto_mode=PLAIN_TEXT)
        rows = rows.select(F.lit(name).alias("run_id"), F.lit("result").alias("kind"), F.concat_ws(" ", "o_orderkey", "o_custkey").alias("line"))
        found = rows if found is None else found.unionByName(rows)
    lines = archive.archived_lines(spark, archived).where(~F.col("name").endswith(".crc"))
    return found.unionByName(lines.select("run_id", "kind", "line"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logged encryption jobs append one log row each."""
    keyring, log = session_keyring(spark), work_path(spark, "log")
    for name in ("orders", "part"):
        df, target = table(spark, sf_dir, name), work_path(spark, "sealed")
        runs.logged(
            spark, log, f"run-{name}", "encrypt", df, lambda d, target=target: write_table(d, target, keyring)
        )
    return spark.read.parquet(log).select("app_id", "job", "n_rows")


def _people_sql(where: str = "true", select: str = "name, age, job") -> str:
    return f"""
        with people as (
          select c_name as name, cast(18 + c_custkey % 43 as integer) as age,
                 case c_custkey % 3 when 0 then 'Developer' when 1 then 'Engineer' else 'Researcher' end as job
          from customer)
        select {select} from people where {where}"""


_YOUNG = "job = 'Developer' and age between 20 and 40"


def _drawn(label: str, lo: int, hi: int) -> str:
    return f"({lo} + ('0x' || substr(md5('7:' || c_custkey || ':{label}'), 1, 15))::bigint % {hi - lo + 1})"


_PEOPLE_DRAWN = f"""
    with base as (
      select c_custkey as id, cast({_drawn("age", 18, 60)} as integer) as age,
             ['Developer', 'Engineer', 'Researcher'][{_drawn("job", 1, 3)}] as job,
             {_drawn("name:length", 3, 7)} as len
      from customer),
    letters as (
      select id, i, chr(cast(97 + ('0x' || substr(md5('7:' || id || ':name:' || i), 1, 15))::bigint % 26 as integer)) as c
      from base, range(1, 8) t(i) where i <= len)
    select b.id, n.name, b.age, b.job
    from base b join (select id, string_agg(c, '' order by i) as name from letters group by id) n on b.id = n.id"""

QUERIES = {
    "secure_filter": secure_filter,
    "secure_filter_lineitem": secure_filter_lineitem,
    "secure_count_if": secure_count_if,
    "secure_projection": secure_projection,
    **{f"roundtrip_{t}": roundtrip(t) for t in TABLES if t != "embeddings"},
    "roundtrip_embeddings": roundtrip_embeddings,
    "roundtrip_parquet_lineitem": roundtrip("lineitem", "parquet"),
    "roundtrip_parquet_documents": roundtrip("documents", "parquet"),
    "roundtrip_single_rows_customer": roundtrip("customer", block_bytes=0),
    "roundtrip_zstd_lineitem": roundtrip("lineitem", "parquet", codec="zstd"),
    "roundtrip_zstd_documents": roundtrip("documents", codec="zstd"),
    **{f"roundtrip_columns_{t}": roundtrip(t, "columns") for t in ("lineitem", "events", "documents", "pages")},
    "roundtrip_columns_zstd_lineitem": roundtrip("lineitem", "columns", codec="zstd"),
    "roundtrip_columns_embeddings": lambda spark, sf_dir: roundtrip_embeddings(spark, sf_dir, "columns"),
    "secure_projection_columns": secure_projection_columns,
    "secure_count_columns": secure_count_columns,
    "skipping_range_lineitem": skipping(
        "lineitem", "l_orderkey", ["l_orderkey", "l_returnflag"],
        [Between("l_orderkey", 1000, 1400), Equal("l_returnflag", "R")], 2048,
    ),
    "skipping_value_orders": skipping(
        "orders", "o_custkey", ["o_custkey"], [Equal("o_custkey", 77)], 512, ["o_orderkey", "o_totalprice"]
    ),
    "skipping_dates_events": skipping(
        "events", "ts", ["ts", "event_type"],
        [Between("ts", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)), Equal("event_type", "click")], 1024,
    ),
    "skipping_to_ciphertext": skipping_to_ciphertext,
    "rekey_columns_orders": rekey_columns_orders,
    "roundtrip_json_events": lambda spark, sf_dir: _json_copy(table(spark, sf_dir, "events")),
    "bulk_encrypt_orders": bulk_encrypt_orders,
    "bulk_decrypt_orders": bulk_decrypt_orders,
    "bulk_encrypt_documents": bulk_encrypt_documents,
    "bulk_decrypt_documents": bulk_decrypt_documents,
    "transcode_matrix": transcode_matrix,
    "two_applications": two_applications,
    "rekey_orders": rekey_orders,
    "key_usage": key_usage,
    "rewrap_part": rewrap_part,
    "file_layout_nation": file_layout("nation"),
    "file_layout_orders": file_layout("orders"),
    "file_layout_two_keys": file_layout_two_keys,
    "file_layout_splits_lineitem": file_layout_splits,
    "rekey_files_orders": rekey_files_orders,
    "repartition_counts": repartition_counts,
    "people_from_customer": people_from_customer,
    "people_count": people_count,
    "people_generated": people_generated,
    "people_generated_bounds": people_generated_bounds,
    "people_csv_line": people_csv_line,
    "first_customers": first_customers,
    "archive_by_run": archive_by_run,
    "archive_whole_run": archive_whole_run,
    "run_log": run_log,
}


def _json_copy(df: DataFrame) -> DataFrame:
    spark, keyring = df.sparkSession, session_keyring(df.sparkSession)
    return read_table(spark, stored(df, keyring, fmt="json"), df.schema, keyring, fmt="json")


ORACLES = {
    "secure_filter": "select * from customer where c_mktsegment = 'BUILDING' and c_acctbal between 0 and 5000",
    "secure_filter_lineitem": "select * from lineitem where l_returnflag = 'R' and l_quantity between 10 and 20",
    "secure_count_if": """select count(*) filter (where c_mktsegment = 'BUILDING' and c_acctbal between 0 and 5000) as n
        from customer""",
    "secure_projection": "select o_orderkey, o_orderdate, o_orderpriority from orders",
    **{f"roundtrip_{t}": f"select * from {t}" for t in TABLES if t != "embeddings"},
    "roundtrip_embeddings": """
        select vec_id, label, cast(generate_subscripts(embedding, 1) - 1 as integer) as pos,
               cast(unnest(embedding) as double) as v
        from embeddings""",
    "roundtrip_columns_embeddings": """
        select vec_id, label, cast(generate_subscripts(embedding, 1) - 1 as integer) as pos,
               cast(unnest(embedding) as double) as v
        from embeddings""",
    "roundtrip_parquet_lineitem": "select * from lineitem",
    "roundtrip_parquet_documents": "select * from documents",
    "roundtrip_single_rows_customer": "select * from customer",
    "roundtrip_zstd_lineitem": "select * from lineitem",
    "roundtrip_zstd_documents": "select * from documents",
    **{f"roundtrip_columns_{t}": f"select * from {t}" for t in ("lineitem", "events", "documents", "pages")},
    "roundtrip_columns_zstd_lineitem": "select * from lineitem",
    "secure_projection_columns": "select l_orderkey, l_shipdate from lineitem",
    "secure_count_columns": "select count(*) as n from lineitem",
    "skipping_range_lineitem": "select * from lineitem where l_orderkey between 1000 and 1400 and l_returnflag = 'R'",
    "skipping_value_orders": "select o_orderkey, o_totalprice from orders where o_custkey = 77",
    "skipping_dates_events": """
        select * from events where ts between timestamp '2024-01-02' and timestamp '2024-01-03' and event_type = 'click'""",
    "skipping_to_ciphertext": "select * from customer where c_mktsegment = 'BUILDING' and c_acctbal between 0 and 5000",
    "rekey_columns_orders": "select * from orders",
    "roundtrip_json_events": "select * from events",
    "bulk_encrypt_orders": "select * from orders",
    "bulk_decrypt_orders": "select * from orders",
    "bulk_encrypt_documents": "select * from documents",
    "bulk_decrypt_documents": "select * from documents",
    "two_applications": """
        select 'sales' as app, c_custkey as id from customer union all select 'buying', s_suppkey from supplier""",
    "transcode_matrix": f"""
        with modes(m) as (values ('{AES_CBC}'), ('{PLAIN_TEXT}'))
        select a.m as input_mode, b.m as output_mode, n, custkeys, last_date
        from modes a, modes b,
             (select count(*) as n, cast(sum(o_custkey) as bigint) as custkeys, max(o_orderdate) as last_date
              from orders)""",
    "rekey_orders": "select * from orders",
    "key_usage": """
        select o_orderstatus, count(*) as n, case when o_orderstatus = 'O' then 2 else 1 end as key_id
        from orders group by o_orderstatus""",
    "rewrap_part": "select * from part",
    "file_layout_nation": "select * from nation",
    "file_layout_orders": "select * from orders",
    "file_layout_two_keys": "select * from orders",
    "file_layout_splits_lineitem": "select * from lineitem",
    "rekey_files_orders": "select * from orders",
    "repartition_counts": """
        select 'tasks_in' as what, 8 as n union all select 'files_out', 8
        union all select 'rows', count(*) from lineitem""",
    "people_from_customer": _people_sql(_YOUNG),
    "people_count": _people_sql(select=f"count(*) filter (where {_YOUNG}) as n"),
    "people_generated": _PEOPLE_DRAWN,
    "people_generated_bounds": """
        select count(*) as n, count(*) as named, 18 as youngest, 60 as oldest, cast(3 as bigint) as jobs, 3 as shortest, 7 as longest
        from orders""",
    "people_csv_line": _people_sql(select="'\"' || name || '\",' || age || ',\"' || job || '\"' as line"),
    "first_customers": "select * from customer order by c_custkey limit 87",
    "archive_by_run": """
        select event_id, ts, value, 'run' || (user_id % 8) as app_id from events where event_type <> 'error'""",
    "archive_whole_run": """
        select 'run' || (user_id % 2) as run_id, 'event log' as kind, event_id || ' ' || event_type as line from events
        union all select 'run' || (c_custkey % 2), 'stdout', c_name from customer
        union all select 'run' || (s_suppkey % 2), 'hidden', s_name from supplier
        union all select 'run' || (o_custkey % 2), 'result', o_orderkey || ' ' || o_custkey from orders""",
    "run_log": """
        select 'run-orders' as app_id, 'encrypt' as job, count(*) as n_rows from orders
        union all select 'run-part', 'encrypt', count(*) from part""",
}
