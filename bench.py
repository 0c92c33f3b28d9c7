"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local
threads, BENCH_RUNS how often each query is timed after one untimed run (the
median counts).
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sealtable.functions import payload  # noqa: E402
from sealtable.plans import jobs, text_queries  # noqa: E402
from sealtable.plans.secure_queries import new_keyring, stored, table  # noqa: E402
from sealtable.session import builder, work_path  # noqa: E402
from sealtable.operators.skipping import Between, build_index, read_where  # noqa: E402
from sealtable.sources.columns import seal_columns  # noqa: E402
from sealtable.sources.files import read_files  # noqa: E402
from sealtable.sources.readers import open_sealed, read_table, scan_sealed  # noqa: E402
from sealtable.sources.writers import seal_files, seal_rows, write_table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        builder("bench")
        .master(f"local[{CPUS}]")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    keyring = new_keyring(spark)
    # The given files hold one row group each, which is one task however many threads
    # there are.  Both the plain and the encrypted cases start from a copy in several files.
    copies = work_path(spark, "copy")
    for name in ("lineitem", "orders"):
        table(spark, SF_DIR, name).repartition(int(CPUS)).write.parquet(f"{copies}/{name}.parquet")
    lineitem, orders = table(spark, copies, "lineitem"), table(spark, copies, "orders")
    keep = (F.col("l_returnflag") == "R") & F.col("l_quantity").between(10, 20)

    sealed = stored(lineitem, keyring)
    sealed_columnar = stored(lineitem, keyring, "parquet")
    sealed_zstd = stored(lineitem, keyring, "parquet", codec="zstd")
    columns = stored(lineitem, keyring, "columns")
    ordered, index = work_path(spark, "ordered"), work_path(spark, "index")
    write_table(lineitem, ordered, keyring, layout="columns", cluster_by=["l_orderkey"], block_rows=4096)
    build_index(spark, ordered, index, keyring, lineitem.schema, ["l_orderkey"])
    some = [Between("l_orderkey", 1000, 1400)]
    files = stored(lineitem, keyring, "file")
    old_orders = stored(orders, keyring)
    rotated = keyring.add_key()
    mb = payload.encode(lineitem, "csv").agg(F.sum(F.octet_length("line") + 1)).first()[0] / 1e6

    def text(name):
        return lambda: drain(text_queries.QUERIES[name](spark, SF_DIR))

    cases = {
        "plain_filter": lambda: drain(lineitem.where(keep)),
        "secure_filter": lambda: drain(read_table(spark, sealed, lineitem.schema, keyring).where(keep)),
        "secure_filter_columnar": lambda: drain(
            read_table(spark, sealed_columnar, lineitem.schema, keyring, layout="parquet").where(keep)
        ),
        "secure_filter_zstd": lambda: drain(
            read_table(spark, sealed_zstd, lineitem.schema, keyring, layout="parquet", codec="zstd").where(keep)
        ),
        "columns_read": lambda: drain(read_table(spark, columns, lineitem.schema, keyring, layout="columns")),
        "columns_read_two_of_eleven": lambda: drain(
            read_table(spark, columns, lineitem.schema, keyring, layout="columns", columns=["l_orderkey", "l_shipdate"])
        ),
        "columns_filter": lambda: drain(
            read_table(spark, columns, lineitem.schema, keyring, layout="columns").where(keep)
        ),
        "columns_skipping": lambda: drain(read_where(spark, ordered, index, keyring, lineitem.schema, some)),
        "encrypt_columns": lambda: drain(seal_columns(lineitem, keyring)),
        "files_read_in_splits": lambda: drain(read_files(spark, files, keyring, lineitem.schema, whole_bytes=0)),
        "secure_query_to_ciphertext": lambda: jobs.query_table(
            spark, sealed, work_path(spark, "out"), keyring, lineitem.schema, keep=keep
        ),
        "secure_count": lambda: read_table(spark, sealed, lineitem.schema, keyring).agg(F.count_if(keep)).collect(),
        "encrypt": lambda: drain(seal_rows(lineitem, keyring)),
        "encrypt_zstd": lambda: drain(seal_rows(lineitem, keyring, codec="zstd")),
        "encrypt_files": lambda: drain(seal_files(lineitem, keyring)),
        "encrypt_and_write": lambda: stored(lineitem, keyring),
        "decrypt": lambda: drain(read_table(spark, sealed, lineitem.schema, keyring)),
        "decrypt_to_csv": lambda: jobs.decrypt_table(
            spark, sealed, work_path(spark, "plain"), lineitem.schema, keyring
        ),
        "rekey_orders": lambda: drain(jobs.rekeyed(scan_sealed(spark, old_orders), rotated)),
        "open_orders": lambda: drain(open_sealed(scan_sealed(spark, old_orders), keyring, orders.schema)),
        "text_containing": text("text_containing"),
        "text_after_marker": text("text_after_marker"),
        "line_table_after_marker": text("line_table_after_marker"),
        "text_last_value": text("text_last_value"),
        "line_table_last_value": text("line_table_last_value"),
        "text_numeric_sort": text("text_numeric_sort"),
        "items_joined": text("items_joined"),
        "items_joined_in_parts": text("items_joined_in_parts"),
        "text_digest": text("text_digest"),
    }
    seconds = {}
    for name, run in cases.items():
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 4)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(pathlib.Path(SF_DIR).name.removeprefix("sf") or 0),
                "lineitem_mb": round(mb, 1),
                "encrypt_mb_per_s": round(mb / seconds["encrypt"], 1),
                "decrypt_mb_per_s": round(mb / seconds["decrypt"], 1),
                "secure_over_plain_filter": round(seconds["secure_filter"] / seconds["plain_filter"], 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
