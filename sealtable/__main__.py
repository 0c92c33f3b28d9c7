"""Command line of the jobs, for ``spark-submit`` or ``python -m sealtable``.

    generate-keys    new primary key and keyring
    add-key          new active data key
    generate-people  the sample table as plain CSV, and the count its query must give
    encrypt          plain CSV to ciphertext
    decrypt          ciphertext to plain CSV
    query            filtered rows, any mode in, any mode out
    rekey            rotate a table to the active data key
    index            index columns of a table in the columns layout, for --equals and --between
    archive          file the text outputs of runs under their ids
    archive-run      archive all files of one run and decrypt its result from the archive
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.functions import payload
from sealtable.functions.cipher import AES_CBC, PLAIN_TEXT
from sealtable.operators.keyring import Keyring
from sealtable.operators.relational import PEOPLE_SCHEMA, count_matching, young_developers
from sealtable.operators.skipping import Between, Equal, build_index, read_where
from sealtable.plans import archive, jobs, runs
from sealtable.session import builder
from sealtable.sources.people import SAMPLE_ROWS, people
from sealtable.sources.readers import read_table
from sealtable.sources.writers import write_plain, write_table

# Names of job options are those of the command lines to be matched.
LAYOUTS = ["line", "parquet", "columns", "file"]
MODES = {"encrypt": (PLAIN_TEXT, AES_CBC), "decrypt": (AES_CBC, PLAIN_TEXT), "query": (AES_CBC, AES_CBC)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sealtable", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, keys: bool = True, source: bool = True, target: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        if keys:
            p.add_argument("--primaryKeyPath", required=True)
            p.add_argument("--dataKeyPath", required=True)
            p.add_argument("--kmsType", default="local")
            p.add_argument("--appId", required=True)
        if source:
            p.add_argument("--inputPath", required=True)
            p.add_argument("--inputPartitionNum", type=int)
        if target:
            p.add_argument("--outputPath", required=True)
            p.add_argument("--outputPartitionNum", type=int)
        return p

    command("generate-keys", source=False, target=False).add_argument("--keyBytes", type=int, default=32)
    command("add-key", source=False, target=False).add_argument("--keyBytes", type=int, default=32)
    made = command("generate-people", keys=False, source=False)
    made.add_argument("--rows", type=int, default=SAMPLE_ROWS)
    made.add_argument("--seed", type=int, default=0)
    command("rekey").add_argument("--layout", default="line", choices=LAYOUTS)
    indexed = command("index")
    indexed.add_argument("--schema", default=PEOPLE_SCHEMA)
    indexed.add_argument("--columns", required=True, help="names of columns, with commas")
    command("archive", keys=False)
    whole = command("archive-run")
    whole.add_argument("--archivePath", required=True)
    whole.add_argument("--layout", default="file", choices=LAYOUTS)
    whole.add_argument("--schema", default=PEOPLE_SCHEMA)
    whole.add_argument("--stdout", default="job-stdout", help="name of the file or folder of printed lines")
    for name, (read, write) in MODES.items():
        p = command(name)
        p.add_argument("--inputEncryptModeValue", default=read, choices=[AES_CBC, PLAIN_TEXT])
        p.add_argument("--outputEncryptModeValue", default=write, choices=[AES_CBC, PLAIN_TEXT])
        p.add_argument("--inputLayout", default="line", choices=LAYOUTS)
        p.add_argument("--outputLayout", default="line", choices=LAYOUTS)
        p.add_argument("--inputKeyId", type=int, help="key of files that do not name theirs (file layout)")
        p.add_argument("--clusterBy", help="sort the output by ranges of these columns, with commas")
        p.add_argument("--schema", default=PEOPLE_SCHEMA, help="column names and types, as in a table definition")
        p.add_argument("--codec", choices=["zstd"], help="compression inside encrypted blocks")
        p.add_argument("--multiLine", action="store_true", help="values of plain files may have line breaks")
        p.add_argument("--runLog", help="folder of the run log; one row is added")
        if name == "query":
            p.add_argument("--where", help="SQL condition; default: developers aged 20 to 40")
            p.add_argument("--columns", help="names of columns to return, with commas")
            p.add_argument("--index", help="index of the input; blocks without a match stay closed")
            p.add_argument("--equals", action="append", default=[], metavar="COLUMN=VALUE")
            p.add_argument("--between", action="append", default=[], metavar="COLUMN=LOW,HIGH")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or builder("sealtable").getOrCreate()
    if args.command == "generate-keys":
        Keyring.create(spark, args.primaryKeyPath, args.dataKeyPath, args.appId, args.kmsType, args.keyBytes)
    elif args.command == "generate-people":
        made = people(spark, args.rows, args.seed)
        write_plain(made, args.outputPath, args.outputPartitionNum)
        count = count_matching(made, young_developers()).first().n
        print(f"Number of developers aged between 20 and 40 is {count}")
    elif args.command == "archive":
        runs.archive_runs(runs.text_outputs(spark, args.inputPath), args.outputPath, "entry")
    else:
        with_keys(spark, args)


def input_rows(spark: SparkSession, args: argparse.Namespace, keyring: Keyring) -> DataFrame:
    return read_table(
        spark, args.inputPath, args.schema, keyring, args.inputEncryptModeValue, args.inputLayout,
        partitions=args.inputPartitionNum, codec=args.codec, multi_line=args.multiLine,
        key_id=args.inputKeyId,
    )


def query_rows(spark: SparkSession, args: argparse.Namespace, keyring: Keyring) -> DataFrame:
    """Rows that pass all conditions; values on the command line are cast to their columns' types."""
    schema = payload.as_schema(args.schema)
    tests: list[Equal | Between] = []

    def typed(column: str, text: str):
        cast = spark.range(1).select(F.lit(text).cast(schema[column].dataType).alias("v"))
        return cast.first().v

    for name, _, value in (x.partition("=") for x in args.equals):
        tests.append(Equal(name, typed(name, value)))
    for name, _, ends in (x.partition("=") for x in args.between):
        low, high = ends.split(",")
        tests.append(Between(name, typed(name, low) if low else None, typed(name, high) if high else None))
    wanted = args.columns.split(",") if args.columns else schema.names
    if args.index and args.inputLayout != "columns":
        raise ValueError("only the columns layout has an index")
    if args.index and tests:
        rows = read_where(spark, args.inputPath, args.index, keyring, schema, tests)
    else:
        rows = input_rows(spark, args, keyring)
        for test in tests:
            rows = rows.where(test.rows())
    if args.where or not tests:
        rows = rows.where(F.expr(args.where) if args.where else young_developers())
    return rows.select(*[payload.column(c) for c in wanted])


def with_keys(spark: SparkSession, args: argparse.Namespace) -> None:
    keyring = Keyring.open(spark, args.primaryKeyPath, args.dataKeyPath, args.appId, args.kmsType)
    if args.command == "add-key":
        keyring.add_key(args.keyBytes)
        return
    if args.command == "rekey":
        jobs.rekey_table(spark, args.inputPath, args.outputPath, keyring, args.layout, args.outputPartitionNum)
        return
    if args.command == "archive-run":
        archive.archive_and_decrypt(
            spark, args.inputPath, args.archivePath, args.outputPath, keyring, args.schema, args.layout, args.stdout,
            partitions=args.outputPartitionNum,
        )
        return
    if args.command == "index":
        build_index(spark, args.inputPath, args.outputPath, keyring, args.schema, args.columns.split(","))
        return
    if args.inputPath.rstrip("/") == args.outputPath.rstrip("/"):
        raise ValueError("input and output must be different folders")
    rows = query_rows(spark, args, keyring) if args.command == "query" else input_rows(spark, args, keyring)

    def write(df):
        write_table(
            df, args.outputPath, keyring, args.outputEncryptModeValue, args.outputLayout,
            partitions=args.outputPartitionNum, have_partitions=args.inputPartitionNum, codec=args.codec,
            multi_line=args.multiLine, cluster_by=args.clusterBy.split(",") if args.clusterBy else (),
        )

    if args.runLog:
        runs.logged(spark, args.runLog, spark.sparkContext.applicationId, args.command, rows, write)
    else:
        write(rows)


if __name__ == "__main__":
    main(sys.argv[1:])
