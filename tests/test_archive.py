"""Archiving whole runs, and exact row counts of the run log."""

import hashlib
import pathlib

import pytest

from sealtable.plans import archive as ar
from sealtable.plans import runs
from sealtable.plans.secure_queries import table
from sealtable.session import work_path
from sealtable.sources.readers import read_table
from sealtable.sources.writers import write_table

SF = "/root/testdata/sf0.01"


def local(path):
    return pathlib.Path(path.removeprefix("file://"))


def run_outputs(spark, keyring, run, df, log_lines=("one", "two", "three")):
    folder = work_path(spark, "outputs")
    write_table(df, f"{folder}/simplequery", keyring, layout="file")
    root = local(folder)
    (root / f"spark-application-{run}").write_text("\n".join(log_lines) + "\n")
    (root / "job-stdout").write_text("printed\nwithout end")
    (root / "simplequery" / ".part.crc").write_bytes(b"\0\1\xff\n")
    (root / ".state").mkdir()
    (root / ".state" / "empty").write_text("")
    return folder


def test_all_kinds_of_files_with_line_numbers(spark, keyring):
    df = table(spark, SF, "part")
    folder, archive, plain = run_outputs(spark, keyring, "17", df), work_path(spark, "archive"), work_path(spark, "plain")
    assert ar.archive_and_decrypt(spark, folder, archive, plain, keyring, df.schema, partitions=8) == "17"
    rows = {r.name: r for r in ar.manifest(spark, archive).collect()}
    files = {str(p.relative_to(local(folder))): p for p in local(folder).rglob("*") if p.is_file()}
    assert set(rows) == set(files)
    for name, row in rows.items():
        raw = files[name].read_bytes()
        assert (row.bytes, row.sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert local(row.path).read_bytes() == raw
    kinds = {r.kind for r in rows.values()}
    assert kinds == {ar.EVENT_LOG, ar.RESULT, ar.STDOUT, ar.HIDDEN}
    assert (rows["job-stdout"].lines, rows[".state/empty"].lines, rows["spark-application-17"].lines) == (2, 0, 3)
    lines = sorted((r.name, r.line_no, r.line) for r in ar.archived_lines(spark, archive).collect())
    assert ("job-stdout", 1, "without end") in lines and ("spark-application-17", 2, "three") in lines
    assert ("simplequery/.part.crc", 0, "\0\1�") in lines and len(lines) == 6
    back = read_table(spark, f"{plain}/17", df.schema, crypto_mode="plain_text")
    assert back.exceptAll(df).count() == 0 and back.count() == df.count()
    log = spark.read.parquet(f"{archive}/log").collect()
    assert [(r.app_id, r.job, r.n_rows) for r in log] == [("17", "decrypt", df.count())]


def test_archiving_again_replaces_the_run_and_failure_leaves_it(spark, keyring, monkeypatch):
    df, archive = table(spark, SF, "nation"), work_path(spark, "archive")
    ar.archive_run(spark, run_outputs(spark, keyring, "1", df, ["old"]), archive)
    ar.archive_run(spark, run_outputs(spark, keyring, "2", df, ["other"]), archive)

    def logs():
        return sorted((r.run_id, r.line) for r in ar.archived_lines(spark, archive, [ar.EVENT_LOG]).collect())

    assert logs() == [("1", "old"), ("2", "other")]
    folder = run_outputs(spark, keyring, "1", df, ["new"])
    listed = ar.outputs_of(folder, "job-stdout")
    monkeypatch.setattr(ar, "outputs_of", lambda *a: [*listed, ("simplequery/gone.csv.cbc", ar.RESULT, 5)])
    with pytest.raises(Exception, match="gone.csv.cbc"):
        ar.archive_run(spark, folder, archive)
    assert logs() == [("1", "old"), ("2", "other")]
    monkeypatch.setattr(ar, "outputs_of", lambda *a: listed)
    ar.archive_run(spark, folder, archive)
    assert logs() == [("1", "new"), ("2", "other")]
    assert read_table(spark, ar.run_folder(spark, archive, "1"), df.schema, keyring, layout="file").count() == 25
    with pytest.raises(ValueError, match="not archived"):
        ar.run_folder(spark, archive, "3")


def test_damage_is_found(spark, keyring):
    df, archive = table(spark, SF, "region"), work_path(spark, "archive")
    ar.archive_run(spark, run_outputs(spark, keyring, "5", df), archive)
    assert ar.damaged(spark, archive).count() == 0
    folder = local(ar.run_folder(spark, archive, "5"))
    (folder / "job-stdout").write_text("other")
    (folder / ".state" / "empty").unlink()
    found = {r.name: r.found for r in ar.damaged(spark, archive).collect()}
    assert set(found) == {"job-stdout", ".state/empty"} and found[".state/empty"] is None


def test_one_run_at_a_time():
    assert ar.run_of(["spark-application-a-7/x", "simplequery/y"]) == "7"
    for names in ([], ["simplequery/y"], ["spark-application-1", "spark-application-2"]):
        with pytest.raises(ValueError, match="one run"):
            ar.run_of(names)


def test_tasks_that_run_again_count_once(spark):
    """Every task reports twice, as copies of slow tasks and lost executors make it."""
    df = spark.range(0, 1000, 1, 8)
    rows, n_rows = runs.counted(df)
    for _ in range(2):
        rows.write.format("noop").mode("overwrite").save()
    assert n_rows() == 1000


def test_a_failing_task_counts_its_rows_once(spark, tmp_path):
    """A task that dies after half of its rows and then succeeds."""
    import os
    import subprocess
    import sys
    import textwrap

    code = textwrap.dedent(f"""
        import pathlib
        from pyspark import TaskContext
        from sealtable.session import builder
        from sealtable.plans import runs
        spark = builder("retry").master("local[2,3]").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        seen = pathlib.Path("{tmp_path}/seen")
        def once(batches):
            for batch in batches:
                yield batch
            if TaskContext.get().partitionId() == 1 and not seen.exists():
                seen.write_text("x")
                raise RuntimeError("lost")
        def write(df):
            df.mapInArrow(once, df.schema).repartition(3).write.parquet("{tmp_path}/out")
        runs.logged(spark, "{tmp_path}/log", "a", "copy", spark.range(0, 5000, 1, 4), write)
        print("rows", spark.read.parquet("{tmp_path}/log").first().n_rows, seen.exists())
    """)
    env = os.environ | {"PYTHONPATH": str(pathlib.Path(runs.__file__).parents[2])}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=300)
    assert "rows 5000 True" in done.stdout, done.stderr[-2000:]
