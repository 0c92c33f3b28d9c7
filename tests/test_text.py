"""Text operators against plain Python on small inputs."""

import base64
import hashlib
import fractions
import random
import re

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from sealtable.functions import text as tx
from sealtable.operators import lines as ln
from sealtable.operators.ranking import number_rows
from sealtable.plans import runs


def values(spark, expr, *inputs):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


@pytest.fixture(scope="module", autouse=True)
def text_column(spark):
    """``S`` is the text column of the small tables; a column needs a running session."""
    global S
    S = F.col("s")


def test_fields(spark):
    lines = ["a b c", "  lead  b\tc ", "", "one", "\t"]
    assert values(spark, tx.field(S, 1), *lines) == ["a", "lead", "", "one", ""]
    assert values(spark, tx.field(S, 3), *lines) == ["c", "c", "", "", ""]
    first, rest = tx.first_and_rest(S)
    assert values(spark, first, *lines) == ["a", "lead", "", "one", ""]
    assert values(spark, rest, *lines) == ["b c", "b\tc", "", "", ""]


def test_replace_group(spark):
    got = values(spark, tx.replace_group(S, "[^=]*=(.*)", "$1"), "A_1=x", "none", "k=a=b", "=")
    assert got == ["x", "none", "a=b", ""]


def test_characters(spark):
    assert values(spark, tx.map_chars(S, " ", ","), "a b  c") == ["a,b,,c"]
    assert values(spark, tx.delete_chars(S, r"[\s-]"), "abc  -\n", "\t\v\f\r-") == ["abc", ""]


def test_fill_order_and_first_only(spark):
    swap = tx.fill(S, [("A", "B"), ("B", "C")])
    assert values(spark, swap, "A B") == ["C C"]
    once = tx.fill(S, [("XX", "long value"), ("Y", F.concat(S, F.lit("!")))], first_only=["XX"])
    assert values(spark, once, "XX-XX", "no", "Y") == ["long value-XX", "no", "Y!"]


def test_json_fields(spark):
    both = tx.json_fields(S, ["$.result.key", "$.result.id"])
    got = values(spark, both, '{"result":{"key":"k","id":"i"}}', '{"result":{"id":"i"}}', "{}", "no json")
    assert got == ["k i", " i", " ", " "]


def test_base64(spark):
    text = "é" * 120
    code = base64.b64encode(text.encode()).decode()
    assert values(spark, tx.to_base64(S), text, "") == [code, ""]
    assert values(spark, tx.from_base64(S), code) == [text]
    wrapped = "\n".join(code[i : i + 76] for i in range(0, len(code), 76))
    assert values(spark, tx.to_base64(S, wrap=76), text, "x" * 57) == [wrapped, base64.b64encode(b"x" * 57).decode()]


def test_digest(spark):
    assert values(spark, tx.hex_digest(S), "abc") == [hashlib.sha512(b"abc").hexdigest()]


def test_paths(spark):
    paths = ["/out/spark-application-17", "plain", "a-b-", "/x%y_z"]
    assert values(spark, tx.after_last(S, "-"), *paths) == ["17", "plain", "", "/x%y_z"]
    assert values(spark, tx.glob_match(S, "*spark-application*"), *paths) == [True, False, False, False]
    assert values(spark, tx.glob_match(S, "*%y_?"), *paths) == [False, False, False, True]
    with pytest.raises(ValueError):
        tx.glob_match(S, "[ab]")


def test_prefix_and_route(spark):
    assert values(spark, tx.prefixed(S), "x", "") == ["    x", "    "]
    routes = {"spark": ["driver", "executor"], "none": [""]}
    got = values(spark, tx.route(S, routes, "pass"), "driver", "executor", "", None, "other")
    assert got == ["spark", "spark", "none", "none", "pass"]


def test_numeric_part(spark):
    lines = ["A_B_C_10=x", "A_B_C_9", "A_B_C_x", "A_B", "A_B_C_-3=", "A_B_C_ 2.50_7", "A_B_C_"]
    got = [tuple(v) for v in values(spark, tx.numeric_part(S, "_", 4), *lines)]
    assert got[:3] == [(1, 2, "10", ""), (1, 1, "9", ""), (0, 0, "", "")] and got[4:6] == [(-1, -1, "6", "~"), (1, 1, "2", "5")]


def test_numbers_of_any_length_sort_like_numbers(spark):
    rng = random.Random(1)
    texts = ["0", "-0", "00.0", "", "x", "-", ".5", "-.5", "1.50", "1.5", "-1.5", "-1.55", "-1.49", "007", "7", "." , "1" + "0" * 39]
    texts += ["-" + "9" * 40, "9" * 40 + ".25", "9" * 40 + ".3", "123456789012345678901234567890", "5", "0." + "0" * 30 + "1"]
    for _ in range(200):
        texts.append(rng.choice(["", "-"]) + "".join(rng.choice("0123456789") for _ in range(rng.randrange(0, 45))) +
                     rng.choice(["", "."]) + "".join(rng.choice("0123456789") for _ in range(rng.randrange(0, 15))))

    def number(t):
        found = re.match(r"-?[0-9]*\.?[0-9]*", t)[0]
        return fractions.Fraction(found) if re.search("[0-9]", found) else fractions.Fraction(0)

    df = spark.createDataFrame([(i, 0, f"a_b_c_{t}") for i, t in enumerate(texts)], "doc_id int, line_no int, line string")
    numbered = ln.numbered_by_number(df, "_", 4).orderBy("pos").collect()
    key = lambda i: (number(texts[i]), f"a_b_c_{texts[i]}", i)
    assert [r.doc_id for r in numbered] == sorted(range(len(texts)), key=key)


def test_numeric_sort(spark):
    lines = ["A_B_C_10=x", "A_B_C_9=b", "A_B_C_9=a", "zzz", "A_B_C_-3=", "A_B_C_x"]
    df = spark.createDataFrame([(i, 0, s) for i, s in enumerate(lines)], "doc_id int, line_no int, line string")
    expected = ["A_B_C_-3=", "A_B_C_x", "zzz", "A_B_C_9=a", "A_B_C_9=b", "A_B_C_10=x"]
    assert [r.line for r in ln.sorted_by_number(df, "_", 4).collect()] == expected
    numbered = ln.numbered_by_number(df, "_", 4).orderBy("pos").collect()
    assert [r.line for r in numbered] == expected
    assert [r.pos for r in numbered] == [1, 2, 3, 4, 5, 6]


# ---- line after a marker ------------------------------------------------


def walked(lines, is_marker):
    """What a line-by-line walk takes."""
    out, i = [], 0
    while i < len(lines):
        if is_marker(lines[i]) and i + 1 < len(lines):
            out.append(i + 1)
            i += 1
        i += 1
    return out


def test_adjacent_markers(spark):
    text = "\n".join(["M1", "M2", "M3", "x", "M4", "y", "M5"])
    assert values(spark, tx.lines_after(S, "^M"), text, "", "M", "x", "M\n\nM\n") == [["M2", "x", "y"], [], [], [], ["", ""]]


@pytest.mark.parametrize("chunk_lines", [1, 2, 3, 7, 65_536])
def test_line_table_agrees_with_a_walk(spark, chunk_lines):
    rng = random.Random(chunk_lines)
    docs = {d: [rng.choice(["M", "x"] if d % 2 else ["M", "M", "M", "x"]) + str(i) for i in range(rng.randint(1, 60))] for d in range(40)}
    docs[40] = [f"M{i}" for i in range(200)]
    docs[None] = ["M0", "x1", "M2"]
    rows = [(d, 5 + i, line) for d, lines in docs.items() for i, line in enumerate(lines)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id int, line_no int, line string")
    got = ln.lines_after_marker(df, "^M", chunk_lines=chunk_lines)
    expected = {(d, 5 + i, lines[i]) for d, lines in docs.items() for i in walked(lines, lambda x: x[0] == "M")}
    assert {tuple(r) for r in got.collect()} == expected
    texts = spark.createDataFrame([(d, "\n".join(lines)) for d, lines in docs.items()], "doc_id int, s string")
    by_text = texts.select("doc_id", F.explode(tx.lines_after(S, "^M")).alias("line"))
    assert sorted(map(str, ({(r.doc_id, r.line) for r in by_text.collect()}))) == sorted(map(str, {(d, x) for d, _, x in expected}))


def test_line_table_with_gaps(spark):
    rows = [(1, 10 * i, s) for i, s in enumerate(["M1", "M2", "M3", "x", "M4", "y", "M5"])]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, line string")
    got = ln.lines_after_marker(df, "^M", chunk_lines=2)
    assert {tuple(r) for r in got.collect()} == {(1, 10, "M2"), (1, 30, "x"), (1, 50, "y")}
    three = spark.createDataFrame([(1, 0, "M"), (1, 4, "x"), (1, 6, "y")], df.schema)
    assert [tuple(r) for r in ln.lines_after_marker(three, "^M").collect()] == [(1, 4, "x")]


@pytest.mark.parametrize("chunk_lines", [1, 3, 50])
def test_gapped_lines_agree_with_a_walk(spark, chunk_lines):
    rng = random.Random(chunk_lines)
    docs = {d: [(rng.choice(["M", "M", "x"]) + str(i), i) for i in range(300) if rng.random() < 0.4] for d in range(20)}
    rows = [(d, at, line) for d, lines in docs.items() for line, at in lines]
    got = ln.lines_after_marker(spark.createDataFrame(rows, "doc_id int, line_no int, line string"), "^M", chunk_lines=chunk_lines)
    want = {(d, lines[i][1], lines[i][0]) for d, lines in docs.items() for i in walked([x for x, _ in lines], lambda x: x[0] == "M")}
    assert {tuple(r) for r in got.collect()} == want


def test_a_sealed_table_is_opened_once(spark, keyring):
    """Last values and lines after markers decrypt each block once."""
    from sealtable.plans.secure_queries import sealed_copy

    rows = [(d, i, rng_line) for d in range(30) for i, rng_line in enumerate(["M a", "x b", "M c", "y d"])]
    lines = sealed_copy(spark.createDataFrame(rows, "doc_id int, line_no int, line string"))
    for df in (ln.last_value_per_key(lines, ["doc_id"], {"m": "^M", "x": "^x"}), ln.lines_after_marker(lines, "^M")):
        df.collect()
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        cached = plan.count("InMemoryRelation")
        assert plan.count("aes_decrypt") == 0 or cached or plan.count("from_csv") == 1
        assert cached in (0, 2)


def test_ordering_rows_leaves_no_table(spark):
    """Nothing is written below the shared folder, and building the plan runs no job."""
    import os

    from sealtable.session import shared_folder

    def files():
        return sum(len(names) for _, _, names in os.walk(shared_folder(spark).replace("file:", "")))

    before = files()
    numbered = number_rows(spark.range(1000).withColumn("v", F.col("id") % 7), [], ["v", "id"], "n")
    assert numbered.count() == 1000 and files() == before


def test_last_value_per_key(spark):
    text = {1: "size 1\nkind a\nsize 2\n size  3 x", 2: "other 1", 3: "kind", None: "kind z"}
    rows = [(d, i, s) for d, t in text.items() for i, s in enumerate(t.split("\n"))]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, line string")
    rules = {"size": "^size$", "kind": "^kin"}
    expected = {(1, "3", "a"), (2, "", ""), (3, "", ""), (None, "", "z")}
    assert {tuple(r) for r in ln.last_value_per_key(df, ["doc_id"], rules).collect()} == expected
    texts = spark.createDataFrame(list(text.items()), "doc_id int, s string")
    by_text = texts.select("doc_id", *[tx.last_value(S, p).alias(n) for n, p in rules.items()])
    assert {tuple(r) for r in by_text.collect()} == expected


def test_split_filter_and_header(spark):
    df = spark.createDataFrame([(1, "head\nb x\n\nc x"), (2, "only")], "doc_id int, text string")
    lines = ln.split_lines(df, "text", "doc_id")
    assert lines.count() == 5
    assert [r.line for r in ln.without_header(lines).orderBy("line_no").collect()] == ["b x", "", "c x"]
    assert ln.containing(lines, " x").count() == 2
    assert ln.matching(lines, "^(b|only)").count() == 2


# ---- groups of any size -------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot", rng.randint(0, 10**6), i) for i in range(6000)]
    rows += [(rng.choice(["a", "b", "c", None]), rng.randint(0, 50), i) for i in range(6000, 9000)]
    rng.shuffle(rows)
    return rows


def test_number_rows(spark, skewed):
    df = spark.createDataFrame(skewed, "g string, v int, id int").repartition(5)
    numbered = number_rows(df, ["g"], ["v", "id"], "n")
    expected = set()
    for g in {r[0] for r in skewed}:
        expected |= {(*r, n + 1) for n, r in enumerate(sorted((r for r in skewed if r[0] == g), key=lambda r: r[1:]))}
    assert {tuple(r) for r in numbered.collect()} == expected


def test_number_rows_spreads_a_hot_group(spark, skewed):
    df = spark.createDataFrame(skewed, "g string, v int, id int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = df.repartitionByRange("g", "v", "id").withColumn("p", F.spark_partition_id())
        hot = ordered.where("g = 'hot'").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(hot) >= 4 and max(r["count"] for r in hot) < 3000


def test_number_rows_of_copies(spark):
    """A third of all rows are copies of one row; every place is given once."""
    df = spark.range(0, 9000, 1, 4).select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("s"))
    got = number_rows(df, [], ["s"], "n").cache()
    assert got.select("n").distinct().count() == 9000
    assert got.agg(F.min("n"), F.max("n")).first() == (1, 9000)
    same = got.where("s = 'same'")
    assert same.count() == 3000 and same.agg(F.max("n") - F.min("n")).first()[0] == 2999


def test_number_rows_over_everything(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = number_rows(df, [], ["v", "id"], "n").collect()
    assert {(r.id, r.n) for r in got} == {(i, n + 1) for n, i in enumerate(sorted(range(1000), key=lambda i: (i % 7, i)))}


@pytest.mark.parametrize("max_items", [1, 7, 1000, 10**6])
def test_joined_items(spark, skewed, max_items):
    rows = [(g, f"/home/{v}", i) for g, v, i in skewed] + [("a", None, -1)]
    df = spark.createDataFrame(rows, "g string, path string, id int")
    got = ln.joined_items(df, ["g"], "path", ["id"], ("/home", "local:///home"), max_items=max_items).collect()
    for g in {r[0] for r in rows}:
        parts = [r["items"] for r in sorted((r for r in got if r.g == g), key=lambda r: r.part_no)]
        items = sorted((p, i) for h, p, i in rows if h == g and p is not None)
        assert ",".join(parts) == ",".join("local://" + p for p, _ in items)
        assert all(p.count(",") < max_items for p in parts)


def sed(lines, marker="M"):
    out, k = [], 0
    while k < len(lines):
        if lines[k].startswith(marker) and k + 1 < len(lines):
            out.append(k + 1)
            k += 1
        k += 1
    return out


@pytest.mark.parametrize("chunk_lines", [1, 5, 65_536])
def test_one_document_over_all_tasks_by_microseconds(spark, chunk_lines):
    """Sparse numbers, one document with nearly all lines, long runs of markers across tasks."""
    import datetime as dt

    rng = random.Random(chunk_lines)
    lines, times, now = [], [], dt.datetime(2024, 1, 1)
    while len(lines) < 3000:
        lines += rng.choice([["M"] * rng.choice([1, 2, 3, 301]), ["x"] * rng.choice([1, 2, 5])])
    for _ in lines:
        now += dt.timedelta(microseconds=rng.randrange(1, 10**9))
        times.append(now)
    rows = [("big", t, s) for t, s in zip(times, lines)] + [("a", times[0], "M"), ("z", times[0], "x"), (None, times[1], "M"), (None, times[2], "y")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc string, at timestamp_ntz, line string").repartition(5)
    got = ln.lines_after_marker(df, "^M", ["doc"], "at", chunk_lines=chunk_lines)
    want = [("big", times[k]) for k in sed(lines)] + [(None, times[2])]
    assert sorted(((r.doc, r["at"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_no_task_sees_the_whole_document(spark, monkeypatch):
    """The walk itself reports how many rows of the one document each task had."""
    rows = spark.sparkContext.accumulator({}, runs._ByTask())
    plain = ln._marker_walk

    def reporting(doc, chunk_lines):
        walk = plain(doc, chunk_lines)

        def run(batches):
            seen = 0

            def noted():
                nonlocal seen
                for batch in batches:
                    seen += batch.num_rows
                    yield batch

            yield from walk(noted())
            rows.add({TaskContext.get().partitionId(): seen})

        return run

    monkeypatch.setattr(ln, "_marker_walk", reporting)
    line = F.when(F.col("id") % 3 == 0, "M").otherwise("x")
    df = spark.range(0, 20_000, 1, 4).select(F.lit(1).alias("doc_id"), (F.col("id") * 1_000_003).alias("line_no"), line.alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 20,000 rows are one task's otherwise
    try:
        got = ln.lines_after_marker(df, "^M").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == len(sed(["M" if k % 3 == 0 else "x" for k in range(20_000)]))
    assert len(rows.value) == 8 and sum(rows.value.values()) == 20_000 and max(rows.value.values()) < 5000


def test_release_gives_up_what_is_held(spark):
    from sealtable.session import release

    release(spark)
    df = spark.createDataFrame([(1, k, "M" if k % 2 else "x") for k in range(10)], "doc_id int, line_no int, line string")
    result = ln.lines_after_marker(df, "^M")
    assert result.count() == 4 and release(spark) == 1 and release(spark) == 0
    assert result.count() == 4
