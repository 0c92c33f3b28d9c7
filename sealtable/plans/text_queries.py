"""Registered queries of the text operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.functions import text as tx
from sealtable.operators import lines as ln
from sealtable.operators.patterns import containing_any, filled_from, found_strings
from sealtable.operators.ranking import number_rows
from sealtable.operators.relational import first_rows
from sealtable.plans.secure_queries import sealed_copy, table


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.split_lines(table(spark, sf_dir, "documents"), "text", "doc_id")


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of search strings that comes from a table: the longer words of the benchmark."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[^a-z]+")).alias("word"))
    return words.where("length(word) >= 6").distinct()


def text_filled_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the list turned around, one after the other, each in what the last one left."""
    words = benchmark_words(spark, sf_dir).select(F.col("word").alias("mark"), F.reverse("word").alias("value"), F.col("word").alias("position"))
    return filled_from(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", words)


def text_containing_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containing_any(document_lines(spark, sf_dir), benchmark_words(spark, sf_dir), needle="word")


def text_found_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of the list each document has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = found_strings(docs, benchmark_words(spark, sf_dir), "text", "word")
    return found.select("doc_id", F.explode("found").alias("word"))


def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10,000 orders by customer, out of as many tasks as they need."""
    return first_rows(sealed_copy(table(spark, sf_dir, "orders")), 10_000, "o_custkey", "o_orderkey", at_once=1000)


def text_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.containing(document_lines(spark, sf_dir), "the th")


def text_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.matching(document_lines(spark, sf_dir), "^[A-M][a-z]+ (the|de|la) ")


def sealed_text_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over an encrypted copy of the documents."""
    docs = sealed_copy(table(spark, sf_dir, "documents"), "parquet")
    return ln.containing(ln.split_lines(docs, "text", "doc_id"), "the th")


def text_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return document_lines(spark, sf_dir).select(
        "doc_id", "line_no", tx.field(line, 3).alias("third"), tx.field(line, 40).alias("fortieth")
    )


def text_first_and_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, rest = tx.first_and_rest(F.col("line"))
    return document_lines(spark, sf_dir).select("doc_id", "line_no", first.alias("first"), rest.alias("rest"))


def text_without_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.without_header(document_lines(spark, sf_dir))


LAST_VALUE_RULES = {"after_the": "^(The|La|Die|El)$", "after_vowel": "^[AEIOU]"}


def text_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, the second field of the last line whose first field matches, for two keys."""
    latest = [tx.last_value(F.col("text"), p).alias(name) for name, p in LAST_VALUE_RULES.items()]
    return table(spark, sf_dir, "documents").select("doc_id", *latest)


def line_table_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a table of lines."""
    return ln.last_value_per_key(document_lines(spark, sf_dir), ["doc_id"], LAST_VALUE_RULES)


def conversation_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, the last thing each side said."""
    return ln.last_value_per_key(
        table(spark, sf_dir, "conversations"),
        ["conv_id"],
        {"user_said": "^user$", "assistant_said": "^assistant$"},
        key=F.col("role"),
        value=F.col("text"),
        order="turn",
    )


def text_after_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines after marker lines, within each document's text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(tx.lines_after(F.col("text"), "^[A-M]")).alias("n", "line"))


def line_table_after_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a table of lines, with small chunks so that markers run across them."""
    return ln.lines_after_marker(document_lines(spark, sf_dir), "^[A-M]", chunk_lines=8)


def conversation_after_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that follow a turn with a full stop."""
    turns = table(spark, sf_dir, "conversations")
    return ln.lines_after_marker(turns, r"\.", ["conv_id"], "turn", "text")


def gapped_lines_after_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines after markers where every third line number is missing."""
    left = document_lines(spark, sf_dir).where("line_no % 3 <> 1")
    return ln.lines_after_marker(left, "^[A-M]", chunk_lines=8)


def option_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the form ``A_B_C_<n>=<value>`` from orders; open orders have no number."""
    number = F.when(F.col("o_orderstatus") == "O", "none").otherwise(
        (F.col("o_custkey") - 500).cast("string")
    )
    head = F.concat_ws("_", F.lit("ORDER"), F.lit("OPT"), "o_orderstatus", number)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(head, F.lit("="), F.col("o_orderpriority"), F.lit("=x")).alias("line"),
    )


def text_numeric_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines sorted by the number in their fourth part; the place of each line is shown."""
    numbered = ln.numbered_by_number(option_lines(spark, sf_dir), "_", 4, tie_break=["doc_id"])
    return numbered.select("pos", "doc_id", "line")


def text_sorted_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sort itself: the place at which each line comes out."""
    ordered = ln.sorted_by_number(option_lines(spark, sf_dir), "_", 4, tie_break=["doc_id"])
    placed = ordered.withColumn("seq", F.monotonically_increasing_id())
    return number_rows(placed, [], ["seq"], "pos").select("pos", "doc_id", "line")


def text_option_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands after the first equals sign."""
    value = tx.replace_group(F.col("line"), "[^=]*=(.*)", "$1")
    return option_lines(spark, sf_dir).select("doc_id", value.alias("value"))


def text_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select(
        "doc_id", "line_no", tx.map_chars(F.col("line"), " ", ",").alias("line")
    )


def text_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.delete_chars(F.col("text"), r"[\s-]").alias("text"))


def text_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as placeholders; one value comes from a column, one is filled at its first place only."""
    values = [("the", "_de_"), ("de", F.col("lang")), ("an", "_once_")]
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.fill(F.col("text"), values, first_only=["an"]).alias("text")
    )


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/base/"), F.lower("c_mktsegment"), F.lit("/"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", path.alias("path"))


def items_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each nation's customers as one comma-separated list with rewritten prefix."""
    return ln.joined_items(
        customer_files(spark, sf_dir), ["c_nationkey"], "path", ["c_custkey"], ("/base/", "local:///base/"),
        max_items=10_000,
    )


def items_joined_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups far above the bound: each continues over numbered parts."""
    keyed = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("item"),
        "l_linenumber",
        "l_shipdate",
    )
    return ln.joined_items(keyed, ["l_returnflag"], "item", ["l_linenumber", "l_shipdate"], max_items=500)


def json_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two JSON values joined by a blank; the second is absent in every row."""
    pair = tx.json_fields(F.col("props"), ["$.k", "$.absent"])
    return table(spark, sf_dir, "events").select("event_id", pair.alias("pair"))


def text_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = tx.to_base64(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", encoded.alias("encoded"), tx.from_base64(encoded).alias("decoded")
    )


def text_base64_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", tx.to_base64(F.col("text"), wrap=76).alias("encoded"))


def text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.hex_digest(F.col("text"), 256).alias("digest"))


def path_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.after_last(F.col("url"), "/").alias("tail"))


def path_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(tx.glob_match(F.col("url"), "*example.??g/*")).select("page_id", "url")


def text_prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select("doc_id", "line_no", tx.prefixed(F.col("line")).alias("line"))


def event_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = {"run": ["click", "view", "purchase"], "none": [""]}
    return table(spark, sf_dir, "events").select(
        "event_id", tx.route(F.col("event_type"), routes, default="pass-through").alias("route")
    )


_LINES = """
    with texts as (select doc_id, string_split(text, chr(10)) as parts from documents),
    lines as (select doc_id, cast(unnest(range(len(parts))) as integer) as line_no, unnest(parts) as line from texts)"""

_FIELDS = r"regexp_split_to_array(trim(line, ' ' || chr(9) || chr(10)), '[ \t\n]+')"


def _after_marker_sql(source: str, doc: str, line_no: str, flagged: str, select: str) -> str:
    """Within a run of adjacent markers only the 1st, 3rd, ... act."""
    return f"""
    {source}
    flagged as (select *, {flagged} as marker from lines),
    runs as (
      select {doc}, {line_no}, {line_no} - row_number() over (partition by {doc} order by {line_no}) as run
      from flagged where marker),
    acting as (
      select {doc}, {line_no} + 1 as {line_no} from (
        select *, row_number() over (partition by {doc}, run order by {line_no}) as place from runs)
      where place % 2 = 1),
    taken as (select l.* from lines l join acting a using ({doc}, {line_no}))
    {select}"""


_DOCUMENT_LINES = _LINES + ","
_FIRST_FIELD, _SECOND_FIELD = "coalesce(f[1], '')", "coalesce(f[2], '')"

_LAST_VALUE = f"""{_LINES}, fields as (select doc_id, line_no, {_FIELDS} as f from lines)
        select doc_id,
          coalesce(arg_max({_SECOND_FIELD}, line_no)
            filter (where regexp_matches({_FIRST_FIELD}, '^(The|La|Die|El)$')), '') as after_the,
          coalesce(arg_max({_SECOND_FIELD}, line_no)
            filter (where regexp_matches({_FIRST_FIELD}, '^[AEIOU]')), '') as after_vowel
        from fields group by doc_id"""

_OPTIONS = """
    with options as (
      select o_orderkey as doc_id,
             'ORDER_OPT_' || o_orderstatus || '_' || case when o_orderstatus = 'O' then 'none'
               else cast(o_custkey - 500 as varchar) end || '=' || o_orderpriority || '=x' as line
      from orders)"""

_SORTED = rf"""{_OPTIONS},
        keyed as (
          select *, coalesce(try_cast(regexp_extract(
            coalesce(string_split(line, '_')[4], ''), '^[ \t]*(-?[0-9]*\.?[0-9]*)', 1) as decimal(38,10)), 0) as k
          from options)
        select row_number() over (order by k, line, doc_id) as pos, doc_id, line from keyed"""

QUERIES = {
    "text_containing": text_containing,
    "text_containing_any": text_containing_any,
    "text_found_strings": text_found_strings,
    "text_filled_from_table": text_filled_from_table,
    "first_orders": first_orders,
    "text_matching": text_matching,
    "sealed_text_containing": sealed_text_containing,
    "text_field": text_field,
    "text_first_and_rest": text_first_and_rest,
    "text_without_header": text_without_header,
    "text_last_value": text_last_value,
    "line_table_last_value": line_table_last_value,
    "conversation_last_value": conversation_last_value,
    "text_after_marker": text_after_marker,
    "line_table_after_marker": line_table_after_marker,
    "conversation_after_marker": conversation_after_marker,
    "gapped_lines_after_marker": gapped_lines_after_marker,
    "text_numeric_sort": text_numeric_sort,
    "text_sorted_by_number": text_sorted_by_number,
    "text_option_values": text_option_values,
    "text_mapped": text_mapped,
    "text_deleted": text_deleted,
    "text_filled": text_filled,
    "items_joined": items_joined,
    "items_joined_in_parts": items_joined_in_parts,
    "json_pair": json_pair,
    "text_base64": text_base64,
    "text_base64_wrapped": text_base64_wrapped,
    "text_digest": text_digest,
    "path_tail": path_tail,
    "path_glob": path_glob,
    "text_prefixed": text_prefixed,
    "event_routes": event_routes,
}

_WORDS = """
    words as (select distinct unnest(regexp_split_to_array(text, '[^a-z]+')) as word from benchmark),
    list as (select list(word order by word) as ws from words where length(word) >= 6)"""

ORACLES = {
    "text_containing_any": f"""
        with {_WORDS},
        lines as (select doc_id, unnest(string_split(text, chr(10))) as line,
                         cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as integer) as line_no from documents)
        select doc_id, line_no, line from lines, list where len(list_filter(ws, lambda w: contains(line, w))) > 0""",
    "text_found_strings": f"""
        with {_WORDS}
        select doc_id, unnest(list_filter(ws, lambda w: contains(text, w))) as word from documents, list""",
    "text_filled_from_table": f"""
        with {_WORDS}
        select doc_id, list_reduce(list_prepend(text, ws), lambda t, w: replace(t, w, reverse(w))) as text from documents, list""",
    "first_orders": "select * from orders order by o_custkey, o_orderkey limit 10000",
    "text_containing": f"{_LINES} select * from lines where contains(line, 'the th')",
    "text_matching": f"{_LINES} select * from lines where regexp_matches(line, '^[A-M][a-z]+ (the|de|la) ')",
    "sealed_text_containing": f"{_LINES} select * from lines where contains(line, 'the th')",
    "text_field": f"""{_LINES}
        select doc_id, line_no, coalesce({_FIELDS}[3], '') as third, coalesce({_FIELDS}[40], '') as fortieth
        from lines""",
    "text_first_and_rest": rf"""{_LINES}
        select doc_id, line_no, coalesce({_FIELDS}[1], '') as first,
               regexp_replace(trim(line, ' ' || chr(9) || chr(10)), '^[^ \t\n]*[ \t\n]*', '') as rest
        from lines""",
    "text_without_header": f"{_LINES} select * from lines where line_no > 0",
    "text_last_value": _LAST_VALUE,
    "line_table_last_value": _LAST_VALUE,
    "conversation_last_value": """
        select conv_id, coalesce(arg_max(text, turn) filter (where role = 'user'), '') as user_said,
               coalesce(arg_max(text, turn) filter (where role = 'assistant'), '') as assistant_said
        from conversations group by conv_id""",
    "text_after_marker": _after_marker_sql(
        _DOCUMENT_LINES, "doc_id", "line_no", "regexp_matches(line, '^[A-M]')",
        """select doc_id, cast(row_number() over (partition by doc_id order by line_no) - 1 as integer) as n, line
           from taken""",
    ),
    "line_table_after_marker": _after_marker_sql(
        _DOCUMENT_LINES, "doc_id", "line_no", "regexp_matches(line, '^[A-M]')",
        "select doc_id, line_no, line from taken",
    ),
    "conversation_after_marker": _after_marker_sql(
        "with lines as (select * from conversations),", "conv_id", "turn",
        r"regexp_matches(text, '\.')", "select conv_id, turn, role, text from taken",
    ),
    "gapped_lines_after_marker": _after_marker_sql(
        f"""{_LINES},
        left_over as (select * from lines where line_no % 3 <> 1),
        renumbered as (
          select doc_id, line_no as real_no, line,
                 row_number() over (partition by doc_id order by line_no) as line_no from left_over),
        """, "doc_id", "line_no", "regexp_matches(line, '^[A-M]')",
        "select doc_id, real_no as line_no, line from taken",
    ).replace("from lines)", "from renumbered)", 2).replace("from lines l", "from renumbered l")
    .replace("as (select * from renumbered where", "as (select * from lines where"),
    "text_numeric_sort": _SORTED,
    "text_sorted_by_number": _SORTED,
    "text_option_values": rf"""{_OPTIONS}
        select doc_id, regexp_replace(line, '[^=]*=(.*)', '\1', 'g') as value from options""",
    "text_mapped": f"{_LINES} select doc_id, line_no, translate(line, ' ', ',') as line from lines",
    "text_deleted": r"select doc_id, regexp_replace(text, '[\s-]', '', 'g') as text from documents",
    "text_filled": """
        select doc_id, regexp_replace(replace(replace(text, 'the', '_de_'), 'de', lang), 'an', '_once_') as text
        from documents""",
    "items_joined": """
        select c_nationkey, cast(0 as bigint) as part_no,
               string_agg('local:///base/' || lower(c_mktsegment) || '/' || c_name, ','
                          order by '/base/' || lower(c_mktsegment) || '/' || c_name, c_custkey) as items
        from customer group by c_nationkey""",
    "items_joined_in_parts": """
        with keyed as (
          select l_returnflag, l_orderkey || '/' || l_partkey as item, l_linenumber, l_shipdate from lineitem),
        placed as (
          select *, row_number() over (partition by l_returnflag order by item, l_linenumber, l_shipdate) as pos
          from keyed)
        select l_returnflag, cast((pos - 1) // 500 as bigint) as part_no, string_agg(item, ',' order by pos) as items
        from placed group by l_returnflag, (pos - 1) // 500""",
    "json_pair": """
        select event_id, coalesce(json_extract_string(props, '$.k'), '') || ' ' ||
               coalesce(json_extract_string(props, '$.absent'), '') as pair
        from events""",
    "text_base64": "select doc_id, to_base64(encode(text)) as encoded, text as decoded from documents",
    "text_base64_wrapped": r"""
        select item_id, rtrim(regexp_replace(to_base64(encode(text)), '(.{76})', '\1' || chr(10), 'g'), chr(10))
               as encoded
        from benchmark""",
    "text_digest": "select doc_id, sha256(text) as digest from documents",
    "path_tail": "select page_id, string_split(url, '/')[-1] as tail from pages",
    "path_glob": "select page_id, url from pages where url like '%example.__g/%'",
    "text_prefixed": f"{_LINES} select doc_id, line_no, '    ' || line as line from lines",
    "event_routes": """
        select event_id, case when event_type in ('click', 'view', 'purchase') then 'run'
                              when event_type = '' then 'none' else 'pass-through' end as route
        from events""",
}
