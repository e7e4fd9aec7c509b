"""Queries over the star-schema and event tables, each with the SQL that states its result.

Every query goes through the pipeline compiler, so the SQL checks operators as users configure them. Doubles are
rounded, times are text, and order-sensitive operators have a total order, so both sides are comparable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverloom.operators.cdc import apply_changes, meta
from riverloom.operators.outcome import META, Context, apply
from riverloom.operators.project import FNV32, FNV64, col, fnv32
from riverloom.plans.compile import chain, compile_spec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def one(df: DataFrame, name: str, config: dict, **context) -> DataFrame:
    return apply(df, name, config, Context(**context)).ok


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(col(n), digits) for n in names})


#: Events with a null value in every seventh row, for null logic.
def sparse_events(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


SPARSE = "(select event_id, ts, user_id, event_type, case when event_id % 7 <> 0 then value end as value, props from events)"


# ---------------------------------------------------------------- flagship


@query("""
with d as (select *, row_number() over (partition by user_id, event_type, date_trunc('hour', ts) order by event_id) as rn from events),
j as (select d.event_id, d.ts, d.event_type, d.value, c.c_mktsegment as segment
  from d join customer c on c.c_custkey = d.user_id where rn = 1 and d.value > 10)
select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%dT%H:%M:%SZ') as window_start,
  strftime(time_bucket(interval 1 hour, ts) + interval 1 hour, '%Y-%m-%dT%H:%M:%SZ') as window_end,
  event_type, segment, count(*) as n, round(sum(value), 4) as total, round(avg(value), 4) as mean
from j group by 1, 2, 3, 4
""")
def flagship_wide_aggregate(spark, sf):
    """Filter, de-duplicate by hour, look a dimension up, aggregate by window: the common wide-table pipeline."""
    rows = events(spark, sf).withColumn("hour", F.date_trunc("hour", "ts"))
    spec = {
        "name": "wide",
        "source": {"type": "table", "config": {"table": "events"}},
        "event_time": "ts",
        "seq": "event_id",
        "transforms": [
            {"type": "deduplicate", "config": {"keys": ["user_id", "event_type", "hour"]}},
            {"type": "filter", "config": {"expression": "value > 10"}},
            {"type": "lookup", "config": {"table": "customer", "key": "user_id", "dim_key": "c_custkey", "fields": ["c_mktsegment"], "on_miss": "dlq"}},
            {"type": "rename", "config": {"mappings": {"c_mktsegment": "segment"}}},
            {"type": "window", "config": {"window_size_seconds": 3600, "group_by": ["event_type", "segment"], "aggregates": [
                {"func": "count", "alias": "n"}, {"func": "sum", "field": "value", "alias": "total"}, {"func": "avg", "field": "value", "alias": "mean"}]}},
        ],
    }
    done = compile_spec(spec, rows, Context(tables={"customer": table(spark, sf, "customer")}))
    return rounded(done.sinks["sink"], "total", "mean")


# ---------------------------------------------------------------- projection


@query("select event_id as id, user_id as who, event_type from events")
def project_mappings(spark, sf):
    return one(events(spark, sf), "project", {"fields": ["event_type"], "mappings": {"event_id": "id", "user_id": "who"}})


@query("""select event_id, event_type, 'web' as channel, floor(epoch(ts))::bigint as unix_ts,
strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at, strftime(ts, '%Y/%m/%d %H:%M') as shown from events""")
def project_constants_time_format(spark, sf):
    df = events(spark, sf).withColumns({"unix_ts": F.col("ts"), "at": F.col("ts"), "shown": F.col("ts")})
    config = {
        "fields": ["event_id", "event_type", "unix_ts", "at", "shown"],
        "constants": {"channel": "web"},
        "time_formats": {"unix_ts": "unix", "at": "rfc3339", "shown": "2006/01/02 15:04"},
    }
    return one(df, "project", config)


@query("select event_id as id, event_type as kind, user_id, value from events")
def project_keep_unmapped(spark, sf):
    df = one(events(spark, sf), "project", {"keep_unmapped": True, "mappings": {"event_id": "id", "event_type": "kind"}})
    return one(df, "drop_field", {"fields": ["ts", "props"]})


@query("select event_type as user_id, user_id as event_type, event_id, 'v1' as version from events")
def rename_drop_add(spark, sf):
    """Two columns swap names: all renames read the input."""
    steps = [
        ("rename", {"mappings": {"event_type": "user_id", "user_id": "event_type"}}),
        ("drop_field", {"fields": ["ts", "value", "props", "absent"]}),
        ("add_field", {"field": "version", "value": "v1"}),
        ("identity", {}),
    ]
    return chain(events(spark, sf), steps).ok


@query("select event_id, coalesce(nullif(value, 0), nullif(user_id, 0)) as amount from " + SPARSE)
def coalesce_nonempty(spark, sf):
    df = sparse_events(spark, sf).withColumn("user", F.col("user_id").cast("double"))
    return one(df, "coalesce", {"fields": ["value", "user"], "target_field": "amount"}).select("event_id", "amount")


@query("""select event_id, case event_type when 'click' then 'c' when 'view' then 'v' else 'other' end as event_type,
case user_id when 1 then 'one' when 2 then 'two' else cast(user_id as varchar) end as user_id from events""")
def map_fields_default(spark, sf):
    rules = [
        {"field": "event_type", "map": {"click": "c", "view": "v"}, "default": "other"},
        {"field": "user_id", "map": {1: "one", 2: "two"}},
    ]
    return one(events(spark, sf), "map_fields", {"fields": rules}).select("event_id", "event_type", "user_id")


@query("select event_id, case event_type when 'click' then 'c' when 'error' then 'e' end as event_type from events")
def map_fields_null(spark, sf):
    rule = {"field": "event_type", "map": {"click": "c", "error": "e"}, "on_missing": "null"}
    return one(events(spark, sf), "map_fields", {"fields": [rule]}).select("event_id", "event_type")


@query(r"""select page_id, case when regexp_matches(url, '^(https?)://([^/]+)') then regexp_extract(url, '^(https?)://([^/]+)', 2) end as host,
case when regexp_matches(html, '<title>([^<]*)</title>') then regexp_extract(html, '<title>([^<]*)</title>', 1) end as title,
case when regexp_matches(url, '\?page=([0-9]+)') then regexp_extract(url, '\?page=([0-9]+)', 1) end as page from pages""")
def extract_regex(spark, sf):
    rules = [
        {"target": "host", "source_field": "url", "pattern": r"^(https?)://([^/]+)", "group": 2},
        {"target": "title", "source_field": "html", "pattern": r"<title>([^<]*)</title>", "group": 1},
        {"target": "page", "source_field": "url", "pattern": r"\?page=([0-9]+)", "group": 1},
    ]
    return one(table(spark, sf, "pages"), "extract", {"rules": rules}).select("page_id", "host", "title", "page")


@query("select c_custkey, concat(c_name, ' / ', c_mktsegment, ' #', cast(c_custkey as varchar)) as label from customer")
def extract_template(spark, sf):
    rules = [{"target": "label", "template": "{{.c_name}} / {{.c_mktsegment}} #{{.c_custkey}}"}]
    return one(table(spark, sf, "customer"), "extract", {"rules": rules}).select("c_custkey", "label")


def fnv_sql(text: str, bits: int) -> str:
    """FNV-1a of an ASCII text as DuckDB SQL: a fold over its characters."""
    offset, prime = {32: FNV32, 64: FNV64}[bits]
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::hugeint)"
    return f"list_reduce(list_prepend({offset}::hugeint, {codes}), lambda h, c: (xor(h, c) * {prime}) % {2**bits}::hugeint)"


@query(f"""select c_custkey, concat(left(c_name, 3), '****', right(c_name, 4)) as c_name, '********' as c_mktsegment,
concat(left(mail, 1), '***', substr(mail, instr(mail, '@'))) as mail,
case when length(card) >= 14 then concat(left(card, 3), '***********', right(card, 4)) else '****' end as card,
printf('%x', {fnv_sql("'k' || cast(c_custkey as varchar)", 64)}::ubigint) as hashed from
(select *, concat('u', cast(c_custkey as varchar), '@example.com') as mail, concat(cast(c_custkey as varchar), '00000000', 'XYZAB') as card from customer)""")
def mask_fields(spark, sf):
    key = F.col("c_custkey").cast("string")
    df = table(spark, sf, "customer").withColumn("mail", F.concat(F.lit("u"), key, F.lit("@example.com")))
    df = df.withColumn("card", F.concat(key, F.lit("00000000XYZAB"))).withColumn("hashed", F.concat(F.lit("k"), key))
    rules = {"c_name": "mask_phone", "c_mktsegment": "mask_all", "mail": "mask_email", "card": "mask_id_card", "hashed": "hash"}
    return one(df, "mask", {"fields": rules}).select("c_custkey", "c_name", "c_mktsegment", "mail", "card", "hashed")


@query("""select r_regionkey, r_name, 'audit' as _pipeline, 'regions' as _source_table, '2024-01-01T00:00:00Z' as _ingested_at, 'x' as team from region""")
def field_enrichment(spark, sf):
    config = {"pipeline": "audit", "table": "regions", "extra": {"team": "x", "r_name": "kept as it is"}}
    return one(table(spark, sf, "region"), "field_enrichment", config, now=F.lit("2024-01-01").cast("timestamp"))


# ---------------------------------------------------------------- conversion


@query("""select event_id, cast(trunc(value) as bigint) as value, cast(event_id as double) as id_float, cast(user_id as varchar) as user_id,
try_cast(event_type as double) as event_type from events""")
def type_convert(spark, sf):
    df = events(spark, sf).withColumn("id_float", F.col("event_id"))
    config = {"conversions": {"value": "int", "id_float": "float", "user_id": "string", "event_type": "float", "props": "no_such_type"}}
    return one(df, "type_convert", config).select("event_id", "value", "id_float", "user_id", "event_type")


MIXED = "case event_id % 5 when 0 then '12abc' when 1 then ' 42 ' when 2 then '1.9' when 3 then 'x' else cast(event_id as varchar) end"


@query(f"""with t as (select event_id, {MIXED} as s from events) select event_id,
case when regexp_full_match(trim(s), '[+-]?[0-9]+(\\.[0-9]+)?') then cast(trunc(cast(trim(s) as double)) as bigint) end as as_int,
try_cast(regexp_extract(s, '^\\s*([+-]?[0-9]+(\\.[0-9]+)?)', 1) as double) as as_float from t""")
def cast_int_float(spark, sf):
    df = events(spark, sf).select("event_id", F.expr(MIXED.replace("varchar", "string")).alias("as_int")).withColumn("as_float", F.col("as_int"))
    return one(df, "cast", {"fields": {"as_int": "to_int", "as_float": "to_float"}})


BOOLS = "case event_id % 6 when 0 then 'YES' when 1 then 'off' when 2 then '' when 3 then 'maybe' when 4 then ' t ' else null end"


@query(f"""with t as (select event_id, {BOOLS} as s, event_id % 2 as n from events) select event_id,
case when lower(trim(s)) in ('1','t','true','yes','y','on') then true when lower(trim(s)) in ('0','f','false','no','n','off','') then false end as flag, n <> 0 as odd from t""")
def cast_bool(spark, sf):
    df = events(spark, sf).select("event_id", F.expr(BOOLS).alias("flag"), (F.col("event_id") % 2).alias("odd"))
    return one(df, "cast", {"fields": {"flag": "to_bool", "odd": "bool"}})


TIMES = "case event_id % 5 when 0 then '2024-03-01' when 1 then '2024-03-01 10:20:30' when 2 then '1709288430' when 3 then '1709288430000' else 'soon' end"


@query(f"""with t as (select event_id, {TIMES} as s from events),
u as (select event_id, case event_id % 5 when 0 then timestamp '2024-03-01 00:00:00' when 1 then timestamp '2024-03-01 10:20:30'
  when 2 then timestamp '2024-03-01 10:20:30' when 3 then timestamp '2024-03-01 10:20:30' end as x from t)
select event_id, strftime(x, '%Y-%m-%d %H:%M:%S') as at, strftime(date_trunc('day', x), '%Y-%m-%d %H:%M:%S') as day from u""")
def cast_timestamp_date(spark, sf):
    df = events(spark, sf).select("event_id", F.expr(TIMES).alias("at")).withColumn("day", F.col("at"))
    out = one(df, "cast", {"fields": {"at": "to_timestamp", "day": "to_date"}})
    return out.select("event_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("at", "day")])


@query("""select event_id, case event_id % 4 when 0 then 'a|b|c' when 1 then 'x|y' when 2 then '' else cast(event_id as varchar) end as parts,
case event_id % 4 when 0 then 3 when 1 then 2 when 2 then 0 else 1 end as n from events""")
def cast_array(spark, sf):
    text = "case event_id % 4 when 0 then 'a, b ,c' when 1 then '[\"x\",\"y\"]' when 2 then '' else cast(event_id as string) end"
    out = one(events(spark, sf).select("event_id", F.expr(text).alias("parts")), "cast", {"fields": {"parts": "to_array"}})
    return out.select("event_id", F.array_join("parts", "|").alias("parts"), F.size("parts").alias("n"))


@query(f"with t as (select event_id, {MIXED} as s from events) select event_id, cast(trunc(cast(trim(s) as double)) as bigint) as n from t where event_id % 5 not in (0, 3)")
def cast_on_error_skip(spark, sf):
    df = events(spark, sf).select("event_id", F.expr(MIXED.replace("varchar", "string")).alias("n"))
    return one(df, "cast", {"fields": {"n": "to_int"}, "on_error": "skip"})


@query("select event_id from events where event_id % 5 in (0, 3)")
def cast_on_error_fail(spark, sf):
    df = events(spark, sf).select("event_id", F.expr(MIXED.replace("varchar", "string")).alias("n"))
    out = apply(df, "cast", {"fields": {"n": "to_int"}, "on_error": "fail"})
    return out.errors.select(F.get_json_object("record", "$.event_id").cast("bigint").alias("event_id"))


@query("""select event_id, case when value = floor(value) then cast(cast(value as bigint) as varchar) else cast(value as varchar) end as shown,
json_extract_string(props, '$.k') as k from events""")
def cast_string_json(spark, sf):
    df = events(spark, sf).withColumn("shown", F.col("value")).withColumn("props", F.from_json("props", "k bigint"))
    out = one(df, "cast", {"fields": {"shown": "to_string", "props": "to_json"}})
    return out.select("event_id", "shown", F.get_json_object("props", "$.k").alias("k"))


# ---------------------------------------------------------------- filters and validation


@query("select event_id from events where (value > 50 and event_type = 'click') or not (user_id >= 20) ")
def filter_and_or_not(spark, sf):
    config = {"expression": "(value > 50 && event_type == 'click') || !(user_id >= 20)"}
    return one(events(spark, sf), "filter", config).select("event_id")


@query(f"select event_id from {SPARSE} where not coalesce(value > 30, false)")
def filter_null_logic(spark, sf):
    """A comparison with null is false, so its negation is true."""
    return one(sparse_events(spark, sf), "filter", {"expression": "not (value > 30)"}).select("event_id")


@query("select event_id from events where cast(user_id as varchar) = '42' or cast(user_id as varchar) < '12'")
def filter_string_form(spark, sf):
    return one(events(spark, sf), "filter", {"expression": "user_id == '42' or user_id < \"12\""}).select("event_id")


@query(f"select event_id from {SPARSE} where value is null or (value is not null and event_type <> 'view' and value < 5)")
def filter_presence(spark, sf):
    config = {"expression": "value nil || (value && event_type != 'view' && value < 5) || absent"}
    return one(sparse_events(spark, sf), "filter", config).select("event_id")


@query(f"with t as (select event_id, {MIXED} as s from events) select event_id from t where try_cast(regexp_extract(s, '^\\s*([0-9]+(\\.[0-9]+)?)', 1) as double) > 10")
def filter_numeric_text(spark, sf):
    """A number in the filter reads the numeric beginning of a text."""
    df = events(spark, sf).select("event_id", F.expr(MIXED.replace("varchar", "string")).alias("s"))
    return one(df, "filter", {"expression": "s > 10"}).select("event_id")


@query(f"with t as (select event_id, {MIXED} as s from events) select event_id, 'filter: s is not a number' as message from t where event_id % 5 = 3")
def filter_strict_errors(spark, sf):
    df = events(spark, sf).select("event_id", F.expr(MIXED.replace("varchar", "string")).alias("s"))
    bad = apply(df, "filter", {"expression": "s > 10", "strict_types": True}).errors
    return bad.select(F.get_json_object("record", "$.event_id").cast("bigint").alias("event_id"), "message")


RULES = {
    "required_fields": ["event_type"],
    "rules": [
        {"field": "value", "type": "range", "min": 1, "max": 90},
        {"field": "event_type", "type": "enum", "values": ["click", "view", "purchase", "signup"]},
        {"field": "props", "type": "regex", "pattern": "\"k\": [0-9]"},
        {"field": "event_type", "type": "length_max", "max": 6},
    ],
}
_FAILS = """array_to_string(list_filter([
case when not coalesce(value between 1 and 90, false) then 'value: range' end,
case when event_type not in ('click','view','purchase','signup') then 'event_type: enum' end,
case when not regexp_matches(props, '"k": [0-9]') then 'props: regex' end,
case when strlen(event_type) > 6 then 'event_type: length_max' end], lambda x: x is not null), '; ')"""


@query(f"select event_id, event_type from {SPARSE} where {_FAILS} = ''")
def validate_split_ok(spark, sf):
    return one(sparse_events(spark, sf), "validate", RULES).select("event_id", "event_type")


@query(f"select event_id, {_FAILS} as message, 'data' as error_class from {SPARSE} where {_FAILS} <> ''")
def validate_errors(spark, sf):
    bad = apply(sparse_events(spark, sf), "validate", RULES).errors
    return bad.select(F.get_json_object("record", "$.event_id").cast("bigint").alias("event_id"), "message", "error_class")


@query(f"select event_id from {SPARSE} where value is not null and strlen(event_type) >= 5")
def validate_types_drop(spark, sf):
    rules = [
        {"field": "value", "type": "not_null"},
        {"field": "value", "type": "type_is", "expected": "float64"},
        {"field": "event_id", "type": "type_is", "expected": "int"},
        {"field": "event_type", "type": "length_min", "min": 5},
        {"field": "event_type", "type": "required"},
    ]
    return one(sparse_events(spark, sf), "validate", {"rules": rules, "on_failure": "drop"}).select("event_id")


@query()
def sample_bernoulli(spark, sf):
    """A tenth of the rows; which ones is a matter of chance, so only the sampling itself is stated."""
    return one(events(spark, sf), "sample", {"rate": 0.1, "seed": 7}).select("event_id", "event_type")


# ---------------------------------------------------------------- distinct, order, limits


@query("select min(event_id) as event_id, event_type, user_id from events group by event_type, user_id")
def distinct_fields(spark, sf):
    return one(events(spark, sf), "distinct", {"fields": ["event_type", "user_id"], "seq": "event_id"}).select("event_id", "event_type", "user_id")


@query("select distinct event_type, user_id from events")
def distinct_full(spark, sf):
    df = one(events(spark, sf), "project", {"fields": ["event_type", "user_id"]})
    return one(df, "distinct", {})


@query("""select event_id, user_id, event_type, round(value, 4) as value from (select *, row_number() over (partition by user_id, date_trunc('day', ts)
order by event_id) as rn from events) where rn = 1""")
def deduplicate_first(spark, sf):
    df = events(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    out = one(df, "deduplicate", {"keys": ["user_id", "day"], "seq": "event_id"})
    return rounded(out.select("event_id", "user_id", "event_type", "value"), "value")


@query("""with recursive e as materialized (select event_id, user_id, row_number() over (order by event_id) as n from events),
step as (select 0::bigint as n, [-1::bigint] as ring, false as kept, null::bigint as event_id, null::bigint as user_id union all
  select e.n, case when list_contains(ring, e.user_id) then ring else list_append(list_slice(ring, greatest(1, len(ring) - 48), len(ring)), e.user_id) end,
  not list_contains(ring, e.user_id), e.event_id, e.user_id from step join e on e.n = step.n + 1)
select event_id, user_id from step where kept""")
def deduplicate_ring(spark, sf):
    """Keys are forgotten after 50 others were kept."""
    config = {"keys": ["user_id"], "exact_window": True, "window_size": 50, "seq": "event_id"}
    return one(events(spark, sf), "deduplicate", config).select("event_id", "user_id")


def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a number that orders the lines of an order; line numbers alone repeat."""
    number = F.col("l_linenumber") * 10**14 + F.col("l_partkey") * 10**7 + F.col("l_suppkey")
    return table(spark, sf, "lineitem").withColumn("seq", number.cast("long"))


_LINES = "(select *, l_linenumber::bigint * 100000000000000 + l_partkey * 10000000 + l_suppkey as seq from lineitem)"


@query(f"""select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by seq desc) as rn
from {_LINES}) where rn = 1""")
def compact_by_pk(spark, sf):
    out = one(numbered_lines(spark, sf), "compact", {"keys": ["l_orderkey"], "seq": "seq"})
    return out.select("l_orderkey", "l_linenumber", "l_partkey")


@query("select o_orderkey, round(o_totalprice, 2) as o_totalprice, o_orderpriority from orders order by o_orderpriority desc, o_totalprice desc, o_orderkey limit 25")
def sort_limit_topk(spark, sf):
    """A top-k report: the limit is the feature."""
    fields = [{"field": "o_orderpriority", "order": "desc"}, {"field": "o_totalprice", "order": "desc"}]
    out = chain(table(spark, sf, "orders"), [("sort", {"fields": fields, "seq": "o_orderkey"}), ("limit", {"n": 25})]).ok
    return rounded(out.select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_totalprice", digits=2)


@query(f"select event_id from {SPARSE} order by value nulls first, event_id offset 100")
def skip_offset(spark, sf):
    out = chain(sparse_events(spark, sf), [("sort", {"fields": ["value"], "seq": "event_id"}), ("skip", {"n": 100})]).ok
    return out.select("event_id")


# ---------------------------------------------------------------- windows

_HOUR = """strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%dT%H:%M:%SZ') as window_start,
strftime(time_bucket(interval 1 hour, ts) + interval 1 hour, '%Y-%m-%dT%H:%M:%SZ') as window_end"""


@query(f"select {_HOUR}, event_type, count(*) as n, round(coalesce(sum(value), 0), 4) as total, round(coalesce(avg(value), 0), 4) as mean from {SPARSE} group by 1, 2, 3")
def window_count_sum_avg(spark, sf):
    aggregates = [{"func": "count", "alias": "n"}, {"func": "sum", "field": "value", "alias": "total"}, {"func": "avg", "field": "value", "alias": "mean"}]
    config = {"window_size_seconds": 3600, "group_by": ["event_type"], "aggregates": aggregates, "event_time": "ts"}
    return rounded(one(sparse_events(spark, sf), "window", config), "total", "mean")


@query("""select strftime(time_bucket(interval 1 minute, ts), '%Y-%m-%dT%H:%M:%SZ') as window_start,
strftime(time_bucket(interval 1 minute, ts) + interval 1 minute, '%Y-%m-%dT%H:%M:%SZ') as window_end, event_type,
count(*) as count, min(value) as low, max(value) as high, min(user_id)::double as first_user from events group by 1, 2, 3""")
def window_min_max(spark, sf):
    aggregates = [
        {"func": "count"},
        {"func": "min", "field": "value", "alias": "low"},
        {"func": "max", "field": "value", "alias": "high"},
        {"func": "min", "field": "user_id", "alias": "first_user"},
    ]
    return one(events(spark, sf), "window", {"group_by": ["event_type"], "aggregates": aggregates, "event_time": "ts"})


@query(f"""select {_HOUR}, user_id % 10 as bucket, arg_min(value, event_id) filter (where value is not null) as opening,
arg_max(struct_pack(v := value), event_id).v as closing from {SPARSE} group by 1, 2, 3""")
def window_first_last(spark, sf):
    df = sparse_events(spark, sf).withColumn("bucket", F.col("user_id") % 10)
    aggregates = [{"func": "first", "field": "value", "alias": "opening"}, {"func": "last", "field": "value", "alias": "closing"}]
    config = {"window_size_seconds": 3600, "group_by": ["bucket"], "aggregates": aggregates, "event_time": "ts", "seq": "event_id"}
    return one(df, "window", config)


@query("""select strftime(time_bucket(interval 7 days, ts, timestamp '2024-01-01'), '%Y-%m-%dT%H:%M:%SZ') as window_start,
strftime(time_bucket(interval 7 days, ts, timestamp '2024-01-01') + interval 7 days, '%Y-%m-%dT%H:%M:%SZ') as window_end, count(*) as count from events group by 1, 2""")
def window_7day_alignment(spark, sf):
    """Weeks begin on Mondays: windows are aligned to year 1, not to the epoch."""
    return one(events(spark, sf), "window", {"window_size_seconds": 604800, "event_time": "ts"})


@query(f"""with t as (select *, row_number() over (order by (event_id * 7919) % 100003, event_id) as arrival from events),
u as (select *, max(ts) over (order by arrival rows unbounded preceding) as seen from t)
select {_HOUR}, count(*) as count from u where ts >= seen - interval 20 days group by 1, 2""")
def window_late_drop(spark, sf):
    """Rows that arrive out of order and too late are dropped."""
    df = events(spark, sf).withColumn("order", (F.col("event_id") * 7919) % 100003 * 1_000_000_000 + F.col("event_id"))
    config = {"window_size_seconds": 3600, "event_time": "ts", "seq": "order", "allowed_lateness_seconds": 20 * 86400}
    return one(df, "window", config)


@query("""with w as (select time_bucket(interval 1 day, ts) as d, event_type, count(*) as n from events group by 1, 2)
select strftime(d, '%Y-%m-%dT%H:%M:%SZ') as window_start, event_type, n from w where n > 60""")
def window_then_filter(spark, sf):
    """A filter after a window is its HAVING."""
    steps = [
        ("window", {"window_size_seconds": 86400, "group_by": ["event_type"], "aggregates": [{"func": "count", "alias": "n"}], "event_time": "ts"}),
        ("filter", {"expression": "n > 60"}),
        ("drop_field", {"fields": ["window_end"]}),
    ]
    return chain(events(spark, sf), steps).ok


# ---------------------------------------------------------------- lookups and joins


def _segment(spark, sf):
    return {"dim": table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")}


@query("""select o_orderkey, c_mktsegment from orders left join (select * from customer where c_mktsegment = 'BUILDING') on o_custkey = c_custkey""")
def lookup_pass(spark, sf):
    config = {"table": "dim", "key": "o_custkey", "dim_key": "c_custkey", "fields": ["c_mktsegment"]}
    return one(table(spark, sf, "orders"), "lookup", config, tables=_segment(spark, sf)).select("o_orderkey", "c_mktsegment")


@query("""select o_orderkey, c_name as o_orderpriority from orders left join (select * from customer where c_mktsegment = 'BUILDING') on o_custkey = c_custkey""")
def lookup_null(spark, sf):
    """The looked-up field overwrites one that the row has; a miss makes it null."""
    dim = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_name", "o_orderpriority")
    config = {"table": "dim", "key": "o_custkey", "dim_key": "c_custkey", "fields": ["o_orderpriority"], "on_miss": "null"}
    return one(table(spark, sf, "orders"), "lookup", config, tables={"dim": dim}).select("o_orderkey", "o_orderpriority")


@query("""select o_orderkey, 'lookup: no row for o_custkey' as message from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def lookup_miss_dlq(spark, sf):
    config = {"table": "dim", "key": "o_custkey", "dim_key": "c_custkey", "fields": ["c_name"], "on_miss": "dlq"}
    bad = apply(table(spark, sf, "orders"), "lookup", config, Context(tables=_segment(spark, sf))).errors
    return bad.select(F.get_json_object("record", "$.o_orderkey").cast("bigint").alias("o_orderkey"), "message")


@query("""with d as (select o_custkey, o_orderkey as last_order from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) rn from orders) where rn = 1)
select c_custkey, last_order from customer left join d on c_custkey = o_custkey""")
def lookup_dup_dim_last_wins(spark, sf):
    dim = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "last_order")
    config = {"table": "dim", "key": "c_custkey", "dim_key": "o_custkey", "fields": ["last_order"], "dim_order": "last_order"}
    return one(table(spark, sf, "customer"), "lookup", config, tables={"dim": dim}).select("c_custkey", "last_order")


@query("select event_id, n_name as nation from events left join customer on user_id = c_custkey left join nation on c_nationkey = n_nationkey")
def lookup_query(spark, sf):
    """A query per row becomes one join."""
    text = "select n_name as nation, c_custkey from customer join nation on c_nationkey = n_nationkey where c_custkey = {{.user_id}}"
    tables = {"customer": table(spark, sf, "customer"), "nation": table(spark, sf, "nation")}
    config = {"mode": "query", "query": text, "fields": ["nation"]}
    return one(events(spark, sf), "lookup", config, tables=tables).select("event_id", "nation")


@query("""select c_custkey, count(o_orderkey) as n, coalesce(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey), '') as orders_list
from customer left join orders on c_custkey = o_custkey group by c_custkey""")
def enrich_sql_array(spark, sf):
    config = {"query": "select o_orderkey, o_custkey from orders where o_custkey = {{.c_custkey}}", "target_field": "found"}
    out = one(table(spark, sf, "customer"), "enricher", config, tables={"orders": table(spark, sf, "orders")})
    keys = F.transform("found", lambda x: x["o_orderkey"].cast("string"))
    return out.select("c_custkey", F.size("found").cast("long").alias("n"), F.array_join(keys, ",").alias("orders_list"))


_ASOF = """with e as (select *, max(case when {where} then event_id end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as prev from events),
j as (select e.event_id, e.user_id, p.event_type as prev_event_type, p.value as prev_value, p.ts as pts, e.ts as ts from e left join events p on p.event_id = e.prev)
select event_id, user_id, {cols} from j {cond}"""
_AGE = "(epoch_us(ts) - epoch_us(pts) < 36000000000)"
_CASE = f"case when {_AGE} then prev_event_type end as prev_event_type, case when {_AGE} then prev_value end as prev_value"
_JOIN = {"join_key": "user_id", "join_fields": ["event_type", "value"], "join_prefix": "prev_", "join_window_sec": 36000, "event_time": "ts", "seq": "event_id"}
_OUT = ["event_id", "user_id", "prev_event_type", "prev_value"]


@query(_ASOF.format(where="true", cols="prev_event_type, prev_value", cond=f"where {_AGE}"))
def asof_join_inner(spark, sf):
    return one(events(spark, sf), "join", _JOIN).select(*_OUT)


@query(_ASOF.format(where="true", cols=_CASE, cond=""))
def asof_join_left(spark, sf):
    return one(events(spark, sf), "join", {**_JOIN, "join_type": "left"}).select(*_OUT)


@query(_ASOF.format(where="event_type = 'click'", cols=_CASE, cond=""))
def asof_join_where(spark, sf):
    return one(events(spark, sf), "join", {**_JOIN, "join_type": "left", "where": "event_type == 'click'"}).select(*_OUT)


@query(_ASOF.format(where="value > 40", cols="event_id as missed", cond=f"where not coalesce({_AGE}, false)"))
def asof_join_miss_dlq(spark, sf):
    bad = apply(events(spark, sf), "join", {**_JOIN, "where": "value > 40", "on_miss": "dlq"}).errors
    get = lambda n: F.get_json_object("record", f"$.{n}").cast("bigint")
    return bad.select(get("event_id").alias("event_id"), get("user_id").alias("user_id"), get("event_id").alias("missed"))


# ---------------------------------------------------------------- graphs and routing


@query("""select event_id, 'high' as lane, event_type from events where value >= 80
union all select event_id, 'click' as lane, event_type from events where event_type = 'click'
union all select event_id, 'low' as lane, event_type from events where value < 5""")
def dag_route_union(spark, sf):
    """A row goes along every edge whose condition holds; what meets at a node is the union."""
    lanes = {"high": {"field": "value", "op": "ge", "value": 80}, "click": {"field": "event_type", "op": "eq", "value": "click"}, "low": {"field": "value", "op": "lt", "value": 5}}
    nodes = [{"id": "in", "kind": "source", "plugin": "table"}, {"id": "out", "kind": "sink", "plugin": "table"}]
    edges = []
    for name, condition in lanes.items():
        nodes.append({"id": name, "kind": "transform", "plugin": "add_field", "config": {"field": "lane", "value": name}})
        edges += [{"from": "in", "to": name, "condition": condition}, {"from": name, "to": "out"}]
    done = compile_spec({"name": "lanes", "nodes": nodes, "edges": edges}, events(spark, sf))
    return done.sinks["out"].select("event_id", "lane", "event_type")


@query("""select 'contains' as test, count(*) as n from events where contains(event_type, 'ic') union all
select 'regex', count(*) from events where regexp_matches(event_type, '^s.*p$') union all
select 'ne', count(*) from events where event_type <> 'view' union all
select 'absent', 0 union all select 'text', count(*) from events where cast(user_id as varchar) > '5'""")
def dag_edge_conditions(spark, sf):
    tests = {
        "contains": {"field": "event_type", "op": "contains", "value": "ic"},
        "regex": {"field": "event_type", "op": "regex", "value": "^s.*p$"},
        "ne": {"field": "event_type", "op": "ne", "value": "view"},
        "absent": {"field": "no_such", "op": "ne", "value": "x"},
        "text": {"field": "user_id", "op": "gt", "value": "5"},
    }
    nodes = [{"id": "in", "kind": "source", "plugin": "table"}] + [{"id": k, "kind": "sink", "plugin": "table"} for k in tests]
    edges = [{"from": "in", "to": k, "condition": c} for k, c in tests.items()]
    done = compile_spec({"name": "edges", "nodes": nodes, "edges": edges}, events(spark, sf))
    out = None
    for k in tests:
        part = done.sinks[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("test"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("select event_id, case event_type when 'click' then 'fast' when 'error' then 'alerts' else 'rest' end as route from events where event_type <> 'view'")
def router_default(spark, sf):
    """The router's choice is what edges test."""
    nodes = [
        {"id": "in", "kind": "source", "plugin": "table"},
        {"id": "r", "kind": "router", "config": {"field": "event_type", "routes": {"click": "fast", "error": "alerts", "view": "none"}, "default": "rest"}},
        {"id": "out", "kind": "sink", "plugin": "table"},
    ]
    edges = [{"from": "in", "to": "r"}, {"from": "r", "to": "out", "condition": {"field": "_route", "op": "ne", "value": "none"}}]
    done = compile_spec({"name": "routes", "nodes": nodes, "edges": edges}, events(spark, sf))
    return done.sinks["out"].select("event_id", F.col("_route").alias("route"))


# ---------------------------------------------------------------- change data


def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Change events as JSON text, derived from the events: c, u, d, r by event_id, every eleventh without an image."""
    e = events(spark, sf)
    image = F.to_json(F.struct("user_id", "event_type", "value"))
    letter = F.element_at(F.array(*map(F.lit, "curd")), (F.col("event_id") % 4 + 1).cast("int"))
    gap = F.col("event_id") % 11 == 0
    before = F.when(~gap & letter.isin("u", "d"), image).otherwise("null")
    after = F.when(~gap & letter.isin("c", "u", "r"), image).otherwise("null")
    source = F.when(F.col("event_id") % 2 == 0, '{"db":"shop","table":"orders"}').otherwise('{"db":"crm","table":"users_01"}')
    text = F.concat(
        F.lit('{"payload":{"before":'), before, F.lit(',"after":'), after, F.lit(',"op":"'), letter, F.lit('","source":'), source,
        F.lit(',"ts_ms":'), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit("}}"),
    )
    return e.select("event_id", text.alias("value"))


_ENV = """(select event_id, user_id, event_type, value, ts, case event_id % 4 when 0 then 'INSERT' when 1 then 'UPDATE' when 2 then 'INSERT' else 'DELETE' end as op,
case when event_id % 2 = 0 then 'shop' else 'crm' end as db, case when event_id % 2 = 0 then 'orders' else 'users_01' end as tab, event_id % 11 = 0 as gap from events)"""
_IMAGE = "user_id long, event_type string, value double"


@query(f"""select user_id, event_type, value, op, tab as _source_table, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as _event_time from {_ENV} where not gap""")
def envelope_normalize(spark, sf):
    out = apply(envelopes(spark, sf), "normalize_envelope", {"column": "value", "schema": _IMAGE}).ok
    return out.select("user_id", "event_type", "value", F.col("_meta.op").alias("op"), "_source_table", "_event_time")


@query(f"select event_id, 'data' as error_class, 'envelope: an operation without a row image' as message from {_ENV} where gap")
def envelope_errors(spark, sf):
    bad = apply(envelopes(spark, sf), "normalize_envelope", {"column": "value", "schema": _IMAGE}).errors
    return bad.select(F.get_json_object("record", "$.event_id").cast("bigint").alias("event_id"), "error_class", "message")


@query(f"select event_type, count(*) as n, count(value) as with_value from {_ENV} where not gap and db = 'crm' and op <> 'DELETE' group by event_type")
def cdc_policy_filter(spark, sf):
    steps = [
        ("debezium_cdc", {"column": "value", "schema": _IMAGE}),
        ("cdc_policy", {"include_databases": ["CRM*"], "exclude_tables": ["orders"], "skip_delete": True}),
    ]
    out = chain(envelopes(spark, sf), steps).ok
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("with_value"))


@query(f"""select case when db = 'shop' then 'ods_orders' else concat('crm_users_01_', strftime(ts, '%Y%m%d')) end as target, count(*) as n from {_ENV} where not gap or op = 'DELETE' group by 1""")
def cdc_table_mapping(spark, sf):
    config = {"column": "value", "schema": _IMAGE, "table_mapping": {"shop.orders": "ods_orders"}, "table_template": "{source_db}_{source_table}_{YYYYMMDD}"}
    out = apply(envelopes(spark, sf), "debezium_cdc", config).ok
    return out.groupBy(F.col("_meta.table").alias("target")).agg(F.count("*").alias("n"))


_DDL = ["ALTER TABLE {} ADD COLUMN c INT", "create table {} (id int)", "DROP TABLE {}", "truncate {}", "create index i on {} (a)"]


@query("""select p_partkey, ddl, case when p_partkey % 5 in (1, 4) then 'pass' else 'reject' end as verdict from (select p_partkey, replace(
list_extract(['ALTER TABLE {} ADD COLUMN c INT', 'create table {} (id int)', 'DROP TABLE {}', 'truncate {}', 'create index i on {} (a)'], p_partkey % 5 + 1),
'{}', concat('p', p_partkey)) as ddl from part)""")
def cdc_ddl_guard(spark, sf):
    """A statement per part."""
    form = F.element_at(F.array(*map(F.lit, _DDL)), (F.col("p_partkey") % 5 + 1).cast("int"))
    ddl = F.replace(form, F.lit("{}"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    df = table(spark, sf, "part").select("p_partkey", ddl.alias("ddl")).withColumn(META, meta(op=F.lit("DDL"), ddl=F.col("ddl")))
    out = apply(df, "ddl_guard", {})
    get = lambda n: F.get_json_object("record", f"$.{n}")
    bad = out.errors.select(get("p_partkey").cast("bigint").alias("p_partkey"), get("ddl").alias("ddl"), F.lit("reject").alias("verdict"))
    return out.ok.select("p_partkey", "ddl", F.lit("pass").alias("verdict")).unionByName(bad)


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes to customers, derived from orders: the order's key says what happens."""
    o = table(spark, sf, "orders").withColumn("op", F.when(F.col("o_orderkey") % 5 == 0, "DELETE").otherwise("UPDATE"))
    o = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "op", "o_orderkey")
    return o.withColumn(META, meta(op=F.col("op"), seq=F.col("o_orderkey"))).drop("op")


_CHANGES = """c as (select o_custkey, o_totalprice, o_orderkey % 5 = 0 as gone, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders)"""


@query(f"""with {_CHANGES} select c_custkey, round(case when o_custkey is null then c_acctbal else o_totalprice end, 2) as c_acctbal
from customer left join (select * from c where rn = 1) on o_custkey = c_custkey where not coalesce(gone, false)""")
def cdc_apply_latest(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(apply_changes(base, changes(spark, sf), ["c_custkey"], "o_orderkey").ok, "c_acctbal", digits=2)


@query(f"with {_CHANGES} select c_custkey from customer where c_custkey not in (select o_custkey from c where rn = 1 and gone)")
def cdc_apply_delete(spark, sf):
    """Delete keys come from the before-image."""
    base = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    ch = changes(spark, sf).withColumn("_before", F.struct("c_custkey"))
    done = apply_changes(base, ch.withColumn("c_custkey", F.when(F.col("_meta.op") != "DELETE", F.col("c_custkey"))), ["c_custkey"], "o_orderkey")
    return done.ok.select("c_custkey")


@query(f"""with {_CHANGES} select c_custkey, round(o_totalprice, 2) as c_acctbal from customer join c on o_custkey = c_custkey where rn = 1 and not gone""")
def cdc_log_rotation(spark, sf):
    """Changes of a log that begins a new file, with positions from 4 on, every hundred changes: the file counts first."""
    from riverloom.sources.sources import change_rows

    o = table(spark, sf, "orders")
    file = F.concat(F.lit("bin."), F.lpad(F.floor(F.col("o_orderkey") / 100).cast("string"), 6, "0"))
    source = F.struct(file.alias("file"), (F.lit(4) + (F.col("o_orderkey") % 100) * 917).alias("pos"), F.lit("shop").alias("db"), F.lit("customer").alias("table"))
    image = F.struct(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"))
    gone = F.col("o_orderkey") % 5 == 0
    body = F.struct(F.when(gone, image).alias("before"), F.when(~gone, image).alias("after"), F.when(gone, "d").otherwise("u").alias("op"), source.alias("source"), F.lit(0).alias("ts_ms"))
    lines = o.select(F.to_json(F.struct(body.alias("payload"))).alias("value"))
    rows = change_rows(lines, {"schema": "c_custkey long, c_acctbal double"}, Context(node="log")).ok
    base = rows.limit(0).select("c_custkey", "c_acctbal")
    rows = rows.withColumn("seq", F.col(f"{META}.seq"))
    return rounded(apply_changes(base, rows, ["c_custkey"], "seq").ok, "c_acctbal", digits=2)


@query("""with s as (select l_suppkey, sum(l_quantity) as q from lineitem group by 1)
select s_suppkey, round(s_acctbal + coalesce(q, 0), 2) as s_acctbal from supplier left join s on l_suppkey = s_suppkey""")
def increment_upsert(spark, sf):
    base = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_quantity").alias("s_acctbal"), F.col("l_orderkey").alias("seq"))
    return rounded(apply_changes(base, rows, ["s_suppkey"], "seq", "increment").ok, "s_acctbal", digits=2)


@query("""with base as (select c_custkey, c_acctbal from customer where c_mktsegment = 'BUILDING')
select c_custkey, round(c_acctbal, 2) as c_acctbal from base union all
select o_custkey, round(o_totalprice, 2) from (select *, row_number() over (partition by o_custkey order by o_orderkey) rn from orders
  where o_custkey not in (select c_custkey from base)) where rn = 1""")
def insert_ignore(spark, sf):
    """Rows that are there stay; the first of several new ones goes in."""
    base = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal")
    rows = changes(spark, sf).drop(META)
    return rounded(apply_changes(base, rows, ["c_custkey"], "o_orderkey", "insert").ok, "c_acctbal", digits=2)


@query(f"""select l_orderkey, l_partkey from (select *, row_number() over (partition by l_orderkey order by seq desc) rn from {_LINES}) where rn = 1 and l_returnflag <> 'R'""")
def final_view_versions(spark, sf):
    """Appended versions read as their newest, deleted ones left out."""
    from riverloom.sources.sinks import final_view

    rows = numbered_lines(spark, sf).withColumn("gone", F.col("l_returnflag") == "R")
    return final_view(rows, ["l_orderkey"], "seq", "gone").select("l_orderkey", "l_partkey")


# ---------------------------------------------------------------- rows to rows, SQL, code


@query("select event_id, unnest(string_split(concat(event_type, ',', cast(user_id as varchar), ',x'), ',')) as part from events")
def flat_map_explode(spark, sf):
    text = F.concat_ws(",", "event_type", F.col("user_id").cast("string"), F.lit("x"))
    df = events(spark, sf).select("event_id", text.alias("part"))
    return chain(df, [("cast", {"fields": {"part": "to_array"}}), ("flat_map", {"explode": "part"})]).ok


def split_metrics(row: dict) -> list[dict] | None:
    """One row per metric; views give none."""
    if row["event_type"] == "view":
        return None
    return [{"event_id": row["event_id"], "metric": k, "reading": float(row[k])} for k in ("user_id", "value")]


@query("""select event_id, 'user_id' as metric, user_id::double as reading from events where event_type <> 'view' union all
select event_id, 'value', value from events where event_type <> 'view'""")
def udtf_python(spark, sf):
    config = {"function": "split", "schema": "event_id long, metric string, reading double"}
    return one(events(spark, sf).select("event_id", "event_type", "user_id", "value"), "flat_map", config, functions={"split": split_metrics})


@query("""select n_name, c_mktsegment, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey group by 1, 2""")
def sql_model(spark, sf):
    text = "select n_name, c_mktsegment, count(*) as customers, round(sum(c_acctbal), 2) as balance from staged join nation on c_nationkey = n_nationkey group by 1, 2"
    return one(table(spark, sf, "customer"), "dbt", {"model": text, "source_table": "staged"}, tables={"nation": table(spark, sf, "nation")})


# ---------------------------------------------------------------- schemas, shards, sources


@query("""select event_id, event_type, null as source from events where event_id % 2 = 0 union all select event_id, null, 'b' from events where event_id % 2 = 1""")
def schema_drift_union(spark, sf):
    from riverloom.plans.compile import merge

    e = events(spark, sf)
    a = e.where("event_id % 2 = 0").select("event_id", "event_type")
    b = e.where("event_id % 2 = 1").select("event_id", F.lit("b").alias("source"))
    return merge([a, b])


@query("select event_id from events where event_id % 4 = 1")
def line_shard(spark, sf):
    from riverloom.sources.sources import shard

    return shard(events(spark, sf), {"strategy": "line_modulo", "total": 4, "index": 1, "seq": "event_id"}).select("event_id")


@query(f"""select event_id, event_type, {fnv_sql("concat(event_type, '-', cast(user_id as varchar))", 32)}::bigint as hash from events""")
def hash_shard(spark, sf):
    """FNV-1a of a key, by which rows are dealt to shards."""
    return events(spark, sf).select("event_id", "event_type", fnv32(F.concat_ws("-", "event_type", F.col("user_id").cast("string"))).alias("hash"))


@query("select range as n, range * 7 % 100 as r, 'demo' as s from range(1000)")
def demo_source(spark, sf):
    from riverloom.sources.sources import read

    return read(spark, "demo", {"count": 1000, "fields": {"n": "counter", "r": "random", "s": "static:demo"}}).ok.drop(META)


@query("""select user_id, event_type, case event_id % 4 when 3 then 'DELETE' when 1 then 'UPDATE' else 'INSERT' end as op from events where event_id % 11 <> 0""")
def kafka_envelope_decode(spark, sf):
    """Messages of a topic, as the connector delivers them, decoded."""
    from riverloom.sources.sources import decode_messages

    m = envelopes(spark, sf).select(
        F.col("event_id").cast("string").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.lit("t").alias("topic"),
        F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"),
    )
    out = decode_messages(m, {"format": "envelope", "schema": "user_id long, event_type string", "on_parse_error": "skip"}).ok
    return out.select("user_id", "event_type", F.col("_meta.op").alias("op"))


@query("""select cast(count(*) as bigint) as orders, round(sum(o_totalprice), 2) as total, o_orderstatus from orders
where o_orderpriority <> '5-LOW' group by o_orderstatus""")
def pushdown_aggregate(spark, sf):
    """Filters and columns reach the scan."""
    df = one(table(spark, sf, "orders"), "filter", {"expression": "o_orderpriority != '5-LOW'"})
    text = "select count(*) as orders, round(sum(o_totalprice), 2) as total, o_orderstatus from input group by o_orderstatus"
    return one(df, "sql", {"query": text})


@query(f"select {_HOUR}, event_type, count(*) as n from events group by 1, 2, 3")
def stream_window_available_now(spark, sf):
    """A file stream through the window operator, run to the end of what is there.

    Results go to files, none to the driver. All that is there is one batch, so each window is written once, as it stands
    at the end.
    """
    import tempfile
    from uuid import uuid4

    from riverloom.streaming.runner import file_stream

    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp()
    where = f"{shared.rstrip('/')}/stream-{uuid4().hex}"
    stream = file_stream(spark, sf, events(spark, sf).schema, pathGlobFilter="events.parquet")
    config = {"window_size_seconds": 3600, "group_by": ["event_type"], "aggregates": [{"func": "count", "alias": "n"}], "event_time": "ts", "allowed_lateness_seconds": 0}
    out = apply(stream, "window", config, Context(streaming=True)).ok
    q = out.writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.write.parquet(f"{where}/batch={n}"))
    q = q.option("checkpointLocation", f"{where}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/batch=*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
