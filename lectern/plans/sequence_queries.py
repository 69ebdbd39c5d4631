"""Queries on order: islands, gaps, likeness, repeats, clocks, as-of matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import sequences, timing

from .catalogue import query, table


@query(
    "key_islands",
    """SELECT min(k) AS first, max(k) AS last, count(*) AS n FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem)) GROUP BY g""",
)
def key_islands(spark, sf_dir):
    return sequences.global_islands(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("key_missing", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def key_missing(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(items, "o_orderkey", "left_anti").select("o_orderkey")


# Rows of an order by place: the line numbers repeat and have gaps, as verse numbers do.
LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax) AS pos FROM lineitem"
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query(
    "line_sequence_quality",
    f"""WITH x AS (SELECT l_orderkey, pos, l_linenumber AS v, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY pos) AS b FROM ({LINES})),
    c AS (SELECT l_orderkey, count(*) FILTER (WHERE v > b + 1) AS jumps, count(*) FILTER (WHERE v < b) AS restarts, count(*) FILTER (WHERE v < b) AS reversals,
          count(v) - count(DISTINCT v) AS repeated, count(v) AS n,
          avg(CASE WHEN b IS NULL THEN NULL WHEN v - b IN (0, 1) OR (v IN (1, 2) AND b >= v) THEN 1.0 WHEN v - b = 2 THEN 0.5 ELSE 0.0 END) AS a FROM x GROUP BY l_orderkey)
    SELECT l_orderkey, jumps, restarts, reversals, repeated, n, CASE WHEN n >= 5 THEN a ELSE 0.0 END AS likeness FROM c""",
)
def line_sequence_quality(spark, sf_dir):
    rows = lines(spark, sf_dir)
    args = (["l_orderkey"], LINE_ORDER, "l_linenumber")
    return sequences.verse_likeness(rows, *args).join(sequences.jumps(rows, *args), "l_orderkey").join(sequences.order_faults(rows, *args), "l_orderkey")


@query(
    "line_gap_tramos",
    """SELECT l_orderkey, min(v) AS first, max(v) AS last, count(*) AS n
       FROM (SELECT l_orderkey, v, v - row_number() OVER (PARTITION BY l_orderkey ORDER BY v) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber AS v FROM lineitem)) GROUP BY l_orderkey, g""",
)
def line_gap_tramos(spark, sf_dir):
    return sequences.islands(lines(spark, sf_dir), ["l_orderkey"], "l_linenumber")


@query(
    "line_missing_numbers",
    """SELECT k AS l_orderkey, n::INTEGER AS l_linenumber FROM (SELECT l_orderkey AS k, unnest(range(1, max(l_linenumber) + 1)) AS n FROM lineitem GROUP BY l_orderkey)
       WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k AND l_linenumber = n)""",
)
def line_missing_numbers(spark, sf_dir):
    return sequences.missing(lines(spark, sf_dir), ["l_orderkey"], "l_linenumber", "l_linenumber")


@query(
    "line_repeat_suffix",
    f"""SELECT l_orderkey, pos::INTEGER AS pos, CASE WHEN k > 1 THEN l_linenumber || '#' || k ELSE l_linenumber::VARCHAR END AS key
        FROM (SELECT l_orderkey, pos, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY pos) AS k FROM ({LINES}))""",
)
def line_repeat_suffix(spark, sf_dir):
    from pyspark.sql import Window

    rows = lines(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))
    return sequences.unique_labels(rows, ["l_orderkey"], ["pos"], "l_linenumber").select("l_orderkey", "pos", "key")


@query(
    "line_lis",
    f"""WITH RECURSIVE x AS (SELECT l_orderkey AS k, pos, l_linenumber AS v FROM ({LINES})),
    r AS (SELECT k, pos, v, 1 AS n FROM x UNION SELECT x.k, x.pos, x.v, r.n + 1 FROM r JOIN x ON x.k = r.k AND x.pos > r.pos AND x.v > r.v)
    SELECT k AS l_orderkey, max(n)::INTEGER AS rising FROM r GROUP BY k""",
)
def line_lis(spark, sf_dir):
    return sequences.rising(lines(spark, sf_dir), ["l_orderkey"], LINE_ORDER, "l_linenumber")


@query(
    "line_chapter_likeness",
    f"""WITH RECURSIVE x AS (SELECT l_orderkey AS k, pos, l_linenumber AS v FROM ({LINES})), e AS (SELECT k, v, pos FROM x WHERE v BETWEEN 1 AND 5),
    r AS (SELECT k, pos, v, 1 AS n FROM e UNION SELECT e.k, e.pos, e.v, r.n + 1 FROM r JOIN e ON e.k = r.k AND e.pos > r.pos AND e.v > r.v),
    t AS (SELECT k, max(n) AS up FROM r GROUP BY k)
    SELECT x.k AS l_orderkey, CASE WHEN count(*) - coalesce(max(up), 0) > 3 THEN 0.0::DOUBLE ELSE coalesce(max(up), 0) / 5::DOUBLE END AS likeness FROM x LEFT JOIN t ON t.k = x.k GROUP BY x.k""",
)
def line_chapter_likeness(spark, sf_dir):
    return sequences.chapter_likeness(lines(spark, sf_dir).withColumn("expected", F.lit(5)), ["l_orderkey"], LINE_ORDER, "l_linenumber", "expected")


@query(
    "line_label_runs",
    f"""WITH x AS (SELECT l_orderkey, pos, l_linenumber AS v, CASE WHEN l_linenumber = lag(l_linenumber) OVER w + 1 THEN 0 ELSE 1 END AS new FROM ({LINES}) WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY pos) AS run FROM x),
    s AS (SELECT l_orderkey, run, arg_min(v, pos) AS a, arg_max(v, pos) AS b FROM r GROUP BY l_orderkey, run),
    l AS (SELECT l_orderkey, list(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END ORDER BY run) AS p FROM s GROUP BY l_orderkey)
    SELECT l_orderkey, array_to_string(p[1:6], ', ') || CASE WHEN len(p) > 6 THEN '…' ELSE '' END AS runs FROM l""",
)
def line_label_runs(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("label", F.col("l_linenumber").cast("string"))
    return sequences.label_runs(rows, ["l_orderkey"], LINE_ORDER, "label")


@query(
    "turn_context",
    "SELECT conv_id, turn, right(lag(text) OVER w, 600) AS before, left(lead(text) OVER w, 600) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def turn_context(spark, sf_dir):
    return timing.context(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "before", "after")


@query(
    "turn_clock",
    """WITH x AS (SELECT conv_id, turn, regexp_extract_all(text, '[^ \\t\\n]+') AS w FROM conversations),
    y AS (SELECT conv_id, turn, 0.20 + len(w) * (0.12 + 0.06) + 0.05 * coalesce(list_sum(list_transform(w, lambda a: len(a))), 0) + 0.25 AS s FROM x)
    SELECT conv_id, turn, round(coalesce(sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3)::DOUBLE AS start FROM y""",
)
def turn_clock(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\n]+"), F.lit(0))
    rows = table(spark, sf_dir, "conversations").withColumn("words", words)
    return timing.clock(rows, ["conv_id"], ["turn"], timing.spoken_seconds(F.col("words")), F.lit(250)).select("conv_id", "turn", "start")


@query(
    "first_match_asof",
    """SELECT v.event_id, p.value AS next_value, p.ts AS next_ts
       FROM (SELECT * FROM events WHERE event_type <> 'purchase') v
       ASOF LEFT JOIN (SELECT user_id, ts, min(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON v.user_id = p.user_id AND v.ts <= p.ts""",
)
def first_match_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("next_ts"), F.col("value").alias("next_value"))
    asked = events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    found = timing.asof_forward(asked, bought.withColumn("at", F.col("next_ts")), ["user_id"], "ts", "next_ts", ["next_value", "at"])
    return found.select("event_id", "next_value", F.col("at").alias("next_ts"))


@query(
    "events_between_marks",
    """WITH x AS (SELECT user_id, event_type, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM events),
    p AS (SELECT user_id, part, bool_or(event_type = 'view') AS has FROM x WHERE part > 0 GROUP BY user_id, part)
    SELECT user_id, count(*) AS marks, count(*) FILTER (WHERE has) AS filled FROM p GROUP BY user_id""",
)
def events_between_marks(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return timing.marks_with_content(events, ["user_id"], "at", F.col("event_type") == "purchase", F.col("event_type") == "view")
