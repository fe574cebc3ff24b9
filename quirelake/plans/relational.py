"""Queries of the relational operators over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import codecs, geometry, numeric
from quirelake.operators import graph, ranges, search, state

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Search and replace -----------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE contains(text, 'the ')")
def text_find_cs(spark, d):
    return search.find_text(read(spark, d, "documents"), "the ").select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def text_find_ci(spark, d):
    return search.find_text(read(spark, d, "documents"), "the", True).select("doc_id")


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)an')) AS n FROM documents")
def text_occurrences(spark, d):
    return read(spark, d, "documents").select("doc_id", search.occurrences(F.col("text"), "an", True).cast("long").alias("n"))


@query("SELECT doc_id, (length(text) - length(replace(replace(text, 'eee', 'ee'), 'ee', 'e'))) AS rough, len(list_filter(range(1, length(text)), lambda i: substr(text, i, 2) = 'th')) AS n FROM documents")
def text_occurrences_overlapping(spark, d):
    t = F.col("text")
    rough = F.length(t) - F.length(search.replaced(search.replaced(t, "eee", "ee"), "ee", "e"))
    return read(spark, d, "documents").select("doc_id", rough.cast("long").alias("rough"), search.occurrences(t, "th", overlapping=True).cast("long").alias("n"))


@query("SELECT doc_id, md5(replace(text, 'the', 'THAT')) AS text_md5 FROM documents")
def text_replace_cs(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(search.replaced(F.col("text"), "the", "THAT")).alias("text_md5"))


@query("SELECT doc_id, md5(regexp_replace(text, 'the', 'a$b', 'gi')) AS text_md5 FROM documents")
def text_replace_ci(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(search.replaced(F.col("text"), "the", "a$b", True)).alias("text_md5"))


@query("SELECT conv_id, turn FROM conversations WHERE NOT contains(text, 'the')")
def text_delete_matching(spark, d):
    return search.delete_text(read(spark, d, "conversations"), "the").select("conv_id", "turn")


# References, trees, revisions -------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def ref_deref(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    targets = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_mktsegment")
    return graph.deref(orders, targets, ["key"]).select("o_orderkey", F.col("to_c_name").alias("c_name"), F.col("to_c_mktsegment").alias("c_mktsegment"))


@query("SELECT l_orderkey, l_linenumber, n_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def multi_hop_resource(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("o_orderkey"))
    hop = graph.deref(lines, read(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_").withColumnRenamed("o_o_custkey", "c_custkey")
    hop = graph.deref(hop, read(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_custkey"], "c_").withColumnRenamed("c_c_nationkey", "n_nationkey")
    hop = graph.deref(hop, read(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], "n_")
    return hop.select("l_orderkey", "l_linenumber", F.col("n_n_name").alias("n_name"))


def _tree(spark, d) -> DataFrame:
    regions = read(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("value"))
    nations = read(spark, d, "nation").select((F.col("n_nationkey") + 2000).cast("long").alias("id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("value"))
    customers = read(spark, d, "customer").select((F.col("c_custkey") + 10000).alias("id"), (F.col("c_nationkey") + 2000).cast("long").alias("parent"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).alias("value"))
    return regions.unionByName(nations).unionByName(customers)


TREE = """nodes(id, parent, value) AS (SELECT cast(r_regionkey + 1000 AS BIGINT), NULL::BIGINT, r_name FROM region
  UNION ALL SELECT n_nationkey + 2000, n_regionkey + 1000, CASE WHEN n_nationkey % 3 = 0 THEN n_name END FROM nation
  UNION ALL SELECT c_custkey + 10000, c_nationkey + 2000, CASE WHEN c_custkey % 5 = 0 THEN c_name END FROM customer)"""


@query(f"WITH RECURSIVE {TREE}, t(id, depth, path) AS (SELECT id, 0, cast(id AS VARCHAR) FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, t.depth + 1, t.path || '/' || n.id FROM t JOIN nodes n ON n.parent = t.id) SELECT * FROM t")
def tree_expand(spark, d):
    return graph.expanded(_tree(spark, d), "parent IS NULL")


@query(f"WITH RECURSIVE {TREE}, t(id, value) AS (SELECT id, value FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, coalesce(n.value, t.value) FROM t JOIN nodes n ON n.parent = t.id) SELECT * FROM t")
def inherit_attr(spark, d):
    return graph.inherited(_tree(spark, d), "parent IS NULL")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def revision_merge(spark, d):
    return state.latest(read(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_acctbal + 2 FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 3 <> 0")
def union_first_wins(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return graph.first_wins([c.where("key % 7 = 0"), c.where("key % 3 = 0").withColumn("value", F.col("value") + 1), c.withColumn("value", F.col("value") + 2)], ["key"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def delete_by_key(spark, d):
    """Customers without any order; as NOT IN has it, one without a key stays only where no order has a key."""
    keys = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).where("c_custkey IS NOT NULL")
    kept = graph.deleted(read(spark, d, "customer").select("c_custkey", "c_name"), keys, ["c_custkey"])
    return kept.join(keys.limit(1).select(F.lit(True).alias("_any")), F.col("c_custkey").isNull(), "left_anti")


# Aggregates -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, string_agg(cast(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS members, count(*) AS n FROM lineitem GROUP BY 1")
def group_by_container(spark, d):
    item = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(item, lambda x: x["l_linenumber"].cast("string")), ",").alias("members"), F.count("*").alias("n"))


@query("SELECT max(o_orderkey) AS max_key, max(o_orderkey) + 1 AS next_key, count(*) AS n FROM orders")
def next_key(spark, d):
    return read(spark, d, "orders").agg(F.max("o_orderkey").alias("max_key"), (F.max("o_orderkey") + 1).alias("next_key"), F.count("*").alias("n"))


@query("SELECT vec_id, min(x) AS llx, min(y) AS lly, max(x) AS urx, max(y) AS ury FROM (SELECT vec_id, embedding[i] AS x, embedding[i + 1] AS y FROM embeddings, range(1, 64, 2) r(i)) GROUP BY 1")
def bounds_minmax(spark, d):
    return read(spark, d, "embeddings").select("vec_id", geometry.bounds(F.col("embedding")).alias("b")).select("vec_id", "b.*")


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1")
def ordered_concat(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page_index"), F.col("turn").alias("elem_idx"), "text")
    return search.page_text(rows).select(F.col("doc_id").alias("conv_id"), F.md5("text").alias("text_md5"))


@query("SELECT lang, string_agg(cast(n AS VARCHAR), ',' ORDER BY n) AS lengths FROM (SELECT DISTINCT lang, length(source) AS n FROM documents) GROUP BY 1")
def distinct_lengths(spark, d):
    own = F.array_join(F.transform(F.array_sort(F.collect_set(F.length("source"))), lambda n: n.cast("string")), ",")
    return read(spark, d, "documents").groupBy("lang").agg(own.alias("lengths"))


@query("""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}]')) / greatest(length(text), 1) >= 0.05 THEN 'cjk' WHEN len(regexp_extract_all(text, '[\\x{00C0}-\\x{024F}]')) / greatest(length(text), 1) >= 0.05 THEN 'accented'
  WHEN len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1) >= 0.05 THEN 'digits' WHEN len(regexp_extract_all(text, '[A-Za-z]')) / greatest(length(text), 1) >= 0.05 THEN 'letters' ELSE 'other' END AS label FROM documents""")
def class_count_label(spark, d):
    return read(spark, d, "documents").select("doc_id", codecs.character_label(F.col("text")).alias("label"))


@query("SELECT event_type, max_by(value, struct_pack(a := ts, b := event_id)) AS last_value, count(*) AS n FROM events GROUP BY 1")
def map_last_write_wins(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.count("*").alias("n"))


# Ordered state ----------------------------------------------------------------------------------


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS font FROM events")
def carry_forward_state(spark, d):
    return state.carried(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "click", F.col("value")), "font").select("event_id", "font")


@query("SELECT event_id, cast(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM events")
def running_block_id(spark, d):
    return state.ordinal(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", "block").select("event_id", "block")


@query("SELECT event_id, cast(sum(CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM events")
def nesting_depth(spark, d):
    return state.depth(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "click", "depth").select("event_id", "depth")


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR event_type IS DISTINCT FROM before")
def drop_consecutive_duplicates(spark, d):
    return state.without_repeats(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id")


@query("""WITH r AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM events)
SELECT user_id, cast(run AS BIGINT) AS run, string_agg(event_type, '>' ORDER BY ts, event_id) AS steps FROM r GROUP BY user_id, run HAVING bool_or(event_type = 'purchase')""")
def islands_to_rows(spark, d):
    rows = state.islands(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type"), "steps")
    return rows.select("user_id", F.col("run").cast("long").alias("run"), F.array_join("steps", ">").alias("steps"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def topk_recent(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(20)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'click') WHERE r = 1")
def first_match_only(spark, d):
    return state.first_match(read(spark, d, "events").where("event_type = 'click'").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("""WITH b AS (SELECT conv_id, turn::DOUBLE AS pos, 1 AS fresh, text FROM conversations UNION ALL SELECT DISTINCT conv_id, 1::DOUBLE, 0, 'inserted' FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos, fresh) - 1 AS turn, md5(text) AS text_md5 FROM b""")
def insert_at_index(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "text")
    new = c.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("inserted").alias("text"), F.lit(1).alias("at"))
    return state.inserted(c, new, ["conv_id"], "turn").select("conv_id", F.col("turn").cast("long").alias("turn"), F.md5("text").alias("text_md5"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events")
def row_index(spark, d):
    return state.indexed(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "idx").select("event_id", "idx")


# Geometry and numbers ---------------------------------------------------------------------------


@query("SELECT p_partkey, p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 900 AND 1500 AS inside FROM part")
def rect_contains(spark, d):
    r = geometry.rect(F.lit(30.0), F.lit(1500.0), F.lit(10.0), F.lit(900.0))
    return read(spark, d, "part").select("p_partkey", geometry.contains(r, F.col("p_size"), F.col("p_retailprice")).alias("inside"))


RECTS = "r AS (SELECT vec_id AS id, least(x, x + w) AS llx, least(y, y + h) AS lly, greatest(x, x + w) AS urx, greatest(y, y + h) AS ury FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS w, embedding[4]::DOUBLE AS h FROM embeddings))"


def _rects(spark: SparkSession, d: str) -> DataFrame:
    v = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), geometry.rect(v[0], v[1], v[0] + v[2], v[1] + v[3]).alias("r"))


@query(f"WITH {RECTS} SELECT a.id AS a_id, b.id AS b_id FROM r a, r b WHERE NOT (a.urx < b.llx OR b.urx < a.llx OR a.ury < b.lly OR b.ury < a.lly)")
def rect_intersects(spark, d):
    """All rows against all rows, each with itself too; rect_intersects_all has each pair of one table once."""
    r = _rects(spark, d)
    return ranges.overlapping(r, r, 0.05)


@query(f"WITH {RECTS} SELECT a.id AS a_id, b.id AS b_id FROM r a, r b WHERE a.id < b.id AND NOT (a.urx < b.llx OR b.urx < a.llx OR a.ury < b.lly OR b.ury < a.lly)")
def rect_intersects_all(spark, d):
    return ranges.overlapping_pairs(_rects(spark, d), 0.05)


@query("SELECT p_partkey, label FROM part LEFT JOIN (VALUES (1, 9, 'small'), (10, 24, 'medium'), (25, 49, 'large')) t(lo, hi, label) ON p_size BETWEEN lo AND hi")
def range_lookup(spark, d):
    t = spark.createDataFrame([(1, 9, "small"), (10, 24, "medium"), (25, 49, "large")], "lo int, hi int, label string")
    return ranges.range_lookup(read(spark, d, "part").select("p_partkey", "p_size"), "p_size", t, 8).select("p_partkey", "label")


@query("SELECT vec_id, round(embedding[1]::DOUBLE * 3 + embedding[3]::DOUBLE * 4 + embedding[5]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE * 3 + embedding[4]::DOUBLE * 4 + embedding[6]::DOUBLE, 6) AS y FROM embeddings")
def matrix_transform(spark, d):
    m = geometry.array_matrix(F.transform("embedding", lambda v: v.cast("double")))
    x, y = geometry.transform(F.col("m"), F.lit(3.0), F.lit(4.0))
    return read(spark, d, "embeddings").select("vec_id", m.alias("m")).select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("""WITH m AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d, embedding[5]::DOUBLE AS e, embedding[6]::DOUBLE AS f FROM embeddings)
SELECT vec_id, abs(a * d - b * c) >= 1e-10 AS invertible, CASE WHEN abs(a * d - b * c) >= 1e-10 THEN 1 END AS one FROM m""")
def matrix_inverse(spark, d):
    m = geometry.array_matrix(F.transform("embedding", lambda v: v.cast("double")))
    back = geometry.multiply(F.col("m"), geometry.inverse(F.col("m")))
    near = (F.abs(back["a"] - 1) < 1e-3) & (F.abs(back["b"]) < 1e-3) & (F.abs(back["e"]) < 1e-3)
    return read(spark, d, "embeddings").select("vec_id", m.alias("m")).select("vec_id", geometry.inverse(F.col("m")).isNotNull().alias("invertible"), F.when(near, 1).alias("one"))


@query("SELECT l_orderkey, l_linenumber, round(0.1 + pow(l_discount, 1.5) * 0.8, 6) AS v FROM lineitem")
def exp_interp(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.get(numeric.exponential(F.col("l_discount"), [0.1], [0.9], 1.5), F.lit(0)), 6).alias("v"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount < 0.04 THEN l_discount / 0.04 * 0.5 ELSE 1 - pow((l_discount - 0.04) / 0.06, 2) END, 6) AS v FROM lineitem")
def stitch(spark, d):
    parts = [lambda x: x * 0.5, lambda x: 1 - F.pow(x, F.lit(2.0))]
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(numeric.stitched(F.col("l_discount"), [0.04], (0.0, 0.1), [(0, 1), (0, 1)], parts), 6).alias("v"))


@query("SELECT l_orderkey, l_linenumber, round(s[i + 1] + (x - i) * (s[i + 2] - s[i + 1]), 6) AS v FROM (SELECT *, least(floor(x), 3)::INT AS i, [0.0, 1.0, 4.0, 9.0, 16.0]::DOUBLE[] AS s FROM (SELECT l_orderkey, l_linenumber, least(greatest(l_discount * 10, 0), 1) * 4 AS x FROM lineitem))")
def sampled_1d(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(numeric.sampled(F.col("l_discount") * 10, [0, 1, 4, 9, 16]), 6).alias("v"))


@query("SELECT l_orderkey, l_linenumber, round((1 - x) * (1 - y) * 0 + x * (1 - y) * 1 + (1 - x) * y * 2 + x * y * 5, 6) AS v FROM (SELECT l_orderkey, l_linenumber, least(l_discount * 10, 1) AS x, least(l_tax * 10, 1) AS y FROM lineitem)")
def bilinear(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(numeric.bilinear(F.col("l_discount") * 10, F.col("l_tax") * 10, [[0, 1], [2, 5]]), 6).alias("v"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 25 THEN l_quantity * l_discount ELSE sqrt(l_quantity) + floor(l_tax * 100) END, 6) AS v FROM lineitem")
def ps_calculator(spark, d):
    program = "{ 3 1 roll exch dup 25 gt { mul exch pop } { sqrt exch pop exch 100 mul floor add } ifelse }"
    v = numeric.program(program, F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))[-1]
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(v, 6).alias("v"))


@query("""SELECT vec_id, ch(1) AS r, ch(2) AS g, ch(3) AS b FROM (SELECT vec_id, embedding FROM embeddings)""".replace("ch(1)", "greatest(0, least(255, trunc((1 - abs(embedding[1])::DOUBLE) * (1 - abs(embedding[4])::DOUBLE) * 255)::INT))").replace("ch(2)", "greatest(0, least(255, trunc((1 - abs(embedding[2])::DOUBLE) * (1 - abs(embedding[4])::DOUBLE) * 255)::INT))").replace("ch(3)", "greatest(0, least(255, trunc((1 - abs(embedding[3])::DOUBLE) * (1 - abs(embedding[4])::DOUBLE) * 255)::INT))"))
def cmyk_to_rgb(spark, d):
    v = [F.abs(F.get("embedding", F.lit(i))).cast("double") for i in range(4)]
    r, g, b = geometry.cmyk_to_rgb(*v)
    return read(spark, d, "embeddings").select("vec_id", r.alias("r"), g.alias("g"), b.alias("b"))


# Strings and keys -------------------------------------------------------------------------------


@query("SELECT doc_id, hex(encode(source)) AS as_hex, source AS back, md5(text) AS m, sha256(text) AS s FROM documents")
def hex_codec_digest(spark, d):
    return read(spark, d, "documents").select("doc_id", F.hex(F.col("source").cast("binary")).alias("as_hex"), codecs.latin1(codecs.from_hex(F.hex(F.col("source").cast("binary")))).alias("back"), F.md5("text").alias("m"), F.sha2("text", 256).alias("s"))


@query("SELECT doc_id, md5(text) AS back_md5, md5(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '(', '\\('), ')', '\\)'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) AS escaped_md5 FROM documents")
def literal_escape(spark, d):
    e = codecs.escape_literal(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(codecs.unescape_literal(e)).alias("back_md5"), F.md5(e).alias("escaped_md5"))


@query("SELECT c_custkey, replace(replace(c_name, '#', '#23'), ' ', '#20') AS name, c_name AS back FROM customer")
def name_escape(spark, d):
    e = codecs.escape_name(F.col("c_name"))
    return read(spark, d, "customer").select("c_custkey", e.alias("name"), codecs.unescape_name(e).alias("back"))


@query("SELECT c_custkey, c_custkey || ' ' || c_nationkey AS key, c_custkey::INT AS num, c_nationkey AS gen FROM customer")
def object_key(spark, d):
    k = codecs.key(F.col("c_custkey"), F.col("c_nationkey"))
    num, gen = codecs.key_parts(k)
    return read(spark, d, "customer").select("c_custkey", k.alias("key"), num.alias("num"), gen.alias("gen"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN (n_chars // 1024) || ' KB' ELSE (n_chars // 1048576) || ' MB' END AS label FROM documents")
def file_size_label(spark, d):
    return read(spark, d, "documents").select("doc_id", codecs.file_size(F.col("n_chars")).alias("label"))


@query("SELECT o_orderkey, strftime(o_orderdate, 'D:%Y%m%d%H%M%S') AS stamp FROM orders")
def pdf_date_format(spark, d):
    return read(spark, d, "orders").select("o_orderkey", codecs.date_string(F.col("o_orderdate")).alias("stamp"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN cast(l_extendedprice::BIGINT AS VARCHAR) ELSE regexp_replace(printf('%.6f', l_extendedprice), '\\.?0+$', '') END AS price, CASE WHEN l_tax = floor(l_tax) THEN cast(l_tax::BIGINT AS VARCHAR) ELSE regexp_replace(printf('%.6f', l_tax), '\\.?0+$', '') END AS tax FROM lineitem")
def number_format(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", codecs.show_number(F.col("l_extendedprice")).alias("price"), codecs.show_number(F.col("l_tax")).alias("tax"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN cast(l_quantity::BIGINT AS VARCHAR) ELSE regexp_replace(printf('%.6f', l_quantity), '\\.?0+$', '') END AS q, CASE WHEN l_discount = floor(l_discount) THEN cast(l_discount::BIGINT AS VARCHAR) ELSE regexp_replace(printf('%.6f', l_discount), '\\.?0+$', '') END AS dsc FROM lineitem")
def number_format_all(spark, d):
    """Zero is '0', and null has no text."""
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", codecs.show_number(F.col("l_quantity")).alias("q"), codecs.show_number(F.col("l_discount")).alias("dsc"))


@query("SELECT event_id, coalesce(try_cast(event_type AS DOUBLE), 0) AS a, coalesce(try_cast(cast(value AS VARCHAR) AS DOUBLE), 0) AS b FROM events")
def soft_cast(spark, d):
    return read(spark, d, "events").select("event_id", codecs.soft_number(F.col("event_type")).alias("a"), codecs.soft_number(F.col("value").cast("string")).alias("b"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing') IS NULL AS missing FROM events")
def json_project(spark, d):
    v = F.try_parse_json("props")
    return read(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "string").isNull().alias("missing"))


@query("SELECT vec_id, (label + 1) * 256 + label AS code, label + 1 BETWEEN 1 AND 4 AND label BETWEEN 0 AND 9 AS fits FROM embeddings")
def codespace_predicate(spark, d):
    code = F.unhex(F.lpad(F.hex((F.col("label") + 1) * 256 + F.col("label")), 4, "0"))
    return read(spark, d, "embeddings").select("vec_id", code.alias("raw")).select("vec_id", codecs.big_endian(F.col("raw")).cast("int").alias("code"), codecs.fits_codespace(F.col("raw"), b"\x01\x00", b"\x04\x09").alias("fits"))


@query("SELECT n_name, regexp_matches(upper(n_name), 'WINGDING|WEBDING|DINGBAT|SYMBOL') AS symbol, CASE WHEN n_nationkey % 4 = 0 THEN 'Adobe-GB1-UCS2' WHEN n_nationkey % 4 = 1 THEN 'Adobe-Japan1-UCS2' END AS ucs2 FROM nation")
def font_classifiers(spark, d):
    ordering = F.when(F.col("n_nationkey") % 4 == 0, "GB1").when(F.col("n_nationkey") % 4 == 1, "Japan1").otherwise("Identity")
    return read(spark, d, "nation").select("n_name", codecs.symbol_font(F.col("n_name")).alias("symbol"), codecs.ucs2_map(ordering).alias("ucs2"))
