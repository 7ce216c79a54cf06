"""Queries on what engines give: words to lines by each engine's rule, documents read back, schedules, and intervals by every method."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import generators, statistics
from ..operators.tables import read, shared_folder
from ..sources import readers
from .measures import _T, _clusters
from .registry import query

_WORDS = """src AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ln FROM lineitem),
word AS (SELECT l_orderkey AS image_id, ln // 4 AS block, ln % 2 AS par, ln AS line, k AS word_num, CASE WHEN (l_partkey + k) % 13 = 0 THEN ' ' ELSE 'w' || (l_partkey % 97) || chr(96 + k::INT) END AS text, ((l_suppkey + 7 * k) % 102 - 1)::DOUBLE AS conf,
  ((l_partkey % 40) + 30 * k)::DOUBLE AS x, (30 * ln + k % 2)::DOUBLE AS y, (10 + k * 3)::DOUBLE AS w, (16 + k)::DOUBLE AS h FROM src, (SELECT unnest([1, 2, 3]) AS k))"""


def _words(spark, sf_dir):
    from .standin import gt_lines

    rows = gt_lines(spark, sf_dir).select("image_id", "ln", "l_partkey", "l_suppkey", F.explode(F.array(*[F.lit(i) for i in (3, 1, 2)])).alias("k"))
    k, ln = F.col("k"), F.col("ln")
    text = F.when((F.col("l_partkey") + k) % 13 == 0, " ").otherwise(F.concat(F.lit("w"), (F.col("l_partkey") % 97).cast("string"), F.char(96 + k)))
    b = G.box(F.col("l_partkey") % 40 + 30 * k, 30 * ln + k % 2, 10 + k * 3, 16 + k)
    return rows.select("image_id", F.floor(ln / 4).alias("block"), (ln % 2).alias("par"), ln.alias("line"), k.alias("word_num"), text.alias("text"), ((F.col("l_suppkey") + 7 * k) % 102 - 1).cast("double").alias("conf"), b.alias("b"))


def _rule(name: str, conf: str, scale: str = "1") -> str:
    return f"SELECT '{name}' AS rule, image_id, block, par, line, string_agg(text, ' ' ORDER BY word_num) AS text, min(x) * {scale} AS x, min(y) * {scale} AS y, round((max(x + w) - min(x)) * {scale}, 6) AS w, round((max(y + h) - min(y)) * {scale}, 6) AS h, {conf} AS confidence FROM word WHERE trim(text) <> '' AND conf >= 0 GROUP BY ALL"


@query(f"""WITH {_WORDS} {_rule("tesseract", "round(avg(conf) / 100, 6)")} UNION ALL {_rule("doctr", "round(min(conf), 6)", "2")} UNION ALL {_rule("windows", "NULL::DOUBLE")}""")
def a16_lines_by_engine(spark, sf_dir):
    """Words to lines through one reader by the rules of three engines."""
    words = _words(spark, sf_dir).withColumns({"image_width": F.lit(2.0), "image_height": F.lit(2.0)})
    return readers.word_lines_by(words, list(readers.WORD_RULES)).select("rule", "image_id", "block", "par", "line", "text", "b.x", "b.y", F.round("b.w", 6).alias("w"), F.round("b.h", 6).alias("h"), F.round("confidence", 6).alias("confidence"))


@query("""WITH l AS (SELECT n_name AS base_id, c_custkey, c_name, c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT base_id, count(*)::BIGINT AS lines, count(*) FILTER (c_custkey % 7 = 0)::BIGINT AS stress, sum(c_custkey % 50)::DOUBLE AS left_edges, md5(string_agg(c_name, '|' ORDER BY c_custkey)) AS digest FROM l GROUP BY base_id""")
def r04_truth_documents(spark, sf_dir):
    """Documents of truth, one JSON file each, written, read by the declared schema and looked up by their id."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("base_id"))
    line = F.struct(F.col("c_custkey").alias("order"), F.struct(F.format_string("L%08d", "c_custkey").alias("line_id"), F.col("c_name").alias("text"), F.array((F.col("c_custkey") % 50).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("layout_box"), (F.col("c_custkey") % 7 == 0).alias("stress")).alias("line"))
    docs = read(spark, sf_dir, "customer").join(F.broadcast(nations), "c_nationkey").groupBy("base_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    path = f"{shared_folder(spark)}/inkgrid-truth/{uuid.uuid4().hex}"
    docs.withColumn("file", F.col("base_id")).repartition("file").write.partitionBy("file").json(path)
    lines = readers.truth_lines(readers.truth(spark, f"{path}/*/*.json"))
    wanted = nations.join(lines, "base_id")  # the lookup is a join
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda x: x["text"]), "|")
    return wanted.groupBy("base_id").agg(F.count("*").alias("lines"), F.count_if("stress").alias("stress"), F.sum(F.get("layout_box", F.lit(0))).alias("left_edges"), F.md5(text.cast("binary")).alias("digest"))


@query("""WITH s AS (SELECT source, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes FROM (SELECT source, unnest(string_split(replace(coalesce(text, ''), chr(13), ' '), chr(10))) AS text FROM documents) GROUP BY source)
SELECT source, bytes, bytes * 10 AS projected, bytes * 10 <= 10000000 AS fits FROM s""")
def r09_bytes_of_trees(spark, sf_dir):
    """Bytes of folders that were written, and whether ten times as much would fit."""
    text = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" ")), "\n", -1)
    lines = read(spark, sf_dir, "documents").select("source", F.explode(text).alias("value"))
    path = f"{shared_folder(spark)}/inkgrid-bytes/{uuid.uuid4().hex}"
    lines.write.partitionBy("source").text(path)
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "length")
    found = sizes.groupBy("source").agg(F.sum("length").alias("bytes"))
    return found.select("source", "bytes", (F.col("bytes") * 10).alias("projected"), (F.col("bytes") * 10 <= 10_000_000).alias("fits"))


@query("""SELECT (row_number() OVER (ORDER BY rep, s_suppkey, r_name) - 1)::INT AS place, rep, s_suppkey, r_name AS engine FROM supplier, region, (SELECT unnest([1, 2])::INT AS rep)""")
def e12_interleaved_schedule(spark, sf_dir):
    """The order of runs: repetition, then item, then engine."""
    items, engines = read(spark, sf_dir, "supplier").select("s_suppkey"), read(spark, sf_dir, "region").select(F.col("r_name").alias("engine"))
    runs = generators.interleaved(items, engines, 2)
    # numbered over ranges of the order, which the sort has dealt out already
    from ..operators.scans import running_totals

    placed = running_totals(runs.withColumn("all", F.lit(0)), ["all"], [F.col("rep"), F.col("s_suppkey"), F.col("engine")], {"place": F.lit(1).cast("long")})
    return placed.select(F.col("place").cast("int").alias("place"), "rep", "s_suppkey", "engine")


def _each(names, estimate: str, ordered: str = "true", undefined: str = "false") -> str:
    return " UNION ALL ".join(f"SELECT cell, '{n}' AS method, {estimate} AS estimate, {ordered} AS ordered, {undefined} AS undefined FROM s" for n in names)


#: Totals of a cell, and whether its linearised error is one: with one cluster a stratum, or none that differ, there is none.
_SUMS = f"""WITH {_T}, w AS (SELECT *, sum(l) OVER c AS ll, sum(ea) OVER c AS aa, sum(eb) OVER c AS bb FROM t WINDOW c AS (PARTITION BY cell)),
v AS (SELECT cell, stratum, any_value(aa) AS a, any_value(bb) AS b, any_value(ll) AS l, CASE WHEN count(*) >= 2 THEN var_pop(ea / nullif(aa, 0) - eb / nullif(bb, 0)) ELSE 0 END AS spread FROM w GROUP BY ALL),
s AS (SELECT cell, any_value(a) AS a, any_value(b) AS b, any_value(l) AS l, coalesce(sum(spread), 0) > 0 AND any_value(a) > 0 AND any_value(b) > 0 AS varies FROM v GROUP BY cell)"""


def _by_method(spark, sf_dir, columns, methods):
    """One interval a cell and method: the estimate, and whether it lies between the ends."""
    rows, found = _clusters(spark, sf_dir), None
    for name in methods:
        one = statistics.intervals(rows, ["cell"], "cluster", "stratum", columns, name, b=199)
        told = one.select("cell", F.lit(name).alias("method"), F.round("estimate", 8).alias("estimate"), ((F.col("lo") <= F.col("estimate")) & (F.col("estimate") <= F.col("hi"))).alias("ordered"), "undefined")
        found = told if found is None else found.unionByName(told)
    return found


@query(f"{_SUMS} {_each(statistics.METHODS[2], 'round(a / l, 8)')}")
def q04_ratio_methods(spark, sf_dir):
    """The ratio and its interval by every method."""
    return _by_method(spark, sf_dir, ["ea", "l"], statistics.METHODS[2])


_PLAIN = [m for m in statistics.METHODS[4] if not m.startswith("log")]
_LOG = [m for m in statistics.METHODS[4] if m.startswith("log")]


@query(f"{_SUMS} {_each(_PLAIN, 'round(a / l - b / l, 8)')}")
def q05_difference_methods(spark, sf_dir):
    """The paired difference and its interval by every method."""
    return _by_method(spark, sf_dir, ["ea", "l", "eb", "l"], _PLAIN)


@query(f"{_SUMS} {_each(_LOG, 'round((a / l) / (b / l), 8)', 'CASE WHEN varies THEN true END', 'NOT varies')}")
def q07_quotient_methods(spark, sf_dir):
    """The quotient of two rates and its interval by every method."""
    return _by_method(spark, sf_dir, ["ea", "l", "eb", "l"], _LOG)
