"""Fill-in-the-middle transformation: DuckDB inside ``mapInArrow``.

Each Arrow batch is registered with an in-memory DuckDB of the task, one SQL statement cuts, orders and rebuilds
the texts, and its Arrow result goes on: no Python per row. A text is cut by ``regexp_extract_all`` into blocks
of 32 code points; ``list_slice`` takes whole blocks and, from the block that holds a cut, single code points;
``array_to_string`` puts them together. Blocks keep the lists at a thirty-second of the code points, so a text of
any length that Arrow can hold is cut in memory of a few times its size.

Defined results: a null text is empty, hence plain; a null doc_id counts as the empty string behind the seed;
repeated rows give a row each; an empty table gives no row. Rows are independent, so ties do not arise. Further
columns are dropped unless named in ``keep``; names of this operator in ``keep`` are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .memory import task
from .textkit import utf8_chunks

#: Marks of the three parts. A text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Memory that one task's DuckDB may take; it has no folder to spill to.
MEMORY = "700MB"
_OWN = ("n", "form", "prefix_chars", "middle_chars", "output", "restored", "output_sha256", "restored_sha256")
_BLOCK = 32


def _statement(seed: int, plain_from: int, spm_below: int) -> str:
    def chars(block: str) -> str:
        return f"regexp_extract_all(coalesce({block}, ''), '(?s).')"

    def group(i: int) -> str:
        return f"('0x' || substr(digest, {8 * i + 1}, 8))::UBIGINT"

    def units(block: str, lo: str, hi: str) -> str:
        return f"array_to_string(list_slice({chars(block)}, {lo}, {hi}), '')"

    def blocks(lo: str, hi: str) -> str:
        return f"array_to_string(list_slice(blocks, {lo}, {hi}), '')"

    return f"""
WITH cut AS (
  SELECT place, doc_id, text, regexp_extract_all(text, '(?s).{{1,{_BLOCK}}}') AS blocks, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM (SELECT place, doc_id, coalesce(text, '') AS text FROM batch)),
sized AS (SELECT *, CASE WHEN len(blocks) = 0 THEN 0 ELSE {_BLOCK} * (len(blocks) - 1) + len({chars('blocks[len(blocks)]')}) END::BIGINT AS n FROM cut),
placed AS (
  SELECT *, least({group(0)} % (n + 1), {group(1)} % (n + 1))::BIGINT AS a, greatest({group(0)} % (n + 1), {group(1)} % (n + 1))::BIGINT AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {group(2)} % 100 >= {plain_from} THEN 'plain'
      WHEN {group(3)} % 100 < {spm_below} THEN 'spm' ELSE 'psm' END AS form
  FROM sized),
blocked AS (SELECT *, a // {_BLOCK} AS i, b // {_BLOCK} AS j, a % {_BLOCK} AS r, b % {_BLOCK} AS s FROM placed),
parted AS (
  SELECT place, doc_id, n, form, a, b, text,
    CASE WHEN form <> 'plain' THEN {blocks('1', 'i')} || {units('blocks[i + 1]', '1', 'r')} END AS prefix,
    CASE WHEN form = 'plain' THEN NULL WHEN i = j THEN {units('blocks[i + 1]', 'r + 1', 's')}
      ELSE {units('blocks[i + 1]', 'r + 1', str(_BLOCK))} || {blocks('i + 2', 'j')} || {units('blocks[j + 1]', '1', 's')} END AS middle,
    CASE WHEN form <> 'plain' THEN {units('blocks[j + 1]', 's + 1', str(_BLOCK))} || {blocks('j + 2', 'len(blocks)')} END AS suffix
  FROM blocked),
written AS (
  SELECT place, doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END AS output
  FROM parted),
read AS (SELECT *, {restored_sql('output', 'form')} AS restored FROM written)
SELECT place, doc_id, n, form, prefix_chars, middle_chars, output, restored, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM read ORDER BY place"""


def restored_sql(output: str, form: str) -> str:
    """DuckDB SQL of the text, from an output and its form alone. A text holds no mark, so each mark stands once."""
    outer, inner = f"string_split({output}, '{MIDDLE}')", f"string_split(string_split({output}, '{MIDDLE}')[1]"
    psm = f"substr({inner}, '{SUFFIX}')[1], {len(PREFIX) + 1}) || {outer}[2] || {inner}, '{SUFFIX}')[2]"
    spm = f"{inner}, '{PREFIX}')[2] || {outer}[2] || substr({inner}, '{PREFIX}')[1], {len(SUFFIX) + 1})"
    return f"CASE {form} WHEN 'psm' THEN {psm} WHEN 'spm' THEN {spm} ELSE {output} END"


def _runner(statement: str, names: list[str], columns: list[str]):
    @task("fill_middle")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as con:
            for whole in batches:
                text = whole.column("text")
                for lo, hi, _, _ in utf8_chunks(text):
                    part = whole.slice(lo, hi - lo)
                    rows = pa.table({"place": pa.array(range(hi - lo), pa.int64()), "doc_id": part.column("doc_id"), "text": part.column("text")})
                    con.register("batch", rows)
                    found = con.execute(statement).to_arrow_table().combine_chunks()
                    con.unregister("batch")
                    kept = [part.column(c) for c in names]
                    own = [found.column(c).combine_chunks() for c in columns]
                    yield from pa.Table.from_arrays([*kept, *own], names=[*names, *columns]).to_batches()

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, keep: list[str] | None = None, texts: bool = True) -> DataFrame:
    """doc_id, [keep], n, form, prefix_chars, middle_chars, [output, restored,] output_sha256, restored_sha256.

    ``doc_id`` may be of any type that has a decimal form. Of 100 parts, those from ``plain_from`` on stay plain, and of
    the others those below ``spm_below`` get the suffix first. ``restored`` is rebuilt from output and form."""
    keep = list(keep or [])
    if taken := {c.lower() for c in keep} & {*_OWN, "doc_id", "place"}:
        raise ValueError(f"columns of the result cannot be kept beside it: {sorted(taken)}")
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in keep if c.lower() != "text"])
    columns = [c for c in _OWN if texts or c not in ("output", "restored")]
    kinds = {"n": T.LongType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType()}
    carried = [f for f in plain.schema.fields if f.name != "text" or "text" in keep]
    schema = T.StructType([*carried, *[T.StructField(c, kinds.get(c, T.StringType())) for c in columns]])
    return plain.mapInArrow(_runner(_statement(seed, plain_from, spm_below), [f.name for f in carried], columns), schema)


def op12_duckdb_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: seed 1, nine of ten documents cut, a fifth of these suffix first."""
    return fill_in_middle(table(spark, sf_dir, "documents"), texts=False)


def oracle() -> str:
    """The contract by character positions, without blocks or lists."""
    return """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (SELECT doc_id, t, n, ('0x' || h[1:8])::UBIGINT % (n + 1) AS p, ('0x' || h[9:16])::UBIGINT % (n + 1) AS q, ('0x' || h[17:24])::UBIGINT % 100 AS u, ('0x' || h[25:32])::UBIGINT % 100 AS v FROM drawn),
formed AS (SELECT *, CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') OR u >= 90 THEN 'plain' WHEN v < 20 THEN 'spm' ELSE 'psm' END AS form, least(p, q)::BIGINT AS a, greatest(p, q)::BIGINT AS b FROM numbers),
parts AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1) AS z FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', x, '<S>', z, '<M>', y) ELSE concat('<S>', z, '<P>', x, '<M>', y) END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts"""
