"""Grids, samples and pseudo engines."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written


def grid(*dimensions: DataFrame) -> DataFrame:
    """All combinations of small dimension tables."""
    out = dimensions[0]
    for d in dimensions[1:]:
        out = out.crossJoin(d)
    return out


def interleaved(items: DataFrame, engines: DataFrame, reps: int) -> DataFrame:
    """Schedule by repetition, then item, then engine, so that drift hits all engines alike."""
    spark = items.sparkSession
    return grid(spark.range(1, reps + 1).select(F.col("id").cast("int").alias("rep")), items, engines).orderBy("rep", *items.columns, *engines.columns)


def hash_sample(df: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """``share`` of the rows without replacement: those whose SHA-256 of seed and key is least. The number is exact.

    A histogram of the first three hex digits (4096 counts at most) tells in which bin the sample ends; only that
    bin is ordered, so no task sorts the sample."""
    rows = df.withColumn("_digest", F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)).withColumn("_bin", F.substring("_digest", 1, 3))
    counts = sorted((r["_bin"], r["count"]) for r in rows.groupBy("_bin").count().collect())
    n = sum(c for _, c in counts)
    left, last = max(1, int(n * share + 0.5)) if n else 0, ""
    for last, c in counts:
        if c >= left:
            break
        left -= c
    edge = rows.filter(F.col("_bin") == last).orderBy("_digest", key).limit(left)
    return rows.filter(F.col("_bin") < last).unionByName(edge).drop("_digest", "_bin")


#: Rows of a stratum that are drawn from at once, on average.
LEAF = 1024


def resample(df: DataFrame, stratum: str, order: str, seed: int) -> DataFrame:
    """One stratified resample with replacement: each stratum keeps its size, rows come as often as they are drawn.

    The draws of a stratum go down a binary tree over the hashes of ``order``: a node gives each of its draws to its left half with the
    share of rows there (one binomial number), so the counts at the leaves are exactly multinomial. A leaf deals its draws to
    its rows, about ``LEAF`` of them. Every number comes from a generator seeded by seed, stratum and node: the result depends on
    the rows alone, not on how they are partitioned, and no stratum is gathered. ``order`` should tell rows apart: rows
    of one value are drawn from together, in one leaf. A null stratum is a stratum of its own."""
    place = F.shiftrightunsigned(F.xxhash64(F.col(order)), 1)  # 63 bits
    most = df.groupBy(stratum).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    depth = max(0, (most // LEAF).bit_length())
    rows = df.withColumns({"_leaf": F.shiftright(place, 63 - depth) if depth else F.lit(0).cast("long"), "_place": place})
    leaves = written(rows.groupBy(F.col(stratum).alias("_s"), "_leaf").agg(F.count("*").alias("_n")))
    name = F.coalesce(F.col("_s").cast("string"), F.lit("\x00"))

    def level(k: int) -> DataFrame:
        return leaves.groupBy("_s", F.shiftright("_leaf", depth - k).alias("_node")).agg(F.sum("_n").alias("_n"))

    draws = level(0).select("_s", "_node", "_n", F.col("_n").alias("_draws"))
    for k in range(1, depth + 1):
        above = draws.select(F.col("_s").alias("_t"), F.col("_node").alias("_up"), F.col("_n").alias("_all"), "_draws")
        below = level(k).join(above, F.col("_s").eqNullSafe(F.col("_t")) & (F.shiftright("_node", 1) == F.col("_up")))
        left = F.col("_node") % 2 == 0
        share = F.when(left, F.col("_n")).otherwise(F.col("_all") - F.col("_n")) / F.col("_all")
        given = binomial(F.concat_ws("|", F.lit(seed), F.lit(k), F.col("_up"), name), F.col("_draws"), share)
        split = below.withColumn("_left", given)
        draws = split.select("_s", "_node", "_n", F.when(left, F.col("_left")).otherwise(F.col("_draws") - F.col("_left")).alias("_draws"))
        if k % 8 == 0:
            draws = written(draws)

    columns = df.columns

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_place", order], kind="stable")
        first = rows.iloc[0]
        rng = _generator(f"{seed}|leaf|{first['_leaf']}|{first['_name']}")
        times = rng.multinomial(int(first["_draws"]), np.full(len(rows), 1 / len(rows)))
        return rows.iloc[np.repeat(np.arange(len(rows)), times)][columns]

    wanted = draws.select(F.col("_s").alias("_t"), F.col("_node").alias("_drawn"), "_draws", name.alias("_name"))
    held = rows.join(wanted, F.col(stratum).eqNullSafe(F.col("_t")) & (F.col("_leaf") == F.col("_drawn"))).drop("_t", "_drawn")
    return held.groupBy("_name", "_leaf").applyInPandas(deal, df.schema)


def _generator(name: str) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(name.encode()).digest()[:16], "big")))


def binomial(name: Column, n: Column, share: Column) -> Column:
    """A binomial number for each row, from a generator seeded by its name."""

    @F.pandas_udf("long")
    def drawn(names: pd.Series, ns: pd.Series, shares: pd.Series) -> pd.Series:
        return pd.Series([_generator(a).binomial(int(k), min(max(p, 0.0), 1.0)) for a, k, p in zip(names, ns, shares, strict=True)], dtype="int64")

    return drawn(name, n, share)


#: What is put into a text; of further ones there are as many as are needed.
SYMBOLS = "#@~^"


def _free_symbols(text: str, symbols: str) -> list[str]:
    """Those that the text does not hold; if it holds them all, the first letter of a further alphabet that it does not."""
    free = [s for s in symbols if s not in text]
    return free or [next(chr(c) for c in range(0x2580, 0x110000) if chr(c) not in text and not 0xD800 <= c < 0xE000)]


def perturb(text: str, kind: str, k: int, name: str, symbols: str = SYMBOLS) -> tuple[str, int]:
    """(text at edit distance exactly n, n): n substitutions, deletions or insertions of symbols that the text does not hold,
    at places drawn from the SHA-256 of ``name``. No place is white space or next to it (an insertion: between two
    others), so that the distance is n after the normal form too. n is ``k``, or less if there are not so many places."""
    rng = np.random.Generator(np.random.PCG64(int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)))
    free = _free_symbols(text, symbols)
    ink = np.array([not c.isspace() for c in text], bool)
    if kind == "insert":
        room = np.flatnonzero(ink[1:] & ink[:-1]) + 1
        places = rng.choice(room, k).tolist() if len(room) else []
    elif kind in ("substitute", "delete"):
        inner = ink.copy()
        inner[1:] &= ink[:-1]
        inner[:-1] &= ink[1:]
        room = np.flatnonzero(inner)
        places = rng.choice(room, min(k, len(room)), replace=False).tolist() if len(room) else []
    else:
        raise ValueError(f"unknown kind {kind!r}")
    new = [free[i] for i in rng.integers(len(free), size=len(places)).tolist()]
    chars = list(text)
    for at, symbol in sorted(zip(places, new, strict=True), reverse=True):
        chars[at : at + (kind != "insert")] = [] if kind == "delete" else [symbol]
    return "".join(chars), len(places)


def perturbed(df: DataFrame, text: str, name: str, kind: str, k: int, symbols: str = SYMBOLS) -> DataFrame:
    """Adds ``read`` and ``injected``."""

    @F.pandas_udf("read string, injected int")
    def run(t: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([perturb(a, kind, k, str(b), symbols) if a is not None else (None, None) for a, b in zip(t, n, strict=True)], columns=["read", "injected"])

    return df.withColumn("_p", run(text, F.col(name).cast("string"))).select("*", "_p.read", "_p.injected").drop("_p")


def jittered(b: Column, name: Column, share: float = 0.1) -> Column:
    """The box moved by up to ``share`` of its height each way, by the hash of a name."""
    from ..functions.geometry import box

    def offset(salt: str) -> Column:
        return (F.pmod(F.xxhash64(name, F.lit(salt)), F.lit(2001)) - 1000) / 1000.0 * share * b["h"]

    return box(b["x"] + offset("x"), b["y"] + offset("y"), b["w"], b["h"])


def lock(entries: DataFrame, key: str) -> DataFrame:
    """One row with a map of all entries by key; a null entry is left out."""
    columns = [c for c in entries.columns if c != key]
    some = entries.filter(F.coalesce(*columns).isNotNull()) if columns else entries
    return some.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, F.struct(*columns).alias("entry"))))).alias("lock"))


def stages_from(stages: Column, first: Column) -> Column:
    """The stages from a named one on; an unknown name is an error."""
    at = F.array_position(stages, first)
    return F.when(at > 0, F.slice(stages, at.cast("int"), F.size(stages))).otherwise(F.raise_error(F.concat(F.lit("unknown stage "), first)))
