"""Sinks. Spark commits each as a whole; none needs a temporary file of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, the keys of maps sorted."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.MapType):
            c = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def csv(df: DataFrame, path: str) -> None:
    flat(df).write.option("header", True).csv(path)


def json(df: DataFrame, path: str, single: bool = False) -> None:
    """``single`` for small summaries only: one task writes one file."""
    (df.coalesce(1) if single else df).write.json(path)


def parquet(df: DataFrame, path: str, by: list[str] = ()) -> None:
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)


def bundle(tables: dict[str, DataFrame], path: str) -> None:
    """A CSV and a Parquet folder for each table."""
    for name, df in tables.items():
        csv(df, f"{path}/{name}.csv")
        parquet(df, f"{path}/{name}.parquet")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def stream_json(df: DataFrame, path: str, checkpoint: str):
    """Streaming JSON lines sink that ends when the source has no more."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_lines(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.concat(F.lit(name + " "), F.to_json(F.struct("*"))).alias("value"))


def missing_outputs(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work that is left: wanted keys without an output."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


#: Entries that one sitemap may hold, fixed by its format.
SITEMAP_ENTRIES = 50_000


def xml_text(value: Column) -> Column:
    """Text as XML writes it; control characters that XML cannot hold are left out."""
    out = F.regexp_replace(value, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def sitemap(entries: DataFrame, path: str, per_file: int = SITEMAP_ENTRIES) -> None:
    """XML sitemaps of (loc, lastmod, changefreq, priority, alternates), each of up to ``per_file`` entries in the order of loc.

    ``alternates`` is an array of struct<hreflang, href>. Entries are numbered by a running total spread over ranges, so files are
    full but for the last; a file is a folder ``file=<n>`` with one part. Entries without loc are left out, null fields are not written."""
    from ..operators.scans import running_totals

    tag = lambda name: F.when(F.col(name).isNotNull(), F.concat(F.lit(f"    <{name}>"), xml_text(F.col(name).cast("string")), F.lit(f"</{name}>\n")))
    link = lambda a: F.concat(F.lit('    <xhtml:link rel="alternate" hreflang="'), xml_text(a["hreflang"]), F.lit('" href="'), xml_text(a["href"]), F.lit('"/>\n'))
    body = F.concat(F.lit("  <url>\n"), *[F.coalesce(tag(c), F.lit("")) for c in ("loc", "lastmod", "changefreq", "priority")], F.coalesce(F.array_join(F.transform("alternates", link), ""), F.lit("")), F.lit("  </url>"))
    rows = entries.filter("loc IS NOT NULL").select(F.lit(0).alias("_all"), "loc", body.alias("value"))
    placed = running_totals(rows, ["_all"], [F.col("loc")], {"n": F.lit(1).cast("long")})
    placed = placed.select(F.floor(F.col("n") / per_file).alias("file"), "n", "value")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml">'
    files = placed.select("file").distinct()
    ends = files.select("file", F.lit(-1).cast("long").alias("n"), F.lit(head).alias("value")).unionByName(files.select("file", F.lit(2**62).alias("n"), F.lit("</urlset>").alias("value")))
    placed.unionByName(ends).repartition("file").sortWithinPartitions("file", "n").select("file", "value").write.partitionBy("file").text(path)
