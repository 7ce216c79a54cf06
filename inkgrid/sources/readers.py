"""Sources with explicit schemas; missing fields read as null, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX_ARRAY = "array<double>"
MANIFEST = (
    "image_id string, file string, base_id string, template_id string, form_factor string, source string, device string, os string, browser string, dpr double, theme string, "
    "variant string, format string, quality int, chroma_subsampling string, lossless boolean, downscale double, width int, height int, bytes bigint, bpp double, psnr_vs_v00 double, "
    "ssim_vs_v00 double, encoder string, encoder_settings string, sha256 string, pixel_sha256 string, ocr boolean, license string, generator_source_sha256 string"
)
TRUTH_LINE = (
    f"struct<line_id:string,text:string,layout_box:{BOX_ARRAY},ink_box:{BOX_ARRAY},ink_pixels:bigint,ink_box_half:{BOX_ARRAY},ink_pixels_half:bigint,font_family:string,font_weight:int,"
    f"css_px:double,xheight_px:double,capheight_px:double,fg_rgba:{BOX_ARRAY},bg_rgba:{BOX_ARRAY},contrast_ratio:double,category:string,stress:boolean,element_idx:int>"
)
TRUTH = f"base_id string, template_id string, form_factor string, dpr double, theme string, width int, height int, browser string, lines array<{TRUTH_LINE}>, ignore_regions array<{BOX_ARRAY}>, icon_regions array<{BOX_ARRAY}>, downscaled_0p5 struct<filter:string,pad_px:int,ink_threshold:int,unowned_ink_pixels:bigint,ignore_regions:array<{BOX_ARRAY}>,icon_regions:array<{BOX_ARRAY}>>"
PREDICTION = (
    "engine_id string, engine_version string, config string, image_id string, status string, error string, total_s double, detect_s double, recognize_s double, orchestrator_wall_s double, "
    "attempts int, input_file_sha256_ok boolean, input_pixel_sha256_ok boolean, input_pixel_sha256 string, peak_rss_mb double, peak_rss_scope string, "
    "container_states array<struct<oom_killed:boolean,exit_code:int,status:string,inspect_error:string>>, memory_limit string, "
    f"lines array<struct<bbox:{BOX_ARRAY},text:string,confidence:double>>, pass string, conditions string, completed_at timestamp"
)
TIMING = "rep int, image_id string, engine_id string, status string, total_s double, orchestrator_wall_s double, width int, height int, form_factor string, at timestamp"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a byte order mark and blank lines are skipped, a line that does not parse goes to ``_corrupt``."""
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).filter(F.trim("value") != "")
    parsed = text.select(F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.select("r.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def truth(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(TRUTH).option("multiLine", True).json(path)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """folder/engine/*.json; the engine is the folder's name."""
    rows = spark.read.schema(PREDICTION).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("engine_id", F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1))


def timings(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, TIMING)


def truth_lines(documents: DataFrame) -> DataFrame:
    """A row a line: base_id, line number, and the fields of the line."""
    return documents.select("base_id", F.posexplode("lines").alias("g", "_l")).select("base_id", "g", "_l.*")


def prediction_lines(documents: DataFrame) -> DataFrame:
    rows = documents.select("engine_id", "image_id", F.posexplode("lines").alias("p", "_l"))
    b = F.col("_l.bbox")
    return rows.select("engine_id", "image_id", "p", F.col("_l.text").alias("text"), F.struct(*[F.get(b, F.lit(i)).alias(n) for i, n in enumerate("xywh")]).alias("b"), F.col("_l.confidence").alias("confidence"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: path, height, width, channels, data (BGR), from the built-in image source."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def masks(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width, ink: number of set pixels of 1-channel images."""
    bytes_ = F.split(F.regexp_replace(F.hex("data"), "(..)", "$1 "), " ")
    return images(spark, path).select("origin", "height", "width", F.size(F.filter(bytes_, lambda x: (x != "") & (x != "00"))).alias("ink"))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of png, jpg and jpeg files, contents not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").option("recursiveFileLookup", True).load(path).select("path", "length").orderBy("path")


def tree_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def hash_tree(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def differing_files(found: DataFrame, locked: DataFrame) -> DataFrame:
    """path and what is wrong: missing, unexpected or changed."""
    joined = found.withColumnRenamed("sha256", "_now").join(locked, "path", "full_outer")
    why = F.when(F.col("_now").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("_now") != F.col("sha256"), "changed")
    return joined.select("path", why.alias("problem")).filter("problem IS NOT NULL")


def fingerprint(hashes: DataFrame) -> DataFrame:
    """One SHA-256 over the sorted (path, hash) lines."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["path"], F.lit(" "), x["sha256"], F.lit("\n")))
    return hashes.agg(F.sha2(F.array_join(lines, ""), 256).alias("fingerprint"))


def stage_logs(lines: DataFrame) -> DataFrame:
    """Name and fields of structured log lines ``<name> {json}``; other lines are left out."""
    return lines.select(F.regexp_extract("value", r"(\w+) \{", 1).alias("name"), F.from_json(F.regexp_extract("value", r"(\{.*\})$", 1), "map<string,double>").alias("fields")).filter("name <> '' AND fields IS NOT NULL")


#: How engines' words become lines: confidence of a line, whether it is out of 100, and whether boxes are shares of the image.
WORD_RULES = {"tesseract": ("mean", 100.0, False), "doctr": ("least", 1.0, True), "windows": (None, 1.0, False)}


def word_lines(words: DataFrame, rule: str = "tesseract") -> DataFrame:
    """Words (image_id, block, par, line, word_num, text, conf, b) to lines: text in word order, box around. Blank words and those of
    negative confidence are left out, and so are lines without a word.

    ``tesseract``: mean confidence of 100. ``doctr``: least confidence, boxes are shares of ``image_width`` and ``image_height``.
    ``windows``: no confidence."""
    return word_lines_by(words, [rule]).drop("rule")


def word_lines_by(words: DataFrame, rules: list[str]) -> DataFrame:
    """``rule`` and the columns of ``word_lines`` by each of ``rules``: words are grouped once, and each line is told by every rule."""
    from ..functions import geometry as G

    b, item = F.col("b"), ["word_num", "text", "b"]
    if any(WORD_RULES[rule][2] for rule in rules):
        item.append(G.box(b["x"] * F.col("image_width"), b["y"] * F.col("image_height"), b["w"] * F.col("image_width"), b["h"] * F.col("image_height")).alias("whole"))
    key = ["image_id", "block", "par", "line"]
    kept = words.filter("trim(text) <> '' AND coalesce(conf, 0) >= 0")
    grouped = kept.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*item))).alias("_w"), F.avg("conf").alias("_mean"), F.min("conf").alias("_least"))
    lines = grouped.withColumn("text", F.array_join(F.transform("_w", lambda w: w["text"]), " "))

    def told(rule: str) -> Column:
        how, whole, shares = WORD_RULES[rule]
        confidence = {"mean": F.col("_mean"), "least": F.col("_least"), None: F.lit(None).cast("double")}[how] / whole
        return F.struct(F.lit(rule).alias("rule"), G.union_box(F.transform("_w", lambda w: w["whole" if shares else "b"])).alias("b"), confidence.alias("confidence"))

    found = lines.select(*key, "text", F.explode(F.array(*[told(rule) for rule in rules])).alias("_t"))
    return found.select("_t.rule", *key, "text", "_t.b", "_t.confidence")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """loc, lastmod, changefreq, priority, alternates of all entries below ``path``, by the built-in XML source."""
    schema = "loc string, lastmod string, changefreq string, priority string, `xhtml:link` array<struct<_hreflang:string,_href:string>>"
    rows = spark.read.format("xml").option("rowTag", "url").option("recursiveFileLookup", True).schema(schema).load(path)
    links = F.transform(F.coalesce("`xhtml:link`", F.array().cast("array<struct<_hreflang:string,_href:string>>")), lambda a: F.struct(a["_hreflang"].alias("hreflang"), a["_href"].alias("href")))
    return rows.select("loc", "lastmod", "changefreq", "priority", links.alias("alternates"))


def adapters() -> dict:
    """Readers by name: the place to register another engine's output."""
    return {"manifest": manifest, "truth": truth, "predictions": predictions, "timings": timings, "images": images, "masks": masks, "sitemap": sitemap}
