"""Queries on texts, pages, conversations and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks, generators, matching, ordering, scoring
from ..operators.tables import read
from .registry import query
from .standin import TEXTS, text_pairs

#: Every line of a document, whole and in ASCII, read as the line after it; after the last line nothing is read.
LINES = """l AS (SELECT doc_id, lang, source, string_split(regexp_replace(text, '[^ -~\\n]', '', 'g'), chr(10)) AS parts FROM documents),
s AS (SELECT doc_id, lang, source, (generate_subscripts(parts, 1) - 1)::INT AS line, trim(regexp_replace(unnest(parts), ' +', ' ', 'g')) AS ref FROM l),
p AS (SELECT *, coalesce(lead(ref) OVER (PARTITION BY doc_id ORDER BY line), '') AS hyp FROM s)"""


def _lines(spark, sf_dir):
    """doc_id, line, lang, source, ref, hyp: as LINES. A null text is one row of nulls."""
    parts = F.split(F.regexp_replace("text", "[^ -~\n]", ""), "\n", -1)
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.transform(parts, lambda s: F.trim(F.regexp_replace(s, " +", " "))).alias("lines"))
    pairs = F.transform("lines", lambda s, k: F.struct(s.alias("ref"), F.coalesce(F.get("lines", k + 1), F.lit("")).alias("hyp")))
    return rows.select("doc_id", "lang", "source", F.posexplode_outer(pairs).alias("line", "pair")).select("doc_id", "line", "lang", "source", "pair.*")


def _r(c, n=6):
    return F.round(c, n)


@query(f"WITH {LINES} SELECT doc_id, line, levenshtein(ref, hyp)::INT AS edits, length(ref)::INT AS n, round(CASE WHEN length(ref) > 0 THEN levenshtein(ref, hyp) / length(ref) END, 6) AS cer, round(CASE WHEN length(ref) = 0 THEN CASE WHEN length(hyp) = 0 THEN 0 ELSE 1 END ELSE levenshtein(ref, hyp) / length(ref) END, 6) AS bench_cer FROM p")
def f06_character_distance(spark, sf_dir):
    """F06, M13, M14."""
    return _character_distance(_lines(spark, sf_dir), "doc_id", "line")


def _character_distance(rows, *key):
    r, h = F.col("ref"), F.col("hyp")
    edits = F.col("edits")
    rows = rows.withColumn("edits", X.char_distance(r, h))  # once a row
    return rows.select(*key, "edits", F.length(r).alias("n"), X.error_rate(edits, F.length(r)).alias("cer"), _r(X.bench_error_rate(r, h, edits)).alias("bench_cer"))


@query(f"WITH {LINES} SELECT lang, source, round(sum(levenshtein(ref, hyp)) / sum(length(ref)), 6) AS cer, round(sum(levenshtein(replace(ref, ' ', ''), replace(hyp, ' ', ''))) / sum(length(replace(ref, ' ', ''))), 6) AS cer_nows, sum((ref = hyp)::INT)::BIGINT AS exact, sum(length(ref))::BIGINT AS chars FROM p GROUP BY lang, source")
def a01_micro_rates(spark, sf_dir):
    """Pooled error rates by language and source."""
    return _micro_rates(_lines(spark, sf_dir))


def _micro_rates(rows):
    r, h = F.col("ref"), F.col("hyp")
    rs, hs = X.without_spaces(r), X.without_spaces(h)
    return rows.groupBy("lang", "source").agg(_r(F.try_divide(F.sum(X.char_distance(r, h)), F.sum(F.length(r)))).alias("cer"), _r(F.try_divide(F.sum(X.char_distance(rs, hs)), F.sum(F.length(rs)))).alias("cer_nows"), F.count_if(r == h).alias("exact"), F.sum(F.length(r)).alias("chars"))


@query(f"WITH {LINES}, t AS (SELECT doc_id, line, CASE WHEN ref = '' THEN [] ELSE string_split(ref, ' ') END AS a, CASE WHEN hyp = '' THEN [] ELSE string_split(hyp, ' ') END AS b FROM p) SELECT doc_id, line, len(a)::INT AS n_ref, len(b)::INT AS n_hyp, len(list_filter(a, lambda x: regexp_matches(x, '[0-9]')))::INT AS numeric_tokens FROM t")
def f05_tokens(spark, sf_dir):
    """F05, P08."""
    return _token_counts(_lines(spark, sf_dir), "doc_id", "line")


def _token_counts(rows, *key):
    a, b = X.tokens(F.col("ref")), X.tokens(F.col("hyp"))
    return rows.select(*key, F.size(a).alias("n_ref"), F.size(b).alias("n_hyp"), F.size(F.filter(a, X.is_numeric_token)).alias("numeric_tokens"))


#: The transcript of a page, and the same with every ninth line unread and two letters read as one. Whole texts, in order.
PAGES = f"""WITH {LINES}, w AS (SELECT doc_id, lang, source, string_agg(ref, ' ' ORDER BY line) FILTER (ref <> '') AS truth, string_agg(replace(replace(ref, 'rn', 'm'), 'cl', 'd'), ' ' ORDER BY line) FILTER (ref <> '' AND line % 9 <> 4) AS reading FROM p GROUP BY ALL),
page AS (SELECT doc_id, lang, source, coalesce(truth, '') AS truth, coalesce(reading, '') AS reading FROM w)"""


@query(f"""{PAGES} SELECT lang, source, count(*)::BIGINT AS pages, sum(levenshtein(truth, reading))::BIGINT AS edits, sum(length(truth))::BIGINT AS chars, round(CASE WHEN sum(length(truth)) > 0 THEN sum(levenshtein(truth, reading)) / sum(length(truth)) END, 6) AS page_cer FROM page GROUP BY lang, source""")
def ext_page_error_rate(spark, sf_dir):
    """Extension: error rate of whole transcripts, without lines being matched first."""
    rows = _lines(spark, sf_dir).filter("ref IS NOT NULL")
    line = F.struct("line", "ref")
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(c), lambda x: x.isNotNull())), lambda x: x["ref"]), " ")
    read_as = F.struct("line", F.replace(F.replace(F.col("ref"), F.lit("rn"), F.lit("m")), F.lit("cl"), F.lit("d")).alias("ref"))
    pages = rows.groupBy("doc_id", "lang", "source").agg(ordered(F.when(F.col("ref") != "", line)).alias("truth"), ordered(F.when((F.col("ref") != "") & (F.col("line") % 9 != 4), read_as)).alias("reading"))
    scored = pages.select("lang", "source", F.length("truth").alias("n"), X.char_distance("truth", "reading").alias("e"))
    return scored.groupBy("lang", "source").agg(F.count("*").alias("pages"), F.sum("e").alias("edits"), F.sum("n").alias("chars"), _r(F.try_divide(F.sum("e"), F.sum("n"))).alias("page_cer"))


_BAGS = f"""WITH {LINES}, a AS (SELECT doc_id, line, unnest(CASE WHEN ref = '' THEN [] ELSE string_split(ref, ' ') END) AS t FROM p), b AS (SELECT doc_id, line, unnest(CASE WHEN hyp = '' THEN [] ELSE string_split(hyp, ' ') END) AS t FROM p),
ca AS (SELECT doc_id, line, t, count(*) AS n FROM a GROUP BY ALL), cb AS (SELECT doc_id, line, t, count(*) AS n FROM b GROUP BY ALL),
m AS (SELECT doc_id, line, sum(least(ca.n, cb.n)) AS c, sum(CASE WHEN regexp_matches(t, '[0-9]') THEN least(ca.n, cb.n) ELSE 0 END) AS nc FROM ca JOIN cb USING (doc_id, line, t) GROUP BY doc_id, line),
na AS (SELECT doc_id, line, sum(n) AS n, sum(CASE WHEN regexp_matches(t, '[0-9]') THEN n ELSE 0 END) AS nn FROM ca GROUP BY doc_id, line), nb AS (SELECT doc_id, line, sum(n) AS n FROM cb GROUP BY doc_id, line)
SELECT p.doc_id, p.line, round(CASE WHEN coalesce(na.n, 0) = 0 AND coalesce(nb.n, 0) = 0 THEN 1 WHEN coalesce(c, 0) = 0 THEN 0 ELSE 2 * c / (na.n + nb.n) END, 6) AS f1, coalesce(na.nn, 0)::INT AS numeric_total, coalesce(nc, 0)::INT AS numeric_correct
FROM p LEFT JOIN m USING (doc_id, line) LEFT JOIN na USING (doc_id, line) LEFT JOIN nb USING (doc_id, line)"""


@query(_BAGS)
def a20_bag_of_words(spark, sf_dir):
    """Multisets of tokens, paired off within the row."""
    return _bags(_lines(spark, sf_dir), "doc_id", "line")


def _bags(rows, *key):
    bags = scoring.token_bags(rows, list(key), X.tokens(F.col("ref")), X.tokens(F.col("hyp")))
    return bags.select(*key, _r(scoring.bag_f1(F.col("common"), F.col("n_ref"), F.col("n_hyp"))).alias("f1"), F.col("numeric_total").cast("int").alias("numeric_total"), F.col("numeric_correct").cast("int").alias("numeric_correct"))


@query(f"WITH {LINES}, b AS (SELECT source, f1 FROM (SELECT doc_id, line, source FROM p) JOIN ({_BAGS}) USING (doc_id, line)) SELECT source, round(avg(f1), 5) AS mean_f1, count(*)::BIGINT AS n FROM b GROUP BY source")
def a05_macro_f1(spark, sf_dir):
    """A mean over texts, not pooled."""
    return _macro_f1(_lines(spark, sf_dir))


def _macro_f1(rows):
    bags = scoring.token_bags(rows, ["doc_id", "line", "source"], X.tokens(F.col("ref")), X.tokens(F.col("hyp")))
    scores = bags.select("source", _r(scoring.bag_f1(F.col("common"), F.col("n_ref"), F.col("n_hyp"))).alias("f1"))
    return scores.groupBy("source").agg(_r(F.avg("f1"), 5).alias("mean_f1"), F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, line, trim(regexp_replace(ref || '  ' || hyp, '[ \\t\\n\\r]+', ' ', 'g')) AS normal FROM p")
def f02_normal_form_ascii(spark, sf_dir):
    """F01 and F02 where the text is ASCII, in the JVM."""
    return _normal_form(_lines(spark, sf_dir), "doc_id", "line")


def _normal_form(rows, *key):
    return rows.select(*key, X.n1_ascii(F.concat_ws("  ", "ref", "hyp")).alias("normal"))


@query()
def f02_normal_forms(spark, sf_dir):
    """F02 and F03 on whole texts of any script (Arrow; tested against the plain function)."""
    return read(spark, sf_dir, "documents").select("doc_id", X.n1("text").alias("n1"), X.n2("text").alias("n2"))


@query()
def f07_token_distance(spark, sf_dir):
    """edit distance of the token arrays of all lines (tested against the recurrence)."""
    return _lines(spark, sf_dir).select("doc_id", "line", X.token_distance(X.tokens(F.col("ref")), X.tokens(F.col("hyp"))).alias("edits"))


@query()
def f08_substitutions(spark, sf_dir):
    """Most frequent substitutions of all lines by language (tested against the table of the recurrence)."""
    units = _lines(spark, sf_dir).select("lang", F.lit("component").alias("kind"), F.lit(1).alias("n_gt"), F.col("ref").alias("ref_n1"), F.col("hyp").alias("hyp_n1"))
    return scoring.confusions(units, ["lang"])


@query(f"""WITH {LINES}, c AS (SELECT doc_id, line, regexp_replace(ref, '[^A-Za-z]', '', 'g') AS l, ref FROM p)
SELECT doc_id, line, CASE WHEN l = '' THEN 'no_letters' WHEN NOT regexp_matches(l, '[a-z]') THEN 'upper' WHEN NOT regexp_matches(l, '[A-Z]') THEN 'lower' WHEN NOT regexp_matches(ref, '(^|[^A-Za-z])[a-z]') AND NOT regexp_matches(ref, '[A-Za-z][A-Z]') THEN 'title' ELSE 'mixed' END AS letters,
 regexp_matches(ref, '[0-9]') AS digit, regexp_matches(ref, '[gjpqy]') AS descender, regexp_matches(ref, '[bdfhklt]') AS ascender, regexp_matches(ref, '[A-Z]') AS capital, regexp_matches(ref, '[^A-Za-z0-9 ]') AS punctuation FROM c""")
def f10_case_and_glyphs(spark, sf_dir):
    """F10, F11."""
    return _case_and_glyphs(_lines(spark, sf_dir), "doc_id", "line")


def _case_and_glyphs(rows, *key):
    flags = X.glyph_flags(F.col("ref"))
    return rows.select(*key, X.letter_case(F.col("ref")).alias("letters"), *[flags[c].alias(c) for c in ("digit", "descender", "ascender", "capital", "punctuation")])


@query(f"WITH {LINES}, w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(ref, '\\s+'), lambda x: x <> '')) AS t FROM p) SELECT t AS token, count(*)::BIGINT AS n FROM w GROUP BY t")
def f12_token_multiset(spark, sf_dir):
    """F12."""
    return _token_multiset(_lines(spark, sf_dir))


def _token_multiset(rows):
    return rows.select(F.explode(X.whitespace_tokens(F.col("ref"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, a AS (SELECT unnest(string_split(ref, ' ')) AS t FROM p), b AS (SELECT unnest(string_split(hyp, ' ')) AS t FROM p), x AS (SELECT t, count(*) AS n FROM a GROUP BY t), y AS (SELECT t, count(*) AS n FROM b GROUP BY t)
SELECT t AS token, greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0)::BIGINT AS only_a, greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0)::BIGINT AS only_b FROM x FULL JOIN y USING (t) WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def j20_multiset_difference(spark, sf_dir):
    """J20, E03."""
    return _surplus_tokens(_lines(spark, sf_dir))


def _surplus_tokens(rows):
    a, b = (rows.select(F.explode(F.split(c, " ")).alias("token")) for c in ("ref", "hyp"))
    return matching.multiset_difference(a, b, "token")


@query("WITH a AS (SELECT source, lang FROM documents WHERE doc_id % 2 = 0), b AS (SELECT source, lang FROM documents WHERE doc_id % 2 = 1) SELECT lang, left(source, 4) AS s FROM a EXCEPT ALL SELECT lang, left(source, 4) AS s FROM b")
def e03_except_all(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    rows = d.select("doc_id", "lang", F.left("source", F.lit(4)).alias("s"))
    return rows.filter("doc_id % 2 = 0").drop("doc_id").exceptAll(rows.filter("doc_id % 2 = 1").drop("doc_id"))


@query("WITH a AS (SELECT source, lang FROM documents WHERE doc_id % 2 = 0), b AS (SELECT source, lang FROM documents WHERE doc_id % 2 = 1) SELECT lang, left(source, 4) AS s FROM a INTERSECT ALL SELECT lang, left(source, 4) AS s FROM b")
def e03_intersect_all(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    rows = d.select("doc_id", "lang", F.left("source", F.lit(4)).alias("s"))
    return rows.filter("doc_id % 2 = 0").drop("doc_id").intersectAll(rows.filter("doc_id % 2 = 1").drop("doc_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def e04_set_difference(spark, sf_dir):
    """Documents without labels."""
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('s:' || doc_id::VARCHAR), doc_id) AS k, count(*) OVER () AS n FROM documents) WHERE k <= greatest(1, floor(n * 0.1 + 0.5))")
def e05_hash_sample(spark, sf_dir):
    return generators.hash_sample(read(spark, sf_dir, "documents"), "doc_id", 0.1, "s").select("doc_id")


@query("SELECT conv_id, string_agg(role || ':' || length(text)::VARCHAR, '>' ORDER BY turn) AS turns, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id")
def f13_ordered_join(spark, sf_dir):
    """Pieces joined in order."""
    item = F.struct("turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("v"))
    ordered = F.array_sort(F.collect_list(item))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["v"]), ">").alias("turns"), F.count("*").alias("n"))


@query("SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS current, count(*) OVER (PARTITION BY conv_id)::BIGINT AS total FROM conversations")
def w11_progress(spark, sf_dir):
    from ..streaming.regions import running_progress

    return running_progress(read(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "role", "current", "total")


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 5")
def w17_last_history(spark, sf_dir):
    return ordering.last_of(read(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 5).select("conv_id", "turn", "text")


@query("SELECT conv_id, max(role) FILTER (turn = m) AS role, max(turn) FILTER (turn = m) AS turn FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY conv_id")
def s10_latest_edit(spark, sf_dir):
    """The newest of each key wins."""
    from ..streaming.regions import latest_edits

    return latest_edits(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"]).select("conv_id", "role", "turn")


@query("SELECT conv_id, bool_and(d) AS monotone FROM (SELECT conv_id, coalesce(length(text) <= lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), true) AS d FROM conversations) GROUP BY conv_id")
def w08_monotone(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return ordering.is_monotone(rows, ["conv_id"], ["turn"], "n")


@query("SELECT lang, count(DISTINCT source) = 1 AS same FROM documents GROUP BY lang")
def j13_cross_scale_equality(spark, sf_dir):
    return checks.cross_scale_text(read(spark, sf_dir, "documents"), ["lang"], "source")


@query("""SELECT lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS size, count(*)::BIGINT AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic
FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def a32_accuracy_by_bins(spark, sf_dir):
    """Outcomes by class and half-open bins."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    return d.groupBy("lang", size.alias("size")).agg(F.count("*").alias("n"), _r(F.avg("quality")).alias("quality"), _r(F.avg("toxic")).alias("toxic"))


@query("""WITH f AS (SELECT l.doc_id, quality, regexp_matches(text, '[0-9]') AS digit, contains(text, '|') AS bar, contains(text, '%') AS percent FROM labels l JOIN documents d USING (doc_id)),
u AS (SELECT doc_id, quality, unnest(['digit', 'bar', 'percent']) AS flag, unnest([digit, bar, percent]) AS v FROM f)
SELECT flag, v AS present, count(*)::BIGINT AS n, sum(quality)::BIGINT AS good FROM u GROUP BY flag, v""")
def a31_accuracy_by_flags(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    flags = {"digit": F.col("text").rlike("[0-9]"), "bar": F.contains("text", F.lit("|")), "percent": F.contains("text", F.lit("%"))}
    long = d.select("quality", F.explode(F.array(*[F.struct(F.lit(n).alias("flag"), c.alias("present")) for n, c in flags.items()])).alias("f")).select("quality", "f.*")
    return long.groupBy("flag", "present").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


@query("""WITH h AS (SELECT page_id, lower(html) AS h FROM pages)
SELECT page_id, len(regexp_extract_all(h, '<canvas[\\s>/]'))::INT AS n_canvas, len(regexp_extract_all(h, '<iframe[\\s>/]'))::INT AS n_iframe, len(regexp_extract_all(h, '<video[\\s>/]'))::INT AS n_video, len(regexp_extract_all(h, '<svg[\\s>/]'))::INT AS n_svg,
 len(regexp_extract_all(h, '<img[\\s>/]'))::INT AS n_img, len(regexp_extract_all(h, '<script[\\s>/]'))::INT AS n_script, NOT regexp_matches(h, '<(canvas|iframe|video|svg|img|script)[\\s>/]') AS clean FROM h""")
def v16_page_evidence(spark, sf_dir):
    """Tags a text page must not have."""
    return checks.page_evidence(read(spark, sf_dir, "pages"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host, regexp_extract(url, '([^/]+)$', 1) AS last FROM pages")
def r03_path_parts(spark, sf_dir):
    """Parts of a path as columns."""
    return read(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host"), F.regexp_extract("url", "([^/]+)$", 1).alias("last"))


@query("SELECT page_id, url FROM pages WHERE contains(lower(html), trim(lower('  <Div')))")
def p15_text_search(spark, sf_dir):
    return read(spark, sf_dir, "pages").filter(F.contains(F.lower("html"), F.lower(F.trim(F.lit("  <Div"))))).select("page_id", "url")


@query("SELECT page_id, sha256(html) AS sha256, sha256(url || chr(10) || html) AS pixel_sha256, ('0x' || substr(sha256(url), 1, 8))::BIGINT AS seed FROM pages")
def m04_hashes(spark, sf_dir):
    """M04, M05, R10."""
    from ..functions.numeric import seed_of

    return read(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.sha2(F.concat("url", F.lit("\n"), "html"), 256).alias("pixel_sha256"), seed_of(F.col("url")).alias("seed"))


@query("SELECT sha256(string_agg(url || ' ' || sha256(html) || chr(10), '' ORDER BY url, sha256(html))) AS fingerprint FROM pages")
def r11_fingerprint(spark, sf_dir):
    from ..sources.readers import fingerprint

    return fingerprint(read(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256")))


@query("SELECT a.page_id, a.url FROM pages a LEFT JOIN (SELECT page_id, sha256(html) AS h FROM pages WHERE page_id % 3 <> 0) b USING (page_id) WHERE sha256(CASE WHEN a.page_id % 5 = 0 THEN a.html || '!' ELSE a.html END) IS DISTINCT FROM b.h")
def j17_stale(spark, sf_dir):
    """Records whose hash is not the current one."""
    p = read(spark, sf_dir, "pages")
    record = p.select("page_id", "url", F.sha2(F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")), 256).alias("h"))
    return matching.stale(record, p.filter("page_id % 3 <> 0").select("page_id", F.sha2("html", 256).alias("h")), "page_id", "h").select("page_id", "url")


@query("SELECT item_id, text FROM (SELECT *, CASE item_id WHEN 7 THEN 1 WHEN 3 THEN 2 END AS o FROM benchmark) ORDER BY coalesce(o, 1000), item_id LIMIT 6")
def j19_curated_first(spark, sf_dir):
    return matching.curated_first(read(spark, sf_dir, "benchmark"), "item_id", [7, 3], 6)


@query("WITH d AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, map_from_entries(list((source, n::BIGINT) ORDER BY source))::VARCHAR AS counts FROM d GROUP BY lang")
def a11_status_maps(spark, sf_dir):
    """A map of counts by key, as text with sorted keys."""
    counts = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("source", "n")))
    return counts.groupBy("lang").agg(F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda x: F.concat(x["source"], F.lit("="), x["n"].cast("string"))), ", "), F.lit("}")).alias("counts"))


@query("SELECT lang, count(*) FILTER (source = 'src1')::BIGINT AS src1, count(*) FILTER (source = 'src2')::BIGINT AS src2, count(*) FILTER (source = 'src3')::BIGINT AS src3 FROM documents GROUP BY lang")
def a11_status_pivot(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").pivot("source", ["src1", "src2", "src3"]).count().na.fill(0)


@query(f"WITH {TEXTS} SELECT doc_id, length(ref)::INT AS n_ref, length(hyp)::INT AS n_hyp FROM pairs")
def j12_neighbour_pairs(spark, sf_dir):
    """Self-pairs along an order."""
    return text_pairs(spark, sf_dir).select("doc_id", F.length("ref").alias("n_ref"), F.length("hyp").alias("n_hyp"))


@query()
def e08_perturbed(spark, sf_dir):
    """All lines at a known edit distance (tested to be exact). Symbols beyond ASCII are free in every line."""
    rows = _lines(spark, sf_dir).select("doc_id", "line", "ref", F.concat_ws(":", "doc_id", "line").alias("name"))
    return generators.perturbed(rows, "ref", "name", "substitute", 3, "#@~^\u00a4\u00a7").drop("name")


@query("SELECT lang, source, n, n - lag(n) OVER (PARTITION BY lang ORDER BY source) AS step FROM (SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY ALL)")
def w07_gaps(spark, sf_dir):
    counts = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return counts.withColumn("step", F.col("n") - F.lag("n").over(Window.partitionBy("lang").orderBy("source")))
