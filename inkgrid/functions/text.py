"""Text functions: normal forms, tokens, edit distances and classifications.

Code points are the unit everywhere. Normal forms need Unicode tables that Spark lacks and run as
Arrow functions; ASCII text, the common case, does not leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .distance import edit_distance as _edit_distance
from .distance import edit_distance_of, edit_distances, substituted

# What the normal form deletes and replaces.
DELETED = [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD]
APOSTROPHES = [0x2018, 0x2019, 0x201A, 0x201B, 0x2032]
QUOTES = [0x201C, 0x201D, 0x201E, 0x201F, 0x2033]
DASHES = [0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212]

_REPLACED = {**dict.fromkeys(DELETED), **dict.fromkeys(APOSTROPHES, "'"), **dict.fromkeys(QUOTES, '"'), **dict.fromkeys(DASHES, "-")}
_BLANKS = re.compile(r"\s+")


def normal_form(text: str | None) -> str | None:
    """NFKC, then invisible code points out, typographic quotes and dashes plain, white space single."""
    if text is None:
        return None
    if text.isascii():
        return _BLANKS.sub(" ", text).strip()
    return _BLANKS.sub(" ", unicodedata.normalize("NFKC", text).translate(_REPLACED)).strip()


def n1_ascii(text: Column) -> Column:
    """The normal form of ASCII text, without leaving the JVM."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r\x1C-\x1F]+", " "))


#: Texts of a batch that are Python strings at once.
AT_ONCE = 64


def _of_each(texts: pa.Array, form: Callable[[str], str]) -> pa.Array:
    """``form`` of each text; the others of the batch stay in Arrow's memory."""
    parts = (texts.slice(lo, AT_ONCE).to_pylist() for lo in range(0, len(texts), AT_ONCE))
    done = [pa.array([None if t is None else form(t) for t in part], pa.string()) for part in parts]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def _n1(text: pa.Array) -> pa.Array:
    return _of_each(text, normal_form)


@F.arrow_udf(T.StringType())
def _n2(text: pa.Array) -> pa.Array:
    return _of_each(text, lambda t: normal_form(t).casefold())


def _by_script(text: Column | str, plain: Callable[[Column], Column], other: Callable[[Column], Column]) -> Column:
    """ASCII rows stay in the JVM; the Arrow function gets a null for each of them."""
    text = F.col(text) if isinstance(text, str) else text
    beyond = text.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, other(F.when(beyond, text))).otherwise(plain(text))


def n1(text: Column | str) -> Column:
    """Normal form."""
    return _by_script(text, n1_ascii, _n1)


def n2(text: Column | str) -> Column:
    """Normal form, case folded (not merely lower-cased)."""
    return _by_script(text, lambda t: F.lower(n1_ascii(t)), _n2)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _n1_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda all_: [normal_form(t) for t in all_], na_action="ignore")


def n1_each(texts: Column) -> Column:
    """Normal forms of an array of texts; arrays of ASCII texts stay in the JVM."""
    beyond = F.exists(texts, lambda t: F.coalesce(t.rlike(r"[^\x00-\x7F]"), F.lit(False)))
    return F.when(beyond, _n1_each(F.when(beyond, texts))).otherwise(F.transform(texts, n1_ascii))


def char_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance of two texts; null if either is null. Equal texts do not leave the JVM."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    apart = a != b
    return F.when(a == b, 0).otherwise(_edit_distance(F.when(apart, a), F.when(apart, b)))


def without_spaces(normal: Column) -> Column:
    return F.replace(normal, F.lit(" "), F.lit(""))


def tokens(normal: Column) -> Column:
    """Split on single blanks; an empty text has no tokens."""
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def whitespace_tokens(text: Column) -> Column:
    """Split on any white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def is_numeric_token(token: Column) -> Column:
    return token.rlike("[0-9]")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once (a lambda variable, not an expression repeated in every lambda)."""
    return F.get(F.transform(F.array(value), use), 0)


def multiset(items: Column) -> Column:
    """map<item, count> of an array: places of change in the sorted array, and the gaps between them."""

    def counted(s: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i < F.size(s)) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        return bound(places, lambda at: F.map_from_arrays(F.transform(at, lambda i: F.get(s, i)), F.transform(at, lambda i, k: F.coalesce(F.get(at, k + 1), F.size(s)) - i)))

    return bound(F.array_sort(items), counted)


def multiset_common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two count maps."""
    merged = F.map_zip_with(a, b, lambda _, x, y: F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))
    return F.aggregate(F.map_values(merged), F.lit(0), lambda s, v: s + v)


#: Tokens of two arrays that are numbered for their intersection; of more, count maps are made.
NUMBERED = 128


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays without nulls. Where one has no repeats that of the sets will do; else each token
    gets the number of times it stood before, which takes its place among all to find: few tokens only."""

    def numbered(items: Column) -> Column:
        return bound(F.sort_array(items), lambda s: F.transform(s, lambda t, i: F.concat(t, F.lit(" "), (i - F.array_position(s, t)).cast("string"))))

    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    few = F.size(a) + F.size(b) <= NUMBERED
    return F.when(plain, F.size(F.array_intersect(a, b))).when(few, F.size(F.array_intersect(numbered(a), numbered(b)))).otherwise(multiset_common(multiset(a), multiset(b)))


def bag_of_words_f1(ref: Column, hyp: Column) -> Column:
    """F1 of two token arrays as multisets; two empty ones agree."""
    common, n_ref, n_hyp = common_tokens(ref, hyp), F.size(ref), F.size(hyp)
    return F.when((n_ref == 0) & (n_hyp == 0), 1.0).when(common == 0, 0.0).otherwise(2.0 * common / (n_ref + n_hyp))


def numeric_matches(ref: Column, hyp: Column) -> Column:
    """struct<total, correct>: number-bearing reference tokens, and those that the hypothesis has as well, each once."""
    numbers = lambda tokens: F.filter(tokens, is_numeric_token)
    return bound(numbers(ref), lambda own: F.struct(F.size(own).alias("total"), F.when(ref == hyp, F.size(own)).otherwise(bound(numbers(hyp), lambda other: common_tokens(own, other))).alias("correct")))


def error_rate(edits: Column, length: Column) -> Column:
    """edits / length rounded to 6 digits, null for no reference."""
    return F.round(F.when(length > 0, edits / length), 6)


def bench_error_rate(ref: Column, hyp: Column, edits: Column | None = None) -> Column:
    """The variant for which an empty reference is right (0) if nothing was read, else wrong (1)."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise((char_distance(ref, hyp) if edits is None else edits) / F.length(ref))


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, a row of the table at a time."""
    if not len(a) or not len(b):
        return len(a) + len(b)
    codes: dict = {}
    x = np.array([codes.setdefault(t, len(codes)) for t in a])
    y = np.array([codes.setdefault(t, len(codes)) for t in b])
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, c in enumerate(x, 1):
        up = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        row = np.minimum.accumulate(np.concatenate(([i], up)) - steps) + steps
    return int(row[-1])


def token_distance(a: Column | str, b: Column | str) -> Column:
    """Edit distance of token arrays; null if either is null. Equal arrays do not leave the JVM."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    apart = a != b
    return F.when(a == b, 0).otherwise(_token_distance(F.when(apart, a), F.when(apart, b)))


@F.pandas_udf(T.IntegerType())
def _token_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance_of(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


#: Characters of a text up to which edits are counted in the JVM, and signs for its tokens, of which it has fewer than half as many.
SHORT = 192
_SIGNS = "".join(map(chr, range(0x4E00, 0x4E00 + SHORT + 2)))
#: Characters of texts that are worked on together.
_TOGETHER = 1 << 20


_COUNTS = T.StructType([*[T.StructField(c, T.StringType()) for c in ("ref_n1", "hyp_n1")], *[T.StructField(c, T.IntegerType()) for c in ("len_n2", "ed_n0", "ed_n1", "ed_n2", "ed_nows", "ed_w")]])


@F.pandas_udf(_COUNTS)
def _edits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for refs, hyps in batches:
        parts, lo = [], 0
        size = np.cumsum([sum(len(t) for t in pair if isinstance(t, str)) for pair in zip(refs, hyps, strict=True)]) // _TOGETHER
        for hi in [*(np.flatnonzero(np.diff(size)) + 1), len(refs)]:
            parts.append(_edits_of(refs.iloc[lo:hi], hyps.iloc[lo:hi]))
            lo = hi
        yield pd.concat(parts, ignore_index=True)


def _edits_of(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
    forms = [[t if isinstance(t, str) else None for t in side] for side in (refs, hyps)]
    n1 = [[normal_form(t) for t in side] for side in forms]
    n2 = [[None if t is None else t.casefold() for t in side] for side in n1]
    nows = [[None if t is None else t.replace(" ", "") for t in side] for side in n1]
    some = np.array([a is not None and b is not None for a, b in zip(*forms, strict=True)], bool)
    whole = np.flatnonzero(some)

    def counted(distances: list[int]) -> pd.Series:
        out = np.zeros(len(some), np.int32)
        out[whole] = distances
        return pd.Series(pd.arrays.IntegerArray(out, ~some))

    chars = {name: counted(edit_distances(*[[side[i] for i in whole] for side in texts])) for name, texts in (("n0", forms), ("n1", n1), ("n2", n2), ("nows", nows))}
    words = counted([edit_distance_of(n1[0][i].split(), n1[1][i].split()) if n1[0][i] != n1[1][i] else 0 for i in whole])
    length = pd.Series([None if t is None else len(t) for t in n2[0]], dtype="Int32")
    return pd.DataFrame({"ref_n1": n1[0], "hyp_n1": n1[1], "len_n2": length, **{f"ed_{k}": v for k, v in chars.items()}, "ed_w": words})


def with_edit_counts(rows: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Adds the normal forms ref_n1, hyp_n1 of two texts, their tokens _rt, _ht, and ed_<form> and len_<form>: Levenshtein distances and lengths of
    the reference as it is (n0), in normal form (n1), case folded (n2), without blanks (nows) and by tokens (w).

    Short texts of ASCII do not leave the JVM; all that is told of the others is told by one Arrow function."""
    r, h = F.col(ref), F.col(hyp)
    hard = F.coalesce((F.length(r) > SHORT) | r.rlike(r"[^\x00-\x7F]"), F.lit(False)) | F.coalesce((F.length(h) > SHORT) | h.rlike(r"[^\x00-\x7F]"), F.lit(False))
    rows = rows.withColumn("_hard", hard).withColumn("_e", _edits(F.when(F.col("_hard"), r), F.when(F.col("_hard"), h)))
    either = lambda name, plain: F.when(F.col("_hard"), F.col("_e")[name]).otherwise(plain)
    rows = rows.withColumns({"ref_n1": either("ref_n1", n1_ascii(r)), "hyp_n1": either("hyp_n1", n1_ascii(h))})
    r1, h1 = F.col("ref_n1"), F.col("hyp_n1")
    rows = rows.withColumns({"_rt": tokens(r1), "_ht": tokens(h1)})
    apart = lambda a, b, far: F.when(a == b, 0).otherwise(far)

    def signs(items: Column, known: Column) -> Column:
        return F.array_join(F.transform(items, lambda t: F.substring(F.lit(_SIGNS), F.array_position(known, t).cast("int"), F.lit(1))), "")

    by_words = bound(F.array_distinct(F.concat("_rt", "_ht")), lambda known: F.levenshtein(signs(F.col("_rt"), known), signs(F.col("_ht"), known)))
    pairs = {"n0": (r, h), "n1": (r1, h1), "n2": (F.lower(r1), F.lower(h1)), "nows": (without_spaces(r1), without_spaces(h1))}
    found = {f"ed_{name}": either(f"ed_{name}", apart(a, b, F.levenshtein(a, b))) for name, (a, b) in pairs.items()}
    lengths = {f"len_{name}": F.length(a) for name, (a, _) in pairs.items()}
    lengths["len_n2"] = either("len_n2", lengths["len_n2"])
    return rows.withColumns({**found, **lengths, "ed_w": either("ed_w", apart(r1, h1, by_words)), "len_w": F.size("_rt")}).drop("_hard", "_e")


def substitutions(a: str, b: str, cells: int = 1 << 22) -> list[tuple[int, int, str, str]]:
    """(place in a, place in b, character, read as) of one least edit script. Of equal scripts the one that, from the
    end, prefers substitution, then deletion."""
    m, n = len(a), len(b)
    y = np.array([ord(c) for c in b])
    steps = np.arange(n + 1)

    def below(row: np.ndarray, first: int, last: int) -> np.ndarray:
        """Rows ``first`` to ``last`` of the table, of which ``row`` is the first."""
        table = np.zeros((last - first + 1, n + 1), np.int32)
        table[0] = row
        for i in range(1, len(table)):
            up = np.minimum(table[i - 1, 1:] + 1, table[i - 1, :-1] + (y != ord(a[first + i - 1]))) if n else np.empty(0, np.int64)
            table[i] = np.minimum.accumulate(np.concatenate(([first + i], up)) - steps) + steps
        return table

    # a table of more than ``cells`` is kept a run of rows at a time: the first row of each run, the others anew on the way back
    run = m or 1 if (m + 1) * (n + 1) <= cells else int(m**0.5) + 1
    heads, table = [np.arange(n + 1, dtype=np.int32)], None
    for first in range(0, m, run):
        table = below(heads[-1], first, min(m, first + run))
        heads.append(table[-1].copy())
    at = (m - 1) // run * run if m else 0
    out, i, j = [], m, n
    while i and j:
        if i <= at:
            at -= run
            table = below(heads[at // run], at, at + run)
        here, above = table[i - at], table[i - at - 1]
        if here[j] == above[j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                out.append((i, j, a[i], b[j]))
        elif here[j] == above[j] + 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


#: Rows and characters of which substitutions are counted together.
COUNTED, COUNTED_CHARACTERS = 32_768, 1 << 23


def substitution_counts(key: list[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``key``, ref_char, hyp_char and how often (_n) it is substituted in some of the pairs _ref, _hyp of the key."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + len(batch), size + int(batch["_ref"].str.len().sum() + batch["_hyp"].str.len().sum())
        if rows >= COUNTED or size >= COUNTED_CHARACTERS:
            yield _counted(key, pd.concat(held, ignore_index=True))
            held, rows, size = [], 0, 0
    if rows:
        yield _counted(key, pd.concat(held, ignore_index=True))


def _counted(key: list[str], rows: pd.DataFrame) -> pd.DataFrame:
    pair, a, b = substituted(rows["_ref"].tolist(), rows["_hyp"].tolist())
    group = rows.groupby(key, dropna=False, sort=False).ngroup().to_numpy() if key else np.zeros(len(rows), np.int64)
    first = np.zeros(int(group.max()) + 1, np.int64)
    first[group] = np.arange(len(group))  # a row of each key
    kinds, n = np.unique(np.column_stack((group[pair], a, b)).astype(np.int64), axis=0, return_counts=True)
    out = rows[key].astype(object).iloc[first[kinds[:, 0]]].reset_index(drop=True)
    a, b = (pd.Series([chr(c) for c in kinds[:, k]], dtype=object) for k in (1, 2))
    return out.assign(ref_char=a, hyp_char=b, _n=n)


@F.udtf(returnType="ref_at int, hyp_at int, ref_char string, hyp_char string")
class EditSubstitutions:
    """Table function: the substitutions between two texts."""

    def eval(self, ref: str, hyp: str):
        if ref is not None and hyp is not None:
            yield from substitutions(ref, hyp)


def letter_case(text: Column) -> Column:
    """no_letters, upper, lower, title (every word begins with its only capitals) or mixed."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    titled = ~text.rlike(r"(^|[^\p{L}])\p{Ll}") & ~text.rlike(r"\p{L}\p{Lu}")
    return F.when(letters == "", "no_letters").when(~letters.rlike(r"\p{Ll}"), "upper").when(~letters.rlike(r"\p{Lu}"), "lower").when(titled, "title").otherwise("mixed")


def glyph_flags(text: Column) -> Column:
    """struct of booleans: digit, descender, ascender, capital, punctuation."""
    return F.struct(
        text.rlike("[0-9]").alias("digit"),
        text.rlike("[gjpqy]").alias("descender"),
        text.rlike("[bdfhklt]").alias("ascender"),
        text.rlike(r"\p{Lu}").alias("capital"),
        text.rlike(r"[^\p{L}\p{N}\s]").alias("punctuation"),
    )


def hex_to_rgb(text: Column) -> Column:
    """struct<r, g, b> of '#rrggbb'; anything else is black."""
    digits = F.regexp_extract(text, "^#?([0-9a-fA-F]{6})$", 1)
    part = [F.when(digits != "", F.conv(F.substring(digits, 1 + 2 * k, 2), 16, 10).cast("int")).otherwise(0) for k in range(3)]
    return F.struct(*[p.alias(n) for p, n in zip(part, "rgb", strict=True)])


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    """Channels rounded half up and kept within 0 and 255."""
    part = [F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c.cast("double"))) + 0.5)), 2, "0") for c in (r, g, b)]
    return F.concat(F.lit("#"), F.lower(F.concat(*part)))


def css_colour(text: Column) -> Column:
    """array of the four numbers of rgb(..) or rgba(..); alpha 1 if not given; null for other text."""
    body = F.regexp_extract(text, r"^rgba?\(([^)]*)\)$", 1)
    numbers = F.transform(F.split(body, r"[,/\s]+"), lambda x: x.try_cast("double"))
    return F.when(body != "", F.when(F.size(numbers) == 3, F.concat(numbers, F.array(F.lit(1.0)))).otherwise(numbers))


def first_font_family(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.split(text, ",")[0]), "^[\"']|[\"']$", "")


def base_id(template: Column, dpr: Column, theme: Column) -> Column:
    """template_dpr<k>_theme, with p for the decimal point and whole numbers without one."""
    label = F.replace(F.regexp_replace(dpr.cast("string"), r"\.0$", ""), F.lit("."), F.lit("p"))
    return F.concat_ws("_", template, F.concat(F.lit("dpr"), label), theme)


def counter(values: list) -> dict:
    return dict(Counter(values))
