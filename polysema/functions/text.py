"""Text functions over columns: tokens, word forms, cleaning, cluster strings.

All but the merging of phrases are built-in expressions, so they stay in the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Letters, letter numbers and other numbers, and the underscore; no decimal digits, no combining marks.
ALPHABETIC = r"[\p{L}\p{Nl}\p{No}_]+"

# Patterns of the predicate library. (?U): \d, \s, \w and \b know all of Unicode.
PATTERNS = {
    "latin_mwe": r"(?iu)^[-a-z ]+$",
    "latin_word": r"(?iu)^[-a-z]+$",
    "latin_chars": r"[a-zA-Z]",
    "whitespaces": r"(?U)\s+",
    "newlines": r"[\n\r]+",
    "xml_escape": r"(?U)&[^\s]+;",
    "dollar": r"\$",
    "phone": r"(?U)\+?\s*\b[78]\s*[\(\s-]?\d\d\d[)\s-]?\s*(\d[-\s]?){7}\b",
    "url": r"(?iu)https?://[^ ]+",
    "exclamations": r"!!!+",
    "questions": r"\?\?\?+",
    "upper_letter": r"[A-Z]",
    "upper_run": r"[A-Z]{3,}",
    "spaced_numbers": r"(?U)^[,\d\s]+$",
    "number": r"(?U)\d+",
    "numeric_stops": r"(?iU)[\d\s:;\.-]+(?![а-яa-z\d-])",
    "at": r"@",
    "amp": r"(?i)&(amp|quot)(\\;|;)?",
    "escape": r"\\;",
    "quote_escape": r'[\\"]',
    "norm_babel": r"[()_:]",
    "norm_babel_dash": r"[()_:-]",
}

# Marks and words that are stop words beside the library's list.
STOP_MARKS = [".", ",", "?", "!", ";", ":", '"', "&", "'", "(", ")", "-", "+", "/", "\\", "|", "[", "]", "often", "a", "an", "-pron-", "can", "just"]


def tokenize(text: Column) -> Column:
    """Alphabetic tokens with their case kept."""
    return F.regexp_extract_all(text, F.lit(ALPHABETIC), 0)


def stop_words(language: str = "english") -> list[str]:
    """The library's list for the language with the marks above."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted({*StopWordsRemover.loadDefaultStopWords(language), *STOP_MARKS})


def stop_variants(word: Column) -> Column:
    """The forms in which a stop word is left out of contexts."""
    return F.array_distinct(F.array(word, title(word), F.upper(word)))


def fixed_point(number: Column, digits: int = 12) -> Column:
    """A number without an exponent, rounded as C and Python do: by its exact binary value, ties to the even digit.

    The product with the power of ten and its error make up the exact value (Dekker); numbers too large for that have no
    digits to round, or are left to the formatter."""
    power, split = 10.0**digits, 134217729.0  # 2**27 + 1
    high = split * power - (split * power - power)
    low = power - high

    def text(x: Column) -> Column:
        top = split * x - (split * x - x)
        return F.struct(F.floor(x * power).alias("n"), (x * power - F.floor(x * power) - 0.5).alias("over"), (top * high - x * power + top * low + (x - top) * high + (x - top) * low).alias("error"))

    f = F.transform(F.array(text(F.abs(number))), lambda t: t["n"] + F.when((t["over"] > 0) | ((t["over"] == 0) & ((t["error"] > 0) | ((t["error"] == 0) & (t["n"] % 2 == 1)))), 1).otherwise(0))
    sign = F.when(number.cast("string").startswith("-"), "-").otherwise("")  # a negative zero has one too

    def pointed(n: Column) -> Column:
        s = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(digits + 1)), F.lit("0"))
        return F.concat(sign, F.substring(s, F.lit(1), F.length(s) - digits), F.lit("."), F.right(s, F.lit(digits)))

    return F.when(F.abs(number) * power < 2.0**52, F.transform(f, pointed)[0]).otherwise(F.format_string(f"%.{digits}f", number))


def parse_list(text: Column) -> Column:
    """Items of a written list ``['a', "b", c]``, ``a, b`` or none; quotes and spaces around items go."""
    items = F.transform(F.split(F.regexp_replace(F.trim(text), r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(F.trim(x), r"""^['"]|['"]$""", ""))
    return F.filter(items, lambda x: x != "")


def split_space(text: Column) -> Column:
    """Runs of non-white-space characters."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def minimize(word: Column) -> Column:
    """Stripped and lower-cased; the first and the last character go if they are not a-z, one each."""
    w = F.lower(strip(word))
    w = F.when(w.rlike("^[a-z]"), w).otherwise(F.substring(w, F.lit(2), F.length(w)))
    return F.when(w.rlike("[a-z]$"), w).otherwise(F.substring(w, F.lit(1), F.greatest(F.length(w) - 1, F.lit(0))))


def title(word: Column) -> Column:
    """Upper case for every letter after a non-letter, lower case for the others."""
    chars = F.split(F.lower(word), "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i == 0) | ~F.element_at(chars, F.greatest(i, F.lit(1))).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")


def case_variants(word: Column) -> Column:
    return F.array_distinct(F.array(word, title(word), F.lower(word)))


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def phrase_variants(line: Column) -> Column:
    """A phrase as it is, capitalised, and both with underscores for spaces."""
    w = strip(line)
    under = F.translate(w, " ", "_")
    return F.array_distinct(F.array(w, capitalised(w), under, capitalised(under)))


def pos_variants(word: Column, upper: bool = False) -> Column:
    """Case variants with the part-of-speech marks of sparse vocabularies."""
    forms = F.array(F.lower(word), *([F.upper(word)] if upper else []), capitalised(word))
    return F.flatten(F.transform(forms, lambda w: F.transform(F.array(*map(F.lit, ("#NN", "#NP", "#JJ", "#VB"))), lambda t: F.concat(w, t))))


def norm(word: Column) -> Column:
    """Lower case of what stands before the first #."""
    return F.lower(F.substring_index(word, "#", 1))


def babel(word: Column, hyphen: bool = False) -> Column:
    marks = PATTERNS["norm_babel_dash" if hyphen else "norm_babel"]
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(word, marks, " "), " +", " ")))


def csv_clean(text: Column) -> Column:
    """Stripped; then & marks of ampersands and quotes, escaped semicolons, backslashes and quotes become spaces."""
    t = strip(text)
    for name in ("amp", "escape", "quote_escape"):
        t = F.regexp_replace(t, PATTERNS[name], " ")
    return t


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\n\r]+", " ")


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERNS["url"]), 0)


def without_markup(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", " ")


def matches(text: Column, name: str) -> Column:
    return text.rlike(PATTERNS[name])


def find_nth(text: Column, part: str, n: int) -> Column:
    """0-based place of the occurrence with 0-based number n, or -1."""
    before = F.substring_index(text, part, n + 1)
    return F.when(F.length(before) < F.length(text), F.length(before)).otherwise(F.lit(-1)).cast("int")


def sense_id(word: Column, cid: Column) -> Column:
    return F.concat(F.translate(word, " ", "_"), F.lit("#"), cid.cast("string"))


def parse_sense(sense: Column) -> Column:
    """struct<word, cid>, cut at the last #; null where a part is missing."""
    word, cid = F.regexp_extract(sense, r"^(.+)#([^#]+)$", 1), F.regexp_extract(sense, r"^(.+)#([^#]+)$", 2)
    return F.when(word != "", F.struct(word.alias("word"), cid.alias("cid")))


def parse_span(span: Column) -> Column:
    p = F.split(span, ",")
    return F.struct(F.get(p, 0).try_cast("int").alias("start"), F.get(p, 1).try_cast("int").alias("end"))


def good_token(word: Column, stop: list[str] | None = None) -> Column:
    plain = ~word.rlike(PATTERNS["spaced_numbers"])
    return plain & ~F.lower(word).isin(stop) if stop else plain


def parse_cluster(cluster: Column, strip_sense: bool = False, load_sim: bool = True) -> Column:
    """array<struct<word, sim, pos>> of ``w:0.1, w, ...``; pos from 1 in order of first occurrence.

    Without a number the weight is 1 / (place ** 0.33); an item whose last field is
    no number is left out; of equal words the last weight counts, at the first place."""
    items = F.transform(
        F.split(cluster, ","),
        lambda x, j: F.struct(
            F.trim(F.get(F.split(x, ":"), 0)).alias("w"),
            F.when(F.size(F.split(x, ":")) >= 2, F.trim(F.element_at(F.split(x, ":"), -1)).try_cast("double")).otherwise(1 / F.pow(j + 1.0, F.lit(0.33))).alias("s"),
        ),
    )
    items = F.transform(items, lambda x: F.struct((F.substring_index(x["w"], "#", 1) if strip_sense else x["w"]).alias("w"), (x["s"] if load_sim else F.lit(1.0)).alias("s")))
    items = F.filter(items, lambda x: x["s"].isNotNull() & (x["w"] != ""))
    ranked = F.array_sort(F.transform(items, lambda x, i: F.struct(x["w"].alias("w"), i.alias("i"), x["s"].alias("s"))))

    def each(y: Column) -> Column:  # equal words stand together: the place of the first, the weight of the last
        first = F.filter(y, lambda x, i: (i == 0) | (F.get(y, i - 1)["w"] != x["w"]))
        last = F.filter(y, lambda x, i: (i == F.size(y) - 1) | (F.get(y, i + 1)["w"] != x["w"]))
        return F.array_sort(F.zip_with(first, last, lambda f, l: F.struct(f["i"].alias("i"), f["w"].alias("w"), l["s"].alias("s"))))

    one = F.transform(F.array(ranked), each)[0]  # a variable of its own, so that it is worked out once and not for each word
    return F.transform(one, lambda x, i: F.struct(x["w"].alias("word"), x["s"].alias("sim"), (i + 1).alias("pos")))


def format_cluster(cluster: Column, digits: int = 4) -> Column:
    """``w:0.1234, w:...`` of array<struct<word, sim, ...>> in its order."""
    return F.array_join(F.transform(cluster, lambda x: F.concat(x["word"], F.lit(":"), fixed_point(x["sim"], digits))), ", ")


def merged_left_to_right(tokens: list[str], phrases: frozenset[str], longest: int) -> list[str]:
    """Left to right, the longest known phrase first, its tokens joined by an underscore."""
    out, i, n = [], 0, len(tokens)
    while i < n:
        for m in range(min(longest, n - i), 1, -1):
            joined = "_".join(tokens[i : i + m])
            if joined in phrases:
                out.append(joined)
                i += m
                break
        else:
            out.append(tokens[i])
            i += 1
    return out


def merge_phrases(tokens: Column, phrases: list[str]) -> Column:
    """phrases: a bounded vocabulary, underscored. An Arrow-batched function: a fold in SQL would copy
    the output at every token, which is quadratic in the length of a text."""
    known = frozenset(phrases)
    longest = max((p.count("_") + 1 for p in known), default=1)

    @pandas_udf("array<string>")
    def merge(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else merged_left_to_right(list(t), known, longest))

    return merge(tokens)


def split_underscores(tokens: Column) -> Column:
    return F.flatten(F.transform(tokens, lambda t: F.split(t, "_")))


def restore_bigrams(tokens: Column, original: Column) -> Column:
    """Adjacent pairs that stood joined in the original tokens, without an underscore of their own, are joined again."""

    @pandas_udf("array<string>")
    def restore(rows: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else merged_left_to_right(list(t), frozenset(x for x in (o if o is not None else ()) if x.count("_") == 1), 2) for t, o in zip(rows, before)])

    return restore(tokens, original)
