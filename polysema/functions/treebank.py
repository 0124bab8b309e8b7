"""Words as the Penn Treebank has them: quotes, contractions, brackets and final periods are tokens of their own.

A text is cut into sentences, and each sentence is rewritten by an ordered list of rules that put
spaces around tokens. All of it is regular-expression columns, without look-around, so that other SQL
engines can run the same rules. Sentence ends are found by rule: a period, question or exclamation
mark before white space, unless it ends an abbreviation of the list, an initial or, before a small letter,
dotted letters or an ellipsis. (The usual implementation has learnt its abbreviations from a corpus.)

A null text has no tokens (null); an empty one has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, word characters and their opposites, as members of a class, in both engines.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{M}\p{N}_"
_CUT, _DOT = "\x01", "\x02"

# Abbreviations whose period ends no sentence.
ABBREVIATIONS = "mr mrs ms dr prof gen sen rep sr jr st vs etc inc ltd co corp fig no vol dept est approx al jan feb mar apr jun jul aug sep sept oct nov dec".split()

#: Pattern and replacement ($1 is a group), in order. Periods that end no sentence are hidden first.
SENTENCE_RULES = [
    (rf"(?i)(^|[^{WORD}])({'|'.join(ABBREVIATIONS)})\.", f"$1$2{_DOT}"),
    (rf"(^|[^{WORD}])([A-Z])\.([{SPACE}])", f"$1$2{_DOT}$3"),
    (rf"(\p{{L}}\.\p{{L}})\.([{SPACE}]+\p{{Ll}})", f"$1{_DOT}$2"),
    (rf"(\.\.)\.([{SPACE}]+\p{{Ll}})", f"$1{_DOT}$2"),
    (rf"([.?!][\"')\]}}»”’]*)[{SPACE}]+", f"$1{_CUT}"),
    (_DOT, "."),
]

# The rules of the tokenizer, in its order. Some are there twice, as what one match takes the next can't.
_ONE_LETTER = r"(')([0-9_a-ce-lo-ru-zA-CE-LO-RU-Z\x{c0}-\x{2af}\x{370}-\x{1fff}\x{2c00}-\x{d7ff}])" + rf"([^{WORD}]|$)"
_SPLIT_WORDS = [("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n"), ("wan", "na")]
TOKEN_RULES = [
    # opening quotes
    (r"([«“‘„]|`+)", " $1 "),
    (r'^"', "``"),
    (r"(``)", " $1 "),
    (r"""([ (\[{<])("|'')""", "$1 `` "),
    (_ONE_LETTER, "$1 $2$3"),
    (_ONE_LETTER, "$1 $2$3"),
    # punctuation
    (rf"""([^.])(\.)([\])}}>"'»”’ ]*)[{SPACE}]*$""", "$1 $2 $3 "),
    (r"([:,])([^\p{Nd}])", " $1 $2"),
    (r"([:,])$", " $1 "),
    (r"(\.{2,})", " $1 "),
    (r"([;@#$%&])", " $1 "),
    (rf"""([^.])(\.)([\])}}>"']*)[{SPACE}]*$""", "$1 $2$3 "),
    (r"([?!])", " $1 "),
    (r"([^'])' ", "$1 ' "),
    (r"([*])", " $1 "),
    # brackets and dashes
    (r"([\]\[(){}<>])", " $1 "),
    (r"(--)", " $1 "),
    (r"^(.*)$", " $1 "),
    # closing quotes and clitics
    (r"([»”’])", " $1 "),
    (r"('')", " $1 "),
    (r'"', " '' "),
    (rf"[{SPACE}]+", " "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    # contractions that are written as one word
    *((rf"(?i)([^{WORD}])({a})({b})([^{WORD}])", "$1 $2 $3 $4") for a, b in _SPLIT_WORDS for _ in range(2)),
    (r"(?i) ('t)(is|was) ", " $1 $2 "),
]


def _rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0].replace("^(.*)$", "(?s)^(.*)$"), r[1]), rules, text)


def sentences(text: Column) -> Column:
    marked = F.split(_rewritten(text, SENTENCE_RULES), _CUT)
    return F.filter(F.transform(marked, lambda s: F.regexp_replace(s, rf"^[{SPACE}]+|[{SPACE}]+$", "")), lambda s: s != "")


def word_tokenize(text: Column) -> Column:
    """array<string> of the tokens of a text."""
    each = F.transform(sentences(text), lambda s: F.filter(F.split(_rewritten(s, TOKEN_RULES), " "), lambda w: w != ""))
    return F.flatten(each)


def sql(text: str) -> str:
    """The same in DuckDB's SQL, as a list of words."""

    def rewritten(c: str, rules: list[tuple[str, str]]) -> str:
        for pattern, replacement in rules:
            flags = "gs" if pattern == r"^(.*)$" else "g"
            by = replacement.replace("$", "\\").replace("'", "''").replace(_CUT, "' || chr(1) || '").replace(_DOT, "' || chr(2) || '")
            p = pattern.replace("'", "''").replace(_DOT, "' || chr(2) || '")
            c = f"regexp_replace({c}, '{p}', '{by}', '{flags}')"
        return c

    trimmed = rf"regexp_replace(s, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
    marked = f"list_filter(list_transform(string_split({rewritten(text, SENTENCE_RULES)}, chr(1)), lambda s: {trimmed}), lambda s: s <> '')"
    return f"flatten(list_transform({marked}, lambda s: list_filter(string_split({rewritten('s', TOKEN_RULES)}, ' '), lambda w: w <> '')))"
