"""Column functions (E1, E3-E8, D3 predicate, number rendering).

All of them are built-in Spark expressions, so they stay inside whole-stage codegen.
Java regex differs from Python's in three places that matter here:
  * ``(?U)\\s`` lacks U+001C..U+001F, which Python's ``\\s`` and ``str.strip`` include;
  * ``\\d`` is ASCII only, while Python also reads other decimal digits as numbers; they are
    translated to ASCII first, in the same pass that drops the white space;
  * ``(?iu)`` is needed for Unicode case folding.
Where an exact native function exists (``translate``, ``btrim``, ``contains``) it is used
instead of a regex: Spark decodes every value to a Java string for each regex call.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateflow import dims

# Whitespace as Python's ``str.isspace`` (what ``\s`` and ``str.strip`` use there), computed
# from the interpreter by rule; Java's ``(?U)\s`` lacks U+001C..U+001F.
PY_WHITESPACE = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
WHITESPACE_NO_NEWLINE = PY_WHITESPACE.replace("\n", "")
# Decimal digits of other scripts and their values, computed from the interpreter by rule.
_DIGITS = {chr(c): unicodedata.decimal(chr(c)) for c in range(0x80, 0x20000) if chr(c).isdecimal()}
_WS = r"\s\x1c-\x1f"
# E7 as a regex (kept for SQL users); the column function below uses ``translate``.
WS_EXCEPT_NEWLINE = r"(?U)[" + _WS + r"&&[^\n]]"
# The first number; '.' is the only decimal mark.
FIRST_NUMBER = r"(\d+(?:\.\d+)?)"
# Regex metacharacters: a stop-word without them is matched as a plain substring.
_REGEX_META = set(".^$*+?{}[]\\|()")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()`` with Python's whitespace set (plain ``trim`` keeps NBSP and tabs)."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def header_key(c) -> Column:
    """``name.lower().strip()``."""
    return F.lower(py_strip(c))


def remove_spaces_keep_newlines(c) -> Column:
    """Every whitespace character except the newline removed (``translate``, no regex)."""
    return F.translate(_col(c), WHITESPACE_NO_NEWLINE, "")


def first_number(c) -> Column:
    """First number of the text after removing every whitespace except newlines.

    ``1 234.50`` -> 1234.5, ``1 234,50`` -> 1234.0, ``-7`` -> 7.0, ``.5`` -> 5.0, none -> null.
    Numbers never join across lines because newlines survive. Digits of any script count.
    """
    # translate deletes the characters that have no counterpart: the white space
    plain = F.translate(_col(c), "".join(_DIGITS) + WHITESPACE_NO_NEWLINE, "".join(map(str, _DIGITS.values())))
    return F.regexp_extract(plain, FIRST_NUMBER, 1).try_cast("double")  # no number: '' casts to null


def after_last_equal(c) -> Column:
    """The text from the last ``=`` on, including it (null when there is no ``=``)."""
    c = _col(c)
    return F.when(c.contains("="), F.concat(F.lit("="), F.substring_index(c, "=", -1)))


def entry_number(c) -> Column:
    """E5: number after the last ``=``, else the first number."""
    return first_number(F.substring_index(_col(c), "=", -1))


def service_name(c, keywords: Sequence[tuple[str, str]] = dims.SERVICE_KEYWORDS, lowered: bool = False) -> Column:
    """First keyword (in dictionary order) contained in the lower-cased text, else ''.

    ``lowered``: ``c`` is already lower-cased (saves repeated lower() inside lambdas)."""
    c = _col(c)
    low = c if lowered else F.lower(c)
    expr = None
    for keyword, service in keywords:
        cond = low.contains(keyword.lower())
        expr = F.when(cond, F.lit(service)) if expr is None else expr.when(cond, F.lit(service))
    expr = F.lit("") if expr is None else expr.otherwise(F.lit(""))
    return F.when(c.isNotNull(), expr)


def _grams(c: Column, q: int) -> Column:
    """All distinct substrings of ``q`` characters (null or shorter: none)."""
    n = F.length(c) - q + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, i, F.lit(q)))))


def with_services(df: DataFrame, name_col: str, dim: DataFrame, out: str = "name", q: int = 3) -> DataFrame:
    """E6 with a dictionary table ``(keyword, service, prio)`` of any size: adds the service of the
    keyword of lowest priority number that the lower-cased text contains, else ''; null text -> null.

    Each keyword is filed under one of its substrings of ``q`` characters, the one that fewest
    keywords have (shorter keywords under themselves). Distinct texts meet the keywords by an
    equi-join on their own substrings, so only pairs that share one are compared; rows get the
    result of their text by an equi-join. Null and empty keywords are left out; of equal priority
    numbers the smallest keyword, then service, counts.
    """
    keys = dim.where("keyword IS NOT NULL AND keyword <> ''").select(F.lower("keyword").alias("keyword"), "service", "prio").distinct()
    sizes = F.least(F.length("keyword"), F.lit(q))
    short = F.filter(F.array(*[F.struct(F.lit(k).alias("q"), _grams(F.col("keyword"), k).alias("g")) for k in range(1, q + 1)]), lambda x: x["q"] == sizes)[0]["g"]
    filed = keys.select("keyword", "service", "prio", F.explode(short).alias("gram"))
    rare = filed.groupBy("gram").agg(F.count("*").alias("n"))
    filed = filed.join(rare, "gram").groupBy("keyword", "service", "prio").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    low = F.lower(F.col(name_col))
    texts = df.where(F.col(name_col).isNotNull()).select(low.alias("_low")).distinct()
    every = F.flatten(F.array(*[F.coalesce(_grams(F.col("_low"), k), F.array().cast("array<string>")) for k in range(1, q + 1)]))
    pairs = texts.select("_low", F.explode(every).alias("gram")).join(filed, "gram").where(F.contains(F.col("_low"), F.col("keyword")))
    best = pairs.groupBy("_low").agg(F.min(F.struct("prio", "keyword", "service")).alias("_best"))
    joined = df.withColumn("_low", low).join(best, "_low", "left")
    found = F.when(F.col("_low").isNotNull(), F.coalesce(F.col("_best.service"), F.lit("")))
    return joined.withColumn(out, found).drop("_low", "_best")


def stopword_pattern(words: Sequence[str] = dims.STOPWORDS, literal: bool = False) -> str:
    """Stop-words joined into one case-insensitive pattern (as regex, like the source)."""
    parts = [r"\Q" + w + r"\E" for w in words] if literal else list(words)
    return "(?iu)(?:" + "|".join(parts) + ")"


def without_stopwords(df: DataFrame, name_col: str, dim: DataFrame, q: int = 3) -> DataFrame:
    """D3 with a stop-word table ``(word)`` of any size: the rows whose name is non-null and contains
    no stop-word, any case, as plain text. Meets the words as ``with_services`` meets its keywords."""
    words = dim.select(F.col("word").alias("keyword"), F.lit("x").alias("service"), F.lit(0).alias("prio"))
    return with_services(df, name_col, words, out="_stop", q=q).where("_stop = ''").drop("_stop")


def keeps_row(name, words: Sequence[str] = dims.STOPWORDS, literal: bool = False, lowered: bool = False) -> Column:
    """D3 predicate: True when the name is non-null and contains no stop-word."""
    name = _col(name)
    if not words:
        return name.isNotNull()
    if literal or not any(ch in _REGEX_META for w in words for ch in w):
        # plain words: case-insensitive substring test without a regex per row
        low = name if lowered else F.lower(name)
        hit = None
        for w in words:
            cond = low.contains(w.lower())
            hit = cond if hit is None else hit | cond
        return F.coalesce(~hit, F.lit(False))
    return F.coalesce(~name.rlike(stopword_pattern(words, literal)), F.lit(False))


def source_stem(path) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(_col(path), r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def _shorter(d: Column) -> Column:
    """Digits and exponent with one digit less where that is still the same double.

    Java 17 prints some doubles with a digit or two too many; Python's ``repr`` never does.
    """
    n = F.length(d["digits"])
    cut = F.substring(d["digits"], F.lit(1), n - 1)
    up = (cut.try_cast("decimal(20,0)") + 1).cast("string")
    first, second = F.when(F.right(d["digits"], F.lit(1)) < "5", cut).otherwise(up), F.when(F.right(d["digits"], F.lit(1)) < "5", up).otherwise(cut)

    def same(digits: Column) -> Column:
        return F.concat(digits, F.lit("E"), (d["e"] - n + 2).cast("string")).try_cast("double") == d["value"]

    def kept(digits: Column) -> Column:
        return F.struct(
            F.rtrim(digits, F.lit("0")).alias("digits"), (d["e"] + F.length(digits) - n + 1).cast("int").alias("e"), d["value"].alias("value")
        )

    long = (n >= 16) | ((n > 1) & (d["value"] < 1e-300))
    return F.when(long & same(first), kept(first)).when(long & same(second), kept(second)).otherwise(d)


def _from_digits(d: Column) -> Column:
    """Python ``repr`` of a positive number from its significant digits and decimal exponent."""
    digits, e = d["digits"], d["e"]
    n = F.length(digits)
    sci = F.concat(
        F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit("")),
        F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.abs(e) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(e).cast("string"),
    )
    whole = F.concat(digits, F.repeat(F.lit("0"), e - n + 1), F.lit(".0"))
    mixed = F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, n))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    return F.when((e < -4) | (e >= 16), sci).when(e >= n - 1, whole).when(e >= 0, mixed).otherwise(small)


def render_number(c) -> Column:
    """A double as pandas writes it in CSV (Python ``repr``): ``1234.5``, ``35.0``,
    ``10000000.0``, ``1e+16``, ``1.5e-07``; null -> null.

    All digits of the double are kept: the text is built from the digits and the exponent of the
    cast (``1.5E-7``), positional for 1e-4 <= |x| < 1e16. Plain short casts are already right.
    """
    c = _col(c)
    a = F.abs(c)
    java = a.cast("string")
    mantissa = F.regexp_extract(java, r"^([0-9.]+)", 1)
    power = F.coalesce(F.regexp_extract(java, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    before = F.length(F.substring_index(mantissa, ".", 1))
    every = F.replace(mantissa, F.lit("."), F.lit(""))
    leading = F.length(every) - F.length(F.ltrim(every, F.lit("0")))
    parts = F.struct(
        F.btrim(every, F.lit("0")).alias("digits"), (before - 1 - leading + power).cast("int").alias("e"), a.alias("value")
    )
    text = let(let(let(parts, _shorter), _shorter), _from_digits)  # Java may print 18 digits
    plain = (a >= 1e-3) & (a < 1e7) & (F.length(java) < 17)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(c.isNaN(), F.lit("nan"))
        .when(plain | (a == 0), c.cast("string"))
        .when(a == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .otherwise(F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), text))
    )
