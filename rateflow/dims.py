"""Dictionaries (H1-H4): field aliases, service keywords, stop-words.

They are parameters, not data: a few rows each. Every operator takes them as arguments so a
user can pass their own; ``*_frame`` turns them into DataFrames (``dim_*`` of FIXTURES.md).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values (must equal the reference for equal results).
# H1: canonical rate-table fields and the header aliases of each, in priority order.
FIELD_ALIASES: dict[str, list[str]] = {
    "наименование": ["наименование", "наименование услуги"],
    "ставка": ["ставка"],
    "вход": ["вход"],
}

# H3: service keyword -> canonical service, checked in this order (first contained keyword wins).
SERVICE_KEYWORDS: list[tuple[str, str]] = [
    ("фрахт", "Фрахт"),
    ("организация морской перевозки", "Фрахт"),
    ("транспортно-экспедиторское обслуживание", "Транспортно-Экспедиторское обслуживание"),
    ("транспортно-экспедиционного обслуживания", "Транспортно-Экспедиторское обслуживание"),
    ("экспедирование", "Транспортно-Экспедиторское обслуживание"),
    ("вознаграждение", "Транспортно-Экспедиторское обслуживание"),
    ("организация жд перевозки", "Организация ЖД перевозки"),
    ("ржд", "Организация ЖД перевозки"),
    ("организация железнодорожной перевозки", "Организация ЖД перевозки"),
    ("организация автовывоза", "Организация автовывоза"),
    ("автовывоз", "Организация автовывоза"),
    ("организация автоперевозки", "Организация автовывоза"),
    ("автоперевозка", "Организация автовывоза"),
    ("организация автомобильной перевозки", "Организация автовывоза"),
]

# H4: stop-words; a row whose name contains one is dropped.
STOPWORDS: list[str] = ["охрана"]
# End of fixed values.

NAME, RATE, ENTRY = "наименование", "ставка", "вход"
CANONICAL_FIELDS = (NAME, RATE, ENTRY)


def alias_map(field_aliases: dict[str, list[str]] = FIELD_ALIASES) -> dict[str, str]:
    """H2: lower-cased alias -> canonical field."""
    out: dict[str, str] = {}
    for field, aliases in field_aliases.items():
        for alias in aliases:
            out[alias.lower()] = field
    return out


def field_alias_frame(spark: SparkSession, field_aliases=FIELD_ALIASES) -> DataFrame:
    """One row per alias: its field, the field's place (``field_no``) and the alias's place in it."""
    rows = [
        (a.lower(), f, p, n) for n, (f, aliases) in enumerate(field_aliases.items()) for p, a in enumerate(aliases)
    ]
    return spark.createDataFrame(rows, "alias STRING, field STRING, prio INT, field_no INT")


def service_keyword_frame(spark: SparkSession, keywords=SERVICE_KEYWORDS) -> DataFrame:
    rows = [(k.lower(), s, p) for p, (k, s) in enumerate(keywords)]
    return spark.createDataFrame(rows, "keyword STRING, service STRING, prio INT")


def stopword_frame(spark: SparkSession, words=STOPWORDS) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word STRING")


def keyword_row(dim: DataFrame) -> DataFrame:
    """A user keyword table ``(keyword, service, prio)`` as one row: ``keywords`` in priority order.

    One Spark aggregate: nothing is collected to the driver and no number of rows is refused. Null
    and empty keywords are left out; an empty table gives an empty array.
    """
    rows = dim.where("keyword IS NOT NULL AND keyword <> ''").select(
        F.struct(F.col("prio"), F.lower("keyword").alias("keyword"), F.col("service")).alias("k")
    )
    return rows.agg(F.sort_array(F.collect_list("k")).alias("keywords"))
