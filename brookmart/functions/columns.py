"""Column helpers that every job uses; all are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CODES

STAMP, DAY = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"


def is_entry(last_page: Column) -> Column:
    """A page without a predecessor: null or empty."""
    return F.coalesce(F.length(last_page), F.lit(0)) == 0


def to_millis(text: Column) -> Column:
    """Epoch milliseconds of 'yyyy-MM-dd HH:mm:ss' or the same with slashes; 0 for null or anything else."""
    dashed = F.try_to_timestamp(text, F.lit(STAMP))
    slashed = F.try_to_timestamp(F.translate(text, "-", "/"), F.lit("yyyy/MM/dd HH:mm:ss"))
    return F.coalesce(F.unix_millis(dashed), F.unix_millis(slashed), F.lit(0).cast("long"))


def event_time(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def stamp(millis: Column) -> Column:
    return F.date_format(event_time(millis), STAMP)


def day(millis: Column) -> Column:
    return F.date_format(event_time(millis), DAY)


def age(birthday: Column, as_of: Column) -> Column:
    """Whole years of 365 days between two times; a birthday is 'yyyy-MM-dd'."""
    born = F.unix_millis(F.try_to_timestamp(birthday, F.lit(DAY)))
    return F.floor((F.unix_millis(as_of) - born) / F.lit(1000 * 60 * 60 * 24 * 365)).cast("int")


#: A word of the default tokenizer, found without being consumed: a run of letters and digits of one kind, or each two
#: neighbours in a run of Han, which is written without spaces (a lone one is a word of its own).
PLAIN = r"[\p{L}\p{N}&&[^\p{IsHan}]]"
WORD = rf"(?=(\p{{IsHan}}{{2}}|(?<!\p{{IsHan}})\p{{IsHan}}(?!\p{{IsHan}})|(?<!{PLAIN}){PLAIN}+))"


RUNS = rf"\p{{IsHan}}+|{PLAIN}+"


def words(text: Column) -> Column:
    """Words in lower case by the default tokenizer, which stays in Catalyst: runs, and only texts with Han are looked at
    more closely, whose runs of Han are cut into each two neighbours."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(RUNS), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    cut = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^\p{IsHan}{2}"), pairs(r)).otherwise(F.array(r))))
    return F.when(text.rlike(r"\p{IsHan}"), cut).otherwise(runs)


def code_name(code: Column, group: str) -> Column:
    """The name of a code of a group (see schemas.CODES); null for others."""
    return F.create_map(*(F.lit(x) for pair in CODES[group].items() for x in pair))[code]


def camel(df: DataFrame) -> DataFrame:
    """lower_underscore column names as lowerCamel."""
    return df.toDF(*(re.sub(r"_+(\w)", lambda m: m[1].upper(), c.lower()) for c in df.columns))


def first_non_null(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by key; each column is the left's value, or the right's where that is null."""
    both = left.alias("l").join(right.alias("r"), key, "full")
    return both.select(key, *(F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in left.columns if c != key))
