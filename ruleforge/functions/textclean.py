"""Cleaning and splitting of text, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs that are set apart, words that say nothing in addresses, and Chinese digits.
SIGNS = "/+-^*÷#!\"(),.:;<=>?@[\\]_`{|}~'¿€$%&£±"
USELESS_WORDS = ("深圳", "深圳市", "福田", "福田区", "街道", "社区", "广东", "广东省")
CHINESE_DIGITS = {"〇": "0", "一": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9", "零": "0", "壹": "1", "贰": "2", "叁": "3", "肆": "4", "伍": "5", "陆": "6", "柒": "7", "捌": "8", "玖": "9", "貮": "2", "两": "2"}

_SIGN_CLASS = "[" + "".join(re.escape(c) for c in SIGNS) + "]"


def clean_sentence(c: Column) -> Column:
    """Lower case; line ends and tabs go; a dash between blanks joins; signs stand between blanks; trimmed."""
    flat = F.regexp_replace(F.lower(c), r"[\n\t]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(flat, " - ", "-"), f"({_SIGN_CLASS})", " $1 "))


def remove_signs(c: Column) -> Column:
    """Only letters, digits and Chinese characters stay, and whatever separates two runs of digits."""
    other = r"[^\x{4e00}-\x{9fff}0-9a-zA-Z]+"  # fixed value: what counts as a sign
    return F.regexp_replace(c, rf"([0-9]+{other}[0-9]+)|{other}", "$1")


def remove_words(c: Column, words: tuple[str, ...] = USELESS_WORDS) -> Column:
    """Longer words go first, so that none leaves a rest of itself."""
    for w in sorted(words, key=lambda w: (-len(w), w)):
        c = F.replace(c, F.lit(w), F.lit(""))
    return c


def remove_asides(c: Column) -> Column:
    """Bracketed text (either kind of bracket, from the first to the last) and runs of eleven digits go."""
    for pattern in (r"\(.+\)", "（.+）", r"[0-9]{11}"):
        c = F.regexp_replace(c, pattern, "")
    return c


def plain_digits(c: Column) -> Column:
    return F.translate(c, "".join(CHINESE_DIGITS), "".join(CHINESE_DIGITS.values()))


def letters_digits(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(c, "[^a-z0-9]", "")


def short_codes(c: Column, longest: int = 8) -> Column:
    """Runs of lower-case letters and digits under `longest` characters, joined by dashes."""
    return F.array_join(F.filter(F.split(c, "[^a-z0-9]+"), lambda r: (F.length(r) > 0) & (F.length(r) < longest)), "-")


def code_before(c: Column, word: str) -> Column:
    """Letters and digits right before the first place of a word."""
    return F.when(F.instr(c, word) > 0, F.regexp_extract(F.substring_index(c, word, 1), "([a-z0-9]*)$", 1)).otherwise("")


def last_code(c: Column) -> Column:
    return F.regexp_extract(c, "([a-z0-9]*)$", 1)


def grams(c: Column, n: int = 3) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def joined_columns(df: DataFrame, separator: str = " ") -> Column:
    """All columns whose name does not hold "id", as one string."""
    return F.concat_ws(separator, *[F.col(c).cast("string") for c in df.columns if "id" not in c.lower()])


def leave_one_out(df: DataFrame, columns: list[str], separator: str = " ") -> DataFrame:
    """For each of columns, the others as one string: columns without_<column>."""
    return df.select("*", *[F.concat_ws(separator, *[F.col(x).cast("string") for x in columns if x != c]).alias(f"without_{c}") for c in columns])


def frequent_tokens(df: DataFrame, tokens: Column, top: int = 100) -> DataFrame:
    """token, n: the tokens in most rows, ties by token."""
    rows = df.select(F.explode(F.array_distinct(tokens)).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(top)


def useful_keywords(df: DataFrame, text: Column, keywords: list[str], ratio: float = 0.5) -> DataFrame:
    """keyword, n, before: keywords that a letter or digit precedes in at least a share of the rows."""
    at = [F.instr(text, w) for w in keywords]
    row = df.agg(*[x for i, (w, p) in enumerate(zip(keywords, at, strict=True)) for x in (F.count(F.when(p > 0, 1)).alias(f"n{i}"), F.count(F.when((p > 1) & code_before(text, w).rlike("[a-z0-9]$"), 1)).alias(f"b{i}"))])
    entries = [F.struct(F.lit(w).alias("keyword"), F.col(f"n{i}").alias("n"), F.col(f"b{i}").alias("before")) for i, w in enumerate(keywords)]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where((F.col("n") > 0) & (F.col("before") >= ratio * F.col("n")))
