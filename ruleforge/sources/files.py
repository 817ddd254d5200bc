"""Readers and writers of tables, constants, pair lists, evidence, rules and settings."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import Predicate, parse
from ..plans.rules import Rule, parse_rule


def read_csv(spark: SparkSession, path: str, view: str | None = None, recursive: bool = False) -> DataFrame:
    """All columns as strings, under a header; recursive takes every csv file below path."""
    df = spark.read.option("header", True).option("inferSchema", False).option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.csv" if recursive else "*").csv(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_orc(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    df = spark.read.orc(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_tables(spark: SparkSession, paths: dict[str, str], kind: str = "csv") -> dict[str, DataFrame]:
    """One table, and a view of its name, for each path; kind is csv, orc or parquet."""
    read = {"csv": read_csv, "orc": read_orc, "parquet": lambda s, p, v=None: s.read.parquet(p)}[kind]
    return {name: read(spark, path, name) for name, path in sorted(paths.items())}


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted, under a header; nested columns are written as JSON text."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def to_csv(spark: SparkSession, source: str, target: str, kind: str = "orc") -> DataFrame:
    """Another format rewritten as csv, and read back."""
    write_csv(spark.read.format(kind).load(source), target)
    return read_csv(spark, target)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def read_types(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """Lines ``relation;column;type``."""
    out: dict[str, dict[str, str]] = {}
    for r in _lines(spark, path).collect():  # a line for each column of the schema
        relation, column, kind = (x.strip() for x in r.line.split(";"))
        out.setdefault(relation, {})[column] = kind
    return out


def read_constants(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``relation->column;constant;operator``."""
    parts = F.split("line", ";")
    place = F.split(parts[0], "->")
    return _lines(spark, path).select(F.trim(place[0]).alias("relation"), F.trim(place[1]).alias("column"), parts[1].alias("value"), F.trim(parts[2]).alias("op"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pair lists of scored predicates: predicate, tid0, tid1 with tid0 < tid1.

    Two forms: ``ML;rel->col;rel->col;i;j;i;j;...`` and ``ML#name@threshold(rel->c,..;rel->c,..):i|j;i|j;``.
    """
    lines = _lines(spark, path)
    head = F.regexp_extract("line", r"^(.*?\)):", 1)
    pair = lambda i, j: F.struct(F.trim(i).cast("long").alias("tid0"), F.trim(j).cast("long").alias("tid1"))
    # a line's pairs are one array, so that no row of a pair carries its line along
    listed = F.filter(F.split(F.regexp_replace("line", r"^.*?\):", ""), ";"), lambda p: p != "")
    named = lines.where(F.col("line").contains("#")).select(head.alias("predicate"), F.transform(listed, lambda p: pair(F.get(F.split(p, r"\|"), F.lit(0)), F.get(F.split(p, r"\|"), F.lit(1)))).alias("pairs"))
    items = F.split("line", ";")
    plain = lines.where(~F.col("line").contains("#")).select(F.concat_ws(";", F.slice(items, 1, 3)).alias("predicate"), F.filter(F.slice(items, 4, 1 << 30), lambda x: x != "").alias("ids"))
    plain = plain.where(F.size("ids") > 1).select("predicate", F.transform(F.sequence(F.lit(0), F.size("ids") - 2, F.lit(2)), lambda i: pair(F.get("ids", i), F.get("ids", i + 1))).alias("pairs"))
    both = named.unionByName(plain).select("predicate", F.explode(F.filter("pairs", lambda p: p["tid0"] < p["tid1"])).alias("p"))
    return both.select("predicate", "p.tid0", "p.tid1").distinct()


def write_evidence(evidence: DataFrame, path: str) -> None:
    """predicates (array), n as lines ``predicate;predicate;...SUPPcount``."""
    evidence.select(F.concat(F.array_join(F.array_sort("predicates"), ";"), F.lit("SUPP"), F.col("n").cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """predicates (array), n"""
    parts = F.split("line", "SUPP")
    return _lines(spark, path).select(F.split(parts[0], ";").alias("predicates"), F.trim(parts[1]).cast("long").alias("n"))


def read_vocabulary(spark: SparkSession, path: str) -> list[Predicate]:
    """One predicate a line; its number is the line's."""
    return [parse(r.line) for r in _lines(spark, path).collect()]  # tens of lines


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs: left_table, left_row, right_table, right_row, each once."""
    return spark.read.option("header", True).csv(path).toDF("left_table", "left_row", "right_table", "right_row").dropDuplicates()


def labelled_ids(labels: DataFrame) -> DataFrame:
    """table_name, row_id of all labelled rows."""
    side = lambda s: labels.select(F.col(f"{s}_table").alias("table_name"), F.col(f"{s}_row").alias("row_id"))
    return side("left").union(side("right")).distinct()


def write_rules(spark: SparkSession, rules: list[Rule], path: str) -> None:
    """One rule a line."""
    spark.createDataFrame([(str(r),) for r in rules], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_rules(spark: SparkSession, path: str, kind: str = "text") -> list[Rule]:
    """Rules from text lines, or from the first column of ORC files; other lines are passed over."""
    df = spark.read.format(kind).load(path)
    column = df.columns[0]
    found = df.where(F.col(column).startswith("Rule : ")).select(column).collect()  # mined rules: thousands at most
    return [r for row in found if (r := parse_rule(row[0]))]


@dataclass
class Settings:
    """Settings of a discovery run, as in ``key=value`` files."""

    support: float = 1e-5
    confidence: float = 0.9
    top_k: int = 10_000
    max_tuples: int = 2
    max_level: int = 4
    low_percent: float = 10.0
    high_percent: float = 80.0
    clusters: int = 4
    interval_percent: float = 1.0
    few_values: int = 5
    sample_ratio: float = 0.1
    sample_rounds: int = 1

    @staticmethod
    def parse(text: str) -> Settings:
        given = dict(re.findall(r"^\s*([\w.]+)\s*[=:]\s*(.*?)\s*$", re.sub(r"(?m)^\s*[#!].*$", "", text), re.MULTILINE))
        kinds = {f.name: type(f.default) for f in fields(Settings)}
        return Settings(**{k: kinds[k](v) for k, v in given.items() if k in kinds})
