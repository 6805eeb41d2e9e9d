"""INSERT statements of a SQL dump."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanframe.operators.rows import assign_id
from cleanframe.plans.storage import stored

# The parts of an INSERT statement.
INSERT = r"(?is)^\s*INSERT\s"
HEAD = re.compile(r"""(?is)\s*INSERT\s+(?:INTO\s+)?["`]?([^\s("`]*)["`]?\s*(?:\(([^)]*)\))?\s*VALUES\b""")
NAME = re.compile(r"""[^\s,"`]+(?:[ ]+[^\s,"`]+)*""")
TOKEN = re.compile(r"""'[^']*'|"[^"]*"|[(),]|[^'"(),]+|['"]""")
ORDER = ["_file", "_statement", "_tuple"]
BATCH_ROWS = 5_000


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _statement, value): the statements of the files in order.

    Files are read in splits cut at each `;`. A statement ends at a `;` with an even number of quotes before it, so the quotes of
    each fragment are counted, summed up over the fragments of a split and over the splits of a file, and fragments of one
    statement put together. String values are in single quotes, a quote inside doubled; an odd number of quotes in a file is
    an error.
    """
    text = spark.read.option("lineSep", ";").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), "value",
        (F.length("value") - F.length(F.replace("value", F.lit("'"), F.lit("")))).alias("_quotes"))
    line = Window.partitionBy("_file", "_block").orderBy("_line")
    before_line = line.rowsBetween(Window.unboundedPreceding, -1)
    before_block = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def running(df: DataFrame, what: str, name: str) -> DataFrame:
        """`name`: the sum of `what` over all fragments of the file before this one."""
        blocks = df.groupBy("_file", "_block").agg(F.sum(what).alias("_sum")).select(
            "_file", "_block", F.coalesce(F.sum("_sum").over(before_block), F.lit(0)).alias("_blocks"))
        inner = df.withColumn("_lines", F.coalesce(F.sum(what).over(before_line), F.lit(0)))
        return inner.join(blocks, ["_file", "_block"]).withColumn(name, F.col("_lines") + F.col("_blocks")).drop("_lines", "_blocks")

    fragments = running(text, "_quotes", "_before").withColumn("_starts", (F.col("_before") % 2 == 0).cast("int"))
    numbered = running(fragments, "_starts", "_started").withColumn("_statement", F.col("_started") + F.col("_starts"))
    parts = F.array_sort(F.collect_list(F.struct("_block", "_line", "value")))
    joined = numbered.groupBy("_file", "_statement").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), ";").alias("value"), F.sum("_quotes").alias("_quotes"))
    unbalanced = F.raise_error(F.concat(F.lit("a quote is not closed in "), F.col("_file")))
    return joined.select("_file", "_statement", F.when(F.col("_quotes") % 2 == 0, F.col("value")).otherwise(unbalanced).alias("value"))


def _value(text: str, quoted: bool) -> str | None:
    """Without surrounding quotes; an empty value and the word NULL are NULL."""
    text = text.strip()
    if not quoted:
        return None if text.upper() in ("", "NULL") else text
    if text[0] in "'\"" and text[-1] == text[0]:
        text = text[1:-1].replace("''", "'")
    return text or None


def parse_values(text: str) -> list[list[str | None]]:
    """The tuples of a VALUES list, in one pass; text outside of them is an error."""
    tuples, values, parts, quoted, depth = [], [], [], False, 0
    for token in TOKEN.finditer(text):
        part = token.group()
        if depth == 0:
            if part == "(":
                depth, values, parts, quoted = 1, [], [], False
            elif part != "," and part.strip():
                raise ValueError(f"text between the tuples of an INSERT: {part.strip()[:80]!r}")
            continue
        if depth == 1 and part in (",", ")"):
            values.append(_value("".join(parts), quoted))
            parts, quoted = [], False
            if part == ")":
                tuples.append(values)
                depth = 0
            continue
        depth += (part == "(") - (part == ")")
        quoted |= part[0] in "'\""
        parts.append(part)
    if depth:
        raise ValueError(f"a tuple of an INSERT is not closed: {text[-80:]!r}")
    return tuples


def _tuples(default_table: str):
    def read(batches):
        for batch in batches:
            rows = []
            for file, statement, text in zip(batch["_file"], batch["_statement"], batch["value"]):
                head = HEAD.match(text)
                if not head:
                    continue
                columns = [n.strip() for n in NAME.findall(head[2] or "")]
                for i, values in enumerate(parse_values(text[head.end():])):
                    rows.append((file, statement, i, head[1] or default_table, columns, values))
                    if len(rows) == BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=[*ORDER, "table", "columns", "values"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[*ORDER, "table", "columns", "values"])
    return read


def read_inserts(spark: SparkSession, path: str, default_table: str) -> DataFrame:
    """One row per inserted tuple: source position, table, column names (empty if not given), values."""
    return statements(spark, path).where(F.col("value").rlike(INSERT)).mapInPandas(
        _tuples(default_table), "_file string, _statement long, _tuple int, table string, columns array<string>, values array<string>")


def read_dump(spark: SparkSession, path: str, default_table: str = "dump", id_col: str | None = "id") -> dict[str, DataFrame]:
    """Text tables filled from INSERT statements, all other statements ignored; ids follow the file order.

    Without a column list the columns are col1, col2, ... Only table and column names reach the driver.
    """
    inserts = stored(read_inserts(spark, path, default_table))
    shapes = inserts.groupBy("table", "columns").agg(
        F.min(F.struct(*ORDER)).alias("first"), F.max(F.size("values")).alias("width")).collect()
    tables: dict[str, list[str]] = {}
    for shape in sorted(shapes, key=lambda r: tuple(r["first"])):
        names = shape["columns"] or [f"col{i}" for i in range(1, shape["width"] + 1)]
        known = tables.setdefault(shape["table"], [])
        known += [n for n in names if n not in known]
    result = {}
    for name, columns in tables.items():
        rows = inserts.where(F.col("table") == name)

        def value(i: int, c: str) -> Column:
            position = F.when(F.size("columns") == 0, F.lit(i)).otherwise(F.array_position("columns", F.lit(c)).cast("int") - 1)
            return F.when(position >= 0, F.get("values", position))

        body = rows.select(*ORDER, *[value(i, c).alias(c) for i, c in enumerate(columns)])
        result[name] = (assign_id(body, ORDER, id_col) if id_col else body).drop(*ORDER)
    return result
