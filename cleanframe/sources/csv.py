"""CSV in and out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanframe.functions.columns import ref
from cleanframe.operators.rows import assign_id, conform, max_id
from cleanframe.operators.schema import parse_timestamp
from cleanframe.plans.storage import stored

# Texts read as NULL, and the words of a truth value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "N/A", "NA",
           "NULL", "NaN", "n/a", "nan", "null")
TRUTH_WORDS = ("True", "TRUE", "true", "False", "FALSE", "false")
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
ORDER = ["_file", "_block", "_line"]
EXTRA = "_extra"
#: Splits that begin inside quotes are broadcast up to this number, about 15 MB.
BROADCAST_SPLITS = 100_000


def missing_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~ref(c).isin(*MISSING), ref(c)).alias(c) for c in df.columns])


def infer_types(df: DataFrame) -> dict[str, str]:
    """bigint, double, boolean, timestamp_ntz or string per text column: the narrowest that every value fits.

    One aggregate over one scan: each value has one class, a bit, and a column collects the bits of its values.
    Columns without values stay text.
    """
    def value_class(c: Column) -> Column:
        number = F.when(c.try_cast("bigint").isNotNull(), 1).otherwise(2)
        return (F.when(c.isNull(), 0).when(c.rlike(NUMBER), number).when(c.isin(*TRUTH_WORDS), 4)
                .when(parse_timestamp(c).isNotNull(), 8).otherwise(16))

    found = df.agg(*[F.bit_or(value_class(ref(c))).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    fitting = {1: "bigint", 2: "double", 3: "double", 4: "boolean", 8: "timestamp_ntz"}
    return {c: fitting.get(found[f"c{i}"], "string") for i, c in enumerate(df.columns)}


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    def cast(name: str) -> Column:
        value = parse_timestamp(ref(name)) if types[name] == "timestamp_ntz" else F.trim(ref(name)).cast(types[name])
        return value.alias(name) if types[name] != "string" else ref(name)
    return df.select(*[cast(c) if c in types else ref(c) for c in df.columns])


def normalise_timestamps(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns made of timestamps only, rewritten in ISO form and kept as text."""
    return df.select(*[parse_timestamp(ref(c)).cast("string").alias(c) if types.get(c) == "timestamp_ntz" else ref(c)
                       for c in df.columns])


def finish(text: DataFrame, typed: bool, order_by: list[str], id_col: str | None, start: int = 1) -> DataFrame:
    """Common end of the CSV loaders: NULL words, types, and a serial id from `start` on in source order.

    The files are parsed once into a stored table, which the passes for types and ids read column by column.
    """
    body = [c for c in text.columns if c not in order_by]
    values = stored(text.select(*order_by, *[F.when(~ref(c).isin(*MISSING), ref(c)).alias(c) for c in body]))
    types = infer_types(values.select(*[ref(c) for c in body]))
    values = apply_types(values, types) if typed else normalise_timestamps(values, types)
    if id_col is None:
        return values.drop(*order_by)
    return assign_id(values, order_by, id_col, start).drop(*order_by)


def _source() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value")]


def _quotes() -> Column:
    return F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))


def quote_states(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, open, odd) per split of the files: whether it begins inside quotes, and how many of its lines have an odd number of
    quotes. The quotes of a split are counted without knowing how it begins; a running sum over a file's splits then says so."""
    counted = (spark.read.option("lineSep", "\n").text(path).select(*_source()).groupBy("_file", "_block")
               .agg(F.sum(_quotes()).alias("_quotes"), F.count_if(_quotes() % 2 == 1).alias("odd")))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("_file", "_block", (F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2 == 1).alias("open"), "odd")


class _Rows:
    """Lines of a task's splits, put together to rows. A row that a split's border cuts is given in pieces."""

    def __init__(self):
        self.place, self.parity, self.parts, self.begun, self.line, self.first, self.fresh = None, 0, [], True, 0, False, True

    def _give(self, out: list, closed: bool) -> None:
        if self.parts:
            piece = WHOLE if closed and self.begun else BEGIN if self.begun else REST
            out.append((*self.place, self.line, self.first, piece, "\n".join(self.parts)))
        self.parts, self.begun, self.first = [], True, False

    def _lines(self, lines: pa.RecordBatch, out: list) -> pa.RecordBatch:
        """The whole rows among lines of one split; pieces and what the last lines left open go to `out`."""
        values = lines.column("value")
        after = (self.parity + np.cumsum(pc.count_substring(values, '"').to_numpy())) % 2
        starts = np.flatnonzero(np.append(self.parity, after[:-1]) == 0)
        self.parity = int(after[-1])
        ends = np.append(starts[1:], len(values))
        head = int(starts[0]) if len(starts) else len(values)
        if head or (self.parts and len(starts)):
            self.parts += values.slice(0, head).to_pylist()
            if len(starts) or not self.parity:
                self._give(out, True)
        if self.parity and len(starts):
            last, starts, ends = int(starts[-1]), starts[:-1], ends[:-1]
            self.parts, self.line = values.slice(last).to_pylist(), lines.column("_line")[last].as_py()
            self.first = bool(lines.column("_block")[0].as_py() == 0 and not len(starts) and self.fresh)
        n = len(starts)
        offsets = pa.array(np.append(starts, ends[-1] if n else 0), pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, values), "\n")
        first = np.zeros(n, bool)
        if n and self.fresh and lines.column("_block")[0].as_py() == 0:
            first[0] = True
        self.fresh = self.fresh and not n and not self.parts
        at = pa.array(starts)
        return pa.RecordBatch.from_arrays([lines.column("_file").take(at), lines.column("_block").take(at), lines.column("_line").take(at),
                                           pa.array(first), pa.array(np.full(n, WHOLE), pa.int32()), joined], names=PIECES)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = []
            file = batch.column("_file").dictionary_encode().indices.to_numpy()
            block = batch.column("_block").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                place = (batch.column("_file")[a].as_py(), int(block[a]))
                if place != self.place:
                    self._give(out, False)
                    self.place, self.fresh = place, True
                    self.parity = int(batch.column("open")[a].as_py())
                    self.begun, self.line = not self.parity, batch.column("_line")[a].as_py()
                yield self._lines(batch.slice(a, b - a), out)
            yield _pieces(out)
        out = []
        self._give(out, False)
        yield _pieces(out)


PIECES = ["_file", "_block", "_line", "_first", "_piece", "value"]
WHOLE, BEGIN, REST = 0, 1, 2


def _pieces(rows: list) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
    columns = list(zip(*rows)) if rows else [[] for _ in PIECES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=PIECES)


def quoted_rows(spark: SparkSession, path: str, states: DataFrame) -> DataFrame:
    """(_file, _block, _line, _first, value): the rows of CSV files whose values may hold line ends, each as its text.

    A split's lines are put together by its own task, which knows from `states` whether they begin inside quotes. Only rows that
    cross a split's border are shuffled, in pieces: at most two a split. `_first` marks the first row of a file.
    """
    beginning = states.where("open").select("_file", "_block", "open")
    few = beginning.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    lines = spark.read.option("lineSep", "\n").text(path).select(*_source()).withColumn("_line", F.monotonically_increasing_id())
    known = lines.join(F.broadcast(beginning) if few else beginning, ["_file", "_block"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    if not few:
        known = known.repartition("_file", "_block").sortWithinPartitions("_file", "_block", "_line")

    def run(batches):
        return _Rows()(batches)

    pieces = stored(known.select("_file", "_block", "_line", "value", "open").mapInArrow(
        run, "_file string, _block long, _line long, _first boolean, _piece int, value string"))
    order = Window.partitionBy("_file").orderBy("_block", F.desc("_piece"))
    cut = pieces.where(F.col("_piece") != WHOLE).withColumn(
        "_row", F.sum((F.col("_piece") == BEGIN).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("_block", "_line", "value")))
    mended = cut.groupBy("_file", "_row").agg(F.min(F.struct("_block", "_line")).alias("_at"), F.bool_or("_first").alias("_first"),
                                              F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    columns = ["_file", "_block", "_line", "_first", "value"]
    whole = pieces.where(F.col("_piece") == WHOLE).select(*columns)
    return whole.unionByName(mended.select("_file", "_at._block", "_at._line", "_first", "value"))


def read_csv(spark: SparkSession, path: str, typed: bool = False, id_col: str | None = "id",
             multiline: bool | None = None, start: int = 1) -> DataFrame:
    """Header row, then values; a short row ends in NULLs, a row with more values than the header is an error.

    All text unless `typed`. Ids follow the order of the files' paths as text, then of their lines. A look at the quotes of all lines
    shows whether values hold line ends; rows are then put together within the splits of a file, so a large file stays many tasks'
    work. `multiline` False takes lines for rows without a look, True has each file parsed by one task, as files with other line
    ends than \\n need it.
    """
    states = stored(quote_states(spark, path)) if multiline is None else None
    joined = states is not None and not states.where("odd > 0").isEmpty()
    reader = (spark.read.option("header", True).option("multiLine", bool(multiline) or joined).option("escape", '"')
              .option("encoding", "UTF-8"))
    columns = reader.csv(path).columns
    names = [c.replace('"', "") for c in columns]
    places = [f"_c{i}" for i in range(len(columns))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*places, EXTRA]])
    if joined:
        value = F.regexp_replace(F.regexp_replace("value", "\r$", ""), "\r\n", "\n")
        rows = quoted_rows(spark, path, states).where(~F.col("_first") & (F.trim(value) != ""))
        raw = rows.select("_file", "_block", "_line", F.from_csv(value, schema.simpleString()[7:-1].replace(":", " "), {"escape": '"'}).alias("_row"))
        raw, line = raw.select("_file", "_block", "_line", "_row.*"), F.col("_line")
    else:
        raw = reader.schema(schema).csv(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        line = F.monotonically_increasing_id()
    too_long = F.raise_error(F.concat(F.lit("a row has more values than the header, the first one is: "), F.col(EXTRA)))
    text = raw.select("_file", "_block", F.when(F.col(EXTRA).isNull(), line).otherwise(too_long.cast("long")).alias("_line"),
                      *[F.col(c).alias(n) for c, n in zip(places, names)])
    return finish(text, typed, ORDER, id_col, start)


def append_csv(df: DataFrame, path: str, id_col: str = "id", multiline: bool | None = None) -> DataFrame:
    """Append a file to a table; its columns must be the table's, and ids go on after the largest one."""
    more = read_csv(df.sparkSession, path, False, id_col, multiline, max_id(df, id_col) + 1)
    missing = [c for c in df.columns if c not in more.columns and c != id_col]
    if missing:
        raise ValueError(f"the file lacks columns: {', '.join(missing)}")
    return df.unionByName(conform(more, df))


def write_csv(df: DataFrame, path: str, separator: str | None = ",", quote: str | None = '"',
              empty: str | None = "", id_col: str = "id") -> None:
    """All fields quoted, header first, the id left out; NULL and empty text become `empty`."""
    filled = df.select(*[F.coalesce(F.when(ref(c).cast("string") != "", ref(c).cast("string")), F.lit(empty or ""))
                         .alias(c) for c in df.columns if c != id_col])
    quote = quote or '"'
    (filled.write.option("header", True).option("quoteAll", True).option("sep", separator or ",")
     .option("quote", quote).option("escape", quote).option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
