"""Records of CSV files whose quoted fields hold line breaks, read by many tasks.

A line break ends a record only outside quotes, so what a task sees depends on all quotes before its byte range.
One scan counts the quotes of every range, a running sum over the ranges of a file gives the state in which each begins,
and a second scan cuts the records: a record begins at every line whose start lies outside quotes. A task passes on
the records that begin and end in its range, and the pieces at its borders, at most two a range, which are put
together afterwards. Spark's own CSV parser then takes every record apart.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceloom.operators.joins import join_materialised, materialise_small

_RANGE = ["path", "start"]
RECORDS = "range long, part int, first boolean, record string"
#: What a row of the second scan is: a record, the begin of one that may go on, or what goes on.
WHOLE, TAIL, HEAD = 0, 1, 2
_SCHEMA = pa.schema([("range", pa.int64()), ("part", pa.int32()), ("first", pa.bool_()), ("record", pa.string())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files with the byte range that they were read in, in file order inside a range."""
    # A line keeps its carriage return: inside quotes it is text.
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _quotes(value):
    # Bytes, as characters would have to be counted.
    return F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"')))


def _blank(data: bytes) -> bool:
    """Lines outside quotes that are no records."""
    return data in (b"\n", b"\r\n")


class _Cutter:
    """Cuts the lines of one byte range into records and pieces at its borders; ``border`` asks for those pieces alone.

    Lines stand one after the other in a buffer, with their line ends, so that a record is a slice of it.
    """

    def __init__(self, number: int, inside: bool, top: bool, border: bool):
        self.number, self.inside, self.first, self.border = number, inside, top, border
        self.held, self.begun = [], False

    def _batch(self, part: int, records: pa.Array) -> list[pa.RecordBatch]:
        n = len(records)
        if not n:
            return []
        first = np.zeros(n, bool)
        if part != HEAD:
            first[0], self.first = self.first, False
        if self.border and part == WHOLE:
            return []
        columns = [pa.repeat(pa.scalar(self.number, pa.int64()), n), pa.repeat(pa.scalar(part, pa.int32()), n), pa.array(first), records]
        return [pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)]

    def ended(self, part: int) -> list[pa.RecordBatch]:
        """What is held ends here."""
        held, self.held = b"".join(self.held), []
        return self._batch(part if self.begun else HEAD, pa.array([held[:-1]] if held else [], pa.binary()).cast(pa.string()))

    def take(self, lines: pa.StringArray, odd: np.ndarray) -> list[pa.RecordBatch]:
        """Go on with some lines; ``odd`` marks those with an odd number of quotes. Records begin outside quotes."""
        ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset:lines.offset + len(lines) + 1]
        data = lines.buffers()[2]
        quotes = np.cumsum(odd) + self.inside
        begins = np.flatnonzero(np.r_[self.inside, quotes[:-1]] % 2 == 0)
        self.inside = bool(quotes[-1] % 2)
        cuts = ends[begins]
        if not len(cuts):
            self.held.append(data[ends[0]:ends[-1]].to_pybytes())
            return []
        self.held.append(data[ends[0]:cuts[0]].to_pybytes())
        out = self.ended(WHOLE)
        self.begun = True
        if len(cuts) > 1 and (self.first or not self.border):
            records = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data)
            records = records.filter(pc.invert(pc.is_in(records, pa.array(["\n", "\r\n"]))))
            # The last line of a record is not empty, so one line end is taken off.
            out += self._batch(WHOLE, pc.ascii_rtrim(records, characters="\n"))
        last = data[cuts[-1]:ends[-1]].to_pybytes()
        self.held = [] if _blank(last) else [last]
        return out


def _cut(border: bool):
    """Records of each range, from lines ``(range, odd, top, value)`` in order, or the pieces at its borders alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = batch.column("value").cast(pa.string())
            odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) % 2
            numbers = batch.column("range").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for first, last in zip(edges, edges[1:]):
                if cutter is None or numbers[first] != cutter.number:
                    yield from cutter.ended(TAIL) if cutter else ()
                    cutter = _Cutter(int(numbers[first]), batch.column("odd")[first].as_py(), batch.column("top")[first].as_py(), border)
                yield from cutter.take(lines.slice(first, last - first), odd[first:last])
        yield from cutter.ended(TAIL) if cutter else ()

    return rows


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(path, first, record)``: the text of every record, without its line end, of all files under ``path``.

    ``first`` marks the first record of a file. Quotes are ASCII double quotes, doubled inside a quoted
    field; a file must be well formed in that an unquoted field holds no quote. Lines end with LF or CRLF.
    Empty lines outside quotes are no records. Only a table of one row per byte range is kept between the two
    scans; it is broadcast if it is proven small, else the lines are shuffled by range and put in order again.
    """
    lines = _lines(spark, path)
    ranges = lines.groupBy(*_RANGE).agg(F.sum(_quotes(F.col("value"))).alias("quotes"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    states = ranges.select(*_RANGE, (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("odd"))
    # A line is sent to Python with the number of its range, which is shorter than the path.
    states = states.select("*", F.monotonically_increasing_id().alias("range"), (F.col("start") == 0).alias("top"))
    states, small = materialise_small(states)
    if small:
        ordered = lines.join(F.broadcast(states), _RANGE)
    else:
        numbered = lines.withColumn("line", F.monotonically_increasing_id())
        ordered = (numbered.join(states, _RANGE).repartition(*_RANGE).sortWithinPartitions(*_RANGE, "line").drop("line"))
    sent = ordered.select("range", "odd", "top", F.concat("value", F.lit("\n")).alias("value"))

    def pieces(border: bool) -> DataFrame:
        found = sent.mapInArrow(_cut(border), RECORDS)
        kept = found.where(F.col("part") != WHOLE if border else F.col("part") == WHOLE)
        return join_materialised(kept, states.select("range", *_RANGE), small, ["range"], ["record"])

    # What a range leaves open goes on in the heads of the ranges after it, up to the next tail.
    border = pieces(border=True).withColumn("step", F.when(F.col("part") == HEAD, 0).otherwise(1))
    chain = F.sum("step").over(Window.partitionBy("path").orderBy("start", "step"))
    parts = F.sort_array(F.collect_list(F.struct("start", "step", "record")))
    joined = (border.withColumn("chain", chain).groupBy("path", "chain")
              .agg(F.max("first").alias("first"), parts.alias("parts"))
              .select("path", "first", F.concat_ws("\n", F.transform("parts", lambda p: p["record"])).alias("record")))
    whole = pieces(border=False).select("path", "first", "record")
    records = whole.unionByName(joined)
    start = F.when(F.col("first"), F.regexp_replace("record", "^\ufeff", "")).otherwise(F.col("record"))
    # Few records end with a carriage return, so most are spared the pattern.
    bare = F.when(F.endswith(start, F.lit("\r")), F.regexp_replace(start, "\r$", "")).otherwise(start)
    return records.select("path", "first", bare.alias("record"))


def read_csv_ranges(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files with a header, as strings; every file must have the same header."""
    options = {"escape": '"', "header": "true"}
    names = spark.read.options(**options).option("multiLine", True).csv(path).columns
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    fields = F.from_csv("record", F.lit(schema), {"escape": '"', "multiLine": "true"})
    records = csv_records(spark, path).withColumn("fields", fields)
    values = [F.col(f"fields.c{i}") for i in range(len(names))]
    header = F.array(*values) == F.array(*[F.lit(n) for n in names])
    wrong = F.raise_error(F.concat(F.lit("header differs from that of the first file: "), "path"))
    data = records.where(F.when(F.col("first"), F.when(F.coalesce(header, F.lit(False)), False).otherwise(wrong.cast("boolean")))
                         .otherwise(True))
    return data.select(*[v.alias(n) for v, n in zip(values, names)])
