"""Markdown blocks and structure-aware chunks as Spark jobs.

A line gets a letter for what it looks like; the letters of a document make a word, and one regular expression cuts that word into
blocks.  So the parse of a document is a few built-in string functions; lines, blocks and chunks are rows.  Rows of a document are kept
together by one shuffle; a document comes as one cell, so that is never more than the cell itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailsift.functions import text as tx

# Letters of lines; the small form is the same, indented by two blanks or a tab.  S is a table row that holds "---".
KINDS = {"B": "blank", "F": "fence", "H": "header", "T": "table", "S": "table", "I": "list", "P": "paragraph"}
# A fence runs to the next one or the end; a list takes further items and whatever is indented.
BLOCKS = "B|[Ff][^Ff]*[Ff]?|[Hh]|[TtSs]+|I[Ifhtsp]*|[Pp]+"
# The first row of a table keeps its separator; every other row stands alone.
ROWS = "^[TtSs][Ss]?|[TtSs]"
ITEM = r"^\s*(?:[-+*]|[0-9]+[).]) "
INDENT = r"^(?:\s\s|\t)"


def line_letter(line: Column) -> Column:
    bare = tx.strip(line)
    row = bare.startswith("|") & bare.endswith("|") & (F.length(bare) > 1)
    letter = (
        F.when(bare == "", "B").when(bare.startswith("```"), "F").when(bare.startswith("#"), "H")
        .when(row & line.contains("---"), "S").when(row, "T").when(line.rlike(ITEM), "I").otherwise("P")
    )
    return F.when(line.rlike(INDENT) & ~letter.isin("B", "I"), F.lower(letter)).otherwise(letter)


def block_words(letters: Column) -> Column:
    """The letters of each block."""
    runs = F.regexp_extract_all(letters, F.lit(BLOCKS), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[TtSs]"), F.regexp_extract_all(r, F.lit(ROWS), F.lit(0))).otherwise(F.array(r))))


def _rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """A row per document: its lines, their sizes with the line break (the last line has none), and the letters of each block."""
    rows = docs.select(doc, F.monotonically_increasing_id().alias("__row"), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("__lines"))
    last = F.size("__lines") - 1
    sizes = F.transform("__lines", lambda line, n: F.length(line) + F.when((n == last) & (line != ""), 0).otherwise(1))
    return rows.withColumn("__words", block_words(F.array_join(F.transform("__lines", line_letter), ""))).withColumn("__sizes", sizes)


def _lines(rows: DataFrame, doc: str, chunk: Column) -> DataFrame:
    """A row per line with its block, the block's first letter and number of lines, and its chunk (by the block's number).

    Documents are kept together by a row id of this one pass; no other pass looks for the same ids.
    """
    of_block = lambda w, i: F.struct(i.alias("block"), F.upper(F.substring(w, 1, 1)).alias("letter"), F.length(w).alias("of"), F.get(chunk, i).alias("chunk"))
    placed = F.flatten(F.transform("__words", lambda w, i: F.array_repeat(of_block(w, i), F.length(w))))
    zipped = F.posexplode(F.arrays_zip(F.col("__lines").alias("line"), F.col("__sizes").alias("size"), placed.alias("at"))).alias("n", "z")
    return rows.select(doc, "__row", zipped).repartition("__row").select(doc, "__row", "n", "z.line", "z.size", "z.at.*")


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["line"]), "\n")


def markdown_blocks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks that a chunk never splits, one row each; they tile the text.  An empty text is one blank block."""
    letters = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    grouped = _lines(_rows(docs, doc, text), doc, F.array().cast("array<int>")).groupBy("__row", "block").agg(
        F.first(doc).alias(doc), F.first(letters[F.col("letter")]).alias("kind"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("__lines"), F.sum("size").alias("__size")
    )
    end = F.sum("__size").over(Window.partitionBy("__row").orderBy("block"))
    return grouped.select(doc, F.col("block").cast("bigint").alias("block_index"), "kind", _joined(F.col("__lines")).alias("content"), (end - F.col("__size")).alias("start"), end.alias("end"))


def chunk_numbers(ends: np.ndarray, headers: np.ndarray, limit: int) -> np.ndarray:
    """The chunk of each block: filled up to ``limit`` characters, then cut before the last header if that leaves half a chunk."""
    starts = np.concatenate([[0], ends[:-1]])
    before = np.concatenate([[0], np.maximum.accumulate(np.where(headers, np.arange(len(ends)), 0))[:-1]])  # last header before a block
    cuts, first = [0], 0
    for k in np.arange(1, len(ends)):
        if ends[k] - starts[first] > limit:
            roomy = before[k] > first and 2 * (starts[before[k]] - starts[first]) >= limit
            first = before[k] if roomy else k
            cuts.append(first)
    return np.searchsorted(cuts, np.arange(len(ends)), "right") - 1


def chunk_markdown(
    docs: DataFrame, limit: int = 100_000, overlap_lines: int = 5, start_from: int = 0, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Chunks of whole blocks; a block beyond the limit stands alone.

    Each chunk carries the last lines of the one before, or the table's header rows when it goes on with a table.  ``start_from`` keeps
    the chunks from the one that reaches beyond that offset.
    """

    @F.pandas_udf("array<int>")
    def numbers(sizes: pd.Series, words: pd.Series) -> pd.Series:
        found = []
        for own, blocks in zip(sizes, words, strict=True):
            ends = np.cumsum(own)[np.cumsum([len(w) for w in blocks]) - 1]
            found.append(chunk_numbers(ends, np.array([w in "Hh" for w in blocks]), limit).tolist())
        return pd.Series(found)

    rows = _rows(docs, doc, text).withColumn("__chunks", numbers("__sizes", "__words"))
    # Two lines of a table in one block are its header and separator.
    heading = F.max(F.when(F.col("letter").isin("T", "S") & (F.col("of") == 2), F.col("block")))
    grouped = _lines(rows, doc, F.col("__chunks")).groupBy("__row", "chunk").agg(
        F.first(doc).alias(doc), F.array_sort(F.collect_list(F.struct("n", "line", "block"))).alias("__lines"), F.sum("size").alias("__size"),
        F.min_by("letter", "n").alias("__first"), heading.alias("__block"),
    )
    whole = F.sum("__size").over(Window.partitionBy("__row").orderBy("chunk"))
    table_head = F.filter("__lines", lambda x: x["block"] == F.col("__block"))
    chunks = grouped.withColumns({
        "content": _joined(F.col("__lines")), "start": whole - F.col("__size"), "end": whole, "__heading": F.when(F.col("__block").isNotNull(), _joined(table_head)),
    }).drop("__lines")
    order = Window.partitionBy("__row").orderBy("chunk")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.split(F.last("__heading", ignorenulls=True).over(earlier), "\n", -1)
    lines = F.split(F.lag("content").over(order), "\n", -1)
    tail = F.slice(lines, -F.least(F.size(lines), F.lit(overlap_lines)), F.lit(overlap_lines)) if overlap_lines > 0 else F.array().cast("array<string>")
    goes_on = F.col("__first").isin("T", "S") & F.col("__carried").isNotNull()
    overlap = F.when(goes_on, F.concat("__carried", F.array_except("__tail", "__carried"))).otherwise(F.col("__tail"))
    total = F.count("*").over(Window.partitionBy("__row"))
    empty = (F.col("content") == "") & (F.col("total_chunks") == 1) & (F.col("end") == 1)
    out = chunks.withColumns({"__carried": carried, "__tail": tail, "total_chunks": total}).select(
        doc, F.col("chunk").cast("bigint").alias("chunk_index"), "total_chunks", "content", "start",
        # An empty text is one chunk without extent.
        F.when(empty, 0).otherwise(F.col("end")).alias("end"),
        F.when(F.col("chunk") > 0, F.array_join(overlap, "\n")).otherwise("").alias("overlap"), (F.col("chunk") < F.col("total_chunks") - 1).alias("has_more"),
        F.max("end").over(Window.partitionBy("__row")).alias("__length"),
    )
    kept = out.where((F.col("end") > start_from) & (F.col("__length") > start_from)) if start_from > 0 else out
    return kept.drop("__length")
