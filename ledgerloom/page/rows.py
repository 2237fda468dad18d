"""Tokens to rows. A row's centre moves with every token that joins it, so tokens are taken one after the other.

A token table has doc_id, page_no, token_seq, text, x, y, w, h, page_w, page_h.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "doc_id long, page_no int, token_seq long, text string, x long, y long, w long, h long, page_w long, page_h long, row_no int, place int"


def rows_of_page(centre: np.ndarray, height: np.ndarray, reach: float = 1.5, least: float = 4.0) -> np.ndarray:
    """The row of each of a page's tokens, given in the order of their centres. A token within reach of the mean centre of the current row joins it."""
    gap = max(least, float(np.median(np.maximum(height, 1))) * reach)
    numbers, total, members, row = [], 0.0, 0, -1
    for c in centre.tolist():
        if members and abs(c - total / members) <= gap:
            total, members = total + c, members + 1
        else:
            total, members, row = c, 1, row + 1
        numbers.append(row)
    return np.array(numbers, dtype=np.int32)


def _numbered(pages: pa.Table) -> pa.RecordBatch:
    """Whole pages, in the order of pages and centres, with row_no and place, in the order of rows and places."""
    starts = np.flatnonzero(pages.column("__first").to_numpy())
    centre, height, x = (pages.column(c).to_numpy() for c in ("__centre", "h", "x"))
    page = np.zeros(pages.num_rows, dtype=np.int64)
    page[starts] = 1
    page = np.cumsum(page)
    row = np.concatenate([rows_of_page(centre[a:b], height[a:b]) for a, b in zip(starts, [*starts[1:], pages.num_rows], strict=True)])
    order = np.lexsort((pages.column("token_seq").to_numpy(), x, row, page))
    new = np.ones(pages.num_rows, dtype=bool)
    new[1:] = (page[order][1:] != page[order][:-1]) | (row[order][1:] != row[order][:-1])
    at = np.arange(pages.num_rows)
    place = at - np.maximum.accumulate(np.where(new, at, 0))
    done = pages.drop_columns(["__first", "__centre"]).take(pa.array(order))
    return done.append_column("row_no", pa.array(row[order], pa.int32())).append_column("place", pa.array(place, pa.int32()))


def token_rows(tokens: DataFrame) -> DataFrame:
    """All tokens with row_no and place. Pages are dealt whole and sorted by Spark; many are taken at a time."""
    from pyspark.sql import Window

    names = [c.split()[0] for c in ROWS.split(", ")][:-2]
    order = ["__centre", "x", "token_seq"]
    sorted_ = Window.partitionBy("doc_id", "page_no").orderBy(*order)
    t = tokens.select(*names, (F.col("y") + F.col("h") / 2.0).alias("__centre")).withColumn("__first", F.row_number().over(sorted_) == 1)

    def number(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(batch.schema.get_field_index("__first")).to_numpy(zero_copy_only=False))
            if len(starts) and (held or starts[-1] > 0):  # what comes before the last page is whole
                held.append(batch.slice(0, starts[-1]))
                yield from _numbered(pa.Table.from_batches(held).combine_chunks()).to_batches()
                held = []
                batch = batch.slice(starts[-1])
            held.append(batch)
        if held and sum(b.num_rows for b in held):
            yield from _numbered(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return t.mapInArrow(number, ROWS)


def row_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, page_no, row_no, text, box): each row's tokens joined by spaces, and its bounds."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda t: t["text"])
    return rows.groupBy("doc_id", "page_no", "row_no").agg(
        F.array_join(each, " ").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
        F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"),
    )
