"""Greedy packing of pieces into bodies, for all rows of an Arrow batch side by side.

Prefix sums of the token counts give each piece the place where a body that starts there ends, by one binary search each. Those
places are jump pointers: doubling them marks all starts of bodies in as many steps as the longest row has binary digits, so a
row of any number of pieces takes nearly linear time. Only numbers pass through Python; texts are cut afterwards by columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A body: its tokens, and its parts, each a run of pieces or (count > 0) the tokens [start, start + count) of one piece.
PARTS = T.StructType().add("n", T.IntegerType()).add("parts", T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("first", "last", "start", "count")])))


def body_starts(sizes: np.ndarray, offsets: np.ndarray, budgets: np.ndarray) -> np.ndarray:
    """Places in ``sizes`` where bodies start; rows lie between ``offsets``. A piece over its row's budget is alone."""
    total = len(sizes)
    if not total:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(budgets)), np.diff(offsets))
    budget, end = budgets[row], offsets[1:][row]
    sums = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(total)
    alone = sizes > budget
    coming = np.append(np.where(alone, place, total), total)
    next_alone = np.minimum.accumulate(coming[::-1])[::-1][1:]  # behind each piece
    reach = np.searchsorted(sums, sums[:-1] + budget, side="right") - 1
    jump = np.append(np.where(alone, place + 1, np.minimum(np.minimum(np.maximum(reach, place + 1), next_alone), end)), total)
    marked = np.zeros(total + 1, bool)
    marked[offsets[:-1][np.diff(offsets) > 0]] = True
    for _ in range(int(np.diff(offsets).max()).bit_length()):
        marked[jump[marked]] = True
        jump = jump[jump]
    return np.flatnonzero(marked[:total])


def bodies_of(sizes: pa.Array, budgets: pa.Array, least: int, cut: bool = True) -> pa.Array:
    """Bodies of each row's pieces. A piece over the budget is cut into windows of the budget, or stays whole without ``cut``; a last body under ``least`` tokens
    joins the one before it if both have at most budget + least."""
    budgets = budgets.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.nan_to_num(sizes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = sizes.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = body_starts(flat, offsets, budgets)
    ends = np.append(starts[1:], len(flat))  # a row's last body ends where the next row's first starts
    sums = np.concatenate([[0], np.cumsum(flat)])
    row = np.searchsorted(offsets, starts, side="right") - 1
    n, budget = sums[ends] - sums[starts], budgets[row]
    windows = np.where(cut & (flat[starts] > budget), -(-n // budget), 1) if len(starts) else n
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    row, first, last, whole, n, budget, start = (np.repeat(x, windows) for x in (row, starts - offsets[row], ends - 1 - offsets[row], windows == 1, n, budget, np.zeros(len(starts), np.int64)))
    start = np.where(whole, 0, at * budget)
    size = np.where(whole, n, np.minimum(budget, n - start))
    count = np.where(whole, 0, size)
    # The short tail of a row, and the body before it.
    tail = np.ones(len(row), bool)
    tail[:-1] = row[1:] != row[:-1]
    tail[:1] = False
    tail[1:] &= row[1:] == row[:-1]
    before = np.append(0, size[:-1]) if len(size) else size
    joins = tail & (size < least) & (before + size <= budget + least)
    heads = np.flatnonzero(~joins)
    body = np.append(heads, len(row))
    found = np.add.reduceat(size, heads) if len(heads) else size
    per_row = np.bincount(row[heads], minlength=len(budgets))
    int32 = lambda x: pa.array(x.astype(np.int32))
    parts = pa.StructArray.from_arrays([int32(x) for x in (first, last, start, count)], ["first", "last", "start", "count"])
    each = pa.StructArray.from_arrays([int32(found), pa.ListArray.from_arrays(int32(body), parts)], ["n", "parts"])
    return pa.ListArray.from_arrays(int32(np.concatenate([[0], np.cumsum(per_row)])), each)


def bodies(sizes: Column, budget: Column, least: int, cut: bool = True) -> Column:
    """Bodies (PARTS) of an array of token counts, by an Arrow function."""

    @F.arrow_udf(T.ArrayType(PARTS))
    def run(sizes: pa.Array, budgets: pa.Array) -> pa.Array:
        return bodies_of(sizes, budgets, least, cut)

    return run(sizes, budget.cast("int"))


def body_text(body: Column, pieces: Column, places: Column) -> Column:
    """The text of a body: its parts, each a run of pieces or a stretch of one piece, joined by line ends. ``places``: for each piece
    the (start, end) of its tokens, needed of pieces that are cut only."""

    def text(part: Column) -> Column:
        first = part["first"] + 1
        own = F.element_at(places, first)
        a, b = F.element_at(own, part["start"] + 1)["start"], F.element_at(own, part["start"] + part["count"])["end"]
        return F.when(part["count"] > 0, F.substring(F.element_at(pieces, first), a + 1, b - a)).otherwise(F.array_join(F.slice(pieces, first, part["last"] - part["first"] + 1), "\n"))

    return F.array_join(F.transform(body["parts"], text), "\n")
