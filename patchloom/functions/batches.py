"""Lines of all texts of an Arrow batch at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Lines(NamedTuple):
    """Lines of an array of texts: their texts, first bytes (0: an empty line), places of their texts and of these' first lines."""

    text: pa.Array
    lead: np.ndarray
    row: np.ndarray
    first: np.ndarray


def batch_lines(texts: pa.Array) -> Lines:
    """The lines of texts, one after the other; null texts have none."""
    lists = pc.split_pattern(texts.cast(pa.string()), "\n")
    text, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    begins = np.ones(len(row), bool)
    begins[1:] = row[1:] != row[:-1]
    raw = pc.binary_slice(text.cast(pa.binary()), 0, 1)
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int32)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    lead = np.zeros(len(raw), np.uint8)
    some = ends[1:] > ends[:-1]
    lead[some] = data[ends[:-1][some]]
    return Lines(text, lead, row, latest(begins))


def latest(marks: np.ndarray) -> np.ndarray:
    """For each place the last marked one up to it, -1 before the first."""
    return np.maximum.accumulate(np.where(marks, np.arange(len(marks)), -1)) if len(marks) else np.zeros(0, np.int64)


def next_marked(marks: np.ndarray) -> np.ndarray:
    """For each place the first marked one behind it, their number if there is none."""
    n = len(marks)
    own = np.minimum.accumulate(np.where(marks, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, np.int64)
    return np.append(own[1:], n) if n else own


def listed(values: pa.Array, row: np.ndarray, rows: int) -> pa.Array:
    """values as a list for each of so many rows, row being the place of each in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)
