"""Windows of letters in Arrow batches: packed numbers, rows of any length cut in one pass, and rows of windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The code of each byte; 4 for what is no nucleotide, which no window may hold.
CODES = np.full(256, 4, np.uint8)
CODES[list(b"ACGT")] = range(4)


def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range of n numbers, one after another."""
    return np.repeat(begin - (n.cumsum() - n), n) + np.arange(n.sum())


def packed_windows(codes: np.ndarray, k: int) -> np.ndarray:
    """For each start the number whose base-4 digits are the k codes from there, by doubling; starts near the end wrap to no use."""
    out, covered, power, size = np.zeros(len(codes), np.uint64), 0, codes.astype(np.uint64), 1
    while size <= k:
        if k & size:
            out |= np.roll(power, -covered) << np.uint64(2 * covered)
            covered += size
        power = power | np.roll(power, -size) << np.uint64(2 * size) if 2 * size <= k else power
        size *= 2
    return out


def ordered_windows(codes: np.ndarray, k: int) -> np.ndarray:
    """As packed_windows(), with the first code in the highest digits, so that numbers are in the order of their texts; one for each window."""
    return packed_windows(codes[::-1], k)[: max(0, len(codes) - k + 1)][::-1]


def texts(numbers: np.ndarray, k: int) -> pa.Array:
    """The texts of ordered_windows()."""
    digits = numbers[:, None] >> np.arange(2 * (k - 1), -1, -2, dtype=np.uint64) & np.uint64(3)
    data = np.frombuffer(b"ACGT", np.uint8)[digits.astype(np.uint8)].tobytes()
    return pa.Array.from_buffers(pa.string(), len(numbers), [None, pa.py_buffer((np.arange(len(numbers) + 1) * k).astype(np.int32)), pa.py_buffer(data)])


#: Letters that a task works on at a time; a longer row is cut.
AT_ONCE = 1 << 18


def in_slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some `size` bytes of a column, or of one longer row: the engine bounds batches by rows alone."""
    for batch in batches:
        ends, at = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], np.int64).cumsum(), 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def cut_rows(batches: Iterator[pa.RecordBatch], k: int, size: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """file, seq_no, base, body: the same windows in batches of some `size` letters; rows that are longer are cut, with an overlap; those without windows go."""
    for batch in batches:
        batch = batch.filter(pc.greater_equal(pc.binary_length(batch.column("body")), k))
        sizes = np.array([len(x.as_buffer()) for x in batch.column("body")], np.int64)
        ends, at = sizes.cumsum(), 0
        while at < len(batch):
            if sizes[at] > size:
                row, data = batch.slice(at, 1), batch.column("body")[at].as_buffer()
                step = size - (k - 1)
                for begin in range(0, int(sizes[at]) - (k - 1), step):
                    body = pa.array([data[begin : begin + size].to_pybytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([row.column("file"), row.column("seq_no"), pa.array([row.column("base")[0].as_py() + begin], pa.int64()), body], ["file", "seq_no", "base", "body"])
                at += 1
                continue
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, stop - at).select(["file", "seq_no", "base", "body"])
            at = stop


def window_rows(batch: pa.RecordBatch, n: np.ndarray, values: dict[str, np.ndarray]) -> pa.RecordBatch:
    """file, seq_no, offset and values of n windows for each row of a batch of stretched()."""
    row = pa.array(np.repeat(np.arange(len(n)), n))
    inside = np.arange(n.sum()) - np.repeat(np.r_[0, n.cumsum()[:-1]], n)
    offset = np.repeat(batch.column("base").to_numpy(), n) + inside
    columns = [batch.column("file").take(row), batch.column("seq_no").take(row), pa.array(offset), *map(pa.array, values.values())]
    return pa.RecordBatch.from_arrays(columns, ["file", "seq_no", "offset", *values])


def row_totals(batch: pa.RecordBatch, n: np.ndarray, values: dict[str, np.ndarray]) -> pa.RecordBatch:
    """file, seq_no, kmers, hits, and sum and greatest of each of the values, of the n windows of each row of a batch: what totals() adds up.

    A hit is a window whose first value is not below 0. Each row has a window at least.
    """
    first, hit = n.cumsum() - n, next(iter(values.values())) >= 0
    out = {"kmers": n, "hits": np.add.reduceat(hit, first, dtype=np.int64)}
    for name, v in values.items():
        out |= {f"sum_{name}": np.add.reduceat(v, first, dtype=np.int64), f"max_{name}": np.maximum.reduceat(v, first)}
    return pa.RecordBatch.from_arrays([batch.column("file"), batch.column("seq_no"), *map(pa.array, out.values())], ["file", "seq_no", *out])


def row_totals_by(batch: pa.RecordBatch, n: np.ndarray, values: dict[str, np.ndarray], by: str) -> pa.RecordBatch:
    """file, seq_no, by, kmers and sums of the other values, of the windows of each row of a batch that have one value of `by`; -1 is one of them."""
    row, hit = np.repeat(np.arange(len(n)), n), values[by] >= 0
    order = np.r_[np.flatnonzero(~hit), (at := np.flatnonzero(hit))[np.lexsort((values[by][at], row[at]))]]
    row, value = row[order], values[by][order]
    change = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])])
    take = pa.array(row[change])
    sums = {f"sum_{name}": np.add.reduceat(v[order], change) for name, v in values.items() if name != by}
    columns = [batch.column("file").take(take), batch.column("seq_no").take(take), *map(pa.array, (value[change], np.diff(np.r_[change, len(row)]), *sums.values()))]
    return pa.RecordBatch.from_arrays(columns, ["file", "seq_no", by, "kmers", *sums])
