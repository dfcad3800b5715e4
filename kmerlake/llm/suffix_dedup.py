"""Removal of byte strings that start anywhere else, by a distributed difference-cover algorithm.

Two equal strings of `length` bytes have, at one distance below the period v from both starts, a sampled suffix each:
suffixes are sampled at the places whose remainder modulo v is in the cover, and every remainder is a difference of two of
its members. The steps are

1. Screening. Of every window of length - gram + 1 grams the least gram (by hash, leftmost of equals) is its mark. Equal
   strings have their marks at the same distance, so a string whose mark's gram is nowhere else a mark cannot start twice.
   Screening only drops such strings. What is left is cut into pieces, runs of starts that are still open; each is a text
   of its own with places from 0. Texts that are equal as a whole are one text.
2. Sampled triples. Each sampled suffix of a piece gets the names of the three blocks of bytes that begin it, and each
   triple of names is named in turn. Triples are sorted by name and compared with their neighbours; those that repeat go on.
3. Recursion on the names. The names of a piece's sampled suffixes v, 2v, ... bytes apart are the letters of a shorter
   text. Where three in a row repeat, their triple is named, sorted and compared again. It has length + v - 1 bytes or more,
   so that of an equal pair of these all strings from the first v starts on are repeated; the next sampled suffix of the
   same alignment goes on from there. Deeper levels would settle no other start.
4. Remaining suffixes. Starts within reach of a repeated triple that step 3 leaves open, those near the ends of repeated
   stretches, are merged by the name of their first `length` bytes with all starts that have the same mark, settled or not:
   sorted, and compared with their neighbours.

A name is a hash; its numeric order is the order of sorting. Names that decide (steps 3 and 4) have 128 bits from two sets
of letters; those of step 2 have 64, which keep too much if two collide. Rows of the steps are packed: a task sends one row
of bytes for each range of names. Of equal names that a task meets itself it sends one, so that a string which a third of
all documents share costs each task one name. The ranges' number follows the number of starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_in_parts, release, stored

LENGTH = 400
#: Perfect difference sets by period; every remainder is a difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 91: (0, 1, 3, 9, 27, 81, 61, 49, 56, 77)}
#: Least length that strings may have.
LEAST = 6 * min(COVERS)
#: Suffixes that one task of steps 2 to 4 sorts, about.
RANGE = 500_000
#: Suffixes that a task settles at a time.
LOT = 250_000
#: Bytes whose hashes are computed together, so that they stay in a core's cache.
SLICE = 1 << 18

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
RECORD = np.dtype([("name", "<u8"), ("check", "<u8"), ("sid", "<i8"), ("at", "<i4")])
PLACE = np.dtype([("sid", "<i8"), ("at", "<i4")])


def letters(seed: int) -> np.ndarray:
    """A number for each byte, by the splitmix64 rule."""
    z = (np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * seed)) * _A
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


LETTERS = [letters(0), letters(1)]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (b >> np.uint64(29)) ^ b
    x *= _B
    x += a * _A
    x ^= x >> np.uint64(32)
    return x


def names(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A name for each string of `length` bytes in data, by doubling; one for each start from which data is long enough."""
    out, covered = None, 0
    power, size = LETTERS[seed][data], 1
    parts = []
    while size <= length:
        if length & size:
            parts.append((size, power))
        size *= 2
        if size <= length:
            power = mix(power[: len(power) - size // 2], power[size // 2 :])
    for size, power in reversed(parts):
        if out is None:
            out = power
        else:
            n = min(len(out), len(power) - covered)
            out = mix(out[:n], power[covered : covered + n])
        covered += size
    return out[: max(0, len(data) - length + 1)]


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value, leftmost of equals, of each window of width values."""
    n = len(values)
    key = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def marks_of(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(names, first starts, last starts): the marks of text, and the starts of strings whose mark each is."""
    found, at = [], 0
    n = len(text) - length + 1
    while at < n:
        name = names(text[at : at + SLICE + length], gram)
        place = leftmost_minima(name, length - gram + 1)[: min(SLICE, n - at)]
        change = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        found.append((name[place[change]], at + change, at + np.r_[change[1:], len(place)] - 1))
        at += SLICE
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def marks(rows: DataFrame, length: int, gram: int, letters_of=None) -> DataFrame:
    """name, k1, k2, low, high, known of the marks of every text; texts of a batch that are equal are read once.

    known: the name is another mark's in the same batch too, so that nobody else need be asked. Marks of one name whose starts
    follow one another are one row, so that a text of one word many times over gives no row for each word.

    Short texts of a batch are hashed side by side in slices, which costs little per text. letters_of: a function of a text's
    bytes, whose result is searched in place of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, out, group, size = set(), [], [], 0
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            for key, body in zip(zip(k1, k2, strict=True), batch.column("body"), strict=True):
                if key in seen:
                    continue
                data = letters_of(bytes(body.as_buffer())) if letters_of else body.as_buffer()
                seen.add(key)
                if len(data) < length:
                    continue
                group.append((key, np.frombuffer(data, np.uint8)))
                size += len(data)
                if size >= SLICE:
                    out += side_by_side(group, length, gram)
                    group, size = [], 0
            out += side_by_side(group, length, gram)
            if out:
                name, a, b, low, high = (np.concatenate(x) for x in zip(*out, strict=True))
                _, where, n = np.unique(name, return_inverse=True, return_counts=True)
                begin = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (low[1:] != high[:-1] + 1)])
                name, a, b, low, high, known = name[begin], a[begin], b[begin], low[begin], high[np.r_[begin[1:], len(high)] - 1], n[where][begin] > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(a), pa.array(b), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(known)],
                    ["name", "k1", "k2", "low", "high", "known"],
                )

    return rows.select("k1", "k2", "body").mapInArrow(run, "name bigint, k1 bigint, k2 bigint, low int, high int, known boolean")


def side_by_side(group: list, length: int, gram: int) -> list[tuple]:
    out = []
    small = [x for x in group if len(x[1]) <= SLICE]
    for key, text in (x for x in group if len(x[1]) > SLICE):
        name, low, high = marks_of(text, length, gram)
        out.append((name, np.full(len(name), key[0]), np.full(len(name), key[1]), low, high))
    if not small:
        return out
    sizes = np.array([len(x[1]) for x in small])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    name = names(np.concatenate([x[1] for x in small]), gram)
    place = leftmost_minima(name, length - gram + 1)
    starts = np.arange(len(place))
    owner = np.searchsorted(ends, starts, "right")
    valid = starts + length <= ends[owner]
    starts, owner, place = starts[valid], owner[valid], place[valid]
    change = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[change[1:], len(starts)] - 1
    who = owner[change]
    keys = np.array([x[0] for x in small], np.int64)
    out.append((name[place[change]], keys[who, 0], keys[who, 1], starts[change] - begins[who], starts[last] - begins[who]))
    return out


def groups(keys: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal keys."""
    if not len(keys):
        return []
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist()
    return list(zip(begin, [*begin[1:], len(keys)], strict=True))


def joined(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in order, those that overlap or touch as one."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order]) if len(high) else high
    new = np.r_[True, low[1:] > high[:-1] + 1] if len(low) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return low[begin], high[np.r_[begin[1:], len(low)] - 1] if len(low) else high


def split(values: np.ndarray, count: int) -> np.ndarray:
    """The range, of count, of each 64-bit value."""
    return ((values >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def columns_of(rows: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(range, bytes) of rows by the range they go to: column by column, and rows in their order, which compresses well."""
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    for a, b in groups(to):
        yield int(to[a]), b"".join(np.ascontiguousarray(rows[f][a:b]).tobytes() for f in rows.dtype.names)


def rows_from(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """The rows of columns_of()."""
    out = []
    for x in column:
        data, at = x.as_buffer(), 0
        rows = np.zeros(len(data) // kind.itemsize, kind)
        for f in kind.names:
            rows[f] = np.frombuffer(data, kind[f], len(rows), at)
            at += kind[f].itemsize * len(rows)
        out.append(rows)
    return np.concatenate(out)


def home(places: np.ndarray, ranges: int) -> np.ndarray:
    return split(places["sid"].astype(np.uint64) * _A, ranges)


def adjacent(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which records have an equal neighbour once they are sorted, and which are the first of their name."""
    order = np.argsort(records["name"], kind="stable")
    name, check = records["name"][order], records["check"][order]
    same = name[1:] == name[:-1]
    if (same & (check[1:] != check[:-1])).any():
        order = np.lexsort((records["check"], records["name"]))
        name, check = records["name"][order], records["check"][order]
        same = (name[1:] == name[:-1]) & (check[1:] == check[:-1])
    twin, first = np.zeros(len(records), bool), np.zeros(len(records), bool)
    twin[order], first[order] = np.r_[False, same] | np.r_[same, False], np.r_[True, ~same]
    return twin, first


def repeated(rows: DataFrame, make, ranges: int) -> DataFrame:
    """sid, ats: for each piece the sorted places, packed as 32-bit numbers, whose records have an equal neighbour anywhere.

    Records are made by make(row batch). A task settles its records in lots of about LOT: equal ones at once, and one of
    them is sent on for all.
    """

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for batch in batches:
            for part in make(batch):
                held.append(part)
                size += len(part)
                if size >= LOT:
                    yield np.concatenate(held)
                    held, size = [], 0
        if size:
            yield np.concatenate(held)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in lots(batches):
            twin, first = adjacent(lot)
            known, sent = places_of(lot[twin]), lot[first]
            out = [(0, r, b) for r, b in columns_of(known, home(known, ranges))] + [(1, r, b) for r, b in columns_of(sent, split(sent["name"], ranges))]
            kinds = (pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["kind", "range", "body"])

    def meet(table: pa.Table) -> pa.Table:
        if not table.column("kind")[0].as_py():
            return pa.table({"home": table.column("range"), "places": table.column("body")})
        records = rows_from(table.column("body"), RECORD)
        found = places_of(records[adjacent(records)[0]])
        out = list(columns_of(found, home(found, ranges)))
        return pa.table({"home": pa.array([x[0] for x in out], pa.int64()), "places": pa.array([x[1] for x in out], pa.binary())})

    def by_piece(table: pa.Table) -> pa.Table:
        places = rows_from(table.column("places"), PLACE)
        places = places[np.lexsort((places["at"], places["sid"]))]
        begin = np.flatnonzero(np.r_[True, places["sid"][1:] != places["sid"][:-1]])
        ats = [np.unique(x).tobytes() for x in np.split(places["at"], begin[1:])]
        return pa.table({"sid": pa.array(places["sid"][begin], pa.int64()), "ats": pa.array(ats, pa.binary())})

    sent = rows.mapInArrow(send, "kind int, range bigint, body binary")
    return sent.groupBy("kind", "range").applyInArrow(meet, "home bigint, places binary").groupBy("home").applyInArrow(by_piece, "sid bigint, ats binary")


def places_of(records: np.ndarray) -> np.ndarray:
    out = np.zeros(len(records), PLACE)
    out["sid"], out["at"] = records["sid"], records["at"]
    return out


def records_of(sid: np.ndarray, at: np.ndarray, name: np.ndarray, check: np.ndarray | int = 0) -> np.ndarray:
    out = np.zeros(len(at), RECORD)
    out["name"], out["check"], out["sid"], out["at"] = name, check, sid, at
    return out


class Slice:
    """Pieces side by side: text, and for each byte its piece (own), its place in it (at) and the bytes from it on (left)."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch, self.sid = batch, batch.column("sid").to_numpy()
        bodies = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("body")]
        self.text, size = np.concatenate(bodies), np.array([len(x) for x in bodies])
        self.begin = size.cumsum() - size
        self.own = np.repeat(np.arange(len(size)), size)
        self.at = np.arange(len(self.text)) - self.begin[self.own]
        self.left = size[self.own] - self.at

    def places(self, column: str) -> np.ndarray:
        """The places, in text, that a column of packed places names."""
        found = [np.frombuffer(x.as_buffer(), np.int32) if x.is_valid else np.zeros(0, np.int32) for x in self.batch.column(column)]
        return np.concatenate(found).astype(np.int64) + np.repeat(self.begin, [len(x) for x in found])

    def inside(self, column: str) -> np.ndarray:
        """Which places of text lie in the ranges of a column."""
        found = [bounds(x) for x in self.batch.column(column)]
        shift = np.repeat(self.begin, [len(low) for low, _ in found])
        low, high = (np.concatenate([f[i] for f in found]) + shift for i in (0, 1))
        return covered(len(self.text), low, high + 1)

    def records(self, at: np.ndarray, *names: np.ndarray) -> np.ndarray:
        return records_of(self.sid[self.own[at]], self.at[at], *names)


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie between a begin and its end."""
    change = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return change[:n].cumsum() > 0


def slices(batch: pa.RecordBatch) -> Iterator[Slice]:
    """Pieces of a batch in slices of some SLICE bytes, or of one longer piece."""
    ends = np.cumsum([len(x.as_buffer()) for x in batch.column("body")])
    for a, b in groups(ends // SLICE) if len(ends) else []:
        yield Slice(batch.slice(a, b - a))


class Cover:
    """Sampling for strings of length bytes: period v, triples of blocks of `block` bytes, `depth` bytes in all."""

    def __init__(self, length: int):
        if length < LEAST:
            raise ValueError(f"length must be at least {LEAST}")
        self.length = length
        self.period = max(v for v in COVERS if 6 * v <= length)
        self.sampled = np.isin(np.arange(self.period), COVERS[self.period])
        self.block = (length - self.period + 1) // 3
        self.depth = 3 * self.block
        #: Starts that a repeated triple of names settles: it has depth + 2 * period bytes.
        self.settles = self.depth + 2 * self.period - length + 1

    def triples(self, text: np.ndarray, at: np.ndarray, seed: int = 0) -> np.ndarray:
        name = names(text, self.block, seed)
        return mix(mix(name[at], name[at + self.block]), name[at + 2 * self.block])

    def sampled_triples(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for s in slices(batch):
            at = np.flatnonzero(self.sampled[s.at % self.period] & (s.left >= self.depth))
            if len(at):
                yield s.records(at, self.triples(s.text, at))

    def triples_of_names(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for s in slices(batch):
            at = s.places("ats")
            found = np.zeros(len(s.text) + 2 * self.period, bool)
            found[at] = True
            first = at[found[at + self.period] & found[at + 2 * self.period] & (s.left[at] >= self.depth + 2 * self.period)]
            if len(first):
                name = []
                for seed in (0, 1):
                    letter = np.zeros(len(found), np.uint64)
                    letter[at] = self.triples(s.text, at, seed)
                    name.append(mix(mix(letter[first], letter[first + self.period]), letter[first + 2 * self.period]))
                yield s.records(first, *name)

    def within_reach(self, s: Slice) -> np.ndarray:
        """Which places of a slice are starts with a repeated triple within reach."""
        at = s.places("ats")
        return covered(len(s.text), np.maximum(at - self.period + 1, 0), at + 1) & (s.left >= self.length)

    def marks(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """(names, sids, first starts, last starts, has an open start) of the marks of starts within reach of a repeated triple; as in marks(), those of one name in a row are one."""
        gram = gram_of(self.length)
        for s in slices(batch):
            deep = s.places("deep")
            reach = self.within_reach(s)
            still = reach & ~covered(len(s.text), deep, deep + self.settles)
            starts = np.flatnonzero(reach)
            if not len(starts):
                continue
            name = names(s.text, gram)
            name = name[leftmost_minima(name, self.length - gram + 1)[starts]]
            change = np.r_[True, (name[1:] != name[:-1]) | (np.diff(starts) > 1) | (np.diff(s.own[starts]) > 0)]
            begin = np.flatnonzero(change)
            end = np.r_[begin[1:], len(starts)] - 1
            some = np.add.reduceat(still[starts].astype(np.int64), begin) > 0
            yield name[begin], s.sid[s.own[starts[begin]]], s.at[starts[begin]], s.at[starts[end]], some

    def remaining_suffixes(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for s in slices(batch):
            own = np.flatnonzero(self.within_reach(s) & s.inside("watched"))
            if len(own):
                yield s.records(own, *(names(s.text, self.length, seed)[own] for seed in (0, 1)))


def gram_of(length: int) -> int:
    return length * 8 // 25


def pieces(texts: DataFrame, length: int, letters_of=None, keep: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Columns keep (longs), base, body of each run of open starts (body, open) of texts; runs of over SLICE starts in several pieces.

    letters_of: as in marks(); open refers to its results, of which pieces are cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, (body, ranges) in enumerate(zip(batch.column("body"), batch.column("open"), strict=True)):
                data = memoryview(letters_of(bytes(body.as_buffer())) if letters_of else body.as_buffer())
                for a, b in zip(*joined(*bounds(ranges)), strict=True):
                    own = [(at, bytes(data[at : min(at + SLICE - 1, b) + length])) for at in range(int(a), int(b) + 1, SLICE)]
                    out += own
                    row += [i] * len(own)
            columns, at = list(zip(*out, strict=True)) if out else [()] * 2, pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], [*keep, "base", "body"])

    return texts.select(*keep, "body", "open").mapInArrow(run, ", ".join([*(f"{c} bigint" for c in keep), "base int", "body binary"]))


def bounds(ranges) -> tuple[np.ndarray, np.ndarray]:
    """Lows and highs of a list of ranges; null: none."""
    if not ranges.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(ranges.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))


def repeated_starts(found_pieces: DataFrame, length: int) -> DataFrame:
    """doc, starts: of each doc of pieces() (doc, base, body) the ranges of starts whose strings start anywhere else among open starts."""
    cover = Cover(length)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if out := list(cover.marks(batch)):
                name, sid, low, high, still = (np.concatenate(x) for x in zip(*out, strict=True))
                columns = pa.array(name.view(np.int64)), pa.array(sid), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(still)
                yield pa.RecordBatch.from_arrays(list(columns), ["name", "sid", "low", "high", "still"])

    own = stored(found_pieces.select(F.monotonically_increasing_id().alias("sid"), "doc", "base", "body"), "pieces")
    total = own.agg(F.sum(F.length("body").cast("bigint"))).first()[0] or 0
    ranges = max(4, -(-total // (4 * RANGE)))
    triples = repeated(own.select("sid", "body"), cover.sampled_triples, ranges)
    going = stored(own.select("sid", "body").join(triples, "sid"), "triples")
    deep = stored(repeated(going, cover.triples_of_names, ranges).withColumnRenamed("ats", "deep"), "names")
    found_marks = stored(going.join(deep, "sid", "left").mapInArrow(listed, "name bigint, sid bigint, low int, high int, still boolean"), "piece-marks")
    still = stored(found_marks.groupBy("name").agg(F.max("still").alias("still"), F.count("*").alias("n")).where("still").select("name", "n"), "open-names")
    watched = join_in_parts(found_marks, still, ["name"]).groupBy("sid").agg(F.collect_list(F.struct("low", "high")).alias("watched"))
    merged = stored(repeated(going.join(watched, "sid"), cover.remaining_suffixes, ranges), "merged")  # so that no task has two Python workers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("ats")]
            size = [len(x) for x in at]
            row = np.repeat(np.arange(len(at)), size) << 32
            low = np.concatenate([np.zeros(0, np.int64), *at]) + row
            low, high = joined(low, low + np.repeat(batch.column("settles").to_numpy(), size) - 1)
            columns = pa.array((low & 0xFFFFFFFF).astype(np.int32)), pa.array((high & 0xFFFFFFFF).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("sid").take(pa.array(low >> 32)), *columns], ["sid", "low", "high"])

    settled = deep.select("sid", F.col("deep").alias("ats"), F.lit(cover.settles).cast("bigint").alias("settles"))
    both = settled.union(merged.select("sid", "ats", F.lit(1).cast("bigint"))).mapInArrow(run, "sid bigint, low int, high int")
    place = F.struct((F.col("base") + F.col("low")).alias("low"), (F.col("base") + F.col("high")).alias("high"))
    found = stored(both.join(own.select("sid", "doc", "base"), "sid").groupBy("doc").agg(F.collect_list(place).alias("starts")), "starts")
    for old in (own, going, deep, found_marks, still, merged):
        release(old)
    return found


def cut(texts: DataFrame, length: int) -> DataFrame:
    """k1, k2, n_removed, n_spans, kept_sha256, kept of texts (k1, k2, body, starts).

    starts: ranges of starts of strings of `length` bytes that go; kept: what is left, without parts of characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests, kept = [], [], [], []
            for body, ranges in zip(batch.column("body"), batch.column("starts"), strict=True):
                text = memoryview(body.as_buffer())
                parts, done, gone, n = [], 0, 0, 0
                for begin, end in stretches(ranges, length):
                    parts.append(text[done:begin])
                    done, gone, n = end, gone + end - begin, n + 1
                parts.append(text[done:])
                removed.append(gone)
                spans.append(n)
                digests.append(hashlib.sha256(b"".join(parts)).hexdigest())
                kept.append(b"".join(bytes(x).decode(errors="ignore").encode() for x in parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests), pa.array(kept, pa.binary())],
                ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    rows = texts.select("k1", "k2", "body", "starts")
    return rows.mapInArrow(run, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def stretches(ranges, length: int) -> list[tuple[int, int]]:
    """(begin, end) of the bytes that strings from these ranges of starts cover, where they touch."""
    low, high = bounds(ranges)
    low, high = joined(low, high + length - 1)
    return list(zip(low.tolist(), (high + 1).tolist(), strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, body (the text's bytes; null: none), and k1, k2 that tell texts apart: two hashes and the length."""
    body = F.coalesce(docs["text"], F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body.alias("body")).withColumns({
        "k1": F.xxhash64("body"),
        "k2": F.shiftleft(F.hash("body").cast("bigint"), 32).bitwiseXOR(F.length("body").cast("bigint")),
    })


def screened(rows: DataFrame, classes: DataFrame, length: int, letters_of=None) -> tuple[DataFrame, list[DataFrame]]:
    """(doc (a number), k1, k2, body, open: one text of each class, and its starts whose mark is a mark elsewhere too; stored tables that this reads).

    letters_of: as in marks(); open refers to its results. doc is another number each time this is evaluated.
    """
    all_marks = stored(marks(rows, length, gram_of(length), letters_of), "marks")
    place = F.struct("k1", "k2", "low")
    asks = F.count(F.when(~F.col("known"), 1)).alias("n")
    twice = all_marks.groupBy("name").agg(F.min(place).alias("a"), F.max(place).alias("b"), asks).where("a <> b and n > 0")
    twice = stored(twice.select("name", "n"), "mark-names")
    told = join_in_parts(all_marks.where("not known").drop("known"), twice, ["name"]).select("k1", "k2", "low", "high")
    ranges = told.union(all_marks.where("known").select("k1", "k2", "low", "high")).groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("open"))
    chosen = ranges.join(classes, ["k1", "k2"]).select("k1", "k2", "least", "open")
    bodies = rows.select(F.coalesce("doc_id", F.lit(-1)).alias("least"), "k1", "k2", "body")
    bodies = bodies if letters_of else bodies.where(F.length("body") >= length)
    texts = bodies.join(chosen, ["least", "k1", "k2"]).dropDuplicates(["least", "k1", "k2"])
    return texts.select(F.monotonically_increasing_id().alias("doc"), "k1", "k2", "body", "open"), [all_marks, twice]


def repeats(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(classes, results): all texts with their number of rows, and cut() of the texts that partly go.

    length: at least LEAST bytes. Texts of several rows and of at least `length` bytes go as a whole; one row stands for them
    while others are compared with them.
    """
    rows = keyed(docs)
    least = F.coalesce(F.min("doc_id"), F.lit(-1)).alias("least")
    classes = stored(rows.groupBy("k1", "k2").agg(least, F.count("*").alias("copies")), "texts")
    texts, read = screened(rows, classes, length)
    texts = stored(texts, "candidates")
    for old in read:
        release(old)
    found = repeated_starts(pieces(texts, length), length)
    cuts = stored(cut(texts.join(found, "doc"), length), "cuts")
    release(texts)
    release(found)
    return classes, cuts


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A null text is empty. Texts shorter than `length` keep all bytes. Repeated rows are documents that hold each other's
    strings. Null doc_ids stay null. Strings overlap freely and are judged on the input. An empty table gives no rows.
    """
    classes, cuts = repeats(docs, length)
    rows = keyed(docs).select("doc_id", "k1", "k2", F.length("body").cast("bigint").alias("n_bytes"), F.sha2("body", 256).alias("own"))
    what = stored(classes.join(cuts.drop("kept"), ["k1", "k2"], "left").where("copies > 1 or n_removed is not null").drop("least"), "changes")
    release(classes)
    release(cuts)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return rows.join(what, ["k1", "k2"], "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs whose texts lack the repeated bytes; characters of which only a part is left are left out. Columns may have any names."""
    classes, cuts = repeats(docs, length)
    what = stored(classes.join(cuts, ["k1", "k2"], "left").where("copies > 1 or n_removed is not null").select(*[F.col(c).alias(f"__{c}") for c in ("k1", "k2", "copies", "kept")]), "changes")
    release(classes)
    release(cuts)
    names = [f"__{i}" for i in range(len(docs.columns))]
    own, text = docs.toDF(*names), names[docs.columns.index("text")]
    own = own.withColumn("__body", F.coalesce(F.col(text), F.lit("")).cast("binary")).withColumns({
        "__a": F.xxhash64("__body"),
        "__b": F.shiftleft(F.hash("__body").cast("bigint"), 32).bitwiseXOR(F.length("__body").cast("bigint")),
    })
    out = own.join(what, (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")), "left")
    whole = (F.col("__copies") > 1) & (F.length("__body") >= length)
    new = F.when(whole, F.lit("")).when(F.col("__kept").isNotNull(), F.col("__kept").cast("string")).otherwise(F.col(text))
    return out.select(*[(new if n == text else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)])
