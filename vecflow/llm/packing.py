"""Best-fit packing with swap-based local search.

Documents become id arrays with an end id; arrays longer than a sequence are cut into full pieces
and a rest. Pieces are packed in groups of bounded size: best fit in descending length, then a
local search goes over the bins that are not full, the least filled first, and takes load from each
by moving a piece to a fuller bin or exchanging pieces with it, one for one, two for one or one for
two, whatever gains most. Every step raises the sum of squared fills, so bins empty, and the search
ends when no bin that is not full has such a step left. Pieces of bins that stay open are packed
again in other groups, round after round, until one group holds them all or a round saves nothing
(then its input stands), so no task holds more than a group.

Null and empty texts are documents of one id, the end id. Rows that repeat a document id, and
rows with a null id, are packed each for itself; equal lengths keep the order of their rows' numbers.
Texts of any length are encoded whole. An empty table gives an empty result. Columns other than the
two named ones are ignored.
"""

from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .tokens import MEMO_LIMIT, encoder

GROUP_PIECES = 16_384
#: Documents encoded at once; the encoder takes them in runs of bounded size.
ROWS = 512
#: Bins filled less than this share of a sequence go to the next round.
CLOSED = 0.995

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = f"{PIECES}, uid long, sequence_id long, offset long, fill long"


def cut(docs: DataFrame, vocabulary: str, end_id: int, size: int, id_column: str = "doc_id", text_column: str = "text", kept: int = MEMO_LIMIT) -> DataFrame:
    """PIECES of every document. A worker keeps the ids of that many pieces of text."""

    def pieces(batches):
        encode = encoder(vocabulary, kept).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                rows: list[tuple] = []
                part = batch.slice(i, ROWS)
                for key, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[a : a + 4 * size]
                        rows.append((key, k, a // 4, len(own) // 4, zlib.crc32(own)))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(pieces, PIECES)


class OpenBins:
    """Bins by the room left in them; finds the tightest that still takes a piece."""

    def __init__(self, size: int):
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]
        self.mask = 0

    def add(self, bin_id: int, room: int) -> None:
        if not self.by_room[room]:
            self.mask |= 1 << room
        self.by_room[room].append(bin_id)

    def take(self, length: int) -> tuple[int, int] | None:
        """(bin, room) of the tightest fit, taken out."""
        above = self.mask >> length
        if not above:
            return None
        room = length + (above & -above).bit_length() - 1
        found = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        return found, room


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each piece: longest first, each into the tightest open bin."""
    bins = np.empty(len(lengths), np.int64)
    opened, n = OpenBins(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        if (got := opened.take(length)) is None:
            got, n = (n, size), n + 1
        bins[i] = got[0]
        if got[1] > length:
            opened.add(got[0], got[1] - length)
    return bins


def improve(lengths: np.ndarray, bins: np.ndarray, size: int, patience: int | None = None) -> np.ndarray:
    """Local search over the underfull bins; each step moves load to a fuller bin. With patience it
    ends after so many bins in a row that could not be emptied."""
    bins = bins.copy()
    while True:
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        under = np.flatnonzero(fill[bins] < size)
        search = _Search(lengths[under].astype(np.int64), bins[under], fill, size)
        steps, failures = 0, 0
        live = np.unique(search.home)
        for victim in live[np.argsort(fill[live], kind="stable")].tolist():
            while 0 < fill[victim] < size and search.step(victim):
                steps += 1
            failures = 0 if fill[victim] == 0 else failures + 1
            if patience is not None and failures >= patience:
                break
        bins[under] = search.home
        if not steps or failures == patience:
            return np.unique(bins, return_inverse=True)[1]


class _Search:
    """Pieces of bins that are not full, and their steps."""

    def __init__(self, length: np.ndarray, home: np.ndarray, fill: np.ndarray, size: int):
        self.length, self.home, self.fill, self.size = length, home, fill, size
        self.couples: tuple[np.ndarray, np.ndarray] | None = None

    def shift(self, out: list[int], back: list[int], to: int, victim: int) -> bool:
        moved = int(self.length[out].sum() - self.length[back].sum())
        self.home[out], self.home[back] = to, victim
        self.fill[to] += moved
        self.fill[victim] -= moved
        self.couples = None
        return True

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of pieces that share a bin."""
        if self.couples is None:
            order = np.argsort(self.home, kind="stable")
            home, left, right, lag = self.home[order], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
            while len(at := np.flatnonzero(home[lag:] == home[:-lag])):
                left.append(order[at])
                right.append(order[at + lag])
                lag += 1
            self.couples = np.concatenate(left), np.concatenate(right)
        return self.couples

    def gains(self, totals: np.ndarray, theirs: np.ndarray, where: np.ndarray, victim: int) -> tuple[int, int, int]:
        """The largest gain of a bin from giving theirs for one of totals (ascending); which of theirs,
        and which total. 0 if there is none."""
        room = self.size - self.fill[where]
        ok = (where != victim) & (self.fill[where] >= self.fill[victim]) & (room > 0)
        fit = np.searchsorted(totals, theirs + room, side="right") - 1
        gain = np.where(ok & (fit >= 0), totals[np.maximum(fit, 0)] - theirs, 0)
        k = int(np.argmax(gain)) if len(gain) else 0
        return (max(int(gain[k]), 0), k, int(fit[k])) if len(gain) else (0, 0, 0)

    def step(self, victim: int) -> bool:
        """One move or exchange that takes load from the victim; False if there is none."""
        own = np.flatnonzero(self.home == victim)
        own = own[np.argsort(self.length[own], kind="stable")]
        length = self.length[own]
        room = self.size - self.fill
        open_ = np.flatnonzero((room > 0) & (self.fill >= self.fill[victim]))
        open_ = open_[open_ != victim]
        for x in own[::-1]:  # move, to the tightest bin
            fits = open_[room[open_] >= self.length[x]]
            if len(fits):
                return self.shift([x], [], int(fits[np.argmin(room[fits])]), victim)
        # one for one and two for one
        i, j = np.triu_indices(len(own), 1)
        single, where_single = np.unique(length, return_index=True)
        double, where_double = np.unique(length[i] + length[j], return_index=True)
        best, k, n = self.gains(single, self.length, self.home, victim)
        choice = [own[where_single[n]]] if best else []
        two, k2, n2 = self.gains(double, self.length, self.home, victim) if len(double) else (0, 0, 0)
        if two > best:
            best, k, choice = two, k2, [own[i[where_double[n2]]], own[j[where_double[n2]]]]
        if best:
            return self.shift(choice, [k], int(self.home[k]), victim)
        a, b = self.pairs()  # one for two
        best, k, n = self.gains(single, self.length[a] + self.length[b], self.home[a], victim)
        return bool(best) and self.shift([own[where_single[n]]], [int(a[k]), int(b[k])], int(self.home[a[k]]), victim)


def fullest_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each piece: the longest one left opens a bin, and the piece or the two pieces that
    fill it most go in, again and again until none fits."""
    order = np.argsort(lengths, kind="stable")
    left, at = lengths[order].tolist(), order.tolist()
    bins, n = np.empty(len(lengths), np.int64), 0
    while left:
        room = size - left.pop()
        bins[at.pop()] = n
        while left and left[0] <= room:
            j = bisect.bisect_right(left, room) - 1
            most, pick, i = left[j], (j,), 0
            while i < j and most < room:
                if (both := left[i] + left[j]) > room:
                    j -= 1
                    continue
                if both > most:
                    most, pick = both, (j, i)
                i += 1
            for k in pick:
                del left[k]
                bins[at.pop(k)] = n
            room -= most
        n += 1
    return bins


def pack_lengths(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each piece, bins numbered from 0. Where the search from best fit leaves more bins
    than the sum of lengths asks for, it also goes from fullest_fit, and the fewer bins count."""
    found = improve(lengths, best_fit(lengths, size), size)
    if found.max() + 1 > -(-int(lengths.sum()) // size):
        other = improve(lengths, fullest_fit(lengths, size), size)
        if other.max() < found.max():
            return other
    return found


def _packed(size: int, round_no: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        order = np.lexsort((table["uid"].to_numpy(), -lengths))
        table, lengths = table.take(pa.array(order)), lengths[order]
        bins = pack_lengths(lengths, size)
        place = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[place]) - lengths[place]
        first = np.searchsorted(bins[place], np.arange(bins.max() + 1))
        offset = np.empty(len(bins), np.int64)
        offset[place] = before - before[first][bins[place]]
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        number = ((round_no << 40) | key[0].as_py()) * GROUP_PIECES * 2 + bins
        new = {"sequence_id": number, "offset": offset, "fill": fill[bins]}
        return pa.table({**{n: table[n] for n in table.column_names if n not in (*new, "part")}, **{n: pa.array(v, pa.int64()) for n, v in new.items()}})

    return pack


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """PLACES: each piece with its sequence and its offset there."""
    rest = stored(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    done, before, bins_before, round_no = None, None, None, 0
    while True:
        groups = max(1, math.ceil(rest.count() / GROUP_PIECES))
        part = F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(groups)) if groups > 1 else F.lit(0).cast("long")
        placed = stored(rest.select(*pieces.columns, "uid").withColumn("part", part).groupBy("part").applyInArrow(_packed(size, round_no), PLACES), f"packed{round_no}")
        bins = placed.filter("offset = 0").count()
        if bins_before is not None and bins >= bins_before:  # nothing saved: the round before stands
            placed, groups = before, 1
        open_ = F.col("fill") < CLOSED * size
        closed = placed if groups == 1 else placed.filter(~open_)
        done = closed if done is None else done.unionByName(closed)
        if groups == 1:
            return done
        before = rest = placed.filter(open_)
        bins_before, round_no = rest.filter("offset = 0").count(), round_no + 1


def packed_documents(docs: DataFrame, vocabulary: str, end_id: int, size: int, kept: int = MEMO_LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs."""
    return pack(cut(docs, vocabulary, end_id, size, kept=kept), size).drop("uid", "fill")
