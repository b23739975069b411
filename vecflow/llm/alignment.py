"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

Both tokenizers cover the same bytes. One side leads by some unmatched bytes, the residual; the other side
takes its next token, which either eats into the residual or overtakes it and leads by what is left over.
A group of tokens closes when the residual is empty: there both sides end a token. The step depends on the
residual and the next token alone. Residuals, with the side that leads, are numbered as states, and steps
are memoised in a sorted table by state and token, so all units of a chunk take a step at once.

No token of either vocabulary goes from a visible character over to a blank, so a text is cut there into
units (blanks and a word), and each distinct unit of a chunk is encoded and aligned once.

A corpus is counted in two passes. The first turns some megabytes of text at a time into one row, a chunk:
its distinct id pairs, in how many of its documents each is linked, and for each document the positions of
its pairs among them. Pairs are then counted by Spark over chunks, so a frequent pair is one row a chunk
instead of one a document, and each chunk gets its own pairs' counts back.

Texts that are null or empty, and those that the bytes of either side's tokens do not give back, have no
tokens. Every row is a document, also rows with the same or no doc_id. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Characters of text in a chunk, but for a longer single text.
CHUNK_CHARACTERS = 4 << 20
#: Steps kept per worker, and units that are fewer than this take them one by one.
STEP_LIMIT, FEW_UNITS = 500_000, 48
#: Groups with more pairs of tokens than this are counted by their distinct tokens.
LARGE_GROUP = 1024
#: U+2581 stands for a blank in pieces.
BLANK_MARK = "\u2581"
UNIT = re.compile(r" +[^ ]*")
#: A blank after anything that a tokenizer might take for white space.
UNSAFE = re.compile(r"[\x00-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff] ")
#: An id pair as one number: ids of the second vocabulary are below SECOND.
SECOND = 1 << 15

DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
CHUNK = f"chunk long, documents array<struct<{DOCUMENT.replace(' long', ':bigint').replace(' string', ':string')}>>, codes array<int>, linked_in array<int>, sizes binary, places binary, times binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_level_bytes(tokens: list[str]) -> list[bytes]:
    """The bytes of byte-level tokens: printable bytes stand for themselves, the others, in order, for
    the characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(shown)]
    table = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}
    return [bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t in tokens]


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: U+2581 is a blank, <0xHH> the byte HH."""
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(BLANK_MARK, " ").encode()


class Transducer:
    """Tokens of two sides into groups. A state is the side that leads (0 or 1) and its unmatched bytes;
    state 0 has none."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.bytes = first, second
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple[int, bytes]] = [(1, b"")]
        self.numbers = {b"": 0}, {b"": 0}
        self.leads = np.ones(1, np.int8)
        self.steps: dict[int, int] = {}
        self.keys, self.targets = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def step(self, key: int) -> int:
        """The state after the side that does not lead takes a token, -1 if the bytes differ. key: state
        and token."""
        if key in self.steps:
            return self.steps[key]
        (lead, residual), new = self.states[key >> 16], self.bytes[1 - self.states[key >> 16][0]][key & 0xFFFF]
        if residual.startswith(new):
            lead, left = lead, residual[len(new) :]
        elif new.startswith(residual):
            lead, left = 1 - lead, new[len(residual) :]
        else:
            lead, left = lead, None
        to = -1 if left is None else self.numbers[lead].get(left)
        if to is None:
            to = self.numbers[lead][left] = len(self.states)
            self.states.append((lead, left))
        self.steps[key] = to
        return to

    def take(self, keys: np.ndarray) -> np.ndarray:
        """step for each of many keys."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        unknown = keys if not len(self.keys) else keys[self.keys[at] != keys]
        if len(unknown):
            for key in np.unique(unknown).tolist():
                self.step(key)
            self.keys = np.fromiter(self.steps.keys(), np.int64, len(self.steps))
            order = np.argsort(self.keys)
            self.keys, self.targets = self.keys[order], np.fromiter(self.steps.values(), np.int32, len(self.steps))[order]
            self.leads = np.fromiter((lead for lead, _ in self.states), np.int8, len(self.states))
            at = np.searchsorted(self.keys, keys)
        return self.targets[at]

    def groups(self, tokens: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For units with so many tokens on each side: the group of each token within its unit, on both
        sides, and which units' bytes are the same on both."""
        if len(self.steps) > STEP_LIMIT:
            self.forget()
        ends = [np.cumsum(c) for c in counts]
        at = [e - c for e, c in zip(ends, counts)]
        group = [np.zeros(len(t), np.int32) for t in tokens]
        units = len(counts[0])
        state, now, good = np.zeros(units, np.int64), np.zeros(units, np.int32), np.zeros(units, bool)
        active = np.arange(units)
        while len(active) >= FEW_UNITS:
            side = 1 - self.leads[state[active]]
            going = []
            for k in (0, 1):
                own = active[side == k]
                over = at[k][own] == ends[k][own]
                done = own[over]
                good[done] = (state[done] == 0) & (at[1][done] == ends[1][done]) & (at[0][done] == ends[0][done])
                own = own[~over]
                place = at[k][own]
                group[k][place] = now[own]
                state[own] = to = self.take(state[own] << 16 | tokens[k][place])
                at[k][own] += 1
                now[own] += to == 0
                going.append(own[to >= 0])
            active = np.concatenate(going)
        for u in active.tolist():
            s, g, places, limits = int(state[u]), int(now[u]), [int(x[u]) for x in at], [int(x[u]) for x in ends]
            while s >= 0:
                k = 1 - self.states[s][0]
                if places[k] == limits[k]:
                    good[u] = s == 0 and places == limits
                    break
                group[k][places[k]] = g
                s = self.step(s << 16 | int(tokens[k][places[k]]))
                places[k] += 1
                g += s == 0
        return group[0], group[1], good


@dataclass
class Units:
    """Aligned units. totals: n_a, n_b, n_groups, n_links of each; the links' codes and times, and the
    groups' text as places in a table of pieces, are in one row, with how many each unit has. Units
    that are not good have none."""

    good: np.ndarray
    totals: np.ndarray
    codes: np.ndarray
    times: np.ndarray
    n_codes: np.ndarray
    pieces: np.ndarray
    n_pieces: np.ndarray


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each first, size of them."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Aligner:
    """Units of text and what their alignment gives."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(names) > SECOND or self.a.get_vocab_size() > (1 << 16):
            raise ValueError("vocabularies are too large for a pair in 31 bits")
        self.blank = [self.b.piece_to_id(BLANK_MARK)]
        self.whole = any(re.search(f"[^{BLANK_MARK}]{BLANK_MARK}", n) for n in names)
        ids = range(self.a.get_vocab_size())
        self.a_bytes = byte_level_bytes([self.a.id_to_token(i) or "" for i in ids])
        self.a_sizes = np.fromiter(map(len, self.a_bytes), np.int64)
        self.transducer = Transducer(self.a_bytes, [piece_bytes(n) for n in names])
        #: Numbers with what follows them in a text of groups: , or | after the first side's, , or ; after the second's.
        self.pieces = pa.array([f"{i}{sign}" for n, signs in ((len(ids), ",|"), (len(names), ",;")) for sign in signs for i in range(n)])

    def units(self, text: str) -> list[str]:
        """A blank and the text, cut before blanks that follow a visible character."""
        full = " " + text
        if self.whole or BLANK_MARK in full:
            return [full]
        units = UNIT.findall(full)
        if UNSAFE.search(full):
            joined = []
            for u in units:
                if joined and UNSAFE.match(joined[-1][-1] + " "):
                    joined[-1] += u
                else:
                    joined.append(u)
            units = joined
        return units

    def encoded(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both sides' ids of units, each of which begins with a blank (which the second side adds)."""
        first = self.a.encode_batch_fast(units, add_special_tokens=False)
        second = self.b.encode([u[1:] for u in units], num_threads=1)
        return [e.ids for e in first], [ids if u != " " else self.blank for u, ids in zip(units, second)]

    def _same_bytes(self, units: list[str], a: np.ndarray, n_a: np.ndarray) -> np.ndarray:
        """Which units their tokens of the first side give back."""
        want = [u.encode() for u in units]
        ends = np.concatenate([[0], np.cumsum(self.a_sizes[a])])[np.concatenate([[0], np.cumsum(n_a)])]
        got = b"".join([self.a_bytes[i] for i in a.tolist()])
        if got == b"".join(want) and (np.diff(ends) == np.fromiter(map(len, want), np.int64, len(want))).all():
            return np.ones(len(units), bool)
        return np.array([got[x:y] == w for x, y, w in zip(ends[:-1].tolist(), ends[1:].tolist(), want)], bool)

    def aligned(self, units: list[str]) -> Units:
        """The alignment of some units."""
        ids: tuple[list[np.ndarray], list[np.ndarray]] = [], []
        counts: tuple[list[int], list[int]] = [], []
        for i in range(0, len(units), 8192):
            for k, side in enumerate(self.encoded(units[i : i + 8192])):
                counts[k].extend(map(len, side))
                ids[k].append(np.fromiter((x for y in side for x in y), np.int64))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ids)
        n_a, n_b = (np.array(x, np.int64) for x in counts)
        group_a, group_b, good = self.transducer.groups((a, b), (n_a, n_b))
        good &= self._same_bytes(units, a, n_a)
        # tokens of good units, groups numbered over all units
        unit_a, unit_b = (np.repeat(np.arange(len(units)), n) for n in (n_a, n_b))
        keep_a, keep_b = good[unit_a], good[unit_b]
        a, group_a, unit_a, b, group_b, unit_b = a[keep_a], group_a[keep_a], unit_a[keep_a], b[keep_b], group_b[keep_b], unit_b[keep_b]
        n_groups = np.zeros(len(units), np.int64)
        np.maximum.at(n_groups, unit_a, group_a + 1)
        first_group = np.cumsum(n_groups) - n_groups
        group_a, group_b = first_group[unit_a] + group_a, first_group[unit_b] + group_b
        unit_of = np.repeat(np.arange(len(units)), n_groups)
        in_a, in_b = (np.bincount(g, minlength=len(unit_of)) for g in (group_a, group_b))
        # links of each token of the first side with the group's tokens of the second
        large = in_a * in_b > LARGE_GROUP
        begin_a, begin_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        few = ~large[group_a]
        width = in_b[group_a[few]]
        codes = np.repeat(a[few] * SECOND, width) + b[_spread(begin_b[group_a[few]], width)]
        owner, times = np.repeat(unit_a[few], width), np.ones(len(codes), np.int64)
        for g in np.flatnonzero(large).tolist():
            (x, m), (y, n) = (np.unique(side[begin[g] : begin[g] + size[g]], return_counts=True) for side, begin, size in ((a, begin_a, in_a), (b, begin_b, in_b)))
            codes = np.concatenate([codes, np.add.outer(x * SECOND, y).ravel()])
            times = np.concatenate([times, np.multiply.outer(m, n).ravel()])
            owner = np.concatenate([owner, np.full(len(x) * len(y), unit_of[g])])
        if large.any():
            order = np.argsort(owner, kind="stable")
            codes, times, owner = codes[order], times[order], owner[order]
        # text of the groups: the first side's tokens, then the second's
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (group_a, group_b))
        pieces = np.empty(len(a) + len(b), np.int32)
        own_a, own_b = a + last_a * len(self.a_bytes), 2 * len(self.a_bytes) + b + last_b * self.b.get_piece_size()
        pieces[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = own_a
        pieces[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = own_b
        tokens = [np.where(good, n, 0) for n in (n_a, n_b)]
        links = np.bincount(unit_of, in_a * in_b, len(units)).astype(np.int64)
        return Units(good, np.stack([*tokens, n_groups, links], axis=1), codes, times, np.bincount(owner, minlength=len(units)), pieces, tokens[0] + tokens[1])

    def texts_of(self, pieces: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """Groups' texts from places of pieces, so many for each."""
        made = self.pieces.take(pa.array(pieces))
        offsets, data = np.frombuffer(made.buffers()[1], np.int32)[: len(made) + 1], memoryview(made.buffers()[2] or b"")
        bounds = offsets[np.concatenate([[0], np.cumsum(counts)])].tolist() if len(made) else [0] * (len(counts) + 1)
        return [data[x : max(x, y - 1)] for x, y in zip(bounds, bounds[1:])]

    def groups(self, text: str | None) -> str:
        """A text's groups as a1,a2|b1;a3|b2,b3, empty if it has no tokens."""
        if not text:
            return ""
        found = self.aligned(self.units(text))
        return str(self.texts_of(found.pieces, found.n_pieces.sum(keepdims=True))[0], "ascii") if found.good.all() else ""


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per worker and pair of vocabularies."""
    return Aligner(path_a, path_b)


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def chunk_row(align: Aligner, ids: list, texts: list[str | None]) -> dict:
    """A chunk's row, but for its number."""
    index: dict[str, int] = {}
    number = index.setdefault
    of_text = [np.array([number(u, len(index)) for u in align.units(t)], np.int64) if t else np.zeros(0, np.int64) for t in texts]
    units = align.aligned(list(index))
    if not units.good.all():
        of_text = [x if units.good[x].all() else x[:0] for x in of_text]
    length = np.fromiter(map(len, of_text), np.int64, len(of_text))
    unit, n_units = np.concatenate(of_text) if of_text else np.zeros(0, np.int64), max(len(index), 1)

    first_piece = np.cumsum(units.n_pieces) - units.n_pieces
    pieces = units.pieces[_spread(first_piece[unit], units.n_pieces[unit])]
    per_text = np.diff(np.concatenate([[0], np.cumsum(units.n_pieces[unit])])[np.concatenate([[0], np.cumsum(length)])])
    digests = [hashlib.sha256(t).hexdigest() if n else "" for n, t in zip(per_text.tolist(), align.texts_of(pieces, per_text))]

    keys, repeats = np.unique(np.repeat(np.arange(len(texts)), length) * n_units + unit, return_counts=True)
    doc, unit = np.divmod(keys, n_units)
    totals = [np.bincount(doc, units.totals[unit, k] * repeats, len(texts)).astype(np.int64) for k in range(4)]

    n = units.n_codes[unit]
    at = _spread((np.cumsum(units.n_codes) - units.n_codes)[unit], n)
    codes, place = np.unique(units.codes, return_inverse=True)
    n_codes = max(len(codes), 1)
    pairs, where = np.unique(np.repeat(doc, n) * n_codes + place[at], return_inverse=True)
    times = np.bincount(where, units.times[at] * np.repeat(repeats, n), len(pairs)).astype(np.int64)
    doc, place = np.divmod(pairs, n_codes)
    used = np.bincount(place, minlength=len(codes))
    if (used == 0).any():  # codes of units in no text that counts
        place = (np.cumsum(used > 0) - 1)[place]
        codes, used = codes[used > 0], used[used > 0]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return {
        "documents": [dict(zip(names, row)) for row in zip(ids, *(t.tolist() for t in totals), digests)],
        "codes": codes.astype(np.int32),
        "linked_in": used.astype(np.int32),
        "sizes": _packed(np.bincount(doc, minlength=len(texts)).astype(np.int64)),
        "places": _packed(np.diff(place, prepend=0).astype(np.int32)),
        "times": _packed(times),
    }


def _schema(chunk: bool) -> pa.Schema:
    document = pa.struct([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")])
    if chunk:
        return pa.schema([("chunk", pa.int64()), ("documents", pa.list_(document)), ("codes", pa.list_(pa.int32())), ("linked_in", pa.list_(pa.int32())), *[(n, pa.binary()) for n in ("sizes", "places", "times")]])
    return pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in (x.split()[0] for x in RESULT.split(", "))])


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (doc_id, text) as rows of CHUNK, written in the shared folder."""
    schema = _schema(True)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[str | None] = []
        characters = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"chunk": number} | chunk_row(align, ids, texts)], schema=schema)

        for table in tables:
            for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text")):
                text = text.as_py()
                if ids and characters + len(text or "") > CHUNK_CHARACTERS:
                    yield row()
                    ids, texts, characters, number = [], [], 0, number + 1
                ids.append(doc_id)
                texts.append(text)
                characters += len(text or "")
        if ids:
            yield row()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNK), "alignment_chunks")


def pair_counts(chunk_rows: DataFrame) -> DataFrame:
    """Each linked id pair: code, a, b, documents (in how many it is linked), best (no pair of its a is in
    more). A window holds one a's pairs, as many as the second vocabulary has ids at most."""
    counted = chunk_rows.select(F.inline(F.arrays_zip("codes", "linked_in"))).groupBy(F.col("codes").alias("code")).agg(F.sum("linked_in").alias("documents"))
    split = counted.select("code", F.shiftright("code", 15).alias("a"), (F.col("code") % SECOND).alias("b"), "documents")
    return split.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy("a")))


def _read_back(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(False)
    for table in tables:
        for row in range(table.num_rows):
            one = table.slice(row, 1)
            documents = one.column("documents").flatten()
            counts = one.column("counts").flatten()
            place, documents_of, best = (counts.field(f).to_numpy(zero_copy_only=False) for f in ("pos", "documents", "best"))
            of = np.zeros(len(place), np.int64)
            of[place] = documents_of
            is_best = np.zeros(len(place), bool)
            is_best[place] = best
            sizes, steps, times = (_unpacked(one.column(c)[0].as_py(), kind) for c, kind in (("sizes", "<i8"), ("places", "<i4"), ("times", "<i8")))
            at = np.cumsum(steps.astype(np.int64))
            bounds = np.concatenate([[0], np.cumsum(sizes)])

            def summed(values: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])

            fields = {f: documents.field(f) for f in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            fields["n_best"] = pa.array(summed(times * is_best[at]))
            fields["count_sum"] = pa.array(summed(times * of[at]))
            yield pa.RecordBatch.from_arrays([fields[n] for n in schema.names], schema=schema)


def aligned(chunk_rows: DataFrame, counts: DataFrame) -> DataFrame:
    """A row per document (RESULT): its tokens, groups and links, how many links are of pairs best for
    their first id, and the sum of the pairs' counts over its links."""
    own = chunk_rows.select("chunk", F.posexplode("codes").alias("pos", "code")).join(counts.select("code", "documents", "best"), "code")
    own = own.groupBy("chunk").agg(F.collect_list(F.struct("pos", "documents", "best")).alias("counts"))
    both = chunk_rows.select("chunk", "documents", "sizes", "places", "times").join(own, "chunk", "left")
    nothing = F.array().cast("array<struct<pos:int,documents:bigint,best:boolean>>")
    return both.withColumn("counts", F.coalesce("counts", nothing)).mapInArrow(_read_back, RESULT)


def with_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs with token_groups: each text's groups as a1,a2|b1;a3|b2,b3, empty if it has no tokens."""

    @F.pandas_udf("string")
    def groups(texts):
        align = aligner(path_a, path_b)
        return texts.map(lambda t: align.groups(t))

    return docs.withColumn("token_groups", groups(F.col("text")))
