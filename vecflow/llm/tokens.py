"""Exact, memoised encoding with the tokenizers library.

Both vocabularies split a text into words before merging bytes, and no merge crosses a word.
A text may therefore be cut where a word surely ends, and each distinct piece needs the library
only once per worker: texts are cut as arrays of bytes and their distinct pieces told by Arrow.
Cuts are made between letters and other signs and before blanks, in texts whose characters are all
known to be safe for that; every other text goes to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts of these characters only may be cut (no other blanks, letters, marks or digits).
PLAIN = re.compile(rf"[\n -~¡¿«»{LETTERS}]*")
#: Pieces longer than this are not kept.
LONGEST_KEPT = 48
#: Pieces kept per worker before the memo starts anew (about 200 bytes each).
MEMO_LIMIT = 800_000
#: Texts encoded at once.
RUN_CHARACTERS = 4 << 20
#: Between pieces in one string; no character of a text that may be cut.
CUT = "\x01"
#: What the bytes of such texts are: blanks, letters, other signs, or the second byte of a character.
BLANK, LETTER, SIGN, SECOND_BYTE = range(4)
KINDS = np.full(256, SIGN, np.uint8)
KINDS[[ord(" "), ord("\n")]] = BLANK
KINDS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), 0xC3]] = LETTER  # 0xC3 begins À to ÿ
KINDS[0x80:0xC0] = SECOND_BYTE


class MemoEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, memo_limit: int = MEMO_LIMIT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blanks_count = self.tokenizer.encode("a b", add_special_tokens=False).ids != self.tokenizer.encode("a  b", add_special_tokens=False).ids
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Put between short pieces that are encoded in one go; its id can't come from a piece without mark.
        self.mark, self.separator = ("\n", "\n") if self.blanks_count else ("|", " | ")
        ids = self.tokenizer.encode(self.separator, add_special_tokens=False).ids
        self.separator_id = ids[0] if len(ids) == 1 else None
        self.memo: dict[str, bytes] = {}
        self.memo_limit = memo_limit

    @property
    def vocabulary_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Many short pieces as one text, if the separator is a token of its own."""
        if self.separator_id is None:
            return self._library(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([self.separator.join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(ids == self.separator_id)
        if len(ends) != len(pieces) - 1:
            return self._library(pieces)
        raw, bounds = ids.tobytes(), [-4, *(4 * ends).tolist(), 4 * len(ids)]
        return [raw[a + 4 : b] for a, b in zip(bounds, bounds[1:])]

    def _learn(self, pieces: list[str]) -> None:
        simple = [p for p in pieces if self.mark not in p and p.rfind(" ") <= 0]
        simple_set = set(simple)
        for i in range(0, len(simple), 256):
            part = simple[i : i + 256]
            self.memo.update(zip(part, self._joined(part)))
        if other := [p for p in pieces if p not in simple_set]:
            self.memo.update(zip(other, self._library(other)))

    def cuttable(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    @staticmethod
    def pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct pieces of the texts, the number of each piece in order, and where each text's
        pieces end. A piece is letters or other signs with the blanks before them, or blanks at the
        end of a text; words with an apostrophe stay whole, as contractions are tokens. The pieces of
        a text joined are the text."""
        encoded = [t.encode() for t in texts]
        data = b"".join(encoded)
        raw = np.frombuffer(data, np.uint8)
        end = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))
        begins = np.unique(np.concatenate([[0], end[:-1]])) if len(raw) else np.zeros(0, np.int64)
        begins = begins[begins < len(raw)]
        kind = KINDS[raw]
        second = np.flatnonzero(kind == SECOND_BYTE)
        kind[second] = kind[second - 1]
        cut = np.zeros(len(raw), bool)
        cut[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK)
        cut[begins] = True
        if len(quotes := np.flatnonzero(raw == ord("'"))):
            word_begins = cut & (kind == BLANK)
            word_begins[begins] = True
            word = np.cumsum(word_begins)
            whole = np.zeros(len(raw) + 1, bool)
            whole[word[quotes]] = True
            cut &= word_begins | ~whole[word]
        at = np.flatnonzero(cut)
        offsets = np.append(at, len(raw)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), CUT)[0].as_py().split(CUT) if len(at) else []
        return names, coded.indices.to_numpy(), np.searchsorted(at, end)

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of some distinct pieces."""
        if len(self.memo) > self.memo_limit:
            self.memo = {}
        known = list(map(self.memo.get, pieces))
        if None in known:
            unknown = [k for k, ids in enumerate(known) if ids is None]
            self._learn([pieces[k] for k in unknown if len(pieces[k]) <= LONGEST_KEPT])
            long = [k for k in unknown if len(pieces[k]) > LONGEST_KEPT]
            own = dict(zip(long, self._library([pieces[k] for k in long])))
            for k in unknown:
                known[k] = own[k] if k in own else self.memo[pieces[k]]
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids. Texts are taken in runs of RUN_CHARACTERS, a longer one alone."""
        out: list[bytes] = []
        run, characters = [], 0
        for text in texts:
            if run and characters + len(text) > RUN_CHARACTERS:
                out += self._encode_run(run)
                run, characters = [], 0
            run.append(text)
            characters += len(text)
        return out + self._encode_run(run) if run else out

    def _encode_run(self, texts: list[str]) -> list[bytes]:
        cuttable = [self.cuttable(t) for t in texts]
        whole = iter(self._library([t for t, c in zip(texts, cuttable) if not c]))
        pieces, number, ends = self.pieces([t for t, c in zip(texts, cuttable) if c])
        ids = self.ids_of(pieces)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(size) - size
        size, first = size[number], first[number]
        after = np.cumsum(size)
        at = np.repeat(first - (after - size), size) + np.arange(after[-1] if len(after) else 0)
        raw = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        bounds = 4 * np.concatenate([[0], np.concatenate([[0], after])[ends]])
        cut = iter([raw[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())])
        return [next(cut) if c else next(whole) for c in cuttable]


@lru_cache(maxsize=4)
def encoder(path: str, memo_limit: int = MEMO_LIMIT) -> MemoEncoder:
    """One encoder per worker and vocabulary."""
    return MemoEncoder(path, memo_limit)
