"""Token ids of whole texts by a public tokenizer, many texts at a time.

A byte-level tokenizer first splits a text into pieces and encodes each by itself, so a text's ids are its pieces'
ids in order. Here numpy splits a column of texts at once and looks pieces of up to 16 bytes up in hash tables, whose
keys are those bytes themselves (no two pieces share one); pieces that are new come from the library. The shortcut holds for
texts of Latin letters without the few numerals among them and without the content of a special token; all others go to
the library whole. Ids are those of the library as it loads the file: a special token's content is that token.

A table holds as many pieces as it has room for and is emptied when it is full; a call keeps what doesn't fit for itself, so a
worker's memory has a bound that no input moves.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from partlens.llm.common import byte_view, mix

TOKENIZER = "byte_bpe_50k.json"
#: Places of a table (a power of two), the share of them that may be taken, and how far from its own a piece may lie.
BITS, FULL, PROBES = 19, 0.6, 8
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def _class_of(c: str) -> int:
    return _SPACE if c.isspace() else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _OTHER


#: Classes of code points of one or two bytes; below U+0240 as the library's splitter has them, others don't matter.
_CLASS = np.array([_class_of(chr(c)) for c in range(0x800)], np.uint8)
#: The first byte of U+0240 and above, which send a text to the library whole; so do controls 0 and 1c to 1f,
_WIDE = 0xC9
_CONTROLS = np.array([0, 0x1C, 0x1D, 0x1E, 0x1F], np.uint8)
#: and after C2 the bytes of U+0085 and the numerals of Latin-1.
_NUMERALS = np.array([0x85, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE], np.uint8)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split(data: np.ndarray, offs: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Where pieces begin: letters, digits or other signs in a run, each with a blank before it; contractions after
    an apostrophe; white space, of which the last character before something else stands alone. wide: where characters of
    several bytes begin."""
    n = len(data)
    c = _CLASS.take(data)
    if len(wide):
        c[wide] = c[wide + 1] = _CLASS[(data[wide].astype(np.int64) & 0x1F) << 6 | data[wide + 1] & 0x3F]
    begin = np.zeros(n + 1, bool)
    np.not_equal(c[1:], c[:-1], out=begin[1:n])
    first = np.zeros(n + 1, bool)  # of a text
    first[offs] = True
    after = np.flatnonzero(begin[1:n] & (c[:-1] == _SPACE)) + 1
    after = after[~first[after]]
    last = after - 1
    blank = data[last] == 0x20
    begin[np.where(data[last] >= 0x80, last - 1, last)] = True
    begin[after[blank]] = False
    begin |= first
    q = np.flatnonzero(data == 0x27)
    q = q[begin[q]]
    if len(q):
        pad = np.concatenate([data[q[0] :], np.zeros(2, np.uint8)])
        ends = offs[np.searchsorted(offs, q, side="right")]
        one, two = pad[q - q[0] + 1], pad[q - q[0] + 2]
        short = (q + 1 < ends) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (q + 2 < ends) & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))
        begin[q[short | long] + 1] = False
        begin[q[short] + 2] = True
        begin[q[long] + 3] = True
    return np.flatnonzero(begin[:n])


class Table:
    """Ids of pieces by one or two numbers that hold a piece's bytes; the second is None where all are 0."""

    def __init__(self, both: bool):
        self.both = both
        self.clear()

    def clear(self) -> None:
        self.low = np.zeros(1 << BITS, np.uint64)
        self.high = np.zeros(1 << BITS, np.uint64) if self.both else None
        self.at, self.n = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.uint8)
        self.pool, self.used, self.held = np.zeros(1 << 16, np.uint16), 0, 0

    def _home(self, low: np.ndarray, high: np.ndarray | None) -> np.ndarray:
        x = (low ^ low >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        if high is not None:
            x ^= (high ^ high >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        return ((x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)

    def _here(self, slot: np.ndarray, low: np.ndarray, high: np.ndarray | None) -> np.ndarray:
        same = self.low.take(slot) == low
        return same if high is None else same & (self.high.take(slot) == high)

    def slots(self, low: np.ndarray, high: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The place of each piece, and which pieces have none."""
        out = self._home(low, high)
        left = np.flatnonzero(~self._here(out, low, high))
        for _ in range(1, PROBES):
            if not len(left):
                break
            slot = out[left] + 1 & (1 << BITS) - 1
            out[left] = slot
            left = left[~self._here(slot, low[left], None if high is None else high[left])]
        return out, left

    def learn(self, low: np.ndarray, high: np.ndarray | None, ids: list[list[int]]) -> None:
        """Put new pieces into free places near enough to their home; what finds none stays out."""
        room = int(FULL * (1 << BITS))
        if self.held + len(ids) > room:
            self.clear()
        ids = ids[:room]
        n = np.array([len(x) for x in ids], np.int64)
        ends = np.cumsum(n)
        if self.used + int(n.sum()) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), int(n.sum())), np.uint16)])
        self.pool[self.used : self.used + int(n.sum())] = [i for x in ids for i in x]
        left, home = np.arange(len(n)), self._home(low[: len(n)], None if high is None else high[: len(n)])
        for step in range(PROBES):
            slot = home[left] + step & (1 << BITS) - 1
            free = np.flatnonzero(self.n[slot] == 0)
            taken, one = np.unique(slot[free], return_index=True)
            put = left[free[one]]
            self.low[taken], self.at[taken], self.n[taken] = low[put], self.used + ends[put] - n[put], n[put]
            if high is not None:
                self.high[taken] = high[put]
            left = np.delete(left, free[one])
        self.used += int(n.sum())
        self.held += len(n) - len(left)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Ids:
    """Ids of texts as unsigned 16-bit numbers."""

    def __init__(self, name: str = TOKENIZER):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.model, self.letters = self.library.model, _byte_letters()
        self.tables = Table(False), Table(True)

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def pieces(self, raw: list[bytes]) -> list[list[int]]:
        """The ids of pieces."""
        text, tokenize, at, out = b"".join(raw).decode("latin-1").translate(self.letters), self.model.tokenize, 0, []
        for x in raw:
            to = at + len(x)
            out.append([t.id for t in tokenize(text[at:to])])
            at = to
        return out

    def _odd_rows(self, data: np.ndarray, offs: np.ndarray, wide: np.ndarray) -> list[int]:
        lead, low = data[wide], np.flatnonzero(data < 0x20)
        two = wide[lead == 0xC2]
        at = [wide[lead >= _WIDE], two[np.isin(data[two + 1], _NUMERALS)], low[np.isin(data[low], _CONTROLS)]]
        text = data.tobytes()
        for s in self.special:
            i = text.find(s)
            while i >= 0:
                at.append(np.array([i]))
                i = text.find(s, i + 1)
        at = np.concatenate(at)
        return np.unique(np.searchsorted(offs, at, side="right") - 1).tolist() if len(at) else []

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts one after the other, and where each text's begin; ``end`` follows each text."""
        data, offs = byte_view(texts)
        rows = len(offs) - 1
        if not len(data):
            return np.full(rows if end is not None else 0, end or 0, np.uint16), np.arange(rows + 1) * (end is not None)
        wide = np.flatnonzero(data >= 0xC0)
        begin = split(data, offs, wide)
        padded = np.concatenate([data, np.zeros(24, np.uint8)])
        eight = np.ndarray((len(data) + 16,), "<u8", padded, 0, (1,))
        size = np.diff(begin, append=len(data))
        first = np.searchsorted(begin, offs)
        odd = self._odd_rows(data, offs, wide)
        at, n = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        known = size <= 16
        for r in odd:
            known[first[r] : first[r + 1]] = False
        own: list[np.ndarray] = []
        total, rest = 0, [np.flatnonzero(~known)]
        whole = data.tobytes()
        for table, ask in ((self.tables[0], np.flatnonzero(known & (size <= 8))), (self.tables[1], np.flatnonzero(known & (size > 8)))):
            low = eight[begin[ask]]
            high = None
            if table.both:
                high = eight[begin[ask] + 8] & _MASK.take(size[ask] - 8)
            else:
                low &= _MASK.take(size[ask])
            slot, new = table.slots(low, high)
            if len(new):
                new = new[np.unique(low[new] if high is None else low[new] ^ mix(high[new]), return_index=True)[1]]
                where = ask[new]
                table.learn(low[new], None if high is None else high[new], self.pieces([whole[a:b] for a, b in zip(begin[where].tolist(), (begin[where] + size[where]).tolist(), strict=True)]))
                slot, new = table.slots(low, high)
            at[ask], n[ask] = table.at.take(slot).astype(np.int64) + total, table.n.take(slot)
            rest.append(ask[new])
            own.append(table.pool[: table.used])
            total += table.used
        for r in odd:
            ids = self.whole(whole[offs[r] : offs[r + 1]].decode())
            n[first[r] : first[r + 1]] = 0
            at[first[r]], n[first[r]] = total, len(ids)
            known[first[r] : first[r + 1]] = True
            own.append(np.array(ids, np.uint16))
            total += len(ids)
        mine: dict[bytes, tuple[int, int]] = {}
        for i in np.concatenate([rest[0][~known[rest[0]]], *rest[1:]]).tolist():  # long pieces, and those without a place
            piece = whole[begin[i] : begin[i] + size[i]]
            if piece not in mine:
                ids = self.pieces([piece])[0]
                mine[piece] = (total, len(ids))
                own.append(np.array(ids, np.uint16))
                total += len(ids)
            at[i], n[i] = mine[piece]
        ends = np.cumsum(n)
        flat = np.concatenate(own).take(np.repeat(at - ends + n, n) + np.arange(ends[-1]))
        starts = np.append(0, ends)[first]
        if end is None:
            return flat, starts
        out, where = np.full(len(flat) + rows, end, np.uint16), starts + np.arange(rows + 1)
        for a, b, to in zip(starts[:-1].tolist(), starts[1:].tolist(), where[:-1].tolist(), strict=True):
            out[to : to + b - a] = flat[a:b]
        return out, where


_shared: dict[str, Ids] = {}


def ids(name: str = TOKENIZER) -> Ids:
    """This process's tokenizer."""
    if name not in _shared:
        _shared[name] = Ids(name)
    return _shared[name]
