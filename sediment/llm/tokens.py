"""A public tokenizer over whole text columns.

The library encodes every distinct piece (a word with the space before it, a number, a run of marks) once
per worker and keeps its ids; numpy cuts texts into pieces and looks the ids up. Texts with characters
from U+0250 on, and texts that spell one of the vocabulary's special tokens, go to the library whole. Ids are those
of ``Tokenizer.encode(text, add_special_tokens=False)``: a special token that a text spells out gets the
special id, as the plain library has it.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import unicodedata

from .words import PIECE, U, mix, powers

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Distinct pieces that a worker keeps; beyond that it starts afresh.
KEPT_PIECES = 600_000

_ODD = 0xD6E8FEB86659FD93
_INV = pow(_ODD, -1, 2**64)
_FAST = 0x250
_LETTER, _NUMBER, _OTHER, _BLANK, _SPACE = 1, 2, 3, 4, 5


def vocabulary(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    out = np.full(_FAST, _OTHER, np.uint8)
    for cp in range(_FAST):
        kind = unicodedata.category(chr(cp))
        out[cp] = _SPACE if cp == 32 else _BLANK if chr(cp).isspace() and not 0x1C <= cp <= 0x1F else _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER
    return out


class Encoder:
    """Ids of texts by the byte-level BPE file at ``path``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tool = Tokenizer.from_file(path)
        self.spelled = [t.content for t in self.tool.get_added_tokens_decoder().values() if t.content]
        # one tokenizer in two states: as the file has it, and for pieces that are cut already
        self.own_cut, self.no_cut = self.tool.pre_tokenizer, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tool.pre_tokenizer = self.no_cut
        self.classes = _classes()
        self._forget()

    def _forget(self) -> None:
        self.bits = 17
        self.keys, self.where = np.zeros(1 << self.bits, U), np.zeros(1 << self.bits, np.int32)
        self.first, self.ids, self.n, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), 0, 0

    def byte_lengths(self) -> np.ndarray:
        """Bytes that each id stands for."""
        out = np.zeros(self.tool.get_vocab_size(), np.int32)
        for text, i in self.tool.get_vocab().items():
            out[i] = len(text)  # the file spells every byte as one character
        return out

    # the table of known pieces: open addressing, probed for all pieces of a text at once
    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = U((1 << self.bits) - 1)
        slot = (h & mask).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.where[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[slot] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            keys = self.keys[slot[open_]]
            hit = keys == h[open_]
            out[open_[hit]] = self.where[slot[open_[hit]]]
            open_ = open_[~hit & (keys != 0)]
        return out

    def _put(self, h: np.ndarray, which: np.ndarray) -> None:
        if (self.n + len(h)) * 3 > 1 << self.bits:
            held, at = self.keys[self.keys != 0], self.where[self.keys != 0]
            while (self.n + len(h)) * 3 > 1 << self.bits:
                self.bits += 1
            self.keys, self.where = np.zeros(1 << self.bits, U), np.zeros(1 << self.bits, np.int32)
            self._put_all(held, at)
        self._put_all(h, which)

    def _put_all(self, h: np.ndarray, which: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot, rest = (h & U(mask)).astype(np.int64), np.arange(len(h))
        while len(rest):
            s = slot[rest]
            free = self.keys[s] == 0
            _, one = np.unique(s[free], return_index=True)
            take = rest[free][one]
            self.keys[slot[take]], self.where[slot[take]] = h[take], which[take]
            rest = rest[self.keys[slot[rest]] != h[rest]]
            slot[rest] = (slot[rest] + 1) & mask

    def _learn(self, h: np.ndarray, texts: list[str]) -> None:
        if self.n > KEPT_PIECES:
            self._forget()
        done = self.tool.encode(texts, is_pretokenized=True, add_special_tokens=False)
        ids, of = np.array(done.ids, np.int32), np.array(done.word_ids, np.int64)
        n = self.n + len(texts)
        if n + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(n + 1, np.int64)])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + len(ids), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[self.n : n + 1] = self.used + np.searchsorted(of, np.arange(len(texts) + 1))
        self._put(h, np.arange(self.n, n, dtype=np.int32))
        self.n, self.used = n, self.used + len(ids)

    def _cut(self, cp: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Starts of the pieces of texts laid end to end; ``begins``: where texts (none empty) start."""
        kind = self.classes[cp]
        run_of = np.minimum(kind, _BLANK)  # a space is blank
        new = np.empty(len(cp), bool)
        new[0] = True
        np.not_equal(run_of[1:], run_of[:-1], out=new[1:])
        new[begins] = True
        run = np.flatnonzero(new)
        run_kind = run_of[run]
        stop = np.append(run[1:], len(cp))
        opens = np.zeros(len(cp) + 1, bool)
        opens[begins] = True
        opens[len(cp)] = True
        # a blank run with a text after it gives away its last character
        give = (run_kind == _BLANK) & ~opens[stop]
        last = stop[give] - 1
        new[last] = True
        new[stop[give][cp[last] == 32]] = False
        # 's 't 're 've 'm 'll 'd: a lone apostrophe without a space before it takes the letters along
        lone = (run_kind == _OTHER) & (cp[run] == 39) & (stop - run == 1) & ~opens[stop]
        at = run[lone]
        at = at[new[at]]
        if len(at):
            one = cp[at + 1]
            far = np.minimum(at + 2, len(cp) - 1)
            two = np.where((at + 2 < len(cp)) & ~opens[np.minimum(at + 2, len(cp))], cp[far], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for taken, width in ((short, 2), (pair, 3)):
                a = at[taken]
                new[a + 1] = False
                end = a + width
                end = end[(end < len(cp))]
                inner = end[(kind[end] == _LETTER) & ~opens[end]]
                new[inner] = True
        return np.flatnonzero(new)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and where each text's ids begin (one more at the end)."""
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        group: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if text:
                group.append(i)
                size += len(text)
            if size >= PIECE // 4 or i == len(texts) - 1:
                self._encode(texts, group, parts)
                group, size = [], 0
        begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return np.concatenate([np.zeros(0, np.int32), *parts]), begin

    def _whole(self, texts: list, some: list[int], parts: list[np.ndarray]) -> None:
        self.tool.pre_tokenizer = self.own_cut
        for i, done in zip(some, self.tool.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)):
            parts[i] = np.array(done.ids, np.int32)
        self.tool.pre_tokenizer = self.no_cut

    def _encode(self, texts: list, group: list[int], parts: list[np.ndarray]) -> None:
        if not group:
            return
        joined = "".join(texts[i] for i in group)
        if any(s in joined for s in self.spelled):
            marked = [i for i in group if any(s in texts[i] for s in self.spelled)]
            self._whole(texts, marked, parts)
            marks = set(marked)
            group = [i for i in group if i not in marks]
            if not group:
                return
            joined = "".join(texts[i] for i in group)
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(texts[i]) for i in group])
        begins = np.concatenate([[0], ends[:-1]])
        if cps.max() >= _FAST:
            odd = np.maximum.reduceat(cps, begins) >= _FAST
            rare = [i for i, o in zip(group, odd) if o]
            self._whole(texts, rare, parts)
            return self._encode(texts, [i for i, o in zip(group, odd) if not o], parts)
        start = self._cut(cps, begins)
        n = len(cps)
        h = np.add.reduceat((cps.astype(U) + U(1)) * powers(n, _ODD), start) * powers(n, _INV)[start]
        stop = np.append(start[1:], n)
        h = mix(h + (stop - start).astype(U))
        h[h == 0] = 1
        which = self._find(h)
        missing = np.flatnonzero(which < 0)
        if len(missing):
            keys, first = np.unique(h[missing], return_index=True)
            raw = cps.tobytes()
            self._learn(keys, [raw[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(start[missing[first]].tolist(), stop[missing[first]].tolist())])
            which = self._find(h) if (self.n == len(keys)) else which
            if (which < 0).any():
                rest = np.flatnonzero(which < 0)
                which[rest] = self._find(h[rest])
            if (which < 0).any():  # the table was emptied meanwhile
                return self._encode(texts, group, parts)
        at, count = self.first[which], self.first[which + 1] - self.first[which]
        to = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(at - to[:-1], count) + np.arange(to[-1])]
        cut = to[np.searchsorted(start, np.append(begins, n))]
        for i, a, b in zip(group, cut[:-1].tolist(), cut[1:].tolist()):
            parts[i] = ids[a:b]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(path: str, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return encoder(path).encode(list(texts))
