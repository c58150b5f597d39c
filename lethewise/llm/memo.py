"""Encoding each distinct piece of text once."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from . import textbuf

#: Pieces whose ids a worker remembers (some 150 bytes each); when they are more, it forgets all and starts anew.
KNOWN_PIECES = 500_000


class PieceMemo:
    """Ids of pieces by number, from ``encode_new``: a function from new pieces to all their ids and the number of each."""

    def __init__(self, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = KNOWN_PIECES):
        self.encode_new, self.limit = encode_new, limit
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _codes(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.known) + len(pieces) > self.limit:
            self.forget()
        known = self.known
        codes = np.fromiter(map(known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(codes < 0)
        if len(at):
            new = [pieces[i] for i in at.tolist()]
            codes[at] = np.arange(len(known), len(known) + len(new))
            ids, sizes = self.encode_new(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
        return codes

    def stream(self, raw: np.ndarray, cuts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of ``raw`` between neighbouring cuts, end to end, and where in them the texts of ``offsets``
        (which are cuts) begin and end."""
        if len(cuts) > 1:
            pieces = textbuf.tiles(raw, cuts).dictionary_encode()
            data, at = textbuf.flat(pieces.dictionary)
            data, at = data.tobytes(), at.tolist()
            codes = self._codes([data[a:b] for a, b in zip(at, at[1:], strict=False)])[np.asarray(pieces.indices)]
        else:
            codes = np.zeros(0, np.int64)
        length = self.sizes[codes]
        ends = np.concatenate([[0], np.cumsum(length)])
        return self.ids[textbuf.ragged(self.starts[codes], length)], ends[np.searchsorted(cuts, offsets)]
