"""Subword lattices: the pieces of a vocabulary inside a word, and sums over all its segmentations in log space.

A word is written as a space and its UTF-8 bytes. Pieces are byte strings; every single byte is one, so each word
has a segmentation. Words are worked on as matrices of bytes, by length; very long ones byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
TABLE = 20  # bits of a place in the table of pieces
ROWS, LONG, STRETCH = 4096, 96, 1 << 16


def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a leading word mark is a space) and their scores: those of the file, single bytes the lowest.

    Control symbols and pieces with a word mark inside are left out: no word has them.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) or "▁" in piece[1:]):
            found[piece.replace("▁", " ").encode()] = model.get_score(i)
    lowest = min(found.values(), default=0.0) - 1
    for b in range(256):
        found.setdefault(bytes([b]), lowest)
    pieces = sorted(found)
    return pieces, np.array([found[p] for p in pieces])


def rank_weights(scores: np.ndarray) -> np.ndarray:
    """Log weights from scores that order the vocabulary: the n-th weighs 1 / (n + 1), in all 1."""
    order = np.empty(len(scores))
    order[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
    weights = 1 / (order + 2)
    return np.log(weights / weights.sum())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


class Lattice:
    """Sums over all segmentations into ``pieces``."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        self.lengths = sorted({len(p) for p in pieces})
        self.power = {n: np.uint64(pow(int(FACTOR), n, 1 << 64)) for n in self.lengths}
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        if len(np.unique(hashes)) != len(pieces):
            raise ValueError("two pieces have one hash")
        self.keys, self.values = np.zeros(1 << TABLE, np.uint64), np.full(1 << TABLE, self.n, np.int32)
        for i, h in enumerate(hashes.tolist()):
            at = h >> (64 - TABLE)
            while self.values[at] != self.n:
                at = (at + 1) % (1 << TABLE)
            self.keys[at], self.values[at] = h, i

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(FACTOR) + b + 1) % (1 << 64)
        return int(_mixed(np.array([h], np.uint64))[0])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; ``n`` where there is none."""
        h = _mixed(hashes)
        at = (h >> np.uint64(64 - TABLE)).astype(np.int64)
        out = self.values[at]
        other = (out != self.n) & (self.keys[at] != h)
        while other.any():
            where = np.nonzero(other)
            at[where] = (at[where] + 1) % (1 << TABLE)
            out[where] = self.values[at[where]]
            other[where] = (out[where] != self.n) & (self.keys[at[where]] != h[where])
        return out

    def _pieces(self, bytes_: np.ndarray) -> dict[int, np.ndarray]:
        """By length: the number of the piece at each place of each row of a matrix of bytes."""
        n, width = bytes_.shape
        sums = np.zeros((n, width + 1), np.uint64)
        for j in range(width):
            sums[:, j + 1] = sums[:, j] * FACTOR + (bytes_[:, j].astype(np.uint64) + np.uint64(1))
        return {k: self._find(sums[:, k:] - sums[:, :-k] * self.power[k]) for k in self.lengths if k <= width}

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of words of about one length, their lengths with the space, and their bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(sizes, kind="stable")
        order = order[: np.searchsorted(sizes[order], LONG, "right")]
        for begin in range(0, len(order), ROWS):
            at = order[begin : begin + ROWS]
            width = int(sizes[at[-1]])
            text = b"".join((b" " + words[i]).ljust(width, b"\0") for i in at.tolist())
            yield at, sizes[at], np.frombuffer(text, np.uint8).reshape(len(at), width)

    @staticmethod
    def _added(parts: list[np.ndarray]) -> np.ndarray:
        """log of the sum of exponentials, some of which may be 0 but never all."""
        if len(parts) == 1:
            return parts[0]
        stack = np.stack(parts)
        top = stack.max(0)
        return np.log(np.exp(stack - top).sum(0)) + top

    def _forward(self, found: dict[int, np.ndarray], weights: np.ndarray, width: int) -> np.ndarray:
        """Row e: log weight of all segmentations of the first e bytes of each word."""
        n = next(iter(found.values())).shape[0]
        alpha = np.zeros((width + 1, n))
        for e in range(1, width + 1):
            alpha[e] = self._added([alpha[e - k] + weights[found[k][:, e - k]] for k in found if k <= e])
        return alpha

    def scores(self, words: list[bytes], logs: np.ndarray) -> np.ndarray:
        """Log weight of all segmentations of each word."""
        weights, out = np.append(logs, -np.inf), np.zeros(len(words))
        for at, sizes, bytes_ in self._groups(words):
            alpha = self._forward(self._pieces(bytes_), weights, bytes_.shape[1])
            out[at] = alpha[sizes, np.arange(len(at))]
        for i, word in enumerate(words):
            if len(word) + 1 > LONG:
                out[i] = self._sweep(b" " + word, logs)
        return out

    def _matches(self, text: bytes, begin: int, end: int) -> list[list[tuple[int, int]]]:
        """(length, piece) of the pieces that end at each place from ``begin`` + 1 to ``end``."""
        low = max(0, begin - self.lengths[-1])
        found = self._pieces_of(np.frombuffer(text[low:end], np.uint8))
        out: list[list[tuple[int, int]]] = [[] for _ in range(end - begin)]
        for k, numbers in found.items():
            for s in np.flatnonzero(numbers != self.n).tolist():
                if (e := low + s + k) > begin:
                    out[e - begin - 1].append((k, int(numbers[s])))
        return out

    def _pieces_of(self, row: np.ndarray) -> dict[int, np.ndarray]:
        """As ``_pieces`` for one long row: hashes of each length by as many steps as it has bytes."""
        values, out, h = row.astype(np.uint64) + np.uint64(1), {}, np.zeros(len(row) + 1, np.uint64)
        for k in range(1, min(self.lengths[-1], len(row)) + 1):
            h = h[: len(row) - k + 1] * FACTOR + values[k - 1 :]
            if k in self.power:
                out[k] = self._find(h)
        return out

    def _sweep(self, text: bytes, logs: np.ndarray) -> float:
        """Log weight of one long word, a stretch at a time: the sums of the last places only are kept."""
        reach = self.lengths[-1]
        alpha = [0.0]
        for begin in range(0, len(text), STRETCH):
            for ends in self._matches(text, begin, min(len(text), begin + STRETCH)):
                parts = [alpha[-k] + logs[p] for k, p in ends]
                top = max(parts)
                alpha.append(top + math.log(sum(math.exp(x - top) for x in parts)))
            alpha = alpha[-reach:]
        return alpha[-1]

    def expected(self, words: list[bytes], counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the segmentations of the words, each counted so many times.

        Words of LONG bytes and more are taken in windows: only pieces across the borders of windows are missed, and
        only here; ``scores`` takes them whole.
        """
        weights, total = np.append(logs, -np.inf), np.zeros(self.n + 1)
        short, more = [], []
        for i, w in enumerate(words):
            cut = [w] if len(w) < LONG else [w[j : j + LONG - 1] for j in range(0, len(w), LONG - 1)]
            short += cut
            more += [i] * len(cut)
        counts = np.asarray(counts, np.float64)[np.array(more, np.int64)] if short else np.zeros(0)
        for at, sizes, bytes_ in self._groups(short):
            found, width = self._pieces(bytes_), bytes_.shape[1]
            alpha, column = self._forward(found, weights, width), np.arange(len(at))
            beta = np.full((width + 1, len(at)), -np.inf)
            beta[sizes, column] = 0
            for s in range(width - 1, -1, -1):
                parts = [beta[s + k] + weights[found[k][:, s]] for k in found if s + k <= width]
                inside = s < sizes
                beta[s, inside] = self._added([p[inside] for p in parts])
            scale = np.log(counts[at]) - alpha[sizes, column]
            for k, numbers in found.items():
                for s in range(numbers.shape[1]):
                    hit = numbers[:, s] != self.n
                    hit &= s + k <= sizes
                    np.add.at(total, numbers[hit, s], np.exp(alpha[s, hit] + weights[numbers[hit, s]] + beta[s + k, hit] + scale[hit]))
        return total[: self.n]
