"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

A text is cut into pieces by the tokenizer's pattern, and each distinct piece of a slice of texts is merged
once. The leaves of a piece's tree hold rank and place of each adjacent pair, inner nodes the smaller of their
children, so the root is the leftmost pair of the lowest rank. Merging it changes three leaves and the nodes
above them; when the root holds no rank, nothing can be merged. All short pieces of a slice are worked on at
once, a row of the arrays for each; long ones one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.words import SLICE_BYTES, slices

# The white space of the tokenizer's pattern, and the pattern of its pieces.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^SPACE\p{L}\p{N}]+|[SPACE]+(?![^SPACE])|[SPACE]+".replace("SPACE", _SPACE)
)
#: Pieces of more bytes than this have a tree of their own.
SHORT = 64
#: Bytes of pieces that a worker remembers; it forgets them all when there are more.
REMEMBERED = 4 << 20
_NONE = 1 << 62
_PLACES = (1 << 32) - 1


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary: itself, or the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Vocabulary and merges of a byte-level BPE file, and the special tokens that are found in texts."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = _byte_letters()
        self.of_byte = np.zeros(256, np.int64)
        self.bytes: dict[int, bytes] = {}
        for token, number in vocabulary.items():
            if token not in self.special:
                self.bytes[number] = bytes(letters[c] for c in token)
                if len(self.bytes[number]) == 1:
                    self.of_byte[self.bytes[number][0]] = number
        self.bytes |= {number: token.encode() for token, number in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = np.append(keys[order], _NONE), order, merged
        self.of_pair = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        # the bytes of all tokens in one array
        size = max(self.bytes, default=-1) + 1
        self.token_bytes = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(size)), np.uint8)
        self.token_sizes = np.array([len(self.bytes.get(i, b"")) for i in range(size)], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.forget()

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; special tokens are pieces of their own."""
        if self.split is None or not any(t in text for t in self.special):
            return PIECES.findall(text)
        return [p for part in self.split.split(text) for p in ([part] if part in self.special else PIECES.findall(part))]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, ``_NONE`` where they don't merge."""
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        hit = self.keys[at] == keys
        out = np.full(len(keys), _NONE)
        out[hit] = self.ranks[at[hit]]
        return out

    def _merge_short(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merge pieces of at most ``SHORT`` bytes, all at once: the ids of all in one array, and how many each has."""
        n, width = len(rows), 1
        while width < max(map(len, rows)):
            width *= 2
        sizes = np.array([len(r) for r in rows])
        tokens = np.zeros((n, width + 2), np.int64)
        flat = self.of_byte[np.frombuffer(b"".join(rows), np.uint8)]
        row = np.repeat(np.arange(n), sizes)
        tokens[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        place = np.arange(width + 2)
        after = np.where(place[None, :] + 1 < sizes[:, None], place + 1, width + 1)
        before = np.broadcast_to(place - 1, (n, width + 2)).copy()
        tree = np.full((n, 2 * width), _NONE)
        row, at = np.nonzero(after[:, :width] <= width)
        rank = self._rank(tokens[row, at], tokens[row, at + 1])
        tree[row, width + at] = np.where(rank == _NONE, _NONE, rank << 32 | at)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        alive = np.ones((n, width), bool) & (place[:width] < sizes[:, None])
        root = 1 if width > 1 else 0
        row = np.flatnonzero(tree[:, root] < _NONE)
        while len(row):
            top = tree[row, root]
            left = top & _PLACES
            right = after[row, left]
            tokens[row, left] = self.merged[top >> 32]
            alive[row, right] = False
            beyond, ahead = after[row, right], before[row, left]
            after[row, left] = beyond
            before[row, beyond] = left
            self._leaf(tree, width, row, right, np.full(len(row), _NONE))
            rank = np.where(beyond <= width, self._rank(tokens[row, left], tokens[row, beyond]), _NONE)
            self._leaf(tree, width, row, left, np.where(rank == _NONE, _NONE, rank << 32 | left))
            some = ahead >= 0
            r, a = row[some], ahead[some]
            rank = self._rank(tokens[r, a], tokens[r, left[some]])
            self._leaf(tree, width, r, a, np.where(rank == _NONE, _NONE, rank << 32 | a))
            row = row[tree[row, root] < _NONE]
        return tokens[:, :width][alive].astype(np.uint32), alive.sum(axis=1)

    @staticmethod
    def _leaf(tree: np.ndarray, width: int, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        """Set a leaf in each row and the nodes above it."""
        node = width + place
        tree[row, node] = value
        node = node >> 1
        while width > 1 and node.size and node[0] >= 1:
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            node = node >> 1

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Merge one piece with a tree in a list."""
        n = len(piece)
        tokens = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        width = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * width)

        def leaf(i: int) -> int:
            rank = self.of_pair.get(tokens[i] << 32 | tokens[after[i]]) if after[i] < n else None
            return _NONE if rank is None else rank << 32 | i

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        for i in range(n):
            tree[width + i] = leaf(i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < _NONE:
            left = tree[1] & _PLACES
            right = after[left]
            tokens[left] = int(self.merged[tree[1] >> 32])
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            put(right, _NONE)
            put(left, leaf(left))
            if before[left] >= 0:
                put(before[left], leaf(before[left]))
        out, i = [], 0
        while i < n:
            out.append(tokens[i])
            i = after[i]
        return np.array(out, np.uint32)

    def forget(self) -> None:
        """Drop all merged pieces but the special tokens."""
        #: Place of each known piece in ``sizes`` and ``starts``; its ids are a stretch of ``ids``.
        self.known = {t: i for i, t in enumerate(self.special)}
        self.ids = np.array([*self.special.values()], np.uint32)
        self.sizes = np.ones(len(self.special), np.int64)
        self.starts = np.arange(len(self.special))
        self.held = 0

    def _learn(self, pieces: set[str]) -> None:
        """Merge pieces that aren't known yet."""
        names, ids, sizes = [], [self.ids], [self.sizes]
        short: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            self.held += len(raw)
            if len(raw) > SHORT:
                names.append(piece)
                ids.append(self._merge_long(raw))
                sizes.append(np.array([len(ids[-1])]))
            else:
                short.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for group in short.values():
            merged, counts = self._merge_short([raw for _, raw in group])
            names += [piece for piece, _ in group]
            ids.append(merged)
            sizes.append(counts)
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        cut = [self.pieces(t) for t in texts]
        everything = set().union(*cut)
        if self.held > REMEMBERED:
            self.forget()
        if new := everything - self.known.keys():
            self._learn(new)
        counts = np.array([len(c) for c in cut], np.int64)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        ids, ends = _stretches(self.ids, self.starts[at], self.sizes[at])
        return np.split(ids, ends[np.cumsum(counts)])[:-1]

    def decode(self, texts: list[np.ndarray]) -> list[str]:
        """The texts of token ids, special tokens too; bytes that are no UTF-8 become replacement characters."""
        ids = np.concatenate([*texts, np.zeros(0, np.uint32)])
        data, ends = _stretches(self.token_bytes, self.token_starts[ids], self.token_sizes[ids])
        raw = data.tobytes()
        borders = ends[np.cumsum([0, *map(len, texts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in pairwise(borders)]


def _stretches(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of an array one after another, and where each begins there (one entry more)."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The tokenizer of a file, once in a worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        texts = batch.column("_text")
        for first, last, _, _ in slices(texts, 2 * SLICE_BYTES):
            ids = bpe.encode([t or "" for t in texts.slice(first, last - first).to_pylist()])
            part = batch.slice(first, last - first)
            rest = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in rest),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                    pa.array(bpe.decode(ids), pa.string()),
                ],
                names=[*rest, "n_tokens", "ids", "decoded"],
            )
    # the worker lives on, and other steps need its memory
    bpe.forget()


def encode(documents: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with n_tokens, ids and the decoded text of every whole text, one row for each row.

    ``ids`` are little-endian unsigned integers of 32 bits. Strings of special tokens in a text are these tokens.
    A null text is an empty one, with no ids and an empty decoded text; null ids and repeated rows are kept; other
    columns are ignored; no documents give no rows. ``tokenizer`` is a file that every executor has at this path.
    """
    rows = documents.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(partial(_encode, path=tokenizer), f"{kinds}, n_tokens long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded documents."""
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
