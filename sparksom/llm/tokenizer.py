"""Byte-pair encoding with a segment tree over adjacent pair ranks.

A piece of text starts as its bytes. A segment tree over the adjacent pairs holds each
pair's merge rank (with its position, so the root is the leftmost pair of the lowest
rank); merging the root's pair changes three leaves, each a logarithmic walk to the root,
until the root says that no mergeable pair remains. Short pieces, nearly all, go through
the tree many at a time: the trees of all new pieces of a batch are the rows of one NumPy
array, and a step merges one pair in every row. Long pieces go through a tree of their
own, so a piece of n bytes costs O(n log n), however long a run without blanks is.

The vocabulary is a file of public ranks (one ``base64 rank`` per line); its path is a
parameter and every Python worker reads it once.
"""
from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pieces up to this many bytes are encoded many at a time.
SHORT = 64
#: Encoded pieces that a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 300_000
#: Characters that are split and looked up at once.
SLICE_CHARS = 1 << 20
_NONE = np.int64(1) << 60


#: The code points with the Unicode property White_Space, as ranges.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
               (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
OTHER, LETTER, NUMBER, WHITE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of every code point, whether it is a letter, a number, white space or another."""
    initials = "".join(unicodedata.category(chr(cp))[0] for cp in range(sys.maxunicode + 1))
    initials = np.frombuffer(initials.encode("ascii"), np.uint8)
    table = np.where(initials == ord("L"), LETTER, np.where(initials == ord("N"), NUMBER, OTHER)).astype(np.uint8)
    for first, last in WHITE_SPACE:
        table[first:last + 1] = WHITE
    return table


def split_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pieces begin that the vocabulary's published pattern splits texts into.

    ``points`` are the code points of several texts in a row. The pattern takes, at each
    place, a contraction (``'s 't 're 've 'm 'll 'd``), or a run of letters, of numbers or
    of other signs with the space before it, or a run of white space without its last
    character where something follows. That is: a piece begins where the class of
    character changes; the last white character before something else begins one, too,
    and draws what follows into it if it is a plain space; an apostrophe that begins a
    piece and stands alone draws in the letters of a contraction.
    """
    n = len(points)
    kind = _classes()[points]
    fresh = np.zeros(n + 3, bool)  # first character of a text; padded, as the places after the end
    fresh[text_starts[text_starts < n]] = True
    fresh[n:] = True
    changes = fresh[:n].copy()
    changes[1:] |= kind[1:] != kind[:-1]
    starts = changes.copy()
    white = kind == WHITE
    last_white = np.flatnonzero(white[:-1] & ~white[1:] & ~fresh[1:n])
    starts[last_white] = True
    starts[last_white[points[last_white] == 0x20] + 1] = False
    alone = np.flatnonzero((points[:-1] == 0x27) & starts[:-1] & changes[1:] & (kind[1:] == LETTER) & ~fresh[1:n])
    if len(alone):
        padded = np.append(points[alone[0]:], [0, 0, 0])
        one, two = padded[alone - alone[0] + 1], padded[alone - alone[0] + 2]
        two = np.where(fresh[alone + 2], 0, two)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, width in ((alone[single], 2), (alone[double], 3)):
            starts[found + 1] = False
            cut = found + width
            starts[cut[cut < n]] = True
    return np.flatnonzero(starts)


class _Index(dict):
    """Numbers the pieces in the order of their first look-up; ``new`` are those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class BytePairEncoder:
    """Encodes text with one vocabulary; use :func:`encoder`, which keeps one per worker."""

    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        if max(ranks.values()) >= 1 << 24:
            raise ValueError("ranks must be below 2**24")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # A pair may be merged where its joined bytes are a token; the token's rank is its id.
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 24 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pairs = pairs
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(values[order], -1)
        self._forget()

    # -- pieces ---------------------------------------------------------------------

    @staticmethod
    def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The pieces of the texts in a row, and how many pieces precede each text's end."""
        whole = "".join(texts)
        if not whole:
            return [], np.zeros(len(texts), np.int64)
        ends = np.cumsum([len(t) for t in texts])
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = split_starts(points, np.concatenate(([0], ends[:-1])))
        at = starts.tolist()
        return [whole[i:j] for i, j in zip(at, [*at[1:], len(whole)])], np.searchsorted(starts, ends)

    def _learn(self) -> None:
        """Encodes the pieces that were looked up and not known."""
        by_size: dict[int, list[int]] = {}
        raws = [piece.encode("utf-8", "surrogatepass") for piece in self.index.new]
        for i, raw in enumerate(raws):
            leaves = 0 if len(raw) > SHORT else max(2, 1 << (len(raw) - 1).bit_length())
            by_size.setdefault(leaves, []).append(i)
        base = len(self.index) - len(raws)
        while len(self.first) < len(self.index):
            self.first, self.size = np.tile(self.first, 2), np.tile(self.size, 2)
        for leaves, group in by_size.items():
            for at in range(0, len(group), 4096):
                part = group[at:at + 4096]
                if leaves:
                    ids, sizes = self.encode_short([raws[i] for i in part], leaves)
                else:
                    lists = [self.encode_long(raws[i]) for i in part]
                    ids, sizes = np.array(list(chain.from_iterable(lists))), np.array([len(x) for x in lists])
                while self.used + len(ids) > len(self.flat):
                    self.flat = np.tile(self.flat, 2)
                places = base + np.array(part)
                self.first[places] = self.used + np.cumsum(sizes) - sizes
                self.size[places] = sizes
                self.flat[self.used:self.used + len(ids)] = ids
                self.used += len(ids)
        self.index.new.clear()

    def _forget(self) -> None:
        self.index = _Index()
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    # -- many short pieces: a tree per row --------------------------------------------

    def _pair_values(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, leaves: int) -> np.ndarray:
        """Leaf values: rank and position of a mergeable pair, else a value above all."""
        key = left << 24 | right
        found = np.searchsorted(self.pair_keys, key)
        rank = self.pair_ranks[found]
        good = (self.pair_keys[found] == key) & (left >= 0) & (right >= 0)
        return np.where(good, rank * leaves + at, _NONE)

    def encode_short(self, raws: list[bytes], leaves: int) -> tuple[np.ndarray, np.ndarray]:
        count = len(raws)
        lengths = np.array([len(r) for r in raws])
        padded = np.frombuffer(b"".join(r.ljust(leaves, b"\0") for r in raws), np.uint8).reshape(count, leaves)
        spot = np.arange(leaves)
        ids = np.where(spot < lengths[:, None], self.byte_ids[padded], -1)
        # Column `leaves` stands for "beyond the end": its id is -1, it is its own neighbour.
        ids = np.concatenate([ids, np.full((count, 1), -1)], axis=1)
        right = np.tile(np.append(np.minimum(spot + 1, leaves), leaves), (count, 1))
        right[:, :leaves] = np.where(spot + 1 < lengths[:, None], spot + 1, leaves)
        left = np.tile(np.append(np.where(spot > 0, spot - 1, leaves), leaves), (count, 1))
        tree = np.full((count, 2 * leaves), _NONE)
        next_ids = np.take_along_axis(ids, right[:, :leaves], 1)
        tree[:, leaves:] = self._pair_values(ids[:, :leaves], next_ids, spot, leaves)
        level = leaves
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level = half
        alive = ids[:, :leaves] >= 0
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            root = tree[rows, 1]
            at, rank = root % leaves, root // leaves
            gone = right[rows, at]
            after = right[rows, gone]
            ids[rows, at] = rank
            ids[rows, gone] = -1
            alive[rows, gone] = False
            right[rows, at] = after
            left[rows, after] = at
            left[rows, leaves] = leaves
            before = left[rows, at]
            # Three leaves change: the removed one, the merged one, the one before it.
            tree[rows, leaves + gone] = _NONE
            tree[rows, leaves + at] = self._pair_values(rank, ids[rows, after], at, leaves)
            has = before < leaves
            some, spots = rows[has], before[has]
            tree[some, leaves + spots] = self._pair_values(ids[some, spots], rank[has], spots, leaves)
            three = np.concatenate([rows, rows, some])
            node = np.concatenate([leaves + at, leaves + gone, leaves + spots])
            while node[0] > 1:
                node = node >> 1
                tree[three, node] = np.minimum(tree[three, 2 * node], tree[three, 2 * node + 1])
            rows = rows[tree[rows, 1] < _NONE]
        return ids[:, :leaves][alive], alive.sum(1)

    # -- one long piece: a tree of its own ---------------------------------------------

    def encode_long(self, raw: bytes) -> list[int]:
        n = len(raw)
        leaves = 1 << (n - 1).bit_length()
        none = int(_NONE)
        pairs, ids = self.pairs, self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 24 | ids[i + 1])
            if rank is not None:
                tree[leaves + i] = rank * leaves + i
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = leaves + i
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                best = value if value < other else other
                if tree[node] == best:
                    return
                tree[node] = value = best

        while tree[1] < none:
            rank, at = divmod(tree[1], leaves)
            gone = right[at]
            after = right[gone]
            ids[at], ids[gone], right[at] = rank, -1, after
            put(gone, none)
            joined = None
            if after < n:
                left[after] = at
                joined = pairs.get(rank << 24 | ids[after])
            put(at, none if joined is None else joined * leaves + at)
            before = left[at]
            if before >= 0:
                joined = pairs.get(ids[before] << 24 | rank)
                put(before, none if joined is None else joined * leaves + before)
        return [i for i in ids if i >= 0]

    # -- texts ------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many ids precede each text's end."""
        places, piece_ends, sizes = self._look_up(texts)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.first[places] - (ends - sizes), sizes) + np.arange(total)
        return self.flat[at], np.concatenate(([0], ends))[piece_ends]

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        _, piece_ends, sizes = self._look_up(texts)
        return np.diff(np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], piece_ends))])

    def _look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.index) > REMEMBERED:
            self._forget()
        pieces, piece_ends = self.pieces(texts)
        places = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        if self.index.new:
            self._learn()
        return places, piece_ends, self.size[places]


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(path)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``SLICE_CHARS`` characters (or one row)."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        width = len(text) if text else 0
        if i > begin and size + width > SLICE_CHARS:
            yield begin, i
            begin, size = i, 0
        size += width
    if begin < len(texts):
        yield begin, len(texts)


def encode_column(df: DataFrame, text: str, vocabulary: str, out: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` in its place, as column ``out`` (a list of integers).

    No special tokens: their strings in a text are ordinary text. A null text gives null,
    an empty text an empty list. Texts are encoded whole, whatever their length. The
    other columns pass through, but for one already named ``out``, which is replaced;
    repeated rows stay, an empty table stays empty; nothing is shuffled.
    """
    names = [c for c in df.columns if c not in (text, out)]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + f", `{out}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            column = batch.column(text)
            texts = column.to_pylist()
            for i, j in _slices(texts):
                ids, ends = bpe.encode_texts([t or "" for t in texts[i:j]])
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                null = column.slice(i, j - i).is_null() if column.null_count else None
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids), mask=null)
                others = [batch.column(c).slice(i, j - i) for c in names]
                yield pa.RecordBatch.from_arrays([*others, lists], [*names, out])

    return df.select(*names, text).mapInArrow(run, schema)


def token_counts(df: DataFrame, keep: list[str], text: str, vocabulary: str, out: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text`` (null for a null text)."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, j in _slices(texts):
                counts = bpe.count_texts([t or "" for t in texts[i:j]])
                null = np.array([t is None for t in texts[i:j]], bool)
                others = [batch.column(c).slice(i, j - i) for c in keep]
                yield pa.RecordBatch.from_arrays([*others, pa.array(counts, pa.int64(), mask=null)], [*keep, out])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
