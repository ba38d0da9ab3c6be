"""Byte-pair encoding with a public vocabulary.

A text is cut into pieces by the vocabulary's pattern. Each piece is merged on
a segment tree: leaf i holds the rank of the pair that starts at symbol i, an
inner node the smaller of its children with the left one first, so the root is
the leftmost pair of lowest rank. A merge changes at most three leaves, each
updated in logarithmic time, until no pair is left that the vocabulary knows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.operators.arrowmap import arrow_map
from millrace.session import spread

#: Folder of the vocabulary files; they are read there and never copied.
TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
# Fixed value: how this family of vocabularies cuts a text into pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a task. A full memory is emptied; results don't depend on it.
REMEMBERED = 1 << 18
_NONE = 1 << 62


def read_ranks(path: str | Path) -> dict[bytes, int]:
    """Token bytes with their ids, which are also the ranks of their merges."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece, by merging its bytes on a segment tree."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    symbols: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get

    def pair(i: int) -> int:
        """Rank << 32 | position of the pair at ``i``, so that the minimum is
        the leftmost of the lowest rank."""
        j = after[i]
        r = get(symbols[i] + symbols[j]) if j < n else None
        return _NONE if r is None else r << 32 | i

    size = 1 << max(0, (n - 2).bit_length())
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = pair(i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def update(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                return  # nothing above depends on the change
            tree[k] = low

    while (root := tree[1]) < _NONE:
        i = root & 0xFFFFFFFF
        j = after[i]
        symbols[i] += symbols[j]
        symbols[j] = None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        update(i, pair(i))
        if j < n - 1:
            update(j, _NONE)
        if before[i] >= 0:
            update(before[i], pair(before[i]))
    return [ranks[s] for s in symbols if s is not None]


class Encoder:
    """Encodes texts; special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self._find = regex.compile(pattern).findall
        self._known: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else tuple(merge_piece(raw, self.ranks))
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        if len(piece) <= 64:
            self._known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; [] for null and empty texts."""
        out: list[int] = []
        known = self._known
        for piece in self._find(text or ""):
            out.extend(known.get(piece) or self._piece(piece))
        return out

    def count(self, text: str | None) -> int:
        known = self._known
        return sum(len(known.get(piece) or self._piece(piece)) for piece in self._find(text or ""))


def make_encoder(tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = BYTE_BPE_50K) -> Callable[[], Encoder]:
    """An encoder to be built in each task from the files on its machine."""
    path = str(Path(tokenizer_dir) / vocabulary)
    return lambda: Encoder(read_ranks(path))


def encode_texts(df: DataFrame, key: str, text: str, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """``(key, ids)``: the token ids of every text, one row per row of ``df``.

    A null or empty text gives an empty list. Null keys and repeated rows are
    kept; other columns are not read. Texts of any length are encoded whole.
    """
    build = make_encoder(tokenizer_dir, vocabulary)

    def setup():
        encode = build().encode

        def run(keys, texts):
            flat, ends = [], [0]
            for t in texts:
                flat.extend(encode(t))
                ends.append(len(flat))
            return keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), type=pa.list_(pa.field("element", pa.int32())))

        return run

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(spread(df.select(key, text)), setup, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """``(key, n_tokens)``: how many ids ``encode_texts`` gives for every text."""
    build = make_encoder(tokenizer_dir, vocabulary)

    def setup():
        count = build().count
        return lambda keys, texts: (keys, [count(t) for t in texts])

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(spread(df.select(key, text)), setup, f"`{key}` {kind}, n_tokens bigint")


def decode_ids(df: DataFrame, key: str, ids: str, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """``(key, text)``: the text of every list of ids; null and empty lists give an empty text."""
    path = str(Path(tokenizer_dir) / vocabulary)

    def setup():
        parts = {i: token for token, i in read_ranks(path).items()}
        return lambda keys, lists: (keys, [b"".join(parts[i] for i in x or ()).decode("utf-8", "surrogatepass") for x in lists])

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(df.select(key, ids), setup, f"`{key}` {kind}, text string")
