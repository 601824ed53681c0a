"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file gives token bytes by id. The library wants pairs to merge, so the
pair of every token is found again: merging the token's own bytes by rank ends in
exactly two parts, and these are its pair.

Edge cases: a null text counts as empty and gets no ids; ids outside the table
decode to nothing; a token that starts or ends inside a character gets the
offsets of the whole character; input columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, text_of

#: Unicode White_Space, the class that \s stands for in the split pattern.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The split pattern that PIECES is made for (a fixed value of public tokenizers); with any other one whole texts go to the library.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cuts a text only where the split pattern always ends a match, so pieces can be looked up separately.
PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Pieces whose ids a worker remembers, and the longest that it remembers.
CACHED, CACHED_CHARS = 200_000, 40


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one above 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merge_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks)))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str):
    """A tokenizers BPE model with the ids of the rank file; each match of ``pattern`` is merged separately."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_chars()
    shown = lambda token: "".join(chars[b] for b in token)
    merges = [tuple(map(shown, merge_pair(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    out = Tokenizer(models.BPE(vocab={shown(t): i for t, i in ranks.items()}, merges=merges))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def byte_slices(ids: np.ndarray, starts: list[int], ends: list[int]) -> list[bytes]:
    """The bytes of ids[start:end] for each start and end."""
    raw, width = ids.tobytes(), ids.itemsize
    return [raw[a * width : b * width] for a, b in zip(starts, ends, strict=True)]


class PieceIds:
    """Ids of text pieces as packed bytes; frequent pieces are encoded once per worker.

    New pieces go to the library many at a time as one text, with a separator between
    them that is a token of its own and never part of another; its id cuts the result.
    """

    def __init__(self, model, dtype: str, separator: str, mark: str):
        self.model, self.dtype, self.separator, self.mark, self.known = model, dtype, separator, mark, {}
        self.long: list[str] = []
        (self.cut,) = self.ids(mark)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        ids = self.ids(self.separator.join(pieces))
        at = np.flatnonzero(ids == self.cut)
        if len(at) != len(pieces) - 1:
            return [self.ids(p).tobytes() for p in pieces]
        return byte_slices(ids, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)])

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        known = self.known
        for p in self.long:
            known.pop(p, None)
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > CACHED:
            known.clear()
            new = list(pieces)
        plain = [p for p in new if self.mark not in p and not p.isspace()]
        got = [(p, self.ids(p).tobytes()) for p in new if self.mark in p or p.isspace()]
        for at in range(0, len(plain), 1024):
            got += zip(plain[at : at + 1024], self._encode(plain[at : at + 1024]), strict=True)
        known.update(got)
        self.long = [p for p in new if len(p) > CACHED_CHARS]
        return known


def packed_ids(texts: list[str], cut, pieces: PieceIds) -> list[bytes]:
    """Each text's ids as packed integers; ``cut`` splits a text into pieces."""
    parts = [cut(x) for x in texts]
    ids = pieces.learn({p for x in parts for p in x})
    return [b"".join(map(ids.__getitem__, x)) for x in parts]


def char_offsets(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end character of each token, given the tokens' sizes in bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return char_of[ends - sizes], char_of[ends - 1] + 1


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else [], kind))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Add ``ids array<int>`` and ``n_split int`` (tokens that cut a character); with ``offsets`` also ``starts`` and ``ends`` in characters.

    A narrow map without a shuffle: each task holds one piece of a batch.
    """
    added = [("ids", T.ArrayType(T.IntegerType(), False)), ("n_split", T.IntegerType())] + [(x, T.ArrayType(T.IntegerType(), False)) for x in ("starts", "ends") if offsets]
    kept = [c for c in df.columns if c not in {n for n, _ in added}]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, k) for n, k in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _shared_pieces(ranks_path, pattern)
        size_of, cuts = _token_sizes(ranks_path, pattern)
        for batch in slices(batches, text):
            texts = text_of(batch, text)
            ids = [np.frombuffer(x, "<i4") for x in packed_ids(texts, PIECES.findall, pieces)] if pattern == SPLIT_PATTERN else [pieces.ids(x) for x in texts]
            out = [_lists(ids, pa.int32()), pa.array([int(cuts[i].sum()) for i in ids], pa.int32())]
            if offsets:
                places = [char_offsets(x, size_of[i]) for x, i in zip(texts, ids, strict=True)]
                out += [_lists([p[k] for p in places], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + out, names=kept + [n for n, _ in added])

    return df.mapInArrow(run, schema)


@lru_cache(maxsize=4)
def _shared_pieces(path: str, pattern: str) -> PieceIds:
    return PieceIds(tokenizer(path, pattern), "<i4", "\n", "\n")


@lru_cache(maxsize=4)
def _token_table(path: str, pattern: str = SPLIT_PATTERN) -> dict[int, bytes]:
    """Token bytes by id: the characters of the tokenizer's vocabulary through the reversed byte table."""
    back = {c: b for b, c in enumerate(byte_chars())}
    return {i: bytes(back[c] for c in shown) for shown, i in tokenizer(path, pattern).get_vocab().items()}


def cuts_character(token: bytes) -> bool:
    """Whether a token starts or ends inside a character: no text of whole characters has its bytes."""
    try:
        token.decode()
    except UnicodeDecodeError:
        return True
    return False


@lru_cache(maxsize=4)
def _token_sizes(path: str, pattern: str = SPLIT_PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """By id: bytes of the token, and whether it cuts a character."""
    table = _token_table(path, pattern)
    out, cuts = np.zeros(max(table) + 1, np.int64), np.zeros(max(table) + 1, bool)
    for i, token in table.items():
        out[i], cuts[i] = len(token), cuts_character(token)
    return out, cuts


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", keep_ids: bool = True, as_text: bool = True) -> DataFrame:
    """Add ``decoded binary`` (the tokens' bytes) and, with ``as_text``, ``decoded_text string``.

    Bytes are joined before they become text, so characters that several tokens
    share come back whole; what is still no UTF-8 (ids cut off inside a
    character) becomes U+FFFD. Null ids give empty bytes.
    """
    names = ["decoded", "decoded_text"]
    kept = [c for c in df.columns if c not in names and (keep_ids or c != ids)]
    names = names[: 1 + as_text]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, k) for n, k in zip(names, (T.BinaryType(), T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_table(ranks_path)
        get = lambda i: table.get(i, b"")
        dense = [get(i) for i in range(max(table) + 1)]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = []
                for row in part.column(ids):
                    flat = row.values.to_numpy(zero_copy_only=False) if row.is_valid else []
                    if len(flat) and (flat.min() < 0 or flat.max() >= len(dense)):
                        raw.append(b"".join(map(get, flat.tolist())))
                    else:
                        raw.append(b"".join(map(dense.__getitem__, flat.tolist() if len(flat) else ())))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(raw, pa.binary())] + ([pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())] if as_text else []), names=kept + names)

    return df.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode whole texts and reduce both to digests."""
    both = decode(encode(df.select(id_col, text), ranks_path, pattern, text).drop(text), ranks_path, as_text=False)
    return both.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_split",
    )
