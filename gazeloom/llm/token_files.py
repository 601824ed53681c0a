"""Token-ID output: flat unsigned-integer files with 64-bit document offsets.

A data set is a folder of parts in ascending document order. Part ``k`` has

* ``part-k.bin``: all token ids, little-endian unsigned 16 or 32 bit,
* ``part-k.idx``: one row per document, two little-endian 64-bit integers: the
  document's id and the offset of its first token inside the part,

and the table ``bases`` gives, per part, the number of documents and tokens and
the prefix sum of the tokens before it, so a document's place in the whole is
base + offset. Readers map the files into memory.

Parts are written under a name of the attempt and renamed, so a task that runs
again after a lost executor replaces a part by the same bytes. Edge cases: null
and empty texts hold only the end id; rows with a null document id come first
and are written with the smallest 64-bit id; repeated document ids keep one
entry per row, in the order of their texts' hashes; an empty table gives no parts;
columns other than id and text are not written.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import slices, text_of
from .bpe import CACHED, CACHED_CHARS, PieceIds, byte_slices, packed_ids

MISSING_ID = -(2**63)
#: Stored bytes of the input that a part is made of, and documents and tokens that a reader holds.
PART_BYTES = 64 << 20
READ_ROWS, READ_TOKENS = 2048, 1 << 21


#: A word of Latin letters with punctuation behind it: lower-casing and composing leave the parts apart.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*]*)")
#: Texts that fall apart into words, digits and runs of signs, each of which ends in one end-of-word token; no apostrophes, which start contractions, and no special tokens ("<|").
_SAFE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ \\n!-&(-@\\[-`{-~]*")
_ATOM = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
#: Words that a worker remembers.
CACHED_WORDS = 800_000


class WordIds(PieceIds):
    """Pieces of a lower-casing tokenizer with word ends; plain words are remembered without case and punctuation."""

    def __init__(self, model, dtype: str, separator: str, mark: str):
        super().__init__(model, dtype, separator, mark)
        self.words: dict[str, bytes] = {}
        vocabulary = model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn_words(self, words: set[str]) -> None:
        if len(self.words) + len(words) > CACHED_WORDS:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        for at in range(0, len(new), 1024):
            part = new[at : at + 1024]
            ids = self.ids(" ".join(part))
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            got = byte_slices(ids, [0, *stops[:-1]], stops) if len(stops) == len(part) else [self.ids(w).tobytes() for w in part]
            self.words.update(zip(part, got, strict=True))

    def pack(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as packed integers."""
        safe = ["<|" not in x and bool(_SAFE.fullmatch(x)) for x in texts]
        rest = iter(packed_ids([x for x, ok in zip(texts, safe, strict=True) if not ok], _cut, self))
        parts = [_ATOM.findall(x.lower()) if ok else next(rest) for x, ok in zip(texts, safe, strict=True)]
        self._learn_words({p for x, ok in zip(parts, safe, strict=True) if ok for p in x})
        get = self.words.__getitem__
        return [b"".join(map(get, x)) if ok else x for x, ok in zip(parts, safe, strict=True)]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        known = self.known
        if len(known) + 2 * len(pieces) > CACHED:
            known.clear()
        split = {p: m.groups() for p in pieces if p not in known and (m := _WORD.fullmatch(p))}
        lowered = {p: word.lower() for p, (word, _) in split.items()}
        self._learn_words({*lowered.values()})
        marks = super().learn({mark for _, mark in split.values() if mark} | {p for p in pieces if p not in split})
        words = self.words
        marks.update([(p, words[lowered[p]] + (marks[mark] if mark else b"")) for p, (_, mark) in split.items()])
        self.long += [p for p in split if len(p) > CACHED_CHARS]
        return marks


#: How a tokenizer file normalises and cuts texts that :class:`WordIds` is made for (fixed values of a public tokenizer).
NORMALISED = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A text with cases, accents, digits, signs, contractions and white space, on which the shortcut has to agree, too.
PROBE = "Hello World, it's NICE! Ünïcödé straße 2024 don't  stop\n\tÀ b-c {x} [y] #1 42% naïve É"


class WholeIds(PieceIds):
    """Whole texts by any tokenizer, one call each."""

    def __init__(self, model, dtype: str):
        self.model, self.dtype = model, dtype

    def pack(self, texts: list[str]) -> list[bytes]:
        return [self.ids(x).tobytes() for x in texts]


def fits_shortcut(path: str) -> bool:
    """Whether a tokenizer file lower-cases, drops white space, and cuts and ends words as :class:`WordIds` takes for granted."""
    fs, at = pafs.FileSystem.from_uri(os.path.abspath(path) if "://" not in path else path)
    with fs.open_input_file(at) as file:
        told = json.loads(file.read())
    steps = [(x["type"], (x.get("pattern") or {}).get("Regex")) for x in (told.get("normalizer") or {}).get("normalizers", [])]
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = [(x["type"], (x.get("pattern") or {}).get("Regex"), x.get("behavior"), x.get("invert")) for x in cuts[:1]]
    bytes_ = [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in cuts[1:]]
    model = told["model"]
    plain = all(x["special"] and x["content"].startswith("<|") for x in told.get("added_tokens", []))
    return steps == NORMALISED and split == [("Split", CUT, "Removed", True)] and bytes_ == [("ByteLevel", False, False)] and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and plain


@lru_cache(maxsize=4)
def _pieces(path: str, dtype: str) -> WordIds | WholeIds:
    """The shortcut where the file is of its kind and a probe text agrees with the library, else whole texts."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    whole = WholeIds(model, dtype)
    if fits_shortcut(path):
        try:
            words = WordIds(model, dtype, " \x01 ", "\x01")
        except ValueError:  # the separator is no token of its own
            return whole
        texts = [PROBE, *PROBE.split()]
        if words.pack(texts) == whole.pack(texts):
            return words
    return whole


def _cut(text: str) -> list[str]:
    # no id ever spans a blank or a line feed in a tokenizer that drops white space
    return text.replace("\n", " ").split(" ")


def _open(folder: str):
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, path


def vocabulary_dtype(tokenizer_path: str) -> str:
    """The smallest unsigned type that holds all ids."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 2**16 else "<u4"


def _plan_bytes(df: DataFrame) -> int:
    """The size that the plan states for its files; 0 where it knows none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 0


def write_token_files(df: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Encode whole texts, append ``end_id``, write the parts; returns the ``bases`` table (one row per part).

    Document ids are whole numbers. Any file of the tokenizers library will do; one that
    lower-cases and drops white space as :func:`fits_shortcut` asks is read word by word.
    The texts are dealt into ranges of ids and sorted inside each (one shuffle).
    """
    spark = df.sparkSession
    dtype = vocabulary_dtype(tokenizer_path)
    parts = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(_plan_bytes(df) / PART_BYTES))
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        pieces = _pieces(tokenizer_path, dtype)
        end = np.asarray([end_id], dtype).tobytes()
        fs, path = _open(folder)
        names = [f"{path}/part-{part:05d}.{x}" for x in ("bin", "idx")]
        tokens = docs = 0
        width = np.dtype(dtype).itemsize
        outs = None
        for batch in slices(batches, text):
            if outs is None:
                outs = [fs.open_output_stream(f"{n}.{attempt}") for n in names]
            rows = []
            for key, ids in zip(batch.column(id_col).to_pylist(), pieces.pack(text_of(batch, text)), strict=True):
                outs[0].write(ids + end)
                rows.append((MISSING_ID if key is None else key, tokens))
                tokens += len(ids) // width + 1
            outs[1].write(np.asarray(rows, "<i8").tobytes())
            docs += len(rows)
        if outs is None:
            return
        for out, name in zip(outs, names, strict=True):
            out.close()
            fs.move(f"{name}.{attempt}", name)
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [docs], "n_tokens": [tokens]}, pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    # the texts' hash parts rows of one id, too, so an id that is repeated often fits
    order = [F.col(id_col), F.xxhash64(text)]
    ordered = df.select(id_col, text).repartitionByRange(parts, *order).sortWithinPartitions(*order, text)
    rows = ordered.mapInArrow(write, "part int, n_docs long, n_tokens long").collect()  # one row per part
    sizes = sorted((r["part"], r["n_docs"], r["n_tokens"]) for r in rows)
    base, table = 0, []
    for part, docs, tokens in sizes:
        table.append((part, docs, tokens, base))
        base += tokens
    bases = spark.createDataFrame(table, "part int, n_docs long, n_tokens long, base long")
    bases.coalesce(1).write.mode("overwrite").parquet(f"{folder}/bases")
    return bases.select("*", F.lit(dtype).alias("dtype"))


class _Integers:
    """The integers of a file: mapped into memory where the file system is local, else read in the ranges that are asked for."""

    def __init__(self, fs, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.file = None if local else fs.open_input_file(path)
        self.all = (np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)) if local else None
        self.size = len(self.all) if local else self.file.size() // self.dtype.itemsize

    def range(self, a: int, b: int) -> np.ndarray:
        if self.file is None:
            return self.all[a:b]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((b - a) * width, a * width), self.dtype)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _document_rows(index: _Integers, total: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, starts and ends of up to ``READ_ROWS`` documents of about ``READ_TOKENS`` tokens at a time."""
    n = index.size // 2
    at = 0
    while at < n:
        upto = min(at + READ_ROWS, n)
        rows = index.range(2 * at, 2 * min(upto + 1, n)).reshape(-1, 2)
        edges = rows[:, 1] if upto < n else np.append(rows[:, 1], total)
        k = min(upto - at, max(1, int(np.searchsorted(edges, edges[0] + READ_TOKENS))))
        yield rows[:k, 0], edges[:k], edges[1 : k + 1]
        at += k


def read_token_files(spark: SparkSession, folder: str, dtype: str, bases: DataFrame | None = None, with_ids: bool = True) -> DataFrame:
    """Read a folder back: doc_id, start, n_tokens, ids_crc32 and, on request, the ids themselves."""
    bases = bases if bases is not None else spark.read.parquet(f"{folder}/bases")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        for batch in batches:
            for part, base, total in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "n_tokens")), strict=True):
                ids, index = (_Integers(fs, f"{path}/part-{part:05d}.{x}", kind) for x, kind in (("bin", dtype), ("idx", "<i8")))
                for keys, starts, ends in _document_rows(index, total):
                    first = int(starts[0])
                    held = ids.range(first, int(ends[-1]))
                    own = [held[a - first : b - first] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    got = {
                        "doc_id": pa.array([None if k == MISSING_ID else k for k in keys.tolist()], pa.int64()),
                        "start": pa.array(base + starts),
                        "n_tokens": pa.array(ends - starts),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    }
                    if with_ids:
                        got["ids"] = pa.array([x.astype("<i8") for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(got)
                ids.close()
                index.close()

    n = max(1, bases.count())
    one_each = bases.select("part", "base", "n_tokens").repartition(n, F.col("part"))
    return one_each.mapInArrow(read, schema)
