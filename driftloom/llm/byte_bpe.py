"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The merges are worked out once on the driver from a rank file (the vocabulary alone bounds its size) and sent as one
tokenizer definition. Bytes stand as characters in the library's vocabulary by the usual byte table. The known pattern always ends a match
before a space that follows something else than white space, so texts are cut there: the library encodes every distinct piece of
a batch once, and a text's ids are its pieces' ids in a row, whatever its length; with any other pattern texts are encoded whole. Decoding
joins the tokens' characters by id and reverses the byte table over them, so characters that are split over tokens come out whole.

Defined cases: null text encodes as empty, no ids; special tokens' strings are ordinary text; null id lists
decode to empty, ids outside the vocabulary (or null) to U+FFFD; decoded as text, bytes that are no character are U+FFFD. Columns named like the outputs are replaced, others pass through.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import binary, over_batches, replaced

#: Pieces of a generation that a worker remembers, pieces that the library gets at once, characters whose pieces are looked up, or bytes that are decoded, together.
KNOWN, AT_ONCE, SLICE = 3 << 16, 1 << 12, 1 << 19
#: Fixed value: the pattern whose matches pieces_of() knows not to cut.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with white space, in the widest sense, before a space need a closer look.
LOOSE, LOOSE_END = re.compile(r"^ |[\s\x00-\x20\u200b-\u200f\u2028-\u202f\u180e\ufeff] "), re.compile(r"[\s\x00-\x20\u200b-\u200f\u2028-\u202f\u180e\ufeff]$")


def byte_chars() -> list[str]:
    """The byte table: printable bytes stand for themselves, the others for the characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def chars_of(data: bytes) -> str:
    """Bytes as the characters that stand for them."""
    table = byte_chars()
    return "".join(table[x] for x in data)


#: The byte table reversed: the byte of each character below 512.
BYTE_OF = np.zeros(512, np.uint8)
for _byte, _char in enumerate(byte_chars()):
    BYTE_OF[ord(_char)] = _byte


def bytes_of(utf8: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the byte table, as UTF-8 of one or two bytes each, to the bytes that they stand for, SLICE by SLICE; and where the
    ascending places `marks` of the UTF-8, each the begin of a character or the end, lie among these."""
    out, at, start, done = [np.zeros(0, np.uint8)], np.zeros(len(marks), np.int32), 0, 0
    while start < len(utf8):
        end = min(start + SLICE, len(utf8))
        end += int(end < len(utf8) and utf8[end] & 0xC0 == 0x80)  # not within a character
        part = utf8[start:end]
        begin = np.flatnonzero((part >= 0xC0) | (part < 0x80)).astype(np.int32)
        codes = part[begin].astype(np.int16)
        wide = np.flatnonzero(codes >= 0xC0)
        codes[wide] = (codes[wide] & 0x1F) << 6 | part[begin[wide] + 1] & 0x3F
        out.append(BYTE_OF[codes])
        lo, hi = np.searchsorted(marks, [start, end])
        at[lo:hi] = done + np.searchsorted(begin, marks[lo:hi] - start)
        start, done = end, done + len(begin)
    at[np.searchsorted(marks, len(utf8)) :] = done
    return np.concatenate(out), at


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that are merged last into token when only lower ranks are used."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank >= ranks[token]:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    merges = [tuple(map(chars_of, m)) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1 and (m := last_merge(t, ranks))]
    made = Tokenizer(models.BPE(vocab={chars_of(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made.to_str()


class Encoder:
    """The library's tokenizer with a bounded memory of pieces (two generations of KNOWN); a worker makes its own."""

    def __init__(self, definition: str, cut: bool = True):
        self.pieces = pieces_of if cut else lambda text: [text]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker for each core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_str(definition), {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out, start, size = [], 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= SLICE or k == len(texts) - 1:
                out += self._encode(texts[start : k + 1])
                start, size = k + 1, 0
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        known, older, cut = self.known, self.older, [self.pieces(t) for t in texts]
        new = []
        for piece in set().union(*cut).difference(known):
            if piece in older:
                known[piece] = older[piece]
            else:
                new.append(piece)
        for at in range(0, len(new), AT_ONCE):
            part = new[at : at + AT_ONCE]
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[piece] = array("i", e.ids).tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32) for pieces in cut]


def pieces_of(text: str) -> list[str]:
    """Cuts before each space that follows something else than white space."""
    first, *rest = text.split(" ")
    if not LOOSE.search(text):
        return [first, *[" " + x for x in rest]]
    out = [first]
    for x in rest:
        if out[-1] and not LOOSE_END.search(out[-1]):
            out.append(" " + x)
        else:
            out[-1] += " " + x
    return out


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), kind))


def char_starts(data: bytes, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The character in which each token begins: byte offsets through the byte-to-character map."""
    starts = np.cumsum(sizes[ids]) - sizes[ids]
    first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return (np.cumsum(first) - 1)[starts].astype(np.int32) if len(ids) else np.zeros(0, np.int32)


class ByteBpe:
    """An encoder and decoder by the ranks in a file and the pattern that cuts texts before merging."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.definition, self.cut = tokenizer_json(ranks, pattern), pattern == CUT_PATTERN
        self.sizes = np.full(max(ranks.values(), default=-1) + 2, 3, np.int64)  # bytes of each token; the last stands for unknown ids
        self.tokens = [chars_of(b"\xef\xbf\xbd")] * len(self.sizes)  # as the vocabulary has them
        for token, rank in ranks.items():
            self.tokens[rank], self.sizes[rank] = chars_of(token), len(token)

    def _encoding(self, spark: SparkSession, schema: T.StructType) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        sent = spark.sparkContext.broadcast((self.definition, self.cut, self.sizes))
        made: list[Encoder] = []

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            data = binary(batch.column("text"))
            definition, cut, sizes = sent.value
            if not made:
                made.append(Encoder(definition, cut))
            ids = made[0].encode([d.decode("utf-8", "replace") for d in data])
            new = {"ids": lists(ids, pa.int32())}
            if "starts" in schema.names:
                new["starts"] = lists([char_starts(d, i, sizes) for d, i in zip(data, ids, strict=True)], pa.int32())
            return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in schema.names], names=schema.names)

        return run

    def _decoding(self, spark: SparkSession, schema: T.StructType, text: bool = False) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        sent = spark.sparkContext.broadcast(self.tokens)
        table: list[pa.Array] = []

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not table:
                table.append(pa.array(sent.value, pa.string()))
            column, last = batch.column("ids"), len(table[0]) - 1
            ends = np.cumsum(np.concatenate([[0], column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])).astype(np.int64)
            ids = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            ids = np.where((ids < 0) | (ids >= last), last, ids)
            decoded = pa.array([b""] * batch.num_rows, pa.binary())
            if len(ids):
                joined = table[0].take(pa.array(ids, pa.int32()))
                offsets = np.frombuffer(joined.buffers()[1], np.int32)[: len(ids) + 1]
                data, at = bytes_of(np.frombuffer(joined.buffers()[2], np.uint8)[: offsets[-1]], offsets[ends])
                decoded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at), pa.py_buffer(data)])
            if text:
                decoded = pa.array([d.decode("utf-8", "replace") for d in decoded.to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([decoded if n == "decoded" else batch.column(n) for n in schema.names], names=schema.names)

        return run

    @staticmethod
    def _schema(docs: DataFrame, offsets: bool) -> T.StructType:
        ints = T.ArrayType(T.IntegerType())
        return replaced(docs, ids=ints, **({"starts": ints} if offsets else {}))

    @staticmethod
    def _without(docs: DataFrame, schema: T.StructType, *new: str) -> DataFrame:
        return docs.select(*(f"`{n}`" for n in schema.names if n not in new))

    def encode(self, docs: DataFrame, offsets: bool = True) -> DataFrame:
        """docs with ids array<int> and, if asked for, starts array<int> (each token's first character, 0-based)."""
        schema = self._schema(docs, offsets)
        return over_batches(self._without(docs, schema, "ids", *["starts"] * offsets), self._encoding(docs.sparkSession, schema), schema)

    def decode(self, rows: DataFrame, text: bool = False) -> DataFrame:
        """rows (with ids) with decoded binary: the exact bytes; or as text."""
        schema = replaced(rows, decoded=T.StringType() if text else T.BinaryType())
        return over_batches(self._without(rows, schema, "decoded"), self._decoding(rows.sparkSession, schema, text), schema)

    def round_trip(self, docs: DataFrame, offsets: bool = False) -> DataFrame:
        """decode(encode(docs)) in one pass: a batch goes through both in the same worker."""
        first = self._schema(docs, offsets)
        second = T.StructType([*(f for f in first if f.name.lower() != "decoded"), T.StructField("decoded", T.BinaryType())])
        encode, decode = self._encoding(docs.sparkSession, first), self._decoding(docs.sparkSession, second)
        return over_batches(self._without(docs, first, "ids", *["starts"] * offsets), lambda batch: decode(encode(batch)), second)
