"""Encoding and decoding with a SentencePiece BPE model by a prefix table of last pieces.

A merge-type (BPE) encoding has two properties that make it a table look-up. Two neighbouring pieces
can stand side by side if and only if encoding their concatenation gives just the two; and a sequence
whose neighbours all can is the encoding of its text. So each prefix of a text has one last piece: of
all pieces that end there (an Aho-Corasick automaton lists them), the one that can follow the last
piece of the prefix before it. The table holds that piece for each prefix, and the ids are read off
backwards from the end. Pair tests are remembered.

No piece has a space sign after another character, and none has a line feed among others (both are
checked when a model is read), so texts are encoded in chunks cut there, and chunks are remembered up
to a bound. The result is that of the whole text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright.llm._arrow import slices, with_columns
from pipewright.llm._tables import table

SPACE = "▁"
MAX_REMEMBERED = 700_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class _Odd(Exception):
    """A text that the quick way of cutting doesn't fit."""


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class PieceModel:
    """A BPE model with byte fallback, read from its file; encodes and decodes as the library does."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
        self.scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        normal: dict[int, int | bytes] = {}
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3, 1) != 2 or 6 not in self.kinds or {4, 5} & set(self.kinds) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24):
            raise ValueError("only BPE models with byte fallback, no text normalisation and no user-defined pieces")
        self.dummy_prefix = bool(normal.get(3, 1))
        self.bos, self.eos = self.kinds.index(3), self.kinds.index(3, self.kinds.index(3) + 1)
        self.unknown = self.kinds.index(2)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 1}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p and len(p) > 1 for p in self.ids):
            raise ValueError("pieces across words or lines: texts can't be cut there")
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        #: Neighbours inside any piece; between two other characters every encoding has a border.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.single: dict[str, bool] = {}
        self.words = _Remembered(self, SPACE)
        self.starts = _Remembered(self, "")
        self.line_feed = self._packed("\n")
        self.shown = [self._shown(i) for i in range(len(self.pieces))]

    def merged(self, text: str) -> list[str]:
        """Encoding by merging the best pair again and again; only for pair tests, whose texts are short."""
        parts = list(text)
        score, ids = self.scores, self.ids
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                at = ids.get(parts[i] + parts[i + 1])
                if at is not None and (best is None or score[at] > best):
                    best, where = score[at], i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def prefix_table(self, chunk: str) -> list[str | None]:
        """The last piece of each prefix; [0] is None."""
        n = len(chunk)
        last: list[str | None] = [None] * (n + 1)
        ending: list[list[str]] = [[] for _ in range(n)]
        if n > 1:
            for end, piece in self.automaton.iter(chunk):
                ending[end].append(piece)
        pairs, single = self.pairs, self.single
        for end in range(n):
            found = chunk[end]  # a lone character can always end a prefix, where no longer piece does
            for piece in ending[end]:
                start = end + 1 - len(piece)
                if start:
                    key = (last[start], piece)
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) > 2_000_000:
                            pairs.clear()
                        fits = pairs[key] = self.merged(key[0] + piece) == [*key]
                else:
                    fits = single.get(piece)
                    if fits is None:
                        fits = single[piece] = self.merged(piece) == [piece]
                if fits:
                    found = piece
                    break
            last[end + 1] = found
        return last

    def chunk_ids(self, chunk: str) -> list[int]:
        last = self.prefix_table(chunk)
        ids: list[int] = []
        at = len(chunk)
        while at:
            piece = last[at]
            at -= len(piece)
            i = self.ids.get(piece)
            if i is None:
                ids.extend(self.byte_ids[b] for b in reversed(piece.encode()))
            else:
                ids.append(i)
        ids.reverse()
        return ids

    def _packed(self, chunk: str) -> bytes:
        ids = self.chunk_ids(chunk)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_packed(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text, without begin and end."""
        if not text:
            return b""
        try:
            if not self.dummy_prefix or SPACE in text:
                raise _Odd
            out: list[bytes] = []
            word, feed, first = self.words.__getitem__, self.line_feed, True
            for line in text.split("\n"):
                parts = line.split(" ")
                if first:
                    first = False
                    out.extend(map(word, parts))
                    continue
                out.append(feed)
                if parts[0]:
                    out.append(self.starts[parts[0]])
                out.extend(map(word, parts[1:]))
            return b"".join(out)
        except _Odd:  # runs of spaces, at the text's ends or inside, and space signs in the text
            whole = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
            out, known = [], self.starts
            for chunk in _CHUNK.findall(whole):
                lone = chunk.rfind(SPACE) + 1
                for k, part in enumerate(chunk[lone:].split("\n")):
                    if k:
                        out.append(self.line_feed)
                    if k == 0 and lone == 1 and part:
                        out.append(self.words[part])
                    elif k == 0 and lone:
                        out.append(self._packed(chunk[:lone] + part))
                    elif part:
                        out.append(known[part])
            return b"".join(out)

    def encode(self, text: str, ends: bool = True) -> list[int]:
        packed = self.encode_packed(text)
        ids = list(struct.unpack(f"<{len(packed) // 4}I", packed))
        return [self.bos, *ids, self.eos] if ends else ids

    def _shown(self, i: int) -> bytes:
        kind, piece = self.kinds[i], self.pieces[i]
        if kind == 3:
            return b""
        if kind == 2:
            return " ⁇ ".encode()
        return bytes([int(piece[3:5], 16)]) if kind == 6 else piece.replace(SPACE, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, one each."""
        kinds = self.kinds
        start, stop = 0, len(ids)
        while start < stop and kinds[ids[start]] == 3:
            start += 1
        while start < stop and kinds[ids[stop - 1]] == 3:
            stop -= 1
        body = ids[start:stop]
        strip = self.dummy_prefix and body and kinds[body[0]] == 1
        if self.bos not in body and self.eos not in body:
            data = b"".join(map(self.shown.__getitem__, body))
            try:
                return (data[1:] if strip and data[:1] == b" " else data).decode()
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        for is_byte, run in groupby(body, lambda i: kinds[i] == 6):
            data = b"".join(map(self.shown.__getitem__, run))
            out.append(_replaced(data) if is_byte else data.decode())
        shown = "".join(out)
        return shown[1:] if strip and shown[:1] == " " else shown


def _replaced(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode() + "\ufffd")
            at += e.start + 1
    return "".join(out)


class _Remembered(dict):
    """Packed ids of chunks, each behind a prefix; forgets all when it has MAX_REMEMBERED."""

    def __init__(self, model: PieceModel, prefix: str):
        self.model, self.prefix = model, prefix

    def __missing__(self, word: str) -> bytes:
        if not word:
            raise _Odd
        chunk, inside = self.prefix + word, self.model.inside
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in inside]
        if not cuts:
            packed = self.model._packed(chunk)
        else:
            known = self.model.starts
            parts = [chunk[i:j] for i, j in zip([0, *cuts], [*cuts, len(chunk)], strict=True)]
            first = self[parts[0][1:]] if self.prefix and len(parts[0]) > 1 else self.model._packed(parts[0]) if self.prefix else known[parts[0]]
            packed = first + b"".join([known[x] for x in parts[1:]])
        if len(word) <= 64:
            if len(self) >= MAX_REMEMBERED:
                self.clear()
            self[word] = packed
        return packed


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The model of a path, read once in each worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_decode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """df with ``piece_ids`` (binary: little-endian 32-bit ids with begin and end) and ``decoded`` (the text of those ids).

    A null text counts as empty and gives the begin and end ids. Texts of any length are encoded
    whole; repeated rows each get their columns; an empty table gives an empty result. Columns of df
    with the two names are replaced. model_path must be readable on the executors.
    """
    df = df.drop("piece_ids", "decoded")
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        begin, end = (struct.pack("<I", x) for x in (model.bos, model.eos))
        for batch in slices(batches, text):
            packed, decoded = [], []
            for value in batch.column(text).to_pylist():
                ids = begin + model.encode_packed(value or "") + end
                packed.append(ids)
                decoded.append(model.decode(memoryview(ids).cast("I").tolist()))
            yield with_columns(batch, keep, {"piece_ids": pa.array(packed, pa.binary()), "decoded": pa.array(decoded, pa.string())})

    schema = T.StructType([*df.schema.fields, T.StructField("piece_ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return df.mapInArrow(run, schema)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as the sentencepiece library gives them. A null text counts as empty: begin and end alone;
    repeated rows are encoded each; an empty table gives an empty result."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id", (F.octet_length("piece_ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("piece_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
