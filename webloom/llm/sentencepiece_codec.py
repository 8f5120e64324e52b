"""SentencePiece encoding and decoding over a distinct-chunk table.

Pieces of the model never hold a marker after another character nor a line break, so no
merge reaches across these boundaries; ``check_model`` proves that for the model at hand
(otherwise texts are encoded whole).  Each distinct marked word is segmented once per
worker, by the library itself on a copy of the model that adds no marker of its own.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _scan
from ._store import table
from .chunk_table import LONGEST, ChunkTable, batches_of, marked_chunks

MODEL = "piece_bpe_32k.model"
MARK = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 127) << shift
        shift += 7
        if x < 128:
            return out, at


def _to_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _fields(b: bytes):
    """(number, wire type, whole field, payload) of a protocol buffer message."""
    at = 0
    while at < len(b):
        began = at
        tag, at = _varint(b, at)
        kind = tag & 7
        if kind == 2:
            n, at = _varint(b, at)
            payload, at = b[at : at + n], at + n
        elif kind == 0:
            payload, at = _varint(b, at)
        else:
            n = 8 if kind == 1 else 4
            payload, at = b[at : at + n], at + n
        yield tag >> 3, kind, b[began:at], payload


#: Numbers of the public model format: the normalizer's message and its flags.
_NORMALIZER, _CHARSMAP, _DUMMY, _REMOVE, _ESCAPE = 3, 2, 3, 4, 5


def load(path: str):
    """(library processor, processor that adds no marker or None, whether a marker is added before a text)."""
    import sentencepiece

    with open(path, "rb") as f:
        blob = f.read()
    whole = sentencepiece.SentencePieceProcessor(model_proto=blob)
    flags, charsmap, out = {_DUMMY: 1, _REMOVE: 1, _ESCAPE: 1}, b"", b""
    for number, _, field, payload in _fields(blob):
        if number == _NORMALIZER:
            for n, kind, _, value in _fields(payload):
                if kind == 0:
                    flags[n] = value
                elif n == _CHARSMAP:
                    charsmap = value
            payload += _to_varint(_DUMMY << 3) + b"\0"
            field = _to_varint(_NORMALIZER << 3 | 2) + _to_varint(len(payload)) + payload
        out += field
    bare = sentencepiece.SentencePieceProcessor(model_proto=out)
    plain = not charsmap and not flags[_REMOVE] and flags[_ESCAPE]
    return whole, bare if plain and check_model(whole) else None, bool(flags[_DUMMY])


def check_model(sp) -> bool:
    """Whether no piece has a marker after another character, nor a line break."""
    crosses = re.compile(f"[^{MARK}]{MARK}|\n")
    return not any(crosses.search(sp.id_to_piece(i)) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))


class Codec:
    """Encodes and decodes texts as the library does, by chunks."""

    def __init__(self, path: str):
        self.whole, self.bare, self.dummy = load(path)
        self.bos, self.eos = struct.pack("<I", self.whole.bos_id()), struct.pack("<I", self.whole.eos_id())
        self.odd: dict[str, str] = {}  # chunks of the table, or of the texts at hand, that don't decode to themselves
        self.table = ChunkTable(self._segment, emptied=self.odd.clear) if self.bare else None
        self.reads = [self._reads(i) for i in range(self.whole.vocab_size())]
        self.length = np.array([len(x) for x in self.reads])

    def _reads(self, i: int) -> bytes:
        """What one piece decodes to, with the blank that the library takes away before a text."""
        piece = self.whole.id_to_piece(i)
        if self.whole.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.whole.is_control(i) else piece.replace(MARK, " ").encode()

    def _segment(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; each is decoded once, and noted where that isn't the chunk."""
        found, reads = self.bare.encode(chunks, num_threads=1), self.reads
        n = np.array([len(x) for x in found])
        ends = np.cumsum(n)
        flat = [i for ids in found for i in ids]
        blob = np.array(flat, "<u4").tobytes()
        long = np.concatenate(([0], np.cumsum(self.length[flat] if flat else np.zeros(0, int))))
        texts = [c.replace(MARK, " ").encode() for c in chunks]
        if b"".join([reads[i] for i in flat]) != b"".join(texts) or not np.array_equal(long[ends] - long[ends - n], [len(x) for x in texts]):
            for c, ids, text in zip(chunks, found, texts):
                if (back := b"".join([reads[i] for i in ids])) != text:
                    self.odd[c] = back.decode("utf-8", "replace")
        at = [0, *(4 * ends).tolist()]
        return [blob[a:b] for a, b in zip(at, at[1:])]

    def chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        out = marked_chunks(" " + text if self.dummy and text[0] in " ▁" else text)
        if self.dummy and text[0] not in " ▁":
            out[0] = MARK + out[0] if out[0] != "\n" else out[0]
            if out[0] == "\n":
                out.insert(0, MARK)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of begin, text and end of each text, as little-endian unsigned 32-bit integers."""
        return [ids for ids, _ in self.both(texts, False)]

    def decode(self, ids: bytes) -> str:
        """The library's own decoding of these ids."""
        return self.whole.decode(np.frombuffer(ids, "<u4").tolist())

    def both(self, texts: list[str | None], back: bool = True) -> list[tuple[bytes, str]]:
        """Ids of each text, and the text that they decode to."""
        if self.table is None:
            ids = [self.bos + np.array(self.whole.encode(x or ""), "<u4").tobytes() + self.eos for x in texts]
            return [(x, self.decode(x) if back else "") for x in ids]
        cut = [self.chunks(x) for x in texts]
        get, out = self.table.lookup(cut).__getitem__, []
        for chunks in cut:
            text = ""
            if back:
                if self.odd:
                    text = "".join([self.odd[c] if c in self.odd else c.replace(MARK, " ") for c in chunks])
                else:
                    text = "".join(chunks).replace(MARK, " ")
            out.append((b"".join([self.bos, *map(get, chunks), self.eos]), text[1:] if self.dummy and text[:1] == " " else text))
        for c in [c for c in self.odd if len(c) > LONGEST]:  # the table doesn't keep those
            del self.odd[c]
        return out


_codecs: dict[str, Codec] = {}


def codec_at(path: str) -> Codec:
    """One codec for each worker process, so that its table serves all tasks there."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _digests(path: str):
    def run(batches):
        codec = codec_at(path)
        for batch in batches:
            for part in _scan.slices(batch, "text"):
                n, ids_sha, text_sha = [], [], []
                for texts in batches_of(part.column(1)):
                    for ids, back in codec.both(texts):
                        n.append(len(ids) // 4)
                        ids_sha.append(hashlib.sha256(ids).hexdigest())
                        text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches):
        codec = codec_at(path)
        for batch in batches:
            for part in _scan.slices(batch, "text", 1 << 20):
                ids = [np.frombuffer(x, "<u4") for x in codec.encode(part.column(1).to_pylist())]
                offs = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)))
                yield pa.record_batch([part.column(0), pa.array(np.diff(offs).astype(np.int64)), flat], ["doc_id", "n_tokens", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        codec = codec_at(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if x is None else codec.whole.decode([int(i) for i in x]) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _out(df: DataFrame, rest: str) -> T.StructType:
    return T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), *T._parse_datatype_string(rest).fields])


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` (array<int>) with begin and end ids; a null text is an empty one.  ``path`` is the model's place on every machine."""
    base = _base(docs, id_col, text_col)
    return base.mapInArrow(_ids(path or model_path()), _out(base, "n_tokens long, ids array<int>"))


def decode(ids: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows with an array of ids; a null array gives a null text."""
    base = ids.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return base.mapInArrow(_decode(path or model_path()), _out(base, "text string"))


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; null texts count as empty, repeated rows are each answered."""
    base = _base(docs, id_col, text_col)
    return base.mapInArrow(_digests(path or model_path()), _out(base, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
