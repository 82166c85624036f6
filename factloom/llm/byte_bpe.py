"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file lists token bytes by merge priority. The library wants pairs of
tokens written in a printable alphabet, so the merges are recovered from the ranks
and each byte is mapped to a character; decoding reverses that table.

Encoding splits a text into pre-tokens, encodes those that a worker does not remember
with the library, many at once, and strings the ids together. Nulls are empty texts; an
empty text has no ids and decodes to no bytes. Very long texts are split lazily and
encoded whole. Ids are packed as little-endian unsigned 32-bit integers. A token may end
within a character: :func:`decode_text` joins bytes before it decodes characters, and
offsets of such tokens cover the whole character. Repeated rows are encoded separately;
null and repeated ids are kept as they are; further columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE

from factloom.llm.pretokens import Memory, PieceEncoder, Splitter, byte_alphabet, kept, pattern_sources

#: Pre-tokens whose ids a worker remembers in each of two generations.
REMEMBERED = 80_000
SLICE_ROWS = 128


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def recover_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The pair that the last merge of ``token`` joins: merge its bytes with every rank below its own."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if best >= limit:
            raise ValueError(f"rank {limit} cannot be reached by merging pairs")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def library_model(ranks: dict[bytes, int]) -> str:
    """A definition for the tokenizers library that merges as the ranks do."""
    letters = byte_alphabet()
    show = lambda token: "".join(letters[b] for b in token)
    merges = [tuple(map(show, recover_merge(t, ranks))) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
    return Tokenizer(BPE({show(t): r for t, r in ranks.items()}, merges)).to_str()


class Codec:
    """Encodes and decodes; one for each Python worker."""

    def __init__(self, definition: str, sources: tuple[str, str]) -> None:
        self.pieces = PieceEncoder(definition)
        self.split = Splitter(sources)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        spelled = [b""] * self.pieces.library.get_vocab_size()
        for shown, token_id in self.pieces.library.get_vocab().items():
            spelled[token_id] = bytes(map(byte_of.__getitem__, shown))
        self.token_bytes = spelled
        self.memory = Memory(self._learn, REMEMBERED)

    def _learn(self, names: list[str]) -> Iterator[tuple[str, bytes]]:
        for part, ids, stops in self.pieces.ids(names):
            packed = ids.astype("<u4").tobytes()
            start = 0
            for name, stop in zip(part, (4 * stops).tolist(), strict=True):
                yield name, packed[start:stop]
                start = stop

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        return b"".join([b"".join(self.memory.of(block)) for block in self.split.blocks(text)])

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Start and end of every token in characters of ``text``; tokens within a character share its span."""
        out, base = [], 0
        for block in self.split.blocks(text):
            for piece in block:
                char_of = [k for k, c in enumerate(piece) for _ in c.encode()]
                for start, end in self.pieces.library.encode(self.pieces.shown([piece]), add_special_tokens=False).offsets:
                    out.append((base + char_of[start], base + char_of[end - 1] + 1))
                base += len(piece)
        return out

    def decode(self, packed: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.token_bytes.__getitem__, _unpacked(packed)))


def worker_codec(made_from: tuple) -> Codec:
    """The codec of this Python worker, built once and kept for later tasks."""

    def build_codec() -> Codec:
        return Codec(*made_from)

    return kept(hash(made_from), build_codec)


def decode_text(pieces: list[bytes]) -> str:
    """Characters of token bytes in order; bytes are joined first, and what is no UTF-8 becomes U+FFFD."""
    return b"".join(pieces).decode(errors="replace")


def _unpacked(packed: bytes) -> array:
    out = array("I")
    out.frombytes(packed)
    if array("H", [1]).tobytes() != b"\1\0":
        out.byteswap()
    return out


def _shared(docs: DataFrame, ranks_path: str):
    # vocabulary and patterns: a few MB whatever the corpus
    return docs.sparkSession.sparkContext.broadcast((library_model(load_ranks(ranks_path)), pattern_sources("tiktoken")))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, offsets: bool = False) -> DataFrame:
    """``(id_col, n_tokens, ids)`` for every row, in one pass without a shuffle.

    ``decoded`` adds the bytes that the ids decode to, ``offsets`` the character
    spans of the tokens as ``array<struct<start, end>>``.
    """
    shared = _shared(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared.value)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [codec.encode(t) for t in texts]
                columns = {id_col: part.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    columns["decoded"] = pa.array([codec.decode(x) for x in ids], pa.binary())
                if offsets:
                    columns["offsets"] = pa.array([[{"start": a, "end": b} for a, b in codec.offsets(t)] for t in texts], span)
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids binary" + ", decoded binary" * decoded
    return docs.select(id_col, text_col).mapInArrow(run, schema + ", offsets array<struct<start:int,end:int>>" * offsets)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, decoded)``: the bytes that packed ids stand for; null ids are empty."""
    shared = _shared(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "decoded": pa.array([codec.decode(x or b"") for x in part.column(1).to_pylist()], pa.binary())})

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
