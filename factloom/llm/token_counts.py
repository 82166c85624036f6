"""Token counts with a whole-token shortcut.

Before any text is read, every string of the vocabulary is put through the
tokenizer: those that the tokenizer splits into a single pre-token and encodes as
their own single id are proven to be one token wherever they occur as a pre-token.
Counting a text is then a dictionary lookup for each pre-token; only pre-tokens
outside that proof are merged by the library, many in one call, and remembered.

Only definitions are taken that split as byte-level BPE does by default, without a
normalizer or dropout; others are refused. Nulls count as empty texts. Empty texts have
0 bytes and 0 tokens; very long texts are split lazily and counted whole. Repeated rows
are counted separately; null and repeated ids are kept as they are. Columns other than
the id and the text are not read, so extra columns with any name are harmless. An empty
table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from factloom.llm.pretokens import Memory, PieceEncoder, Splitter, kept, pattern_sources

#: Pre-tokens that a worker remembers beyond the proven ones, in each of two generations.
REMEMBERED = 80_000
OVER_LIMIT = 512
#: Rows handled at once within an Arrow batch.
SLICE_ROWS = 256


def proven_whole_tokens(tokenizer: Tokenizer, split: Splitter) -> list[str]:
    """Vocabulary strings that are one pre-token and that the library encodes as exactly their own id."""
    found: list[tuple[str, int]] = []
    for token_id in range(tokenizer.get_vocab_size(with_added_tokens=False)):
        text = tokenizer.decode([token_id], skip_special_tokens=False)
        if text and "�" not in text and [text] == [p for block in split.blocks(text) for p in block]:
            found.append((text, token_id))
    encoded = tokenizer.encode_batch([text for text, _ in found], add_special_tokens=False)
    return [text for (text, token_id), one in zip(found, encoded, strict=True) if one.ids == [token_id]]


def check_definition(definition: str) -> None:
    """Refuse a tokenizer whose pre-tokens or merges depend on more than the split pattern and the pre-token."""
    d = json.loads(definition)
    split, model = d["pre_tokenizer"] or {}, d["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    merges = model.get("type") == "BPE" and not model.get("dropout") and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
    added = all(not t[k] for t in d["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if d["normalizer"] or not (plain and merges and added):
        raise ValueError("only byte-level BPE with the default split and plain added tokens is supported")


class Counter:
    """Counts tokens of texts; one for each Python worker."""

    def __init__(self, definition: str, sources: tuple[str, str], whole: list[str]) -> None:
        self.special = [t.content for t in Tokenizer.from_str(definition).get_added_tokens_decoder().values()]
        self.pieces = PieceEncoder(definition)
        self.split = Splitter(sources)
        self.whole = dict.fromkeys(whole, 1)
        self.memory = Memory(self._merged, REMEMBERED)

    def _merged(self, names: list[str]) -> Iterator[tuple[str, int]]:
        for part, _, stops in self.pieces.ids(names):
            yield from zip(part, np.diff(stops, prepend=0).tolist(), strict=True)

    def _pieces(self, text: str) -> Iterator[str | None]:
        """Stretches of ordinary text; None stands for one special token between them."""
        rest = [text]
        for special in self.special:
            if special in text:
                rest = [x for part in rest for x in _interleave(part, special)]
        return iter(rest)

    def count(self, text: str) -> int:
        """Tokens of a text: one for each pre-token that is proven to be whole, the rest merged."""
        n = 0
        for stretch in self._pieces(text):
            if stretch is None:
                n += 1
                continue
            for block in self.split.blocks(stretch):
                rest = [p for p in block if p not in self.whole]
                n += len(block) - len(rest) + sum(self.memory.of(rest))
        return n


def _interleave(part: str | None, special: str) -> list[str | None]:
    if part is None:
        return [None]
    out: list[str | None] = []
    for k, piece in enumerate(part.split(special)):
        out += [None] * (k > 0) + [piece]
    return out


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", over: int = OVER_LIMIT) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` for every row of ``docs``, in one pass without a shuffle."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    check_definition(definition)
    tokenizer = Tokenizer.from_str(definition)
    sources = pattern_sources("tokenizers")
    whole = proven_whole_tokens(tokenizer, Splitter(sources))
    # the tokenizer file and its proven strings: a few MB whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast((definition, sources, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, sources, whole = shared.value

        def build_counter() -> Counter:
            return Counter(definition, sources, whole)

        counter = kept(hash((definition, sources, len(whole))), build_counter)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = [counter.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > over for n in tokens], pa.bool_())],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
