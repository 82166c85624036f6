"""Text operators of ingestion: normalisation, token estimates, paragraphs, chunks, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.unicode import normalized

#: What counts as a token, and how many a chunk and an overlap hold; fixed values.
TOKEN = r"[一-鿿]|[A-Za-z0-9]+(\.[0-9]+)*"
CHUNK_TOKENS, OVERLAP_TOKENS = 512, 64
BLOCK = "struct<text:string,page:int>"


def stripped_lines(text: Column) -> Column:
    """Line ends as LF, each line and the whole stripped; blank lines inside stay."""
    lf = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lf, r"(?Um)^[^\S\n]+|[^\S\n]+$", ""), r"(?U)^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    """:func:`stripped_lines` of the text in NFC."""
    return stripped_lines(normalized(text, "NFC"))


def estimate_tokens(text: Column) -> Column:
    """Han characters, and runs of ASCII letters and digits with dotted numbers."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), F.lit(0))


#: Lines that are not blank, one after the other.
_PARAGRAPH = r"(?mdU)^[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*"


def paragraph_spans(text: Column) -> Column:
    """``array<struct<text, offset_start, offset_end>>``: blank lines part paragraphs, whose lines are stripped.

    Offsets are characters of ``text``, from the beginning of a paragraph's first line to
    the end of its last, white space at the ends of lines included.
    """
    parts = F.regexp_extract_all(text, F.lit(_PARAGRAPH), F.lit(0))
    gaps = F.slice(F.split(text, _PARAGRAPH, -1), F.lit(1), F.size(parts))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        return F.struct((begin + x["part"]).alias("at"), F.concat(acc["starts"], F.array(begin)).alias("starts"))

    starts = F.aggregate(F.zip_with(gaps, parts, lambda g, p: F.struct(F.length(g).alias("gap"), F.length(p).alias("part"))), none, add, lambda acc: acc["starts"])
    block = lambda p, s: F.struct(stripped_lines(p).alias("text"), s.alias("offset_start"), (s + F.length(p)).alias("offset_end"))
    return F.zip_with(parts, starts, block)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, paragraph, text)``: blank lines part paragraphs; their lines are stripped."""
    return docs.select(id_col, F.posexplode(paragraph_texts(F.col(text_col))).alias("paragraph", "text"))


def paragraph_texts(text: Column) -> Column:
    return F.filter(F.split(stripped_lines(text), r"\n\n+"), lambda p: p != "")


def blocks_of(text: Column) -> Column:
    """The paragraphs of a plain text as blocks without pages."""
    return F.transform(paragraph_texts(text), lambda p: F.struct(p.alias("text"), F.lit(None).cast("int").alias("page")))


def lines_of(text: Column) -> Column:
    """Non-blank stripped lines with their token counts."""
    lines = F.filter(F.split(stripped_lines(text), "\n"), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(x.alias("text"), estimate_tokens(x).alias("n")))


def _sliced(line: Column, limit: int, overlap: int) -> Column:
    """Windows of ``limit`` tokens of a line, as its own text from the first token to the last."""
    step = max(1, limit - overlap)
    tokens = F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))
    # each token with what follows it, so that a window is a slice put together
    tailed = F.zip_with(tokens, F.slice(F.split(line, TOKEN, -1), 2, F.size(tokens)), lambda t, gap: F.struct(t.alias("token"), F.concat(t, gap).alias("tailed")))

    def windows(t: Column) -> Column:
        def window(k: Column) -> Column:
            n = F.least(F.lit(limit), F.size(t) - k * step)
            text = F.concat(F.array_join(F.slice(t["tailed"], k * step + 1, n - 1), ""), F.element_at(t["token"], k * step + n))
            return F.struct(text.alias("text"), n.alias("n"))

        return F.transform(F.sequence(F.lit(0), F.ceil((F.size(t) - limit) / step).cast("int")), window)

    # bound once, so a line is only matched once
    return F.transform(F.array(tailed), windows)[0]


def units(text: Column, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """Non-blank stripped lines with their token counts; lines over the limit as overlapping windows of their text."""
    return F.flatten(F.transform(lines_of(text), lambda u: F.when(u["n"] > limit, _sliced(u["text"], limit, overlap)).otherwise(F.array(u))))


def chunks_of(blocks: Column, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """Chunks of the blocks of one document: ``array<struct<chunk_index, text, token_count, page_start, page_end, block_indexes>>``.

    Units are packed greedily up to ``limit`` tokens: a chunk is closed when it holds
    something and the next unit would pass the limit. Units of a block are joined by a
    line end, blocks by a blank line. Where chunks begin is found by one pass over the
    token counts; each chunk is then a slice.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and the overlap less than it")
    each = F.flatten(F.transform(blocks, lambda b, i: F.transform(units(b["text"], limit, overlap), lambda u: F.struct(u["text"].alias("text"), u["n"].alias("n"), b["page"].alias("page"), i.alias("block")))))
    none = F.struct(F.lit(0).alias("filled"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def pack(acc: Column, n: Column) -> Column:
        begins = (acc["at"] == 0) | ((acc["filled"] > 0) & (acc["filled"] + n > limit))
        return F.struct(
            F.when(begins, n).otherwise(acc["filled"] + n).alias("filled"),
            (acc["at"] + 1).alias("at"),
            F.when(begins, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
        )

    def cut(u: Column) -> Column:
        starts = F.aggregate(F.transform(u, lambda x: x["n"]), none, pack, lambda acc: acc["starts"])
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda begin, k: chunk(F.slice(u, begin + 1, F.coalesce(F.get(s, k + 1), F.size(u)) - begin), k)))[0]

    def chunk(part: Column, k: Column) -> Column:
        glued = F.transform(part, lambda x, i: F.concat(F.when(i == 0, "").when(F.get(part, i - 1)["block"] == x["block"], "\n").otherwise("\n\n"), x["text"]))
        pages = F.filter(F.transform(part, lambda x: x["page"]), lambda p: p.isNotNull())
        return F.struct(
            k.alias("chunk_index"),
            F.array_join(glued, "").alias("text"),
            F.aggregate(part, F.lit(0), lambda s, x: s + x["n"]).alias("token_count"),
            F.array_min(pages).alias("page_start"),
            F.array_max(pages).alias("page_end"),
            F.array_sort(F.array_distinct(F.transform(part, lambda x: x["block"]))).alias("block_indexes"),
        )

    # bound once, so units are only computed once
    return F.transform(F.array(each), cut)[0]


def chunk_blocks(docs: DataFrame, blocks: Column, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, id_col: str = "doc_id") -> DataFrame:
    """A row for each chunk of each row's blocks; a document never leaves its task, and rows that repeat an id are cut by themselves."""
    return docs.select(id_col, F.explode(chunks_of(blocks, limit, overlap)).alias("c")).select(id_col, "c.*")


def chunk_lines(docs: DataFrame, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`chunk_blocks` of the paragraphs of plain texts."""
    return chunk_blocks(docs, blocks_of(F.col(text_col)), limit, overlap, id_col)


def long_line_windows(docs: DataFrame, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, line, window, text, n_tokens)``: overlapping windows of the text of lines over the limit."""
    x = docs.select(id_col, F.posexplode(lines_of(F.col(text_col))).alias("line", "u")).where(F.col("u.n") > limit)
    return x.select(id_col, "line", F.posexplode(_sliced(F.col("u.text"), limit, overlap)).alias("window", "w")).select(id_col, "line", "window", "w.text", F.col("w.n").alias("n_tokens"))


def content_hash(blocks: Column) -> Column:
    """SHA-256 of the compact JSON of blocks in order; nulls are kept, and fields should come in the order of their names."""
    return F.sha2(F.to_json(blocks, {"ignoreNullFields": "false"}), 256)
