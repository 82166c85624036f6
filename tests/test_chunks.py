"""Chunks against a small brute force of the rule."""

from __future__ import annotations

import random
import re

from factloom.functions import text as T

TOKEN = re.compile(T.TOKEN)


def chunked(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    pieces, block, blank = [], 0, True
    for line in (x.strip() for x in text.split("\n")):
        if not line:
            blank = True
            continue
        block += blank
        blank = False
        spans = [m.span() for m in TOKEN.finditer(line)]
        if len(spans) <= limit:
            pieces.append((len(spans), line, block))
            continue
        start = 0
        while True:
            end = min(start + limit, len(spans))
            pieces.append((end - start, line[spans[start][0] : spans[end - 1][1]], block))
            if end == len(spans):
                break
            start += limit - overlap
    out: list[list[tuple[int, str, int]]] = []
    filled = 0
    for n, piece, of in pieces:
        if not out or (filled and filled + n > limit):
            out.append([])
            filled = 0
        out[-1].append((n, piece, of))
        filled += n
    glue = lambda c: "".join((("\n" if c[i - 1][2] == of else "\n\n") if i else "") + p for i, (_, p, of) in enumerate(c))
    return [(k, sum(n for n, _, _ in c), glue(c)) for k, c in enumerate(out)]


def test_long_lines_are_sliced_and_packed(spark):
    pick = random.Random(6)
    word = lambda: pick.choice(["alpha", "b2", "3.14.15", "\u77e5\u8bc6", "- x", "(y),", "\u00e9t\u00e9", "!?", "end."])
    line = lambda n: " ".join(word() for _ in range(n))
    texts = ["one " * n for n in (19, 20, 21, 35, 36, 37, 400)]
    texts += ["\n".join(line(pick.choice([0, 1, 3, 8, 19, 20, 21, 60, 300])) for _ in range(pick.randrange(1, 9))) for _ in range(40)]
    texts += ["", "\n \n", "!!! ???", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in T.chunk_lines(docs, 20, 4).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.token_count, r.text))
    assert got == {k: c for k, t in enumerate(texts) if t and (c := chunked(t, 20, 4))}
    assert T.chunk_lines(spark.createDataFrame([(1, "w " * 20_000)], "doc_id long, text string")).where("token_count > 512").count() == 0


def test_rows_that_repeat_an_id_are_cut_by_themselves(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (1, "c\nd"), (None, "e")], "doc_id long, text string")
    assert sorted(r.text for r in T.chunk_lines(docs).collect()) == ["a\nb", "c\nd", "e"]


def test_blocks_carry_pages_and_numbers(spark):
    rows = [(7, [("one two", 1), ("three", 1), ("four five\n\n six", 2), (" \n", 9), ("seven", None)])]
    docs = spark.createDataFrame(rows, "doc_id long, b array<struct<text:string,page:int>>")
    got = [(r.chunk_index, r.text, r.token_count, r.page_start, r.page_end, r.block_indexes) for r in T.chunk_blocks(docs, docs.b, 3, 0).collect()]
    assert got == [(0, "one two\n\nthree", 3, 1, 1, [0, 1]), (1, "four five\nsix", 3, 2, 2, [2]), (2, "seven", 1, None, None, [4])]


def test_places_of_paragraphs(spark):
    pick = random.Random(3)
    texts = ["", "\n\n", "one", "  a  \n b\n\n \n c \n", "x\n \u3000 \ny"] + ["".join(pick.choice("ab \n\n\u3000") for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in docs.select("doc_id", T.paragraph_spans(docs.text).alias("b")).collect():
        text, want, begin, held, at = texts[r.doc_id], [], None, [], 0
        for line in [*text.split("\n"), ""]:
            if line.strip():
                begin = at if begin is None else begin
                held.append(line)
            elif held:
                want.append(("\n".join(x.strip() for x in held), begin, begin + len("\n".join(held))))
                begin, held = None, []
            at += len(line) + 1
        assert [(b.text, b.offset_start, b.offset_end) for b in r.b] == want, repr(text)
