"""Cutting texts that exceed a limit of tokens at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.bpe import ByteBpe, load
from graphloom.llm.encode import steps

# The class of each token says what ends with it, from the strongest boundary to none.
HEADING, PARAGRAPH, SENTENCE, WORD, CHARACTER, INSIDE = "hpswcx"
_HEADING = re.compile(r"(?<=\n)(?=[ \t]*(?:#{1,6}[ \t]|\d+(?:\.\d+)*\.?[ \t]+\w[^\n]{0,80}\n[ \t]*\n))")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*|\n(?=[^\S\n]*[-*•][^\S\n])")
_SENTENCE = re.compile(r"""[.!?…؟।]["'”’»)\]]*(?=\s)\s?|[。！？]["”』」’]*\s?|\n""")
#: Code points of a block, in which texts are handed on.
BLOCK = 1000
#: White space by code point.
_SPACE = np.array([chr(c).isspace() for c in range(0x110000)])


def word_starts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of white space before a word begin and end."""
    space = np.concatenate([[False], _SPACE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]])
    turn = np.flatnonzero(space[1:] != space[:-1])  # begin, end, begin ...
    return turn[: len(turn) // 2 * 2 : 2], turn[1::2]


def token_classes(bpe: ByteBpe, texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """For each text one class character for each token, and the code points up to the end of each token."""
    flat, count = bpe.encode_texts(texts)
    classes, ends = [], []
    for text, ids in zip(texts, np.split(flat, np.cumsum(count)[:-1])):
        end = np.cumsum(bpe.chars[ids], dtype=np.int64)
        kind = np.full(len(ids), ord(CHARACTER), np.uint8)
        kind[:-1][bpe.inside[ids[1:]]] = ord(INSIDE)
        whole = kind == ord(CHARACTER)

        def mark(low: np.ndarray, high: np.ndarray, letter: str) -> None:
            """The last token that ends within each span, both ends counting."""
            if len(low):
                at = np.searchsorted(end, high, "right") - 1
                ok = at >= 0
                at, low = at[ok], low[ok]
                at = at[(end[at] >= low) & whole[at]]
                kind[at] = ord(letter)

        mark(*word_starts(text), WORD)
        for rule, letter in ((_SENTENCE, SENTENCE), *(((_PARAGRAPH, PARAGRAPH), (_HEADING, HEADING)) if "\n" in text else ())):
            mark(*np.array([m.span() for m in rule.finditer(text)], np.int64).reshape(-1, 2).T, letter)
        classes.append(kind.tobytes().decode("ascii"))
        ends.append(end)
    return classes, ends


def next_starts(classes: str, offsets: np.ndarray) -> list[np.ndarray]:
    """For each token, within its text, the first token from it on that follows a word boundary, and the first that begins a character.

    The classes of several texts stand in a row, cut by the offsets. Where there is no such token in the text a number past its end is given.
    """
    kind = np.frombuffer(classes.encode("ascii"), np.uint8)
    start = np.repeat(offsets[:-1], np.diff(offsets))
    first = np.zeros(len(kind) + 1, bool)
    first[offsets] = True  # a text's own beginning follows a boundary
    out = []
    for ends in (np.isin(kind, np.frombuffer(b"hpsw", np.uint8)), kind != ord(INSIDE)):
        at = np.append(np.flatnonzero(first | np.concatenate([[False], ends])), len(kind) + 1)
        out.append(at[np.searchsorted(at, np.arange(len(kind)))] - start)
    return out


def piece_pattern(limit: int, least: int) -> str:
    """Up to `limit` tokens, ending at the strongest boundary that leaves at least `least`; a text's rest; else any whole character."""
    tries = [rf".{{{least - 1},{limit - 1}}}{c}" for c in (HEADING, PARAGRAPH, SENTENCE, WORD, "[hpswc]")]
    return "|".join([rf".{{1,{limit}}}\z", *tries, rf".{{0,{limit - 1}}}[hpswc]"])


def split_long(df: DataFrame, key: str, text: str, limit: int, overlap: int, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Cut texts into pieces of at most `limit` tokens; gives (key, piece, n_pieces, start_pos, end_pos, own_pos, n_tokens, piece_text).

    Positions count code points from 0, end exclusive. A piece ends after its body, at a heading, else a
    paragraph, a sentence, a word, a character, whichever comes first in this order with the
    body at least half full. From the second piece on, the body (from own_pos) follows up to `overlap`
    tokens repeated from before it (start_pos to own_pos), which begin after a word where one begins
    there, so that overlap and body together stay within the limit. The bodies laid end to end are the text.

    A text within the limit is one piece; an empty or null text has none. A null key is kept; repeated rows
    give their pieces each. An empty table gives an empty result; other columns are left out.
    """
    if not 0 <= overlap or limit - overlap < 8:
        raise ValueError("limit must exceed overlap by 8 tokens or more")
    kind = df.schema[key].dataType
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("own_key", kind), T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("cls", T.StringType()), T.StructField("ends", numbers), T.StructField("word", numbers), T.StructField("whole", numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(name, folder)
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in steps(texts):
                classes, ends = token_classes(bpe, texts[s])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(e) for e in ends])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (np.concatenate(ends), *next_starts("".join(classes), offsets.to_numpy()))]
                part = b.slice(s.start, s.stop - s.start)
                blocks = [[t[i : i + BLOCK] for i in range(0, len(t), BLOCK)] for t in texts[s]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blocks, pa.list_(pa.string())), pa.array(classes, pa.string()), *lists], names=schema.names)

    body = limit - overlap
    tokens = df.select(F.col(key).alias("own_key"), F.col(text).cast("string").alias("txt")).filter("length(txt) > 0").mapInArrow(run, schema)
    first = rf"\A(?:{piece_pattern(limit, max(1, limit // 2))})"
    rest = piece_pattern(body, max(1, body // 2))
    # The first piece repeats nothing and so may fill the whole limit.
    cut = tokens.withColumn("head", F.regexp_extract("cls", first, 0))
    cut = cut.withColumn("bodies", F.concat(F.array("head"), F.expr("regexp_extract_all(substring(cls, length(head) + 1), pattern, 0)".replace("pattern", "'" + rest.replace("\\", "\\\\") + "'"))))
    cut = cut.withColumn("sizes", F.expr("transform(bodies, b -> length(b))"))
    cut = cut.withColumn("stops", F.expr("aggregate(sizes, cast(array() as array<int>), (a, n) -> concat(a, array(coalesce(try_element_at(a, -1), 0) + n)))"))
    # Look back `overlap` tokens and move forward to the next whole word, or at least to a whole character.
    back = f"greatest(p.stops - p.sizes - {overlap}, 0)"
    begin = f"if({overlap} = 0 or p.stops = p.sizes, p.stops - p.sizes, if({back} = 0, 0, if(word[{back}] < p.stops - p.sizes, word[{back}], least(whole[{back}], p.stops - p.sizes))))"
    spots = f"transform(arrays_zip(stops, sizes), p -> struct({begin} as start, p.stops - p.sizes as own, p.stops as stop))"
    end_of = "if({0} = 0, 0, ends[{0} - 1])".format
    cut = cut.select("own_key", "blocks", "ends", F.expr(spots).alias("spots"))
    cut = cut.select("own_key", "blocks", F.expr(f"transform(spots, p -> struct({end_of('p.start')} as start_pos, {end_of('p.own')} as own_pos, {end_of('p.stop')} as end_pos, p.stop - p.start as n_tokens))").alias("pieces"))
    # Each piece takes its text from the blocks that it touches, before the pieces are exploded: none carries the whole text.
    said = f"substring(array_join(slice(blocks, p.start_pos div {BLOCK} + 1, (p.end_pos - 1) div {BLOCK} - p.start_pos div {BLOCK} + 1), ''), p.start_pos % {BLOCK} + 1, p.end_pos - p.start_pos)"
    cut = cut.select("own_key", F.size("pieces").alias("n_pieces"), F.posexplode(F.expr(f"transform(pieces, p -> struct(p.start_pos, p.end_pos, p.own_pos, p.n_tokens, {said} as piece_text))")).alias("piece", "p"))
    return cut.select(F.col("own_key").alias(key), F.col("piece").cast("int").alias("piece"), "n_pieces", "p.start_pos", "p.end_pos", "p.own_pos", "p.n_tokens", "p.piece_text")
