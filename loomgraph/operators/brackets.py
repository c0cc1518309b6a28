"""Pairing of brackets at any depth, with byte, line and column places.

A text is first masked, in built-in functions: what a token pattern matches
(comments, strings) becomes blanks or quotes of as many bytes, so that places stay.
It is then cut behind every mark (brackets and separators), in one pass per text;
a running depth gives each piece its level, and brackets of one level alternate, so
that the partner of an opening one is the next closing one of its level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import col

OPENING, CLOSING = "({[", ")}]"
CUT = "\u0001"
#: Bytes of texts that are sent to a task's Python step at once, or one text.
BATCH_BYTES = 16 << 20


def blanks(c: Column) -> Column:
    """As many bytes of blanks, with the line breaks kept."""
    for chars, size in ((r"[\x{80}-\x{7FF}]", 2), (r"[\x{800}-\x{FFFF}]", 3), (r"[\x{10000}-\x{10FFFF}]", 4)):
        c = F.regexp_replace(c, chars, " " * size)
    return F.regexp_replace(c, r"[^\n]", " ")


def cut_out(text: Column | str, token: str) -> Column:
    """The text as an array: what lies between tokens at even places (from 0), the tokens at odd ones.

    ``token`` is a regular expression without groups that capture.
    """
    marked = F.regexp_replace(F.translate(col(text), CUT, " "), f"({token})", f"{CUT}$1{CUT}")
    return F.split(marked, CUT)


def masked(text: Column | str, token: str) -> Column:
    """The text with every token hidden byte for byte: comments (they begin with a slash) as blanks, all others as quotes."""
    def hidden(p: Column) -> Column:
        return F.when(F.startswith(p, F.lit("/")), blanks(p)).otherwise(F.translate(blanks(p), " ", "'"))

    return F.array_join(F.transform(cut_out(text, token), lambda p, i: F.when(i % 2 == 0, p).otherwise(hidden(p))), "")


def line_breaks(c: Column | str) -> Column:
    return F.length(col(c)) - F.length(F.replace(col(c), F.lit("\n"), F.lit("")))


def last_line_bytes(c: Column | str) -> Column:
    """Bytes behind the last line break, or of all."""
    return F.octet_length(F.substring_index(col(c), "\n", -1))


def place_after(line: Column, column: Column, text: Column) -> tuple[Column, Column]:
    """(line, column) behind a text that begins at line and column; both count from 1, columns in bytes."""
    return line + line_breaks(text), F.when(line_breaks(text) > 0, F.lit(1)).otherwise(column) + last_line_bytes(text)


#: Pieces that leave a task's Python step at once.
STEP_PIECES = 20_000

_PIECE = (
    "pos int, piece binary, mark string, start_byte long, end_byte long, start_line long, start_col long, level long, "
    "close struct<byte: long, line: long>, block int, within long, "
    "head struct<mark: string, piece: binary, start_byte: long, start_line: long, start_col: long, end_byte: long, text: binary>"
)
_ARROW = pa.schema([
    ("pos", pa.int32()), ("piece", pa.binary()), ("mark", pa.string()), *[(c, pa.int64()) for c in ("start_byte", "end_byte", "start_line", "start_col", "level")],
    ("close", pa.struct([("byte", pa.int64()), ("line", pa.int64())])), ("block", pa.int32()), ("within", pa.int64()),
    ("head", pa.struct([
        ("mark", pa.string()), ("piece", pa.binary()), *[(c, pa.int64()) for c in ("start_byte", "start_line", "start_col", "end_byte")], ("text", pa.binary()),
    ])),
])


def _paired(text: bytes, source: bytes, marks: str, ends: re.Pattern[bytes], around: re.Pattern[bytes] | None) -> list[list]:
    """The pieces of one text, a list per column of ``_ARROW``."""
    names = {ord(m): m for m in marks}
    found = ends.split(text)
    rows, at, line, line_byte, depth = [], 0, 1, 0, 0
    last_open: dict[int, int] = {}  # level -> piece of the latest opening mark
    waiting: dict[int, int] = {}  # level -> piece of the opening mark without a partner so far
    close: list = [None] * len(found)
    block: list = [None] * len(found)
    head: list = [None] * len(found)
    closed = None  # mark of the piece before, if it closes
    for pos, piece in enumerate(found):
        mark = names.get(piece[-1]) if piece else None
        opens, closes = mark is not None and mark in OPENING, mark is not None and mark in CLOSING
        level, end, breaks = depth + opens, at + len(piece), piece.count(b"\n")
        rows.append((pos, piece, mark, at, end, line, at - line_byte + 1, level))
        line += breaks
        if breaks:
            line_byte = at + piece.rindex(b"\n") + 1
        if opens:
            first = block[pos - 1] if closed else None
            if first is not None:
                _, opening, _, start, stop, *place, _ = rows[first]
                head[pos] = {
                    "mark": closed, "piece": opening, "start_byte": start, "start_line": place[0], "start_col": place[1], "end_byte": stop, "text": source[stop - 1 : at],
                }
            last_open[level] = waiting[level] = pos
        else:
            block[pos] = last_open.get(level)
        if closes and level in waiting:
            close[waiting.pop(level)] = {"byte": end, "line": line}
        depth, at, closed = depth + opens - closes, end, mark if closes else None
    for pos in waiting.values():
        close[pos] = {"byte": at, "line": line}
    within: list = [None] * len(found)
    if around is not None:
        far = None
        for pos, piece in enumerate(found):
            within[pos] = far
            if close[pos] is not None and around.search(piece):
                far = max(far or 0, close[pos]["byte"])
    return [*map(list, zip(*rows)), close, block, within, head]


def _cutter(keys: Sequence[str], text: str, source: str, marks: str, around: str | None):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = re.compile(f"(?<=[{''.join(chr(92) + m for m in marks)}])".encode())
        found = re.compile(around.encode()) if around else None
        for batch in batches:
            texts, sources, own = batch.column(text), batch.column(source), batch.select(list(keys))
            at: list[int] = []
            columns: list[list] = [[] for _ in _ARROW]

            def step() -> Iterator[pa.RecordBatch]:
                for i in range(0, len(at), STEP_PIECES):
                    left = own.take(pa.array(at[i : i + STEP_PIECES], pa.int64()))
                    right = [pa.array(c[i : i + STEP_PIECES], f.type) for c, f in zip(columns, _ARROW)]
                    yield pa.RecordBatch.from_arrays([*left.columns, *right], names=[*keys, *_ARROW.names])
                at.clear()
                for c in columns:
                    c.clear()

            for row in range(batch.num_rows):
                value = texts[row].as_py()
                if value is None:
                    continue
                new = _paired(value, sources[row].as_py(), marks, ends, found)
                at.extend([row] * len(new[0]))
                for c, n in zip(columns, new):
                    c.extend(n)
                if len(at) >= STEP_PIECES:
                    yield from step()
            yield from step()

    return cut


def pieces(rows: DataFrame, keys: Sequence[str], text: str, marks: str, around: str | None = None, source: str | None = None) -> DataFrame:
    """One row per piece: keys, pos, piece, mark, start_byte, end_byte, start_line, start_col, level, close, block, within, head.

    A piece ends with its mark; the last one may have none (NULL).  ``level`` is
    that of the bracket an opening or closing mark belongs to, else of the bracket
    around the piece.  ``close`` (byte, line) is the end of the partner of an
    opening mark, or of the text if it has none; ``block`` is the ``pos`` of a closing
    mark's partner, or of the bracket around a piece without bracket.  ``within`` is the
    furthest end of the earlier brackets whose opening piece matches the regular
    expression ``around``.  ``head``, of an opening mark whose piece is behind a closing
    one, is that closing mark, the piece of its partner with its place, and what lies
    from the one bracket to the other in ``source`` (a text of the same bytes before
    masking, by default the text itself).  One text is the unit of work: it is taken
    apart where it is read, no rows are shuffled or sorted, and a task holds the pieces
    of one text and ``STEP_PIECES`` at a time.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    raw = rows.select(*keys, *[F.col(c).cast("binary").alias(c) for c in dict.fromkeys([text, source or text])])
    cut = raw.mapInArrow(_cutter(keys, text, source or text, marks, around), f"{types}, {_PIECE}")
    return cut.withColumn("piece", F.col("piece").cast("string"))
