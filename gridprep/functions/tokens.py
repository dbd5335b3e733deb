"""Token sequences: text, markers, positions."""

import pyarrow as pa
from pyspark.sql import functions as F

from gridprep.constants import (
    BLANK, BOS, CONTEXT_LENGTH, EOS, FIRST_ROW_ID, GRID_SIZE, N_ROWS, POSITION_PAD,
    ROW_LENGTH, ROW_PREFIX, ROW_START, ROW_TOKENS, TEXT_PREFIX,
)
from gridprep.functions.text import apart, empty_array, let, line_words


def sequence_text(data, row_length=ROW_LENGTH):
    """Row marker and cells 1 to row_length - 1 of every line that is not empty."""

    @F.arrow_udf("string")
    def sequences(texts: pa.Array) -> pa.Array:
        return pa.array([None if text is None else _sequence(text, row_length) for text in texts.to_pylist()], pa.string())

    return apart(sequences)(data)


def _sequence(text, row_length):
    rows = filter(None, map(str.split, text.split("\n")))
    return " ".join([
        " ".join([ROW_TOKENS[i] if i < N_ROWS else f"{ROW_PREFIX}{i}]", *cells[1:row_length]]) for i, cells in enumerate(rows)
    ])


def sequence_text_bos(data, row_length=ROW_LENGTH):
    """Older form: a row start before every line, cut to row_length; first cell BOS, last EOS.

    One row of one cell ends as EOS, since the last cell is set after the first.
    """
    rows = F.transform(
        line_words(data),
        lambda row: F.slice(F.concat(F.array(F.lit(ROW_START)), row), F.lit(1), F.lit(row_length)),
    )

    def with_ends(tokens):
        n = F.size(tokens)
        return F.when(n == 1, F.array(F.lit(EOS))).otherwise(
            F.concat(F.array(F.lit(BOS)), F.slice(tokens, F.lit(2), n - 2), F.array(F.lit(EOS)))
        )

    return F.array_join(let(F.flatten(rows), with_ends), " ")


def text_prefix(text):
    return F.substring(text, 1, TEXT_PREFIX)


def token_row(token):
    """Row number of a row marker, else null."""
    number = F.substring(token, 6, 2).try_cast("int")
    return F.when(token.startswith(ROW_PREFIX) & token.isin(ROW_TOKENS), number)


def id_row(token_id):
    """Row number of a row marker id, else null."""
    return F.when(
        token_id.between(FIRST_ROW_ID, FIRST_ROW_ID + N_ROWS - 1), token_id - FIRST_ROW_ID
    ).cast("int")


def is_special(token):
    return token.startswith("[") & token.endswith("]")


def token_length(token):
    """Characters a token fills in a row; special tokens fill none."""
    return F.when(is_special(token), F.lit(0)).otherwise(F.length(token))


def _markers(tokens, row_of):
    marked = F.transform(tokens, lambda t, i: F.struct(i.alias("at"), row_of(t).alias("row")))
    return F.filter(marked, lambda m: m["row"].isNotNull())


def _by_segment(tokens, row_of, before, inside):
    """Concatenate `before(n)` for the part ahead of the first marker and
    `inside(row, n, start)` for every marker with what follows it, in linear time."""

    def build(seq):
        def joined(marks):
            end = F.coalesce(F.get(marks, F.lit(0))["at"], F.size(seq))
            parts = F.transform(
                marks,
                lambda m, k: inside(
                    m["row"], F.coalesce(F.get(marks, k + 1)["at"], F.size(seq)) - m["at"], m["at"]
                ),
            )
            return F.concat(before(end), F.flatten(parts))

        return let(_markers(seq, row_of), joined)

    return let(tokens, build)


def row_ids(tokens, row_of=token_row):
    """Row of the last marker seen, 64 before the first."""
    return _by_segment(
        tokens,
        row_of,
        lambda n: F.array_repeat(F.lit(POSITION_PAD), n),
        lambda row, n, start: F.array_repeat(row, n),
    )


def col_ids(tokens, row_of=token_row):
    """Cells since the last marker, from 0; 64 for markers, before the first and from cell 64 on."""
    columns = F.sequence(F.lit(0), F.lit(POSITION_PAD - 1))
    return _by_segment(
        tokens,
        row_of,
        lambda n: F.array_repeat(F.lit(POSITION_PAD), n),
        lambda row, n, start: F.concat(
            F.array(F.lit(POSITION_PAD)),
            F.slice(columns, F.lit(1), F.least(n - 1, F.lit(POSITION_PAD))),
            F.array_repeat(F.lit(POSITION_PAD), F.greatest(n - 1 - POSITION_PAD, F.lit(0))),
        ),
    )


def _pattern(row_body):
    return F.flatten(F.array(*[row_body(r) for r in range(N_ROWS)]))


def row_pattern():
    """Row ids of a full sequence, a constant."""
    return _pattern(lambda r: F.array_repeat(F.lit(r), ROW_LENGTH))


def col_pattern():
    """Column ids of a full sequence, a constant."""
    return _pattern(
        lambda r: F.concat(F.array(F.lit(POSITION_PAD)), F.sequence(F.lit(0), F.lit(ROW_LENGTH - 2)))
    )


def position_ids(pattern, start, count, length):
    """`count` ids from position `start` on, filled up to `length` (a number or a column) with the padding id.

    A full sequence has CONTEXT_LENGTH positions; what stands beyond is no place in a grid and has the padding id too.
    """
    inside = F.greatest(F.least(count, F.lit(CONTEXT_LENGTH) - start), F.lit(0))
    return F.concat(
        F.slice(pattern, start + 1, inside),
        F.array_repeat(F.lit(POSITION_PAD), F.lit(length) - inside),
    )


def sequence_is_consistent(tokens):
    """True for 64 markers in order, each followed by 63 tokens that are no markers."""

    def judge(seq):
        in_place = F.forall(
            F.transform(seq, lambda t, i: F.struct(i.alias("i"), token_row(t).alias("row"))),
            lambda m: m["row"].eqNullSafe(
                F.when(m["i"] % ROW_LENGTH == 0, F.floor(m["i"] / ROW_LENGTH).cast("int"))
            ),
        )
        return (F.size(seq) == CONTEXT_LENGTH) & in_place

    return let(tokens, judge)


def tokens_to_grid(tokens, fill=BLANK, split_multi=False, size=GRID_SIZE):
    """Cells of a token sequence: rows end at row markers, special tokens and empty rows go,
    the first `size` rows and cells stay, `fill` (None for black) completes them.

    With `split_multi` a token of several characters is as many cells.
    """

    def is_delimiter(token):
        return token.startswith(ROW_PREFIX) & token.endswith("]")

    def skipped(token):
        return token.rlike(r"^\[[A-Z_0-9]+\]$") if split_multi else is_special(token)

    def row_cells(part):
        kept = F.filter(part, lambda t: ~skipped(t))
        if split_multi:
            kept = F.flatten(F.transform(kept, lambda t: F.split(t, "")))
        return kept

    fill_cell = F.lit(fill).cast("string")

    def build(seq):
        bounds = F.concat(
            F.array(F.lit(-1)),
            F.filter(
                F.transform(seq, lambda t, i: F.when(is_delimiter(t), i)), lambda i: i.isNotNull()
            ),
            F.array(F.size(seq)),
        )

        def rows_of(marks):
            parts = F.transform(
                F.slice(marks, F.lit(1), F.size(marks) - 1),
                lambda at, k: F.slice(seq, at + 2, F.get(marks, k + 1) - at - 1),
            )
            return F.filter(F.transform(parts, row_cells), lambda row: F.size(row) > 0)

        return let(bounds, rows_of)

    def squared(rows):
        body = F.transform(
            F.slice(rows, F.lit(1), F.lit(size)),
            lambda row: F.concat(
                F.slice(row, F.lit(1), F.lit(size)),
                F.array_repeat(fill_cell, F.greatest(F.lit(size) - F.size(row), F.lit(0))),
            ),
        )
        missing = F.greatest(F.lit(size) - F.size(rows), F.lit(0))
        return F.concat(body, F.array_repeat(F.array_repeat(fill_cell, size), missing))

    return let(let(F.coalesce(tokens, empty_array("string")), build), squared)
