"""Grids of tokens. Text form: rows end at a newline, cells at a blank.
Cell form: array<array<string>>."""

import pyarrow as pa
from pyspark.sql import functions as F

from gridprep.constants import BLANK, DOMINANCE_THRESHOLD, GRID_SIZE, PALETTE_START
from gridprep.functions.text import apart, empty_array, let, line_words, lines, split_line_words


def text_to_grid(data):
    """Cells at single blanks, as the writer puts them."""
    return F.transform(lines(data), lambda line: F.split(line, " "))


def grid_cells(data):
    """Cells at any whitespace, as the filters see them."""
    return line_words(data)


def grid_to_text(cells):
    return F.array_join(F.transform(cells, lambda row: F.array_join(row, " ")), "\n")


def grid_size(data):
    """Number of rows."""
    return F.length(data) - F.length(F.replace(data, F.lit("\n"), F.lit(""))) + 1


def first_ragged_row(data):
    """Index of the first row with another number of cells than row 0, or null."""

    def cells_in(line):
        return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1

    return let(
        F.transform(lines(data), cells_in),
        lambda sizes: F.get(
            F.filter(
                F.transform(
                    sizes, lambda n, i: F.when(n != F.get(sizes, F.lit(0)), i)
                ),
                lambda i: i.isNotNull(),
            ),
            F.lit(0),
        ),
    )


def _has_ink(row):
    return F.size(F.array_remove(row, BLANK)) > 0


def trim_blank(cells):
    """Drop every wholly blank row, then every wholly blank column, inner ones too."""

    def inked_columns(rows):
        width = F.array_min(F.transform(rows, F.size))
        columns = F.filter(
            F.sequence(F.lit(0), width - 1),
            lambda x: F.exists(rows, lambda row: F.get(row, x) != BLANK),
        )
        return let(
            columns,
            lambda keep: F.transform(
                rows, lambda row: F.transform(keep, lambda x: F.get(row, x))
            ),
        )

    return let(
        F.filter(cells, _has_ink),
        lambda rows: F.when(F.size(rows) == 0, rows).otherwise(inked_columns(rows)),
    )


def fits(cells, size=GRID_SIZE):
    """True if the trimmed grid has at most `size` rows and columns."""
    width = F.coalesce(F.size(F.get(cells, F.lit(0))), F.lit(0))
    return (F.size(cells) <= size) & (width <= size)


def pad_center(cells, size=GRID_SIZE):
    """Text of the cells in the middle of a size × size blank grid; odd space goes right and below."""
    blank_row = " ".join([BLANK] * size)

    def padded(rows):
        width = F.size(F.get(rows, F.lit(0)))
        left = F.floor((F.lit(size) - width) / 2).cast("int")
        right = F.lit(size) - width - left
        top = F.floor((F.lit(size) - F.size(rows)) / 2).cast("int")
        bottom = F.lit(size) - F.size(rows) - top
        body = F.transform(
            rows,
            lambda row: F.array_join(
                F.concat(F.array_repeat(F.lit(BLANK), left), row, F.array_repeat(F.lit(BLANK), right)), " "
            ),
        )
        return F.array_join(
            F.concat(
                F.array_repeat(F.lit(blank_row), top), body, F.array_repeat(F.lit(blank_row), bottom)
            ),
            "\n",
        )

    one_empty_row = F.array(empty_array("string"))
    return let(F.when(F.size(cells) == 0, one_empty_row).otherwise(cells), padded)


def flip_horizontal(data):
    return F.array_join(
        F.transform(split_line_words(data), lambda cells: F.array_join(F.reverse(cells), " ")), "\n"
    )


def permute_channels(data, permutation):
    """Swap colour channels; `permutation[i]` is the source (r, g, b) of channel i."""
    return permute_channels_by(data, F.lit(0), {0: permutation})


def permute_channels_by(data, choice, permutations):
    """Swap colour channels by the permutation that `choice`, a number of each row, has in a dictionary; None swaps nothing, and a
    number that is not there gives null."""
    tables = {label: {} if permutation is None else _recoding(permutation) for label, permutation in permutations.items()}

    @F.arrow_udf("string")
    def recoded(texts: pa.Array, labels: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), labels.to_pylist())
        return pa.array([None if text is None or label not in tables else text.translate(tables[label]) for text, label in rows], pa.string())

    return apart(recoded)(data, choice)


def _recoding(permutation):
    table = {}
    for index in range(64):
        levels = (index // 16, index // 4 % 4, index % 4)
        r, g, b = (levels[i] for i in permutation)
        table[PALETTE_START + index] = PALETTE_START + r * 16 + g * 4 + b
    return table


def border_is_blank(cells):
    """All four corners are blank and blank is the most common border cell.

    A tie goes to the token met first in the order top, left, right, bottom. A border
    without cells is refused.
    """

    def judge(rows):
        first, last = F.get(rows, F.lit(0)), F.element_at(rows, -1)
        corners = [
            F.get(first, F.lit(0)), F.try_element_at(first, F.lit(-1)),
            F.get(last, F.lit(0)), F.try_element_at(last, F.lit(-1)),
        ]
        corners_blank = F.lit(True)
        for corner in corners:
            corners_blank = corners_blank & F.coalesce(corner == BLANK, F.lit(False))
        inner = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 2, F.lit(0)))

        def without_ends(row):
            return F.slice(row, F.lit(2), F.greatest(F.size(row) - 2, F.lit(0)))

        margin = F.concat(
            without_ends(first),
            F.transform(inner, lambda row: F.get(row, F.lit(0))),
            F.transform(inner, lambda row: F.try_element_at(row, F.lit(-1))),
            without_ends(last),
        )
        return corners_blank & F.coalesce(let(margin, most_common) == BLANK, F.lit(False))

    return F.when(F.size(cells) == 0, F.lit(False)).otherwise(let(cells, judge))


def most_common(values):
    """The most frequent element, the first met on a tie; null for an empty array."""
    ranked = F.transform(
        F.array_distinct(values),
        lambda value, i: F.struct(
            (F.size(values) - F.size(F.array_remove(values, value))).alias("n"),
            (-i).alias("order"),
            value.alias("value"),
        ),
    )
    return F.array_max(ranked)["value"]


def is_dominated(tokens, threshold=DOMINANCE_THRESHOLD):
    """True if there are no tokens or one token's share reaches the threshold.

    A token with that share fills a run of the sorted tokens that is long enough to hold
    one of a few fixed positions, so only the tokens there are counted.
    """

    def judge(ordered):
        total = F.size(ordered)
        step = F.greatest(F.floor(total * F.lit(threshold)).cast("int") - 1, F.lit(1))
        candidates = F.transform(
            F.sequence(F.lit(1), F.floor(total / step).cast("int")),
            lambda k: F.element_at(ordered, k * step),
        )
        return F.exists(
            F.array_distinct(candidates),
            lambda token: (total - F.size(F.array_remove(ordered, token))) / total >= threshold,
        )

    return F.when(F.size(tokens) == 0, F.lit(True)).otherwise(let(F.sort_array(tokens), judge))
