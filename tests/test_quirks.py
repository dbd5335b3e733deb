"""Kept behaviour at the edges, and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from gridprep import constants as C
from gridprep.functions import grids as G
from gridprep.functions import names as N
from gridprep.functions import tokens as T
from gridprep.functions.pixels import over_white, palette_level, palette_token
from gridprep.functions.text import line_words, running_sum, split_line_words, words
from gridprep.operators.augment import augment
from gridprep.operators.metadata import join_metadata
from gridprep.operators.sequences import chunk_pad, row_report, row_state, sliding_chunks, to_sequence
from gridprep.operators.validate import check_rectangular, filter_border, filter_dominant, fit_grid
from gridprep.operators.vocab import build_vocab, decode_ids, encode_ids, marker_ids, token_weights
from gridprep.plans.jobs import grids_to_training_table, training_to_batches

GRID_SCHEMA = "generation STRING, game_name STRING, name STRING, data STRING"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def grid(spark, text, name="001.txt"):
    return spark.createDataFrame([("gen3", "a", name, text)], GRID_SCHEMA)


@pytest.mark.parametrize("rgb, token", [
    ((246, 246, 246), "~"), ((245, 255, 255), chr(59 + 63)), ((9, 9, 9), "~"), ((10, 0, 0), ";"), ((255, 0, 0), chr(59 + 48)),
])
def test_blank_rule(spark, rgb, token):
    assert value(spark, palette_token(*[F.lit(c) for c in rgb])) == token


def test_alpha_is_cut_not_rounded(spark):
    for c, a in ((0, 0), (255, 255), (100, 128), (3, 254), (77, 1)):
        share = a / 255.0
        assert value(spark, over_white(F.lit(c), F.lit(a))) == int(c * share + 255 * (1 - share))


def test_decode_and_encode_are_stable(spark):
    for index in range(64):
        token = chr(59 + index)
        levels = [palette_level(F.lit(token), c) for c in "rgb"]
        assert value(spark, palette_token(*levels)) in (token,)
    assert value(spark, palette_level(F.lit(None).cast("string"), "r")) == 0
    assert value(spark, palette_level(F.lit("~"), "b")) == 255


def test_words_like_python(spark):
    texts = ["", " ", "a", " a  b\tc\n d e f \x1cg\x85h", "x\r\ny\x0bz\n", "\n\na\n"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").select(
        "i", words(F.col("t")).alias("w"), line_words(F.col("t")).alias("l"), split_line_words(F.col("t")).alias("s"))
    for row in found.collect():
        text = texts[row["i"]]
        assert row["w"] == text.split()
        assert row["l"] == [line.split() for line in text.split("\n")]
        assert row["s"] == [line.split() for line in text.splitlines()]


def test_trim_drops_inner_blank_lines_and_columns(spark):
    cells = G.grid_to_text(G.trim_blank(G.grid_cells(F.lit("~ ~ ~ ~\na ~ ~ b\n~ ~ ~ ~\nc ~ ~ ~"))))
    assert value(spark, cells) == "a b\nc ~"


def test_blank_grid_is_padded_to_a_blank_grid(spark):
    blank = "\n".join([" ".join(["~"] * 64)] * 64)
    assert fit_grid(grid(spark, "~ ~\n~ ~")).first()["data"] == blank
    assert fit_grid(grid(spark, "")).first()["data"] == blank


def test_odd_space_goes_right_and_below(spark):
    data = fit_grid(grid(spark, "a b\nc d"), size=5).first()["data"]
    assert data == "~ ~ ~ ~ ~\n~ a b ~ ~\n~ c d ~ ~\n~ ~ ~ ~ ~\n~ ~ ~ ~ ~"


def test_oversize_grid_is_dropped_and_full_one_kept(spark):
    rows = [("gen3", "a", str(n), "\n".join([" ".join(["a"] * n)] * n)) for n in (64, 65)]
    assert [r["name"] for r in fit_grid(spark.createDataFrame(rows, GRID_SCHEMA)).collect()] == ["64"]


@pytest.mark.parametrize("text, kept", [
    ("~ a ~\n~ b ~\n~ ~ ~", True),            # border: a ~ ~ ~
    ("~ a ~\na b ~\n~ ~ ~", False),           # a tie, and a comes first
    ("~ ~ ~\na b a\n~ ~ ~", True),            # a tie, and blank comes first
    ("a ~ ~\n~ b ~\n~ ~ ~", False),           # a corner has colour
    ("~ ~\n~ ~", False),                       # no border cells
    ("~", False),
])
def test_border(spark, text, kept):
    assert (filter_border(grid(spark, text)).count() == 1) == kept


@pytest.mark.parametrize("tokens, kept", [
    (["a"] * 19 + ["b"], False), (["a"] * 18 + ["b"] * 2, True), (["a"], False), ([], False), (["a", "b"], True),
])
def test_dominance(spark, tokens, kept):
    assert (filter_dominant(grid(spark, " ".join(tokens))).count() == 1) == kept


def test_dominance_against_counting(spark):
    chance = random.Random(5)
    texts = [[chance.choice("abcdefg"[:k]) for _ in range(chance.randint(1, 40))] for k in range(1, 8) for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i INT, t STRING")
    for threshold in (0.95, 0.5, 0.3, 0.2):
        found = {r["i"] for r in df.where(G.is_dominated(words(F.col("t")), threshold)).collect()}
        assert found == {i for i, t in enumerate(texts) if max(map(t.count, t)) / len(t) >= threshold}


def test_rectangular_check_names_the_row(spark):
    df = grid(spark, "a b\nc d\ne")
    assert check_rectangular(df, on_error="flag").first()["ragged_row"] == 2
    assert check_rectangular(df, on_error="drop").count() == 0
    with pytest.raises(Exception, match="row 2 has another number"):
        check_rectangular(df).collect()
    assert check_rectangular(grid(spark, "a b\nc d")).first()["data"] == "a b\nc d"


def test_flip_twice_is_identity(spark):
    text = "a b c\nd e f"
    assert value(spark, G.flip_horizontal(F.lit(text))) == "c b a\nf e d"
    assert value(spark, G.flip_horizontal(G.flip_horizontal(F.lit(text)))) == text
    assert value(spark, G.flip_horizontal(F.lit("a b\nc d\n"))) == "b a\nd c"


def test_permutations_are_a_group(spark):
    palette = " ".join(chr(59 + i) for i in range(64)) + " ~"
    images = {value(spark, G.permute_channels(F.lit(palette), p)) for _, p in C.PERMUTATIONS} | {palette}
    assert len(images) == 6
    for text in images:
        assert {value(spark, G.permute_channels(F.lit(text), p)) for _, p in C.PERMUTATIONS} | {text} == images


def test_augment_makes_twelve_named_variants(spark):
    found = {r["name"]: (r["data"], r["color_shift"]) for r in augment(grid(spark, "; z ~")).collect()}
    assert len(found) == 12
    assert found["001.txt"] == ("; z ~", 0) and found["001_flip.txt"] == ("~ z ;", 0)
    red_as_green = augment(grid(spark, chr(59 + 48))).where("name = '001_rg.txt'").first()
    assert (red_as_green["data"], red_as_green["color_shift"]) == (chr(59 + 12), 1)
    one = augment(grid(spark, "a"), [("_rb", (2, 1, 0))])
    assert sorted(r["name"] for r in one.collect()) == ["001.txt", "001_flip.txt", "001_rb.txt", "001_rb_flip.txt"]


@pytest.mark.parametrize("name, key", [
    ("025.txt", "025"), ("025_flip.txt", "025"), ("025_rg_flip.txt", "025"), ("025_frame2.txt", "025"),
    ("025_frame2_flip.txt", "025"), ("025_frame2_rg.txt", "025_frame2"), ("025_frame2_rg_flip.txt", "025_frame2"),
    ("025_shiny_cyc1.txt", "025_shiny"),
])
def test_identity_key(spark, name, key):
    assert value(spark, N.identity_key(F.lit(name))) == key


def test_names(spark):
    assert value(spark, N.species_id(F.lit("007_shiny.txt"))) == "7"
    assert value(spark, N.species_id(F.lit("egg.txt"))) == ""
    assert value(spark, N.species_id(F.lit("000.txt"))) == "0"
    assert value(spark, N.name_chars(F.lit("025_shiny_flip.txt"))) == [48, 50, 53] + [0] * 13
    assert value(spark, N.name_chars(F.lit("_shiny.txt"))) == [0] * 16
    assert value(spark, N.name_chars(F.lit("a" * 20 + ".txt"))) == [97] * 16


def test_sequence_text(spark):
    assert value(spark, T.sequence_text(F.lit("a b c\n\n  \nd\ne f"), 3)) == "[ROW_00] b c [ROW_01] [ROW_02] f"
    assert value(spark, T.sequence_text(F.lit("a b c d\n\nd\ne f"), 3)) == "[ROW_00] b c [ROW_01] [ROW_02] f"
    assert value(spark, T.sequence_text(F.lit("a\tb\tc\td\ne  f"), 3)) == "[ROW_00] b c [ROW_01] f"
    assert value(spark, T.sequence_text(F.lit("\n".join(["a b"] * 66)))).endswith("[ROW_63] b [ROW_64] b [ROW_65] b")
    assert value(spark, T.sequence_text_bos(F.lit("a b c\nd e"), 3)) == "[BOS] a b 00 d [EOS]"
    assert value(spark, T.sequence_text_bos(F.lit("a"), 1)) == "[EOS]"


def test_positions(spark):
    tokens = F.split(F.lit("x [ROW_01] a b [ROW_00] c [ROW_64] d"), " ")
    assert value(spark, T.row_ids(tokens)) == [64, 1, 1, 1, 0, 0, 0, 0]
    assert value(spark, T.col_ids(tokens)) == [64, 64, 0, 1, 64, 0, 1, 2]
    ids = F.array(*[F.lit(i) for i in (70, 5, 71, 4, 72, 68)])
    assert value(spark, T.row_ids(ids, T.id_row)) == [64, 1, 1, 0, 0, 0]
    assert value(spark, T.row_ids(F.array().cast("array<string>"))) == []
    assert value(spark, T.col_ids(F.split(F.lit("[ROW_00]" + " a" * 70), " ")))[60:] == [59, 60, 61, 62, 63, 64, 64, 64, 64, 64, 64]


def test_fixed_positions_equal_those_of_the_markers(spark):
    tokens = [t for r in range(64) for t in [f"[ROW_{r:02d}]"] + ["~"] * 63]
    df = spark.createDataFrame([(tokens,)], "t ARRAY<STRING>")
    row = df.select(T.row_ids(F.col("t")).alias("r"), T.col_ids(F.col("t")).alias("c"),
                    T.row_pattern().alias("rp"), T.col_pattern().alias("cp"),
                    T.sequence_is_consistent(F.col("t")).alias("ok")).first()
    assert (row["r"], row["c"], row["ok"]) == (row["rp"], row["cp"], True)


def test_chunks(spark):
    df = spark.createDataFrame([(1, list(range(1, 8))), (2, [])], "k INT, input_ids ARRAY<INT>")
    chunks = sorted(chunk_pad(df, length=4).collect(), key=lambda r: (r["k"], r["chunk"]))
    assert [(r["k"], r["chunk"], r["input_ids"], r["attention_mask"]) for r in chunks] == [
        (1, 1, [1, 2, 3, 4], [1, 1, 1, 1]), (1, 2, [5, 6, 7, 0], [1, 1, 1, 0]), (2, 1, [0, 0, 0, 0], [0, 0, 0, 0])]
    assert chunks[0]["labels"] == chunks[0]["input_ids"]
    assert chunks[1]["row_ids"] == [0, 0, 0, 64] and chunks[1]["col_ids"] == [3, 4, 5, 64]
    assert chunks[2]["row_ids"] == [64] * 4


def test_sliding_chunks_drop_short_texts(spark):
    df = spark.createDataFrame([(1, list("abcdef")), (2, list("ab")), (3, list("abc"))], "k INT, tokens ARRAY<STRING>")
    found = sorted((r["k"], r["chunk"], "".join(r["window"])) for r in sliding_chunks(df, length=3, step=2).collect())
    assert found == [(1, 1, "abc"), (1, 2, "cde"), (3, 1, "abc")]


def test_vocabulary_and_lookups(spark):
    texts = spark.createDataFrame([(1, "[ROW_00] b a b"), (2, "[ROW_01] ~ [ ] \\ a")], "k INT, text STRING")
    vocab = build_vocab(texts)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert len(ids) == 68 + 6
    assert [ids[t] for t in ("[PAD]", "[UNK]", "[ROW_00]", "[ROW_63]", "[", "\\", "]", "a", "b", "~")] == [0, 3, 4, 67, 68, 69, 70, 71, 72, 73]
    assert [r["id"] for r in marker_ids(vocab).collect()] == list(range(4, 68))
    weights = {r["token"]: r["weight"] for r in token_weights(vocab).collect()}
    assert weights["~"] == 0.6 and weights["a"] == 1.0
    probes = spark.createDataFrame([(1, ["a", "zz", "[ROW_01]"]), (2, []), (3, ["~"] * 5)], "k INT, tokens ARRAY<STRING>")
    expected = [(1, [71, 3, 5]), (2, []), (3, [73] * 5)]
    for limit in (65_536, 5):
        texts = probes.select("k", F.concat(F.lit(" "), F.array_join("tokens", "  ")).alias("tokens"))
        assert sorted((r["k"], r["input_ids"]) for r in encode_ids(texts, vocab, ["k"], limit=limit).collect()) == expected
        coded = encode_ids(probes, vocab, ["k"], limit=limit).drop("tokens")
        assert sorted((r["k"], r["input_ids"]) for r in coded.collect()) == expected
        back = decode_ids(coded, vocab, ["k"], limit=limit)
        assert sorted((r["k"], r["tokens"]) for r in back.collect()) == [(1, ["a", "[UNK]", "[ROW_01]"]), (2, []), (3, ["~"] * 5)]


@pytest.mark.parametrize("split_multi, expected", [(False, [["ab", "~"], ["c", "~"]]), (True, [["a", "b"], ["c", "d"]])])
def test_tokens_to_grid(spark, split_multi, expected):
    tokens = F.split(F.lit("[ROW_00] [BOS] ab [ROW_01] [ROW_02] c [EOS] [ROW_77] d e f"), " ")
    if split_multi:
        tokens = F.split(F.lit("[ROW_00] [BOS] ab [ROW_01] [ROW_02] cd e [EOS] [ROW_77] d e f"), " ")
    cells = value(spark, T.tokens_to_grid(tokens, split_multi=split_multi, size=2))
    assert cells == expected


def test_tokens_to_grid_fills(spark):
    assert value(spark, T.tokens_to_grid(F.split(F.lit("a b"), " "), fill=None, size=3)) == [
        ["a", "b", None], [None] * 3, [None] * 3]
    assert value(spark, T.tokens_to_grid(F.array().cast("array<string>"), size=2)) == [["~", "~"], ["~", "~"]]


def test_row_state_counts_characters(spark):
    df = spark.createDataFrame([(1, "ab [ROW_00] abc [UNK] d [ROW_02] e".split()), (2, []), (3, ["x", "yz"])], "k INT, tokens ARRAY<STRING>")
    states = {r["k"]: (r["rows"], r["used"]) for r in row_state(df).collect()}
    assert states == {1: ([-1, 0, 0, 0, 0, 2, 2], [2, 0, 3, 3, 4, 0, 1]), 2: ([], []), 3: ([-1, -1], [1, 3])}
    report = [(r["row"], r["used"], r["full"], r["in_order"]) for r in row_report(df, width=4).orderBy("segment").collect()]
    assert report == [(0, 4, True, True), (2, 1, False, False)]


def test_running_sum(spark):
    df = spark.createDataFrame([(1, [3, 1, 2]), (2, []), (3, None), (4, [5])], "k INT, a ARRAY<INT>").repartition(2)
    sums = {r["k"]: r["s"] for r in df.withColumn("s", running_sum(F.col("a"))).collect()}
    assert sums == {1: [3, 4, 6], 2: [], 3: [], 4: [5]}


def test_metadata_defaults(spark):
    names = spark.createDataFrame([("001.txt", "gen3"), ("002_shiny.txt", "gen4"), ("egg.txt", "gen3")], "name STRING, generation STRING")
    species = spark.createDataFrame(
        [(1, "fire", None, 9, True, "red", None, None), (1, "water", "mist", 2, True, "teal", "bug-wings", "moon")],
        "id INT, type_1 STRING, type_2 STRING, evolution_stage INT, has_evolution BOOLEAN, color STRING, shape STRING, habitat STRING",
    ).withColumn("position", F.monotonically_increasing_id())
    found = {r["name"]: r for r in join_metadata(names, species).collect()}
    one, two = found["001.txt"], found["002_shiny.txt"]
    assert (one["type1_idx"], one["type2_idx"], one["evolution_stage_idx"], one["has_evolution_idx"]) == (2, 18, 1, 1)
    assert (one["color_idx"], one["shape_idx"], one["habitat_idx"], one["is_baby_idx"]) == (10, 12, 9, 0)
    assert (two["type1_idx"], two["type2_idx"], two["is_shiny"], two["generation_idx"], two["evolution_stage_idx"]) == (18, 18, 1, 3, 0)


def test_training_table_of_one_full_grid(spark):
    rows = [("gen3", "a", "001.txt", "\n".join([" ".join(["a"] * n)] * n)) for n in (64, 65)]
    meta = spark.createDataFrame([(1, "fire")], "id INT, type_1 STRING")
    train, vocab = grids_to_training_table(spark.createDataFrame(rows, GRID_SCHEMA), meta)
    found = train.collect()
    assert len(found) == 12
    assert {"name", "chunk", "labels", "input_ids", "input_text", "original_text", "attention_mask", "identity_idx", "row_ids",
            "col_ids", "generation", "game_name", "color_shift", "type1_idx", "name_chars"} <= set(train.columns)
    for row in found:
        assert len(row["input_ids"]) == 4096 and sum(row["attention_mask"]) == 4096
        assert row["input_ids"][:64] == [4] + [row["input_ids"][1]] * 63 and row["identity_idx"] == 0
    batches, weights, markers = training_to_batches(train, vocab, 5)
    assert sorted(b["n"] for b in batches.collect()) == [2, 5, 5]
    assert weights.where("weight < 1").count() == 0 and markers.count() == 64


def test_training_table_pads_a_longer_context(spark):
    meta = spark.createDataFrame([(1, "fire")], "id INT, type_1 STRING")
    train, _ = grids_to_training_table(grid(spark, "a b\nc d"), meta, context_length=5000)
    row = train.where("name = '001.txt'").first()
    assert len(row["input_ids"]) == 5000 and sum(row["attention_mask"]) == 4096
    assert row["row_ids"][4095:4097] == [63, 64] and row["col_ids"][4095:4097] == [62, 64]


def test_empty_grid_has_no_sequence(spark):
    assert to_sequence(grid(spark, "")).count() == 0
    assert to_sequence(grid(spark, " ")).first()["text"] == ""
