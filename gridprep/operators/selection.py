"""Sampling and selection. Chance is a hash of a seed and the row's key, so a run can be repeated."""

from math import pi

from pyspark.sql import Window, functions as F

from gridprep.constants import (
    EOS, FIELD_RANGES, N_ROWS, ROW_LENGTH, ROW_TOKENS,
)
from gridprep.functions.names import output_name as output_name_column
from gridprep.functions.pixels import over_white
from gridprep.functions.text import hash_int
from gridprep.functions.tokens import token_length
from gridprep.operators.images import explode_pixels
from gridprep.operators.joins import MAX_BROADCAST_BYTES, join_unique, spread_join
from gridprep.session import stored

HASH_BUCKET_BITS = 16
HASH_BITS = 60


def sample_fields(df, key, seed=0, ranges=FIELD_RANGES, n_identities=None):
    """Fill each field that is missing or null with a value drawn from its range.

    With `n_identities`, `identity_idx` is one of the fields: a given one is kept, any other is drawn from the known ones.
    """
    columns = set(df.columns)
    if n_identities is not None:
        ranges = {**ranges, "identity_idx": n_identities}
    drawn = {}
    for field, size in ranges.items():
        value = (hash_int(seed, F.lit(field), *key) % size).cast("int")
        drawn[field] = F.coalesce(F.col(field), value) if field in columns else value
    return df.withColumns(drawn)


def resolve_conditioning(df, key, seed=0, ranges=FIELD_RANGES, n_identities=None):
    """A field's explicit value, else its fixed default, else a drawn one.

    Defaults: plain palette, not shiny, third or fourth generation.
    """
    columns = set(df.columns)
    defaults = {
        "color_shift": F.lit(0),
        "is_shiny": F.lit(0),
        "generation": (hash_int(seed, F.lit("default generation"), *key) % 2 + 2).cast("int"),
    }
    given = {
        field: F.coalesce(F.col(field), default) if field in columns and field != "color_shift" else default
        for field, default in defaults.items()
    }
    return sample_fields(df.withColumns(given), key, seed, ranges, n_identities)


def sample_picks(targets, key, n_vectors, n=3, seed=0):
    """`n` vector positions per target, each with a normally distributed logit."""
    picks = targets.select(*key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pick"))

    def uniform(name):
        return (hash_int(seed, F.lit(name), *key, "pick") % 1_000_000 + 0.5) / 1_000_000

    normal = F.sqrt(-2 * F.log(uniform("u1"))) * F.cos(2 * pi * uniform("u2"))
    return picks.withColumns({
        "vec_id": hash_int(seed, F.lit("pick"), *key, "pick") % n_vectors,
        "logit": normal,
    })


def blend_vectors(picks, vectors, key, vec_id="vec_id", vector="vector"):
    """The picked vectors of each target, added up with softmax weights.

    `picks` holds (key, pick, vec_id, logit), a few per target. The result is null if a picked vector is not found.
    """
    found = spread_join(picks, vectors.select(vec_id, vector), vec_id, "left", spread=[*key, "pick"])
    picked = found.groupBy(*key).agg(
        F.bool_and(F.col(vector).isNotNull()).alias("_all"),
        F.sort_array(F.collect_list(F.struct("pick", "logit", F.col(vector).cast("array<double>").alias("v")))).alias("_p")
    )
    top = F.array_max(F.transform("_p", lambda s: s["logit"]))
    total = F.aggregate("_p", F.lit(0.0), lambda a, s: a + F.exp(s["logit"] - F.col("_top")))
    zeros = F.transform(F.get("_p", F.lit(0))["v"], lambda v: F.lit(0.0))
    blended = F.aggregate(
        "_p", zeros,
        lambda acc, s: F.zip_with(
            acc, F.transform(s["v"], lambda v: v * (F.exp(s["logit"] - F.col("_top")) / F.col("_total"))),
            lambda a, v: a + v,
        ),
    )
    return picked.withColumn("_top", top).withColumn("_total", total).select(
        *key, F.when(F.col("_all"), blended).alias(vector)
    )


def sum_vectors(df, lookups, out="vector", most_bytes=MAX_BROADCAST_BYTES):
    """Add up one vector from each of several tables.

    `lookups` lists (column, table with `id` and `vector`). The sum is null if one is not found. Tables of up to
    `most_bytes` bytes as measured go to the tasks; wider ones are joined by shuffle, frequent ids spread.
    """
    kept = df.columns
    total = None
    for i, (column, table) in enumerate(lookups):
        renamed = table.select(
            F.col("id").alias(f"_id{i}"), F.col("vector").cast("array<double>").alias(f"_v{i}")
        )
        df = join_unique(df.withColumn(f"_id{i}", F.col(column)), renamed, [f"_id{i}"], "left", spread=kept, most_bytes=most_bytes)
        found = F.col(f"_v{i}")
        total = found if total is None else F.zip_with(total, found, lambda a, b: a + b)
    return df.select(*kept, total.alias(out))


def best_of_n(df, group, order, score="score", n=3, min_score=0.55):
    """Of the first `n` candidates of a group, the first that reaches `min_score`, else the
    first of the best. Each task cuts its groups to `n` rows before they are shuffled."""
    rest = [c for c in df.columns if c not in group]
    first = df.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    ).where(F.col("_n") <= n)
    row = F.struct(*rest)
    good = F.min_by(F.when(F.col(score) >= min_score, row), F.when(F.col(score) >= min_score, F.col("_n")))
    best = F.max_by(row, F.struct(F.col(score), -F.col("_n")))
    chosen = first.groupBy(*group).agg(F.coalesce(good, best).alias("_c"))
    return chosen.select(*group, *[F.col(f"_c.{c}").alias(c) for c in rest])


def with_output_name(df, prefix="sprite", out="output_name"):
    return df.withColumn(
        out,
        output_name_column(
            *[F.col(c) for c in ("identity_idx", "type1", "type2", "is_shiny", "generation", "evolution_stage", "has_evolution")],
            prefix=prefix,
        ),
    )


def _state_class(row, used, width):
    return (
        F.when(row < 0, F.lit("any"))
        .when(used < width, F.concat(F.lit("room "), width - used))
        .when(row < N_ROWS - 1, F.concat(F.lit("next "), row + 1))
        .otherwise(F.lit("end"))
    )


def with_token_class(states, row="row", used="used", width=ROW_LENGTH - 1, out="token_class"):
    """The class of each state; all states of a class allow the same tokens, those of `class_tokens`."""
    return states.withColumn(out, _state_class(F.col(row), F.col(used), width))


def class_tokens(vocab, width=ROW_LENGTH - 1):
    """(token_class, id): the ids allowed in each of the width + 65 classes of states, one row each."""
    sized = vocab.select("token", "id", token_length(F.col("token")).alias("_n"))
    room = sized.where(F.col("_n").between(1, width)).select(
        F.explode(F.sequence(F.col("_n"), F.lit(width))).alias("_room"), "id"
    ).select(F.concat(F.lit("room "), "_room").alias("token_class"), "id")
    following = vocab.where(F.col("token").isin(ROW_TOKENS[1:])).select(
        F.concat(F.lit("next "), F.substring("token", 6, 2).cast("int")).alias("token_class"), "id"
    )
    end = vocab.where(F.col("token") == EOS).select(F.lit("end").alias("token_class"), "id")
    anything = vocab.select(F.lit("any").alias("token_class"), "id")
    return room.unionByName(following).unionByName(end).unionByName(anything).distinct()


MASK_WORD = 64


def class_masks(vocab, width=ROW_LENGTH - 1):
    """(token_class, mask): the ids allowed in each class as bits, id i in bit i % 64 of word i // 64.

    Tokens are packed by length before the lengths that fit a room are joined, so what is shuffled grows with the number of
    words, not of tokens. A mask has an eighth of a byte for each id of the vocabulary.
    """
    ids = F.col("id").cast("long")
    word, bit = (ids / MASK_WORD).cast("int").alias("_word"), F.expr(f"shiftleft(1L, CAST(id % {MASK_WORD} AS INT))").alias("_bits")
    sized = vocab.select(token_length(F.col("token")).alias("_n"), word, bit).where(F.col("_n").between(1, width))
    lengths = sized.groupBy("_n", "_word").agg(F.bit_or("_bits").alias("_bits"))
    room = lengths.select(F.explode(F.sequence(F.col("_n"), F.lit(width))).alias("_room"), "_word", "_bits").select(
        F.concat(F.lit("room "), "_room").alias("token_class"), "_word", "_bits"
    )
    following = vocab.where(F.col("token").isin(ROW_TOKENS[1:])).select(
        F.concat(F.lit("next "), F.substring("token", 6, 2).cast("int")).alias("token_class"), word, bit
    )
    end = vocab.where(F.col("token") == EOS).select(F.lit("end").alias("token_class"), word, bit)
    anything = vocab.select(F.lit("any").alias("token_class"), word, bit)
    packed = room.unionByName(following).unionByName(end).unionByName(anything)
    packed = packed.groupBy("token_class", "_word").agg(F.bit_or("_bits").alias("_bits"))
    # empty words stand for themselves, so that the place in the array is the word
    blank = packed.groupBy("token_class").agg(F.max("_word").alias("_last")).select(
        "token_class", F.explode(F.sequence(F.lit(0), "_last")).alias("_word"), F.lit(0).cast("long").alias("_bits")
    )
    full = packed.unionByName(blank).groupBy("token_class", "_word").agg(F.bit_or("_bits").alias("_bits"))
    words = F.sort_array(F.collect_list(F.struct("_word", "_bits")))
    return full.groupBy("token_class").agg(F.transform(words, lambda w: w["_bits"]).alias("mask"))


def mask_allows(mask, id):
    """Whether a mask holds an id; a null mask holds none."""
    held = F.get(mask, (id / MASK_WORD).cast("int"))
    return F.coalesce(F.call_function("bit_get", held, (id % MASK_WORD).cast("int")) == 1, F.lit(False))


def mask_ids(mask):
    """The ids of a mask, in order; none for a null mask."""
    places = F.sequence(F.lit(0), F.lit(MASK_WORD - 1))
    ids = F.flatten(F.transform(mask, lambda held, word: F.transform(
        F.filter(places, lambda bit: F.call_function("bit_get", held, bit) == 1), lambda bit: bit + word * MASK_WORD
    )))
    return F.coalesce(ids, F.array().cast("array<int>"))


def with_token_mask(states, vocab, row="row", used="used", width=ROW_LENGTH - 1, out="mask", most_bytes=MAX_BROADCAST_BYTES):
    """The mask of each state's class, for a vocabulary of any size; null if the class allows nothing.

    Masks of up to `most_bytes` bytes go to the tasks, larger ones are joined by shuffle, the states of a class spread.
    """
    masks = class_masks(vocab, width).withColumnRenamed("mask", out)
    classed = with_token_class(states, row, used, width, "_class")
    return join_unique(classed, masks.withColumnRenamed("token_class", "_class"), ["_class"], "left", states.columns, most_bytes=most_bytes).drop("_class")


def allowed_tokens(states, vocab, row="row", used="used", width=ROW_LENGTH - 1):
    """Ids a constrained decoder may emit in each state, as a list beside it.

    A row with room takes tokens up to the room left, a full one only the next marker, or the
    end after the last row; before the first marker everything goes. States of a class share one mask, decoded once
    for the class. For a large vocabulary `with_token_mask` keeps the masks and `mask_allows` asks them.
    """
    lists = stored(class_masks(vocab, width), "masks").select(F.col("token_class").alias("_class"), mask_ids(F.col("mask")).alias("allowed"))
    classed = with_token_class(states, row, used, width, "_class")
    return (
        join_unique(classed, lists, ["_class"], "left", states.columns)
        .withColumn("allowed", F.coalesce("allowed", F.array().cast("array<int>")))
        .drop("_class")
    )


def make_negatives(images, key, seed=0, frac=0.5):
    """Pixel rows of every image with label 1 and of one made-up counterpart with label 0.

    By a hash of the key the counterpart has its rows shuffled, is noise, or has about `frac` of its
    pixels replaced. The rows are shuffled as pieces of the image's bytes. No row moves.
    """
    placed = images.withColumn("strategy", (hash_int(seed, F.lit("strategy"), *key) % 3).cast("int"))
    stride = F.col("width") * F.col("n_channels")
    new_order = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.col("height") - 1),
            lambda y: F.struct(hash_int(seed, F.lit("row"), *key, y).alias("h"), y.alias("y")),
        )
    )
    pieces = F.transform(new_order, lambda s: F.hex(F.substring("data", s["y"] * stride + 1, stride)))
    shuffled = F.unhex(F.array_join(pieces, ""))
    plain = explode_pixels(images, key).withColumns({"label": F.lit(1), "strategy": F.lit(None).cast("int")})
    changed = explode_pixels(
        placed.withColumn("data", F.when(F.col("strategy") == 0, shuffled).otherwise(F.col("data"))),
        [*key, "strategy"],
    ).withColumn("label", F.lit(0))
    white = plain.unionByName(changed).withColumns(
        {c: over_white(F.col(c), F.col("a")) for c in ("r", "g", "b")}
    ).drop("a")
    text = F.concat_ws(":", F.lit(str(seed)), F.lit("pixel"), *key, "y", "x")
    digits = white.withColumn("_h", F.when(F.col("strategy").isin(1, 2), F.md5(text)))

    def number(start, length):
        return F.conv(F.substring("_h", start, length), 16, 10).cast("int")

    replaced = (F.col("strategy") == 1) | (
        (F.col("strategy") == 2) & (number(7, 7) < int(frac * 16**7))
    )
    return digits.withColumns({
        c: F.when(replaced, number(1 + 2 * i, 2)).otherwise(F.col(c)) for i, c in enumerate("rgb")
    }).drop("_h")


def split_rows(df, key, frac=0.1, seed=0, out="is_validation"):
    """Mark exactly max(1, floor(n * frac)) rows, those with the smallest hashes of the unique key.

    A histogram of the hashes finds the bucket the limit falls into and only the rows of
    that bucket are sorted. The table itself is not shuffled.
    """
    hashed = df.withColumn("_hash", hash_int(seed, *key))
    bucket = F.shiftright("_hash", HASH_BITS - HASH_BUCKET_BITS).alias("_bucket")
    counts = hashed.groupBy(bucket).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    wanted = F.greatest(F.lit(1).cast("long"), F.floor(total * F.lit(frac)))
    before = F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")
    edge = counts.withColumn("_before", before).withColumn("_wanted", wanted).where(
        "_before < _wanted AND _before + _n >= _wanted"
    ).select("_bucket", (F.col("_wanted") - F.col("_before")).alias("_rank"))
    identity = F.struct("_hash", *key)
    position = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", *key))
    limit = (
        hashed.select("_hash", *key, bucket)
        .join(F.broadcast(edge), "_bucket")
        .withColumn("_position", position)
        .where("_position = _rank")
        .select(identity.alias("limit"))
        .scalar()
    )
    return hashed.withColumn(out, identity <= limit).drop("_hash")
