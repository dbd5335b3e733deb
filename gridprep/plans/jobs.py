"""From archives to batches."""

from pyspark.sql import functions as F

from gridprep.constants import CONTEXT_LENGTH, DEFAULT_GENERATIONS
from gridprep.functions.names import name_chars, swap_extension, variants
from gridprep.functions.tokens import text_prefix
from gridprep.operators.augment import augment, decode_palette
from gridprep.operators.batches import collate
from gridprep.operators.images import encode_images
from gridprep.operators.joins import join_unique
from gridprep.operators.keys import index_keys
from gridprep.operators.metadata import join_metadata
from gridprep.operators.sequences import chunk_pad, to_sequence
from gridprep.operators.validate import filter_border, filter_dominant, fit_grid, select_generations
from gridprep.operators.vocab import build_vocab, decode_ids, encode_ids, marker_ids, token_weights
from gridprep.session import bound_batches, ensure_checkpoint_dir
from gridprep.sources.images import extract_archives, name_members
from gridprep.sources.png import decode_png
from gridprep.sources.tables import upsert

TASKS_PER_CORE = 4


def archives_to_images(spark, pattern, path, prefix):
    """Store the PNG members of archives by key."""
    members = extract_archives(spark, pattern)
    upsert(name_members(members, prefix), path)


def stored_images(stored, generations=None):
    """The images that `archives_to_images` has stored, decoded, as `images_to_grids` reads them."""
    kept = stored if generations is None else select_generations(stored, generations)
    return decode_png(kept)


def images_to_grids(images, generations=DEFAULT_GENERATIONS):
    """Palette grids of the images that have a blank border and are not nearly one token."""
    grids = encode_images(select_generations(images, generations))
    named = grids.withColumn("name", swap_extension(F.col("name")))
    return filter_dominant(filter_border(named))


def grids_to_training_table(grids, metadata, context_length=CONTEXT_LENGTH, permutations=None):
    """(train, vocab) of the grids that fit, in all their variants."""
    ensure_checkpoint_dir(grids.sparkSession)
    bound_batches(grids.sparkSession)
    # read three times below: for the vocabulary, for the identities and for the table
    fitted = fit_grid(grids).checkpoint()
    grids = augment(fitted, permutations)
    vocab = build_vocab(to_sequence(grids.select("data")))
    # the species does not depend on the variant, so its codes are joined before the rows multiply
    joined = join_unique(join_metadata(fitted, metadata), variant_identities(fitted, permutations), ["name"], "left", spread=["data"])
    # a join by shuffle leaves about one task to a core, by the size of its rows; what follows makes twelve long ones of each
    tasks = max(fitted.rdd.getNumPartitions(), TASKS_PER_CORE * grids.sparkSession.sparkContext.defaultParallelism)
    described = augment(joined.repartition(tasks, "name", "data"), permutations)
    named = described.withColumn("name_chars", name_chars(F.col("name")).cast("array<bigint>"))
    indexed = named.withColumn("identity_idx", F.try_element_at("_identities", F.col("name"))).drop("_identities")
    encoded = encode_ids(to_sequence(indexed), vocab, tokens="text").drop("data")
    train = chunk_pad(encoded, "input_ids", context_length)
    train = train.withColumn("input_text", text_prefix(F.col("text"))).withColumnRenamed("text", "original_text")
    return train, vocab


def variant_identities(grids, permutations=None):
    """(name, _identities): once for each name, the identity numbers of its variants by their names.

    The numbers are joined with the names alone, so that the variants with their texts need not move."""
    names = grids.select("name").where("name IS NOT NULL").distinct()
    listed = augment(names.select(F.col("name").alias("_of"), "name", F.lit("").alias("data")), permutations).select("_of", "name")
    numbered = index_keys(listed)
    entries = F.collect_set(F.struct("name", "identity_idx"))  # a name without extension is that of several variants
    return numbered.groupBy(F.col("_of").alias("name")).agg(F.map_from_entries(entries).alias("_identities"))


def augment_preview(images):
    """Pixel rows of every variant of the images that fit."""
    grids = encode_images(images).withColumn("name", swap_extension(F.col("name")))
    pixels = decode_palette(augment(fit_grid(grids)))
    return pixels.withColumn("name", swap_extension(F.col("name"), ".txt", ".png"))


def augment_counts(images, permutations=None):
    """How many variants are saved and how many images are too large."""
    all_images = images.agg(F.count("*").alias("n")).scalar()
    fitting = fit_grid(encode_images(images)).agg(F.count("*").alias("n"))
    saved = (F.col("n") * len(variants(permutations))).alias("saved")
    return fitting.select(saved, (all_images - F.col("n")).alias("skipped"))


def training_to_batches(train, vocab, batch_size=16, order=("generation", "game_name", "name", "chunk")):
    """Batches in key order, the vocabulary with its weights, and the marker ids."""
    return collate(train, list(order), batch_size), token_weights(vocab), marker_ids(vocab)


def decode_training_table(train, vocab):
    return decode_ids(train, vocab)
