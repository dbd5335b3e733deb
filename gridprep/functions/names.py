"""Names, paths and what can be read from them."""

from pyspark.sql import functions as F

from gridprep.constants import (
    FLIP_SUFFIX, IDENTITY_SUFFIXES, NAME_CHARS, NAME_CHARS_SUFFIX, PERMUTATIONS, TYPE2_NONE, TYPES,
)
from gridprep.functions.text import let


def swap_extension(name, old=".png", new=".txt"):
    return F.replace(name, F.lit(old), F.lit(new))


def identity_key(name):
    """Name without extension and variant suffixes, removed in a fixed order."""
    key = F.replace(name, F.lit(".txt"), F.lit(""))
    for pattern in IDENTITY_SUFFIXES:
        key = F.regexp_replace(key, pattern, "")
    return key


def species_id(name):
    """Leading digits without leading zeros as text, else empty."""
    digits = F.regexp_extract(F.replace(name, F.lit(".txt"), F.lit("")), r"^(\d+)", 1)
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def name_chars(name, width=NAME_CHARS):
    """Code points of the first characters of the bare name, filled up with 0."""
    stem = F.substring(F.regexp_replace(name, NAME_CHARS_SUFFIX, ""), 1, width)
    codes = F.when(F.length(stem) > 0, F.transform(F.split(stem, ""), F.ascii)).otherwise(
        F.array().cast("array<int>")
    )
    return let(codes, lambda c: F.concat(c, F.array_repeat(F.lit(0), F.lit(width) - F.size(c))))


def is_shiny(name):
    return F.contains(name, F.lit("_shiny")).cast("int")


def generation_index(generation):
    return F.substring(generation, 4, 10).cast("int") - 1


def variant_name(name, suffix, flipped):
    """Name of a colour variant, then of its mirror image: suffixes stand before the extension."""
    shifted = F.when(suffix == "", name).otherwise(
        F.concat(F.replace(name, F.lit(".txt"), F.lit("")), suffix, F.lit(".txt"))
    )
    return F.when(flipped, F.replace(shifted, F.lit(".txt"), F.lit(f"{FLIP_SUFFIX}.txt"))).otherwise(shifted)


def variants(permutations=None):
    """(label, suffix, flipped, permutation) of every variant; label 0 is the plain palette."""
    listed = PERMUTATIONS if permutations is None else permutations
    shifts = [("", None)] + list(listed)
    return [
        (label, suffix, flipped, permutation)
        for label, (suffix, permutation) in enumerate(shifts)
        for flipped in (False, True)
    ]


def normalise_member_path(generation, path, prefix):
    """`gen<n>/<game>/<name>.png` of an archive member, or null.

    `prefix` holds the two folders all members stand under. Back views and names that do not
    start with a number are refused; the number has at least three digits, hyphens become
    underscores and inner folders are appended.
    """
    first, second = prefix.split("/")

    def rebuilt(parts):
        n = F.size(parts)
        folders = F.slice(parts, F.lit(4), F.greatest(n - 4, F.lit(0)))
        stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]+$", "")
        number = F.regexp_extract(stem, r"^(\d+)(-|$)", 1)
        variant = F.replace(F.regexp_extract(stem, r"^\d+-(.*)$", 1), F.lit("-"), F.lit("_"))
        padded = F.format_string("%03d", number.try_cast("long"))
        name = F.concat_ws("_", padded, F.when(variant != "", variant), folders)
        wanted = (
            (n >= 4)
            & (F.get(parts, F.lit(0)) == first)
            & (F.get(parts, F.lit(1)) == second)
            & ~F.array_contains(folders, "back")
            & (number != "")
        )
        return F.when(
            wanted,
            F.concat(F.lit("gen"), generation.cast("string"), F.lit("/"),
                     F.get(parts, F.lit(2)), F.lit("/"), name, F.lit(".png")),
        )

    parts = F.filter(F.split(path, "/"), lambda part: ~part.isin("", "."))
    return F.when(~path.startswith("/"), let(parts, rebuilt))


def output_name(identity, type1, type2, shiny, generation, stage, has_evolution, prefix="sprite"):
    """File name of a sampled image; parts without a value are left out or stand for their default."""

    def type_name(code):
        return F.get(F.array(*[F.lit(t) for t in TYPES]), code)

    first = F.coalesce(type_name(F.coalesce(type1, F.lit(len(TYPES)))), F.lit("unk"))
    second = type_name(F.coalesce(type2, F.lit(TYPE2_NONE)))
    zero = F.lit(0)
    return F.concat(
        F.concat_ws(
            "_",
            F.lit(prefix),
            identity.cast("string"),
            F.concat_ws("-", first, second),
            F.concat(F.lit("sh"), F.coalesce(shiny, zero)),
            F.concat(F.lit("g"), F.coalesce(generation, zero) + 1),
            F.concat(F.lit("ev"), F.coalesce(stage, zero)),
            F.concat(F.lit("he"), F.coalesce(has_evolution, zero)),
        ),
        F.lit(".png"),
    )
