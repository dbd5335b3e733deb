"""Species metadata: shaping, evolution chains, the join onto grids."""

from functools import reduce
from itertools import chain

from pyspark.sql import functions as F

from gridprep import constants as C
from gridprep import schemas
from gridprep.functions.enums import encode_enum
from gridprep.functions.names import generation_index, is_shiny, name_chars, species_id
from gridprep.operators.joins import join_unique
from gridprep.operators.keys import keyed_last
from gridprep.session import ensure_checkpoint_dir

MAX_ROUNDS = 62


def shape_species(df, json="json"):
    """Flat rows from the nested documents of the species service, sorted by id. A cut-off document is an error."""
    roman = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in C.ROMAN.items()))
    doc = df.select(F.from_json(json, schemas.SPECIES_JSON, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    types = F.transform(
        F.array_sort(F.transform("types", lambda t: F.struct(t["slot"].alias("slot"), t["type"]["name"].alias("name")))),
        lambda t: t["name"],
    )
    numeral = F.upper(F.get(F.split("species.generation.name", "-"), F.lit(1)))
    return doc.select(
        "id",
        "name",
        (F.col("height") / 10).alias("height"),
        (F.col("weight") / 10).alias("weight"),
        F.get(types, F.lit(0)).alias("type_1"),
        F.get(types, F.lit(1)).alias("type_2"),
        F.coalesce(F.try_element_at(roman, numeral), F.lit(0)).alias("generation"),
        F.col("sprites.front_shiny").isNotNull().alias("is_shiny"),
        *[F.col(f"species.{c}").alias(c) for c in ("is_legendary", "is_mythical", "is_baby")],
        *[F.col(f"species.{c}.name").alias(c) for c in ("color", "shape", "habitat")],
    ).orderBy("id")


def chain_edges(df, json="json"):
    """(parent, child) of every step in nested evolution documents, root rows with no parent.

    The documents nest as deep as their chains; each round unnests one level of all of them.
    """
    ensure_checkpoint_dir(df.sparkSession)

    def name(node):
        return F.variant_get(node, "$.species.name", "string")

    level = df.select(
        F.lit(None).cast("string").alias("parent"),
        F.variant_get(F.parse_json(json), "$.chain", "variant").alias("node"),
    )
    found = []
    while True:
        level = level.checkpoint()
        if level.isEmpty():
            break
        found.append(level.select("parent", name(F.col("node")).alias("child")))
        level = level.select(
            name(F.col("node")).alias("parent"),
            F.explode(F.variant_get("node", "$.evolves_to", "array<variant>")).alias("node"),
        )
    if not found:
        return df.sparkSession.createDataFrame([], "parent STRING, child STRING")
    return reduce(lambda a, b: a.unionByName(b), found)


def chain_stage(edges, targets, parent="parent", child="child", target="target"):
    """Position in the chain (1 for the root) and whether it goes on, for each target.

    A target outside every chain gets (1, false). Every node keeps a link to an ancestor
    and its distance; each round doubles the distance, so a chain of depth d takes
    log2(d) rounds. The linked side of the join has one row per node: a child of two parents is an error.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    kind = edges.schema[child].dataType
    edges = edges.select(parent, child).distinct().checkpoint()
    if not edges.where(F.col(parent).isNotNull()).groupBy(child).count().where("count > 1").isEmpty():
        raise ValueError("a child has two parents")
    steps = edges.where(F.col(parent).isNotNull()).select(
        F.col(child).alias("node"), F.col(parent).alias("up"), F.lit(1).cast("long").alias("distance")
    )
    parents = steps.select(F.col("up").alias("node")).distinct()
    lone = edges.where(F.col(parent).isNull()).select(F.col(child).alias("node"))
    roots = parents.union(lone).distinct().join(steps.select("node"), "node", "left_anti")
    state = steps.unionByName(
        roots.select("node", F.lit(None).cast(kind).alias("up"), F.lit(0).cast("long").alias("distance"))
    ).checkpoint()
    for _ in range(MAX_ROUNDS):
        open_links = state.where("up IS NOT NULL")
        if open_links.isEmpty():
            break
        linked = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("distance").alias("_d"))
        moved = join_unique(open_links, linked, ["up"], "left", spread=["node"]).select(
            "node", F.col("_up").alias("up"), (F.col("distance") + F.coalesce("_d", F.lit(0))).alias("distance")
        )
        state = state.where("up IS NULL").unionByName(moved).checkpoint()
    else:
        raise ValueError("the chain has a cycle")
    stages = state.select(F.col("node").alias(target), (F.col("distance") + 1).cast("int").alias("_stage"))
    going_on = parents.select(F.col("node").alias(target), F.lit(True).alias("_more"))
    facts = stages.join(going_on, target, "left")
    return join_unique(targets, facts, [target], "left").select(
        *targets.columns,
        F.coalesce("_stage", F.lit(1)).alias("evolution_stage"),
        (F.coalesce("_more", F.lit(False)) & F.col("_stage").isNotNull()).alias("has_evolution"),
    )


def join_metadata(df, metadata, name="name", generation="generation"):
    """Codes of a grid's species, with defaults where the species or a field is missing.

    `metadata` has one row per species or several, of which the one with the highest
    `position` counts.
    """
    if "position" in metadata.columns:
        metadata = keyed_last(metadata, ["id"], ["position"]).drop("position")
    fields = ["type_1", "type_2", "evolution_stage", "has_evolution", "is_legendary",
              "is_mythical", "is_baby", "color", "shape", "habitat"]
    present = dict(zip(metadata.columns, metadata.schema.fields))
    defaults = {f.name: f.dataType for f in schemas.METADATA.fields}
    species = metadata.select(
        F.col("id").cast("string").alias("_species"),
        *[
            (F.col(f) if f in present else F.lit(None)).cast(defaults[f]).alias(f"_{f}")
            for f in fields
        ],
    )
    keyed = df.withColumn("_species", species_id(F.col(name)))
    joined = join_unique(keyed, species, ["_species"], "left", spread=[name])

    def flag(field):
        return F.coalesce(F.col(f"_{field}"), F.lit(False)).cast("bigint")

    def code(field, names, unknown):
        return encode_enum(F.col(f"_{field}"), names, unknown).cast("bigint")

    return joined.withColumns({
        "type1_idx": code("type_1", C.TYPES, C.TYPE1_UNKNOWN),
        "type2_idx": code("type_2", C.TYPES, C.TYPE2_NONE),
        "is_shiny": is_shiny(F.col(name)).cast("bigint"),
        "generation_idx": generation_index(F.col(generation)).cast("bigint"),
        "evolution_stage_idx": F.least(
            F.coalesce("_evolution_stage", F.lit(1)) - 1, F.lit(C.LAST_STAGE_CODE)
        ).cast("bigint"),
        "has_evolution_idx": flag("has_evolution"),
        "is_legendary_idx": flag("is_legendary"),
        "is_mythical_idx": flag("is_mythical"),
        "is_baby_idx": flag("is_baby"),
        "color_idx": code("color", C.COLORS, C.COLOR_UNKNOWN),
        "shape_idx": code("shape", C.SHAPES, C.SHAPE_UNKNOWN),
        "habitat_idx": code("habitat", C.HABITATS, C.HABITAT_NONE),
        "name_chars": name_chars(F.col(name)).cast("array<bigint>"),
    }).drop("_species", *[f"_{f}" for f in fields])
