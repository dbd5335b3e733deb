"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

IMAGE = T.StructType([
    T.StructField("generation", T.StringType()),
    T.StructField("game_name", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("n_channels", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
])

GRID = T.StructType([
    T.StructField("generation", T.StringType()),
    T.StructField("game_name", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("data", T.StringType()),
])

VOCAB = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("id", T.IntegerType()),
])

METADATA = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("height", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("type_1", T.StringType()),
    T.StructField("type_2", T.StringType()),
    T.StructField("generation", T.IntegerType()),
    T.StructField("is_shiny", T.BooleanType()),
    T.StructField("has_evolution", T.BooleanType()),
    T.StructField("evolution_stage", T.IntegerType()),
    T.StructField("is_legendary", T.BooleanType()),
    T.StructField("is_mythical", T.BooleanType()),
    T.StructField("is_baby", T.BooleanType()),
    T.StructField("color", T.StringType()),
    T.StructField("shape", T.StringType()),
    T.StructField("habitat", T.StringType()),
])

_NAMED = T.StructType([T.StructField("name", T.StringType())])

SPECIES_JSON = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("height", T.LongType()),
    T.StructField("weight", T.LongType()),
    T.StructField("types", T.ArrayType(T.StructType([
        T.StructField("slot", T.IntegerType()),
        T.StructField("type", _NAMED),
    ]))),
    T.StructField("sprites", T.StructType([T.StructField("front_shiny", T.StringType())])),
    T.StructField("species", T.StructType([
        T.StructField("generation", _NAMED),
        T.StructField("is_legendary", T.BooleanType()),
        T.StructField("is_mythical", T.BooleanType()),
        T.StructField("is_baby", T.BooleanType()),
        T.StructField("color", _NAMED),
        T.StructField("shape", _NAMED),
        T.StructField("habitat", _NAMED),
    ])),
])
