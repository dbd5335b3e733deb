"""What the training job holds and moves at once."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridprep import schemas
from gridprep.operators.augment import augment
from gridprep.operators.keys import index_keys
from gridprep.operators.validate import fit_grid
from gridprep.plans.jobs import grids_to_training_table
from gridprep.session import BATCH_BYTES, TEXT_BATCH_BYTES

NAMES = ["001.txt", "001_frame2.txt", "001_shiny.txt", "002_rg.txt", "002.txt", "002.txt", "egg", None, "003_frame2_flip.txt"]


@pytest.fixture
def grids(spark):
    rows = [("gen3", "a", name, f"~ ;\n{chr(60 + i)} ~") for i, name in enumerate(NAMES)]
    return spark.createDataFrame(rows, "generation string, game_name string, name string, data string")


@pytest.fixture
def species(spark):
    return spark.createDataFrame([], schemas.METADATA)


def test_texts_go_to_python_in_small_batches(spark, grids, species):
    spark.conf.unset(BATCH_BYTES)
    try:
        grids_to_training_table(grids, species)
        assert spark.conf.get(BATCH_BYTES) == str(TEXT_BATCH_BYTES)
        spark.conf.set(BATCH_BYTES, "1000000")
        grids_to_training_table(grids, species)
        assert spark.conf.get(BATCH_BYTES) == "1000000"
    finally:
        spark.conf.unset(BATCH_BYTES)


def test_identities_are_those_of_the_variants(spark, grids, species):
    train, _ = grids_to_training_table(grids, species)
    expected = index_keys(augment(fit_grid(grids)))
    found, wanted = (Counter(map(tuple, t.select("name", "color_shift", "identity_idx").collect())) for t in (train, expected))
    assert found == wanted and len({i for _, _, i in found}) > 5


def test_variants_are_not_moved(spark, grids, species, monkeypatch):
    """However many identities there are, no shuffle stands behind the fan-out."""
    import gridprep.operators.joins as joins

    monkeypatch.setattr(joins, "is_small", lambda *a, **b: False)
    train, _ = grids_to_training_table(grids, species)
    plan = train._jdf.queryExecution().optimizedPlan().toString()
    assert plan[:plan.index("Join")].count("Generate explode") == 2  # chunks and variants
    assert train.agg(F.count("*")).head()[0] == 12 * len(NAMES)
