"""Rows of which each makes thousands of pixels are spread over tasks, and the pixels stay as they are."""

from pyspark.sql import functions as F

from gridprep.operators.images import explode_pixels
from suite import fixtures as X

SF = "/root/testdata/sf0.001"


def test_sprites_of_one_file_are_many_tasks(spark):
    for rows in (X.images(spark, SF), X.grids(spark, SF), X.pixels(spark, SF)):
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert X.spread(spark.range(5000).withColumnRenamed("id", "sid"), per_task=100).rdd.getNumPartitions() == 50


def test_image_bytes_are_the_pixels_of_the_expressions(spark):
    drawn = explode_pixels(X.images(spark, SF), ["sid"])
    told = X.pixels(spark, SF)
    assert drawn.count() == told.count() > 0
    assert drawn.exceptAll(told.select(drawn.columns)).isEmpty()
