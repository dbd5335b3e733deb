"""Connected components of a table of links."""

from pyspark.sql import functions as F

from gridprep.llm.tables import written

MOST_ROUNDS = 60


def _state(edges):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    return tuple(row)


def components(links):
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each node's larger neighbours,
    then its smaller ones, are linked to its smallest neighbour, until nothing changes. Every edge
    stays one row, so a component of any size is spread over all tasks; what comes back to the driver
    is a count and a checksum per round. Null ends and loops are dropped.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    for _ in range(MOST_ROUNDS):
        if before[0] == 0:
            break
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # now a > b holds for every edge: the neighbours of a that are smaller than a
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (
            joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct()
        )
        edges = written(small, "edges")
        after = _state(edges)
        if after == before:
            return _roots(edges)
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return _roots(edges)


def _roots(edges):
    own = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return own.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
