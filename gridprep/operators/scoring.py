"""Losses, evaluation and shares."""

from pyspark.sql import functions as F

from gridprep.functions.text import let, running_sum, with_kept

PROBABILITY_UNITS = 10**12
LOG_FLOOR = -100.0


def weighted_nll(df, weights, group=(), labels="labels", nll="nll", ignore=-100, count=None):
    """Weighted next-token loss per group.

    `nll[i]` is the loss of predicting label i + 1. The mean divides by the sum of the weights;
    with `count`, a column that is the same within a group, the sum is divided by it. Labels
    equal to `ignore` do not count, and a loss that is undefined is 0. Losses are summed per
    label before the weights are joined, so frequent labels move no rows.
    """
    pairs = F.arrays_zip(
        F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))).alias("label"),
        F.slice(nll, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))).alias("nll"),
    )
    extra = [] if count is None else [F.max(count).alias("_count")]
    inputs = [*group] + ([] if count is None else [count])
    counted = df.select(*inputs, F.inline_outer(pairs)).withColumn(
        "_counts", F.col("label").isNotNull() & (F.col("label") != ignore)
    )
    per_label = counted.groupBy(*group, F.when(F.col("_counts"), F.col("label")).alias("id")).agg(
        F.sum("nll").alias("_nll"), F.count("*").alias("_n"), *extra
    )
    weighted = per_label.join(weights.select("id", "weight"), "id", "left").withColumn(
        "_w", F.when(F.col("id").isNotNull(), F.coalesce("weight", F.lit(1.0)))
    )
    total = F.sum(F.col("_w") * F.col("_nll"))
    divisor = F.sum(F.col("_w") * F.col("_n")) if count is None else F.max("_count")
    loss = F.nanvl(F.coalesce(F.try_divide(total, divisor), F.lit(0.0)), F.lit(0.0))
    return weighted.groupBy(*group).agg(loss.alias("loss"))


def binary_eval(df, probability="probability", label="label"):
    """Mean cross-entropy and accuracy at 0.5; both 0 for an empty table."""

    def log(p):
        return F.when(p > 0, F.greatest(F.log(p), F.lit(LOG_FLOOR))).otherwise(F.lit(LOG_FLOOR))

    p, y = F.col(probability), F.col(label)
    entropy = -(y * log(p) + (1 - y) * log(1 - p))
    right = (p > 0.5) == (y == 1)
    return df.agg(
        F.coalesce(F.avg(entropy), F.lit(0.0)).alias("loss"),
        F.coalesce(F.avg(right.cast("double")), F.lit(0.0)).alias("accuracy"),
    )


def token_share(df, token="token"):
    """Share of each token in the corpus."""
    counts = df.groupBy(token).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def filter_candidates(df, scores="scores", k=0, p=1.0, temperature=1.0):
    """Candidates that survive temperature, top-k and nucleus filtering, best first.

    `scores` is an array of (token, logit), one row per decoding step. Ties go to the
    smaller token. Probabilities are added up in whole units of 1e-12, so the cut does
    not depend on the order of summation.
    """
    ordered = F.sort_array(
        F.transform(scores, lambda s: F.struct((-s["logit"]).alias("negative"), s["token"].alias("token")))
    )
    if k > 0:
        ordered = F.slice(ordered, F.lit(1), F.lit(k))

    def with_mass(best):
        top = F.get(best, F.lit(0))["negative"]
        masses = F.transform(best, lambda s: F.exp((top - s["negative"]) / temperature))
        return let(
            masses,
            lambda m: let(
                F.aggregate(m, F.lit(0.0), lambda a, e: a + e),
                lambda total: F.zip_with(
                    best, m,
                    lambda s, e: F.struct(s["token"].alias("token"), (e / total).alias("probability")),
                ),
            ),
        )

    def units(c):
        return F.round(c["probability"] * PROBABILITY_UNITS).cast("long")

    kept = [c for c in df.columns if c != scores]
    listed = with_kept(df, "_list", let(ordered, with_mass), lambda c: F.size(c) > 0)
    summed = listed.withColumn("_sums", running_sum(F.transform("_list", units)))
    nucleus = F.filter(
        F.zip_with(
            "_list", "_sums",
            lambda c, s: F.struct(c["token"].alias("token"), c["probability"].alias("probability"), (s - units(c)).alias("before")),
        ),
        lambda c: c["before"] < round(p * PROBABILITY_UNITS),
    )
    return summed.select(*kept, F.posexplode(nucleus).alias("rank", "c")).select(
        *kept, "rank", "c.token", "c.probability"
    )
