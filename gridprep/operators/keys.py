"""Identity keys and joins by name."""

from pyspark.sql import functions as F

from gridprep.functions.names import identity_key
from gridprep.operators.joins import join_unique
from gridprep.operators.ranking import global_rank


def index_keys(df, name="name", out="identity_idx"):
    """Number the identities in key order, from 0.

    Only distinct keys are sorted, and the rows do not move if there are few of them. A null name has no
    identity and a null number.
    """
    keyed = df.withColumn("_key", identity_key(F.col(name)))
    index = global_rank(keyed.select("_key").where("_key IS NOT NULL").distinct(), ["_key"], out)
    return join_unique(keyed, index, ["_key"], "left", spread=df.columns).drop("_key")


def count_identities(df, name="name"):
    return df.agg(F.countDistinct(identity_key(F.col(name))).alias("n_identities"))


def keyed_last(df, key, order):
    """The last row of each key in the order of the `order` columns.

    An aggregate, so a frequent key is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def attach_by_name(df, attributes, order, name="name"):
    """Join attributes by name; of several rows with a name the last one counts."""
    last = keyed_last(attributes, [name], order).drop(*[c for c in order if c not in df.columns])
    return join_unique(df, last, [name])
