"""Filters and checks."""

from pyspark.sql import functions as F

from gridprep.functions.grids import grid_size
from gridprep.operators.images import composite, explode_pixels
from gridprep.operators.validate import (
    check_rectangular, filter_border, filter_dominant, filter_exact, filter_oversize, non_empty,
    select_generations,
)
from suite import fixtures as X

# no sprite of the recipe is 64 x 64; some are 62 x 62
EXACT_SIZE = 62


def docs(spark, sf):
    return X.documents(spark, sf)


def generation_filter(spark, sf):
    return select_generations(X.grids(spark, sf), ["gen3", "gen1"]).select("sid", "generation", F.md5("data").alias("digest"))


def rectangular(spark, sf):
    return check_rectangular(docs(spark, sf), "text", "flag").drop("text")


def grid_size_query(spark, sf):
    return docs(spark, sf).select("doc_id", grid_size(F.col("text")).alias("n_rows"))


def border_filter(spark, sf):
    return filter_border(X.grids(spark, sf)).select("sid", "data")


def dominance_filter(spark, sf):
    return filter_dominant(X.grids(spark, sf)).select("sid", "data")


def dominance_filter_docs(spark, sf):
    return filter_dominant(docs(spark, sf), "text", 0.1).select("doc_id")


def non_empty_query(spark, sf):
    some = docs(spark, sf).withColumn("data", F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("text")))
    return non_empty(some).select("doc_id", F.length("data").alias("n_chars"))


def oversize_filter(spark, sf):
    return filter_oversize(X.grids(spark, sf)).select("sid", "data")


def exact_size(spark, sf):
    return composite(explode_pixels(filter_exact(X.images(spark, sf), EXACT_SIZE), ["sid"]), "float")


QUERIES = {
    "generation_filter": generation_filter,
    "rectangular": rectangular,
    "grid_size": grid_size_query,
    "border_filter": border_filter,
    "dominance_filter": dominance_filter,
    "dominance_filter_docs": dominance_filter_docs,
    "non_empty": non_empty_query,
    "oversize_filter": oversize_filter,
    "exact_size": exact_size,
}

SINGLE = ("CAST(CAST(floor(CAST({c} AS REAL) * (CAST(a AS REAL) / CAST(255 AS REAL)) + "
          "CAST(255 AS REAL) * (CAST(1 AS REAL) - CAST(a AS REAL) / CAST(255 AS REAL))) AS DOUBLE) AS INT)")

ORACLES = {
    "generation_filter": f"""WITH {X.GRID_TEXT} SELECT sid, generation, md5(data) AS digest FROM grids
        WHERE generation IN ('gen3', 'gen1')""",
    "rectangular": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
        n AS (SELECT doc_id, i, len(string_split(line, ' ')) AS n FROM l)
        SELECT a.doc_id, CAST(min(CASE WHEN b.n <> a.n THEN b.i END) AS INT) AS ragged_row
        FROM n AS a JOIN n AS b ON a.doc_id = b.doc_id WHERE a.i = 0 GROUP BY a.doc_id""",
    "grid_size": "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS n_rows FROM documents",
    "border_filter": f"""WITH {X.GRID_TEXT},
        corner AS (SELECT sid FROM e WHERE y IN (0, h - 1) AND x IN (0, w - 1) GROUP BY sid HAVING bool_and(tok = '~')),
        b AS (SELECT sid, tok, CASE WHEN y = 0 THEN 0 WHEN x = 0 THEN 1 WHEN x = w - 1 THEN 2 ELSE 3 END * 1000
                + CASE WHEN y IN (0, h - 1) THEN x ELSE y END AS pos
              FROM e WHERE (y IN (0, h - 1)) <> (x IN (0, w - 1))),
        m AS (SELECT sid, tok, row_number() OVER (PARTITION BY sid ORDER BY count(*) DESC, min(pos)) AS n FROM b GROUP BY sid, tok)
        SELECT grids.sid, data FROM grids JOIN corner ON grids.sid = corner.sid
        JOIN m ON m.sid = grids.sid WHERE m.n = 1 AND m.tok = '~'""",
    "dominance_filter": f"""WITH {X.GRID_TEXT},
        k AS (SELECT sid, tok, count(*) AS n FROM e GROUP BY sid, tok),
        m AS (SELECT sid FROM k GROUP BY sid HAVING max(n) / sum(n) < 0.95)
        SELECT grids.sid, data FROM grids JOIN m ON grids.sid = m.sid""",
    "dominance_filter_docs": r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS tok FROM documents),
        k AS (SELECT doc_id, tok, count(*) AS n FROM w WHERE tok <> '' GROUP BY doc_id, tok)
        SELECT doc_id FROM k GROUP BY doc_id HAVING CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) < CAST(0.1 AS DOUBLE)""",
    "non_empty": "SELECT doc_id, CAST(length(text) AS INT) AS n_chars FROM documents WHERE doc_id % 5 <> 0 AND text <> ''",
    "oversize_filter": f"""WITH {X.FITTED},
        ln AS (SELECT sid, y, string_agg(tok, ' ' ORDER BY x) AS line FROM e GROUP BY sid, y)
        SELECT ln.sid, string_agg(line, chr(10) ORDER BY y) AS data FROM ln JOIN fit ON fit.sid = ln.sid GROUP BY ln.sid""",
    "exact_size": f"""WITH {X.PX} SELECT sid, y, x, {SINGLE.format(c='r')} AS r, {SINGLE.format(c='g')} AS g,
        {SINGLE.format(c='b')} AS b FROM q WHERE h = {EXACT_SIZE} AND w = {EXACT_SIZE}""",
}
