"""Weights, losses, sampling and selection."""

from pyspark.sql import functions as F

from gridprep.functions.grids import grid_cells
from gridprep.functions.text import words
from gridprep.constants import SPECIAL_TOKENS
from gridprep.operators import scoring as S
from gridprep.operators import selection as P
from gridprep.operators.sequences import row_report, row_state, to_sequence
from gridprep.operators.validate import fit_grid
from gridprep.operators.vocab import build_vocab, token_weights
from suite import fixtures as X

SEED = 17

CONDITIONS = """
SELECT c_custkey AS cid, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 18 AS INT) END AS type1,
 CASE WHEN c_custkey % 4 = 0 THEN CAST(1 AS INT) END AS is_shiny,
 CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 9 AS INT) END AS generation FROM customer
"""
CANDIDATES = "SELECT user_id AS grp, event_id AS ord, round(value / 200, 6) AS score FROM events"
OUTPUT_FIELDS = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 1 THEN CAST(p_partkey AS INT) END AS identity_idx,
 CASE WHEN p_partkey % 7 <> 2 THEN CAST(p_partkey % 20 AS INT) END AS type1,
 CASE WHEN p_partkey % 5 <> 3 THEN CAST(p_partkey % 23 AS INT) END AS type2,
 CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 2 AS INT) END AS is_shiny,
 CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey % 10 AS INT) END AS generation,
 CASE WHEN p_partkey % 8 <> 0 THEN CAST(p_partkey % 4 AS INT) END AS evolution_stage,
 CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 2 AS INT) END AS has_evolution FROM part
"""


def fitted_vocab(spark, sf, extra=()):
    return build_vocab(to_sequence(fit_grid(X.grids(spark, sf))), special=SPECIAL_TOKENS + list(extra))


def token_weights_query(spark, sf):
    return token_weights(fitted_vocab(spark, sf, ["~~", "~~~", "~;"]))


def losses(spark, sf):
    docs = X.load(spark, sf, "documents").select("lang", words(F.col("text")).alias("w"))
    return docs.select(
        "lang",
        F.transform("w", lambda w, i: F.when(i % 7 == 3, F.lit(-100)).otherwise(F.length(w) % 50)).alias("labels"),
        F.transform("w", lambda w, i: ((F.length(w) * 3 + i) % 17) / F.lit(10.0)).alias("nll"),
        F.lit(1000.0).alias("given"),
    )


def label_weights(spark):
    return spark.range(50).select(
        F.col("id").cast("int").alias("id"), F.when(F.col("id") % 5 == 0, F.lit(0.6)).otherwise(F.lit(1.0)).alias("weight")
    )


def weighted_nll(spark, sf):
    rows = S.weighted_nll(losses(spark, sf), label_weights(spark), ["lang"])
    return rows.withColumn("loss", F.round("loss", 6))


def weighted_nll_counted(spark, sf):
    rows = S.weighted_nll(losses(spark, sf), label_weights(spark), count="given")
    return rows.withColumn("loss", F.round("loss", 4))


def sample_fields(spark, sf):
    return P.sample_fields(X.from_sql(spark, sf, CONDITIONS, "customer"), ["cid"], SEED)


def override_fields(spark, sf):
    return P.resolve_conditioning(X.from_sql(spark, sf, CONDITIONS, "customer"), ["cid"], SEED)


def vectors(spark, sf):
    return X.load(spark, sf, "embeddings")


def blend_vectors(spark, sf):
    known = vectors(spark, sf)
    n = known.agg(F.count("*")).scalar()
    picks = P.sample_picks(known.select(F.col("vec_id").alias("target")), ["target"], n, 3, SEED)
    blended = P.blend_vectors(picks, known, ["target"], "vec_id", "embedding")
    return blended.select("target", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.round("v", 5))


def sum_vectors(spark, sf):
    known = vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    n = known.agg(F.count("*")).scalar()
    rows = X.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("cid"), F.col("c_nationkey").alias("nation"),
        (F.col("c_custkey") % n).alias("identity"), (F.length("c_mktsegment") + 30).alias("segment"),
    )
    total = P.sum_vectors(rows, [("nation", known), ("identity", known), ("segment", known)])
    return total.select("cid", F.posexplode("vector").alias("pos", "v")).withColumn("v", F.round("v", 5))


def best_of_n(spark, sf):
    return P.best_of_n(X.from_sql(spark, sf, CANDIDATES, "events"), ["grp"], ["ord"])


def output_name(spark, sf):
    return P.with_output_name(X.from_sql(spark, sf, OUTPUT_FIELDS, "part")).select("id", "output_name")


def allowed_tokens(spark, sf):
    """States taken from grid rows: as many cells used as the row has that are not blank, the row
    numbers starting at -1."""
    rows = X.grids(spark, sf).select("sid", F.posexplode(grid_cells(F.col("data"))).alias("y", "cells"))
    states = rows.select(
        "sid", (F.col("y") % 65 - 1).alias("row"), "y", F.size(F.array_remove("cells", "~")).alias("used")
    )
    vocab = fitted_vocab(spark, sf, ["~~", "~;;"])
    allowed = P.allowed_tokens(states, vocab, width=40)
    return allowed.select("sid", "y", "row", "used", F.size("allowed").alias("n"), X.as_text("allowed").alias("allowed"))


def row_state_query(spark, sf):
    states = row_state(X.document_tokens(spark, sf).drop("seq"))
    return states.select("doc_id", X.as_text("rows").alias("rows"), X.as_text("used").alias("used"))


def row_report_query(spark, sf):
    return row_report(X.document_tokens(spark, sf).drop("seq"), width=60)


def top_p_filter(spark, sf):
    docs = X.documents(spark, sf).select(
        "doc_id",
        F.transform(
            F.array_distinct(words(F.col("text"))),
            lambda w: F.struct(w.alias("token"), ((F.length(w) * 3 + F.ascii(w) % 5) / F.lit(4.0)).alias("logit")),
        ).alias("scores"),
    )
    kept = S.filter_candidates(docs, k=200, p=0.9, temperature=0.8)
    return kept.withColumn("probability", F.round("probability", 9))


def negatives(spark, sf):
    pixels = P.make_negatives(X.images(spark, sf).select("sid", "height", "width", "n_channels", "data"), ["sid"], SEED)
    level = F.col("r") + F.col("g") * 256 + F.col("b") * 65536
    return pixels.groupBy("sid", "label", "strategy", "y").agg(
        F.count("*").alias("n"), F.sum(level.cast("long") * (F.col("x") + 1)).alias("weighted")
    )


def holdout_split(spark, sf):
    return P.split_rows(X.documents(spark, sf), ["doc_id"], 0.1, SEED).select("doc_id", "is_validation")


def binary_eval(spark, sf):
    rows = X.load(spark, sf, "labels").select(
        (F.col("doc_id") * 37 % 1001 / F.lit(1000.0)).alias("probability"), F.col("quality").alias("label")
    )
    return S.binary_eval(rows).withColumns({c: F.round(c, 6) for c in ("loss", "accuracy")})


def token_share(spark, sf):
    tokens = X.grids(spark, sf).select(F.explode(words(F.col("data"))).alias("token"))
    return S.token_share(tokens).withColumn("share", F.round("share", 9))


QUERIES = {
    "token_weights": token_weights_query,
    "weighted_nll": weighted_nll,
    "weighted_nll_counted": weighted_nll_counted,
    "sample_fields": sample_fields,
    "override_fields": override_fields,
    "blend_vectors": blend_vectors,
    "sum_vectors": sum_vectors,
    "best_of_n": best_of_n,
    "output_name": output_name,
    "allowed_tokens": allowed_tokens,
    "row_state": row_state_query,
    "row_report": row_report_query,
    "top_p_filter": top_p_filter,
    "negatives": negatives,
    "holdout_split": holdout_split,
    "binary_eval": binary_eval,
    "token_share": token_share,
}


def _hash(*parts):
    return f"CAST(concat('0x', substr(md5(concat_ws(':', '{SEED}', {', '.join(parts)})), 1, 15)) AS BIGINT)"


def _drawn(field, size):
    quoted = f"'{field}'"
    return f"CAST({_hash(quoted, 'cid')} % {size} AS INT)"


RANGES = {"type1": 19, "type2": 20, "is_shiny": 2, "generation": 10, "evolution_stage": 4, "has_evolution": 2, "color_shift": 6}


def _specials(*extra):
    """The special tokens with some more behind them, and the fitted grids' vocabulary."""
    more = " ".join(f"UNION ALL SELECT '{t}', CAST({68 + i} AS INT)" for i, t in enumerate(extra))
    return f"""{X.FITTED}, {X.SPECIALS.rstrip().removesuffix(')')} {more}),
        corpus AS (SELECT tok FROM f WHERE x > 0),
        vocab AS (SELECT token, id FROM sp UNION ALL SELECT tok, CAST({67 + len(extra)} + row_number() OVER (ORDER BY tok) AS INT)
                  FROM (SELECT DISTINCT tok FROM corpus WHERE tok NOT IN (SELECT token FROM sp)))"""


LOSS_ROWS = r"""
w AS (SELECT doc_id, lang, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS w FROM documents),
t AS (SELECT doc_id, lang, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS i FROM w),
l AS (SELECT doc_id, lang, i, CASE WHEN i % 7 = 3 THEN -100 ELSE length(tok) % 50 END AS label,
        ((length(tok) * 3 + i) % 17) / CAST(10 AS DOUBLE) AS nll FROM t),
s AS (SELECT lang, lead(label) OVER (PARTITION BY doc_id ORDER BY i) AS label, nll FROM l),
v AS (SELECT lang, nll, CASE WHEN label % 5 = 0 THEN CAST(0.6 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS wt
      FROM s WHERE label IS NOT NULL AND label <> -100)
"""

ORACLES = {
    "token_weights": f"""WITH {_specials('~~', '~~~', '~;')} SELECT token, id,
        CASE WHEN token IN ('~', '~~', '~~~') THEN CAST(0.6 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight FROM vocab""",
    "weighted_nll": f"WITH {LOSS_ROWS} SELECT lang, round(sum(wt * nll) / sum(wt), 6) AS loss FROM v GROUP BY lang",
    "weighted_nll_counted": f"WITH {LOSS_ROWS} SELECT round(sum(wt * nll) / 1000, 4) AS loss FROM v",
    "sample_fields": f"WITH c AS ({CONDITIONS}) SELECT cid, " + ", ".join(
        (f"coalesce({f}, {_drawn(f, n)}) AS {f}" if f in ("type1", "is_shiny", "generation") else f"{_drawn(f, n)} AS {f}")
        for f, n in RANGES.items()) + " FROM c",
    "override_fields": f"""WITH c AS ({CONDITIONS}) SELECT cid, coalesce(type1, {_drawn('type1', 19)}) AS type1, {_drawn('type2', 20)} AS type2,
        coalesce(is_shiny, 0) AS is_shiny, coalesce(generation, CAST(2 + {_drawn('default generation', 2)} AS INT)) AS generation,
        {_drawn('evolution_stage', 4)} AS evolution_stage, {_drawn('has_evolution', 2)} AS has_evolution, CAST(0 AS INT) AS color_shift FROM c""",
    "blend_vectors": f"""WITH t AS (SELECT vec_id AS target, k AS pick FROM embeddings CROSS JOIN range(3) AS r(k)),
        p AS (SELECT target, pick, {_hash("'pick'", 'target', 'pick')} % (SELECT count(*) FROM embeddings) AS vec_id,
               sqrt(-2 * ln(({_hash("'u1'", 'target', 'pick')} % 1000000 + 0.5::DOUBLE) / 1000000))
                 * cos(2 * pi() * (({_hash("'u2'", 'target', 'pick')} % 1000000 + 0.5::DOUBLE) / 1000000)) AS logit FROM t),
        w AS (SELECT target, pick, vec_id, exp(logit - max(logit) OVER (PARTITION BY target)) AS e FROM p),
        x AS (SELECT target, e / sum(e) OVER (PARTITION BY target) AS wt, embedding FROM w JOIN embeddings USING (vec_id)),
        u AS (SELECT target, wt, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM x)
        SELECT target, CAST(pos AS INT) AS pos, round(sum(wt * CAST(v AS DOUBLE)), 5) AS v FROM u GROUP BY target, pos""",
    "sum_vectors": """WITH k AS (SELECT c_custkey AS cid, unnest([CAST(c_nationkey AS BIGINT), c_custkey % (SELECT count(*) FROM embeddings), length(c_mktsegment) + 30]) AS vec_id FROM customer),
        u AS (SELECT cid, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM k JOIN embeddings USING (vec_id))
        SELECT cid, CAST(pos AS INT) AS pos, round(sum(CAST(v AS DOUBLE)), 5) AS v FROM u GROUP BY cid, pos""",
    "best_of_n": f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ord) AS n FROM ({CANDIDATES}) AS e),
        r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN score >= 0.55 THEN 0 ELSE 1 END,
                CASE WHEN score >= 0.55 THEN n END, score DESC, n) AS k FROM c WHERE n <= 3)
        SELECT grp, ord, score FROM r WHERE k = 1""",
    "output_name": f"""WITH f AS ({OUTPUT_FIELDS}),
        n AS (SELECT *, ['normal', 'fire', 'water', 'electric', 'grass', 'ice', 'fighting', 'poison', 'ground', 'flying', 'psychic',
          'bug', 'rock', 'ghost', 'dragon', 'dark', 'steel', 'fairy'] AS t FROM f)
        SELECT id, concat('sprite_', CASE WHEN identity_idx IS NOT NULL THEN identity_idx || '_' ELSE '' END,
          CASE WHEN type1 < 18 THEN t[type1 + 1] ELSE 'unk' END, CASE WHEN type2 < 18 THEN '-' || t[type2 + 1] ELSE '' END,
          '_sh', coalesce(is_shiny, 0), '_g', coalesce(generation, 0) + 1, '_ev', coalesce(evolution_stage, 0),
          '_he', coalesce(has_evolution, 0), '.png') AS output_name FROM n""",
    "allowed_tokens": f"""WITH {_specials('~~', '~;;')},
        st AS (SELECT sid, y, y % 65 - 1 AS row, CAST(sum(CASE WHEN tok <> '~' THEN 1 ELSE 0 END) AS INT) AS used FROM e GROUP BY sid, y),
        vl AS (SELECT token, id, CASE WHEN starts_with(token, '[') AND ends_with(token, ']') THEN 0 ELSE length(token) END AS n FROM vocab),
        j AS (SELECT sid, y, row, used, id FROM st LEFT JOIN vl ON
               CASE WHEN row < 0 THEN true WHEN used < 40 THEN n BETWEEN 1 AND 40 - used
                    WHEN row < 63 THEN token = printf('[ROW_%02d]', row + 1) ELSE token = '[EOS]' END)
        SELECT sid, y, row, used, CAST(count(id) AS INT) AS n, coalesce(string_agg(id, ' ' ORDER BY id), '') AS allowed
        FROM j GROUP BY sid, y, row, used""",
    "row_state": f"""WITH {X.DOC_TOKENS},
        g AS (SELECT doc_id, pos, m, CASE WHEN starts_with(tok, '[') AND ends_with(tok, ']') THEN 0 ELSE length(tok) END AS n,
               count(m) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM dm),
        u AS (SELECT doc_id, pos, coalesce(max(m) OVER (PARTITION BY doc_id, grp), -1) AS row,
               sum(n) OVER (PARTITION BY doc_id, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM g)
        SELECT doc_id, string_agg(row, ' ' ORDER BY pos) AS rows, string_agg(CAST(used AS BIGINT), ' ' ORDER BY pos) AS used FROM u GROUP BY doc_id""",
    "row_report": f"""WITH {X.DOC_TOKENS},
        g AS (SELECT doc_id, pos, m, CASE WHEN starts_with(tok, '[') AND ends_with(tok, ']') THEN 0 ELSE length(tok) END AS n,
               count(m) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM dm),
        k AS (SELECT doc_id, grp, max(m) AS row, sum(n) AS used FROM g WHERE grp > 0 GROUP BY doc_id, grp)
        SELECT doc_id, CAST(grp - 1 AS INT) AS segment, row, CAST(used AS INT) AS used, used = 60 AS "full",
          row = coalesce(lag(row) OVER (PARTITION BY doc_id ORDER BY grp), -1) + 1 AS in_order FROM k""",
    "top_p_filter": r"""WITH d AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '\s+')) AS token FROM documents),
        l AS (SELECT doc_id, token, (length(token) * 3 + ascii(token) % 5) / CAST(4 AS DOUBLE) / CAST(0.8 AS DOUBLE) AS logit FROM d WHERE token <> ''),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY logit DESC, token) - 1 AS rank FROM l),
        e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY doc_id)) AS e FROM k WHERE rank < 200),
        p AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS probability FROM e),
        c AS (SELECT *, sum(CAST(round(probability * 1000000000000) AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY rank
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CAST(round(probability * 1000000000000) AS BIGINT) AS before FROM p)
        SELECT doc_id, CAST(rank AS INT) AS rank, token, round(probability, 9) AS probability FROM c WHERE before < 900000000000""",
    "negatives": f"""WITH {X.GRID},
        k AS (SELECT sid, CAST({_hash("'strategy'", 'sid')} % 3 AS INT) AS strategy FROM s),
        o AS (SELECT sid, y, CAST(row_number() OVER (PARTITION BY sid ORDER BY {_hash("'row'", 'sid', 'y')}, y) - 1 AS INT) AS ny
              FROM (SELECT DISTINCT sid, y FROM c)),
        a AS (SELECT c.sid, strategy, CASE WHEN strategy = 0 THEN ny ELSE c.y END AS y, x, r, g, b FROM c JOIN k ON k.sid = c.sid
              JOIN o ON o.sid = c.sid AND o.y = c.y),
        h AS (SELECT *, md5(concat_ws(':', '{SEED}', 'pixel', sid, y, x)) AS h FROM a),
        n AS (SELECT *, strategy = 1 OR (strategy = 2 AND CAST(concat('0x', substr(h, 7, 7)) AS BIGINT) < {16**7 // 2}) AS rep FROM h),
        px AS (SELECT sid, 1 AS label, CAST(NULL AS INT) AS strategy, y, x, r, g, b FROM c UNION ALL
               SELECT sid, 0, strategy, y, x,
                 CASE WHEN rep THEN CAST(concat('0x', substr(h, 1, 2)) AS INT) ELSE r END,
                 CASE WHEN rep THEN CAST(concat('0x', substr(h, 3, 2)) AS INT) ELSE g END,
                 CASE WHEN rep THEN CAST(concat('0x', substr(h, 5, 2)) AS INT) ELSE b END FROM n)
        SELECT sid, CAST(label AS INT) AS label, strategy, y, count(*) AS n, CAST(sum((r + g * 256 + b * 65536) * (x + 1)) AS BIGINT) AS weighted
        FROM px GROUP BY sid, label, strategy, y""",
    "holdout_split": f"""WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY {_hash('doc_id')}, doc_id) AS n, count(*) OVER () AS t FROM documents)
        SELECT doc_id, n <= greatest(1, floor(t * CAST(0.1 AS DOUBLE))) AS is_validation FROM h""",
    "binary_eval": """WITH p AS (SELECT (doc_id * 37 % 1001) / CAST(1000 AS DOUBLE) AS p, quality AS y FROM labels),
        l AS (SELECT p, y, CASE WHEN p > 0 THEN greatest(ln(CASE WHEN p > 0 THEN p ELSE 1 END), -100) ELSE -100 END AS lp,
                CASE WHEN p < 1 THEN greatest(ln(CASE WHEN p < 1 THEN 1 - p ELSE 1 END), -100) ELSE -100 END AS lq FROM p)
        SELECT round(coalesce(avg(-(y * lp + (1 - y) * lq)), 0), 6) AS loss,
          round(coalesce(avg(CASE WHEN (p > 0.5) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 0), 6) AS accuracy FROM l""",
    "token_share": f"""WITH {X.GRID} SELECT tok AS token, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM e), 9) AS share
        FROM e GROUP BY tok""",
}
