"""Tokenization."""

from pyspark.sql import functions as F

from gridprep.functions import tokens as T
from gridprep.functions.text import words
from gridprep.operators.bpe import bpe_encode, bpe_train, pair_counts, word_counts
from gridprep.operators.sequences import (
    check_sequence, chunk_pad, length_stats, sliding_chunks, to_sequence, to_sequence_bos,
)
from gridprep.operators.validate import fit_grid
from gridprep.operators.vocab import build_vocab, decode_ids, encode_ids, marker_ids
from gridprep.session import stored
from suite import fixtures as X

CONTEXT = 128
STEP = 64


def sequence_text(spark, sf):
    return X.document_tokens(spark, sf).select("doc_id", "seq")


def vocabulary(spark, sf):
    return build_vocab(X.document_tokens(spark, sf), "seq")


def marker_ids_query(spark, sf):
    """The markers that the documents hold, in the documents' own vocabulary."""
    return marker_ids(build_vocab(X.document_tokens(spark, sf), "seq", special=()))


def encoded(spark, sf):
    return encode_ids(X.document_tokens(spark, sf), X.benchmark_vocab(spark, sf), ["doc_id"], "seq")


def encode_ids_query(spark, sf):
    return encoded(spark, sf).select("doc_id", X.as_text("input_ids").alias("ids"))


def encode_ids_large_vocab(spark, sf):
    """The documents' own vocabulary, with a limit that makes it one to be joined."""
    docs = X.document_tokens(spark, sf)
    result = encode_ids(docs, stored(build_vocab(docs, "seq"), "vocab"), ["doc_id"], limit=1000)
    return result.select("doc_id", X.as_text("input_ids").alias("ids"))


def decode_ids_query(spark, sf):
    back = decode_ids(encoded(spark, sf).drop("tokens"), X.benchmark_vocab(spark, sf), ["doc_id"])
    return back.select("doc_id", F.array_join("tokens", " ").alias("text"))


def position_ids(spark, sf):
    placed = X.grids(spark, sf).select("sid", F.size(words(T.sequence_text(F.col("data")))).alias("n"))
    length = F.greatest("n", F.lit(4096))
    return placed.select(
        "sid",
        F.array_join(T.position_ids(T.row_pattern(), F.lit(0), F.col("n"), length).cast("array<string>"), " ").alias("row_ids"),
        F.array_join(T.position_ids(T.col_pattern(), F.lit(0), F.col("n"), length).cast("array<string>"), " ").alias("col_ids"),
    )


def row_forward_fill(spark, sf):
    docs = X.document_tokens(spark, sf).withColumn("ids", T.row_ids(F.col("tokens")))
    return docs.select("doc_id", X.as_text("ids").alias("row_ids"))


def col_position(spark, sf):
    docs = X.document_tokens(spark, sf).withColumn("ids", T.col_ids(F.col("tokens")))
    return docs.select("doc_id", X.as_text("ids").alias("col_ids"))


def chunk_pad_query(spark, sf):
    chunks = chunk_pad(encoded(spark, sf).select("doc_id", "input_ids"), "input_ids", CONTEXT)
    return chunks.select(
        "doc_id", "chunk", *[X.as_text(c).alias(c) for c in ("input_ids", "labels", "attention_mask", "row_ids", "col_ids")]
    )


def text_prefix(spark, sf):
    return X.documents(spark, sf).select("doc_id", T.text_prefix(F.col("text")).alias("input_text"))


def sequence_bos(spark, sf):
    return to_sequence_bos(X.documents(spark, sf), "text", "seq", X.DOC_ROW_LENGTH).select("doc_id", "seq")


def windows(spark, sf):
    docs = X.documents(spark, sf).select("doc_id", words(F.col("text")).alias("tokens"))
    return sliding_chunks(docs, "tokens", CONTEXT, STEP).drop("tokens")


def sliding_chunks_query(spark, sf):
    return windows(spark, sf).select("doc_id", "chunk", F.array_join("window", " ").alias("window"))


def length_stats_query(spark, sf):
    return length_stats(X.document_tokens(spark, sf), "seq", CONTEXT).withColumns(
        {c: F.round(c, 6) for c in ("mean_tokens", "fit_share")}
    )


def tokens_to_grid(spark, sf):
    docs = X.document_tokens(spark, sf)
    cells = T.tokens_to_grid(F.col("tokens"))
    text = F.array_join(F.transform(cells, lambda row: F.array_join(row, " ")), "\n")
    return docs.select("doc_id", F.md5(text).alias("digest"))


def sequence_check(spark, sf):
    """Fitted grids, but every third one as it was."""
    both = fit_grid(X.grids(spark, sf).withColumn("fitted", F.col("data")), "fitted")
    mixed = both.withColumn("data", F.when(F.col("sid") % 3 == 0, F.col("data")).otherwise(F.col("fitted")))
    tokens = to_sequence(mixed).select("sid", words(F.col("text")).alias("tokens"))
    return check_sequence(tokens).drop("tokens")


def bpe_pairs(spark, sf):
    letters = word_counts(X.documents(spark, sf)).select("n", F.split("word", "").alias("symbols"))
    return pair_counts(letters)


def word_pieces(spark, sf):
    model = bpe_train(X.documents(spark, sf), max_merges=MERGES)
    return bpe_encode(windows(spark, sf), model).select(
        "doc_id", "chunk", X.as_text("input_ids").alias("ids"), F.size("attention_mask").alias("n")
    )


def bpe_merges(spark, sf):
    model = bpe_train(X.documents(spark, sf), max_merges=MERGES)
    return spark.createDataFrame(
        [(i, model.tokens[a], model.tokens[b], model.tokens[m]) for i, (a, b, m) in enumerate(model.merges)],
        "position INT, left_token STRING, right_token STRING, merged STRING",
    )


MERGES = 20


def _bpe_sql(merges):
    """The merges as a chain of steps: count pairs, take the top one, replace it in every word.

    A word is its ids with blanks around each, so that a replacement goes from left to right and never overlaps. Merged
    tokens have ids above all characters, in the order of their making.
    """
    steps = [r"""c AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(word, '.')) AS c FROM w),
        n0 AS MATERIALIZED (SELECT c AS token, CASE WHEN c = '~' THEN 5 ELSE 5 + row_number() OVER (PARTITION BY c = '~' ORDER BY c) END AS id FROM c),
        l AS (SELECT word, n, unnest(regexp_extract_all(word, '.')) AS c, generate_subscripts(regexp_extract_all(word, '.'), 1) AS i FROM w),
        s0 AS MATERIALIZED (SELECT any_value(l.n) AS n, concat(' ', string_agg(id, '  ' ORDER BY i), ' ') AS s FROM l JOIN n0 ON l.c = n0.token GROUP BY word)"""]
    for k in range(merges):
        steps.append(f"""x{k} AS (SELECT n, string_split(trim(s), '  ') AS x FROM s{k}),
        p{k} AS (SELECT n, x, unnest(range(1, len(x))) AS i FROM x{k}),
        t{k} AS MATERIALIZED (SELECT CAST(x[i] AS INT) AS a, CAST(x[i + 1] AS INT) AS b FROM p{k} GROUP BY ALL ORDER BY sum(n) DESC, a, b LIMIT 1),
        n{k + 1} AS MATERIALIZED (SELECT * FROM n{k} UNION ALL SELECT concat(l.token, r.token), {2_000_000 + k} FROM t{k} JOIN n{k} l ON l.id = a JOIN n{k} r ON r.id = b),
        s{k + 1} AS MATERIALIZED (SELECT n, replace(s, concat(' ', a, '  ', b, ' '), ' {2_000_000 + k} ') AS s FROM s{k}, t{k})""")
    words_cte = r"""v AS (SELECT unnest(string_split_regex(text, '\s+')) AS word FROM documents),
        w AS MATERIALIZED (SELECT word, count(*) AS n FROM v WHERE word <> '' GROUP BY word)"""
    return f"{words_cte}, {', '.join(steps)}"


def _bpe_merges_sql(merges):
    learned = " UNION ALL ".join(
        f"SELECT CAST({k} AS INT) AS position, l.token AS left_token, r.token AS right_token, concat(l.token, r.token) AS merged "
        f"FROM t{k} JOIN n{k} l ON l.id = a JOIN n{k} r ON r.id = b" for k in range(merges)
    )
    return f"WITH {_bpe_sql(merges)} {learned}"


def _word_pieces_sql(merges):
    """Words cut at '00' and '~', the merges in their order on every piece, then the words of each window put together."""
    done = "' ' || array_to_string(ids, '  ') || ' '"
    for k in range(merges):
        done = f"replace({done}, concat(' ', t{k}.a, '  ', t{k}.b, ' '), ' {2_000_000 + k} ')"
    cut = "replace(replace(word, '00', concat(chr(1), chr(2), chr(1))), '~', concat(chr(1), '~', chr(1)))"
    return f"""WITH {WINDOWS}, {_bpe_sql(merges)},
        f AS (SELECT 6 + count(*) AS free FROM n0 WHERE token <> '~'),
        cw AS (SELECT word, list_filter(string_split({cut}, chr(1)), lambda p: p <> '') AS pieces FROM w),
        cp AS (SELECT word, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM cw),
        pl AS (SELECT piece, unnest(regexp_extract_all(piece, '.')) AS c, generate_subscripts(regexp_extract_all(piece, '.'), 1) AS i
               FROM (SELECT DISTINCT piece FROM cp) WHERE piece NOT IN (chr(2), '~')),
        pi AS (SELECT piece, list(id ORDER BY i) AS ids FROM pl JOIN n0 ON c = token GROUP BY piece),
        pm AS (SELECT piece, string_split(trim({done}), '  ') AS ids FROM pi, {", ".join(f"t{k}" for k in range(merges))}),
        pd AS (SELECT piece, list_transform(ids, lambda x: CASE WHEN CAST(x AS INT) >= 2000000 THEN CAST(x AS INT) - 2000000 + free ELSE CAST(x AS INT) END) AS ids FROM pm, f
               UNION ALL SELECT chr(2), [4] UNION ALL SELECT '~', [5]),
        wd AS (SELECT word, flatten(list(ids ORDER BY i)) AS ids FROM cp JOIN pd USING (piece) GROUP BY word),
        sw AS (SELECT doc_id, s, unnest(list_slice(w, s + 1, s + {CONTEXT})) AS word, unnest(range({CONTEXT})) AS o FROM st),
        sd AS (SELECT doc_id, s, flatten(list(ids ORDER BY o)) AS ids FROM sw JOIN wd USING (word) GROUP BY doc_id, s)
        SELECT doc_id, s // {STEP} + 1 AS chunk, array_to_string(ids, ' ') AS ids, CAST(len(ids) AS INT) AS n FROM sd"""


QUERIES = {
    "sequence_text": sequence_text,
    "vocabulary": vocabulary,
    "marker_ids": marker_ids_query,
    "encode_ids": encode_ids_query,
    "encode_ids_large_vocab": encode_ids_large_vocab,
    "decode_ids": decode_ids_query,
    "position_ids": position_ids,
    "row_forward_fill": row_forward_fill,
    "col_position": col_position,
    "chunk_pad": chunk_pad_query,
    "text_prefix": text_prefix,
    "sequence_bos": sequence_bos,
    "sliding_chunks": sliding_chunks_query,
    "length_stats": length_stats_query,
    "tokens_to_grid": tokens_to_grid,
    "sequence_check": sequence_check,
    "bpe_pairs": bpe_pairs,
    "word_pieces": word_pieces,
    "bpe_merges": bpe_merges,
}

WINDOWS = rf"""
dw AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents),
st AS (SELECT doc_id, w, unnest(range(0, len(w) - {CONTEXT} + 1, {STEP})) AS s FROM dw WHERE len(w) >= {CONTEXT})
"""

ORACLES = {
    "sequence_text": f"WITH {X.DOC_LINES} SELECT doc_id, array_to_string(toks, ' ') AS seq FROM ds",
    "vocabulary": f"WITH {X.DOC_TOKENS}, corpus AS (SELECT tok FROM dt), {X.VOCAB} SELECT token, id FROM vocab",
    "marker_ids": f"""WITH {X.DOC_TOKENS},
        v AS (SELECT tok AS token, CAST(row_number() OVER (ORDER BY tok) - 1 AS INT) AS id FROM (SELECT DISTINCT tok FROM dt))
        SELECT token, id FROM v WHERE regexp_full_match(token, '\\[ROW_([0-5][0-9]|6[0-3])\\]')""",
    "encode_ids": f"""WITH {X.DOC_TOKENS}, {X.BENCHMARK_VOCAB}
        SELECT doc_id, string_agg(CAST(coalesce(id, 3) AS VARCHAR), ' ' ORDER BY pos) AS ids
        FROM dt LEFT JOIN vocab ON tok = token GROUP BY doc_id""",
    "encode_ids_large_vocab": f"""WITH {X.DOC_TOKENS}, corpus AS (SELECT tok FROM dt), {X.VOCAB}
        SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids
        FROM dt JOIN vocab ON tok = token GROUP BY doc_id""",
    "decode_ids": f"""WITH {X.DOC_TOKENS}, {X.BENCHMARK_VOCAB}
        SELECT doc_id, string_agg(coalesce(token, '[UNK]'), ' ' ORDER BY pos) AS text
        FROM dt LEFT JOIN vocab ON tok = token GROUP BY doc_id""",
    "position_ids": f"""WITH s AS ({X.SPRITE_SIZES}),
        n AS (SELECT sid, p, h * least(w, 64) AS n FROM s JOIN range(76 * 64) AS r(p) ON p < greatest(h * least(w, 64), 4096))
        SELECT sid, string_agg(CASE WHEN p < least(n, 4096) THEN p // 64 ELSE 64 END, ' ' ORDER BY p) AS row_ids,
          string_agg(CASE WHEN p < least(n, 4096) AND p % 64 > 0 THEN p % 64 - 1 ELSE 64 END, ' ' ORDER BY p) AS col_ids
        FROM n GROUP BY sid""",
    "row_forward_fill": f"""WITH {X.DOC_TOKENS},
        r AS (SELECT doc_id, pos, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 64) AS row FROM dm)
        SELECT doc_id, string_agg(row, ' ' ORDER BY pos) AS row_ids FROM r GROUP BY doc_id""",
    "col_position": f"""WITH {X.DOC_TOKENS},
        g AS (SELECT doc_id, pos, m, count(m) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM dm),
        c AS (SELECT doc_id, pos, m, grp, row_number() OVER (PARTITION BY doc_id, grp ORDER BY pos) - 2 AS c FROM g)
        SELECT doc_id, string_agg(CASE WHEN m IS NOT NULL OR grp = 0 OR c >= 64 THEN 64 ELSE c END, ' ' ORDER BY pos) AS col_ids
        FROM c GROUP BY doc_id""",
    "chunk_pad": f"""WITH {X.DOC_TOKENS}, {X.BENCHMARK_VOCAB},
        i AS (SELECT doc_id, pos, coalesce(id, 3) AS id FROM dt LEFT JOIN vocab ON tok = token),
        n AS (SELECT doc_id, count(*) AS n FROM i GROUP BY doc_id),
        k AS (SELECT doc_id, n, unnest(range(0, greatest(n, 1), {CONTEXT})) AS s FROM n),
        a AS (SELECT k.doc_id, k.n, k.s, o, k.s + o AS pos FROM k CROSS JOIN range({CONTEXT}) AS r(o)),
        f AS (SELECT a.doc_id, a.s // {CONTEXT} + 1 AS chunk, o, coalesce(i.id, 0) AS id,
                CASE WHEN a.pos < n THEN 1 ELSE 0 END AS m,
                CASE WHEN a.pos < n AND a.pos < 4096 THEN a.pos // 64 ELSE 64 END AS r,
                CASE WHEN a.pos < n AND a.pos < 4096 AND a.pos % 64 > 0 THEN a.pos % 64 - 1 ELSE 64 END AS c
              FROM a LEFT JOIN i ON a.doc_id = i.doc_id AND a.pos = i.pos)
        SELECT doc_id, chunk, string_agg(id, ' ' ORDER BY o) AS input_ids, string_agg(id, ' ' ORDER BY o) AS labels,
          string_agg(m, ' ' ORDER BY o) AS attention_mask, string_agg(r, ' ' ORDER BY o) AS row_ids,
          string_agg(c, ' ' ORDER BY o) AS col_ids FROM f GROUP BY doc_id, chunk""",
    "text_prefix": "SELECT doc_id, substr(text, 1, 512) AS input_text FROM documents",
    "sequence_bos": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        r AS (SELECT doc_id, i, list_slice(list_concat(['00'], list_filter(string_split_regex(line, '\s+'), lambda w: w <> '')), 1, 16) AS w FROM l),
        t AS (SELECT doc_id, flatten(list(w ORDER BY i)) AS w FROM r GROUP BY doc_id)
        SELECT doc_id, array_to_string(CASE WHEN len(w) = 1 THEN ['[EOS]']
          ELSE list_concat(['[BOS]'], list_slice(w, 2, len(w) - 1), ['[EOS]']) END, ' ') AS seq FROM t""",
    "sliding_chunks": f"""WITH {WINDOWS} SELECT doc_id, s // {STEP} + 1 AS chunk,
        array_to_string(list_slice(w, s + 1, s + {CONTEXT}), ' ') AS window FROM st""",
    "length_stats": f"""WITH {X.DOC_LINES}, n AS (SELECT CAST(len(toks) AS INT) AS n FROM ds)
        SELECT min(n) AS min_tokens, max(n) AS max_tokens, round(avg(n), 6) AS mean_tokens,
          round(avg(CASE WHEN n <= {CONTEXT} THEN 1.0 ELSE 0.0 END), 6) AS fit_share FROM n""",
    "tokens_to_grid": f"""WITH {X.DOC_TOKENS},
        g AS (SELECT doc_id, pos, tok, starts_with(tok, '[ROW_') AND ends_with(tok, ']') AS d,
               sum(CASE WHEN starts_with(tok, '[ROW_') AND ends_with(tok, ']') THEN 1 ELSE 0 END)
                 OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM dt),
        k AS (SELECT doc_id, grp, tok, row_number() OVER (PARTITION BY doc_id, grp ORDER BY pos) - 1 AS x FROM g
              WHERE NOT d AND NOT (starts_with(tok, '[') AND ends_with(tok, ']'))),
        y AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS y FROM (SELECT DISTINCT doc_id, grp FROM k)),
        c AS (SELECT k.doc_id, y.y, k.x, tok FROM k JOIN y ON k.doc_id = y.doc_id AND k.grp = y.grp WHERE y.y < 64 AND k.x < 64),
        b AS (SELECT ds.doc_id, gy.y AS y, gx.x AS x FROM ds CROSS JOIN range(64) AS gy(y) CROSS JOIN range(64) AS gx(x)),
        ln AS (SELECT b.doc_id, b.y, string_agg(coalesce(tok, '~'), ' ' ORDER BY b.x) AS line
               FROM b LEFT JOIN c ON b.doc_id = c.doc_id AND b.y = c.y AND b.x = c.x GROUP BY b.doc_id, b.y)
        SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY y)) AS digest FROM ln GROUP BY doc_id""",
    "sequence_check": f"""WITH {X.FITTED} SELECT fit.sid, fit.sid % 3 <> 0 OR (h = 64 AND w >= 64) AS consistent
        FROM fit JOIN s ON s.sid = fit.sid""",
    "bpe_pairs": r"""WITH w AS (SELECT unnest(string_split_regex(text, '\s+')) AS word FROM documents),
        u AS (SELECT regexp_extract_all(word, '.') AS c, count(*) AS n FROM w WHERE word <> '' GROUP BY word),
        p AS (SELECT n, c, unnest(range(1, len(c))) AS i FROM u)
        SELECT c[i] AS a, c[i + 1] AS b, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY ALL""",
    "bpe_merges": _bpe_merges_sql(MERGES),
    "word_pieces": _word_pieces_sql(MERGES),
}
