"""Byte-pair encoding over whitespace words."""

import heapq
import re
import unicodedata
from collections import namedtuple
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gridprep import schemas
from gridprep.constants import BLANK, BOS, EOS, PAD, ROW_START, UNK
from gridprep.functions.text import apart, words
from gridprep.operators.vocab import encode_ids
from gridprep.session import ensure_checkpoint_dir, shared_folder, shuffle_partitions, stored

BPE_SPECIAL_TOKENS = [BOS, EOS, UNK, PAD, ROW_START, BLANK]
CODE_POINTS = 0x110000
CANDIDATES = 256
CHECKPOINT_EVERY = 4
BUCKETS = 32
COMPACT_EVERY = 16
LONG_WORD = 64

# tokens in id order; merges as (left id, right id, merged id) in the order they were learned
BpeModel = namedtuple("BpeModel", "tokens merges special")


def nfkc(text):
    """Unicode normal form KC, which Spark has no function for; plain ASCII stays as it is."""

    @F.arrow_udf("string")
    def normalise(texts: pa.Array) -> pa.Array:
        return pa.array(
            [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()],
            pa.string(),
        )

    return apart(normalise)(text)


def word_counts(df, text="text"):
    return df.select(F.explode(words(nfkc(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _neighbours(symbols, column="symbols"):
    """The pairs of neighbours (n, a, b) of words given as arrays with their count `n`."""
    left = F.slice(column, F.lit(1), F.greatest(F.size(column) - 1, F.lit(0)))
    right = F.slice(column, F.lit(2), F.greatest(F.size(column) - 1, F.lit(0)))
    return symbols.select("n", F.inline(F.arrays_zip(left.alias("a"), right.alias("b"))))


def pair_counts(symbols, column="symbols"):
    """How often each two neighbours occur, over words given as arrays with their count `n`."""
    return _neighbours(symbols, column).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _joined(ids):
    """Ids as text in which each has its own blanks, so that neighbours can be replaced."""
    return F.concat(F.lit(" "), F.array_join(ids.cast("array<string>"), "  "), F.lit(" "))


def _parted(symbols):
    return F.split(F.trim(symbols), "  ").cast("array<int>")


class PairIndex:
    """The words under each pair of neighbours they hold, as files in buckets of pairs, so that a round of merges reads the
    words of its own pairs.

    The words a round changes are kept beside it, once each, with their symbols before and after. They say more than the
    buckets, and the later round more than the earlier. Every `COMPACT_EVERY` rounds the buckets are written again.
    """

    SCHEMA = "a int, b int, word_id bigint, n bigint, turn int, symbols string, bucket int"

    def __init__(self, words):
        self.spark, self.turn, self.changed = words.sparkSession, 0, []
        self._write(words.select("word_id", "n", F.lit(0).alias("turn"), F.col("new").alias("symbols"), F.explode(_pairs(F.col("new"))).alias("p")))

    def _write(self, entries):
        self.path = shared_folder(self.spark, "pairs")
        placed = entries.select("p.*", "word_id", "n", "turn", "symbols").withColumn("bucket", F.pmod(F.col("a") * 31 + F.col("b"), F.lit(BUCKETS)))
        placed.repartition("bucket").sortWithinPartitions("bucket", "a", "b").write.partitionBy("bucket").parquet(self.path)

    def _buckets(self):
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def _changes(self):
        turns = [c.where("NOT long").select("word_id", "n", F.lit(turn).alias("turn"), "old", "new") for turn, c in self.changed]
        return reduce(DataFrame.unionByName, turns) if turns else None

    def add(self, changed):
        """Take in the words (word_id, n, old, new, long) of a round."""
        self.turn += 1
        self.changed.append((self.turn, changed))
        if len(self.changed) == COMPACT_EVERY:
            pair = F.struct("a", "b").alias("p")
            gone = self._changes().select("word_id", "n", "turn", F.lit(None).cast("string").alias("symbols"), F.explode(_pairs(F.col("old"))).alias("p"))
            now = self._changes().select("word_id", "n", "turn", F.col("new").alias("symbols"), F.explode(_pairs(F.col("new"))).alias("p"))
            every = self._buckets().select("word_id", "n", "turn", "symbols", pair).unionByName(gone).unionByName(now)
            last = F.max_by(F.struct("n", "turn", "symbols"), F.struct("turn", F.col("symbols").isNotNull().alias("held"))).alias("l")
            self._write(every.groupBy("word_id", "p").agg(last).where("l.symbols IS NOT NULL").select("word_id", "p", "l.*"))
            self.changed = []

    def words(self, pairs):
        """The words (word_id, n, symbols) that hold one of some pairs."""
        buckets = sorted({(a * 31 + b) % BUCKETS for a, b in pairs})
        entries = self._buckets().where(F.col("bucket").isin(buckets)).where(_among(pairs)).select("word_id", "n", "turn", "symbols")
        if self.changed:
            def held(symbols):
                return reduce(or_, [F.contains(symbols, F.lit(f" {a}  {b} ")) for a, b in pairs])

            now = F.when(held(F.col("new")), F.col("new")).alias("symbols")
            changes = self._changes().where(held(F.col("old")) | held(F.col("new")))
            entries = entries.unionByName(changes.select("word_id", "n", "turn", now))
        last = F.max_by(F.struct("n", "symbols"), "turn").alias("l")
        return entries.groupBy("word_id").agg(last).where("l.symbols IS NOT NULL").select("word_id", "l.*")


def _among(pairs):
    """Whether (a, b) is one of a few pairs, as a condition that reaches the files."""
    by_left = {}
    for a, b in pairs:
        by_left.setdefault(a, []).append(b)
    return reduce(or_, [(F.col("a") == a) & F.col("b").isin(bs) for a, bs in by_left.items()])


def _pairs(symbols):
    """The distinct pairs of neighbours of ids in their text form."""
    ids = _parted(symbols)
    left = F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))
    right = F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))
    return F.array_distinct(F.arrays_zip(left.alias("a"), right.alias("b")))


def _changes(changed):
    """Rows (n, a, b) that add up to the change of the pairs' counts with words (n, old, new)."""
    gone = changed.where("old IS NOT NULL").select((-F.col("n")).alias("n"), _parted(F.col("old")).alias("symbols"))
    return _neighbours(gone.unionByName(changed.select("n", _parted(F.col("new")).alias("symbols"))))


def _totals(changes):
    return changes.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0")


def bpe_train(df, text="text", vocab_size=30_000, min_frequency=0, max_token_length=None,
              special=BPE_SPECIAL_TOKENS, max_merges=None):
    """Learn merges from the distinct words of a corpus.

    The most frequent pair is merged, on a tie the one with the smaller ids, until the
    vocabulary is full, `max_merges` are learned or no pair is frequent enough. A pair of two characters may always be
    merged; a pair with a merged token only if together they have fewer than
    `max_token_length` characters.

    All words are counted once. After that a round reads the words that hold its pairs (`PairIndex`) and changes the
    counts by what they lose and gain. Words of more than `LONG_WORD` symbols would be copied under too many pairs; they lie
    apart and are looked through in every round.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # read for the letters and for the state, so they are spread over all tasks once
    counted = word_counts(df, text).repartition(shuffle_partitions(spark), "word").checkpoint()
    letters = counted.select(F.explode(F.split("word", "")).alias("c")).distinct().orderBy("c")
    # there are no more characters than code points
    alphabet = [r["c"] for r in letters.limit(CODE_POINTS).collect()]
    tokens = list(special) + [c for c in alphabet if c not in special]
    ids = {t: i for i, t in enumerate(tokens)}
    merges = []

    def full():
        return len(tokens) >= vocab_size or len(merges) == max_merges

    if full() or not alphabet:
        return BpeModel(tokens, merges, list(special))
    base = spark.createDataFrame([(c, ids[c]) for c in alphabet], schemas.VOCAB)
    spelled = encode_ids(counted.withColumn("_c", F.split("word", "")), base, ["word"], "_c", "_ids", limit=CODE_POINTS)
    state = spelled.where(F.size("_ids") > 1).select(
        F.monotonically_increasing_id().alias("word_id"), "n", F.lit(None).cast("string").alias("old"),
        _joined(F.col("_ids")).alias("new"), (F.size("_ids") > LONG_WORD).alias("long"),
    )
    state = stored(state, "words")
    counts = stored(_totals(_changes(state)), "counts")
    index = PairIndex(state.where("NOT long"))
    long_words = state.where("long").select("word_id", "n", F.col("new").alias("symbols"))
    has_long = not long_words.isEmpty()
    pending = 0

    while not full():
        found = _totals(counts) if pending else counts
        if max_token_length is not None:
            lengths = F.lit([len(t) for t in tokens])
            joined = F.get(lengths, F.col("a")) + F.get(lengths, F.col("b"))
            found = found.where((joined == 2) | (joined < max_token_length))
        best = (
            found.where(F.col("n") >= max(1, min_frequency))
            .orderBy(F.desc("n"), "a", "b")
            .limit(CANDIDATES)
            .collect()
        )
        if not best:
            break
        learned = []
        for a, b in _certain(best):
            merged = tokens[a] + tokens[b]
            is_new = merged not in ids
            if is_new:
                ids[merged] = len(tokens)
                tokens.append(merged)
            merges.append((a, b, ids[merged]))
            learned.append(merges[-1])
            if full() or not is_new:
                break
        if full():
            break

        def replaced(symbols):
            for a, b, new in learned:
                symbols = F.replace(symbols, F.lit(f" {a}  {b} "), F.lit(f" {new} "))
            return symbols

        touched = index.words([m[:2] for m in learned]).withColumn("long", F.lit(False))
        if has_long:
            touched = touched.unionByName(long_words.withColumn("long", F.lit(True)))
            long_words = long_words.withColumn("symbols", replaced(F.col("symbols")))
        changed = stored(touched.select("word_id", "n", F.col("symbols").alias("old"), replaced(F.col("symbols")).alias("new"), "long").where("old <> new"), "changed")
        index.add(changed)
        counts = counts.select("n", "a", "b").unionByName(_changes(changed))
        pending += 1
        if pending == CHECKPOINT_EVERY:
            counts, pending = stored(_totals(counts), "counts"), 0
            long_words = stored(long_words, "long") if has_long else long_words
    return BpeModel(tokens, merges, list(special))


def _certain(best):
    """The pairs at the head of the list that are the next merges whatever the merges before
    them do to the counts.

    Merging (a, b) leaves pairs without a and b alone, and a pair with the new token is at most
    as frequent as (x, a) or (b, y) was. A pair not in the list is at most as frequent as the
    list's last one.
    """
    unseen = best[-1]["n"] if len(best) == CANDIDATES else 0
    used, limit, certain = set(), 0, []
    for row in best:
        a, b, n = row["a"], row["b"], row["n"]
        if certain and ({a, b} & used or n <= limit):
            break
        certain.append((a, b))
        used |= {a, b}
        around = [r["n"] for r in best if r["b"] == a or r["a"] == b]
        limit = max([limit, unseen, *around])
    return certain


def apply_merges(symbols, ranks):
    """The symbols after all merges: the pair learned earliest first, of equal ones the leftmost.

    Symbols are linked to their neighbours, and the pairs wait in a heap, so n symbols take n log n steps.
    """
    n = len(symbols)
    symbols = list(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[pair][0], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if symbols[i] is None or j >= n:
            continue
        found = ranks.get((symbols[i], symbols[j]))
        if found is None or found[0] != rank:  # one of them has been merged since
            continue
        symbols[i], symbols[j] = found[1], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (symbols[left], symbols[right]) in ranks:
                heapq.heappush(heap, (ranks[symbols[left], symbols[right]][0], left))
    return [s for s in symbols if s is not None]


def bpe_encode(df, model, tokens="window", out="input_ids"):
    """Ids, text and mask of each row's tokens; characters outside the vocabulary are dropped.

    Each distinct word of a batch is encoded once. Special tokens are cut out of the words
    first; then the pair learned earliest is merged until none is left.
    """
    ids = {t: i for i, t in enumerate(model.tokens)}
    ranks = {(a, b): (rank, new) for rank, (a, b, new) in reversed(list(enumerate(model.merges)))}
    special = set(model.special)
    cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) + ")")

    @F.arrow_udf("array<int>")
    def encode(lists: pa.Array) -> pa.Array:
        def encoded(word):
            result = []
            for piece in cut.split(word) if special else [word]:
                if piece in special:
                    result.append(ids[piece])
                else:
                    for part in unicodedata.normalize("NFKC", piece).split():
                        result.extend(apply_merges([ids[c] for c in part if c in ids], ranks))
            return result

        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        distinct = lists.flatten().dictionary_encode()
        table = pa.array([encoded(w) for w in distinct.dictionary.to_pylist()], pa.list_(pa.int32()))
        per_word = table.take(distinct.indices)
        sizes = pc.fill_null(pc.list_value_length(per_word), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        offsets = ends[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), per_word.flatten())

    return df.withColumn(out, apart(encode)(F.col(tokens))).withColumns({
        "input_text": F.array_join(tokens, " "),
        "attention_mask": F.array_repeat(F.lit(1).cast("tinyint"), F.size(out)),
    })


def bpe_vocab(spark, model):
    return spark.createDataFrame([(t, i) for i, t in enumerate(model.tokens)], schemas.VOCAB)
