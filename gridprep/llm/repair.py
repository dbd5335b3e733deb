"""Repair of the structure of conversations by bidirectional Dijkstra search.

A conversation's rows in order and the states of the role pattern `(s?(ua)+)?` span a lattice: node (i, s) has edited i
rows and stands in state s. Edges edit the next row (keep, rerole, delete) or insert a turn. One heap searches from the
start, one from the accepting ends, level of cost by level, until no cheaper or equally cheap path can be
unseen. All crossings of the cheapest cost are joined, and the least audit of them is taken.

From one node at most one edge has each initial, so the audit determines the repair. Backwards the
least of the equally cheap audits begins with the least initial; forwards two equally cheap audits are
compared where their paths part.

Only one small number per row and the audit of a conversation are held at a time: texts stream through in order,
first for the faults, then for the repaired rows. A conversation of any length is one sequence by its
nature, so its rows meet in one task.
"""

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import functions as F

from gridprep.llm.tables import written
from gridprep.session import shuffle_partitions

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired conversation ends with so far
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
TURN = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}  # what may be inserted or reroled to
ACCEPTING = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"
CLEAN, CUT_OFF, BAD = range(3)  # what a row is: usable, truncated, or to be deleted


def _row_edges(state, initial, kind):
    """(edit, next state, cost) of the edits of one row."""
    yield DELETE, state, COSTS[DELETE]
    if kind == BAD:
        return
    more = TRUNCATED_COST if kind == CUT_OFF else 0
    if (state, initial) in NEXT:
        yield KEEP, NEXT[state, initial], COSTS[KEEP] + more
    yield REROLE, NEXT[state, TURN[state][0]], COSTS[REROLE] + more


def _out(node, rows):
    i, state = node
    if i < len(rows):
        for edit, to, cost in _row_edges(state, *rows[i]):
            yield edit, (i + 1, to), cost
    yield INSERT, (i, NEXT[state, TURN[state][0]]), COSTS[INSERT]


def _into(node, rows):
    i, state = node
    for before in range(4):
        if i > 0:
            for edit, to, cost in _row_edges(before, *rows[i - 1]):
                if to == state:
                    yield edit, (i - 1, before), cost
        if NEXT[before, TURN[before][0]] == state:
            yield INSERT, (i, before), COSTS[INSERT]


class _Search:
    """One of the two searches: settles nodes level by level of cost."""

    def __init__(self, starts, backwards):
        self.backwards = backwards
        self.cost = {node: 0 for node in starts}
        self.link = {node: None for node in starts}  # (edit, node it leads to or comes from)
        self.depth = {node: 0 for node in starts}
        self.done = set()
        # no edge of cost zero leads to an earlier node in this order
        self.heap = [self._entry(0, node) for node in starts]
        heapq.heapify(self.heap)

    def _entry(self, cost, node):
        return cost, -node[0] if self.backwards else node[0], node

    def top(self):
        while self.heap and (self.heap[0][2] in self.done or self.heap[0][0] > self.cost[self.heap[0][2]]):
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle_level(self, edges):
        """Settle all nodes of the smallest cost; yields them."""
        level = self.top()
        while self.top() == level:
            node = heapq.heappop(self.heap)[2]
            self.done.add(node)
            yield node
            for edit, to, cost in edges(node):
                if to in self.done:
                    continue
                known = self.cost.get(to)
                if known is None or level + cost < known:
                    self.cost[to] = level + cost
                    heapq.heappush(self.heap, self._entry(level + cost, to))
                elif level + cost > known or not self._precedes(edit, node, *self.link[to]):
                    continue
                self.link[to], self.depth[to] = (edit, node), self.depth[node] + 1

    def _precedes(self, edit, node, old_edit, old_node):
        """Whether the path over `node` has the lesser audit than the equally cheap one over `old_node`."""
        if self.backwards:
            return edit < old_edit
        while node != old_node:
            if self.depth[node] >= self.depth[old_node]:
                edit, node = self.link[node]
            else:
                old_edit, old_node = self.link[old_node]
        return edit < old_edit

    def audit(self, node):
        edits = []
        while self.link[node] is not None:
            edit, node = self.link[node]
            edits.append(edit)
        return "".join(edits if self.backwards else reversed(edits))


def cheapest_edits(rows):
    """(cost, audit) of the cheapest repair of rows given as (role initial, kind); of equally cheap ones the least audit."""
    start = (0, START)
    forth, back = _Search([start], False), _Search([(len(rows), s) for s in ACCEPTING], True)
    best = float("inf")
    while forth.top() + back.top() <= best:
        # the ends are settled first: every path leads into nodes settled backwards
        side, other, edges = (forth, back, _out) if back.done and forth.top() <= back.top() else (back, forth, _into)
        for node in side.settle_level(lambda node: edges(node, rows)):
            if node in other.cost:
                best = min(best, side.cost[node] + other.cost[node])
    if start in back.done:
        return back.cost[start], back.audit(start)
    # every cheapest path enters the nodes settled backwards once, from a node settled forwards
    crossings = {
        (u, edit, v) for u in forth.done if u not in back.done
        for edit, v, cost in _out(u, rows) if v in back.done and forth.cost[u] + cost + back.cost[v] == best
    }
    return best, min(forth.audit(u) + edit + back.audit(v) for u, edit, v in crossings)


def damage(rows):
    """Faults put into conversations (conv_id, turn, role, text), chosen by a hash of each row's conversation and turn.

    Nulls in role and text, and in what is hashed, are one space. A dropped row stays as one with `dropped` set."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    chance = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), chance.alias("chance")
    ).select(
        "conv_id", "turn", F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("chance").isin(0, 1), "").when(F.col("chance") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("chance") == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(F.col("chance") == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


ORDER = ["turn", "role", "text"]
PLAN = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _conversations(batches, columns):
    """(conv_id, rows) of batches that are sorted by conversation; rows are an iterator to be used up."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns))

    stream = rows()
    row = next(stream, None)
    while row is not None:
        conv_id = row[0]

        def own():
            nonlocal row
            while row is not None and row[0] == conv_id:
                yield row[1:]
                row = next(stream, None)

        yield conv_id, own()


def _plan(rows):
    seen, turns, low, high = set(), set(), None, None
    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    codes, before = [], None
    for turn, role, text, dropped in rows:
        if dropped:
            continue
        if turn is not None:
            turns.add(turn)
            low, high = min(turn, turn if low is None else low), max(turn, turn if high is None else high)
        initial = role[:1]
        if before is not None and before + initial not in LEGAL:
            counts["illegal"] += 1
        before = initial
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        end = text.rstrip(BLANKS)
        kind = CLEAN
        if not end:
            counts["blank"] += 1
            kind = BAD
        elif key in seen:
            counts["duplicate"] += 1
            kind = BAD
        elif end[-1] not in ".!?":
            counts["truncated"] += 1
            kind = CUT_OFF
        seen.add(key)
        codes.append((initial, kind))
    cost, audit = cheapest_edits(codes)
    gaps = high - low + 1 - len(turns) if turns else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit


def _plans(batches):
    made = []
    for conv_id, rows in _conversations(batches, ["conv_id", *ORDER, "dropped"]):
        made.append((conv_id, *_plan(rows)))
        if len(made) == 1000:
            yield _batch(made)
            made = []
    yield _batch(made)


def _batch(rows):
    columns = list(zip(*rows)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.string())],
                                      names=[c.split()[0] for c in PLAN.split(", ")])


def _together(rows, *order):
    return rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), *order)


def plan_repairs(rows):
    """One row per conversation of `rows` (conv_id, turn, role, text, dropped): its faults, and the cheapest repair.

    Rows count in the order of turn (nulls first), then role and text. Of a row's faults the first counts: blank,
    duplicate (role and text seen before in the conversation), truncated (not ended by `.`, `!` or `?`). `illegal`
    counts neighbours whose role initials are none of su, ua, au; `gaps` the turns missing between the first and the last.
    `audit` has one letter for each edit: K keep, R rerole, D delete, I insert. A null conv_id is a conversation too;
    null roles and texts are one space, a null `dropped` is false; rows that are dropped count for nothing,
    and a conversation without others has zeros and an empty audit. Other columns are ignored.
    """
    rows = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.coalesce("dropped", F.lit(False)).alias("dropped"),
    )
    return _together(rows, *(F.asc_nulls_first(c) for c in ORDER)).mapInArrow(_plans, PLAN)


REPAIRED = "conv_id bigint, position bigint, role string, text string"


def _edited(rows):
    """The repaired (role, text) of rows that begin with the audit."""
    audit = next(rows)[-1]
    state, place = START, 0

    def inserted():
        nonlocal state, place
        while place < len(audit) and audit[place] == INSERT:
            role = TURN[state]
            state, place = NEXT[state, role[0]], place + 1
            yield role, ""

    for _, role, text, _ in rows:
        yield from inserted()
        edit = audit[place]
        place += 1
        if edit != DELETE:
            role = TURN[state] if edit == REROLE else role
            state = NEXT[state, role[:1]]
            yield role, text
    yield from inserted()


def _repaired(batches):
    made, held = [], 0
    for conv_id, rows in _conversations(batches, ["conv_id", *ORDER, "audit"]):
        for position, (role, text) in enumerate(_edited(rows)):
            made.append((conv_id, position, role, text))
            held += len(text)
            if len(made) == 10_000 or held > 1 << 24:
                yield _turns(made)
                made, held = [], 0
    yield _turns(made)


def _turns(rows):
    columns = list(zip(*rows)) if rows else [[]] * 4
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in REPAIRED.split(", ")])


def repaired(rows, plans):
    """The repaired turns (conv_id, position, role, text) of `rows` by their plans; inserted turns have an empty text.

    A conversation's turns follow each other in one partition."""
    kept = rows.where(~F.coalesce("dropped", F.lit(False))).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(None).cast("string").alias("audit"),
    )
    nothing = [F.lit(None).cast("bigint").alias("turn"), *[F.lit("").alias(c) for c in ("role", "text")]]
    audits = plans.where("audit <> ''").select("conv_id", *nothing, "audit")
    order = [F.col("audit").isNull(), *(F.asc_nulls_first(c) for c in ORDER)]  # the audit, then the rows
    return _together(audits.unionByName(kept), *order).mapInArrow(_repaired, REPAIRED)


def _hashes(batches):
    """conv_id and the SHA-256 of `role:text` lines, from repaired turns in order."""
    ids, hashes = [], []
    for conv_id, turns in _conversations(batches, ["conv_id", "position", "role", "text"]):
        digest = hashlib.sha256()
        for position, role, text in turns:
            digest.update(("\n" if position else "").encode() + f"{role}:{text}".encode())
        ids.append(conv_id)
        hashes.append(digest.hexdigest())
        if len(ids) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], names=["conv_id", "sha256"])
            ids, hashes = [], []
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], names=["conv_id", "sha256"])


def repair_report(rows):
    """The plans of `rows` with the SHA-256 of each repaired conversation, that of an empty text where nothing is left."""
    rows = written(rows, "rows")
    plans = written(plan_repairs(rows), "plans")
    hashes = repaired(rows, plans).mapInArrow(_hashes, "conv_id bigint, sha256 string").withColumnRenamed("conv_id", "_of")
    found = plans.join(hashes, plans["conv_id"].eqNullSafe(hashes["_of"]), "left")
    return found.select(*plans.columns, F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
