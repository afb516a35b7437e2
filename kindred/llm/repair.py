"""Repairing the structure of conversations by the cheapest edits.

A conversation's rows, in the order of turn (nulls first), role and text, have roles and faults. The cheapest edits that give roles of the form `(s?(ua)+)?` come from a dynamic program over
the row number and the state of that form. What it looks at of a row is one of nine signs (role initial and whether it is truncated, or that it must go), so a conversation
is a signature, and signatures share prefixes. They are inserted in sorted order into a prefix trie whose nodes hold a layer of the program; a layer is made once for
each shared prefix, and the node where a signature ends has its answer.

A layer holds for each state the least cost of edits that end with the row's own edit, the rank of its audit among the states' audits, and where it came from. Audits of one layer have as many row edits and end in
one, so none begins another, and their ranks decide all later ties: no audit is compared letter by letter. Inserts before a row are at most two, as three lead where one does.

Conversations of up to LONG_ROWS rows and LONG_BYTES of text are dealt by their id and worked on as they are read, in order. Longer ones, up to a third of all rows, are sorted over all tasks
by ranges of (conversation, turn, role, text). Runs of SEGMENT rows are signatures of their own there, solved from every state they may begin in; a task a conversation
then joins the runs by these small tables (48 numbers a run), the chosen beginning and end go back to the run, and the repaired lines are hashed in one pass that holds one batch at a time: a digest of a
conversation's text can't be split.

Damage: crc32(`conv_id:turn`) % 20 drops a row (0), empties its text (1), takes `[.!?]` out of it (2), repeats it (3) or sets its role to user (4).

Edge cases: a null text, role, id or turn reads as one space where it is hashed, compared or written, and null turns come first; null ids are one conversation; a role without a character counts as an unknown one,
which can't be kept; repeated rows are rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import _vec as V

WORD_CHAR = r"[^\x20\x09-\x0D]"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and bytes above which a conversation is solved in runs of SEGMENT rows.
LONG_ROWS, LONG_BYTES, SEGMENT = 10_000, 16 << 20, 2048
#: Nodes that a task's trie keeps; past them it starts anew.
MOST_NODES = 200_000

FAR = 1 << 60
#: States: nothing yet, after s, after u, after a. STEP[state][initial] is the next state; WANTED[state] the role that rerole and insert give there.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEP = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
WANTED = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}
#: Signs: x must go; s, u, a and o (any other role) as they are, S, U, A and O if truncated.
MUST_GO = "x"


def _reach(state: int) -> list[tuple[int, int]]:
    """(inserts, state) that none, one or two inserts lead to; the second one after a full pair leads back."""
    one = STEP[state][WANTED[state]]
    return [(0, state), (1, one), (2, STEP[one][WANTED[one]])]


REACH = tuple(_reach(s) for s in range(4))
#: Inserts that end a conversation in each state: after nothing and after a it may end.
CLOSE = tuple(0 if s in (START, AFTER_A) else next(n for n, to in REACH[s] if to == AFTER_A) for s in range(4))


class Layer:
    """Of each state: cost, rank of the audit, and the edits of the last row (previous state, inserts before it, letter)."""

    __slots__ = ("cost", "rank", "back")

    def __init__(self, cost, rank, back):
        self.cost, self.rank, self.back = cost, rank, back


def first_layer(state: int = START) -> Layer:
    return Layer([0 if s == state else FAR for s in range(4)], [0] * 4, [None] * 4)


def next_layer(layer: Layer, sign: str) -> Layer:
    """The layer after one more row."""
    best: list = [None] * 4
    initial, more = sign.lower(), TRUNCATED if sign.isupper() else 0
    for state in range(4):
        if layer.cost[state] >= FAR:
            continue
        for inserts, at in REACH[state]:
            cost, order = layer.cost[state] + INSERT * inserts, (layer.rank[state], "I" * inserts)
            ways = [(DELETE, "D", at)]
            if sign != MUST_GO:
                if initial in STEP[at]:
                    ways.append((more, "K", STEP[at][initial]))
                ways.append((REROLE + more, "R", STEP[at][WANTED[at]]))
            for price, letter, to in ways:
                key = (cost + price, (order[0], order[1] + letter))
                if best[to] is None or key < best[to][0]:
                    best[to] = (key, (state, inserts, letter))
    order = sorted(x[0][1] for x in best if x)
    return Layer([x[0][0] if x else FAR for x in best], [order.index(x[0][1]) if x else 0 for x in best], [x[1] if x else None for x in best])


class Trie:
    """Layers by prefix. Signatures that come in sorted order find the nodes of the prefix they share with earlier ones."""

    def __init__(self, state: int = START):
        self.root = (first_layer(state), {})
        self.nodes = 1

    def layers(self, signature: str) -> list[Layer]:
        """The layers along a signature, the root's first; missing nodes are made."""
        if self.nodes > MOST_NODES:
            self.root, self.nodes = (self.root[0], {}), 1
        node, out = self.root, [self.root[0]]
        for sign in signature:
            below = node[1].get(sign)
            if below is None:
                below = node[1][sign] = (next_layer(node[0], sign), {})
                self.nodes += 1
            node = below
            out.append(node[0])
        return out


def end_of(layer: Layer) -> tuple[int, int]:
    """Least cost of a whole conversation and the state before its closing inserts."""
    cost, _, state = min((layer.cost[s] + INSERT * CLOSE[s], layer.rank[s], s) for s in range(4) if layer.cost[s] < FAR)
    return cost, state


def edits(layers: list[Layer], state: int) -> tuple[list[tuple[int, str]], int]:
    """(inserts, letter) of each row on the way to `state`, and the state before them."""
    out = []
    for layer in layers[:0:-1]:
        state, inserts, letter = layer.back[state]
        out.append((inserts, letter))
    return out[::-1], state


def repaired(way: list[tuple[int, str]], roles: list[str], texts: list[str], state: int, closing: int = 0) -> tuple[str, list[str]]:
    """The audit of the edits and the lines they leave, from `state` on."""
    audit, lines = [], []

    def emit(initial: str, role: str, text: str) -> None:
        nonlocal state
        lines.append(f"{role}:{text}")
        state = STEP[state][initial]

    for (inserts, letter), role, text in zip(way, roles, texts, strict=True):
        audit.append("I" * inserts + letter)
        for _ in range(inserts):
            emit(WANTED[state], ROLE[WANTED[state]], "")
        if letter == "K":
            emit(role[0], role, text)
        elif letter == "R":
            emit(WANTED[state], ROLE[WANTED[state]], text)
    audit.append("I" * closing)
    for _ in range(closing):
        emit(WANTED[state], ROLE[WANTED[state]], "")
    return "".join(audit), lines


def sign_of(role: Column, must_go: Column, truncated: Column) -> Column:
    initial = F.substring(role, 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(must_go, MUST_GO).when(truncated, F.upper(known)).otherwise(known)


def is_blank(text: Column) -> Column:
    return ~text.rlike(WORD_CHAR)


def is_truncated(text: Column) -> Column:
    """Not blank, and the last character that isn't white space is no end of a sentence."""
    return text.rlike(WORD_CHAR) & ~text.rlike(rf"[{ENDS}][\x20\x09-\x0D]*\z")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """_conv, _turn, _role and _text after damage."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    plain = rows.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), shown(role).alias("_role"), shown(text).alias("_text"), kind.alias("_kind")).where("_kind <> 0")
    changed = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("_text", ENDS, "")).otherwise(F.col("_text"))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")
    return plain.select("_conv", "_turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("_role"), changed.alias("_text"), times).drop("_copy")


_ORDER = ["_turn", "_role", "_text"]
_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}
_EMPTY = hashlib.sha256(b"").hexdigest()


class Counts:
    """Counts of one conversation that rows are added to in order."""

    def __init__(self):
        self.turns = [None, None, 0]
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last_turn = self.last_initial = None

    def add(self, turn, role: str, sign: str, blank: bool) -> None:
        if turn is not None:
            if turn != self.last_turn:
                self.turns[2] += 1
            self.turns[0] = turn if self.turns[0] is None else self.turns[0]
            self.turns[1] = self.last_turn = turn
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in _LEGAL:
            self.illegal += 1
        self.last_initial = initial
        if blank:
            self.blank += 1
        elif sign == MUST_GO:
            self.duplicate += 1
        elif sign.isupper():
            self.truncated += 1

    @property
    def gaps(self) -> int:
        first, last, n = self.turns
        return 0 if first is None else last - first + 1 - n


def _conversations(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[object, list[tuple]]]:
    """Conversations of sorted batches, each with its rows; only the last one of a batch waits for the next."""
    conv, held = None, []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in names]
        for key, *row in zip(*columns, strict=True):
            if held and key != conv:
                yield conv, held
                held = []
            conv = key
            held.append(row)
    if held:
        yield conv, held


def _short(rows: DataFrame, kind: str) -> DataFrame:
    """The report of conversations that one task can hold, from one exchange."""
    signed = rows.select("*", is_blank(F.col("_text")).alias("_blank"), is_truncated(F.col("_text")).alias("_cut"))
    dealt = signed.repartition("_conv").sortWithinPartitions("_conv", *_ORDER)

    def solve(group: list[tuple[object, list[tuple]]], trie: Trie) -> Iterator[tuple]:
        made = []
        for conv, rows_ in group:
            counts, seen, signs = Counts(), set(), []
            for turn, role, text, blank, cut in rows_:
                must_go = blank or (role, text) in seen
                seen.add((role, text))
                initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
                signs.append(MUST_GO if must_go else initial.upper() if cut else initial)
                counts.add(turn, role, signs[-1], blank)
            made.append(("".join(signs), conv, rows_, counts))
        for signature, conv, rows_, counts in sorted(made, key=lambda x: x[0]):
            layers = trie.layers(signature)
            cost, end = end_of(layers[-1])
            way, begin = edits(layers, end)
            audit, lines = repaired(way, [r[1] for r in rows_], [r[2] for r in rows_], begin, CLOSE[end])
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            yield conv, counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, audit, digest

    def run(batches):
        trie, group, size = Trie(), [], 0
        for conv, rows_ in _conversations(batches, ["_conv", *_ORDER, "_blank", "_cut"]):
            group.append((conv, rows_))
            size += sum(len(r[2]) for r in rows_) + len(rows_)
            if size > 1 << 22:
                yield _table(solve(group, trie), kind_of)
                group, size = [], 0
        if group:
            yield _table(solve(group, trie), kind_of)

    kind_of = _arrow_type(rows, "_conv")
    return dealt.mapInArrow(run, f"_conv {kind}, {_OUT}")


def _arrow_type(rows: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[name].dataType)


def _table(rows: Iterator[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 9
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["_conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


_SORTED = ["_conv", *_ORDER, "_sign", "_blank", "_part", "_seg", "_at"]


def _in_segments(rows: DataFrame, segment: int) -> DataFrame:
    """Rows in order, over all tasks, with their sign and the segment (_part, _seg) they are in; written once."""
    named = F.md5(F.concat("_role", F.lit("\x00"), "_text"))
    rows = V.written(rows.select("*", named.alias("_named"), is_blank(F.col("_text")).alias("_blank"), is_truncated(F.col("_text")).alias("_cut")), "long-rows")
    # The first turn of each role and text, as a struct: null turns come first in it.
    first = V.written(rows.groupBy("_conv", "_named").agg(F.min(F.struct("_turn")).alias("_first")).select(F.col("_conv").alias("_c"), F.col("_named").alias("_m"), "_first"), "first-turns")
    joined = rows.join(first, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_named") == F.col("_m")))
    later = joined.withColumn("_later", ~F.col("_first._turn").eqNullSafe(F.col("_turn"))).select("_conv", *_ORDER, "_blank", "_cut", "_later", F.substring("_text", 1, 64).alias("_head"))
    # Rows that are equal in these keys stay in one task, so a row's equal stands right before it.
    dealt = later.repartitionByRange(F.col("_conv"), F.col("_turn"), F.col("_role"), F.col("_head")).drop("_head").sortWithinPartitions("_conv", *_ORDER)

    def run(batches):
        part, seg, at, size, last = TaskContext.get().partitionId(), -1, 0, 0, None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("_conv", *_ORDER, "_blank", "_cut", "_later")]
            signs, segs, places = [], [], []
            for conv, turn, role, text, blank, cut, late in zip(*columns, strict=True):
                row = (conv, turn, role, text)
                if last is None or last[0] != conv or at >= segment or size > LONG_BYTES // 4:
                    seg, at, size = seg + 1, 0, 0
                initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
                signs.append(MUST_GO if blank or late or row == last else initial.upper() if cut else initial)
                segs.append(seg)
                places.append(at)
                at, size, last = at + 1, size + len(text), row
            n = len(signs)
            more = [pa.array(signs, pa.string()), batch.column("_blank"), pa.array([part] * n, pa.int32()), pa.array(segs, pa.int64()), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_conv", *_ORDER)), *more], names=_SORTED)

    kinds = dict(rows.dtypes)
    out = V.written(dealt.mapInArrow(run, f"_conv {kinds['_conv']}, _turn {kinds['_turn']}, _role string, _text string, _sign string, _blank boolean, _part int, _seg long, _at int"), "segments")
    V.discard(rows, first)
    return out


_TALLY = "t0 long, t1 long, nt long, first string, last string, illegal long, blank long, duplicate long, truncated long"


def _signatures(rows: DataFrame) -> DataFrame:
    """One row a segment: its signature and its counts, its ends among them."""
    cells = F.sort_array(F.collect_list(F.struct("_at", "_sign", F.substring("_role", 1, 1).alias("i"), "_turn", "_blank")))
    return rows.groupBy("_part", "_seg").agg(F.first("_conv").alias("_conv"), cells.alias("_rows"))


def _solved_from_all(segments: DataFrame) -> DataFrame:
    """Of each segment: signature, counts, and the cost and rank of every end from every beginning (16 of each)."""
    kinds = dict(segments.dtypes)
    plain = segments.select("_part", "_seg", "_conv", F.array_join(F.transform("_rows", lambda x: x["_sign"]), "").alias("sig"), "_rows")

    def run(batches):
        tries = [Trie(s) for s in range(4)]
        for batch in batches:
            out = []
            for sig, rows in zip(batch.column("sig").to_pylist(), batch.column("_rows").to_pylist(), strict=True):
                ends = [trie.layers(sig)[-1] for trie in tries]
                counts = Counts()
                for x in rows:
                    counts.add(x["_turn"], x["i"], x["_sign"], x["_blank"])
                out.append(([c for e in ends for c in e.cost], [r for e in ends for r in e.rank], *counts.turns, rows[0]["i"], rows[-1]["i"], counts.illegal, counts.blank, counts.duplicate, counts.truncated))
            columns = list(zip(*out, strict=True))
            kinds_ = [pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 3, pa.string(), pa.string(), *[pa.int64()] * 4]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds_, strict=True)] if columns else [pa.array([], k) for k in kinds_]
            names = ["cost", "rank", "t0", "t1", "nt", "first", "last", "illegal", "blank", "duplicate", "truncated"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_part", "_seg", "_conv", "sig")), *arrays], names=["_part", "_seg", "_conv", "sig", *names])

    dealt = plain.repartitionByRange("sig", "_part", "_seg").sortWithinPartitions("sig")
    return V.written(dealt.mapInArrow(run, f"_part int, _seg long, _conv {kinds['_conv']}, sig string, cost array<long>, rank array<long>, {_TALLY}"), "solved")


def joined_runs(tables: list[tuple[list[int], list[int]]]) -> tuple[list[tuple[int, int]], int]:
    """(beginning, end) state of each run of a conversation and the least cost, from the runs' costs and ranks (16 of each, by beginning and end)."""
    layer, came = first_layer(), []
    for cost, rank in tables:
        best: list = [None] * 4
        for a in range(4):
            for b in range(4):
                if layer.cost[a] < FAR and cost[4 * a + b] < FAR:
                    key = (layer.cost[a] + cost[4 * a + b], (layer.rank[a], rank[4 * a + b]))
                    if best[b] is None or key < best[b][0]:
                        best[b] = (key, a)
        order = sorted(x[0][1] for x in best if x)
        layer = Layer([x[0][0] if x else FAR for x in best], [order.index(x[0][1]) if x else 0 for x in best], None)
        came.append([x[1] if x else None for x in best])
    total, state = end_of(layer)
    ways = []
    for back in reversed(came):
        ways.append((back[state], state))
        state = back[state]
    return ways[::-1], total


def _chosen(solved: DataFrame) -> DataFrame:
    """begin, end and closing inserts of each segment; the last one of a conversation has its cost and counts. Few numbers a segment meet in a task."""
    names = ["_part", "_seg", "begin", "end", "closing", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: (r["_part"], r["_seg"]))
        ways, total = joined_runs([(r["cost"], r["rank"]) for r in rows])
        counts = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal", "nt")}
        for a, b in zip(rows, rows[1:], strict=False):
            counts["illegal"] += a["last"] + b["first"] not in _LEGAL
            counts["nt"] -= a["t1"] is not None and a["t1"] == b["t0"]
        turns = [t for r in rows for t in (r["t0"], r["t1"]) if t is not None]
        gaps = turns[-1] - turns[0] + 1 - counts["nt"] if turns else 0
        out = []
        for i, (r, (begin, end)) in enumerate(zip(rows, ways, strict=True)):
            last = i == len(rows) - 1
            more = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], total) if last else (None,) * 6
            out.append((r["_part"], r["_seg"], begin, end, CLOSE[end] if last else 0, *more))
        kinds = [pa.int32(), pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 6]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*out, strict=True), kinds, strict=True)})

    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    return V.written(solved.drop("sig").groupBy("_conv").applyInArrow(run, f"_part int, _seg long, begin int, end int, closing int, {counts}"), "chosen")


def _long(rows: DataFrame, kind: str, segment: int) -> DataFrame:
    """The report of conversations that are spread over tasks."""
    sorted_rows = _in_segments(rows, segment)
    solved = _solved_from_all(_signatures(sorted_rows))
    chosen = _chosen(solved)
    of = _arrow_type(rows, "_conv")

    def lines(part: pa.Table) -> pa.Table:
        part = part.sort_by("_at")
        begin, end, closing = (part.column(c)[0].as_py() for c in ("begin", "end", "closing"))
        way, _ = edits(Trie(begin).layers("".join(part.column("_sign").to_pylist())), end)
        audit, made = repaired(way, part.column("_role").to_pylist(), part.column("_text").to_pylist(), begin, closing)
        return pa.table({"_conv": part.column("_conv").slice(0, 1), "_part": part.column("_part").slice(0, 1), "_seg": part.column("_seg").slice(0, 1), "audit": [audit], "made": pa.array(["\n".join(made)] if made else [None], pa.string())})

    given = sorted_rows.join(chosen.select("_part", "_seg", "begin", "end", "closing"), ["_part", "_seg"])
    pieces = given.groupBy("_part", "_seg").applyInArrow(lines, f"_conv {kind}, _part int, _seg long, audit string, made string")
    pieces = pieces.join(chosen.drop("begin", "end", "closing"), ["_part", "_seg"]).repartition("_conv").sortWithinPartitions("_conv", "_part", "_seg")
    counted = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def report(batches):
        digest, some, audit = hashlib.sha256(), False, []
        for batch in batches:
            out = []
            for conv, piece, made, *counts in zip(*(batch.column(c).to_pylist() for c in ("_conv", "audit", "made", *counted)), strict=True):
                audit.append(piece)
                if made is not None:
                    digest.update(("\n" if some else "").encode() + made.encode())
                    some = True
                if counts[-1] is not None:  # the conversation's last segment
                    out.append((conv, *counts, "".join(audit), digest.hexdigest()))
                    digest, some, audit = hashlib.sha256(), False, []
            if out:
                yield _table(iter(out), of)

    return pieces.mapInArrow(report, f"_conv {kind}, {_OUT}")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long_rows: int = LONG_ROWS, segment: int = SEGMENT) -> DataFrame:
    """One row a conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of its damaged rows."""
    V.tune(rows.sparkSession)
    kind = rows.schema[conv].dataType.simpleString()
    after = damaged(rows, conv, turn, role, text)
    sizes = after.groupBy("_conv").agg(F.count("*").alias("_n"), F.sum(F.octet_length("_text")).alias("_bytes"))
    long = V.written(sizes.where((F.col("_n") > long_rows) | (F.col("_bytes") > LONG_BYTES)).select(F.col("_conv").alias("_l")), "long-ids")
    if long.isEmpty():
        out = _short(after, kind)
    else:
        same = F.col("_conv").eqNullSafe(F.col("_l"))
        out = _short(after.join(long, same, "left_anti"), kind).unionByName(_long(after.join(long, same, "left_semi"), kind, segment))
    every = rows.select(F.col(conv).alias("_every")).distinct()
    whole = every.join(out, F.col("_every").eqNullSafe(F.col("_conv")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return whole.select(
        F.col("_every").alias(conv), *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256")
    )


def sql(conv: str = "conv_id", turn: str = "turn", table: str = "conversations") -> str:
    """The report in DuckDB's SQL: a fold over a conversation's rows that keeps the best (cost, audit, lines) of each state; all of small tables."""
    far = f"{{'c': {FAR}::BIGINT, 'a': ''::VARCHAR, 'l': []::VARCHAR[]}}"
    given = lambda s: ROLE[WANTED[s]]

    def ways() -> dict[int, list[str]]:
        out: dict[int, list[str]] = {s: [] for s in range(4)}
        for s in range(4):
            at, lines, letters, price = s, f"acc.s[{s + 1}].l", f"acc.s[{s + 1}].a", f"acc.s[{s + 1}].c"
            for inserts in range(3):
                if inserts:
                    lines, letters, price = f"list_append({lines}, '{given(at)}:')", f"{letters} || 'I'", f"{price} + {INSERT}"
                    at = STEP[at][WANTED[at]]
                add = lambda ok, cost, letter, line: f"CASE WHEN acc.s[{s + 1}].c < {FAR} AND {ok} THEN {{'c': {price} + {cost}, 'a': {letters} || '{letter}', 'l': {line}}} ELSE {far} END"  # noqa: B023, E731
                out[at].append(add("true", DELETE, "D", lines))
                cut = f"CASE WHEN y.x.cut THEN {TRUNCATED} ELSE 0 END"
                for initial, to in STEP[at].items():
                    out[to].append(add(f"NOT y.x.gone AND y.x.i = '{initial}'", f"({cut})", "K", f"list_append({lines}, y.x.role || ':' || y.x.text)"))
                out[STEP[at][WANTED[at]]].append(add("NOT y.x.gone", f"({REROLE} + {cut})", "R", f"list_append({lines}, '{given(at)}:' || y.x.text)"))
        return out

    layers = ", ".join(f"list_min([{', '.join(w)}])" for w in ways().values())
    close = lambda s: {0: "", AFTER_U: "['assistant:']", AFTER_S: "['user:', 'assistant:']"}[s if CLOSE[s] else 0]
    ends = ", ".join(
        f"{{'c': s[{s + 1}].c + {INSERT * CLOSE[s]}, 'a': s[{s + 1}].a || '{'I' * CLOSE[s]}', 'l': " + (f"list_concat(s[{s + 1}].l, {close(s)})" if CLOSE[s] else f"s[{s + 1}].l") + "}" for s in range(4)
    )
    start = ", ".join([f"{{'c': 0::BIGINT, 'a': ''::VARCHAR, 'l': []::VARCHAR[]}}", *[far] * 3])
    none = "{'gone': false, 'cut': false, 'i': '', 'role': '', 'text': ''}"
    key = f"coalesce(CAST({conv} AS VARCHAR), ' ') || ':' || coalesce(CAST({turn} AS VARCHAR), ' ')"
    blank = r"[^\x20\x09-\x0D]"
    return f"""
      WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM range(0, 256) r(i))),
      raw AS (SELECT {conv} AS conv_id, {turn} AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_transform(string_split({key}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1]), 4294967295), 4294967295) % 20 AS k FROM {table}, crc),
      bad AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '{ENDS}', '') ELSE text END AS text FROM raw, range(0, CASE WHEN k = 3 THEN 2 ELSE 1 END) WHERE k <> 0),
      put AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM bad),
      seen AS (SELECT *, regexp_matches(text, '{blank}') AS filled, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY p) || substr(role, 1, 1) AS two FROM put),
      told AS (SELECT *, NOT filled OR again AS gone, filled AND NOT regexp_matches(text, '[{ENDS}][\\x20\\x09-\\x0D]*\\z') AS cut FROM seen),
      n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (NOT filled) AS blank, count(*) FILTER (filled AND again) AS duplicate,
        count(*) FILTER (cut AND NOT again) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal,
        list({{'gone': gone, 'cut': cut, 'i': substr(role, 1, 1), 'role': role, 'text': text}} ORDER BY p) AS rows FROM told GROUP BY conv_id),
      f AS (SELECT *, list_reduce(list_transform(rows, lambda x: {{'s': [{start}], 'x': x}}), lambda acc, y: {{'s': [{layers}], 'x': y.x}}, {{'s': [{start}], 'x': {none}}}).s AS s FROM n),
      e AS (SELECT * EXCLUDE (s, rows), list_min(list_filter([{ends}], lambda z: z.c < {FAR})) AS b FROM f),
      o AS (SELECT DISTINCT {conv} AS conv_id FROM {table})
      SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
        CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(list_aggregate(b.l, 'string_agg', chr(10)), '')) AS repaired_sha256
      FROM o LEFT JOIN e ON o.conv_id IS NOT DISTINCT FROM e.conv_id"""
