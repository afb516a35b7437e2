"""Packing documents into token windows with a controlled mixture.

Every source is a queue of tokens. Each window is filled by deficit round-robin: a source's credit grows by its share of the window, it gives as many
whole tokens as its credit allows, and what is left of the credit goes on to the next window. A source that runs dry leaves its share and credit to the others.
The schedule depends only on the sources' totals and targets and repeats itself after a cycle of windows, so it is a small table; any task
finds the windows of any stretch of a queue by arithmetic, and so deficits carry over partitions without tasks talking to each other.

Tokens are made once, written to the shared folder with each row's place among the rows of its source in the same task, and read again once
the sums by task and source are known. Tokens are never shuffled unless Spark joins the sums that way.

The last tokens, fewer than a window, are cut into sequences of falling powers of two, so nothing is padded at all.

Edge cases: a null text is an empty one and has only its end token; a null source is a source; texts of any length are read whole and cut
freely; repeated rows are packed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm import _vec as V

WINDOW = 4096
CYCLE = 64
#: Distinct words whose tokens a worker remembers.
CACHE_WORDS = 2_000_000


class WordEncoder:
    """Tokens of texts by a tokenizer that never joins what white space parts: distinct words are encoded once and found again by hashes
    of 122 bits, never by one of 61 alone."""

    #: Parts the words of one call; words that hold it are encoded alone.
    MARK = "\x01"

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.hashes = self.checks = np.zeros(0, np.uint64)
        self.begin = self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def words(self, words: list[str], together: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of ids of each."""
        if self.mark is None or any(self.MARK in w for w in words):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)
        parts = [words[i : i + together] for i in range(0, len(words), together)]
        ids, lengths = [], []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(p) for p in parts], add_special_tokens=False), strict=True):
            got = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(got == self.mark)
            if len(cuts) != len(part) - 1:
                raise ValueError("the tokenizer joins or drops words across white space")
            lengths.append(np.diff(np.concatenate([[-1], cuts, [len(got)]])) - 1)
            ids.append(got[got != self.mark])
        return np.concatenate(ids), np.concatenate(lengths)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the number of ids of each row."""
        words = V.Words(buf, offsets)
        n = len(offsets) - 1
        if not len(words.start):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        keys, check = (V.Rolling(buf, k).spans(words.start, words.end) for k in (0, 1))
        keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if (check != check[first][which]).any():
            # Different words with one hash: nothing is looked up in this chunk.
            which = np.arange(len(which))
            return self._placed(words, n, *self.words(self._texts(buf, words, which)), which)
        check = check[first]
        at = np.searchsorted(self.hashes, keys)
        inside = at < len(self.hashes)
        taken, known = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        taken[inside] = self.hashes[at[inside]] == keys[inside]
        known[inside] = taken[inside] & (self.checks[at[inside]] == check[inside])
        begin, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        begin[known], length[known] = self.begin[at[known]], self.length[at[known]]
        pool, new = self.pool, np.flatnonzero(~known)
        if len(new):
            ids, size = self.words(self._texts(buf, words, first[new]))
            begin[new], length[new] = len(pool) + np.cumsum(size) - size, size
            pool = np.concatenate([pool, ids])
            if len(self.hashes) + len(new) <= CACHE_WORDS:
                self.pool = pool
                kept = np.flatnonzero(~taken)
                self.hashes, self.checks, self.begin, self.length = (
                    np.insert(old, at[kept], x[kept]) for old, x in ((self.hashes, keys), (self.checks, check), (self.begin, begin), (self.length, length))
                )
        return self._placed(words, n, pool, length, which, begin)

    @staticmethod
    def _texts(buf: np.ndarray, words: V.Words, which: np.ndarray) -> list[str]:
        raw = buf.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start[which].tolist(), words.end[which].tolist(), strict=True)]

    @staticmethod
    def _placed(words: V.Words, n: int, pool: np.ndarray, length: np.ndarray, which: np.ndarray, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in their order; `pool` has a word's ids from `begin` on."""
        begin = np.cumsum(length) - length if begin is None else begin
        each = length[which]
        flat = pool[V.ragged(begin[which], each)]
        return flat, np.bincount(words.row, each, n).astype(np.int64)


_encoders: dict[str, WordEncoder] = {}


def encoder(tokenizer_json: str) -> WordEncoder:
    """Built once in each worker."""
    if tokenizer_json not in _encoders:
        _encoders[tokenizer_json] = WordEncoder(tokenizer_json)
    return _encoders[tokenizer_json]


@dataclass
class Phase:
    """`repeats` times the same windows: table[j, s] tokens of source s are in the windows before the j-th of a cycle."""

    first: int
    repeats: int
    start: np.ndarray
    table: np.ndarray


def one_window(credit: np.ndarray, share: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """Tokens of each source in a window; credit is carried on. `left` limits each source."""
    take = np.zeros(len(left), np.int64)
    credit += share * size
    while (room := size - take.sum()) > 0:
        more = np.minimum(np.maximum(np.floor(credit + 1e-9), 0).astype(np.int64), left - take)
        if more.sum() > room:
            cut = np.cumsum(more) - room
            more = np.maximum(0, more - np.maximum(0, cut))
        if not more.sum():
            able = np.flatnonzero(left - take > 0)
            if room > len(able):
                # Sources ran dry: the others get what is open by their shares.
                spare = share[able] if share[able].sum() > 0 else np.ones(len(able))
                credit[able] += spare / spare.sum() * room
                continue
            # Nobody has a whole token's credit: those with most of it, and tokens to give, go ahead of their share.
            order = able[np.argsort(-credit[able], kind="stable")][:room]
            more[order] = 1
        take += more
        credit -= more
    return take


def schedule(totals: np.ndarray, weights: np.ndarray | None = None, window: int = WINDOW, cycle: int = CYCLE) -> list[Phase]:
    """Deficit round-robin over queues of the given lengths. Without weights, targets are the queues' shares of all tokens."""
    totals = np.asarray(totals, np.int64)
    left, phases, at, credit = totals.copy(), [], 0, np.zeros(len(totals))
    while left.sum() > 0:
        live = left > 0
        w = np.where(live, totals if weights is None else weights, 0).astype(np.float64)
        if weights is None and phases:
            w = np.where(live, left, 0).astype(np.float64)
        if not w.sum():
            w = live.astype(np.float64)
        share = w / w.sum()
        # Credit goes on to the next phase; the others take over that of a source that ran dry.
        gone = credit[~live].sum()
        credit = np.where(live, credit + share * gone, 0.0)
        # Whole tokens for a cycle, at least one of each source, by largest remainders.
        quota = np.where(live, np.maximum(1, np.floor(share * window * cycle)), 0).astype(np.int64)
        spare = window * cycle - int(quota.sum())
        for s in np.argsort(-(share * window * cycle - quota), kind="stable"):
            if spare <= 0:
                break
            if live[s]:
                quota[s] += 1
                spare -= 1
        if spare:
            quota[int(quota.argmax())] += spare
        repeats = int((left[live] // np.maximum(quota[live], 1)).min()) if quota.min() >= 0 else 0
        start, rows = totals - left, [np.zeros(len(left), np.int64)]
        if repeats:
            rest = quota.copy()
            for _ in range(cycle):
                take = one_window(credit, quota / quota.sum(), rest, window)
                rest -= take
                rows.append(rows[-1] + take)
            left -= repeats * quota
        else:
            repeats, rest = 1, left.copy()
            while rest.sum() > 0 and ((rest > 0) == live).all() and len(rows) <= cycle:
                size = window if rest.sum() >= window else 1 << (int(rest.sum()).bit_length() - 1)
                take = one_window(credit, share, rest, size)
                rest -= take
                rows.append(rows[-1] + take)
            left = rest
        phases.append(Phase(at, repeats, start, np.stack(rows)))
        at += repeats * (len(rows) - 1)
    return phases


def cut(phases: list[Phase], source: np.ndarray, begin: np.ndarray, length: np.ndarray):
    """Pieces of the stretches [begin, begin + length) of the sources' queues: row, start in the row, length, sequence and offset there."""
    row, x, end = np.arange(len(begin)), begin.astype(np.int64).copy(), begin + length
    starts = np.stack([p.start for p in phases]) if phases else np.zeros((0, 0), np.int64)
    out = []
    live = x < end
    while live.any():
        row, x, end = row[live], x[live], end[live]
        s = source[row]
        part = np.zeros(len(row), np.int64)
        sequence, offset, size = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for k in np.unique(s):
            mine = s == k
            part[mine] = np.searchsorted(starts[:, k], x[mine], "right") - 1
        for p, k in {*zip(part.tolist(), s.tolist(), strict=True)}:
            mine = np.flatnonzero((part == p) & (s == k))
            phase = phases[p]
            column, before = phase.table[:, k], phase.table[:, :k].sum(1)
            y = x[mine] - phase.start[k]
            turn = y // column[-1]
            z = y - turn * column[-1]
            j = np.searchsorted(column, z, "right") - 1
            sequence[mine] = phase.first + turn * (len(column) - 1) + j
            offset[mine] = before[j + 1] - before[j] + z - column[j]
            size[mine] = np.minimum(column[j + 1] - z, end[mine] - x[mine])
        out.append((row, x - begin[row], size, sequence, offset))
        x = x + size
        live = x < end
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5


def tokenized(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """_id, _source, _task, _local (tokens of the same source before it in its task), _n and _ids of every row, written once."""
    V.tune(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        encode, task, before = encoder(shared.value).encode, TaskContext.get().partitionId(), {}
        for batch in batches:
            for part in V.chunks(batch, "_text"):
                flat, n = encode(*V.text_buffer(part.column("_text")))
                # The end token follows each row's own.
                ids = np.full(len(flat) + len(n), end_id, np.uint32)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
                n = n + 1
                local = []
                for source, k in zip(part.column("_source").to_pylist(), n.tolist(), strict=True):
                    local.append(before.get(source, 0))
                    before[source] = local[-1] + k
                packed = ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids
                wide = packed.itemsize
                bounds = np.concatenate([[0], np.cumsum(n)]) * wide
                data = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(packed.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_source"), pa.array(np.full(len(n), task, np.int32)), pa.array(local, pa.int64()), pa.array(n), pa.array(np.full(len(n), wide, np.int32)), data],
                    names=["_id", "_source", "_task", "_local", "_n", "_wide", "_ids"],
                )

    return V.written(src.mapInArrow(run, f"_id {kind}, _source string, _task int, _local long, _n long, _wide int, _ids binary"), "tokens")


def pack(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source and, if asked, the ids themselves.
    `weights` are the sources' targets; without them each window has the sources' shares of all tokens. One row a source comes to the driver."""
    spark = docs.sparkSession
    table = tokenized(docs, tokenizer_json, end_id, id_col, text_col, source_col)
    sums = V.written(table.groupBy("_task", "_source").agg(F.sum("_n").alias("_sum")), "sums")
    totals = {r["_source"]: r["n"] for r in sums.groupBy("_source").agg(F.sum("_sum").alias("n")).collect()}
    names = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    phases = schedule(np.array([totals[s] for s in names], np.int64), None if weights is None else np.array([weights.get(s, 0) for s in names], np.float64), window)
    plan = spark.sparkContext.broadcast((names, phases))
    before = Window.partitionBy("_source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("_task").alias("_t"), F.col("_source").alias("_s"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    placed = table.join(base, (F.col("_task") == F.col("_t")) & F.col("_source").eqNullSafe(F.col("_s")))
    placed = placed.select("_id", "_source", (F.col("_base") + F.col("_local")).alias("_begin"), "_n", "_wide", "_ids")
    kind = placed.schema["_id"].dataType.simpleString()

    def run(batches):
        names, phases = plan.value
        index = {s: i for i, s in enumerate(names)}
        for batch in batches:
            source = np.array([index[s] for s in batch.column("_source").to_pylist()], np.int64)
            n = batch.column("_n").to_numpy()
            row, start, length, sequence, offset = cut(phases, source, batch.column("_begin").to_numpy(), n)
            data, wide = batch.column("_ids"), batch.column("_wide").to_pylist()
            ids = [np.frombuffer(b.as_buffer(), np.uint16 if w == 2 else np.uint32).astype("<u4") for b, w in zip(data, wide, strict=True)]
            spans = [ids[r][a : a + m] for r, a, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            columns = [batch.column("_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in spans], pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(offset), batch.column("_source").take(pa.array(row))]
            if with_ids:
                columns.append(pa.array([x.tolist() for x in spans], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "pack_source", *["ids"] * with_ids])

    out = placed.mapInArrow(run, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, pack_source string{', ids array<int>' * with_ids}")
    return out.withColumnRenamed("_id", id_col)
