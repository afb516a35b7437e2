"""Removing repeated passages with suffix arrays.

Every string of `width` bytes that also starts anywhere else goes, wherever it occurs. Windows are dealt to shards so that equal ones meet: a window
belongs to the least of its hashed grams (its anchor, the leftmost of equals), so equal windows have equal anchors, and the windows that share one anchor
position form a piece. Only anchors that occur twice can hold a repeat. Equal pieces
are found by 122 bits of hashes and go as a whole; one of each kind is kept, and where an anchor has different kinds, their bytes go to a shard.

Each shard builds the suffix array of its pieces by Larsson-Sadakane refinement (doubling ranks, leaving sorted groups alone), finds the common
prefixes with Kasai's method, many stretches of the text side by side, and so the classes of windows that agree in `width` bytes. The pieces of a very common
anchor are dealt over several shards; these hand out the sorted hashes (122 bits) of their windows, and each run is searched by bisection in
the others for windows that occur in another shard.

Edge cases: a null text is empty; texts shorter than `width` bytes lose nothing; matches never cross documents; overlapping repeats within
one text count; repeated rows repeat each other; texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import _vec as V

WIDTH = 200
GRAM = 50
#: Pieces of one anchor in a shard, and bytes of a shard.
SHARD_PIECES = 1024
SHARD_BYTES = 1 << 19
#: Windows of split anchors in a range of hashes.
RANGE_WINDOWS = 100_000

_U = np.uint64
_HIGH = _U(0xFFFFFFFF00000000)


def pieces(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """Row, start in the row, windows, repeats, anchor hash and two piece hashes of each piece. Equal pieces that follow one another are one entry."""
    empty = [np.zeros(0, np.int64)] * 7
    windows = np.maximum(np.diff(offsets) - width + 1, 0)
    if not windows.any():
        return empty
    rolling, n = V.Rolling(buf), len(buf)
    at = np.arange(n - gram + 1)
    grams = rolling.spans(at, at + gram)
    low = (grams & _HIGH) | np.arange(len(grams), dtype=_U)
    span, reach = width - gram + 1, 1
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    at = V.ragged(offsets[:-1], windows)
    row = np.repeat(np.arange(len(windows)), windows)
    anchor = (low[at] & ~_HIGH).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    start, row, anchor = at[head], row[head], anchor[head]
    own = np.diff(np.append(head, len(at)))
    whole = V.mix(rolling.spans(start, start + own + width - 1) + (anchor - start).astype(_U))
    other = V.Rolling(buf, 1).spans(start, start + own + width - 1)
    mark = grams[anchor]
    same = np.zeros(len(head), bool)
    same[1:] = (whole[1:] == whole[:-1]) & (other[1:] == other[:-1]) & (mark[1:] == mark[:-1]) & (own[1:] == own[:-1]) & (row[1:] == row[:-1]) & (start[1:] == start[:-1] + own[:-1])
    first = np.flatnonzero(~same)
    repeats = np.diff(np.append(first, len(head)))
    return [row[first], (start - offsets[row])[first], own[first], repeats, *(x[first].view(np.int64) for x in (mark, whole, other))]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of text in the order of their suffixes, refined to the end: the common prefixes are only right in a full order, however few bytes of them count."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).tobytes()
    key = np.ndarray(n, ">u8", padded, strides=(1,)).astype(_U)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.ones(n + 1, bool)
    head[1:n] = sorted_key[1:] != sorted_key[:-1]
    place = np.arange(n)
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head[:n], place, 0))
    h = 8
    while h < n:
        # Groups of more than one suffix; the others have their final place.
        loose = np.flatnonzero(~(head[:n] & head[1:]))
        if not len(loose):
            break
        suffix = order[loose]
        pair = (rank[suffix] << 32) + rank[np.minimum(suffix + h, n)] + 1
        by = np.argsort(pair, kind="stable")
        order[loose] = suffix = suffix[by]
        pair = pair[by]
        new = np.ones(len(loose), bool)
        new[1:] = pair[1:] != pair[:-1]
        head[loose] = new
        rank[suffix] = np.maximum.accumulate(np.where(new, loose, 0))
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, stretch: int = 64) -> np.ndarray:
    """Length of the common prefix of each suffix in `order` with the one before it, up to `most`.

    Kasai: the next suffix of the text shares at least one byte less than this one does. Every stretch of the text is walked on its own, all of them together."""
    n = len(text)
    words = np.ndarray(n + most + 8, "<u8", np.concatenate([text, np.zeros(most + 16, np.uint8)]).tobytes(), strides=(1,))
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    length = np.zeros(-(-n // stretch), np.int64)
    for step in range(stretch):
        p = np.arange(step, n, stretch)
        q = before[p]
        length = np.maximum(length[: len(p)] - 1, 0)
        length[q < 0] = 0
        live = np.flatnonzero((q >= 0) & (length < most))
        while len(live):
            a, b, have = p[live], q[live], length[live]
            other = words[a + have] ^ words[b + have]
            same = np.bitwise_count((other & (~other + _U(1))) - _U(1)).astype(np.int64) >> 3
            have = have + np.where(other == 0, 8, same)
            length[live] = np.minimum(np.minimum(have, most), n - np.maximum(a, b))
            live = live[(other == 0) & (have < most) & (have < n - np.maximum(a, b))]
        shared[p] = length
    return shared[order]


def window_classes(text: np.ndarray, width: int) -> np.ndarray:
    """For each position, a number that two positions share where the next `width` bytes are equal."""
    order = suffix_array(text)
    out = np.empty(len(text), np.int64)
    out[order] = np.cumsum(common_prefixes(text, order, width) < width)
    return out


def runs(flags: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last index of runs of set flags that don't cross pieces."""
    edge = np.ones(len(flags) + 1, bool)
    edge[1:-1] = (flags[1:] != flags[:-1]) | (piece[1:] != piece[:-1])
    cuts = np.flatnonzero(edge)
    first, last = cuts[:-1], cuts[1:]
    keep = flags[first] if len(first) else np.zeros(0, bool)
    return first[keep], last[keep]


#: What names a piece: the hashes of its anchor and of itself.
_PIECE = ("fp", "ph", "pq")
_FOUND = "range int, shard long, fp long, ph long, pq long, a long, b long, run binary"
#: An entry of a run: hashes of the window, its piece, its place there, and whether it is alone in its shard.
_ENTRY = np.dtype([("hash", "<i8"), ("check", "<i8"), ("fp", "<i8"), ("ph", "<i8"), ("pq", "<i8"), ("a", "<i4"), ("lone", "?")])


def search_shard(names: np.ndarray, own: np.ndarray, single: np.ndarray, split: np.ndarray, data: list[bytes], width: int = WIDTH):
    """Repeated windows of a shard's pieces, as (names, first, past) runs, and for the pieces of split anchors each different window as an entry;
    lone says that the window occurs once here, in a piece that occurs once. `names` has a row of hashes a piece."""
    _, first = np.unique(names, axis=0, return_index=True)
    first.sort()
    names, own, single, split = (x[first] for x in (names, own, single, split))
    text = np.frombuffer(b"".join(data[i] for i in first), np.uint8)
    size = np.array([len(data[i]) for i in first], np.int64)
    begin = np.cumsum(size) - size
    at = V.ragged(begin, own)
    piece = np.repeat(np.arange(len(own)), own)
    classes = window_classes(text, width)[at]
    count = np.bincount(classes, minlength=int(classes.max()) + 1 if len(classes) else 0)
    many = count[classes] > 1
    a, b = runs(many & single[piece], piece)
    flagged = (names[piece[a]], at[a] - begin[piece[a]], at[b - 1] - begin[piece[a]] + 1)
    told = np.flatnonzero(split[piece])
    _, one = np.unique(classes[told], return_index=True)
    told = told[one]
    entries = np.zeros(len(told), _ENTRY)
    if len(told):
        for k, name in enumerate(("hash", "check")):
            entries[name] = V.Rolling(text, k).spans(at[told], at[told] + width).view(np.int64)
        for k, name in enumerate(_PIECE):
            entries[name] = names[piece[told], k]
        entries["a"] = at[told] - begin[piece[told]]
        entries["lone"] = ~many[told] & single[piece[told]]
    return flagged, entries


def found_elsewhere(shard: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Which entries have equal hashes in another shard: each shard's sorted run is searched by bisection in what the others hold."""
    out = np.zeros(len(hashes), bool)
    # Both hashes as one number in their order.
    order = np.lexsort((checks, hashes))
    new = np.zeros(len(order), np.int64)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    everything = np.sort(rank)
    for s in np.unique(shard):
        mine = np.flatnonzero(shard == s)
        own = np.sort(rank[mine])
        total = np.searchsorted(everything, rank[mine], "right") - np.searchsorted(everything, rank[mine], "left")
        here = np.searchsorted(own, rank[mine], "right") - np.searchsorted(own, rank[mine], "left")
        out[mine] = total > here
    return out


def _search(shard: int, part: pa.Table, width: int) -> pa.Table:
    """Flagged windows as rows (range -1), and what other shards have to look at as one sorted run for each range of hashes."""
    column = lambda name: part.column(name).to_numpy()
    names = np.stack([column(c) for c in _PIECE], 1)
    (named, first, past), entries = search_shard(names, column("own"), column("single"), column("split"), part.column("bytes").to_pylist(), width)
    entries.sort(order="hash")
    n, ranges = len(first), int(part.column("ranges")[0].as_py())
    of = entries["hash"].view(np.uint64) % np.uint64(ranges)
    sent = [(r, entries[of == r].tobytes()) for r in np.unique(of).tolist()]
    zero = np.zeros(len(sent), np.int64)
    columns = [np.concatenate([x, zero]) for x in (*named.T, first, past)]
    return pa.table({
        "range": pa.array([-1] * n + [r for r, _ in sent], pa.int32()), "shard": pa.array(np.full(n + len(sent), shard, np.int64)),
        **{k: pa.array(v) for k, v in zip((*_PIECE, "a", "b"), columns, strict=True)}, "run": pa.array([None] * n + [x for _, x in sent], pa.binary()),
    })


def _merge(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    runs = [np.frombuffer(x, _ENTRY) for x in part.column("run").to_pylist()]
    shard = np.repeat(part.column("shard").to_numpy(), [len(x) for x in runs])
    entries = np.concatenate(runs)
    hit = entries[found_elsewhere(shard, entries["hash"], entries["check"]) & entries["lone"]]
    return pa.table({**{k: np.ascontiguousarray(hit[k]) for k in _PIECE}, "a": hit["a"].astype(np.int64), "b": hit["a"].astype(np.int64) + 1})


def repeated_spans(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """_k and the list of byte spans [s, e) that go, of each text that loses any; rows has _k and _text, and equal _k mean equal texts."""
    V.tune(rows.sparkSession)

    def cut(batches):
        for batch in batches:
            for part in V.chunks(batch, "_text", 1 << 19):
                row, start, own, repeats, *names = pieces(*V.text_buffer(part.column("_text")), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_k").take(pa.array(row)), pa.array(start), pa.array(own.astype(np.int32)), pa.array(repeats), *map(pa.array, names)], names=["_k", "p", "own", "reps", *_PIECE]
                )

    every = V.written(rows.mapInArrow(cut, "_k binary, p long, own int, reps long, fp long, ph long, pq long"), "pieces")
    twice = every.groupBy("fp").agg(F.sum("reps").alias("n")).where("n > 1").select("fp")
    some = V.written(every.join(twice, "fp", "left_semi"), "candidates")
    V.discard(every)
    kinds = V.written(some.groupBy(*_PIECE).agg(F.sum("reps").alias("n"), F.first("own").alias("own"), F.min(F.struct("_k", "p")).alias("at")), "kinds")
    sizes = kinds.groupBy("fp").agg(F.count("*").alias("different")).where("different > 1").withColumn("shards", F.ceil(F.col("different") / SHARD_PIECES))
    wanted = V.written(kinds.join(sizes, "fp").select(*_PIECE, "own", (F.col("n") == 1).alias("single"), "shards", "at._k", "at.p"), "wanted")
    hot = F.when(F.col("shards") > 1, F.col("own")).otherwise(0)
    n_bytes, n_hot = wanted.agg(F.coalesce(F.sum(F.col("own") + width), F.lit(0)), F.coalesce(F.sum(hot), F.lit(0))).first()
    n_shards, n_ranges = max(1, -(-n_bytes // SHARD_BYTES)), max(1, -(-n_hot // RANGE_WINDOWS))
    asked = wanted.groupBy("_k").agg(F.collect_list(F.struct(*_PIECE, "own", "single", "shards", "p")).alias("asked"))

    def fetch(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text, asked in zip(batch.column("_text"), batch.column("asked"), strict=True):
                raw = memoryview(text.as_buffer())
                for x in asked.as_py():
                    for column, value in zip(out, (x["fp"], x["ph"], x["pq"], x["own"], x["single"], x["shards"], raw[x["p"] : x["p"] + x["own"] + width - 1].tobytes()), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[*_PIECE, "own", "single", "shards", "bytes"])

    given = rows.join(asked, "_k").select("_text", "asked").mapInArrow(fetch, "fp long, ph long, pq long, own int, single boolean, shards long, bytes binary")
    shard = F.pmod(F.xxhash64("fp", F.pmod("ph", "shards")), F.lit(n_shards)).alias("shard")
    dealt = given.select(shard, *_PIECE, "own", "single", (F.col("shards") > 1).alias("split"), F.lit(n_ranges).alias("ranges"), "bytes")

    def search(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        return _search(key[0].as_py(), part, width)

    found = V.written(dealt.groupBy("shard").applyInArrow(search, _FOUND), "found")
    merged = found.where("range >= 0").groupBy("range").applyInArrow(_merge, "fp long, ph long, pq long, a long, b long")
    whole = kinds.where("n > 1").select(*_PIECE, F.lit(0).cast("long").alias("a"), F.col("own").cast("long").alias("b"))
    flags = V.written(whole.unionByName(found.where("range < 0").select(*_PIECE, "a", "b")).unionByName(merged), "flags")
    V.discard(kinds, wanted, found)
    placed = some.join(flags, list(_PIECE)).select("_k", F.struct((F.col("p") + F.col("a")).alias("s"), (F.col("p") + (F.col("reps") - 1) * F.col("own") + F.col("b") - 1 + width).alias("e")).alias("span"))
    return placed.groupBy("_k").agg(F.collect_list("span").alias("_spans"))


def cut_text(raw: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left of a text, the number of bytes that went and of maximal runs of them."""
    depth = np.zeros(len(raw) + 1, np.int64)
    for s in spans:
        depth[s["s"]] += 1
        depth[s["e"]] -= 1
    gone = np.cumsum(depth[:-1]) > 0
    starts = gone.copy()
    starts[1:] &= ~gone[:-1]
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), int(starts.sum())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_bytes: bool = False) -> DataFrame:
    """One row a row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the bytes that are left."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), V.row_key(F.col(id_col), text).alias("_k"), text.alias("_text"))
    spans = repeated_spans(rows.select("_k", "_text"), width)
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("_text"), batch.column("_spans"), strict=True):
                raw = text.as_buffer().to_pybytes()
                kept, removed, n = cut_text(raw, spans.as_py()) if spans.is_valid else (raw, 0, 0)
                out.append((len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                columns.append(pa.array([x[4] for x in out], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], names=names)

    joined = rows.join(spans, "_k", "left").select("_id", "_text", "_spans")
    out = joined.mapInArrow(run, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', kept binary' * with_bytes}")
    return out.withColumnRenamed("_id", id_col)
