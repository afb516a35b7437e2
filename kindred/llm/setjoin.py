"""Exact n-gram Jaccard join by a token-group matrix.

A document is the set of its distinct three-word shingles; two documents link when 100 * intersection >= percent * union, and components of links are returned. Documents of one set are one node from the start.

Similar sets are put into groups of bounded size, and of each group the union of its members' tokens is kept: its line of the token-group matrix. A set and a group are compared by the part of the set that lies in the
union, which no member's intersection exceeds; only groups where it reaches the share of the set (and of the group's least member) that a link needs are opened, and their members then get their exact intersections from a matrix
product. The matrix isn't multiplied whole. Tokens are dealt into parts by a hash, one part more than tokens in which linked sets of their size class may differ; so linked sets agree in one part
at least, and a set meets only the groups that hold a member with an equal part. A part has about nine tokens: a passage that many documents share makes few parts equal, however common it is.

Sets of more than 1/percent-th in size are in one class or the next one; a set has the parts of both. A set's group is named by the most common one of its shared parts, so that copies of one text fall to few groups, and large ones are dealt over groups of about GROUP members
or GROUP_TOKENS tokens by a hash.

Every pair inside a group is decided where the group is. A set of another group first meets, for each part, the heaviest group with that part; after the components of these links, the sets outside a part's largest component
meet every other group of the part, and add a link to each component there. So copies by the thousand cost a meeting each, not one a pair; what stays quadratic is members outside the largest component times groups of
a part, where dissimilar sets have a part in common. Queries of a group are dealt over tasks of bounded tokens.

Set equality rests on 122 bits, shingles inside a compared pair on 61.

Edge cases: a null text, or one without a word, has an empty set and is a component of its own; a text of one or two words is one shingle; only A-Z are folded; repeated rows and equal sets share a component; the component's id is its least doc_id
(a null one counts only where all are null); texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import _vec as V
from kindred.llm.graph import components

SHINGLE = 3
PERCENT = 90
#: Members and tokens of a group, tokens of the queries that one task opens it for, tokens multiplied together.
GROUP, GROUP_TOKENS, QUERY_TOKENS, TOGETHER = 512, 1 << 20, 1 << 20, 4096
#: Queries whose intersections with a group are counted together.
QUERIES = 512

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingles(column, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all rows, in the order of row and first hash: row, and hashes at both bases."""
    buf, offsets = V.text_buffer(column)
    buf = _LOWER[buf]
    words = V.Words(buf, offsets)
    per_row = np.bincount(words.row, minlength=len(offsets) - 1)
    first = np.cumsum(per_row) - per_row
    some = np.flatnonzero(per_row)
    each = np.maximum(per_row[some] - size + 1, 1)
    row = np.repeat(some, each)
    at = V.ragged(first[some], each)
    to = np.minimum(at + size, first[row] + per_row[row])
    one, two = (V.Rolling(V.Rolling(buf, k).spans(words.start, words.end), k).spans(at, to) for k in (0, 1))
    order = np.lexsort((two, one, row))
    row, one, two = row[order], one[order], two[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return row[new], one[new], two[new]


def size_classes(most: int, percent: int = PERCENT) -> np.ndarray:
    """Least size of each class up to one that holds `most`; a set and a larger one that may link are in one class or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def parts_of(classes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Parts of each class but the last: one more than linked sets that have at most the class's sizes can differ in."""
    largest = classes[1:] - 1
    return (100 - percent) * 2 * largest // (100 + percent) + 1


def part_keys(row: np.ndarray, token: np.ndarray, n_rows: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every part of the sets, of their own class and the next one. Classes of one part are left out: there, only equal sets link."""
    size = np.bincount(row, minlength=n_rows)
    classes = size_classes(int(size.max(initial=1)) * 100 // percent + 1, percent)
    parts = parts_of(classes, percent)
    own = np.searchsorted(classes, size, "right") - 1
    rows, keys = [], []
    for step in (0, 1):
        c = np.maximum(own + step, 0)
        m = np.where((size > 0) & (parts[c] > 1), parts[c], 0)
        begin = np.cumsum(m) - m
        inside = m[row] > 0
        r, t = row[inside], token[inside]
        salted = V.mix(t + (c[r].astype(_U) + _U(1)) * _U(0xA24BAED4963EE407))
        part = ((salted >> _U(33)) * m[r].astype(_U)) >> _U(31)
        total = np.zeros(int(m.sum()), _U)
        np.add.at(total, begin[r] + part.astype(np.int64), V.mix(salted + _U(0x9FB21C651E98DF25)))
        of = np.repeat(np.arange(n_rows), m)
        number = np.arange(len(total)) - begin[of]
        rows.append(of)
        keys.append(V.mix(total + V.mix((c[of].astype(_U) << _U(32)) + number.astype(_U) + _U(7))))
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(row, kind="stable")
    return row[order], key[order]


def _signed(docs: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> DataFrame:
    """_id, _n, _set (a digest, null where the set is empty), _t (the text's digest) and _keys of every row, written once."""
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("_t"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in V.chunks(batch, "_text"):
                n = part.num_rows
                row, one, two = shingles(part.column("_text"), size)
                count = np.bincount(row, minlength=n)
                sums = np.zeros((n, 2), _U)
                np.add.at(sums[:, 0], row, V.mix(one))
                np.add.at(sums[:, 1], row, V.mix(two + _U(1)))
                digest = pa.array([x.tobytes() if k else None for x, k in zip(sums, count.tolist(), strict=True)], pa.binary())
                of, key = part_keys(row, one, n, percent)
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(count), digest, part.column("_t"), keys], names=["_id", "_n", "_set", "_t", "_keys"])

    return V.written(rows.mapInArrow(run, f"_id {kind}, _n long, _set binary, _t binary, _keys array<long>"), "sets")


def _grouped(members: DataFrame) -> DataFrame:
    """_set, _n and _group of every set with a shared part, written once."""
    named = V.written(members.groupBy("_set").agg(F.max(F.struct("_often", "_key"))["_key"].alias("_label"), F.first("_n").alias("_n")), "labels")
    sizes = named.groupBy("_label").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("_n") / GROUP_TOKENS)).alias("_subs"))
    group = F.xxhash64("_label", F.pmod(F.xxhash64("_set"), "_subs")).alias("_group")
    out = V.written(named.join(sizes, "_label").select("_set", "_n", group), "groups")
    V.discard(named)
    return out


def _token_sets(docs: DataFrame, text_col: str, wanted: DataFrame, size: int) -> DataFrame:
    """_set, _n, _group and the sorted tokens of each wanted (_t, _set, _n, _group), written once. Copies of a text are put together before they move."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("_t"), F.col(text_col).alias("_text")).groupBy("_t").agg(F.first("_text").alias("_text"))
    rows = texts.join(wanted.hint("merge"), "_t").select("_set", "_n", "_group", "_text")

    def run(batches):
        for batch in batches:
            for part in V.chunks(batch, "_text"):
                row, one, _ = shingles(part.column("_text"), size)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(one.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_set", "_n", "_group")), tokens], names=["_set", "_n", "_group", "_tokens"])

    return V.written(rows.mapInArrow(run, "_set binary, _n long, _group long, _tokens array<long>"), "tokens")


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a list column and the row of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), lengths)


def shared_counts(left: tuple, right: tuple, n_left: int, n_right: int) -> np.ndarray:
    """Size of the intersection of every left set with every right one, both as (places in the union, rows). Only places that both sides have are multiplied."""
    places = np.intersect1d(left[0], right[0])
    sides = []
    for at, row in (left, right):
        column = np.searchsorted(places, at)
        some = places[np.minimum(column, len(places) - 1)] == at if len(places) else np.zeros(len(at), bool)
        order = np.argsort(column[some], kind="stable")
        sides.append((column[some][order], row[some][order]))
    out = np.zeros((n_left, n_right), np.float32)
    for low in range(0, len(places), TOGETHER):
        blocks = []
        for (at, row), n in zip(sides, (n_left, n_right), strict=True):
            a, b = np.searchsorted(at, [low, low + TOGETHER])
            x = np.zeros((n, TOGETHER), np.float32)
            x[row[a:b], at[a:b] - low] = 1
            blocks.append(x)
        out += blocks[0] @ blocks[1].T
    return np.rint(out).astype(np.int64)


def linked(shared: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (left[:, None] + right - shared)


def inside_links(union: np.ndarray, at: np.ndarray, row: np.ndarray, n: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join a group's members as far as they go, and each member's component."""
    k = len(n)
    # A token of one member only counts for nothing but its size.
    often = np.bincount(at, minlength=len(union))[at] > 1
    mine = at[often], row[often]
    near = linked(shared_counts(mine, mine, k, k), n, n, percent)
    root, out = np.full(k, -1), []
    for i in range(k):
        if root[i] < 0:
            root[i], edge = i, [i]
            while edge:
                x = edge.pop()
                for y in np.flatnonzero(near[x] & (root < 0)).tolist():
                    root[y] = i
                    out.append((x, y))
                    edge.append(y)
    return out, root


def opened(member_tokens, n: np.ndarray, root: np.ndarray | None, query_tokens, m: np.ndarray, query_root: np.ndarray | None, percent: int):
    """Links inside a group, and links (query, member) from the queries whose overlap with the group's union allows any, one to each component (`root`, or what is linked inside) but the query's own."""
    token, row = flat(member_tokens)
    union, at = np.unique(token, return_inverse=True)
    inner, found = inside_links(union, at, row, n, percent) if root is None else ([], root)
    if not len(m):
        return inner, []
    token, who = flat(query_tokens)
    place = np.minimum(np.searchsorted(union, token), max(len(union) - 1, 0))
    hit = union[place] == token if len(union) else np.zeros(len(token), bool)
    place, who = place[hit], who[hit]
    overlap = np.bincount(who, minlength=len(m))
    open_ = np.flatnonzero(100 * overlap >= percent * np.maximum(m, n.min(initial=1 << 62)))
    if not len(open_):
        return inner, []
    outer = []
    for low in range(0, len(open_), QUERIES):
        asking = open_[low : low + QUERIES]
        number = np.full(len(m), -1)
        number[asking] = np.arange(len(asking))
        some = number[who] >= 0
        near = linked(shared_counts((place[some], number[who[some]]), (at, row), len(asking), len(n)), m[asking], n, percent)
        for i, q in enumerate(asking.tolist()):
            hits = np.flatnonzero(near[i] & (found != query_root[q])) if query_root is not None else np.flatnonzero(near[i])
            _, first = np.unique(found[hits], return_index=True)
            outer += [(q, int(j)) for j in hits[first]]
    return inner, outer


def _open(sets: DataFrame, queries: DataFrame, percent: int, roots: DataFrame | None) -> DataFrame:
    """Links (u, v) between sets, from opening groups for the queries (_set, _group). With roots (node, root), only links between them, and none inside groups."""
    with_root = lambda df: df.withColumn("_root", F.lit(None).cast("binary")) if roots is None else df.join(roots, F.col("_set") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_set")).drop("node", "root")
    asked = queries.join(sets.select("_set", "_n"), "_set")
    loads = V.written(asked.groupBy("_group").agg(F.greatest(F.ceil(F.sum("_n") / QUERY_TOKENS), F.lit(1)).cast("int").alias("_tasks")), "loads")
    spread = F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1)).alias("_task")
    members = sets.join(loads, "_group", "left" if roots is None else "inner").select("_set", "_n", "_group", "_tokens", spread)
    dealt = queries.join(loads, "_group").select("_set", "_group", F.pmod(F.xxhash64("_set"), "_tasks").cast("int").alias("_task"))
    dealt = dealt.join(sets.select("_set", "_n", "_tokens"), "_set").select("_set", "_n", "_group", "_tokens", "_task")
    whole = with_root(members).withColumn("_asks", F.lit(False)).unionByName(with_root(dealt).withColumn("_asks", F.lit(True)))
    first_round = roots is None

    def run(part: pa.Table) -> pa.Table:
        asks = part.column("_asks").to_numpy()
        mine, theirs = (part.filter(pa.array(x)) for x in (~asks, asks))
        n, m = (x.column("_n").to_numpy() for x in (mine, theirs))
        root = query_root = None
        if not first_round:
            number: dict[bytes, int] = {}
            root, query_root = (np.array([number.setdefault(r, len(number)) for r in x.column("_root").to_pylist()], int) for x in (mine, theirs))
        inner, outer = opened(mine.column("_tokens"), n, root, theirs.column("_tokens"), m, query_root, percent)
        a, b = mine.column("_set").to_pylist(), theirs.column("_set").to_pylist()
        if part.column("_task")[0].as_py():
            inner = []
        pairs = [(a[i], a[j]) for i, j in inner] + [(b[i], a[j]) for i, j in outer]
        return pa.table({"u": pa.array([x for x, _ in pairs], pa.binary()), "v": pa.array([y for _, y in pairs], pa.binary())})

    out = V.written(whole.groupBy("_group", "_task").applyInArrow(run, "u binary, v binary"), "links")
    V.discard(loads)
    return out


def links(docs: DataFrame, signed: DataFrame, text_col: str, percent: int = PERCENT, size: int = SHINGLE) -> list[DataFrame]:
    """Written tables of links (u, v) between different sets, enough of them for the components."""
    nodes = signed.where("_set IS NOT NULL").groupBy("_set").agg(F.first("_keys").alias("_keys"), F.min("_t").alias("_t"), F.first("_n").alias("_n"))
    nodes = V.written(nodes, "nodes")
    keys = nodes.select("_set", "_n", F.explode("_keys").alias("_key"))
    often = keys.groupBy("_key").agg(F.count("*").alias("_often")).where("_often > 1")
    members = V.written(keys.join(often, "_key"), "parts")
    groups = _grouped(members)
    wanted = groups.join(nodes.select("_set", "_t"), "_set").select("_t", "_set", "_n", "_group")
    sets = _token_sets(docs, text_col, wanted, size)
    V.discard(nodes)
    placed = V.written(members.select("_key", "_set").join(groups.select("_set", "_group"), "_set"), "placed")
    V.discard(members)
    weight = placed.groupBy("_group").agg(F.count("*").alias("_weight"))
    hubs = placed.groupBy("_key", "_group").agg(F.lit(1)).join(weight, "_group").groupBy("_key").agg(F.max(F.struct("_weight", "_group"))["_group"].alias("_hub"))
    hubs = V.written(hubs, "hubs")
    asked = placed.join(hubs, "_key").where("_group <> _hub").select("_set", F.col("_hub").alias("_group")).distinct()
    asked = V.written(asked, "asked")
    found = _open(sets, asked, percent, None)
    roots = components(found)
    named = placed.join(roots, F.col("_set") == F.col("node"), "left").select("_key", "_set", "_group", F.coalesce("root", "_set").alias("_root"))
    counts = V.written(named.groupBy("_key", "_root").agg(F.count("*").alias("_c")), "counts")
    mixed = counts.groupBy("_key").agg(F.max(F.struct("_c", "_root"))["_root"].alias("_major"), F.count("*").alias("_roots")).where("_roots > 1").select("_key", "_major")
    named = V.written(named.join(mixed, "_key"), "mixed")
    # Groups of a part, each with its least and greatest root: a set meets those that hold another root than its own.
    held = V.written(named.groupBy("_key", "_group").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high")), "held")
    minor = named.where("_root <> _major").select("_key", "_set", "_root", F.col("_group").alias("_own"))
    second = minor.join(held, "_key").where("_group <> _own AND (_low <> _root OR _high <> _root)").select("_set", "_group").distinct()
    second = V.written(second.join(asked, ["_set", "_group"], "left_anti"), "second")
    more = _open(sets, second, percent, roots)
    V.discard(groups, sets, placed, hubs, asked, roots, counts, named, held, second)
    return [found, more]


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row a row: id, n_shingles and component_id."""
    V.tune(docs.sparkSession)
    signed = _signed(docs, id_col, text_col, percent, size)
    found = links(docs, signed, text_col, percent, size)
    roots = components(found[0].unionByName(found[1]))
    V.discard(*found)
    least = signed.where("_set IS NOT NULL").groupBy("_set").agg(F.min("_id").alias("_low"))
    least = V.written(least.join(roots, F.col("_set") == F.col("node"), "left").select("_set", F.coalesce("root", "_set").alias("_root"), "_low"), "least")
    V.discard(roots)
    named = least.join(least.groupBy("_root").agg(F.min("_low").alias("_first")), "_root").select(F.col("_set").alias("_s"), "_first")
    out = signed.select("_id", "_n", "_set").join(named, F.col("_set") == F.col("_s"), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.when(F.col("_set").isNull(), F.col("_id")).otherwise(F.col("_first")).alias("component_id"))
