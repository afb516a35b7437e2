"""Near-duplicate documents by DartMinHash.

A text is the weighted set of its five-word shingles, a shingle's weight being how often it occurs. Hashed darts are thrown at the plane of weight
by rank: every unit cell of a shingle's region gets a Poisson number of darts at hashed places, the same in every text that has the cell. A text
catches the darts inside its weights, up to a rank that yields a few darts for each coordinate, and keeps the earliest of each coordinate. Two
signatures agree in a coordinate with the probability of the texts' weighted Jaccard similarity. Work is the text's length plus a constant.

Equal texts are one node from the start. Nodes that agree in a whole band are candidates: small buckets compare all their members, larger ones
each member with the bucket's hub, the member that meets most others over all bands; a pair whose signatures agree in fewer than AGREE of the
coordinates is dropped, every other one is verified by exact similarity over the whole texts. Classes are the connected components of the
verified links, so members of a bucket that are in one component by then need no more comparing. Where large buckets still hold several components,
the members outside the largest one meet all the others in cells of bounded size: a task holds two blocks of texts and gets all their
similarities from products of count matrices, so no pair is a row unless it links. That last step's work is the number of such members times their cluster.

Words are lower-cased and lose their punctuation. With 28 bands of 5, a pair of similarity 0.8 is no candidate 15 times in a million, and fails AGREE
about once in a million.

Edge cases: a null text is a class of its own; texts without a word link only to equal texts; texts of one to four words have one shingle;
texts of any length are read whole; repeated rows and ties share the class of the least id, and one row of the class is kept; an empty table gives an empty result; other columns are
ignored by `classes` and passed through by `deduplicated`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import _vec as V
from kindred.llm.graph import components

SHINGLE = 5
BANDS, ROWS = 28, 5
THRESHOLD = 0.8
#: Buckets with up to so many members compare all of them; larger ones go by hubs and cells, which finds the same classes at another cost.
SMALL_BUCKET = 16
#: Texts of a cell: outside the largest component, and of their cluster.
CELL = 256, 2048
#: Share of equal coordinates below which a pair isn't verified.
AGREE = 0.62
PUNCTUATION = ".,;:!?\"'()[]{}"

_U = np.uint64
#: Chances of at most 0, 1, 2, ... darts in a cell: Poisson with mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def normal(text: Column) -> Column:
    return F.translate(F.lower(text), PUNCTUATION, "")


def units(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of each row's weighted set: a hash of (shingle, which of its occurrences) and the row."""
    words = V.Words(buf, offsets)
    n = len(offsets) - 1
    per_row = np.bincount(words.row, minlength=n)
    first = np.cumsum(per_row) - per_row
    grams = V.Rolling(V.Rolling(buf).spans(words.start, words.end))
    row = np.flatnonzero(per_row)
    each = np.maximum(per_row[row] - shingle + 1, 1)
    begin = np.cumsum(each) - each
    at = np.repeat(first[row] - begin, each) + np.arange(each.sum())
    row = np.repeat(row, each)
    h = grams.spans(at, np.minimum(at + shingle, first[row] + per_row[row]))
    # The occurrence's number among equal shingles of its row.
    key = h ^ V.mix(row.astype(_U) + _U(1))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    place = np.arange(len(key))
    nth = np.empty(len(key), np.int64)
    nth[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return V.mix(h + nth.astype(_U) * _U(0xA0761D6478BD642F)), row


def signatures(unit: np.ndarray, row: np.ndarray, n: int, k: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The earliest dart of each coordinate (n x k), and which rows have any unit."""
    weight = np.bincount(row, minlength=n)
    out = np.zeros(n * k, _U)
    todo, darts = weight > 0, k * (math.log(k) + 3)
    while todo.any():
        mine = todo[row]
        e, r = unit[mine], row[mine]
        reach = darts / np.maximum(weight, 1)
        cells = np.ceil(reach).astype(np.int64)[r]
        begin = np.cumsum(cells) - cells
        rank = np.arange(cells.sum()) - np.repeat(begin, cells)
        cell = V.mix(np.repeat(e, cells) + (rank.astype(_U) + _U(1)) * _U(0xE7037ED1A0B428DB))
        r = np.repeat(r, cells)
        many = np.searchsorted(_POISSON, (cell >> _U(11)) * 2.0**-53, "right")
        again = np.cumsum(many) - many
        nth = np.arange(many.sum()) - np.repeat(again, many)
        dart = V.mix(np.repeat(cell, many) + (nth.astype(_U) + _U(1)) * _U(0x8EBC6AF09C88C6E3))
        r = np.repeat(r, many)
        when = np.repeat(rank, many) + (dart >> _U(11)) * 2.0**-53
        caught = when < reach[r]
        dart, r, when = dart[caught], r[caught], when[caught]
        coordinate = (V.mix(dart) % _U(k)).astype(np.int64)
        order = np.argsort(-when, kind="stable")
        slot = (r * k + coordinate)[order]
        filled = np.zeros(n * k, bool)
        filled[slot] = True
        out[slot] = dart[order]  # of equal slots the last one stays: the earliest dart
        todo &= ~filled.reshape(n, k).all(1)
        darts *= 2
    return out.reshape(n, k), weight > 0


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.shape[1] // bands
    key = np.full((len(signature), bands), 0, _U) + np.arange(1, bands + 1, dtype=_U)
    for j in range(rows):
        key = V.mix(key * _U(0x9E3779B97F4A7C15) + signature[:, j::rows])
    return key


def similarities(a, b) -> np.ndarray:
    """Weighted Jaccard similarity of the texts in each place of two Arrow columns."""
    n = len(a)
    (ua, ra), (ub, rb) = units(*V.text_buffer(a)), units(*V.text_buffer(b))
    salt = V.mix(np.arange(1, n + 1, dtype=_U))
    keys = np.concatenate([ua ^ salt[ra], ub ^ salt[rb]])
    _, later = V.repeated(keys, keys)
    both = np.bincount(rb[later[len(ua) :]], minlength=n)
    total = np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n) - both
    return np.where(total > 0, both / np.maximum(total, 1), 0.0)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _nodes(rows: DataFrame) -> DataFrame:
    """_digest, _keys (a key for each band) and _sketch (a byte of each coordinate) of each different text with a word, written once."""

    def run(batches):
        for batch in batches:
            for part in V.chunks(batch, "_words"):
                buf, offsets = V.text_buffer(part.column("_words"))
                signature, some = signatures(*units(buf, offsets), part.num_rows)
                keys = band_keys(signature[some]).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                sketch = pa.array([x.tobytes() for x in signature[some].astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("_digest").filter(pa.array(some)), flat, sketch], names=["_digest", "_keys", "_sketch"])

    signed = rows.where("_digest IS NOT NULL").select("_digest", normal(F.col("_text")).alias("_words")).mapInArrow(run, "_digest binary, _keys array<long>, _sketch binary")
    return V.written(signed.groupBy("_digest").agg(F.first("_keys").alias("_keys"), F.first("_sketch").alias("_sketch")), "signatures")


def _promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of digests whose signatures agree in AGREE of the coordinates, written once."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("_a", "_b"))
            near = (a == b).mean(1) >= AGREE if batch.num_rows else np.zeros(0, bool)
            yield batch.select(["u", "v"]).filter(pa.array(near))

    left, right = (nodes.select(F.col("_digest").alias(k), F.col("_sketch").alias(c)) for k, c in (("u", "_a"), ("v", "_b")))
    return V.written(pairs.join(right, "v").join(left, "u").select("u", "v", "_a", "_b").mapInArrow(run, "u binary, v binary"), "pairs")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) of digests whose texts are similar enough, written once; texts has _digest and _words."""
    left, right = (texts.select(F.col("_digest").alias(k), F.col("_words").alias(c)) for k, c in (("u", "_a"), ("v", "_b")))

    def run(batches):
        for batch in batches:
            for part in V.chunks(batch, "_b"):
                linked = similarities(part.column("_a"), part.column("_b")) >= threshold
                yield part.select(["u", "v"]).filter(pa.array(linked))

    return V.written(pairs.join(right, "v").join(left, "u").select("u", "v", "_a", "_b").mapInArrow(run, "u binary, v binary"), "verified")


def cell_links(words, minor: np.ndarray, root: np.ndarray, threshold: float, together: int = 4096) -> list[tuple[int, int]]:
    """Places (i, j) of similar texts in an Arrow column, i among the minor ones and j not, of different roots; one for each i and root."""
    unit, row = units(*V.text_buffer(words))
    total = np.bincount(row, minlength=len(words)).astype(np.float32)
    left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
    place = np.empty(len(words), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    # Units of the minor texts are the columns; others can't be shared.
    columns = np.unique(unit[minor[row]])
    at = np.minimum(np.searchsorted(columns, unit), max(len(columns) - 1, 0))
    known = columns[at] == unit if len(columns) else np.zeros(len(unit), bool)
    row, at = row[known], at[known]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(columns), together):
        a, b = np.searchsorted(at, [low, low + together])
        r, c = row[a:b], at[a:b] - low
        x, y = np.zeros((len(left), together), np.float32), np.zeros((len(right), together), np.float32)
        mine = minor[r]
        x[place[r[mine]], c[mine]] = 1
        y[place[r[~mine]], c[~mine]] = 1
        shared += x @ y.T
    near = shared / np.maximum(total[left][:, None] + total[right] - shared, 1) >= threshold - 1e-6
    near &= (root[left][:, None] != root[right]) & (shared > 0)
    out = []
    for i in range(len(left)):
        hits = np.flatnonzero(near[i])
        _, first = np.unique(root[right][hits], return_index=True)
        out += [(int(left[i]), int(right[j])) for j in hits[first]]
    return out


def _across(large: DataFrame, found: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between the components that large buckets (_key, _digest, _hub) still hold; texts has _digest and _words."""
    roots = components(found)
    placed = large.join(roots, F.col("_digest") == F.col("node"), "left").select("_key", "_hub", "_digest", F.coalesce("root", "_digest").alias("_root"))
    mixed = V.written(placed.groupBy("_key").agg(F.min("_root").alias("_a"), F.max("_root").alias("_b")).where("_a <> _b").select("_key"), "several")
    placed = V.written(placed.join(mixed, "_key"), "mixed")
    stars = placed.where("_digest <> _hub").select(F.col("_hub").alias("u"), F.col("_digest").alias("v")).distinct()
    clusters = components(stars)
    named = clusters.select("node", F.col("root").alias("_cluster"))
    nodes = placed.select("_digest", "_root").distinct().join(named, F.col("_digest") == F.col("node"), "left").select("_digest", "_root", F.coalesce("_cluster", "_digest").alias("_cluster"))
    sizes = nodes.groupBy("_cluster", "_root").agg(F.count("*").alias("_n"))
    sizes = sizes.groupBy("_cluster").agg(F.max(F.struct("_n", "_root")).alias("_top"), F.sum("_n").alias("_all"))
    few, many = CELL
    sizes = sizes.select("_cluster", F.col("_top._root").alias("_major"), F.ceil((F.col("_all") - F.col("_top._n")) / few).cast("int").alias("_mb"), F.ceil(F.col("_all") / many).cast("int").alias("_ab")).where("_mb > 0")
    nodes = V.written(nodes.join(sizes, "_cluster").join(texts, "_digest"), "clusters")
    block = lambda seed, n: F.pmod(F.xxhash64("_digest", F.lit(seed)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["_cluster", "_digest", "_root", "_words"]
    minor = nodes.where("_root <> _major").select(*names, F.lit(True).alias("_minor"), block(1, "_mb").alias("_i"), spread("_ab").alias("_j"))
    every = nodes.select(*names, F.lit(False).alias("_minor"), block(2, "_ab").alias("_j"), spread("_mb").alias("_i"))

    def cell(part: pa.Table) -> pa.Table:
        digests = part.column("_digest").to_pylist()
        number: dict[bytes, int] = {}
        root = np.array([number.setdefault(x, len(number)) for x in part.column("_root").to_pylist()])
        got = cell_links(part.column("_words"), part.column("_minor").to_numpy(), root, threshold)
        return pa.table({"u": pa.array([min(digests[i], digests[j]) for i, j in got], pa.binary()), "v": pa.array([max(digests[i], digests[j]) for i, j in got], pa.binary())})

    out = V.written(minor.unionByName(every).groupBy("_cluster", "_i", "_j").applyInArrow(cell, "u binary, v binary"), "across")
    V.discard(roots, mixed, placed, clusters, nodes)
    return out


def links(rows: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Verified links (u, v) between digests of different texts in two written tables, enough of them for the components; rows has _digest and _text."""
    nodes = _nodes(rows)
    keys = nodes.select("_digest", F.explode("_keys").alias("_key"))
    buckets = V.written(keys.groupBy("_key").agg(F.count("*").alias("_size")).where("_size > 1"), "sizes")
    members = V.written(keys.join(buckets, "_key"), "buckets")
    small, large = members.where(F.col("_size") <= SMALL_BUCKET), members.where(F.col("_size") > SMALL_BUCKET)
    close = small.select("_key", F.col("_digest").alias("u")).join(small.select("_key", F.col("_digest").alias("v")), "_key").where("u < v").select("u", "v")
    weight = large.groupBy("_digest").agg(F.sum("_size").alias("_met"))
    # Written, so that the join has an exchange of its own on both sides and Spark can split a hot bucket's rows.
    hubs = V.written(large.join(weight, "_digest").groupBy("_key").agg(F.max(F.struct("_met", "_digest"))["_digest"].alias("_hub")), "hubs")
    large = V.written(large.select("_key", "_digest").join(hubs, "_key"), "large")
    star = large.where("_digest <> _hub").select(F.least("_digest", "_hub").alias("u"), F.greatest("_digest", "_hub").alias("v"))
    tried = V.written(close.unionByName(star).distinct(), "tried")
    # The texts of all candidates, fetched once.
    wanted = tried.select(F.col("u").alias("_digest")).unionByName(tried.select(F.col("v").alias("_digest"))).distinct()
    # Copies are put together before the shuffle. Candidates grow with the table: texts go to them by a sort-merge join at every size.
    texts = rows.where("_digest IS NOT NULL").groupBy("_digest").agg(F.first("_text").alias("_text")).join(wanted.hint("merge"), "_digest", "left_semi")
    texts = V.written(texts.select("_digest", normal(F.col("_text")).alias("_words")), "texts")
    promising = _promising(tried, nodes)
    V.discard(nodes, members, hubs, buckets)
    found = _verified(promising, texts, threshold)
    across = _across(large, found, texts, threshold)
    V.discard(tried, promising, large, texts)
    return found, across


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("_digest"), F.col(text_col).alias("_text"))


def _classed(texts: DataFrame, found: tuple[DataFrame, DataFrame], order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(_digest, _root) of each different text, and _first (`order` of the first row) and class_size of each _root; `texts` has _digest, `order` of its first row as _low, and _n."""
    roots = components(found[0].unionByName(found[1]))
    V.discard(*found)
    texts = texts.join(roots, F.col("_digest") == F.col("node"), "left").select("_digest", F.coalesce("root", "_digest").alias("_root"), "_low", "_n")
    texts = V.written(texts, "classes")
    V.discard(roots)
    least = F.min(F.struct(F.col("_low._id").isNull().alias("none"), *(F.col(f"_low.{c}").alias(c) for c in order), F.col("_digest").alias("_digest"))).alias("_first")
    return texts, texts.groupBy("_root").agg(least, F.sum("_n").alias("class_size"))


def _first_rows(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """_digest, the least `order` of its rows (rows with an id before those without) and their number."""
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), *order)).alias("_low")
    return rows.where("_digest IS NOT NULL").groupBy("_digest").agg(least, F.count("*").alias("_n"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a row: id, _digest of the text, class_id (the least id of its class), class_size (rows) and kept (the class's first row: one of its rows, also where rows repeat)."""
    V.tune(docs.sparkSession)
    # Written once, so that rows equal in id and text have a number that tells them apart.
    rows = V.written(_rows(docs, id_col, text_col).select("_id", "_digest", F.monotonically_increasing_id().alias("_row")), "rows")
    found = links(_rows(docs, id_col, text_col).select("_digest", "_text"), threshold)
    texts, first = _classed(_first_rows(rows, ("_id", "_row")), found, ("_id", "_row"))
    named = texts.join(first, "_root").select(F.col("_digest").alias("_d"), F.col("_first._id").alias("class_id"), F.col("_first._row").alias("_kept"), "class_size")
    out = rows.join(named, F.col("_digest") == F.col("_d"), "left")
    return out.select(
        F.col("_id").alias(id_col), "_digest", F.when(F.col("_d").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("_d").isNull() | (F.col("_row") == F.col("_kept"))).alias("kept"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The first document of each class, with all its columns; rows with a null text all stay."""
    V.tune(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    _, first = _classed(_first_rows(rows, ("_id",)), links(rows.select("_digest", "_text"), threshold), ("_id",))
    key = lambda d, i: F.struct(d.alias("d"), i.alias("i"))
    keep = first.select(key(F.col("_first._digest"), F.col("_first._id")).alias("_key"))
    marked = docs.select(F.struct("*").alias("_row"), digest(F.col(text_col)).alias("_digest"), key(digest(F.col(text_col)), F.col(id_col)).alias("_key"))
    # Of rows equal in id and text one stays; they are put together before they meet. Both steps share one exchange.
    stay = marked.where("_digest IS NOT NULL").join(keep, "_key", "left_semi").groupBy("_key").agg(F.first("_row").alias("_row")).select("_row")
    every = stay.unionByName(marked.where("_digest IS NULL").select("_row"))
    return every.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
