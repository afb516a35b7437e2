"""Line deduplication by a segment-partition edit join.

Two lines are near if they are `max_edits` characters apart or, with `words_an_edit`, as few words as the longer line has that many words, rounded down.

Allowed edits leave one of threshold-plus-one disjoint segments of a line untouched, so near lines share one. For characters, a line is cut into
`max_edits + 1` segments, indexed under its length, and it probes the segments of the lengths it could match with those of its substrings that a match could
align (the length-aware selection from both ends). For words, a line indexes its runs of GRAM words from the rarest one on, until threshold-plus-one of them are
disjoint, and probes with the disjoint ones. Whichever of two near lines stops first has an untouched run among its disjoint ones, and the other one, which went
on at least as far in the same order, indexes it. How rare a run is is read from a table of fixed size, counted over all lines; any table gives the same links.

Lines under one key are compared if lengths and places allow it: pair by pair up to BUCKET lines. Above that, each line is compared with the key's earliest one;
the lines still open meet the key's lines in cells of bounded size, where bit sketches of the lines (128 bits, from WIDE_FROM words on 1024 more, which tell lines of up to about 2500 words apart)
rule out nearly all pairs, so only those that may be near are rows:
of each open line the FEW earliest ones first, then the others of the lines still open. The work of the sketches is the number of open lines times the key's lines, and
a line's sketch is sent once for every CELL lines of the key. All that remains is verified by banded edit distance, `2 * threshold + 1` diagonals in a machine word, all pairs of a batch side by side; thresholds over 31 are
verified by the furthest places that each number of edits reaches.

A line is a duplicate if an equal line comes earlier, or if a near one has its first occurrence earlier; order is by document id, text and line
number. Lines of fewer than MIN_CHARS characters are compared for equality only, since one character is too much of them; lines without a word are left alone.

Edge cases: a null text has no lines; texts and lines of any length are read whole; rows equal in id and text are judged alike; ties in the id are
broken by the text's hash; an empty table gives an empty result; other columns are ignored by `line_report` and passed through by `without_duplicates`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import _vec as V

MAX_EDITS = 1
MIN_CHARS = 20
#: Lines that a key may have to be joined pair by pair.
BUCKET = 64
#: The queries' `words_an_edit`.
WORDS_AN_EDIT = 10
#: Words of a run.
GRAM = 3
#: Lines of a key on one side of a cell.
CELL = 8192
#: Earlier lines that an open line of a cell is compared with before all the others.
FEW = 4
#: Words of a line from which it has a wide sketch too: 1024 bits, as half of 128 bits change by chance.
WIDE_FROM = 128
_WIDE = 16
#: Edits that a band of diagonals holds, from band to band; a machine word holds no more.
BANDS = (1, 2, 4, 8, 15, 31)
#: Symbols of lines that are verified side by side.
TOGETHER = 1 << 17

_U = np.uint64
_MAX = _U(2**64 - 1)
_BUCKETS = 1 << 16


def segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the i-th of `parts` segments of lines; the last ones are one longer where it doesn't come out even."""
    size, longer = length // parts, length % parts
    short = parts - longer
    return i * size + np.maximum(0, i - short), size + (i >= short)


def selections(max_edits: int) -> list[tuple[int, int, int]]:
    """(difference of lengths, segment, shift): a probing line looks at the segment's place, shifted, in itself."""
    out = []
    for longer in range(max_edits + 1):
        for i in range(max_edits + 1):
            low, high = max(-i, longer - (max_edits - i)), min(i, longer + (max_edits - i))
            out += [(longer, i, shift) for shift in range(low, high + 1)]
    return out


def join_keys(rolling: V.Rolling, start: np.ndarray, length: np.ndarray, max_edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys and probe keys of lines of code points, one column for each segment or selection; a probe that can't apply is 0."""
    parts = max_edits + 1

    def key(of_length, i, at, size):
        h = rolling.spans(start + at, start + at + size)
        return V.mix(h ^ V.mix(of_length.astype(_U) * _U(64) + _U(i + 1)))

    index = np.stack([key(length, i, *segment(length, i, parts)) for i in range(parts)], 1)
    probes = []
    for longer, i, shift in selections(max_edits):
        if longer == 0 and shift == 0:
            continue  # the index key itself
        of_length = length - longer
        at, size = segment(of_length, i, parts)
        fits = (at + shift >= 0) & (at + shift + size <= length) & (of_length > 0)
        probes.append(np.where(fits, key(of_length, i, np.where(fits, at + shift, 0), np.where(fits, size, 0)), _U(0)))
    return index, np.stack(probes, 1)


def equal_bits(points: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """For each place of points[b:b+n], pair after pair, a word whose bits say which of the 2 * most + 1 places around it in points[a:a+m] have an equal symbol."""
    place = V.ragged(np.zeros(len(n), np.int64), n)
    symbol = points[np.repeat(b, n) + place]
    left = np.repeat(m, n) - place  # symbols of the other line from this place on
    at = np.repeat(a, n) + place
    out = np.zeros(len(place), _U)
    for k in range(2 * most + 1):
        g = k - most
        inside = (place >= -g) & (left > g)
        equal = points[np.where(inside, at + g, 0)] == symbol
        out |= (equal & inside).astype(_U) << _U(k)
    return out


def within(points: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, most: int, limit: np.ndarray | None = None) -> np.ndarray:
    """Whether points[a:a+m] and points[b:b+n] are within `limit` (or `most`) edits: bit-parallel in a band of diagonals that holds `most` edits, pairs side by side."""
    out = np.zeros(len(a), bool)
    close = np.flatnonzero(np.abs(m - n) <= most)
    # The longest first, so that the pairs still running are a prefix, and so many together that their symbols' bits fit in the cache.
    close = close[np.argsort(-n[close], kind="stable")]
    cut = np.flatnonzero(np.diff(np.cumsum(n[close]) // TOGETHER)) + 1
    for part in np.split(close, cut):
        out[part] = _banded(points, a[part], m[part], b[part], n[part], most) <= (most if limit is None else limit[part])
    return out


def _banded(points: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """Edits between points[a:a+m] and points[b:b+n] where they are `most` at most, and more than `most` otherwise; the longest b comes first."""
    wide = 2 * most + 1
    mask, top = _U((1 << wide) - 1), _U(1 << (wide - 1))
    up = np.full(len(n), ((1 << (most + 1)) - 1) << most, _U)
    down = np.zeros(len(n), _U)
    # D[most][0] of a line shorter than the band starts from its own last row.
    distance = np.minimum(np.full(len(n), most, np.int64), m)
    longest = int(n.max()) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, longest + 1), "right")
    bits, begin = equal_bits(points, a, m, b, n, most), np.cumsum(n) - n
    for j in range(1, longest + 1):
        k = active[j - 1]
        equal = bits[begin[:k] + (j - 1)]
        p, q = up[:k], down[:k]
        d0 = ((((equal & p) + p) ^ p) | equal | q) & mask
        right = (q | ~(d0 | p)) & mask
        left = d0 & p
        last = m[:k] - (j - most)
        inner = last >= wide - 1
        distance[:k] += inner & ((d0 & top) == 0)
        edge = np.flatnonzero(~inner & (last >= 0))
        if len(edge):
            at = _U(1) << last[edge].astype(_U)
            distance[edge] += ((right[edge] & at) != 0).astype(np.int64) - ((left[edge] & at) != 0)
        up[:k] = (left | ~((d0 >> _U(1)) | right)) & mask
        down[:k] = (d0 >> _U(1)) & right
    return distance


def points_of(buf: np.ndarray) -> np.ndarray:
    return np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def words_within(a: list, b: list, most: int) -> bool:
    """Whether two lists are within `most` edits, by the furthest places that each number of edits reaches on each diagonal."""
    m, n = len(a), len(b)
    # A word that the other list lacks takes an edit of its own.
    if abs(m - n) > most or len(set(b).difference(a)) > most:
        return False
    reached: dict[int, int] = {}
    for d in range(most + 1):
        now = {}
        for g in range(-min(d, m), min(d, n) + 1):
            x = max(reached.get(g + 1, -2) + 1, reached.get(g, -2) + 1, reached.get(g - 1, -2)) if d else 0
            x = min(x, m, n - g)
            if x < 0 or x + g < 0:
                continue
            while x < m and x + g < n and a[x] == b[x + g]:
                x += 1
            now[g] = x
        if now.get(n - m, -1) >= m:
            return True
        reached = now
    return False


def near_words(words: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether words[a:a+m] and words[b:b+n], of hashed words, are within `most` edits, for each pair, where `least` are certain.
    A pair is tried in the narrowest band that may hold it and then in wider ones."""
    out = np.zeros(len(a), bool)
    least = np.maximum(least, np.abs(m - n))
    open_ = least <= most
    for band in BANDS:
        mine = np.flatnonzero(open_ & (least <= band) & (most <= BANDS[-1]))
        out[mine] = within(words, a[mine], m[mine], b[mine], n[mine], band, most[mine])
        open_[mine] = ~out[mine] & (most[mine] > band)
    for i in np.flatnonzero(open_):
        out[i] = words_within(words[a[i] : a[i] + m[i]].tolist(), words[b[i] : b[i] + n[i]].tolist(), int(most[i]))
    return out


def sketches(symbols: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """128 bits of each stretch of hashed words: which of them it has an odd number of times. A word's edit changes two bits at most."""
    out = np.zeros((len(first), 2), _U)
    some = np.flatnonzero(count)
    if len(some):
        order = V.ragged(first[some], count[some])
        h = V.mix(symbols[order] + _U(1))
        starts = np.cumsum(count[some]) - count[some]
        bit, lane = _U(1) << (h & _U(63)), (h >> _U(6)) & _U(1)
        for k in range(2):
            out[some, k] = np.bitwise_xor.reduceat(np.where(lane == k, bit, _U(0)), starts)
    return out


def wide_sketches(symbols: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.Array:
    """The same in 1024 bits, null for stretches of under WIDE_FROM words."""
    some = np.flatnonzero(count >= WIDE_FROM)
    out = np.zeros((len(some), _WIDE), _U)
    if len(some):
        h = V.mix(symbols[V.ragged(first[some], count[some])] ^ _U(0x9E3779B97F4A7C15))
        lane = np.repeat(np.arange(len(some)) * _WIDE, count[some]) + ((h >> _U(6)) & _U(_WIDE - 1)).astype(np.int64)
        np.bitwise_xor.at(out.reshape(-1), lane, _U(1) << (h & _U(63)))
    at = np.full(len(first), -1, np.int64)
    at[some] = np.arange(len(some))
    return pa.array([row.tobytes() for row in out], pa.binary()).take(pa.array(at, mask=at < 0))


def disjoint_runs(order: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Which runs (by first word) are picked where the least in order goes first and rules out those that overlap it; _MAX is no run."""
    now, picked = order.copy(), np.zeros(len(order), bool)
    live = np.flatnonzero(now < _MAX)
    steps = np.array([d for d in range(1 - gram, gram) if d])
    while len(live):
        # All that are least among the runs they overlap, at once.
        least = np.ones(len(live), bool)
        for d in steps:
            other = now[np.clip(live + d, 0, len(now) - 1)]
            inside = (live + d >= 0) & (live + d < len(now))
            least &= ~inside | ((now[live] < other) if d < 0 else (now[live] <= other))
        chosen = live[least]
        picked[chosen] = True
        around = (chosen[:, None] + np.arange(1 - gram, gram)).ravel()
        now[around[(around >= 0) & (around < len(now))]] = _MAX
        live = live[now[live] < _MAX]
    return picked


def _gram(words_an_edit: int) -> int:
    """Words of a run, so that a line has threshold-plus-one disjoint ones."""
    if words_an_edit < 3:
        raise ValueError("words_an_edit must be 3 at least")
    return min(GRAM, max(1, (words_an_edit - 1) // 2))


def runs_of(words: np.ndarray, first: np.ndarray, last: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, first word and hash of all runs of lines words[first:last] of hashed words."""
    each = np.maximum(last - first - gram + 1, 0)
    at = V.ragged(first, each)
    return np.repeat(np.arange(len(first)), each), at, V.Rolling(words).spans(at, at + gram)


def word_keys(words: np.ndarray, first: np.ndarray, last: np.ndarray, words_an_edit: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line, key, place and whether it is one of the disjoint ones, of the runs that lines words[first:last] index. `common` has a class for each bucket of hashes."""
    gram, count = _gram(words_an_edit), last - first
    # The threshold of a line and the longest one it can be near.
    most = count // (words_an_edit - 1)
    first, last = np.where(most > 0, first, 0), np.where(most > 0, last, 0)
    line, at, h = runs_of(words, first, last, gram)
    content = (common[h >> _U(48)].astype(_U) << _U(44)) | (h >> _U(20))
    # Equal runs of a line go in the order of their hashed places.
    order = np.full(len(words), _MAX, _U)
    order[at] = (content << _U(16)) | (V.mix(at.astype(_U) + _U(1)) >> _U(48))
    picked = disjoint_runs(order, gram)[at]
    mine = np.flatnonzero(picked)
    mine = mine[np.lexsort((content[mine], line[mine]))]
    n = np.bincount(line[mine], minlength=len(first))
    enough = n > most
    limit = np.full(len(first), _MAX, _U)
    limit[enough] = content[mine[(np.cumsum(n) - n + most)[enough]]]
    inside = content <= limit[line]
    line, at, h, picked = line[inside], at[inside], h[inside], picked[inside]
    return line, V.mix(h ^ _U(0x5851F42D4C957F2D)), at - first[line], picked | ~enough[line]


class _Lines:
    """The lines of a chunk of texts that have a word, with their hashes."""

    def __init__(self, column):
        buf, offsets = V.text_buffer(column)
        self.start, self.end, row = V.lines_of(buf, offsets)
        number = np.arange(len(row)) - np.searchsorted(row, row, "left")
        words = V.Words(buf, offsets)
        first, last = np.searchsorted(words.start, self.start), np.searchsorted(words.start, self.end)
        full = last > first
        self.start, self.end, self.row, self.number, self.first, self.last = (x[full] for x in (self.start, self.end, row, number, first, last))
        self.buf, self.words, self.rolling = buf, words, V.Rolling(buf)
        before = V.code_points(buf)
        self.length = before[self.end] - before[self.start]

    def hash(self, which: int = 0) -> np.ndarray:
        return (V.Rolling(self.buf, which) if which else self.rolling).spans(self.start, self.end)

    def hashed_words(self) -> np.ndarray:
        return self.rolling.spans(self.words.start, self.words.end)

    def characters(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code points of some lines, and where each begins."""
        size = (self.end - self.start)[some]
        length = self.length[some]
        return points_of(self.buf[V.ragged(self.start[some], size)]), np.cumsum(length) - length


def _chunks(batches):
    for batch in batches:
        for part in V.chunks(batch, "_text"):
            yield part, _Lines(part.column("_text"))


def common_runs(counts: DataFrame) -> np.ndarray:
    """A class for each bucket of hashed runs of words (_bucket, _n): 0, or more the more often its runs occur. One row a bucket comes to the driver."""
    total = np.zeros(_BUCKETS, np.int64)
    for row in counts.groupBy("_bucket").agg(F.sum("_n").alias("_n")).collect():
        total[row["_bucket"]] = row["_n"]
    often = max(64.0, 4 * total.mean())
    return np.where(total > often, np.clip(np.floor(np.log2(np.maximum(total, 1) / often)) + 1, 1, 15), 0).astype(np.uint8)


def seeds(texts: DataFrame, max_edits: int, words_an_edit: int | None, common: np.ndarray | None) -> DataFrame:
    """_key, _h, _n (words; characters below 0), _at and _asks of what all lines index and probe; texts has _text."""
    shared = None if common is None else texts.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for _, lines in _chunks(batches):
            h, count = lines.hash(), lines.last - lines.first
            # Lines that the chunk has repeatedly are told once.
            once = np.zeros(len(h), bool)
            once[np.unique(h, return_index=True)[1]] = True
            once &= lines.length >= MIN_CHARS
            # An edit of one character changes two words at most, so word edits include it where two are allowed.
            chars = np.flatnonzero(once & (count // words_an_edit < 2 * max_edits) if words_an_edit else once)
            points, begin = lines.characters(chars)
            index, probes = join_keys(V.Rolling(points), begin, lines.length[chars], max_edits)
            found = []
            for keys, own in ((index, True), (probes, False)):
                who, which = np.nonzero(keys)
                found.append((chars[who], keys[who, which], np.zeros(len(who), np.int64), np.full(len(who), own), -lines.length[chars[who]]))
            if words_an_edit:
                by_words = np.flatnonzero(once)
                line, key, at, asks = word_keys(lines.hashed_words(), lines.first[by_words], lines.last[by_words], words_an_edit, shared.value)
                found.append((by_words[line], key, at, asks, count[by_words[line]]))
            line, key, at, asks, n = (np.concatenate(x) for x in zip(*found, strict=True))
            columns = [pa.array(key.view(np.int64)), pa.array(h[line].view(np.int64)), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(asks)]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "_h", "_n", "_at", "_asks"])

    return texts.mapInArrow(run, "_key long, _h long, _n int, _at int, _asks boolean")


def _fits(max_edits: int, words_an_edit: int | None):
    """Whether lines a and b under one key may be near by their lengths and places; those of character segments are in their keys."""
    by_words = F.floor(F.greatest("_na", "_nb") / words_an_edit) if words_an_edit else F.lit(0)
    most = F.when(F.col("_na") < 0, F.lit(max_edits)).otherwise(by_words)
    return (F.abs(F.col("_na") - F.col("_nb")) <= most) & ((F.col("_na") < 0) | (F.abs(F.col("_pa") - F.col("_pb")) <= most))


def _alike(max_edits: int, words_an_edit: int | None):
    """Whether the sketches of lines a and b, of _wa and _wb words, differ no more than edits can make them: a word's edit changes two bits, a character's four."""
    changed = F.bit_count(F.col("_ua").bitwiseXOR(F.col("_ub"))) + F.bit_count(F.col("_va").bitwiseXOR(F.col("_vb")))
    by_words = F.floor(F.greatest("_wa", "_wb") / words_an_edit) if words_an_edit else F.lit(0)
    return changed <= F.greatest(2 * by_words, F.lit(4 * max_edits))


def candidates(texts: DataFrame, lines: DataFrame, counts: DataFrame | None, max_edits: int, words_an_edit: int | None) -> tuple[DataFrame, DataFrame]:
    """Pairs _a, _b to compare, and the lines of the keys that more than BUCKET share, with all columns of `lines`, _n, _at, _size and whether it is the key's earliest (_leads)."""
    every = seeds(texts, max_edits, words_an_edit, common_runs(counts) if words_an_edit else None)
    # Most keys have one line. Counting is narrow and put together before the exchange, and the join with the rest can be split where a key is hot.
    twice = V.written(every.groupBy("_key").agg(F.count("*").alias("_k")).where("_k > 1").select("_key"), "twice")
    some = V.written(every.join(twice.hint("merge"), "_key", "left_semi").distinct(), "some")
    sizes = some.groupBy("_key").agg(F.count("*").alias("_size"), F.min("_h").alias("_a"), F.max("_h").alias("_b"), F.max("_asks").alias("_any")).where("_a <> _b AND _any")
    sizes = V.written(sizes.select("_key", "_size"), "sizes")
    fits = _fits(max_edits, words_an_edit)
    small = some.join(sizes.where(F.col("_size") <= BUCKET).select("_key"), "_key")
    side = lambda x: small.select("_key", F.col("_h").alias(f"_{x}"), F.col("_n").alias(f"_n{x}"), F.col("_at").alias(f"_p{x}"), F.col("_asks").alias(f"_q{x}"))
    pairs = side("a").join(side("b"), "_key").where((F.col("_a") < F.col("_b")) & (F.col("_qa") | F.col("_qb")) & fits).select("_a", "_b")
    hot = some.join(sizes.where(F.col("_size") > BUCKET), "_key").select("_key", "_h", "_n", "_at", "_size").distinct().join(lines, "_h")
    lead = F.min(F.struct("_first", "_h", "_n", "_at")).alias("_l")
    lead = V.written(hot.groupBy("_key").agg(lead).select("_key", F.col("_l._h").alias("_b"), F.col("_l._n").alias("_nb"), F.col("_l._at").alias("_pb")), "lead")
    hot = V.written(hot.join(lead, "_key").withColumn("_leads", F.col("_h") == F.col("_b")), "hot")
    stars = hot.where("NOT _leads").withColumns({"_na": F.col("_n"), "_pa": F.col("_at")}).where(fits).select(F.least("_h", "_b").alias("_a"), F.greatest("_h", "_b").alias("_b"))
    met = V.written(pairs.unionByName(stars).distinct(), "met")
    about = lambda x: lines.select(F.col("_h").alias(f"_{x}"), F.col("_words").alias(f"_w{x}"), F.col("_s").alias(f"_u{x}"), F.col("_s2").alias(f"_v{x}"))
    out = V.written(met.join(about("a"), "_a").join(about("b"), "_b").where(_alike(max_edits, words_an_edit)).select("_a", "_b").distinct(), "pairs")
    V.discard(twice, some, sizes, lead, met)
    return out, hot.drop("_b", "_nb", "_pb")


class _Stretches:
    """Texts of columns as stretches of symbols: hashed words, or characters."""

    def __init__(self, columns, by_words: bool):
        found = [V.text_buffer(c) for c in columns]
        buf = np.concatenate([b for b, _ in found])
        offsets = np.concatenate([[0], *(o[1:] + sum(len(b) for b, _ in found[:k]) for k, (_, o) in enumerate(found))])
        if by_words:
            words = V.Words(buf, offsets)
            self.symbols = V.Rolling(buf).spans(words.start, words.end)
            bounds = np.searchsorted(words.start, offsets)
        else:
            self.symbols = points_of(buf)
            bounds = V.code_points(buf)[offsets]
        self.first, self.count = bounds[:-1], np.diff(bounds)


def near_pairs(a, b, max_edits: int, words_an_edit: int | None) -> np.ndarray:
    """Whether the texts in each place of two columns are near."""
    n = len(a)
    out, left = np.zeros(n, bool), np.arange(n)
    if words_an_edit:
        words = _Stretches([a, b], True)
        most = np.maximum(words.count[:n], words.count[n:]) // words_an_edit
        some = np.flatnonzero(most)
        sketch = sketches(words.symbols, words.first, words.count)
        changed = np.bitwise_count(sketch[:n] ^ sketch[n:]).sum(1)
        out[some] = near_words(words.symbols, words.first[some], words.count[some], words.first[n + some], words.count[n + some], most[some], changed[some] // 2)
        left = np.flatnonzero(~out & (most < 2 * max_edits))
    if len(left):
        points, n = _Stretches([a.take(pa.array(left)), b.take(pa.array(left))], False), len(left)
        out[left] = within(points.symbols, points.first[:n], points.count[:n], points.first[n:], points.count[n:], max_edits)
    return out


def earlier_ones(table: pa.Table, max_edits: int, words_an_edit: int | None, skip: int, take: int | None, together: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the asking lines of a cell (_asks, _place, _n, _at, _words, _s, _s2, _wide; all of one key): rows of the line and of others with an earlier place that may be near it,
    from the earliest one on, `take` of them after the first `skip`; and whether there are more."""
    column = lambda name: table.column(name).to_numpy(zero_copy_only=False)
    asks, place, n, at, words = (column(c) for c in ("_asks", "_place", "_n", "_at", "_words"))
    sketch = np.stack([column("_s"), column("_s2")], 1)
    known = [v for v in table.column("_wide").to_pylist() if v is not None]
    wide = np.frombuffer(b"".join(known), _U).reshape(-1, _WIDE)
    wide_at = table.column("_wide").is_valid().to_numpy()
    wide_at = np.where(wide_at, np.cumsum(wide_at) - 1, -1)
    by_words = bool(len(n) and n[0] > 0)
    side = np.flatnonzero(~asks.astype(bool))
    side = side[np.argsort(place[side], kind="stable")]
    mine = np.flatnonzero(asks.astype(bool))
    step = max(1, together // max(1, len(side)))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    there, side_at, side_n, side_words = place[side], at[side], np.abs(n[side]), words[side]
    for low in range(0, len(mine), step):
        i = mine[low : low + step]
        mine_n = np.abs(n[i])[:, None]
        near = np.bitwise_count(sketch[i, 0][:, None] ^ sketch[side, 0]) + np.bitwise_count(sketch[i, 1][:, None] ^ sketch[side, 1])
        edits = 2 * (np.maximum(words[i][:, None], side_words) // words_an_edit) if words_an_edit else 0
        fits = near <= np.maximum(edits, 4 * max_edits)
        fits &= there < place[i][:, None]
        most = np.maximum(mine_n, side_n) // words_an_edit if by_words else max_edits
        fits &= np.abs(mine_n - side_n) <= most
        if by_words:
            fits &= np.abs(at[i][:, None] - side_at) <= most
        who, whom = np.nonzero(fits)
        both = np.flatnonzero((wide_at[i[who]] >= 0) & (wide_at[side[whom]] >= 0))
        if len(both):
            a, b = i[who[both]], side[whom[both]]
            changed = np.bitwise_count(wide[wide_at[a]] ^ wide[wide_at[b]]).sum(1, dtype=np.int64)
            edits = 2 * (np.maximum(words[a], words[b]) // words_an_edit) if words_an_edit else 0
            stays = np.ones(len(who), bool)
            stays[both] = changed <= np.maximum(edits, 4 * max_edits)
            who, whom = who[stays], whom[stays]
        a, b = i[who], side[whom]
        turn = np.arange(len(a)) - np.searchsorted(who, who, "left")
        here = (turn >= skip) & (turn < skip + take) if take else turn >= skip
        many = np.bincount(who, minlength=len(i))
        out.append((a[here], b[here], many[who[here]] > skip + take if take else np.zeros(int(here.sum()), bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def in_cells(hot: DataFrame, open_: DataFrame, max_edits: int, words_an_edit: int | None, skip: int, take: int | None) -> DataFrame:
    """Pairs _a, _b of open lines (_h, _h2) with earlier lines of a hot key, and _more: blocks of open lines meet blocks of all lines, by numbers of fixed size a line."""
    members = hot.join(open_.withColumn("_open", F.lit(True)), ["_h", "_h2"], "left").withColumn("_open", F.coalesce("_open", F.lit(False)) & ~F.col("_leads"))
    many = V.written(members.where("_open").groupBy("_key").agg(F.count("*").alias("_many")), "open")
    members = members.join(many, "_key")
    block = lambda n: F.pmod(F.xxhash64("_h", "_at"), n).cast("int")
    members = members.withColumn("_is", F.ceil(F.col("_many") / CELL).cast("int")).withColumn("_js", F.ceil(F.col("_size") / CELL).cast("int"))
    columns = ["_key", "_h", "_first", "_n", "_at", "_words", "_s", "_s2", "_wide"]
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = members.where("_open").select(*columns, F.lit(True).alias("_asks"), block(F.col("_is")).alias("_i"), others("_js").alias("_j"))
    asked = members.select(*columns, F.lit(False).alias("_asks"), block(F.col("_js")).alias("_j"), others("_is").alias("_i"))

    def compare(table: pa.Table) -> pa.Table:
        first = [tuple((v is not None, v) for v in f.values()) for f in table.column("_first").to_pylist()]
        order = {v: k for k, v in enumerate(sorted({*first}))}
        table = table.append_column("_place", pa.array([order[f] for f in first], pa.int64()))
        a, b, more = earlier_ones(table, max_edits, words_an_edit, skip, take)
        h = table.column("_h").to_numpy()
        return pa.table({"_a": h[a], "_b": h[b], "_more": more})

    return V.written(asking.unionByName(asked).groupBy("_key", "_i", "_j").applyInArrow(compare, "_a long, _b long, _more boolean"), "cells")


def occurrences(docs: DataFrame, id_col: str, text_col: str, words_an_edit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """id, _k (128 bits of id and text), line number, whether it is the text's first, characters, words, two hashes and the sketches of every line with a word;
    and, for word edits, how many runs of words fall into each bucket of hashes (_bucket, _n). Both are one table, written in one pass over the texts."""
    src = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), V.row_key(F.col(id_col), F.col(text_col)).alias("_k"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    names = ["_id", "_k", "_line", "_head", "_chars", "_words", "_h", "_h2", "_s", "_s2", "_wide", "_bucket", "_n"]

    def run(batches):
        runs, types = np.zeros(_BUCKETS, np.int64), None
        for part, lines in _chunks(batches):
            at = pa.array(lines.row)
            head = np.ones(len(lines.row), bool)
            head[1:] = lines.row[1:] != lines.row[:-1]
            count, words = lines.last - lines.first, lines.hashed_words()
            sketch = sketches(words, lines.first, count).view(np.int64)
            if words_an_edit:
                fits = count >= words_an_edit - 1
                _, _, h = runs_of(words, lines.first[fits], lines.last[fits], _gram(words_an_edit))
                runs += np.bincount((h >> _U(48)).astype(np.int64), minlength=_BUCKETS)
            numbers = [lines.number.astype(np.int32), head, lines.length.astype(np.int32), count.astype(np.int32), *(lines.hash(k).view(np.int64) for k in (0, 1)), *sketch.T]
            columns = [part.column("_id").take(at), part.column("_k").take(at), *map(pa.array, numbers), wide_sketches(words, lines.first, count)]
            types = [c.type for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.int64())], names=names)
        some = np.flatnonzero(runs)
        if len(some):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), t) for t in types), pa.array(some.astype(np.int32)), pa.array(runs[some])], names=names)

    types = f"_id {kind}, _k binary, _line int, _head boolean, _chars int, _words int, _h long, _h2 long, _s long, _s2 long, _wide binary, _bucket int, _n long"
    table = V.written(src.mapInArrow(run, types), "lines")
    return table.where("_bucket IS NULL").drop("_bucket", "_n"), table.where("_bucket IS NOT NULL").select("_bucket", "_n") if words_an_edit else None


def _line_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_h, _h2, _first and the text of the wanted lines, each cut out of its first occurrence's document."""
    asked = wanted.groupBy(F.col("_first._k").alias("_k")).agg(F.collect_list(F.struct("_h", "_h2", "_first")).alias("_asked"))
    src = docs.where(F.col(text_col).isNotNull()).select(V.row_key(F.col(id_col), F.col(text_col)).alias("_k"), F.col(text_col).alias("_text")).join(asked, "_k")
    lines = src.select(F.split("_text", "\n", -1).alias("_lines"), F.explode("_asked").alias("_a"))
    return lines.select("_a.*", F.element_at("_lines", F.col("_a._first._line") + 1).alias("_text")).dropDuplicates(["_h", "_h2"])


def duplicate_lines(docs: DataFrame, occ: DataFrame, counts: DataFrame | None, id_col: str, text_col: str, max_edits: int, words_an_edit: int | None = None) -> DataFrame:
    """_h, _h2, _first (the first occurrence) and _dup (an earlier line is near) of every different line."""
    first = F.min(F.struct("_id", "_k", "_line")).alias("_first")
    lines = V.written(occ.groupBy("_h", "_h2").agg(first, *(F.first(c).alias(c) for c in ("_words", "_s", "_s2", "_wide"))), "distinct")
    pairs, hot = candidates(docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("_text")), lines, counts, max_edits, words_an_edit)
    ends = lambda pairs: pairs.select(F.col("_a").alias("_h")).unionByName(pairs.select(F.col("_b").alias("_h")))
    # Two lines with one _h are told apart by _h2 and are both compared.
    texts = V.written(_line_texts(docs, lines.select("_h", "_h2", "_first").join(ends(pairs).unionByName(hot.select("_h")).distinct(), "_h"), id_col, text_col), "texts")

    def verify(batches):
        for batch in batches:
            for part in V.chunks(batch, "_ta", 4 << 20):
                near = near_pairs(part.column("_ta"), part.column("_tb"), max_edits, words_an_edit)
                yield part.select(["_h", "_h2"]).filter(pa.array(near))

    def verified(pairs: DataFrame) -> DataFrame:
        """_h, _h2 of the later line of each pair that is near."""
        side = lambda x: texts.select(F.col("_h").alias(f"_{x}"), F.col("_h2").alias(f"_{x}2"), F.col("_first").alias(f"_f{x}"), F.col("_text").alias(f"_t{x}"))
        later = lambda c: F.when(F.col("_fa") < F.col("_fb"), F.col(f"_b{c}")).otherwise(F.col(f"_a{c}"))
        met = pairs.select("_a", "_b").distinct().join(side("a"), "_a").join(side("b"), "_b").select(later("").alias("_h"), later("2").alias("_h2"), "_ta", "_tb")
        return V.written(met.mapInArrow(verify, "_h long, _h2 long").distinct(), "near")

    found = [verified(pairs)]
    members = hot.where("NOT _leads").select("_h", "_h2").distinct()
    cells = in_cells(hot, members.join(found[0], ["_h", "_h2"], "left_anti"), max_edits, words_an_edit, 0, FEW)
    found.append(verified(cells))
    left = members.join(cells.where("_more").select(F.col("_a").alias("_h")).distinct(), "_h", "left_semi").join(found[1], ["_h", "_h2"], "left_anti")
    if not left.isEmpty():
        rest = in_cells(hot, left, max_edits, words_an_edit, FEW, None)
        found.append(verified(rest))
        V.discard(rest)
    dup = found[0]
    for more in found[1:]:
        dup = dup.unionByName(more)
    dup = dup.distinct().withColumn("_dup", F.lit(True))
    out = V.written(lines.select("_h", "_h2", "_first").join(dup, ["_h", "_h2"], "left").withColumn("_dup", F.coalesce("_dup", F.lit(False))), "judged")
    V.discard(lines, pairs, hot, texts, cells, *found)
    return out


def _judged(docs: DataFrame, id_col: str, text_col: str, max_edits: int, words_an_edit: int | None) -> DataFrame:
    """_k, _line, _head, _chars, _near and _gone of every line with a word."""
    V.tune(docs.sparkSession)
    occ, counts = occurrences(docs, id_col, text_col, words_an_edit)
    lines = duplicate_lines(docs, occ, counts, id_col, text_col, max_edits, words_an_edit)
    gone = F.col("_dup") | ~F.struct("_id", "_k", "_line").eqNullSafe(F.col("_first"))
    return occ.join(lines, ["_h", "_h2"]).select("_k", "_line", "_head", "_chars", F.col("_dup").alias("_near"), gone.alias("_gone"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, words_an_edit: int | None = None) -> DataFrame:
    """One row a document: id, n_lines (with a word), n_dup_lines (that go), n_near_lines (of these, near another line) and removed_chars."""
    judged = _judged(docs, id_col, text_col, max_edits, words_an_edit)
    # Rows equal in id and text are judged alike: the sums are theirs together, and there are as many of them as first lines.
    count = lambda c: F.sum(F.col(c).cast("long"))
    sums = {"n_lines": F.count("*"), "n_dup_lines": count("_gone"), "n_near_lines": count("_near"), "removed_chars": F.sum(F.col("_gone").cast("long") * F.col("_chars"))}
    per = judged.groupBy(F.col("_k").alias("_dk")).agg(count("_head").alias("_rows"), *(c.alias(name) for name, c in sums.items()))
    rows = docs.select(F.col(id_col).alias("_id"), V.row_key(F.col(id_col), F.col(text_col)).alias("_k"), F.col(text_col).isNull().alias("_none"))
    out = rows.join(per, (F.col("_k") == F.col("_dk")) & ~F.col("_none"), "left")
    return out.select(F.col("_id").alias(id_col), *(F.coalesce(F.col(c) / F.col("_rows"), F.lit(0)).cast("long").alias(c) for c in sums))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, words_an_edit: int | None = None) -> DataFrame:
    """The documents without their duplicate lines, with all their columns; a document that loses all its lines stays, with what is left."""
    gone = _judged(docs, id_col, text_col, max_edits, words_an_edit).where("_gone").groupBy(F.col("_k").alias("_dk")).agg(F.collect_set(F.col("_line") + 1).alias("_lines"))
    # The row travels as one value, so that no column of it can clash.
    marked = docs.select(F.struct("*").alias("_row"), V.row_key(F.col(id_col), F.col(text_col)).alias("_k"), F.col(text_col).alias("_text"))
    joined = marked.join(gone, (F.col("_k") == F.col("_dk")) & F.col("_text").isNotNull(), "left")
    lines = F.split("_text", "\n", -1)
    kept = F.transform(F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("x"))), lambda p: ~F.array_contains("_lines", p["n"])), lambda p: p["x"])
    text = F.when(F.col("_lines").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*(text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns))
