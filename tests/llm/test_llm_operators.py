"""Each corpus operator against a plain version, over rows with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import graph, language, linedup, mixing, neardup, packing, quality, shards, suffix, tokens, topk
from kindred.llm import _vec as V

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ["_id", "_text", "_k", "_digest", "_n", "_lines", "_row", "_crc", "_source", "_times", "size", "score", "kept", "slot", "_h"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(rng.randrange(8, 14))) + "." for _ in range(n))
    base = [prose(6) for _ in range(12)]
    shared = prose(4)
    long = prose(900)
    swap = lambda t, n: " ".join("changed" if i % (len(t.split(" ")) // n + 1) == 7 else w for i, w in enumerate(t.split(" ")))
    out = [*base, base[0], base[0], swap(base[1], 1), swap(base[2], 1), base[3] + " tail", base[4].upper(), long, long + "\nand more", None, None, "", "", " \n\t ", "\x1c ", "one", "one", "two words"]
    out += [prose(3) + "\n" + shared + "\n" + prose(2) for _ in range(5)]
    out += ["abc def ghi " * 60, "x" * 500, "ab" * 300, "é" * 250 + " ñandú çà", "spam spam spam\n" * 30, "#$% & | <> " * 40, "a" * 199, "b" * 200 + "c" + "b" * 200]
    lines = base[5].split("\n")
    out += ["\n".join([lines[0][:-2] + "x.", lines[1], lines[2][:10] + lines[2][11:], "new line of " + word()]), "\n".join(lines[::-1]), "\n\n" + lines[0] + "\n\n"]
    out += [f"This is line number {i:04d} of the very same counter." for i in range(80)]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en" if i % 3 else "fr", None if i % 11 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts())]
    out += [out[0], out[13], out[22], (None, "a row without id, of a few words only", None, "s1", 0), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *(F.lit(f"clash {c}").alias(c) for c in CLASHING)).repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


# ---- primitives


def test_words_lines_and_hashes():
    texts_ = ["a bc\n\nd", "", "é\x0bñ x", None, "\n"]
    buf, offsets = V.text_buffer(pa.array(texts_))
    words = V.Words(buf, offsets)
    got = [bytes(buf[a:b]).decode() for a, b in zip(words.start, words.end, strict=True)]
    assert got == [w for t in texts_ for w in WORD.findall(t or "")]
    assert words.row.tolist() == [i for i, t in enumerate(texts_) for _ in WORD.findall(t or "")]
    start, end, row = V.lines_of(buf, offsets)
    assert [(int(r), bytes(buf[a:b]).decode()) for a, b, r in zip(start, end, row, strict=True)] == [(i, x) for i, t in enumerate(texts_) for x in (t or "").split("\n")]
    rolling = V.Rolling(np.frombuffer(b"abcabcab", np.uint8))
    h = rolling.spans(np.array([0, 3, 1, 0]), np.array([3, 6, 4, 2]))
    assert h[0] == h[1] and len({*h.tolist()}) == 3


def test_chunks_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["abcd", None, "", "x" * 50, "yz"])], names=["t"])
    parts = list(V.chunks(batch, "t", 8))
    assert [x for p in parts for x in p.column("t").to_pylist()] == batch.column("t").to_pylist() and len(parts) > 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for x in {x for e in edges for x in e}:
        assert got.get(x, x) == find(x)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 1 language


def test_language(spark, sf_dir, docs, none):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language.fit(table, ~held)
    out = language.predict(table, model).join(table.select("doc_id", "lang", held.alias("held")), "doc_id").where("held").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.95 and out["score"].between(0, 1).all()
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    assert odd[20] == ("und", 0.0) and odd[24] == ("und", 0.0) and odd[28][0] != "und"
    assert language.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(none, F.lit(True))).collect()} == {"und"}


def test_language_bound_and_reruns(spark, docs):
    a, b = (language.fit(docs, F.lit(True), sample_rows=10) for _ in range(2))
    assert a.languages == ["en", "fr"] and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(500, 3))
    p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert 3.5 < language.fit_temperature(scores * 5, labels) < 7


def test_scores_of_a_separable_hold_out_say_its_size():
    for n in (40, 400):
        labels = np.arange(n) % 3
        scores = 9.0 * np.eye(3)[labels]
        p = np.exp(scores / language.fit_temperature(scores, labels))
        p = (p.max(1) / p.sum(1)).mean()
        assert abs(p - (1 - 1 / (n + 2))) < 1e-3


# ---- 2 tokens


def greedy(word, inner, final, longest):
    at = n = 0
    while at < len(word):
        to = next(b for b in range(min(len(word), at + longest), at, -1) if b == at + 1 or word[at:b] in inner or (b == len(word) and word[at:b] in final))
        at, n = to, n + 1
    return n


def test_automaton_equals_longest_match():
    rng = random.Random(5)
    piece = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6)))
    for _ in range(20):
        inner, final = [piece() for _ in range(15)], [piece() for _ in range(8)]
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 14))) for _ in range(100)]
        buf = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words])
        got = tokens.Automaton(inner, final).count(buf, end - [len(w) for w in words], end)
        assert got.tolist() == [greedy(w, {*inner}, {*final}, 5) for w in words]


@pytest.fixture(scope="module")
def vocabulary():
    from kindred.llm import queries

    try:
        with open(queries._vocabulary(), encoding="utf-8"):
            return queries._vocabulary()
    except OSError:
        pytest.skip("no vocabulary")


def test_token_counts(docs, none, rows, vocabulary):
    inner, final = tokens.read_vocabulary(vocabulary)
    longest = max(map(len, inner + final))
    inner, final = {*inner}, {*final}
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in tokens.count_tokens(docs, vocabulary).collect())
    split = [(i, WORD.findall((t or "").lower())) for i, t, *_ in rows]
    assert got == sorted((str(i), len(w), sum(greedy(x.encode(), inner, final, longest) for x in w)) for i, w in split)
    assert tokens.count_tokens(none, vocabulary).count() == 0


# ---- 3 packing


def test_schedule_fills_windows_to_target():
    totals, weights = np.array([50_000, 9_000, 700, 3]), np.array([3.0, 2.0, 1.0, 1.0])
    for w in (weights, None):
        phases = packing.schedule(totals, w, window=256, cycle=8)
        taken = np.zeros(4, np.int64)
        sizes = []
        for p in phases:
            assert np.array_equal(p.start, taken) and p.first == len(sizes)
            for _ in range(p.repeats):
                steps = np.diff(p.table, axis=0)
                assert (steps >= 0).all()
                sizes += steps.sum(1).tolist()
                taken = taken + p.table[-1]
        assert np.array_equal(taken, totals)
        full = sizes.index(next(s for s in sizes if s < 256)) if min(sizes) < 256 else len(sizes)
        assert all(s == 256 for s in sizes[:full]) and all(s & (s - 1) == 0 for s in sizes[full:])
    first = packing.schedule(np.array([50_000, 20_000, 9_000]), np.array([3.0, 2.0, 2.0]), 256, 8)[0]
    assert first.repeats > 10 and np.abs(np.diff(first.table, axis=0) - 256 * np.array([3, 2, 2]) / 7).max() <= 2


def test_packing_round_trip(docs, none, rows, vocabulary):
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as f:
        file = f.read()
    tokenizer = Tokenizer.from_str(file)
    want = collections.Counter()
    for i, t, *_ in rows:
        want[(i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,))] += 1
    for weights in (None, {"s0": 3, "s1": 1, "s2": 1, "s3": 0, None: 1}):
        got = packing.pack(docs, file, 2, weights=weights, window=128, with_ids=True).collect()
        by_sequence = collections.defaultdict(list)
        for r in got:
            assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert sorted(by_sequence) == list(range(len(by_sequence)))
        for spans in by_sequence.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at == 128 or at & (at - 1) == 0
        # Copies of a row can't be told apart, so pieces are put together by place.
        have = collections.Counter()
        pieces = collections.defaultdict(list)
        for r in got:
            pieces[(r["doc_id"], r["doc_tokens"])].append((r["start"], tuple(r["ids"])))
        for (i, n), spans in pieces.items():
            open_ = []
            for start, ids in sorted(spans):
                if start == 0:
                    open_.append(ids)
                else:
                    k = next(k for k, x in enumerate(open_) if len(x) == start)
                    open_[k] += ids
            assert all(len(x) == n for x in open_)
            for x in open_:
                have[(i, x)] += 1
        assert have == want
    assert packing.pack(none, file, 2).count() == 0


def test_encoder_with_odd_words(vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as f:
        file = f.read()
    odd = ["a\x01b c", "<|endoftext|> x<|startoftext|>y", "ΑΣ Σ é é ́", "\x85a b", "a's don't 12ab", "", " "]
    whole = Tokenizer.from_str(file)
    for limit in (2_000_000, 3):
        monkeypatch.setattr(packing, "CACHE_WORDS", limit)
        encoder = packing.WordEncoder(file)
        for _ in range(2):
            flat, n = encoder.encode(*V.text_buffer(pa.array(odd)))
            assert flat.tolist() == [i for t in odd for i in whole.encode(t, add_special_tokens=False).ids] and n.sum() == len(flat)


# ---- 4 lines


def apart(a, b):
    """No more than twice the edits: each changes the counts of two symbols at most."""
    x, y = collections.Counter(a), collections.Counter(b)
    return sum(((x - y) + (y - x)).values())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_banded_distance():
    rng = random.Random(2)
    for most in (1, 2, 3):
        a = [[rng.randrange(3) for _ in range(rng.randrange(14))] for _ in range(800)]
        b = []
        for x in a:
            y = list(x)
            for _ in range(rng.randrange(5)):
                i = rng.randrange(len(y) + 1)
                y[i : i + rng.randrange(2)] = [rng.randrange(3)] * rng.randrange(2)
            b.append(y)
        points = np.array([p for x in a + b for p in x] + [0], np.uint32)
        length = np.array([len(x) for x in a + b])
        start = np.cumsum(length) - length
        got = linedup.within(points, start[:800], length[:800], start[800:], length[800:], most)
        assert got.tolist() == [edits(x, y) <= most for x, y in zip(a, b, strict=True)]


@functools.cache
def plain_lines_of(rows, most):
    found = collections.defaultdict(lambda: (2, 0))
    occurrences = []
    for i, t, *_ in {(r[0], r[1]) for r in rows if r[1] is not None}:
        for n, line in enumerate(t.split("\n")):
            if WORD.search(line):
                occurrences.append((i, t, n, line))
    key = lambda o: (o[0] is not None, o[0] if o[0] is not None else 0, o[2])
    first = {}
    for o in sorted(occurrences, key=key):
        first.setdefault(o[3], key(o))
    lines = sorted((x for x in first if len(x) >= linedup.MIN_CHARS), key=lambda x: first[x])
    near = {b for i, b in enumerate(lines) for a in lines[:i] if abs(len(a) - len(b)) <= most and apart(a, b) <= 2 * most and edits(a, b) <= most}
    return {(i, t, n): key((i, t, n)) != first[line] or line in near for i, t, n, line in occurrences}


def plain_lines(rows, most):
    return plain_lines_of(tuple(rows), most)


@pytest.mark.parametrize(("most", "bucket"), [(1, 64), (1, 2), (2, 64)])
def test_line_dedup(docs, rows, monkeypatch, most, bucket):
    monkeypatch.setattr(linedup, "BUCKET", bucket)
    gone = plain_lines(rows, most)
    want = [(str(i), None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not gone.get((i, t, n)))) for i, t, *_ in rows]
    out = linedup.without_duplicates(docs, max_edits=most)
    assert out.columns == docs.columns
    key = lambda p: (p[0], p[1] or "")
    assert sorted(((str(r["doc_id"]), r["text"]) for r in out.collect()), key=key) == sorted(want, key=key)
    assert out.where("_k = 'clash _k' AND _lines = 'clash _lines'").count() == len(rows)


def test_line_report(docs, none, rows):
    gone = plain_lines(rows, 1)
    want = collections.Counter()
    for i, t, *_ in rows:
        mine = [v for (j, u, _), v in gone.items() if (j, u) == (i, t)]
        want[(i, len(mine), sum(mine))] += 1
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dup_lines"]) for r in linedup.line_report(docs).collect()) == want
    assert linedup.line_report(none).count() == 0 and linedup.without_duplicates(none).count() == 0


def plain_word_lines(rows, most):
    """plain_lines with the lines that are a tenth of their words apart."""
    gone = plain_lines(rows, most)
    key = lambda o: (o[0] is not None, o[0] if o[0] is not None else 0, o[2])
    first = {}
    for i, t, n in sorted(gone, key=key):
        first.setdefault(t.split("\n")[n], key((i, t, n)))
    lines = [(x, WORD.findall(x)) for x in sorted((x for x in first if len(x) >= linedup.MIN_CHARS), key=first.__getitem__)]
    allowed = lambda v, w: max(len(v), len(w)) // 10
    near = {y for k, (y, w) in enumerate(lines) for _, v in lines[:k] if abs(len(v) - len(w)) <= allowed(v, w) and apart(v, w) <= 2 * allowed(v, w) and edits(v, w) <= allowed(v, w)}
    return {(i, t, n): g or t.split("\n")[n] in near for (i, t, n), g in gone.items()}


@pytest.fixture(scope="module")
def word_rows(rows):
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    lines = []
    for size in (9, 10, 12, 19, 20, 21, 35, 39, 40, 41, 60, 95):
        line = some(size)
        for times in range(size // 10 + 2):
            other = list(line)
            for at in sorted(rng.sample(range(size), times + 1)):
                other[at : at + rng.randrange(2)] = some(rng.randrange(2))
            lines += [line, other]
    # Near copies of one line, and one passage in lines that have nothing else in common.
    line, passage = some(45), some(12)
    for _ in range(30):
        other = list(line)
        for at in rng.sample(range(45), rng.randrange(1, 5)):
            other[at] = f"w{rng.randrange(5000)}"
        lines += [other, some(rng.randrange(2, 30)) + passage + some(rng.randrange(2, 30)), ["the"] * rng.randrange(10, 80)]
    rng.shuffle(lines)
    return rows + [(1000 + i, " ".join(x), "en", "s1", 0) for i, x in enumerate(lines)]


@pytest.mark.parametrize(("bucket", "cell"), [(64, 2048), (4, 5)])
def test_line_dedup_by_words(spark, word_rows, monkeypatch, bucket, cell):
    monkeypatch.setattr(linedup, "BUCKET", bucket)
    monkeypatch.setattr(linedup, "CELL", cell)
    gone = plain_word_lines(word_rows, 1)
    assert sum(gone.values()) > sum(plain_lines(word_rows, 1).values()) + 50
    want = [(str(i), None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not gone.get((i, t, n)))) for i, t, *_ in word_rows]
    out = linedup.without_duplicates(spark.createDataFrame(word_rows, SCHEMA).repartition(5), words_an_edit=10)
    key = lambda p: (p[0], p[1] or "")
    assert sorted(((str(r["doc_id"]), r["text"]) for r in out.collect()), key=key) == sorted(want, key=key)


def test_wide_sketches_tell_long_lines_apart():
    rng = np.random.default_rng(4)
    some = lambda n: rng.integers(1, 2**63, n).astype(np.uint64)
    passage, lines = some(300), []
    for size in (100, 300, 1200):
        line = some(size)
        other = line.copy()
        other[rng.permutation(size)[: size // 10]] = some(size // 10)
        lines += [line, other, np.concatenate([some(size // 2), passage, some(size // 2)]), np.concatenate([some(size // 2), passage, some(size // 2)])]
    count = np.array([len(x) for x in lines])
    wide = linedup.wide_sketches(np.concatenate(lines), np.cumsum(count) - count, count).to_pylist()
    assert [w is None for w in wide] == [n < linedup.WIDE_FROM for n in count]
    changed = lambda a, b: int(np.bitwise_count(np.frombuffer(wide[a], np.uint64) ^ np.frombuffer(wide[b], np.uint64)).sum())
    for k, size in ((4, 300), (8, 1200)):
        assert changed(k, k + 1) <= 2 * (size // 10) and changed(k + 2, k + 3) > 2 * (count[k + 2] // 10)


def test_line_dedup_of_long_lines(spark, monkeypatch):
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    passage, out = some(40), []
    for size in (90, 100, 135, 150, 260, 330):
        line = some(size) + passage
        for times in (0, 3, len(line) // 10, len(line) // 10 + 1):
            other = list(line)
            for at in rng.sample(range(size), times):
                other[at] = f"w{rng.randrange(9000)}"
            out += [other, some(size - times) + passage]
    long = [(i, " ".join(x)) for i, x in enumerate(out)]
    monkeypatch.setattr(linedup, "BUCKET", 4)
    monkeypatch.setattr(linedup, "CELL", 8)
    docs = spark.createDataFrame(long, "doc_id long, text string")
    want = {i: g for (i, _, _), g in plain_word_lines(long, 1).items()}
    got = {r["doc_id"]: r["n_dup_lines"] == 1 for r in linedup.line_report(docs, words_an_edit=10).collect()}
    assert got == want and 10 < sum(want.values()) < len(long) - 10


def test_op4_query_takes_changed_words(spark, tmp_path):
    from kindred.llm import queries

    line = [f"word{i}" for i in range(12)]
    spark.createDataFrame([(1, " ".join(line)), (2, " ".join([*line[:5], "another", *line[6:]]))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_near_lines"] for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}


# ---- 5 top-k


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(90)]
    vectors += [(200 + i, vectors[i][1]) for i in range(10)] + [vectors[20], vectors[21]]
    bad = [(300, None), (320, [None] + [1.0] * 5), (340, [float("nan")] * 6), (360, [float("inf")] * 6), (380, [1.0]), (381, [])]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("_id"), F.lit(2).alias("score"))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).select("query_id", "rank", "vec_id", "score").collect())
    whole = [(i, np.floor(64 * np.array(v, np.float32).astype(np.float64))) for i, v in vectors]
    want = []
    for i in sorted({i for i, _ in whole if i % 20 == 0}):
        q = next(v for j, v in whole if j == i)
        best = sorted((-int(q @ v), j) for j, v in whole if j != i)[:20]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    few = df.where("vec_id < 5")
    assert topk.top_k(few, F.col("vec_id") % 20 == 0, 20).count() == 4
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0


def test_pivot_bounds_leave_out_what_cannot_matter():
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, size=(8, 8))
    x = (centres[rng.integers(0, 8, 4000)] + rng.integers(-9, 9, size=(4000, 8))).astype(float)
    ids = np.arange(4000)
    pivots = topk.pick_pivots(x[:500], 24)
    out, evaluated = topk.search_block(ids[:40], x[:40], ids, x, pivots, 5, step=64)
    assert evaluated < 0.5 * 40 * 4000
    for i, (_, got, _) in enumerate(out):
        s = x @ x[i]
        s[i] = -np.inf
        assert got.tolist() == np.lexsort((ids, -s))[:5].tolist()


# ---- 6 quality


def plain_quality(t):
    words = WORD.findall(t or "")
    seen, dup_lines = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup_lines += line in seen
            seen.add(line)

    def covered(n):
        at = collections.defaultdict(list)
        for i in range(len(words) - n + 1):
            at[tuple(words[i : i + n])].append(i)
        return {i + k for v in at.values() if len(v) > 1 for i in v for k in range(n)}

    chars = [sum(len(words[i]) for i in covered(n)) for n, _ in quality.NGRAM_LIMITS]
    return len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), dup_lines, len(covered(3)), chars


def test_quality(docs, none, rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ngram_chars")
    got = quality.profile(docs).collect()
    key = lambda p: (str(p[0]), p[1])
    assert sorted(((r["doc_id"], tuple(r[c] for c in names)) for r in got), key=key) == sorted(((i, plain_quality(t)) for i, t, *_ in rows), key=key)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got) > 0
    assert quality.profile(none).count() == 0 and quality.keep(none).count() == 0


# ---- 7 shards


def test_sharding(docs, none, rows, spark, tmp_path):
    out, final = shards.shard(docs, 4, n_slots=256, store=str(tmp_path / "map"))
    got = out.collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    loads = [0] * 4
    for r in got:
        loads[r["shard"]] += r["size"]
        assert final.shards[r["vslot"]] == r["shard"]
    for s in range(4):
        places = sorted(r["slot"] for r in got if r["shard"] == s)
        assert places == list(range(len(places)))
    slots = collections.Counter()
    for r in got:
        slots[r["vslot"]] += r["size"]
    assert max(loads) - min(loads) <= max(slots.values())
    again = shards.SlotMap.load(spark, str(tmp_path / "map"))
    assert (again.shards, again.version) == (final.shards, 2) and shards.SlotMap.load(spark, str(tmp_path / "map"), 1).version == 1
    assert shards.shard(none, 4)[0].count() == 0


def test_equal_texts_share_a_shard(docs, rows, spark, monkeypatch):
    out, final = shards.shard(docs, 4, n_slots=256)
    total = sum(len((t or "").encode()) + 1 for _, t, *_ in rows)
    held, places, copies = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for r in out.collect():
        key = (r["text_crc32"], r["size"])
        held[key] += r["size"]
        copies[key] += 1
        places[key].add(r["shard"])
    large = [k for k in held if copies[k] > 1 and held[k] > total / 16]
    assert len(final.dealt) == len(large) and all(len(places[k]) == 1 for k in held if k not in large) and max(copies.values()) > 2
    # A group with a third of the rows is dealt out, for its bytes or for its rows alone, and stays so in later versions.
    many = spark.createDataFrame([(i, "the same text" if i % 3 == 0 else f"text {i} " * 3) for i in range(600)], "doc_id long, text string")
    out, final = shards.shard(many, 4, n_slots=256)
    assert len(final.dealt) == 1 and {r["shard"] for r in out.where("text_crc32 = crc32('the same text')").collect()} == {0, 1, 2, 3}
    again, later = shards.shard(docs, 4, n_slots=256, at=final)
    assert set(final.dealt) <= set(later.dealt) and again.count() == len(rows)
    monkeypatch.setattr(shards, "DEALT_ROWS", 100)
    short = spark.createDataFrame([(i, None if i % 3 == 0 else f"text {i} " * 300) for i in range(600)], "doc_id long, text string")
    out, final = shards.shard(short, 4, n_slots=256)
    assert len(final.dealt) == 1 and out.where("size = 1").select("vslot").distinct().count() > 50


def test_slot_map_edits():
    rng = random.Random(9)
    sizes = [rng.randrange(1, 1000) for _ in range(512)]
    first = shards.SlotMap.even(512, 8)
    even = first.rebalanced(sizes)
    load = lambda m, n: [sum(z for z, s in zip(sizes, m.shards, strict=True) if s == k) for k in range(n)]
    assert max(load(even, 8)) - min(load(even, 8)) <= 5 and even.version == 2
    assert all(first.shards[slot] == a and even.shards[slot] == b for slot, a, b in even.edits)
    grown = even.grown(sizes)
    assert all(b == 8 for a, b in zip(even.shards, grown.shards, strict=True) if a != b) and max(load(grown, 9)) <= 1.1 * sum(sizes) / 9


# ---- 8 mixing


def test_targets_share_out_the_excess():
    got = mixing.source_targets({"a": 1, "b": 1000, None: 500})
    assert got["a"] <= 3 and abs(sum(got.values()) - 1501) < 1e-6 and list(sorted(got.values()))[-1] <= 1500
    assert mixing.source_targets({"a": 0}) == {"a": 0.0} and mixing.source_targets({}) == {}


def test_flight_keeps_totals():
    rng = random.Random(1)
    size = [rng.randrange(1, 500) for _ in range(300)]
    p = [0.37] * 300
    held = mixing.fly(size, p, rng)
    assert len(held) <= 2 and abs(sum(p) - 111) < 1e-6 and abs(sum(s * x for s, x in zip(size, p, strict=True)) - 0.37 * sum(size)) < 1e-3
    mixing.land(size, p, held)
    assert {*p} <= {0.0, 1.0} and abs(sum(p) - 111) <= 1 and abs(sum(s * x for s, x in zip(size, p, strict=True)) - 0.37 * sum(size)) <= 5
    many = [mixing.fly([1, 2, 3, 4, 5, 6], q, random.Random(s)) and q or q for s, q in ((s, [0.5] * 6) for s in range(400))]
    assert all(0.4 < sum(q[k] for q in many) / 400 < 0.6 for k in range(6))


@pytest.mark.parametrize("block_rows", [4096, 8])
def test_mixing(docs, none, rows, block_rows):
    got = [tuple(r) for r in mixing.mix(docs, block_rows=block_rows).select("doc_id", "size", "mix_source", "source_size", "target", "times", "taken").collect()]
    again = [tuple(r) for r in mixing.mix(docs.repartition(2), block_rows=block_rows).select("doc_id", "size", "mix_source", "source_size", "target", "times", "taken").collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets = mixing.source_targets(dict(sizes))
    assert collections.Counter((i, n) for i, n, *_ in got) == collections.Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    for s, size in sizes.items():
        mine = [g for g in got if g[2] == s]
        assert all(g[3] == size and abs(g[4] - targets[s]) < 1e-6 and g[6] == g[5] * g[1] <= 3 * g[1] for g in mine)
        # No nearer than half the largest document, where nothing of its size can make up for it.
        assert abs(sum(g[6] for g in mine) - targets[s]) <= max(g[1] for g in mine) / 2 + (5 if block_rows == 4096 else 200)
    out = mixing.mixed(docs, block_rows=block_rows)
    assert out.columns == docs.columns and out.count() == sum(g[5] for g in got)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


# ---- 9 near-duplicates


def shingles(t):
    words = WORD.findall(t.lower().translate({ord(c): None for c in neardup.PUNCTUATION}))
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def plain_classes(rows):
    known = [(r[0], r[1]) for r in rows if r[1] is not None]
    sets = [shingles(t) for _, t in known]
    parent = list(range(len(known)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(known)):
        for j in range(i):
            if known[i][1] == known[j][1] or (sets[i] and jaccard(sets[i], sets[j]) >= 0.8):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = collections.defaultdict(set)
    for i, k in enumerate(known):
        groups[find(i)].add(k)
    return groups.values()


@pytest.mark.parametrize(("bucket", "cell"), [(16, (64, 512)), (2, (2, 3))])
def test_near_duplicates(docs, none, rows, monkeypatch, bucket, cell):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", bucket)
    monkeypatch.setattr(neardup, "CELL", cell)
    got = neardup.classes(docs).collect()
    want = {}
    for group in plain_classes(rows):
        ids = [i for i, _ in group if i is not None]
        for k in group:
            want[k] = (min(ids) if ids else None, sum((r[0], r[1]) in group for r in rows))
    by = collections.Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got)
    assert by == collections.Counter((r[0], *want.get((r[0], r[1]), (r[0], 1))) for r in rows)
    out = neardup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(plain_classes(rows)) + sum(r[1] is None for r in rows)
    assert neardup.classes(none).count() == 0 and neardup.deduplicated(none).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    a = " ".join(rng.choice(words) for _ in range(400))
    pieces = a.split()
    b = " ".join(w if rng.random() > 0.03 else "other" for w in pieces)
    buf, offsets = V.text_buffer(pa.array([a, b, "", "one two"]))
    signature, some = neardup.signatures(*neardup.units(buf, offsets), 4, k=1024)
    assert some.tolist() == [True, True, False, True]
    true = jaccard(shingles(a), shingles(b))
    assert abs((signature[0] == signature[1]).mean() - true) < 0.06
    assert abs(neardup.similarities(pa.array([a]), pa.array([b]))[0] - true) < 1e-9


# ---- 10 repeats


def plain_repeats(rows, width):
    raw = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for (doc, *_), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(doc), len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("width", "pieces"), [(200, 1024), (60, 1024), (60, 2)])
def test_repeats(docs, none, rows, monkeypatch, width, pieces):
    monkeypatch.setattr(suffix, "SHARD_PIECES", pieces)
    monkeypatch.setattr(suffix, "RANGE_WINDOWS", 500)
    if pieces == 2:
        monkeypatch.setattr(suffix, "SHARD_BYTES", 2000)
    got = suffix.remove_repeats(docs, width=width).collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == plain_repeats(rows, width)
    assert suffix.remove_repeats(none).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(8)
    for text in (rng.integers(97, 100, 300), np.full(100, 97), np.tile([97, 98], 80)):
        text = text.astype(np.uint8)
        raw = text.tobytes()
        order = suffix.suffix_array(text)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        shared = suffix.common_prefixes(text, order, 64, stretch=16)
        for k in range(1, len(raw)):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(n, 64)


def test_bisection_across_shards():
    shard = np.array([0, 0, 1, 1, 2])
    same = np.zeros(5, np.int64)
    assert suffix.found_elsewhere(shard, np.array([5, 7, 7, 9, 3]), same).tolist() == [False, True, True, False, False]
    assert not suffix.found_elsewhere(shard, np.array([5, 7, 7, 9, 3]), np.arange(5)).any()


# ---- pipeline


def test_pipeline(spark, sf_dir, vocabulary):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = []
    for name, stage in pipeline.STAGES[:-1]:
        out = V.written(stage(spark, docs, sf_dir), f"test-{name}")
        assert out.dtypes == docs.dtypes
        counts.append((docs.count(), out.count()))
        docs = out
    assert counts[0][1] < counts[0][0] and counts[1][1] == counts[1][0] and counts[2][1] <= counts[2][0]
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
