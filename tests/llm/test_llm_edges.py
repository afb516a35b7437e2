"""What single operators got wrong or left open: hashes of like texts, large numbers, repeated rows, hot keys, and the pipeline on odd rows."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import CLASHING, SCHEMA, edits, plain_classes, plain_repeats, plain_word_lines, texts

from kindred.llm import _vec as V
from kindred.llm import language, linedup, mixing, neardup, packing, quality, queries, suffix, topk

#: Two words of 1024 bytes that share their hash in every polynomial modulo 2**64.
MORSE = tuple("".join("ab"[(i.bit_count() + flip) % 2] for i in range(1024)) for flip in (0, 1))


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


# ---- hashes


def test_arithmetic_modulo_the_prime():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, V.PRIME, 1000).astype(np.uint64) for _ in range(2))
    a[:3] = b[:3] = [0, 1, V.PRIME - 1]
    assert V.times(a, b).tolist() == [int(x) * int(y) % V.PRIME for x, y in zip(a, b, strict=True)]
    for values in (rng.integers(0, 256, 300).astype(np.uint8), rng.integers(0, 2**21, 300).astype(np.uint32)):
        for which in (0, 1):
            r = V.Rolling(values, which)
            total, want = 0, [0]
            for i, v in enumerate(values.tolist()):
                total = (total + (v + 1) * pow(r.base, i, V.PRIME)) % V.PRIME
                want.append(total)
            assert r.prefix.tolist() == want


def test_like_texts_have_hashes_of_their_own(spark):
    buf = np.frombuffer("".join(MORSE).encode(), np.uint8)
    for which in (0, 1):
        h = V.Rolling(buf, which).spans(np.array([0, 1024]), np.array([1024, 2048]))
        assert h[0] != h[1]
    assert quality.measure(pa.array(["\n".join(MORSE)]))["n_dup_lines"].tolist() == [0]
    assert neardup.similarities(pa.array([MORSE[0]]), pa.array([MORSE[1]])).tolist() == [0.0]
    rows = [(1, "\n".join(MORSE), "en", "s", 0), (2, MORSE[1] + " end", "en", "s", 0), (3, " ".join(MORSE), "en", "s", 0)]
    docs = documents(spark, rows)
    assert {r["doc_id"]: r["n_dup_lines"] for r in linedup.line_report(docs).collect()} == {1: 0, 2: 0, 3: 0}
    assert sorted((str(r["doc_id"]), *r[1:]) for r in suffix.remove_repeats(docs).collect()) == plain_repeats(rows, 200)


def test_like_words_have_ids_of_their_own():
    tokenizers = pytest.importorskip("tokenizers")
    try:
        file = queries.tokenizer_file()
    except OSError:
        pytest.skip("no vocabulary")
    odd = [MORSE[0], MORSE[1], " ".join(MORSE)]
    flat, _ = packing.WordEncoder(file).encode(*V.text_buffer(pa.array(odd)))
    whole = tokenizers.Tokenizer.from_str(file)
    assert flat.tolist() == [i for t in odd for i in whole.encode(t, add_special_tokens=False).ids]


def test_repeated_looks_at_both_hashes():
    many, later = V.repeated(np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 1], np.uint64))
    assert many.tolist() == [True, False, True, False] and later.tolist() == [False, False, True, False]


# ---- 1 language


def plain_grams(text):
    """Each n-gram's bucket, number by number."""
    mask, out = (1 << 64) - 1, collections.Counter()
    one = [(ord(c) + 1) * 0x9E3779B97F4A7C15 & mask for c in text.lower()]
    for x in one:
        out[x >> (64 - language.BUCKET_BITS)] += 1
    mixed = one
    for n, factor in ((2, 0xBF58476D1CE4E5B9), (3, 0x94D049BB133111EB)):
        mixed = [((x ^ (x >> 29)) * factor + one[i + n - 1]) & mask for i, x in enumerate(mixed[: max(0, len(one) - n + 1)])]
        for x in mixed:
            out[(x * 0xD6E8FEB86659FD93 & mask) >> (64 - language.BUCKET_BITS)] += 1
    return out


def test_gram_counts_equal_plain_ones():
    for text in ("", "a", "ab", "Straße über äöü 12", "x" * 300, "\U0001f600 ok"):
        got = language.gram_counts(text)
        assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(plain_grams(text))


def test_training_equals_plain_ftrl():
    rng = random.Random(3)
    examples = [(np.array(sorted(rng.sample(range(12), 4))), np.array([rng.random() for _ in range(4)]), rng.randrange(3)) for _ in range(30)]
    alpha, beta, l1, l2 = 2.0, 1.0, 0.02, 0.02
    z, n = collections.Counter(), collections.Counter()

    def weight(k, i):
        s = z[k, i]
        return 0.0 if abs(s) <= l1 else (math.copysign(l1, s) - s) / ((beta + math.sqrt(n[k, i])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(4):
        for e in order.permutation(len(examples)):
            at, value, label = examples[e]
            scores = [sum(weight(k, i) * v for i, v in zip(at.tolist(), value, strict=True)) for k in range(3)]
            total = sum(math.exp(s) for s in scores)
            now = {(k, i): weight(k, i) for k in range(3) for i in at.tolist()}
            for k in range(3):
                error = math.exp(scores[k]) / total - (k == label)
                for i, v in zip(at.tolist(), value, strict=True):
                    g = error * v
                    z[k, i] += g - (math.sqrt(n[k, i] + g * g) - math.sqrt(n[k, i])) / alpha * now[k, i]
                    n[k, i] += g * g
    got = language.train_ftrl(examples, 3)
    assert np.allclose(got[:, :12], [[weight(k, i) for i in range(12)] for k in range(3)]) and not got[:, 12:].any()


def test_rare_languages_are_learned(spark):
    rows = [(7, "aaa bbb ccc", "en", "s", 0)] * 300 + [(i, "ddd eee fff", "xx", "s", 0) for i in range(3)]
    model = language.fit(documents(spark, rows), F.lit(True), sample_rows=40)
    assert model.languages == ["en", "xx"] and model.predict("eee ddd")[0] == "xx"


# ---- 4 lines


def test_lines_of_a_hot_key(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [f"common{i}" for i in range(24)]
    lines = [[*passage, *(word() for _ in range(30))] for _ in range(5000)]
    copies = []
    for k in range(0, 5000, 50):
        other = list(lines[k])
        for at in rng.sample(range(24, 54), 3):
            other[at] = "changed" + word()
        copies.append(other)
    counter = [[f"This is line number {i:05d} of the very same counter."] for i in range(300)]
    rows = [(i, " ".join(x), "en", "s", 0) for i, x in enumerate(lines + counter + copies)]
    got = {r["doc_id"]: r["n_near_lines"] for r in linedup.line_report(documents(spark, rows).repartition(6), words_an_edit=10).collect()}
    want = {i: int(i >= 5300) for i in range(len(rows))}
    texts_ = [c[0] for c in counter]
    want |= {5000 + i: int(any(edits(x, texts_[j]) <= 1 for j in range(i) if sum(p != q for p, q in zip(x, texts_[j], strict=True)) <= 1)) for i, x in enumerate(texts_)}
    assert got == want


# ---- 5 top-k


def test_top_k_of_large_numbers_lengths_and_ids(spark):
    rng = random.Random(9)
    rows = [(2**60 + i, [rng.uniform(-4e7, 4e7) for _ in range(5)]) for i in range(40)]
    rows += [(i, [rng.uniform(-1e12, 1e12) for _ in range(3)]) for i in range(1, 41)]
    df = spark.createDataFrame([*rows, (None, [1.0] * 5), (None, None), (3, [])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 4 == 0, 5).select("query_id", "rank", "vec_id", "score").collect())
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = []
    for i, q in whole:
        if i % 4 == 0:
            score = lambda v, q=q: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True))))
            best = sorted((-score(v), j) for j, v in whole if j != i and len(v) == len(q))[:5]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


# ---- 8 mixing, 9 near-duplicates


def test_mixing_a_row_repeated_very_often(spark):
    rows = [(1, "one two three", "en", "a", 0)] * 20_000 + [(None, None, None, None, None)] * 50 + [(i, "word " * (i % 40 + 1), "en", "b", 0) for i in range(2, 400)]
    docs = documents(spark, rows).repartition(6)
    got = mixing.mix(docs, block_rows=512).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    for _, mine in got.groupby("mix_source"):
        assert abs(mine["taken"].sum() - mine["target"].iloc[0]) <= mine["size"].max()
    assert mixing.mixed(docs, block_rows=512).count() == got["times"].sum()


def test_one_row_of_a_class_is_kept(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base, "en", "s", 0)] * 3 + [(2, base, "en", "s", 0), (3, base + " end", "en", "s", 0), (None, "a b c d e f", "en", "s", 0), (None, "a b c d e f", "en", "s", 0), (5, None, "en", "s", 0)]
    got = neardup.classes(documents(spark, rows).repartition(3)).collect()
    assert collections.Counter((r["class_id"], r["class_size"], r["kept"]) for r in got) == {(1, 5, True): 1, (1, 5, False): 4, (None, 2, True): 1, (None, 2, False): 1, (5, 1, True): 1}
    assert neardup.deduplicated(documents(spark, rows)).count() == 3


# ---- pipeline


def test_pipeline_on_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    try:
        queries.tokenizer_file()
    except OSError:
        pytest.skip("no vocabulary")
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None), (None, None, None, None, None)]
    docs = documents(spark, rows).select("*", *(F.lit(f"clash {c}").alias(c) for c in CLASHING))
    stages, key = dict(pipeline.STAGES), lambda r: (str(r[0]), r[1] or "")
    plain = lambda df: sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=key)
    step = lambda name, df: V.written(stages[name](spark, df, ""), f"test-{name}")

    kept = step("quality_rules", docs)
    good = quality.measure(pa.array([r[1] for r in rows]))["kept"].tolist()
    assert kept.columns == docs.columns and plain(kept) == sorted((r for r, k in zip(rows, good, strict=True) if k), key=key) and 10 < kept.count() < len(rows)
    lines = step("line_dedup", kept)
    before = plain(kept)
    gone = plain_word_lines(before, 1)
    cut = lambda i, t: "\n".join(x for n, x in enumerate(t.split("\n")) if not gone.get((i, t, n)))
    assert lines.columns == docs.columns and plain(lines) == sorted(((i, cut(i, t), lang, s, len(cut(i, t))) for i, t, lang, s, _ in before), key=key)
    once = step("near_dedup", lines)
    assert once.columns == docs.columns and once.count() == len(plain_classes(plain(lines)))
    mixed = step("source_mixing", once)
    took = collections.Counter({(r["doc_id"], r["text_crc32"]): r["times"] for r in mixing.mix(once).collect()})
    have = collections.Counter((r["doc_id"], r["c"]) for r in mixed.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("c")).collect())
    assert mixed.columns == docs.columns and have == +took
    packed = step("token_packing", mixed)
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]

    for name, rows_ in (("odd", docs), ("none", docs.where("false"))):
        rows_.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = pipeline.run(spark, str(tmp_path / name))
        assert (out.count() > 0) == (name == "odd")


# ---- 10 repeats of more than the width


def plain_prefix(a, b, most):
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return min(n, most)


def test_prefixes_of_long_near_copies():
    rng = random.Random(11)
    word = lambda: bytes(rng.choice(b"abcdefgh") for _ in range(rng.randrange(2, 7)))
    for shared in (300, 700, 2000):
        base = b" ".join(word() for _ in range(shared // 4))
        copies = [base[: rng.randrange(len(base))] + word() + base[rng.randrange(len(base)) :] for _ in range(4)]
        text = np.frombuffer(b"|".join([base, *copies, b"ab" * shared]), np.uint8)
        order, raw = suffix.suffix_array(text), text.tobytes()
        assert [raw[i:] for i in order] == sorted(raw[i:] for i in order)
        for most in (60, 200):
            got = suffix.common_prefixes(text, order, most)
            assert got.tolist() == [0, *(plain_prefix(raw[i:], raw[j:], most) for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True))]


@pytest.mark.parametrize("width", [60, 200])
def test_repeats_of_long_near_copies(spark, width):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    rows = []
    for size in (300, 600, 1200, 2000):
        base = [word() for _ in range(size // 4)]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(1, 6)):
                copy[rng.randrange(len(copy))] = word()
            at = rng.randrange(len(copy))
            rows.append((len(rows), " ".join(copy[at:] + copy[:at]), "en", "s", 0))
    got = suffix.remove_repeats(documents(spark, rows), width=width).collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == plain_repeats(rows, width)


def test_repeats_of_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    raw = {r["doc_id"]: (r["text"] or "").encode() for r in table.collect()}
    seen = collections.Counter(hash(b[i : i + 200]) for b in raw.values() for i in range(len(b) - 199))
    want = {}
    for doc, b in raw.items():
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[hash(b[i : i + 200])] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        flags = np.cumsum(gone[:-1]) > 0
        want[doc] = (int(flags.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~flags].tobytes()).hexdigest())
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix.remove_repeats(table).collect()} == want
