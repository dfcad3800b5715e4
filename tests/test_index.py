"""The index and searches in it, against direct constructions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlake.functions import alphabet as A
from kmerlake.operators import index as X
from kmerlake.operators import kmers as K
from kmerlake.operators import routing, search
from kmerlake.operators.order import ranked, running

SEGMENTS = {
    30: [], 31: [(0, 31, True)], 128: [(0, 128, True)], 129: [(0, 64, False), (64, 129, True)], 200: [(0, 100, False), (100, 200, True)],
    255: [(0, 127, False), (127, 255, True)], 256: [(0, 128, False), (128, 256, True)], 300: [(0, 128, False), (128, 214, False), (214, 300, True)],
    385: [(0, 128, False), (128, 256, False), (256, 320, False), (320, 385, True)],
}
GOLDEN = [
    ("$$$", "G", 0), ("CGA", "C", 0), ("GAC", "GT", 0), ("$$G", "G", 0), ("ACG", "A", 1), ("$GG", "T", 1), ("ACT", "", 0), ("GGT", "", 1),
]


def frame(spark, sequences, file="f"):
    return spark.createDataFrame([(file, i, s) for i, s in enumerate(sequences)], "file string, seq_no bigint, sequence string")


def test_packing(spark):
    row = lambda *c: spark.range(1).select(*c).first()
    assert row(A.pack(F.lit("CAG")), A.pack(F.lit("T" * 32)), A.unpack(F.lit(33), 3), A.unpack(F.lit(-1), 32)) == (33, -1, "CAG", "T" * 32)
    assert row(A.codes(F.lit("acgTN@C")), A.letters(F.lit("0123")), A.code_of(F.lit("x")), A.letter_of(F.lit(2))) == ("0003001", "ACGT", 0, "G")
    s = "ACGTTGCA" * 9 + "C"
    assert row(A.unpack_words(A.pack_words(F.lit(s)), F.lit(len(s))), F.size(A.pack_words(F.lit(s))), F.size(A.pack_words(F.lit("")))) == (s, 3, 0)
    assert row(A.shift_left(F.lit(1), F.lit(64)), A.low_bits(F.lit(64)), A.low_bits(F.lit(3)), A.mod(F.lit(-3), F.lit(5)), A.ceil_div(F.lit(9), F.lit(4))) == (0, -1, 7, 2, 3)
    assert row(A.human_bytes(F.lit(1000)), A.human_bytes(F.lit(1536)), A.skip_value(F.lit(3 | 5 << 5)), A.lane5(F.lit(9 << 10), F.lit(2))) == ("1000 B", "1.500 KB", 40, 9)
    assert [tuple(x) for x in row(A.invalid_runs(F.lit("NNACxGT-")))[0]] == [(0, 2), (4, 1), (7, 1)] and row(A.invalid_runs(F.lit("ACG")))[0] == []


def test_a_word_of_the_highest_bit_alone(spark):
    s = "C" * 32 + "A" * 31 + "G"
    words, back = spark.range(1).select(A.pack_words(F.lit(s)), A.unpack_words(A.pack_words(F.lit(s)), F.lit(64))).first()
    assert words[1] == -(2**63) and back == s


def test_segments(spark):
    rows = K.segments(frame(spark, ["A" * n for n in SEGMENTS]), 31).collect()
    for i, n in enumerate(SEGMENTS):
        assert [(r["seg_start"], r["seg_end"], r["is_true_sep"]) for r in sorted((r for r in rows if r["seq_no"] == i), key=lambda r: r["seg_no"])] == SEGMENTS[n]


def test_segments_keep_kmers_and_text(spark):
    rnd = random.Random(1)
    rows = frame(spark, ["".join(rnd.choice("ACGT") for _ in range(n)) for n in range(25, 700, 37)])
    segs = K.segments(rows, 31)
    total = segs.agg(F.sum(F.col("seg_end") - F.col("seg_start") - 30 * F.col("is_true_sep").cast("int"))).first()[0]
    assert total == K.kmers(rows, 31).count() == K.kmer_totals(rows, 31).first()["kmers"]
    lines = [r["line"] for r in K.decoded(rows, 31).orderBy("seq_no").collect()]
    assert lines == [r["sequence"] for r in rows.collect() if len(r["sequence"]) >= 31]
    first = {r["seq_no"]: r["out_start"] for r in K.separators(segs, 31).where("seg_no = 0").collect()}
    done = 0
    for r in rows.collect():
        if r["seq_no"] in first:
            assert first[r["seq_no"]] == done
            done += len(r["sequence"]) - 30


def test_decoded_segments_with_a_word_of_the_highest_bit_alone(spark):
    s = "T" * 96 + "A" * 31 + "G" + "C" * 128
    assert [r["line"] for r in K.decoded(frame(spark, [s]), 31).collect()] == [s]


def test_golden_index(spark):
    built = X.build(frame(spark, ["ACGACT", "GGT"]), 3)
    rows = built.orderBy("pos").collect()
    assert [(r["kmer"], "".join(x for x in "ACGT" if r[x.lower()]), r["lcs"]) for r in rows] == GOLDEN
    assert [r["offset"] for r in sorted(X.offset_map(built).collect(), key=lambda r: r["letter"].lower())] == [1, 2, 8, 3, 6] and X.info(built, 3).first()["c_map"] == "1 2 3 6 8"
    found = search.search(frame(spark, ["ACGTACTGGT"]), built, 3).orderBy("offset")
    assert [r["pos"] for r in found.collect()] == [4, -1, -1, -1, 6, -1, -1, 7]


@pytest.mark.parametrize("k,seed", [(2, 1), (4, 2), (6, 3)])
def test_searches_agree(spark, k, seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    built = X.build(frame(spark, [text(40), text(25), text(k - 1)]), k).cache()
    queries = frame(spark, [text(rnd.randrange(60)) for _ in range(20)])
    key = lambda df: sorted(map(tuple, df.collect()))
    by_join = search.search(queries, built, k)
    assert key(by_join) == key(search.streaming_search(queries, built, k))
    hits = by_join.where("pos >= 0").count()
    assert hits == search.present(queries, built, k).count() and by_join.count() - hits == search.absent(queries, built, k).count()
    rows = built.orderBy("pos").collect()
    for s, l, r in [(x["suffix"], x["l"], x["r"]) for x in X.suffix_intervals(built, k - 1).collect()]:
        assert [i for i, x in enumerate(rows) if x["kmer"].endswith(s)] == list(range(l, r + 1))
    lcs, n = [r["lcs"] for r in rows], len(rows)
    for r in X.smaller_values(built, k, block=5).collect():
        i = r["pos"]
        up = [j for j in range(i) if lcs[j] < lcs[i]]
        down = [j for j in range(i + 1, n) if lcs[j] < lcs[i]]
        assert (r["psv"], r["nsv"]) == (up[-1] if up else 0, down[0] if down else n)
    for r in X.ranks(built).collect():
        assert [r[f"rank_{x}"] for x in "acgt"] == [sum(y[x] for y in rows[: r["pos"]]) for x in "acgt"]
    keys = {i for i in range(n) if i % 3 == 0}
    walked = {r["pos"]: r["key"] for r in search.walk_to_keys(built, built.where("pos % 3 = 0").select("pos")).collect()}
    ranks = {x: np.r_[0, np.cumsum([r[x] for r in rows])] for x in "acgt"}
    start = dict(zip("acgt", 1 + np.r_[0, np.cumsum([ranks[x][-1] for x in "acgt"])], strict=False))
    for i in range(n):
        at, steps = i, 0
        while at not in keys and steps <= n:
            x = next((x for x in "acgt" if rows[at][x]), None)
            if x is None:
                break
            at, steps = int(start[x] + ranks[x][at]), steps + 1
        assert walked[i] == (at if at in keys else -1)


def test_rank_directory(spark):
    rnd = random.Random(2)
    bits = [rnd.random() < 0.3 for _ in range(5000)]
    rows = spark.createDataFrame(list(enumerate(bits)), "pos bigint, a boolean")
    for r in X.rank_blocks(rows, "a").collect():
        at = r["block"] * 1024
        q = [sum(bits[at + 256 * i : at + 256 * i + 256]) for i in range(4)]
        assert (r["layer_0"], r["layer_1"], r["ones"]) == (0, sum(bits[:at]), sum(q))
        assert r["layer_1_2"] == sum(bits[:at]) << 32 | q[0] << 20 | q[1] << 10 | q[2]


def test_two_level_order(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abc") for _ in range(6)) + str(i) for i in range(300)]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r["w"] for r in ranked(rows, F.col("w")).orderBy("pos").collect()] == sorted(words)
    numbers = spark.createDataFrame([(i, i % 7) for i in range(300)], "pos bigint, v int")
    assert [r["s"] for r in running(numbers, {"s": F.col("v")}, block=16).orderBy("pos").collect()] == [sum(j % 7 for j in range(i)) for i in range(300)]


def test_balance(spark):
    files = spark.createDataFrame([("a", 5), ("b", 1), ("c", 9), ("d", 5), ("e", 30)], "file string, size bigint")
    got = {r["file"]: (r["stream"], r["stream_total"]) for r in routing.balance(files, 8).collect()}
    assert got == {"e": (0, 30), "b": (1, 11), "a": (1, 11), "d": (1, 11), "c": (2, 9)}
    assert routing.balance(files.limit(0)).count() == 0


def filled(files, limit):
    """Streams of files, filled one after another."""
    streams = []
    for file, size in sorted(files, key=lambda f: (f[1], f[0].encode())):
        if not streams or sum(n for _, n in streams[-1]) > limit:
            streams.append([])
        streams[-1].append((file, size))
    totals = [sum(n for _, n in x) for x in streams]
    order = sorted(range(len(streams)), key=lambda i: (-totals[i], i))
    return {f: (order.index(i), totals[i]) for i, x in enumerate(streams) for f, _ in x}


@pytest.mark.parametrize("seed,block", [(2, 1), (3, 7), (4, 1000)])
def test_balance_over_blocks(spark, seed, block):
    rnd = random.Random(seed)
    files = [(f"f{i}", rnd.choice([0, 1, 2, 5, 30, 31, 200])) for i in range(rnd.choice([1, 60, 131]))]
    for limit in (0, 40):
        got = {r["file"]: (r["stream"], r["stream_total"]) for r in routing.balance(spark.createDataFrame(files, "file string, size bigint"), limit, block).collect()}
        assert got == filled(files, limit)


def test_ranges_of_the_order_are_even_where_keys_lie_close(spark):
    """Nine in ten k-mers end in the same six letters; no range has over twice the mean."""
    from kmerlake.operators.order import in_ranges

    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    kmers = list({text(7) + "ACGTAC" if i % 10 else text(13) for i in range(20_000)} | {"$" * 5 + "ACGTACGT", "$" * 4 + "AACGTACGT", "$" * 13})
    rows = spark.createDataFrame([(x,) for x in kmers], "kmer string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in in_ranges(rows, *X.backward(13)).groupBy("__b").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) == 4 and sum(sizes) == len(kmers) and max(sizes) <= 2 * len(kmers) / len(sizes)
    assert [r["kmer"] for r in ranked(rows, *X.backward(13)).orderBy("pos").collect()] == sorted(kmers, key=lambda x: x[::-1])
    wide = [text(32) for _ in range(50)] + ["T" * 32, "A" * 32]
    assert [r["kmer"] for r in ranked(spark.createDataFrame([(x,) for x in wide], "kmer string"), *X.backward(32)).orderBy("pos").collect()] == sorted(wide, key=lambda x: x[::-1])


@pytest.mark.parametrize("k,stretch", [(1, 4), (3, 1), (5, 2), (31, 128), (9, 9)])
def test_stretches_hold_every_window_once(spark, k, stretch):
    rnd = random.Random(k)
    texts = ["".join(rnd.choice("ACGT\né") for _ in range(n)) for n in (0, 1, k - 1, k, k + 1, stretch, stretch + k, 4 * stretch, 700)]
    got = sorted(map(tuple, K.kmers(frame(spark, texts), k, stretch).select("seq_no", "offset", "kmer").collect()))
    assert got == sorted((i, j, t[j : j + k]) for i, t in enumerate(texts) for j in range(len(t) - k + 1))


@pytest.mark.parametrize("k,whole", [(1, 40), (5, 64), (31, 1 << 20), (32, 100), (33, 100)])
def test_summaries_of_kmers(spark, k, whole):
    """As their rows say, also of keys of several rows, null keys, long rows and letters that are none; settled rows exchange no k-mer."""
    rnd = random.Random(k)
    text = lambda n, letters="ACGT": "".join(rnd.choice(letters) for _ in range(n))
    rows = [("f", i, text(rnd.randrange(1, 90))) for i in range(20)] + [("f", 3, text(80)), (None, 3, text(70)), (None, None, text(60)), (None, None, text(60)), ("g", 1, text(200)), ("g", 2, text(90, "ACGTN")), ("g", 3, "T" * 80), ("g", 4, None)]
    found = K.kmer_summaries(spark.createDataFrame(rows, "file string, seq_no bigint, sequence string"), k, whole)
    expected = {}
    for file, seq_no, s in rows:
        for i in range(len(s or "") - k + 1):
            expected.setdefault((file, seq_no), []).append((i, s[i : i + k]))
    expected = {key: (len(x), len({w for _, w in x}), min(w for _, w in x), max(w for _, w in x), sum(i for i, _ in x)) for key, x in expected.items()}
    got = [tuple(r) for r in found.select("file", "seq_no", "kmers", "distinct_kmers", "least", "greatest", "offsets").collect()]
    assert len(got) == len(expected) and {r[:2]: r[2:] for r in got} == expected
    settled = K.kmer_summaries(frame(spark, [text(90) for _ in range(5)]), 31)
    assert "Exchange" not in settled._jdf.queryExecution().executedPlan().toString()


def test_long_rows_take_no_more_time_a_letter(spark):
    import time

    def seconds(n):
        rows = spark.range(1).select(F.lit("f").alias("file"), F.lit(1).cast("bigint").alias("seq_no"), F.repeat(F.lit("ACGGT"), n // 5).alias("sequence"))
        begun = time.time()
        assert K.stretches(rows, 31, 128).agg(F.count("*")).first()[0] == -(-(n - 30) // 128)
        return time.time() - begun

    seconds(1_000_000)
    short = min(seconds(1_000_000) for _ in range(3))
    assert seconds(16_000_000) < 2 * 16 * short + 2


def test_partitioned_search_is_search(spark):
    from kmerlake.operators import minimizers

    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    k = 21
    refs = [text(2000), "A" * 60, text(300) + "A" * 40 + text(300)]
    built = X.build(frame(spark, refs), k).cache()
    queries = [refs[0][100:700] + "N" + refs[2], "A" * 5000, text(1000), "", "ACG", refs[0][:k], "NNNN" * 20, "A" * 3000 + "C" + refs[1]]
    rows = frame(spark, queries).union(spark.createDataFrame([(None, 3, refs[2]), ("g", 3, refs[0])], "file string, seq_no bigint, sequence string")).repartition(3)
    key = lambda df: sorted(map(tuple, df.select("file", "seq_no", "offset", "pos").collect()), key=repr)
    by_join = K.kmers(rows, k).join(search.entries(built), "kmer", "left").select("file", "seq_no", "offset", F.coalesce("pos", F.lit(-1)).alias("pos"))
    expected = key(by_join)
    assert key(search.search(rows, built, k)) == expected
    known = search.entries(built)
    for options in ({}, {"per_bucket": 100}, {"per_bucket": 50, "most": 60, "windows": 400, "m": 4}, {"most": 10, "windows": 50}):
        assert key(minimizers.partitioned_search(search.stretched(rows, k), known, k, **options)) == expected, options
    assert {p for *_, p in key(minimizers.partitioned_search(search.stretched(rows, k), known.limit(0), k))} == {-1}
    assert key(search.present(rows, built, k).join(known, "kmer").select("file", "seq_no", "offset", "pos")) == [r for r in expected if r[3] >= 0]
    assert sorted(map(tuple, search.absent(rows, built, k).collect()), key=repr) == sorted(map(tuple, K.kmers(rows, k).join(known, "kmer", "left_anti").select("file", "seq_no", "offset", "kmer").collect()), key=repr)


@pytest.mark.parametrize("most", [4_000_000, 10])
def test_totals_of_absent_kmers(spark, monkeypatch, most):
    """As rows of absent k-mers say; beside a small index a row of a sequence, and not of a k-mer, is what the sum is made of."""
    monkeypatch.setattr(search, "SMALL", most)
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    k, ref = 11, text(400)
    built = X.build(frame(spark, [ref]), k).cache()
    rows = frame(spark, [ref[:200], text(300), "", ref[50:90] + text(60), "T" * 40, text(5)]).union(frame(spark, [ref[10:300]], "known")).union(frame(spark, ["NN" + ref[:60] + "NaN" + ref[80:99], "ACGTNACGTAC"], "odd"))
    rows = rows.union(spark.createDataFrame([(None, 1, text(90)), ("none", 1, None)], "file string, seq_no bigint, sequence string"))
    got = search.absent_totals(rows, built, k)
    expected = search.absent(rows, built, k).groupBy("file").agg(F.count("*"), F.min("kmer"), F.max("kmer"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    assert {r["file"] for r in got.collect()} == {"f", "odd", None}
    if most > 10:
        assert "kmer" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_windows_of_a_large_batch_are_routed_in_slices():
    import pyarrow as pa

    from kmerlake.operators import minimizers

    class Rows:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    codes = np.arange(1 << 22, dtype=np.uint64) * np.uint64(7) // np.uint64(3) % np.uint64(4)
    body = minimizers.written(np.array([5]), np.array([0]), np.array([(1 << 22) - 30]), codes.astype(np.uint8))  # a megabyte
    batch = pa.record_batch({"bucket": pa.array([1] * 32, pa.int32()), "file": pa.array(["f"] * 32), "body": pa.array([body] * 32, pa.binary())})
    got = list(minimizers.routed_windows(Rows(), 31, {}, {1: 3})(iter([batch])))
    assert sum(len(x) for x in got) == 32 and max(x.nbytes for x in got) < 6 << 20
    assert [p for x in got for p in x.column("part").to_pylist()] == [i % 3 for i in range(1, 33)]


def test_super_kmers_are_small(spark):
    """What travels is under three bytes a letter, though each letter is in 31 windows."""
    from kmerlake.operators import minimizers

    rnd = random.Random(9)
    rows = frame(spark, ["".join(rnd.choice("ACGT") for _ in range(3000)) for _ in range(40)])
    sent = minimizers.super_kmers(search.stretched(rows, 31), minimizers.SuperKmers(31, 11, 50)).agg(F.sum(F.length("body")), F.sum("n")).first()
    assert sent[1] == 40 * 2970 and sent[0] < 3 * 40 * 3000


@pytest.mark.parametrize("k", [1, 3, 12, 13, 20])
def test_streams_begin_behind_known_texts(k):
    """A stream with the table of texts finds the same rows as one without, in fewer steps; both as a dictionary has them."""
    rnd = random.Random(k)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    ref = text(400)
    real = {ref[i : i + k] for i in range(len(ref) - k + 1)}
    sources = {x for x in real if x[:-1] not in {y[1:] for y in real}}
    nodes = sorted(real | {"$" * (k - n) + x[:n] for x in sources for n in range(k)} | {"$" * k}, key=lambda x: x[::-1])
    lcs, bits, seen = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), set()
    after = {x[:-1] + "|" + x[-1] for x in nodes if x[-1] != "$"}
    for i, x in enumerate(nodes):
        lcs[i] = next((n for n in range(k) if i == 0 or nodes[i - 1][k - n - 1 :] != x[k - n - 1 :] or "$" in x[k - n - 1 :]), k - 1) if i else 0
        if x[1:] not in seen:
            seen.add(x[1:])
            bits[i] = sum(1 << j for j, c in enumerate("ACGT") if f"{x[1:]}|{c}" in after)
    queries = [ref[50:130], text(90), ref[:k], ref[10:40] + "N" + ref[20:60], "", "ACG"]
    width = max(map(len, queries))
    codes = np.array([["ACGT".find(c) if c in "ACGT" else 4 for c in q.ljust(width, "N")] for q in queries])
    lengths = np.array([len(q) for q in queries])
    place = {x: i for i, x in enumerate(nodes)}
    runs = [search.RankIndex(bits, lcs, k, prefix) for prefix in (1, 12)]
    for index in runs:
        found = index.stream(codes, lengths)
        for row, q in zip(found, queries, strict=True):
            assert row[: max(0, len(q) - k + 1)].tolist() == [place.get(q[i : i + k], -1) for i in range(len(q) - k + 1)]
    assert runs[1].steps < runs[0].steps or k == 1
    assert k < 12 or runs[1].steps < lengths.sum()


def test_search_to_keys(spark):
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    built = X.build(frame(spark, [text(200), "ACACACACACAC"]), 5).cache()
    rows = frame(spark, [text(300), "ACACACACT", ""])
    keys = built.where("pos % 7 = 0").select("pos")
    walks = search.walk_to_keys(built, keys)
    expected = sorted(map(tuple, search.search(rows, built, 5).join(walks, "pos", "left").select("seq_no", "offset", "pos", F.coalesce("key", F.lit(-1)).alias("key")).collect()))
    for most in (4_000_000, 3):
        before, search.SMALL = search.SMALL, most
        try:
            assert sorted(map(tuple, search.search_to_keys(rows, built, keys, 5).select("seq_no", "offset", "pos", "key").collect())) == expected
        finally:
            search.SMALL = before
    assert any(r[3] >= 0 and r[3] != r[2] for r in expected) and any(r[2] < 0 for r in expected)


def test_stored_tables_go_with_their_scope(spark):
    import os

    from kmerlake.operators.lineage import scope, stored

    there = lambda df: os.path.exists(df.stored_at.removeprefix("file:"))
    with scope():
        one = stored(spark.range(5).toDF("x"), "one")
        with pytest.raises(ZeroDivisionError), scope():
            two = stored(one.where("x > 2"), "two")
            assert there(one) and there(two) and two.count() == 2
            1 / 0  # noqa: B018
        assert there(one) and not there(two)
    assert not there(one)
    three = stored(spark.range(3).toDF("x"), "three")
    assert there(three) and three.count() == 3


def test_whole_numbers_and_sizes(spark):
    from kmerlake.functions import alphabet as A

    rows = [(2**53 + 1, 1), (2**62 + 3, 2), (-7, 2), (7, 2), (0, 5), (8, 4), (-8, 4)]
    got = spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", A.ceil_div(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r["x"] == -(-r["a"] // r["b"]) for r in got)
    sizes = spark.createDataFrame([(2**30 - 1,), (1023,), (1536,), (2**40,)], "n bigint").select(A.human_bytes(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in sizes] == ["1.000 GB", "1023 B", "1.500 KB", "1.000 TB"]


def test_streaming_over_letters_that_are_none(spark):
    built = X.build(frame(spark, ["ACGACTTACG"]), 3)
    queries = frame(spark, ["ACGNACTT", "NNNN", "ACG" * 700])
    key = lambda df: sorted(map(tuple, df.collect()))
    expected = K.kmers(queries, 3).join(search.entries(built), "kmer", "left").select("file", "seq_no", "offset", F.coalesce("pos", F.lit(-1)).alias("pos"))
    assert key(search.search(queries, built, 3)) == key(search.streaming_search(queries, built, 3)) == key(expected)


def test_windows_are_summed_up_where_they_are_found(spark):
    """Sums by sequence are those of the windows, on every route, for cut, repeated, short and odd rows; a stretch gives one row, not one a window."""
    rnd = random.Random(21)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    base = text(400)
    built = X.build(frame(spark, [base, text(60)]), 7).cache()
    rows = frame(spark, [text(50) + base[40:300] + text(3000), base[:9] + "N" + base[5:90], "ACG", "", base])
    rows = rows.union(rows.limit(2)).union(rows.limit(1).selectExpr("cast(null as string) file", "seq_no", "sequence")).union(rows.limit(1).selectExpr("file", "seq_no", "cast(null as string) sequence")).cache()
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    expected = key(search.totals(K.kmers(rows, 7).join(search.entries(built), "kmer", "left").select("file", "seq_no", F.coalesce("pos", F.lit(-1)).alias("pos"))))
    assert any(r[3] > 1 for r in expected)
    keys = built.where("pos % 7 = 0").select("pos")
    found = search.search_to_keys(rows, built, keys, 7)
    at = F.when(F.col("key") >= 0, F.col("key"))
    by_key = key(found.groupBy("file", "seq_no").agg(F.count("*"), F.count(at), F.countDistinct(at), F.sum("key"), F.sum("pos")))
    ends = key(search.totals(search.intervals(rows, built, 5), "l", "r"))
    for most in (4_000_000, 3):
        before, search.SMALL = search.SMALL, most
        try:
            assert key(search.search_totals(rows, built, 7)) == key(search.streaming_search(rows, built, 7, summed=True)) == expected
            assert key(search.key_totals(rows, built, keys, 7)) == by_key
            assert key(search.interval_totals(rows, built, 5)) == ends
        finally:
            search.SMALL = before
    shared = search.Searcher(built, 7).shared
    assert search.looked_up_totals(search.stretched(rows, 7), shared).count() <= rows.count() < search.looked_up(search.stretched(rows, 7), shared).count()


def test_streams_begin_behind_long_texts():
    """A stream that loses its match to under 20 letters goes on behind the next long text that occurs, not letter by letter."""
    import numpy as np

    rnd = random.Random(4)
    k, word = 31, "".join(rnd.choice("ACGT") for _ in range(14))
    refs = [word + "".join(rnd.choice("ACGT") for _ in range(40)) for _ in range(5)]
    proper = {x[i : i + k] for x in refs for i in range(len(x) - k + 1)}
    starts = {x for x in proper if not any(y.endswith(x[:-1]) for y in proper)}
    every = sorted([(x[::-1], x) for x in proper | {x[:i].rjust(k, "$") for x in starts for i in range(k)}])
    names = [x for _, x in every]
    ends: dict[str, set[str]] = {}
    for x in names:
        ends.setdefault(x[:-1], set()).add(x[-1])
    shared = lambda a, b: next((i for i in range(k) if a[k - 1 - i] != b[k - 1 - i] or a[k - 1 - i] == "$"), k)
    lcs = np.array([0, *(shared(a, b) for a, b in zip(names, names[1:], strict=False))])
    bits = np.array([0 if i and names[i - 1][1:] == x[1:] else sum(1 << "ACGT".index(y) for y in ends.get(x[1:], ()) if y != "$") for i, x in enumerate(names)])
    query = "".join(word + rnd.choice("ACGT") for _ in range(60)) + refs[3] + word * 3
    codes = np.array([["ACGT".index(x) for x in query]])
    found, runs = {}, {}
    for prefix in (12, None):
        runs[prefix] = search.RankIndex(bits, lcs, k, *([prefix] if prefix else []))
        found[prefix] = runs[prefix].stream(codes, np.array([len(query)]))[0].tolist()
    place = {x: i for i, x in enumerate(names) if "$" not in x}
    assert found[12] == found[None] == [place.get(query[i : i + k], -1) for i in range(len(query) - k + 1)] and max(found[12]) >= 0
    assert runs[None].steps < len(query) / 4
