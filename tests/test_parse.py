"""Parsing: the grammar's edge cases, the readers against each other, writers and the command line."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from kmerlake import cli
from kmerlake.operators import kmers as K
from kmerlake.sources import blocks, fastx, index_file

CASES = [
    ("@x\nACGT\nAC\n+\n@@@@\n\n>y\nGGNC\n", ["ACGTAC", "GGAC"]),
    ("ACGT\n@a\nACGTA", ["ACGTA"]),
    (">a\nacgT\r\nGG\n", ["AAATAGG"]),
    ("@a\nACGT\n+\n!!\n@!!\nACGG\n@b\nTTTT\n", ["ACGT", "ACGG", "TTTT"]),
    ("@a\nACGT\n+\n+\n+\n+\n@q\n@b\nTTT\n", ["ACGT", "TTT"]),
    ("@a\n@b\nACG\n\nT@>+\n", ["ACGTAAA"]),
    (">a\nAC\n>b\nACG\n", ["ACG"]),
    ("@a\n+\nIIII\n@b\nACGT\n", ["ACGT"]),
    ("", []),
    ("\n\n", []),
]


def parsed(spark, texts, k):
    raw = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, value string")
    rows = fastx.records(raw, k).collect()
    return [[r["sequence"] for r in sorted((r for r in rows if r["file"] == str(i)), key=lambda r: r["seq_no"])] for i in range(len(texts))]


def test_grammar(spark):
    assert parsed(spark, [t for t, _ in CASES], 3) == [e for _, e in CASES]


@pytest.mark.parametrize("per_split", [1, 3])
def test_grammar_in_blocks_of_single_lines(spark, monkeypatch, per_split):
    """Every line a block, blocks in splits of any number: their maps are composed in two levels."""
    monkeypatch.setattr(blocks, "PER_SPLIT", per_split)
    rows = [(str(i), n, line) for i, (t, _) in enumerate(CASES) for n, line in enumerate(t.split("\n"))]
    own = spark.createDataFrame(rows, "file string, block bigint, value string").repartition(5)
    found = blocks.records(own, 3).collect()
    assert [[r["sequence"] for r in sorted((r for r in found if r["file"] == str(i)), key=lambda r: r["seq_no"])] for i in range(len(CASES))] == [e for _, e in CASES]
    for k in (1, 4):
        whole = K.kmers(blocks.records(own, k), k).select("file", "seq_no", "offset", "kmer")
        cut = blocks.stretches(own, k)
        assert cut.agg(F.max(F.length("body"))).first()[0] < 12 + k
        parts = K.kmers(cut.select("file", "seq_no", "base", F.col("body").alias("sequence")), k, more=("base",)).select("file", "seq_no", (F.col("base") + F.col("offset")).alias("offset"), "kmer")
        assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))


def test_readers_agree_on_random_texts(spark, tmp_path):
    rnd = random.Random(5)
    texts = []
    for i in range(60):
        lines = ["".join(rnd.choice("@>+ACGTN") for _ in range(rnd.choice([0, 1, 1, 2, 5]))) for _ in range(rnd.randrange(40))]
        texts.append("\n".join(lines))
        (tmp_path / f"{i:02}.fq").write_text(texts[-1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        assert blocks.read_blocks(spark, str(tmp_path)).select("file", "block").distinct().count() > 60
        large = {(r["file"][-5:], r["seq_no"], r["sequence"]) for r in blocks.read_large(spark, str(tmp_path), 1).collect()}
        cut = blocks.records(blocks.read_blocks(spark, str(tmp_path), 5), 1)
        assert {(r["file"][-5:], r["seq_no"], r["sequence"]) for r in cut.collect()} == large
        lines = {(r["file"][-5:], r["ln"], r["line"]) for r in blocks.numbered(blocks.read_blocks(spark, str(tmp_path), 5)).collect()}
        assert lines == {(f"{i:02}.fq", n, line) for i, t in enumerate(texts) if t for n, line in enumerate(t[:-1].split("\n") if t.endswith("\n") else t.split("\n"))}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    raw = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    assert {(r["file"][-5:], r["seq_no"], r["sequence"]) for r in fastx.records(raw, 1).collect()} == large


def test_strict(spark):
    files = {
        "a": "@1\nACGN\n+\n!!!!\n@2\nAXA\n+\n!!!\n@3\nACG\n+\n!!!\n", "b": "@1\nAC\n+\n!!\n", "windows": "@1\r\nACN\r\n+\r\n!!!\r\n@2\r\nGG\r\n+\r\n!!\r\n",
        "no header": "@1\nAC\n+\n!!\n2\nGG\n+\n!!\n", "no plus": "@1\nAC\n-\n!!\n@2\nGG\n+\n!!\n", "ends": "@1\nAC\n+\n!!\n@2\nGG", "ends early": "@1", "empty": "",
    }
    raw = spark.createDataFrame(list(files.items()), "file string, value string")
    assert sorted((r["file"], r["seq_no"], r["sequence"]) for r in fastx.strict_records(fastx.lines(raw)).collect()) == sorted([
        ("a", 1, "ACGA"), ("b", 1, "AC"), ("windows", 1, "ACA"), ("windows", 2, "GG"), ("no header", 1, "AC"), ("no plus", 1, "AC"), ("ends", 1, "AC"), ("ends", 2, "GG"),
    ])


def test_generated_fastq(spark):
    rnd, text, expected = random.Random(3), "", []
    for i in range(100):
        s = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 200)))
        text += f"@sequence {i}\n"
        rest = s
        if rnd.random() < 0.5:
            while rest and rnd.random() < 0.8:
                n = rnd.randint(1, 31)
                text, rest = text + rest[:n] + "\n", rest[n:]
        text += rest + ("\n" if rest else "")
        if rnd.random() < 0.5:
            text += f"+quality {i}\n" + "".join(rnd.choice("!#$%^&*()_-=") for _ in range(9)) + "\n"
        elif rnd.random() < 0.5:
            text += "+\n" + "".join(rnd.choice("@!#$%>^&*()_+-=") for _ in range(rnd.randint(1, 80))) + "\n"
        if len(s) >= 31:
            expected.append(s)
    assert parsed(spark, [text], 31) == [expected]


def test_command_line(spark, tmp_path):
    for name, text in (("a.fq", "@1\nACGTACGT\n+\n!!!!!!!!\n@2\nAC\n"), ("b.fa", ">1\nAC\n"), ("c.fa", ">1\nGGG\nTTT\n>2\nCCCC\n")):
        (tmp_path / name).write_text(text)
    inputs, outputs = [str(tmp_path / n) for n in ("a.fq", "b.fa", "c.fa")], [str(tmp_path / f"{n}.out") for n in "abc"]
    (tmp_path / "out.list").write_text("\n".join(outputs) + "\n\n")
    assert cli.main(["-k", "3", "-i", *inputs, "-of", str(tmp_path / "out.list")]) == 0
    assert [(tmp_path / f"{n}.out").read_text() for n in "abc"] == ["ACGTACGT\n", "", "GGGTTT\nCCCC\n"]
    assert not list(tmp_path.glob("*.parts-*"))
    assert cli.main(["-k", "3", "-i", *inputs, "-o", outputs[0]]) == 1
    assert cli.main(["-k", "3", "-i", inputs[0], "-o", inputs[0]]) == 1
    assert cli.main(["-k", "3", "-i", str(tmp_path / "none"), "-o", outputs[0]]) == 1


def test_lists_and_sizes_of_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">1\nACGT\n")
    (tmp_path / "list").write_text("x/a.fa\n\ny\n")
    assert [(r["file"][-4:], r["size"]) for r in fastx.file_sizes(spark, str(tmp_path / "a.fa")).collect()] == [("a.fa", 8)]
    assert sorted(r["path"] for r in fastx.read_path_list(spark, str(tmp_path / "list")).collect()) == ["x/a.fa", "y"]


def test_arrivals(spark, tmp_path):
    from kmerlake.streaming.arrival import clean_arrivals

    (tmp_path / "in").mkdir()
    for n, text in enumerate((">1\nACGT\n", ">1\nGG\n>2\nTTTT\n")):
        (tmp_path / "in" / f"{n}.fa").write_text(text)
        clean_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 3, once=True).awaitTermination()
    assert sorted(r["sequence"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["ACGT", "TTTT"]
    from kmerlake.operators import index as X

    built = X.build(spark.createDataFrame([("r", 1, "ACGACT"), ("r", 2, "GGT")], "file string, seq_no bigint, sequence string"), 3)
    clean_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "hits"), str(tmp_path / "cp2"), 3, built, once=True, files=1).awaitTermination()
    assert sorted(r["pos"] for r in spark.read.parquet(str(tmp_path / "hits")).collect()) == [-1, -1, -1, 4]


def test_index_file(spark, tmp_path):
    from kmerlake.operators import index as X

    rnd = random.Random(9)
    for k, texts in ((3, ["ACGACT", "GGT"]), (5, ["".join(rnd.choice("ACGT") for _ in range(90))]), (1, ["AC"])):
        built = X.build(spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "file string, seq_no bigint, sequence string"), k)
        path, n = str(tmp_path / f"{k}.bin"), built.count()
        index_file.write(built, k, path)
        assert {x: index_file.metadata(spark, path)[x] for x in ("k", "rows", "n_nodes")} == {"k": k, "rows": n, "n_nodes": n}
        assert index_file.read_bits(spark, path).orderBy("pos").collect() == built.select("pos", "a", "c", "g", "t").orderBy("pos").collect()
        again, found = index_file.read(spark, path)
        assert found == k and again.orderBy("pos").collect() == built.orderBy("pos").collect()
    for name, data in (("bad", struct.pack("<Q", 2) + b"v9"), ("text", b"ACGTACGTACGTACGT")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            index_file.metadata(spark, str(tmp_path / name))


def test_index_source_reads_ranges_and_pushes_conditions(spark, tmp_path):
    n = 300_000
    bits = spark.range(n, numPartitions=7).select(F.col("id").alias("pos"), *[(F.hash("id", F.lit(x)) % 3 == 0).alias(x) for x in "acgt"])
    path = str(tmp_path / "many.bin")
    index_file.write(bits, 9, path)
    assert (tmp_path / "many.bin").stat().st_size == 8 + 12 + 8 + 4 + 4 * (8 + 8 * -(-n // 64)) + 7 * 8 + 4 * 8 and not list(tmp_path.glob("*.parts-*"))
    source = index_file.registered(spark).read.format("kmer_index").option("split", 500).load(path)
    assert source.rdd.getNumPartitions() == -(-(-(-n // 64)) // 500)
    mark = [F.count("*"), F.sum("pos"), F.bit_xor(F.xxhash64("pos", *"acgt"))]
    assert source.agg(*mark).first() == bits.agg(*mark).first()
    for condition in ("pos = 77", "pos >= 70000 and pos < 70130", "pos > 299990", "pos in (3, 200000)", "pos <= 5 and a", "pos < 0", "pos + 1 = 10"):
        assert source.where(condition).agg(*mark).first() == bits.where(condition).agg(*mark).first(), condition
    near = source.where("pos >= 70000 and pos < 70130")
    assert near.rdd.getNumPartitions() == 1 and source.where("pos < 0").count() == 0
    with pytest.raises(Exception, match="missing"):
        index_file.write(bits.where("pos < 640 or pos >= 1280"), 9, str(tmp_path / "gap.bin"))
    assert not (tmp_path / "gap.bin").exists() and not list(tmp_path.glob("*.parts-*"))


def test_one_file_is_written_by_several_tasks(spark, tmp_path):
    from kmerlake.sources import sinks

    rows = spark.range(40_000).select(F.lit("in").alias("file"), F.col("id").alias("seq_no"), F.repeat(F.lit("ACGT"), (F.col("id") % 5).cast("int") + 1).alias("sequence"))
    rows = rows.union(spark.createDataFrame([("small", 2, "GG"), ("small", 1, "T")], rows.schema))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        named = {"in": str(tmp_path / "a"), "small": str(tmp_path / "b"), "none": str(tmp_path / "new" / "c")}
        ranged = rows.where("file = 'in'").repartitionByRange("seq_no")
        assert ranged.rdd.getNumPartitions() > 1
        sinks.write_sequences(rows, named)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert (tmp_path / "a").read_text() == "".join("ACGT" * (i % 5 + 1) + "\n" for i in range(40_000))
    assert (tmp_path / "b").read_text() == "T\nGG\n" and (tmp_path / "new" / "c").read_text() == "" and not list(tmp_path.glob("*.parts-*"))


def test_search_command(spark, tmp_path):
    from kmerlake.operators import index as X

    index_file.write(X.build(spark.createDataFrame([("r", 1, "ACGACT"), ("r", 2, "GGT")], "file string, seq_no bigint, sequence string"), 3), 3, str(tmp_path / "x"))
    (tmp_path / "q.fa").write_text(">1\nACGTAC\nTGGT\n>2\nAC\n")
    assert cli.main(["-x", str(tmp_path / "x"), "-i", str(tmp_path / "q.fa"), "--search", str(tmp_path / "hits")]) == 0
    hits = spark.read.parquet(str(tmp_path / "hits")).orderBy("offset").collect()
    assert [(r["seq_no"], r["pos"]) for r in hits] == [(1, p) for p in (4, -1, -1, -1, 6, -1, -1, 7)]


def test_totals_match_kmers(spark):
    rows = spark.createDataFrame([("f", 1, "ACGTACGT"), ("f", 2, "AC")], "file string, seq_no bigint, sequence string")
    assert K.kmer_totals(rows, 3).first()["kmers"] == K.kmers(rows, 3).count() == 6
    assert K.kmers(rows, 3, stretch=2).orderBy("offset").agg(F.collect_list("kmer")).first()[0] == ["ACG", "CGT", "GTA", "TAC", "ACG", "CGT"]


def test_blocks_of_a_large_batch_are_parsed_in_slices(spark, monkeypatch):
    """What a task holds beside a batch follows the slice, however many bytes the engine puts in a batch."""
    import pyarrow as pa

    from kmerlake.operators.windows import in_slices

    values = ["A" * n for n in (0, 10, 400, 90, 5, 5)] + [None]
    batch = pa.record_batch({"value": pa.array(values, pa.string()), "i": pa.array(range(7))})
    found = list(in_slices(iter([batch, batch.slice(0, 0)]), "value", 100))
    assert [x.column("i").to_pylist() for x in found] == [[0, 1], [2], [3, 4, 5, 6]]
    assert all(len(x) == 1 or sum(len(v or "") for v in x.column("value").to_pylist()) <= 100 for x in found)

    class Rows:
        def __getattr__(self, name):
            return lambda *a: self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    rows = Rows()
    monkeypatch.setattr(blocks, "block_maps", lambda b: b)
    monkeypatch.setattr(blocks, "entries", lambda m: m)
    blocks.parts_of(rows)
    value = "@a\n" + ("ACGT" * 15 + "\n") * 17_000  # a megabyte
    n = 24
    columns = {"file": ["f"] * n, "block": range(n), "value": [value] * n, "state": [0] * n, "base": range(n)}
    types = {"file": pa.string(), "block": pa.int64(), "value": pa.string(), "state": pa.int32(), "base": pa.int64()}
    got = list(rows.run(iter([pa.record_batch({c: pa.array(x, types[c]) for c, x in columns.items()})])))
    assert sum(len(x) for x in got) == n and max(x.nbytes for x in got) < 6 << 20


def test_lines_of_a_large_batch_are_written_in_slices(tmp_path):
    import tracemalloc

    import pyarrow as pa

    from kmerlake.sources.sinks import LineWriter

    n = 32
    batch = pa.record_batch({"number": pa.array([0] * n, pa.int32()), "place": pa.array(range(n)), "line": pa.array(["ACGT" * 250_000] * n)})
    writer = LineWriter([str(tmp_path / "lines.txt")])
    tracemalloc.start()
    try:
        said = writer.write(iter([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    writer.commit([said])
    assert (tmp_path / "lines.txt").read_text() == ("ACGT" * 250_000 + "\n") * n
    assert peak < 24_000_000, peak  # the batch has 32 MB
