"""Operators against direct computations on small tables with the awkward cases."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kmerlake.llm import ann, bpe, line_dedup, lm_score, ngram_rules, packing, quality_gam, simhash, suffix_dedup, token_count
from kmerlake.llm.common import connected
from kmerlake.llm.queries import vocabulary_file, word_pattern

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, words string, name string"


def frame(spark, texts, sources=None):
    """Documents with numbers from 0, and columns whose names operators use inside."""
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or ""), 0.5, "w", "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def corpus(seed=1, n=60):
    """Random prose, with exact and near copies, shared passages, junk, and empty and null texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    words = [word() for _ in range(150)]
    line = lambda k: " ".join(rnd.choice(words) if rnd.random() < 0.8 else word() for _ in range(k))
    texts = ["\n".join(line(rnd.randint(1, 20)) for _ in range(rnd.randint(1, 12))) for _ in range(n)]
    shared = line(150)
    for i in range(5, 12):
        texts[i] = line(5) + "\n" + shared + "\n" + line(7)
    for i in range(20, 26):
        texts[i] = texts[19]
    for i in range(30, 35):
        texts[i] = texts[29].replace(rnd.choice(words), word(), 1)
    texts[40] = "same words again " * 300
    texts[41] = "THE!! ### | a | b " * 30
    return [*texts, "", None, " \n\t ", "x", "\n\n\n", "é" * 500, "日本語 テキスト  <|endoftext|> 🙂🙂 o'clock's 12345", "a b", "a b c"]


def rows_of(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_gam_learns_and_scores_every_row(spark):
    rnd = random.Random(3)
    good = [" ".join(rnd.choice(["river", "stone", "walk", "green", "and"]) for _ in range(60)) + "." for _ in range(150)]
    bad = [" ".join(rnd.choice(["BUY!!", "NOW!!", "###", "$$$"]) for _ in range(60)) for _ in range(150)]
    texts = [x for pair in zip(good, bad, strict=True) for x in pair] + ["", None]
    docs = frame(spark, texts).union(frame(spark, texts).limit(1)).union(frame(spark, ["x"]).selectExpr("cast(null as bigint) doc_id", "* except (doc_id)"))
    labels = spark.createDataFrame([(i, (i + 1) % 2, 0) for i in range(300)] + [(None, 1, 0), (7, None, None)], "doc_id bigint, quality int, toxic int")
    rows = quality_gam.quality(docs, labels).collect()
    assert len(rows) == len(texts) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 300]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    assert len(held) > 30 and np.mean([r["predicted"] == (r["doc_id"] + 1) % 2 for r in held]) > 0.95
    kept = quality_gam.score(docs, quality_gam.train(docs, labels))
    assert kept.columns == [*docs.columns, "quality_score", "quality_kept"]
    none = quality_gam.quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and quality_gam.quality(docs.limit(0), labels).count() == 0


def test_gam_tables_and_pairs():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(4000, len(quality_gam.FEATURES)))
    y = ((x[:, 2] > 0) ^ (x[:, 5] > 0)).astype(float)  # only a pair of features tells
    model = quality_gam.fit(x, y)
    assert (2, 5) in {(i, j) for i, j, _ in model.pairs}
    fresh = rnd.normal(size=(2000, x.shape[1]))
    assert np.mean((model.scores(fresh) > 0.5) == ((fresh[:, 2] > 0) ^ (fresh[:, 5] > 0))) > 0.85
    for row, score in zip(fresh[:50], model.scores(fresh[:50]), strict=True):
        at = [int(np.sum(e <= v)) for e, v in zip(model.edges, row, strict=True)]
        logit = model.base + sum(t[b] for t, b in zip(model.tables, at, strict=True)) + sum(t[at[i] // quality_gam.COARSE, at[j] // quality_gam.COARSE] for i, j, t in model.pairs)
        assert math.isclose(score, 1 / (1 + math.exp(-min(30, max(-30, logit)))))
    g, h = np.array([1.0, 1, -1, -1]), np.ones(4)
    assert np.allclose(quality_gam.shallow_tree(g, h, 2, 0.0), [1, 1, -1, -1])


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_longs(*longs):
    h = 42
    for x in longs:
        h = xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), seed=h)
    return signed(h)


def test_rules(spark):
    texts = corpus() + ["p q r s " * 20 + " ".join(map(str, range(40)))]
    docs = frame(spark, texts)
    trusted = [0, 1, 2, 3, 12, 13, 14]
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(0, 1, 0), (41, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    grams = {}
    for i, t in enumerate(texts):
        u = [signed(xxhash.xxh64_intdigest(w, seed=42)) for w in (t or "").encode().split()]
        grams[i] = [x & (ngram_rules.BUCKETS - 1) for x in u + [hash_longs(a, b) for a, b in zip(u, u[1:], strict=False)]]
    raw, target = Counter(x for g in grams.values() for x in g), Counter(x for i in trusted for x in grams[i])
    n_raw, n_target = sum(raw.values()), sum(target.values())
    weight = lambda c: round(1000 * (math.log((target[c] + 1) / (raw[c] + 1)) + math.log((n_raw + ngram_rules.BUCKETS) / (n_target + ngram_rules.BUCKETS))))
    got = rows_of(ngram_rules.quality_rules(docs, labels))
    assert len(got) == len(texts)
    levels = sorted(math.floor(1000 * got[i]["llr"]) for i in trusted if not got[i]["base_failed"])
    low, high = (levels[math.ceil(q * len(levels) / 4) - 1] for q in (1, 3))
    least = (low - ngram_rules.FENCE * (high - low)) / 1000
    for i, t in enumerate(texts):
        b = (t or "").encode()
        w = b.split()
        triples = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        often, covered = Counter(triples), set()
        for j, x in enumerate(triples):
            covered |= {j, j + 1, j + 2} if often[x] > 1 else set()
        lines = [x for x in b.split(b"\n") if x.split()]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[i]
        symbols = sum((t or "").count(c) for c in "#*$%&|<>")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(w), sum(len(x.decode()) for x in w), symbols, len(lines) - len(set(lines)), len(covered), failed
        ), i
        ratio = sum(map(weight, grams[i])) / 1000 / len(grams[i]) if grams[i] else 0.0
        assert abs(r["llr"] - ratio) < 2e-3 and r["kept"] == (not failed and r["llr"] >= least)
    assert {(r["llr"], r["kept"]) for r in ngram_rules.quality_rules(docs, labels.limit(0)).collect() if not r["base_failed"]} == {(0.0, True)}
    assert ngram_rules.quality_rules(docs.limit(0), labels).count() == 0


def test_rules_of_long_texts(spark, monkeypatch):
    docs = frame(spark, corpus(4))
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    usual = rows_of(ngram_rules.quality_rules(docs, labels))
    for bits in (4, 60):  # texts of 16 words or more then sort pairs, or those whose hashes agree in 4 bits
        monkeypatch.setattr(ngram_rules, "PLACE_BITS", bits)
        assert rows_of(ngram_rules.quality_rules(docs, labels)) == usual


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_line_dedup(spark, depth):
    rnd = random.Random(depth)
    texts = ["\n".join(rnd.choice(["a", "b", "c", "dd", "", " ", "é"]) for _ in range(rnd.randrange(1, 14))) for _ in range(40)] + ["", "\n\n\n\n\n\n", "a", None, "q\r\nq\r\nq\r\nq\r\nq\r\nq\r\n"]
    first, gone = {}, defaultdict(set)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        for j in range(len(lines) - depth + 1):
            run = tuple(lines[j : j + depth])
            if any(x.strip(" \t\n\r\v\f") for x in run) and first.setdefault(run, (i, j)) != (i, j):
                gone[i] |= set(range(j, j + depth))
    got = rows_of(line_dedup.without_repeated_lines(frame(spark, texts), depth))
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        runs = sum(x - 1 not in gone[i] for x in gone[i])
        expected = None if t is None else "\n".join(x for j, x in enumerate(lines) if j not in gone[i])
        assert (got[i]["text"], got[i]["lines_before"], got[i]["lines_gone"], got[i]["runs_gone"]) == (expected, 0 if t is None else len(lines), len(gone[i]), runs), i
    assert line_dedup.without_repeated_lines(frame(spark, texts).limit(0), depth).count() == 0


def test_suffix_array_of_lines(spark):
    """Ranks are in the order of names, equal for equal runs of lines only, and reach the depth of the longest repeated run."""
    rnd = random.Random(12)
    run = [f"run {i}" for i in range(23)]
    texts = [[rnd.choice("abc") for _ in range(9)] for _ in range(12)] + [["x", *run], [*run[:20], "y"], ["z", *run[3:9]], run[:11]]
    found = list(line_dedup.suffix_array(frame(spark, ["\n".join(t) for t in texts])))
    assert [depth for depth, _ in found] == [1, 2, 4, 8, 16]
    for depth, rows in found:
        spans = defaultdict(list)
        for i, t in enumerate(texts):
            for j in range(len(t) - depth + 1):
                spans[tuple(t[j : j + depth])].append((i, j))
        rows = rows.collect()
        assert {(r["doc"], r["at"]): r["later"] for r in rows} == {x: x != places[0] for places in spans.values() if len(places) > 1 for x in places}
        ranks = defaultdict(set)
        for r in rows:
            ranks[r["rank"]].add(tuple(texts[r["doc"]][r["at"] : r["at"] + depth]))
        assert all(len(x) == 1 for x in ranks.values()) and len(ranks) == sum(len(p) > 1 for p in spans.values())


@pytest.mark.parametrize("n", [3, 7, 20])
def test_line_dedup_of_long_runs(spark, n):
    run = [f"line {i}" for i in range(n)]
    texts = ["\n".join(t) for t in (["a", *run, "b"], ["c", "", *run], [*run, "d", *run[:-1]], ["e", run[0], "f"])]
    got = rows_of(line_dedup.without_repeated_lines(frame(spark, texts)))
    assert [got[i]["text"] for i in range(4)] == [texts[0], "c\n", "d", texts[3]]
    assert [got[i]["runs_gone"] for i in range(4)] == [0, 1, 2, 0]


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    docs = frame(spark, ["a\nb\nc", "a\nb\nd"])
    twice = docs.union(docs.where("doc_id = 1")).union(docs.where("doc_id = 0").selectExpr("cast(null as bigint) doc_id", "* except (doc_id)"))
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in line_dedup.without_repeated_lines(twice).collect())
    assert got == [(False, 0, "a\nb\nc"), (True, 0, ""), (True, 1, "d"), (True, 1, "d")]


@pytest.mark.parametrize("lot,size", [(1 << 22, 1_000_000), (2_000, 100), (1, 10)])
def test_lm_score(spark, lot, size):
    """Scores are those of plain counts, however documents are put into lots and keys into ranges."""
    texts = [*corpus(2), "only once here", "twice in the corpus", "twice in the corpus"]
    target = set(range(0, 30, 3))
    labels = spark.createDataFrame([(i, 1) for i in target] + [(1, 0), (0, 1), (None, 1)], "doc_id bigint, quality int")
    words = [[None, *(t or "").encode().lower().split()] for t in texts]
    uni, bi = (Counter(), Counter()), (Counter(), Counter())
    for i, x in enumerate(words):
        for m in [0, 1] if i in target else [0]:
            uni[m].update(x)
            bi[m].update(zip(x, x[1:], strict=False))
    kinds, got = len(set(uni[0]) - {None}), rows_of(lm_score.cross_entropy_difference(frame(spark, texts), labels, lot, size))
    assert len(got) == len(texts)
    for i, x in enumerate(words):
        loss, pairs, own = [0.0, 0.0], list(zip(x, x[1:], strict=False)), Counter(x)
        own_pairs = Counter(pairs)
        for m in (0, 1):
            part = 1 if m == 0 or i in target else 0  # the text itself is held out
            total = sum(uni[m].values()) - uni[m][None] - part * len(pairs)
            for before, now in pairs:
                word = (uni[m][now] - part * own[now] + 1) / (total + kinds + 1)
                loss[m] -= math.log((bi[m][before, now] - part * own_pairs[before, now] + 5 * word) / (uni[m][before] - part * own[before] + 5))
        n = max(len(pairs), 1)
        r = got[i]
        assert r["n_words"] == len(pairs) and np.allclose([r["background_loss"], r["target_loss"], r["difference"]], [loss[0] / n, loss[1] / n, (loss[1] - loss[0]) / n])
    assert got[len(texts) - 1]["background_loss"] < got[len(texts) - 3]["background_loss"]  # another copy is in the corpus
    assert lm_score.cross_entropy_difference(frame(spark, texts).limit(0), labels, lot, size).count() == 0


def greedy(word, pieces):
    n = i = 0
    longest = max(map(len, pieces))
    while i < len(word):
        i += next(k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in pieces)
        n += 1
    return n


def test_automaton_on_random_vocabularies():
    rnd = random.Random(8)
    for _ in range(60):
        pieces = {bytes([b]) for b in range(256)} | {bytes(rnd.choice(b"ab") for _ in range(rnd.randint(2, 6))) for _ in range(rnd.randrange(14))}
        machine = token_count.Automaton(sorted(pieces))
        for _ in range(60):
            word = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(25)))
            assert machine.count(word) == greedy(word, pieces)
    with pytest.raises(ValueError):
        token_count.Automaton([b"a"])


def test_token_counts(spark):
    path = vocabulary_file("byte_bpe_50k.tiktoken")
    pieces = set(token_count.read_pieces(path))
    texts = corpus(5) + ["x" * 5000]
    got = rows_of(token_count.token_counts(frame(spark, texts), path))
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        assert got[i] == {"doc_id": i, "n_bytes": len((t or "").encode()), "n_words": len(words), "n_tokens": sum(greedy(b" " + w, pieces) for w in words)}
    assert token_count.token_counts(frame(spark, texts).limit(0), path).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(50_000, 500), (40, 12), (16, 4), (7, 3)])
def test_bpe(spark, chunk, overlap):
    import tiktoken

    path = vocabulary_file("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("plain", pat_str=word_pattern(), mergeable_ranks=ranks, special_tokens={})
    texts = [*corpus(6), " " * 300, "\n \n" * 100 + "x", "w" * 400, "🙂" * 90, "it's " * 50]
    docs = frame(spark, texts)
    for r in bpe.round_trip(docs.union(docs.where("doc_id = 3")), path, word_pattern(), chunk, overlap).collect():
        text = texts[r["doc_id"]] or ""
        ids = plain.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), r["doc_id"]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), path, word_pattern(), chunk, overlap).count() == 0


def by_bits(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        up[root(a)] = root(b)
    return root


def test_simhash(spark):
    texts = corpus(7)
    got = rows_of(simhash.near_duplicates(frame(spark, texts)))
    fp = {i: by_bits(t) for i, t in enumerate(texts)}
    root = components(fp, [(i, j) for i in fp for j in fp if i < j and (fp[i] ^ fp[j]).bit_count() <= 2])
    least = {}
    for i in fp:
        least.setdefault(root(i), i)
    for i in fp:
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fp[i]:016x}", least[root(i)])
    kept = simhash.one_of_each(frame(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values()) and kept.columns == SCHEMA.replace(" bigint", "").replace(" string", "").replace(" double", "").split(", ")
    twice = frame(spark, ["a b c d", "a b c d"]).selectExpr("cast(null as bigint) doc_id", "* except (doc_id)")
    assert [r["component_id"] for r in simhash.near_duplicates(twice).collect()] == [None, None]
    assert simhash.near_duplicates(frame(spark, texts).limit(0)).count() == 0


def test_one_of_each_keeps_rows_without_an_id_and_texts_that_share_one(spark):
    rnd = random.Random(5)
    a, b, c, d, e = (" ".join(f"{x}{rnd.randrange(1000)}" for _ in range(80)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (None, c), (4, c), (7, d), (7, e), (7, e), (9, e), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in simhash.one_of_each(docs).collect())
    assert kept == sorted([(0, a), (0, b), (4, c), (7, d), (7, e), (0, "")])


@pytest.mark.parametrize(("node", "most"), [(3, simhash.MOST), (40, 30), (5000, 2)])
def test_trie_join(spark, node, most):
    """most: with few fingerprints for a pair of prefixes, those under one long prefix go down to the last levels."""
    rnd = random.Random(node)
    fps = {rnd.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1, 1, 1 << 63}
    fps |= {0xABCDEF0123 << 24 | rnd.getrandbits(9) for _ in range(120)}
    for f in list(fps)[:60]:
        for _ in range(3):
            for _ in range(rnd.choice([1, 2, 3])):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    rows = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "id bigint, fp bigint")
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = components(range(len(fps)), near)
    least = {}
    for i in range(len(fps)):
        least.setdefault(root(i), i)
    found = {r["node"]: r["component"] for r in connected(simhash.links(rows, 2, node, most)).collect()}
    assert all(found.get(i, i) == least[root(i)] for i in range(len(fps)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 199), (199, 200)]
    found = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 40)}, 200: 199}


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(spark, window):
    from tokenizers import Tokenizer

    path = vocabulary_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [*corpus(9), "Straße ÉCOLE naïve", "ﬁ ligature", "á éx", "İstanbul ΑΣ", "\x1c\x85x"]
    sources = ["big" if i % 3 else f"s{i}" for i in range(len(texts))]
    sources[5] = None
    docs = frame(spark, texts, sources)
    rows = packing.pack(docs, path, 2, window).collect()
    pieces, sequences, totals = defaultdict(list), defaultdict(list), Counter()
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        totals[r["source"]] += r["length"]
    n = sum(totals.values())
    for i, t in enumerate(texts):
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and part
            at += r["length"]
        assert at == len(ids)
    assert sorted(sequences) == list(range(-(-n // window)))
    for number, parts in sequences.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == min(window, n - number * window)
        for s in totals:
            assert abs(sum(r["length"] for r in parts if r["source"] == s) - at * totals[s] / n) <= 2 + len(totals) / 2
    assert packing.pack(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("weights", [None, [1, 1, 1, 1, 1], [7, 1, 2, 50, 3]])
def test_schedule_is_a_round_robin_by_deficit(weights):
    for sizes in ([1], [5, 5], [100, 1, 7, 3, 50], [1, 1, 1, 1000]):
        own = weights[: len(sizes)] if weights else sizes
        turns = sorted((Fraction(2 * x + 1, 2 * own[s]), s) for s, t in enumerate(sizes) for x in range(t))
        plan = packing.Schedule(sizes, 4, weights and own)
        for w in range(sum(sizes) // 4 + 2):
            assert plan.sent(w) == [sum(s == q for _, s in turns[: 4 * w]) for q in range(len(sizes))]
        for place, (due, s) in list(enumerate(turns))[::7]:
            assert plan.first(s, int(due * own[s])) == place // 4


def test_packing_to_target_shares(spark):
    texts, sources = ["word " * 40] * 60, ["a"] * 30 + ["b"] * 20 + ["c"] * 10
    rows = packing.pack(frame(spark, texts, sources), vocabulary_file("word_bpe_49k.json"), 2, 64, {"a": 0.25, "b": 0.5, "c": 0.25}).collect()
    sent, totals = defaultdict(Counter), Counter()
    for r in rows:
        sent[r["sequence_id"]][r["source"]] += r["length"]
        totals[r["source"]] += r["length"]
    assert totals == {"a": 30 * 41, "b": 20 * 41, "c": 10 * 41}
    for w in range(20 * 41 * 2 // 64):  # until b has run dry
        assert abs(sent[w]["a"] - 16) <= 2 and abs(sent[w]["b"] - 32) <= 2 and abs(sent[w]["c"] - 16) <= 2
    assert [sum(sent[w].values()) for w in sorted(sent)][:-1] == [64] * (len(sent) - 1)
    with pytest.raises(ValueError):
        packing.pack(frame(spark, texts, sources), vocabulary_file("word_bpe_49k.json"), shares={"a": 0.0})


def test_packing_of_very_many_sources(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 5)
    texts = [f"text {i}" for i in range(40)]
    rows = packing.pack(frame(spark, texts, [f"s{i}" for i in range(40)]), vocabulary_file("word_bpe_49k.json"), 2, 16, {"s3": 0.5}).collect()
    assert {(r["doc_id"], r["source"]) for r in rows} == {(i, f"s{i}") for i in range(40)}
    assert sorted((r["sequence_id"], o) for r in rows for o in range(r["offset"], r["offset"] + r["length"])) == [divmod(x, 16) for x in range(sum(r["length"] for r in rows))]


def test_neighbours(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(12, 16))
    x = (centres[rnd.integers(0, 12, 900)] + 0.5 * rnd.normal(size=(900, 16))).astype(np.float32)
    x[300:420] = x[300]  # a common vector, at queries too
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] * 16, 0), (5300, [None] * 16, 0), (5400, [1.0], 0), (5500, [], 0), (None, x[0].tolist(), 0), (3, x[3].tolist(), 0)]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int")
    got = defaultdict(list)
    for r in ann.neighbours(table).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        exact = np.lexsort((np.arange(900), d))[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(s - d[i]) < 1e-12 for _, i, s in found)
        assert found == sorted(found, key=lambda f: (f[2], f[1]))
        hits += len({i for _, i, _ in found} & set(exact.tolist()))
        if q in (300, 400):
            assert [i for _, i, _ in found] == exact.tolist()
    assert hits >= 0.9 * 90
    assert ann.neighbours(table.limit(0)).count() == 0
    few = {(r["query_id"], r["vec_id"]) for r in ann.neighbours(table.where("vec_id < 4")).collect()}
    assert few == {(0, 1), (0, 2), (0, 3)}


def test_very_long_texts_and_clashing_names(spark):
    rnd = random.Random(21)
    long = " ".join(rnd.choice(["river", "stone", "walk"]) + str(rnd.randrange(5000)) for _ in range(200_000))
    docs = frame(spark, [long, long + " end", "a b c d", "x" * 1_000_000, None]).withColumns({c: F.lit(1) for c in ("labelled", "body", "quality", "fp", "good", "order", "x", "n")})
    labels = spark.createDataFrame([(0, 1), (2, 0), (3, 0)], "doc_id bigint, quality int").withColumns({c: F.lit("?") for c in ("labelled", "text", "body", "n")})
    assert [r["doc_id"] for r in quality_gam.quality(docs, labels).orderBy("doc_id").collect()] == [0, 1, 2, 3, 4]
    scored = rows_of(lm_score.cross_entropy_difference(docs, labels))
    assert [scored[i]["n_words"] for i in range(5)] == [200_000, 200_001, 4, 1, 0]
    prints = rows_of(simhash.near_duplicates(docs))
    assert prints[0]["fingerprint"] == f"{by_bits(long):016x}" and prints[1]["component_id"] == 0


def test_neighbours_with_clashing_names(spark):
    x = np.random.default_rng(4).normal(size=(40, 8)).astype(np.float32)
    plain = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    clashing = plain.withColumns({c: F.lit(7) for c in ("v", "entry", "ids", "query", "query_id", "leaf", "tree", "score", "rank", "h1", "r")})
    assert sorted(map(tuple, ann.neighbours(clashing).collect())) == sorted(map(tuple, ann.neighbours(plain).collect()))


def test_neighbours_count_repeated_rows_once(spark):
    x = np.random.default_rng(2).normal(size=(30, 8)).astype(np.float32)
    x[:14] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1, x[1].tolist())] * 20
    found = ann.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(i, i, 0.0) for i in range(1, 11)]


def test_neighbours_search_as_many_leaves_as_recall_takes(spark):
    """Vectors without structure in so many leaves that ann.LEAVES of them hold a small part of the table."""
    x = np.random.default_rng(3).normal(size=(3000, 48)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    hits = 0
    for r in ann.neighbours(table, trees=4, leaf=4).collect():
        d = ((x.astype(float) - x[r["query_id"]].astype(float)) ** 2).sum(1)
        d[r["query_id"]] = np.inf
        hits += r["vec_id"] in np.argpartition(d, 10)[:10]
    assert hits >= 0.9 * 300


@pytest.mark.parametrize("length,slice_,ranges", [(400, 1 << 18, 1_000_000), (400, 500, 40), (230, 700, 100), (42, 60, 30)])
def test_suffix_dedup(spark, monkeypatch, length, slice_, ranges):
    for name, value in (("SLICE", slice_), ("RANGE", ranges), ("LOT", 3 * ranges)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rnd = random.Random(length + slice_)
    text = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passage_text = text(900)
    texts = [*corpus(10), text(300) + passage_text, passage_text + text(200), text(50) + passage_text[100:700] + text(20) + passage_text[300:690], "ab" * 700, "ab" * 250, "xyz" * 100, passage_text[:350], passage_text]
    texts += [text(20) + passage_text[:k] + text(3) + passage_text[k:] for k in range(0, 900, 90)]
    docs = frame(spark, texts)
    docs = docs.union(docs.where("doc_id in (2, 60)")).union(docs.where("doc_id = 3").selectExpr("cast(null as bigint) doc_id", "* except (doc_id)"))
    bodies = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]

    def covered(n):
        starts = Counter(b[i : i + n] for _, b in bodies for i in range(len(b) - n + 1))
        for d, b in bodies:
            gone = np.zeros(len(b), bool)
            for i in range(len(b) - n + 1):
                if starts[b[i : i + n]] > 1:
                    gone[i : i + n] = True
            yield d, b, gone

    expected = []
    for d, b, gone in covered(length):
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        expected.append((repr(d), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    found = suffix_dedup.remove_repeats(docs, length).collect()
    got = [(repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found]
    assert sorted(got) == sorted(expected)
    kept = suffix_dedup.without_repeats(docs, length)
    assert kept.columns == docs.columns and kept.count() == len(bodies)
    assert sum(len((r["text"] or "").encode()) for r in kept.collect()) <= sum(n - g for _, n, g, _, _ in expected)
    assert suffix_dedup.remove_repeats(docs.limit(0), length).count() == 0


def test_marks_of_one_name_in_a_row_are_one(spark):
    texts = [f"{i} begins " + "word " * 1_000 + f"ends {i}" for i in range(3)]
    rows = suffix_dedup.keyed(frame(spark, texts).coalesce(1))
    found = suffix_dedup.marks(rows, 400, suffix_dedup.gram_of(400)).collect()
    plain = [suffix_dedup.marks_of(np.frombuffer(t.encode(), np.uint8), 400, suffix_dedup.gram_of(400)) for t in texts]
    assert min(len(name) for name, _, _ in plain) > 900 and len(found) < 30 and sum(r["known"] for r in found) >= 3
    for row, (name, low, high) in zip(rows.orderBy("doc_id").collect(), plain, strict=True):
        starts = {(int(x), at) for x, a, b in zip(name.view(np.int64), low, high, strict=True) for at in range(a, b + 1)}
        assert {(r["name"], at) for r in found if (r["k1"], r["k2"]) == (row["k1"], row["k2"]) for at in range(r["low"], r["high"] + 1)} == starts
    pieces = pa.RecordBatch.from_pydict({"sid": list(range(3)), "body": [t.encode() for t in texts], "ats": [np.arange(4_500, dtype=np.int32).tobytes()] * 3, "deep": [b""] * 3})
    names, sids, *_, still = (np.concatenate(x) for x in zip(*suffix_dedup.Cover(400).marks(pieces), strict=True))
    assert set(sids.tolist()) == {0, 1, 2} and len(names) < 30 and still.all()


def test_suffix_dedup_of_too_short_strings(spark):
    with pytest.raises(ValueError):
        suffix_dedup.without_repeats(frame(spark, ["a"]), suffix_dedup.LEAST - 1)


def test_cover_and_minima():
    for period, cover in suffix_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    rnd = np.random.default_rng(0)
    for n, width in ((50, 7), (7, 7), (200, 1), (64, 33)):
        v = rnd.integers(0, 9, n).astype(np.uint64) << np.uint64(40)
        assert suffix_dedup.leftmost_minima(v, width).tolist() == [i + int(v[i : i + width].argmin()) for i in range(n - width + 1)]
    data = np.frombuffer(b"abcabcabcabx", np.uint8)
    for size in (1, 2, 3, 5, 12):
        found = suffix_dedup.names(data, size)
        same = {(i, j) for i in range(len(found)) for j in range(i) if found[i] == found[j]}
        assert same == {(i, j) for i in range(len(found)) for j in range(i) if bytes(data[i : i + size]) == bytes(data[j : j + size])}


def test_packing_ids_of_whole_texts(monkeypatch):
    """Ids of texts that are put in lower case at once are the tokenizer's, also where frequent words outlive a full table; fewer words are met."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from kmerlake.llm import packing as P

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    words = ["The", "the", "THE", "Straße", "ÀÉÎ", "it's", "IT'S", "'LL", "3.5", "a1b2", "...", "ok,", "OK?!", "(x)", "naïve", "Ünder", "x" * 70]
    odd = ["H̱", "Å", "İ", "ΑΣ", "<|EndOfText|>", "<|endoftext|>", "a B", "a\u0085b", "x\x1cY", "×", "µ", "ª", "—", "日本", "\0"]
    rnd = random.Random(5)
    texts = ["", " ", *[rnd.choice([" ", "\n", "\t", "\x0b "]).join(rnd.choices(words, k=30)) for _ in range(60)], *[" ".join([*rnd.choices(words, k=5), x, *rnd.choices(words, k=5)]) for x in odd], *odd]
    for most in (400_000, 5):
        for kind in (P.Chunks, P.Pieces, P.Lowered):
            monkeypatch.setattr(kind, "MOST", most)
        known = P.Chunks(path)
        for text in texts:
            assert known.of(text.encode()) == b"".join(i.to_bytes(2, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids), text
        assert all(len(x) <= most for x in (known, known.pieces, known.lowered))
    known = P.Chunks(path)
    known.of(b"The the THE tHe")
    assert len(known) + len(known.lowered) == 1
