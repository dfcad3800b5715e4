"""Conversation repair, pattern packing and the divergence audit against direct computations."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kmerlake.llm import conversation_repair as repair
from kmerlake.llm import divergence
from kmerlake.llm import pattern_packing as packing
from kmerlake.llm.queries import vocabulary_file

# ---------------------------------------------------------------- conversations

LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(signs):
    """(cost, edits) by trying all edits from the last row on; whole strings are compared."""
    best = {}
    for i in range(len(signs), -1, -1):
        for inserted in (3, 2, 1, 0):
            for state, step in (("-", "su"), ("s", "u"), ("u", "a"), ("a", "u")):
                out = [(0, "")] if i == len(signs) and state in "-a" else []
                tries = []
                if inserted < 3:
                    tries += [(2, "I", best[i, x, inserted + 1]) for x in step.replace("s", "")]
                if i < len(signs):
                    tries.append((3, "D", best[i + 1, state, 0]))
                    if signs[i] != "D":
                        more = signs[i].isupper()
                        tries += [(more, "K", best[i + 1, x, 0]) for x in step if x == signs[i].lower()]
                        tries += [(2 + more, "R", best[i + 1, x, 0]) for x in step if x != "s"]
                best[i, state, inserted] = min([*out, *((c + cost, edit + e) for c, edit, (cost, e) in tries)], default=(10**9, ""))
        for key in [k for k in best if k[0] == i + 2]:
            del best[key]
    return best[0, "-", 0]


def test_composition_finds_the_cheapest_edits_however_rows_are_cut():
    rnd, machine = random.Random(1), repair.Composition()
    for n in range(400):
        signs = "".join(rnd.choice("suaoSUAOD") for _ in range(rnd.randint(0, 12 if n < 380 else 200)))
        cuts = sorted(rnd.randint(0, len(signs)) for _ in range(rnd.randint(0, 3)))
        parts = [signs[a:b] for a, b in zip([0, *cuts], [*cuts, len(signs)], strict=True)]
        cost, edits = repair.composed([{s: machine.weights(p, s) for s in range(4)} for p in parts])
        assert (cost, "".join(e for _, e in edits)) == cheapest(signs), signs
    assert len(machine.steps) < 20_000  # profiles are few, however long conversations are


def expected(rows):
    """The audit of rows (conv_id, turn, role, text) after damage, by conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, signs, counts = set(), "", Counter()
        for _, _, role, text in own:
            stem = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not stem else "duplicate" if (role, text) in seen else "truncated" if stem[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            initial = role[:1] if role[:1] in {"s", "u", "a"} else "o"
            signs += "D" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        counts["illegal"] = sum(a[2][:1] + b[2][:1] not in {"su", "ua", "au"} for a, b in zip(own, own[1:], strict=False))
        turns = {t for has, t, *_ in own if has}
        cost, edits = cheapest(signs)
        kept, i = [], 0
        for e in edits:
            role, text = own[i][2:] if e != "I" else ("", "")
            i += e != "I"
            if e in "RI":
                first_is_system = bool(kept) and kept[0][0].startswith("s")
                role = "user" if (len(kept) - first_is_system) % 2 == 0 else "assistant"
            if e != "D":
                kept.append((role, text))
        assert LEGAL.fullmatch("".join(r[0] for r, _ in kept))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, edits, kept)
    return out


def test_repair_with_awkward_rows(spark):
    rnd = random.Random(2)
    text = lambda: rnd.choice(["Yes.", "No", "", " \t", "Why?", "é!\n", "a:b\nc. ", "x" * 5000 + "."]) + rnd.choice(["", " More.", " ok", "."])
    rows = [(rnd.choice([1, 2, 3, None, -5]), rnd.choice([None, *range(12)]), rnd.choice(["user", "assistant", "system", "tool", "", None, "user"]), rnd.choice([None, text(), text()])) for _ in range(300)]
    rows += [(7, t, ("user", "assistant")[t % 2], f"line {t}" + "." * (t % 5 > 0)) for t in range(900)] + [(8, 1, "user", "same.")] * 40 + [(9, None, None, None)]
    frame = spark.createDataFrame([(*r, 0, "s", 1, "w") for r in rows], "conv_id bigint, turn bigint, role string, text string, n int, sign string, at int, stretch string").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plain = frame.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("bigint").alias("copies"))
        ordered, found = repair.solved(plain)
        assert found.where("conv = 7").count() > 1  # a conversation in several tasks
        said = {r["conv_id"]: r for r in repair.audit(plain).collect()}
        kept = defaultdict(list)
        for r in repair.repair(frame).orderBy("at", "sub").collect():
            kept[r["conv_id"]].append((r["role"], r["text"]))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    wanted = expected([(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows])
    assert set(said) == set(wanted)
    for conv, (gaps, blank, duplicate, truncated, illegal, cost, edits, lines) in wanted.items():
        r = said[conv]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == (gaps, blank, duplicate, truncated, illegal, cost, edits)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest() and kept[conv] == lines


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(60) for t in range(3)] + [(None, None, None, None), (None, 3, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    left = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if kind == 4 else role or " ", "" if kind == 1 else re.sub("[.!?]", "", text or " ") if kind == 2 else text or " "
        left += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = {r["conv_id"]: r for r in repair.audit(repair.damaged(frame)).collect()}
    wanted = expected(left)
    assert set(got) == {c for c, *_ in rows}
    for conv, r in got.items():
        assert (r["gaps"], r["cost"], r["audit"]) == (wanted[conv][0], *wanted[conv][5:7]) if conv in wanted else (0, 0, "")
    none = repair.audit(repair.damaged(frame.where("conv_id = 1")).withColumn("copies", F.lit(0).cast("bigint"))).collect()
    assert [tuple(r) for r in none] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.audit(repair.damaged(frame.limit(0))).count() == 0 and repair.repair(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- packing


def test_patterns_fill_sequences(spark):
    path = vocabulary_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["river", "stönes", "Walk!", "\n\n", "12345"]) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    texts += ["", None, "a<|endoftext|>b <|endoftext|>", "<|endo", "é" * 700, "日本語 🙂", " \n \t x", "word " * 400, "twice", "twice"]
    docs = spark.createDataFrame([(i if i % 50 else None, t, "n", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, length string, piece int").repartition(4)
    docs = docs.union(docs.where("doc_id = 3"))
    rows = packing.pack(docs, path, window=64, with_ids=True).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], ids.tolist(), r["doc_tokens"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in enumerate(texts):
        if i % 50 and i != 3:
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
            own = sorted(by_doc[i])
            assert sum((x[3] for x in own), []) == ids and [x[0] for x in own] == list(range(len(own)))
            assert all(x[4] == len(ids) for x in own) and (len(own) == 1 or len(ids) > 64 and all(x[2] == 64 for x in own[1:]) and own[0][2] == (len(ids) % 64 or 64))
    assert len(by_doc[3]) == 2 * len({x[0] for x in by_doc[3]}) and len({x[0] for x in by_doc[None]}) >= 1
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 64) + 2
    assert packing.pack(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_slots_take_every_piece_once_and_waste_little(seed):
    rnd = np.random.default_rng(seed)
    window = [50, 64, 200, 128][seed]
    lengths = np.clip(rnd.gamma(2.0, window / (3 + 4 * seed), 3000).astype(int) + 1, 1, window)
    counts = np.bincount(lengths, minlength=window + 1)
    rows = packing.patterns(counts, window)
    assert (rows.sum(1) == window).all() and len(np.unique(rows, axis=0)) == len(rows) and (np.diff(rows, axis=1) <= 0).all()
    x = packing.fitted(rows, counts)
    off = lambda y: (np.arange(window + 1) * (np.bincount(rows.ravel(), np.repeat(y, 3), window + 1) - counts) ** 2)[1:].sum()
    best = off(packing.fitted(rows, counts, 4000))
    assert (x >= 0).all() and best <= off(x) < best + 0.01 * off(np.zeros(len(rows))) < off(np.zeros(len(rows)))
    table = packing.slots(counts, window)
    filled, seen = Counter(), Counter()
    ranks = {v: [tuple(r) for r in table if r[0] == v] for v in range(1, window + 1)}
    spans = defaultdict(list)
    for v in range(1, window + 1):
        for rank in range(counts[v]):
            _, first, sequence, copies, offset = [r for r in ranks[v] if r[1] <= rank][-1]
            at = sequence + (rank - first) // copies
            spans[at].append((offset + (rank - first) % copies * v, v))
            seen[v] += 1
    for at, own in spans.items():
        for offset, v in sorted(own):
            assert offset == filled[at]
            filled[at] += v
    assert max(filled.values()) <= window and all(seen[v] == counts[v] for v in seen)
    alone = sum(n for _, n in packing.best_fit(counts, window))
    assert len(filled) <= 1.01 * alone + 1


# ---------------------------------------------------------------- audit


def test_audit_with_awkward_rows(spark):
    rnd = random.Random(4)
    words = ["Ärger", "the", "THE", "naïve", "x", "über", "日本", "a b", "cat", "dog", "e-mail", "it's", "k9"]
    rows = [(i, rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "c", None, "é"]), rnd.choice([None, "", " ".join(rnd.choice(words[: rnd.randint(1, 13)]) for _ in range(rnd.randint(0, 30)))])) for i in range(200)]
    rows += [(1, "fr", "a", "rare words only"), (2, "fr", "z", None), rows[5], rows[5]]
    frame = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "doc_id bigint, lang string, source string, text string, term string, n int, value int").repartition(4)
    least = 20
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, lang, source, text in rows:
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in term.findall(text or "")]
        df[lang or ""].update(set(found))
        n[lang or "", source or ""].update(found)
        groups.add((lang or "", source or ""))
    wanted = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, c in df[lang].items() if c >= least]
        sources = [s for x, s in groups if x == lang]
        p = {}
        whole = Counter()
        for s in sources:
            total = sum(n[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (n[lang, s][t] + 5) // (total + 5 * len(kept)) for t in kept}
            whole.update(n[lang, s])
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(whole[t] for t in kept) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            more = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, own in (("pair", pairs), ("term", more)):
                own.sort(key=lambda x: (-x[0], x[1].encode()))
                wanted |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(own[: 3 if part == "term" else None], 1)}
    got = divergence.audit(frame, least, 3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and {tuple(r) for r in got.collect()} == wanted
    assert any(x[2] == "term" for x in wanted) and divergence.audit(frame.limit(0)).count() == 0
    held = divergence.sketch(divergence.inputs(frame), least, divergence.BLOCK)
    for lang, c in df.items():
        if c:
            possible = held.possible(lang, [t.encode() for t in c])
            assert all(ok or v < least for ok, v in zip(possible, c.values(), strict=True)) and sum(possible) < len(c)


def test_sketch_adds_up_over_tasks_and_never_falls_short(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    docs = spark.createDataFrame([("en", f"s{i % 3}", f"all w{chr(97 + i % 7)} v{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(140)], "lang string, source string, text string").repartition(9)
    docs = docs.select("lang", "source", "text")
    held = divergence.sketch(docs, 20, divergence.BLOCK)
    assert held.possible("en", [b"all", *(b"w%c" % (97 + i) for i in range(7))]).all()
    rows = divergence.counted(docs, held).groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()
    assert {"all": 140}.items() <= {r["term"]: r["df"] for r in rows if r["df"] == r["n"]}.items() and len(rows) < 60
