"""The pipeline's stages on the small tables, and the SQL of this subpackage's queries."""

import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from kmerlake.llm import line_dedup, passage_dedup, quality_gam, queries, simhash
from kmerlake.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, DATA, "labels").collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], ("drops", "cuts", "drops", "cuts"), strict=True):
        out = stage(spark, docs, DATA)
        assert out.columns == corpus_pipeline.COLUMNS
        out = corpus_pipeline.stored(out, "stage")
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.count() == len(after) and set(after) <= set(before)
        if expected == "cuts":
            assert set(after) == set(before) and all(len(after[i] or "") <= len(before[i] or "") for i in after)
            assert any(after[i] != before[i] for i in after)
        else:
            assert len(after) < len(before) and all(after[i] == before[i] for i in after)
        if name == "quality classifier":
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in after for i in good) >= 0.98 * len(good)
        if name == "SimHash near-dedup":
            groups = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
            assert set(after) == groups
        docs, before = out, after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in pieces} == set(before)
    assert all(sum(r["length"] for r in pieces if r["doc_id"] == i) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == i) for i in list(before)[:20])


STRINGS = dict(corpus_pipeline.STAGES)["suffix-array dedup"]


def documents(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


def test_string_stage_takes_passages_of_over_50_words_and_leaves_clean_texts(spark):
    rnd = random.Random(17)
    word = lambda low, high, letters="abcdefghijkl": "".join(rnd.choice(letters) for _ in range(rnd.randint(low, high)))
    prose = lambda n, low=2, high=8, letters="abcdefghijkl": " ".join(word(low, high, letters) for _ in range(n))
    passages = [prose(51), prose(53), prose(60), prose(90), prose(51, 1, 2), prose(51, 3, 9, "äöüß日本é")]
    assert len(passages[0]) < 400 and len(passages[4]) < 150
    long_words = prose(36, 6, 9)
    assert len(long_words) > 250
    texts, whole = [], []
    for i, p in enumerate(passages):
        for j in range(3):
            left, right, other = prose(80), prose(40), p.replace(" ", "\n\t", 2) if j == 2 else p
            texts.append([f"{left} {other}\n{right}", f"{left}\n{other} {right}", f"{other}  {right}", f"{left} {other} "][(i + j) % 4])
            whole.append([f"{left}\n{right}", f"{left}\n{right}", right, f"{left} "][(i + j) % 4])
    clean = [prose(n) for n in (1, 60, 150, 400)] + ["", None, "short line\nshort line", " \n "] + [f"{prose(30)} {long_words} {prose(20)}" for _ in range(3)]
    clean += [f"{prose(20)} {passages[0].rsplit(' ', 1)[0][: -len(passages[0].split()[-2])]}x {prose(5)}"] + [prose(50, 1, 3, "xyz")] * 2
    after = {r["doc_id"]: r for r in STRINGS(spark, documents(spark, texts + clean), DATA).collect()}
    for i, text in enumerate(whole + clean):
        assert after[i]["text"] == text and after[i]["n_chars"] == (len(text) if text is not None else None), i


def test_passages_by_brute_force(spark):
    """Short passages in texts of few words, against all windows; repeated rows, repeats in one text, and columns with names that the operator uses."""
    rnd = random.Random(18)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 60))) + rnd.choice(["", " ", "\n"]) for _ in range(40)] + ["a " * 40, "x y " * 9, "", None]
    texts += texts[:2]
    rows = [(i % 44 if i % 7 else None, t, i, 1, "k", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, copies int, kept int, k1 string, __starts string").repartition(3)
    n = 9
    windows = Counter(tuple(w[i : i + n]) for w in ((t or "").split() for t in texts) for i in range(len(w) - n + 1))
    found = {r["copies"]: r["text"] for r in passage_dedup.without_passages(docs, n).collect()}
    assert passage_dedup.without_passages(docs, n).columns == docs.columns and len(found) == len(texts)
    for i, t in enumerate(texts):
        words = (t or "").split()
        gone = {k for j in range(len(words) - n + 1) if windows[tuple(words[j : j + n])] > 1 for k in range(j, j + n)}
        assert (found[i] or "").split() == [w for j, w in enumerate(words) if j not in gone] and (t is None) == (found[i] is None)
        assert gone or found[i] == t
    assert passage_dedup.without_passages(docs.limit(0), n).count() == 0


def test_stages_with_nulls_repeated_rows_clashing_names_and_no_rows(spark):
    docs = table(spark, DATA, "documents").limit(60)
    odd = docs.limit(3).selectExpr("cast(null as bigint) doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "n_chars")
    docs = docs.union(odd).union(docs.limit(2)).selectExpr("*", "1 quality_kept", "2 lines_gone", "3 copies", "4 kept", "5 component")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() > 0 and stage(spark, docs.limit(0), DATA).count() == 0
    assert [r["lines_gone"] for r in line_dedup.without_repeated_lines(docs).collect()] and quality_gam.score(docs, quality_gam.train(docs, table(spark, DATA, "labels"))).where("quality_kept").count() >= 0


def test_run_writes_and_returns_pieces(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and "sequence_id" in out.columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for view in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{DATA}/{view}.parquet'")
    got = queries.queries()[name](spark, DATA)
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(found.fetchall())


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.queries()} <= names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
