import numpy as np
import pytest

import __spark_entry__ as e
from tests.test_entry import SF, against


@pytest.mark.parametrize("name", ["op1_chat_tree", "op2_topk", "op3_ngram_join", "op7_warc", "op9_licenses"])
def test_query_equals_its_sql(spark, name):
    got, expected = against(spark, name)
    assert got == expected and got


def test_pipeline_stages(spark):
    from allelia.llm import pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0.5 * last < docs.count() <= last
        last = docs.count()
    packed = p.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == last
    assert set(e.queries()) >= {
        f"op{n}_{x}" for n,
        x in ((3, "ngram_join"), (4, "langid"), (5, "decontaminate"), (6, "quality"), (8, "secrets"), (10, "packing"))
    } | {"pipeline"}


def test_near_copies_keep_one_of_each(spark):
    from allelia.llm import pipeline as p

    base = "a b c d e f g h i j k l m n o p q r s t"
    rows = [
        (1, base), (2, base), (2, base), (3, base + " u"), (4, "other words that are not the same at all"),
        (4, "other words that are not the same at all"), (5, None), (5, None), (None, "x"), (None, "x"), (6, "")
    ]
    docs = spark.createDataFrame(
        [(i, t, "l", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    kept = p.near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 4, 5, 6, None, None], key=repr)


def test_near_copies_judge_each_text_of_an_id(spark):
    from allelia.llm import pipeline as p

    a, b, c = ("a1 b1 c1 d1 e1 f1 g1 h1 i1 j1 k1 l1", "a2 b2 c2 d2 e2 f2 g2 h2 i2 j2 k2 l2", "a3 b3 c3 d3 e3 f3 g3 h3 i3 j3 k3 l3")
    long = " ".join(f"w{i}" for i in range(40))
    rows = [
        (3, a), (5, a), (5, b), (7, b), (9, b), (5, c), (20, long), (20, long + " more"), (20, long), (None, a), (30, None),
        (30, "")
    ]
    docs = spark.createDataFrame(
        [(i, t, "l", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    got = sorted(((r["doc_id"], r["text"]) for r in p.near_copies(spark, docs, SF).collect()), key=repr)
    twenty = [x for x in got if x[0] == 20]
    assert len(twenty) == 1 and twenty[0] in rows
    assert [x for x in got if x[0] != 20] == sorted([(3, a), (5, b), (5, c), (None, a), (30, None), (30, "")], key=repr)


ODD = "doc_id long, text string, lang string, source string, n_chars long, _text string, _n int, _leaked int, _k0 long, tags map<string,int>"


def _odd(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, "a", 1, 2, 3, {"x": 1}) for i, t, lang in rows], ODD)


def test_pipeline_with_odd_rows_and_clashing_names(spark, tmp_path):
    import random

    from allelia.llm import pipeline as p

    rnd = random.Random(6)
    syllables = {"xa": "ba ko mi tu".split(), "xb": "ren sol vik dar".split()}
    text = lambda lang, n: " ".join("".join(rnd.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(["xa", "xb"] * 30)]
    leak, long = text("xa", 25), text("xb", 30_000)
    rows += [
        (100, None, "xa"), (101, "", None), (102, "12 . 34", "xb"), (103, long, "xb"), (104, long + " " + text("xb", 3), None),
        (None, text("xa", 30), None), (105, text("xa", 5) + " " + leak + " " + text("xa", 5), "xa")
    ]
    rows += [
        (3, rows[3][1], "xb"), (3, rows[3][1], "xb"), (106, rows[5][1], None),
        (107, text("xa", 20) + " password=hunter22 " + text("xa", 20), "xa"), (None, rows[7][1], "xb")
    ]
    _odd(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(
        [(1, leak), (2, None), (3, "")], "item_id long, text string"
    ).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = p.table(spark, tmp_path, "documents"), []
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [x.split()[0] for x in ODD.replace("string,int", "").split(", ")]
        seen.append(sorted((r["doc_id"] for r in docs.collect()), key=repr))
    wordless, copies = {100, 101, 102}, [104, 106]
    assert seen[0] == sorted((i for i, _, _ in rows if i not in wordless), key=repr)
    kept = [i for i, _, _ in rows if i not in wordless and i not in copies]
    kept.remove(3)
    kept.remove(3)
    assert seen[1] == sorted(kept, key=repr)
    assert seen[2] == seen[3] == sorted((i for i in kept if i != 105), key=repr)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert "hunter22" not in texts[107] and "[SECRET]" in texts[107] and texts[103] == long
    packed = p.run(spark, str(tmp_path))
    assert sorted({r["doc_id"] for r in packed.collect()}, key=repr) == sorted(set(seen[3]), key=repr)


def test_pipeline_of_nothing_and_without_labels(spark, tmp_path):
    from allelia.llm import pipeline as p

    for name, rows in (
        ("none", []), ("unlabelled", [(1, "some words that stand here alone", None), (2, None, None), (3, "...", None)])
    ):
        _odd(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        assert {r["doc_id"] for r in p.run(spark, f"{tmp_path}/{name}").collect()} == ({1} if rows else set())


def test_pipeline_near_copies_against_brute_force(spark):
    from allelia.llm import pipeline as p
    from tests.llm.test_operators import brute_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stays = {i for i, n, c in brute_join(rows, p.WORDS, p.PERCENT) if n == 0 or i == c}
    assert {r["doc_id"] for r in p.near_copies(spark, docs, SF).collect()} == stays and len(stays) < len(rows)


def test_pipeline_near_copies_shuffles_no_text_that_stays(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from allelia.llm import common
    from allelia.llm import pipeline as p

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)  # as if more ids than may be broadcast were wanted, and went
    rnd = random.Random(6)
    rows = [(k, " ".join(rnd.randbytes(500).hex() for _ in range(12))) for k in range(300)]
    rows += [(1000, rows[0][1]), (1001, rows[1][1] + " x"), (None, rows[2][1]), (None, "a"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("more", F.lit(1)).coalesce(2)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = p.near_copies(spark, docs, "").select("doc_id", "text").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(repr, map(tuple, got))) == sorted(
        map(repr, [r for i, r in enumerate(rows) if i < 300 or r[0] is None])
    )
    assert written() - before < 0.4 * sum(len(t) for _, t in rows)


def test_rows_that_go_are_not_shuffled_either(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from allelia.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 20)
    rnd = random.Random(7)
    rows = [(k if k % 9 else None, rnd.randbytes(3000).hex()) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("t", F.xxhash64("text")).coalesce(2)
    gone = common.materialize(docs.where("doc_id % 10 > 0 OR doc_id IS NULL").select(F.col("doc_id").alias("i"), "t"), "gone")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    got = common.without(docs, gone, ["doc_id", "t"]).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[0] is not None and r[0] % 10 == 0)
    assert written() - before < 0.1 * sum(len(t) for _, t in rows)
    # all pass a sieve of one bit: those that have no match stay, though there are more than may be broadcast
    monkeypatch.setattr(common, "sifted", lambda bits, numbers: np.ones(len(numbers), bool))
    got = common.without(docs, gone, ["doc_id", "t"]).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[0] is not None and r[0] % 10 == 0)


def test_a_sieve_tells_what_is_not_in_it(spark):
    from allelia.llm import common

    held = common.sieve(spark.createDataFrame([(k * k - 50,) for k in range(3000)] + [(None,)], "a long")).value
    assert common.sifted(held, np.arange(3000) ** 2 - 50).all()
    assert common.sifted(held, np.arange(10**7, 10**7 + 20_000)).mean() < 0.01


def test_pipeline_decontaminated_against_brute_force(spark):
    from allelia.llm import pipeline as p
    from tests.llm.test_operators import brute_leaks

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 500")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = {d for d, _ in brute_leaks(rows, items)}
    assert {r["doc_id"] for r in p.decontaminated(spark, docs, SF).collect()} == {d for d, _ in rows} - found
