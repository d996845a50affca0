"""The pipeline: planted cases are caught, clean documents stay, columns pass through."""

import random

import corpus_pipeline
import pytest


def planted(path, spark):
    rng = random.Random(8)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(500)]

    def text(k):
        return "\n".join(" ".join(rng.choices(words, k=12)) + "." for _ in range(k))

    clean = {i: text(8 if i < 10 else rng.randrange(3, 12)) for i in range(300)}  # the first ten get near copies
    junk = {1000 + i: " ".join([rng.choice(words)] * 80) for i in range(80)}
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(10)]
    leaks = {2000 + i: text(3) + "\n" + items[i][1] + "\n" + text(2) for i in range(10)}
    near = {}
    for i in range(10):
        own = clean[i].replace("\n", " ").split()
        own[5] = "edited"
        near[3000 + i] = " ".join(own)
    passage = " ".join(rng.choices(words, k=60))
    shared = {4000 + i: text(3) + "\n" + passage + "\n" + text(3) for i in range(12)}
    clean_flat = {i: (t.replace("\n", " ") if i < 10 else t) for i, t in clean.items()}
    docs = clean_flat | junk | leaks | near | shared
    rows = [(i, t, "xx", "s", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 1000), 0) for i in [*clean, *junk] if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return clean_flat, junk, leaks, near, shared, passage


def test_stages(spark, tmp_path):
    clean, junk, leaks, near, shared, passage = planted(str(tmp_path), spark)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{n}")
        docs = spark.read.parquet(f"{tmp_path}/out{n}")
        if n < 4:
            assert docs.columns == columns
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    first, lines, groups, left, packed = seen.values()
    assert not set(junk) & set(first) and len(set(clean) & set(first)) >= 0.99 * len(clean)
    assert sum(passage in r["text"] for r in lines.values()) == 1 and set(shared) & set(first) == set(shared) & set(lines)
    assert not set(near) & set(groups) and set(clean) & set(lines) == set(clean) & set(groups)
    assert not set(leaks) & set(left) and set(clean) & set(groups) == set(clean) & set(left)
    assert set(packed) == set(left)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()) == sorted(packed)


def test_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert found["pipeline"] is corpus_pipeline.run
    assert [sum(q.startswith(f"op{n}_") for q in found) for n in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(found)


@pytest.mark.parametrize("n", range(5))
def test_empty_documents(spark, tmp_path, n):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.STAGES[n][1](spark, docs, str(tmp_path)).count() == 0


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, against the plain versions of the operators' own tests."""
    import zlib

    import numpy as np
    import test_decontaminate
    import test_linedup
    import test_neardup
    import test_quality
    from chronofold.llm import packing, quality

    planted(str(tmp_path), spark)
    docs, items = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tmp_path}/labels.parquet").collect()}
    now = {r["doc_id"]: r["text"] for r in docs.collect()}

    def step(n):
        nonlocal docs
        out = corpus_pipeline.STAGES[n][1](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/step{n}")
        docs = spark.read.parquet(f"{tmp_path}/step{n}")
        return docs.collect()

    train = sorted(i for i in known if zlib.crc32(str(i).encode()) % 5)
    statistics = {i: test_quality.plain_statistics(t) for i, t in now.items()}
    model = quality.Model(np.array([statistics[i] for i in train]), np.array([float(known[i]) for i in train]))
    score = {i: model.intercept + sum(w for rule, w in model.rules if all((x[c] > at) == above for c, above, at in rule)) for i, x in statistics.items()}
    now = {i: t for i, t in now.items() if 1 / (1 + np.exp(-score[i])) >= 0.3}
    assert {r["doc_id"]: r["text"] for r in step(0)} == now

    left = test_linedup.brute(sorted(now.items()), 25)
    now = {i: t for i, t in left.items() if t == now[i] or t.split()}
    assert {r["doc_id"]: r["text"] for r in step(1)} == now

    groups = test_neardup.components(sorted(now.items()))
    now = {i: t for i, t in now.items() if groups[i] == i}
    assert {r["doc_id"]: r["text"] for r in step(2)} == now

    held = test_decontaminate.brute(now.items(), [(r["item_id"], r["text"]) for r in items])
    now = {i: t for i, t in now.items() if i not in {d for d, _ in held}}
    assert {r["doc_id"]: r["text"] for r in step(3)} == now

    exact = packing.Encoder("byte_bpe_50k.json", None)
    lengths = {i: len(exact(t.encode())) + 1 for i, t in now.items()}
    packed = step(4)
    assert {r["doc_id"]: r["length"] for r in packed} == lengths  # none is longer than a sequence here
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(own[-1]) <= 2048


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, empties, repeats and columns named like the stages' own go through all stages."""
    planted(str(tmp_path), spark)
    more = "__keep boolean, __score double, rep string, matches int, ln int, th long, label int, kept boolean"
    base = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = spark.createDataFrame([(None, "a line of its own", "xx", "s", 17), (None, None, None, None, None), (7000, None, "xx", "s", 0), (7001, "", "xx", "s", 0), (7002, "\n\n", "xx", "s", 2), (7003, "same words here", "xx", "s", 15), (7003, "same words here", "xx", "s", 15)], base.schema)
    docs = base.unionByName(odd).selectExpr("*", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in more.split(", ")])
    columns = docs.columns
    accepted = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))  # texts without words score as the model says: let all go on here
    assert accepted.columns == columns and accepted.filter("doc_id = 7003").count() in (0, 2)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[1:], 1):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/odd{n}")
        docs = spark.read.parquet(f"{tmp_path}/odd{n}")
        if n < 4:
            assert docs.columns == columns
            assert docs.filter("doc_id is null or doc_id >= 7000").count() == 7  # no copies of other documents, no benchmark text
    assert docs.filter("doc_id is null").count() == 2 and docs.filter("doc_id = 7003").count() == 2
    assert {r["length"] for r in docs.filter("doc_id in (7000, 7001)").collect()} == {1}
