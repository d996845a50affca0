"""Line dedup against a plain fold over all runs, and against its SQL."""

import random

import duckdb
import pytest
from chronofold.llm import linedup

DOCS = "doc_id long, text string, n_chars long, ln int, d string"


def brute(docs, min_words):
    """Lines left of each document: a line goes if some run around it, of enough words, occurred before."""
    lines = {d: [(n, x.strip(" \t\r")) for n, x in enumerate((t or "").split("\n")) if x.split()] for d, t in docs}
    seen, gone = {}, {d: set() for d, _ in docs}
    for d in sorted(lines):
        own = [x for _, x in lines[d]]
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                if sum(len(x.split()) for x in own[i:j]) >= min_words:
                    seen.setdefault(tuple(own[i:j]), []).append((d, i, j))
    for places in seen.values():
        for d, i, j in sorted(places)[1:]:
            gone[d] |= {lines[d][k][0] for k in range(i, j)}
    return {d: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, t in docs}


def corpus(seed, n=40):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(25)]
    docs = []
    for i in range(n):
        lines = [rng.choice(["", "  ", rng.choice(pool) + " \r", rng.choice(pool), f"u{rng.random()}"]) for _ in range(rng.randrange(12))]
        if docs and rng.random() < 0.4:
            other = docs[rng.randrange(len(docs))][1].split("\n")
            a = rng.randrange(len(other))
            lines[rng.randrange(len(lines) + 1) : 0] = other[a : a + rng.randrange(8)]
        docs.append((i * 2, "\n".join(lines)))
    return docs + [(901, None), (902, ""), (903, " \n ")]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("min_words", [1, 5, 12])
def test_same_as_all_runs(spark, seed, min_words):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, len(t or ""), 0, "clash") for d, t in docs], DOCS).repartition(3)
    marked = linedup._with_marks(df.select("doc_id", "text"), min_words)
    got = {r["doc_id"]: r["left"] for r in marked.select("doc_id", linedup.left_over().alias("left")).collect()}
    assert got == brute(docs, min_words)
    kept = linedup.deduplicated(df, min_words)
    assert kept.columns == df.columns
    changed = {d: t for d, t in got.items() if t != dict(docs)[d]}
    for r in kept.collect():
        assert r["text"] == got[r["doc_id"]]
        if r["doc_id"] in changed:
            assert r["n_chars"] == len(r["text"]) and r["text"].split()
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {d for d, t in got.items() if d not in changed or t.split()}


def test_sql(spark, tmp_path):
    docs = corpus(5, 60) + [(1000 + i, "\n".join(["x y z"] * 12 + [f"own {i}"])) for i in range(3)]
    df = spark.createDataFrame([(d, t, 0, 0, "") for d, t in docs], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, linedup.op4_suffix_line_dedup(spark, str(tmp_path)).select("doc_id", "lines", "deleted", "text").collect()))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted((r[0], r[1], r[2], r[3]) for r in c.execute(f"select doc_id, lines, deleted, text from ({linedup.OP4_SQL})").fetchall())
    assert [(a, b or -1, c, t) for a, b, c, t in got] == [(a, b or -1, c, t) for a, b, c, t in want]
    assert sum(r[2] for r in got) > 10


def test_edges(spark):
    assert linedup.deduplicated(spark.createDataFrame([], DOCS)).count() == 0
    run = "\n".join(f"line {i} of a passage" for i in range(20))
    rows = [(None, run, 1, 0, ""), (1, run, 1, 0, ""), (1, run, 1, 0, ""), (2, "own words\n" + run, 1, 0, ""), (3, run + "\n" + run, 1, 0, "")]
    got = linedup.deduplicated(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] == run, r["text"]) for r in got) == [(0, True, run), (2, False, "own words")]


def test_long_document(spark):
    text = "\n".join(f"line {i % 3000} with some more words" for i in range(6000))
    got = linedup.deduplicated(spark.createDataFrame([(1, text, 0, 0, "")], DOCS)).first()
    assert got["text"] == "\n".join(text.split("\n")[:3000])


@pytest.mark.parametrize("seed", [3, 4])
def test_later_runs_are_the_longest_common_prefixes(spark, seed):
    """Of every suffix the longest prefix that an earlier suffix has too, by comparing all pairs; and ranks are intervals."""
    rng = random.Random(seed)
    docs = {d: [rng.choice("abc") for _ in range(rng.randrange(1, 30))] for d in range(12)}
    docs[20] = docs[3] + docs[5]
    docs[21] = ["a"] * 40
    df = spark.createDataFrame([(d, "\n".join(x), 0, 0, "") for d, x in docs.items()], DOCS)
    levels = linedup.suffix_ranks(linedup.lines_of(df.select("doc_id", "text")).distinct())
    got = {(r["d"], r["i"]): r["length"] for r in linedup.later_runs(levels).collect()}

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    suffixes = [(d, i, x[i:]) for d, x in sorted(docs.items()) for i in range(len(x))]
    want = {}
    for k, (d, i, s) in enumerate(suffixes):
        longest = max((common(s, t) for _, _, t in suffixes[:k]), default=0)
        if longest:
            want[d, i] = longest
    assert got == want and max(want.values()) > 20
    for k, level in enumerate(levels):  # of one rank: the first 2^k lines alike; ranks in the order of the suffixes before
        ranks = {(r["d"], r["i"]): (r["rank"], tuple(r["first"])[0], r["first"]["i"]) for r in level.collect()}
        heads = {(d, i): tuple(s[: 1 << k]) for d, i, s in suffixes if len(s) >= 1 << k}
        by_rank, by_head = {}, {}
        for at, (rank, *_) in ranks.items():
            by_rank.setdefault(rank, set()).add(at)
        for at, head in heads.items():
            by_head.setdefault(head, set()).add(at)
        assert sorted(map(sorted, by_rank.values())) == sorted(sorted(v) for v in by_head.values() if len(v) > 1)
        assert all((f, j) == min(by_rank[rank]) for rank, f, j in ranks.values())
        starts = sorted((rank, len(v)) for rank, v in by_rank.items())
        assert all(a + n <= b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))  # intervals of places, apart from each other
