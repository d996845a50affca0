"""Chat: reversible template, best paths against plain enumeration, and read-back digests."""

import hashlib
import random

from chronofold.llm import chat
from hypothesis import given, settings
from hypothesis import strategies as st

TURNS = "conv_id long, turn long, role string, text string, tree int, leaf string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("\\#<: /turn>\nAé🙂"), max_size=12), st.text(st.sampled_from("\\#<: /turn>\nAé🙂"), max_size=30)), max_size=5))
def test_template_is_reversible(turns):
    whole = "".join(chat.turn_text(r, t)[0] for r, t in turns)
    assert list(chat.turns_of(whole)) == turns
    at = 0
    for r, t in turns:
        text, start, stop = chat.turn_text(r, t)
        body = whole[at + start : at + stop]
        assert chat.unescape(body) == t and "</turn>" not in body and "###" not in body
        at += len(text)


def enumerate_paths(nodes):
    """tree -> [(mean score, length, leaf, path)], best first."""
    out = {}
    by = {(t, n): (p, s) for t, n, p, s in nodes}
    parents = {(t, p) for t, _, p, _ in nodes if p is not None}
    for t, n in by:
        if (t, n) in parents:
            continue
        path, at = [], n
        while at is not None and (t, at) in by and len(path) <= len(nodes):
            path.append(at)
            at = by[t, at][0]
        if len(path) <= len(nodes):
            scores = [by[t, x][1] for x in path]
            out.setdefault(t, []).append((-sum(scores) / len(scores), -len(path), n, path[::-1]))
    return {t: sorted(v) for t, v in out.items()}


def test_best_paths(spark):
    rng = random.Random(3)
    nodes = []
    for t in range(12):
        for n in range(1, rng.randrange(2, 40)):
            nodes.append((t, n, rng.choice([None] if n == 1 else [*range(max(1, n - 6), n)]), float(rng.randrange(-8, 9)) / 4))
    nodes += [(99, 1, 2, 0.0), (99, 2, 1, 0.0), (99, 3, 2, 0.0)]  # a cycle and what hangs on it
    nodes += [(None, 1, None, 1.0), (None, 2, 1, 1.0), (50, 4, 77, 1.0)]  # a null tree, a missing parent
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    want = enumerate_paths([x for x in nodes if x[0] != 99])
    for k in (1, 2, None):
        got = {}
        for r in chat.chosen_paths(df, k).collect():
            got.setdefault((r["tree"], r["leaf"]), []).append((r["place"], r["node"]))
        expected = {(t, leaf): path for t, v in want.items() for _, _, leaf, path in v[:k]}
        assert {key: [n for _, n in sorted(p)] for key, p in got.items()} == expected
        assert all([i for i, _ in sorted(p)] == list(range(1, len(p) + 1)) for p in got.values())


def digests(rows):
    turns = "".join(f"{r}\n{t}\n" for r, t in rows)
    loss = "".join(t for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_read_back(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd: #role"]), "".join(rng.choices("ab\\#</turn>é🙂\n:", k=rng.randrange(40))) if rng.random() < 0.95 else None) for c in range(30) for t in range(rng.randrange(1, 12))]
    rows += [(77, 0, "user", "hi"), (77, 0, "user", "hi"), (77, 0, "assistant", "tie"), (None, 3, "user", "x"), (None, None, "assistant", "first")]
    rows += [(88, t, "assistant" if t % 2 else "user", "long " * 50) for t in range(300)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], TURNS).repartition(4)
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] is not None, r[2], r[3] is not None, r[3]) if False else (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode())):
        want.setdefault(c, []).append((r or "", x or ""))
    for part in (1 << 24, 500):
        monkeypatch.setattr(chat, "PART_CHARS", part)
        whole = chat.formatted(chat.linear(df))
        got = {r["conv_id"]: r for r in chat.read_back(whole).collect()}
        assert set(got) == set(want)
        for c, r in got.items():
            assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests(want[c]), c
            assert r["formatted_chars"] == sum(len(chat.turn_text(a, b)[0]) for a, b in want[c])


def test_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert chat.read_back(chat.formatted(chat.linear(empty))).count() == 0
