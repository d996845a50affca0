"""WARC: exact round trips over any split, false magics, and edge cases."""

import gzip
import hashlib
import random
import zlib

import pytest
from chronofold.llm import warc

PAGES = "page_id long, url string, html string, digest string, first long"


def pages():
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}", "".join(rng.choices("abé<>\r\n\0", k=rng.choice([0, 3, 900, 3000])))) for i in range(150)]
    same = "é" * 700
    rows += [(200 + i, "http://y", same) for i in range(20)] + [(300 + i, None, "short") for i in range(3)] + [(400, "http://\r\nz", None), (401, "u", "")]
    rows += [(500, "u", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n" * 30), (219, "again", same), (None, "u", same), (None, "u", "q" * 1200), (600, "u", "a" * 3_000_000)]
    return rows


def expected(rows):
    out = []
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    for i, _, h in rows:
        b = (h or "").encode()
        known = [x for x in groups[b] if x is not None]
        first = max(known) if len(b) >= 1000 and len(groups[b]) > 1 and known else None
        to = first if first is not None and i != first else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [97, 5000, 1 << 24])
def test_round_trip(spark, tmp_path, split):
    rows = pages()
    if split == 97:
        rows = rows[:60] + rows[150:180]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], PAGES).repartition(3)
    files = warc.write(warc.planned(df), f"file://{tmp_path}/w")
    got = warc.read(spark, files, split, payloads=True).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == expected(rows)
    texts = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert bytes(r["payload"]) == texts[r["page_id"]]
    for f in files:  # any gzip reader can read them
        with gzip.open(f.removeprefix("file://")) as g:
            assert g.read().startswith(b"WARC/1.1\r\n")


def test_false_magics_are_passed_over(tmp_path):
    """Stored (not deflated) members hold the bytes of gzip magics and whole foreign members."""
    def member(text, level):
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        return c.compress(text) + c.flush()

    inner = member(b"not a record", 6)
    noise = warc.MAGIC * 50 + inner + warc.MAGIC
    texts = [b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n" % len(noise) + noise + b"%d" % i + b"\r\n\r\n" for i in range(10)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(member(t, 0) for t in texts))
    size = path.stat().st_size
    for step in (1, 13, 200, size):
        if step == 1:
            cuts = [*range(0, 400), size]
        else:
            cuts = [*range(0, size, step), size]
        got = [at for a, b in zip(cuts, cuts[1:], strict=False) for at, _, _ in warc.records(str(path), a, b)]
        assert len(got) == 10 and got == sorted(set(got))


def test_edges(spark, tmp_path):
    empty = spark.createDataFrame([], PAGES)
    files = warc.write(warc.planned(empty), f"file://{tmp_path}/none")
    assert files == [] and warc.read(spark, files).count() == 0


def test_equal_pages_are_dealt_evenly(spark):
    """No shuffle of payloads is by digest alone."""
    df = spark.createDataFrame([(i, "u", "x" * 2000 if i % 3 else "y" * 5, "", 0) for i in range(300)], PAGES)
    got = warc.planned(df).groupBy("refers_to").count().collect()
    assert {r["refers_to"]: r["count"] for r in got} == {None: 101, 299: 199}


def test_folders_that_tasks_cannot_reach_are_refused():
    assert warc._file_system("file:/tmp/x")[1] == "/tmp/x" and warc._file_system("/tmp/x")[1] == "/tmp/x"
    with pytest.raises(ValueError, match="dbfs"):
        warc._file_system("dbfs://store/x")
