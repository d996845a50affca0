"""Language-model scores: a pretrained byte PPM beside a word unigram base.

Documents lie in blocks of about BLOCK_BYTES. A block asks for the codes it holds,
each once: its byte grams and the hashes of its words. The trie and the word counts
are one table, dealt into BUCKETS by the last three bytes of a gram's context (so
all longer contexts of a position lie in one bucket) and by the hash of a word.

    corpus -> blocks (packed texts) and what they ask (bucket, block, codes, training counts)
           -> parts (bucket, codes, counts): the model
           -> answers (block, codes, values), where a bucket's part meets what was asked of it
           -> scores, where a block's answers meet its texts

Only contexts of up to two bytes go through the driver (at most 256^3 grams, however
much is read). A task holds one bucket's part and streams past it what was asked;
then one block's answers, and streams past them the block's texts. What many blocks
ask of one bucket is dealt among salts of SALT_BLOCKS blocks. The corpus is read
once, whatever the number of grams; blocks are a table, so a task that runs again
reads the same ones.

Defined results: a null or empty text is the end token alone; a null doc_id is
not in the held-out fold and trains; rows that repeat count and are scored once
each; an empty table gives no rows; without training rows every count is 0; other
columns are not read; a very long text is counted and scored in stretches of CHUNK bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import common, ppm

ORDER = 5
BLOCK_BYTES = 32 << 20
#: Bytes of texts that are coded, or packed, at once.
CHUNK = 2 << 20
BUCKETS = 512
#: Blocks whose questions to one bucket are one task's.
SALT_BLOCKS = 1024
#: Context bytes by which grams are dealt; shorter contexts are held by every task.
DEAL_BY = 3
#: Distinct entries that a task gathers before it hands them on.
FLUSH = 3_000_000
#: Stands for the end token among word hashes.
END = np.uint64(0x656E64)
FOLDS, HELD_OUT = 5, 1
GRAM, WORD, TEXT = 0, 1, 2
#: Answers are whole multiples of this part of log10: 5 bytes hold them, and a sum of a million is right to 1e-4.
STEP = 2.0**-33


def stream(words: list[bytes]) -> bytes:
    """The bytes that the model codes: words joined by a space, closed by the end symbol."""
    return b" ".join(words) + b"\n"


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, without the planes that are all zero."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return planes[:used].tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers that packed() made ``data`` from."""
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def bucket_of(kind: int, codes: np.ndarray, buckets: int) -> np.ndarray:
    own = codes >> np.uint64(8) & np.uint64((1 << 8 * DEAL_BY) - 1) if kind == GRAM else codes
    return (common.mixed(own) % np.uint64(buckets)).astype(np.int64)


def _word_keys(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token (words and the end) of all documents, and each token's document."""
    keys = np.concatenate([common.hashed([w for ws in lists for w in ws]), np.full(len(lists), END)])
    return keys, np.concatenate([np.repeat(np.arange(len(lists)), [len(w) for w in lists]), np.arange(len(lists))])


def _chunks(streams: list[bytes], most: int) -> list[tuple[int, int]]:
    """(first, end) of neighbours of ``most`` bytes together, or one longer stream."""
    out, first, held = [], 0, 0
    for i, s in enumerate(streams):
        if i > first and held + len(s) > most:
            out.append((first, i))
            first, held = i, 0
        held += len(s)
    return out + [(first, len(streams))] * (len(streams) > first)


def gram_parts(streams: list[bytes], order: int, most: int = CHUNK):
    """(streams' places, codes) of all positions, about ``most`` at a time; a longer stream comes in several parts."""
    for a, b in _chunks(streams, most):
        if b - a == 1 and len(streams[a]) > most:
            s = b"\n" * order + streams[a]
            for at in range(0, len(streams[a]), most):
                codes = ppm.gram_codes([s[at : at + most + order]], order)[0][order:]  # the first have the piece's own context
                yield np.full(len(codes), a), codes
        else:
            codes, sizes = ppm.gram_codes(streams[a:b], order)
            yield np.repeat(np.arange(a, b), sizes), codes


_BLOCK = "kind int, bucket int, block long, n long, codes binary, trained binary, ids array<long>, train array<boolean>, sizes array<long>"


def blocks(docs: DataFrame, trains, order: int, buckets: int, block_bytes: int = BLOCK_BYTES, flush: int = FLUSH, chunk: int = CHUNK) -> DataFrame:
    """The corpus in blocks: packed texts (TEXT), and for each block and bucket the distinct codes (GRAM, WORD) with their training counts.

    A task closes a block at ``block_bytes`` of texts or ``flush`` distinct codes.
    """
    common.arrow_batches(docs.sparkSession)

    def run(batches):
        held: dict[int, list] = {GRAM: [], WORD: []}
        block, pending, size = TaskContext.get().partitionId() << 32, 0, 0

        def merge():
            for kind, parts in held.items():
                if len(parts) > 1:
                    held[kind] = [ppm.summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
            return sum(len(p[0]) for parts in held.values() for p in parts)

        def emit():
            merge()
            rows = []
            for kind, parts in held.items():
                if not parts:
                    continue
                codes, n = parts[0]
                bucket = bucket_of(kind, codes, buckets)
                by = np.argsort(bucket, kind="stable")
                codes, n, bucket = codes[by], n[by], bucket[by]
                ends = np.searchsorted(bucket, np.arange(buckets), "right")
                starts = np.concatenate([[0], ends[:-1]])
                rows += [(kind, b, block, int(e - s), packed(codes[s:e]), packed(n[s:e].view(np.uint64)), None, None, None) for b, (s, e) in enumerate(zip(starts, ends, strict=True)) if e > s]
                held[kind] = []
            for i in range(0, len(rows), 256):
                yield _batch(rows[i : i + 256], _BLOCK)

        for batch in batches:
            ids, texts, train = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            streams = [stream(common.words_of(t)) for t in texts]
            for a, b in _chunks(streams, chunk):
                for flag in (True, False):
                    own = [s for s, t in zip(streams[a:b], train[a:b], strict=True) if t == flag]
                    for _, codes in gram_parts(own, order, chunk):
                        u, n = np.unique(codes, return_counts=True)
                        held[GRAM].append((u, n.astype(np.int64) * flag))
                        pending += len(u)
                    u, n = np.unique(_word_keys([s.split() for s in own])[0], return_counts=True)
                    held[WORD].append((u, n.astype(np.int64) * flag))
                    pending += len(u)
                joined = b"".join(streams[a:b])
                size += len(joined)
                yield _batch([(TEXT, 0, block, len(joined), pa.compress(joined, "zstd", asbytes=True), None, ids[a:b], train[a:b], [len(s) for s in streams[a:b]])], _BLOCK)
                if pending > flush:
                    pending = merge()
                if pending > flush or size > block_bytes:
                    yield from emit()
                    block, pending, size = block + 1, 0, 0
        yield from emit()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), trains.alias("train"))
    return rows.mapInArrow(run, _BLOCK)


_PART = "kind int, bucket int, n long, codes binary, trained binary"


def _merged(rows: DataFrame, keys: list[str], flush: int = FLUSH) -> DataFrame:
    """For each key one row of the codes that training texts hold, with their counts. Rows stream past the sum so far."""

    def run(batches):
        key, parts, pending = None, [], 0

        def total():
            return ppm.summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

        def done():
            if key is not None:
                codes, n = total()
                codes, n = codes[n > 0], n[n > 0]
                if len(codes):
                    yield _batch([(*key[:2], len(codes), packed(codes), packed(n.view(np.uint64)))], _PART)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for kind, bucket, salt, n, codes, trained in zip(*columns, strict=True):
                if (kind, bucket, salt) != key:
                    yield from done()
                    key, parts, pending = (kind, bucket, salt), [], 0
                parts.append((unpacked(codes, n), unpacked(trained, n).view(np.int64)))
                pending += n
                if pending > flush:  # entries since the last sum
                    parts, pending = [total()], 0
        yield from done()

    ready = rows.select("kind", "bucket", F.col("salt") if "salt" in keys else F.lit(0).alias("salt"), "n", "codes", "trained")
    return ready.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _PART)


def _short_contexts(parts: DataFrame, order: int) -> DataFrame:
    """(kind, code, n): grams of contexts of fewer than DEAL_BY bytes; for words the sum (code 0) and number (code 1) of counts."""
    by = min(order + 1, DEAL_BY)  # bytes of a gram of the longest short context

    def run(batches):
        for batch in batches:
            for kind, n, codes, trained in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, counts = unpacked(codes, n), unpacked(trained, n).view(np.int64)
                if kind == WORD:
                    codes, counts = np.array([0, 1], np.uint64), np.array([counts.sum(), n])
                else:
                    for k in range(order - 1, by - 2, -1):  # ever shorter grams, each counted once for each longer one
                        codes, counts = ppm.summed(ppm.shorter(codes, k), np.ones(len(codes), np.int64))
                for i in range(0, len(codes), 50_000):
                    part = codes[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(counts[i : i + 50_000])], names=["kind", "code", "n"])

    return parts.select("kind", "n", "codes", "trained").mapInArrow(run, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))


class Model:
    """The stored blocks, what they ask, and the partitioned trie and word counts."""

    def __init__(self, docs: DataFrame, trains, order: int = ORDER, block_bytes: int = BLOCK_BYTES, buckets: int = BUCKETS, salt_blocks: int = SALT_BLOCKS, flush: int = FLUSH, chunk: int = CHUNK):
        self.order, self.chunk = order, chunk
        stored = common.settle(blocks(docs, trains, order, buckets, block_bytes, flush, chunk), "blocks")
        self.texts, found = stored.filter(F.col("kind") == TEXT), stored.filter(F.col("kind") != TEXT)
        self.blocks = max(1, self.texts.select("block").distinct().count())
        self.salts = -(-self.blocks // salt_blocks)
        self.asked = found.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(self.salts)).cast("int"))
        parts = _merged(self.asked, ["kind", "bucket", "salt"], flush)
        if self.salts > 1:
            parts = _merged(parts, ["kind", "bucket"], flush)
        self.parts = common.settle(parts, "parts")
        short = _short_contexts(self.parts, order).toArrow()  # 256^3 grams at most
        kind, code, n = (short.column(c).to_numpy() for c in ("kind", "code", "n"))
        told = dict(zip(code[kind == WORD].tolist(), n[kind == WORD].tolist(), strict=True))
        self.tokens, self.kinds = told.get(0, 0), told.get(1, 0)
        self.short = ppm.Trie(code[kind == GRAM].view(np.uint64), n[kind == GRAM], min(order, DEAL_BY - 1))


_ANSWER = "block long, kind int, n long, codes binary, values binary"


def answers(model: Model) -> DataFrame:
    """For each block the value of each code: a gram's log10 probability in steps of -STEP, a word's count in training texts."""
    shared, order = model.asked.sparkSession.sparkContext.broadcast(model.short), model.order
    salts = F.explode(F.sequence(F.lit(0), F.lit(model.salts - 1)))
    held = model.parts.select("kind", "bucket", salts.alias("salt"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("block"), "n", "codes", "trained")
    wanted = model.asked.select("kind", "bucket", "salt", F.lit(1).alias("role"), "block", "n", "codes", F.lit(None).cast("binary").alias("trained"))
    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def table(kind: int, codes: np.ndarray, n: np.ndarray):
        if kind == WORD:
            return codes, n
        if order < DEAL_BY:
            return shared.value
        return ppm.Trie(codes, n, order, shared.value, DEAL_BY)

    def run(batches):
        key, own = None, None
        for batch in batches:
            rows = []
            for kind, bucket, salt, role, block, n, codes, trained in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = unpacked(codes, n)
                if (kind, bucket, salt) != key:
                    key, own = (kind, bucket, salt), table(kind, *(nothing if role else (codes, unpacked(trained, n).view(np.int64))))
                if not role:
                    continue
                if kind == WORD:
                    at = ppm._find(own[0], codes)
                    values = np.where(at >= 0, own[1][np.maximum(at, 0)], 0) if len(own[0]) else np.zeros(n, np.int64)
                else:
                    values = np.rint(own.log10(codes) / -STEP)
                rows.append((block, kind, n, packed(codes), packed(values.astype(np.uint64))))
            if rows:
                yield _batch(rows, _ANSWER)

    keys = ["kind", "bucket", "salt"]
    return held.unionByName(wanted).repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(run, _ANSWER)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row that the model's blocks hold."""
    order, chunk, tokens, bottom = model.order, model.chunk, model.tokens, model.tokens + 0.5 * (model.kinds + 1)
    both = answers(model).unionByName(model.texts.select("block", "kind", "n", "codes", "ids", "train", "sizes"), True)

    def run(batches):
        block, got, tables = None, {GRAM: [], WORD: []}, None
        for batch in batches:
            for of, kind, n, codes, values, ids, train, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != block:
                    block, got, tables = of, {GRAM: [], WORD: []}, None
                if kind != TEXT:
                    got[kind].append((unpacked(codes, n), unpacked(values, n)))
                    continue
                if tables is None:
                    tables = {}
                    for k, parts in got.items():
                        c = np.concatenate([p[0] for p in parts])
                        by = np.argsort(c)
                        tables[k] = (c[by], np.concatenate([p[1] for p in parts])[by])
                    got = {GRAM: [], WORD: []}
                ends = np.cumsum(sizes)
                joined = pa.decompress(codes, n, "zstd", asbytes=True)
                streams = [joined[e - s : e] for e, s in zip(ends.tolist(), sizes, strict=True)]
                lists = [s.split() for s in streams]
                bits = np.zeros(len(lists))
                for doc, grams in gram_parts(streams, order, chunk):
                    u, inverse = np.unique(grams, return_inverse=True)
                    bits -= np.bincount(doc, (tables[GRAM][1][np.searchsorted(tables[GRAM][0], u)] * STEP)[inverse], len(lists))
                keys, doc = _word_keys(lists)
                c = tables[WORD][1][np.searchsorted(tables[WORD][0], keys)].astype(float)
                base = np.bincount(doc, np.log10((c + 0.5) / bottom), len(lists))
                known = np.bincount(doc, c > 0, len(lists)).astype(np.int64)
                m = [len(w) + 1 for w in lists]
                yield _batch(list(zip(ids, [not t for t in train], m, known.tolist(), [tokens] * len(m), base.tolist(), bits.tolist(), strict=True)), _SCORED)

    ready = both.select("block", "kind", "n", "codes", "values", "ids", "train", "sizes").repartition(model.blocks, "block")  # a block each
    return ready.sortWithinPartitions("block", "kind").mapInArrow(run, _SCORED)  # texts come after answers


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[f[1]]) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], names=[f[0] for f in fields])


def op7_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(Model(docs, ~common.in_fold("doc_id", FOLDS, HELD_OUT)))
