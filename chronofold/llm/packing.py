"""Best-fit packing of tokenised documents into sequences of fixed length.

Tokens are counted once, distributed. A packing of items into bins depends only
on how many items of each length there are, and there are at most ``capacity``
lengths: that histogram, whose size does not grow with the data, is what the
driver plans on. Martello-Toth dominance fixes sets that some optimal packing
contains, the rest goes by best fit decreasing, and the plan's runs (length,
ranks, sequences, offset) are looked up by each item's rank within its length.

Defined results: a null or empty text is one end token; a null doc_id is packed
like any other; rows that repeat are packed once each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.llm import common

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks, for the faster library; None to use the tokenizer's file only.
RANKS = "byte_bpe_50k.tiktoken"

_loaded: dict[str, object] = {}
#: Scripts whose character classes differ between Unicode versions, and beyond: not for the fast path.
_RARE = re.compile(rb"[\xd5-\xff]")


class Encoder:
    """Ids of a text as the tokenizer's file gives them, without special tokens added.

    Most texts go through the rank file of the same vocabulary, which is several
    times faster. Texts that hold a special token's string, or characters beyond
    the scripts both libraries are known to class alike, go through the file.
    """

    def __init__(self, file: str, ranks: str | None):
        import public_tokenizers

        self.file = file if "/" in file else public_tokenizers.path(file)
        self.fast = self.exact = None
        if ranks:
            import base64

            import tiktoken

            path = ranks if "/" in ranks else public_tokenizers.path(ranks)
            with open(path, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        import json

        with open(self.file, encoding="utf-8") as f:
            self.special = [x["content"].encode() for x in json.load(f).get("added_tokens", [])]

    def __call__(self, text: bytes) -> np.ndarray:
        if self.fast and not _RARE.search(text) and not any(s in text for s in self.special):
            try:
                return np.asarray(self.fast.encode_ordinary(text.decode("utf-8")), "<u4")
            except UnicodeDecodeError:  # replaced below, by characters that are not for the fast path
                pass
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.file)
        return np.asarray(self.exact.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")


def encoder(file: str = TOKENIZER, ranks: str | None = RANKS) -> Encoder:
    """One encoder for each Python worker."""
    key = f"{file}|{ranks}"
    if key not in _loaded:
        _loaded[key] = Encoder(file, ranks)
    return _loaded[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces. Only longer ones are cut; the first piece may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, file: str = TOKENIZER, ranks: str | None = RANKS, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document, numbered within its task and length (task, nth)."""
    spark = docs.sparkSession
    common.arrow_batches(spark)

    def run(batches):
        encode, task, seen = encoder(file, ranks), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or b""), np.uint32(END_ID)).astype("<u4")
                for k, (start, size) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + size]
                    rows.append((doc, k, start, size, zlib.crc32(part.tobytes()), task, seen[size], part.tolist() if keep_ids else None))
                    seen[size] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long, ids array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def reduce_dominated(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello-Toth reduction on a histogram: takes what it fixes out of ``count`` and returns (lengths, times).

    With j the longest item and k the longest that fits beside it, a set holding
    j is dominated by {j} if nothing fits, by {j, k} if k fills the rest exactly
    or if no two others fit together, and by {j, k, b} if no three others fit
    and b is at least the smaller of any two that fit.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    there = [int(x) for x in np.flatnonzero(count)]

    def drop(length: int, n: int) -> None:
        count[length] -= n
        if not count[length]:
            there.pop(bisect.bisect_left(there, length))

    def longest(limit: int, taken: Counter) -> int:
        i = bisect.bisect_right(there, limit) - 1
        while i >= 0 and count[there[i]] <= taken[there[i]]:
            i -= 1
        return there[i] if i >= 0 else 0

    def shortest(n: int, taken: Counter) -> list[int]:
        out: list[int] = []
        for length in there:
            out += [length] * int(min(n - len(out), max(0, count[length] - taken[length])))
            if len(out) == n:
                break
        return out

    def fix(lengths: tuple[int, ...]) -> None:
        need = Counter(lengths)
        times = min(int(count[x]) // n for x, n in need.items())
        fixed.append((lengths, times))
        for x, n in need.items():
            drop(x, n * times)

    for j in range(capacity, 0, -1):
        while count[j]:
            free, own = capacity - j, Counter([j])
            k = longest(free, own)
            if not k:
                fix((j,))
                continue
            small = shortest(3, own)
            if k == free or len(small) < 2 or small[0] + small[1] > free:
                fix((j, k))
                continue
            b = longest(free - k, own + Counter([k]))
            if b and (len(small) < 3 or sum(small) > free) and b >= longest(free // 2, own):
                fix((j, k, b))
                continue
            break
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram; bins of equal content move together."""
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append([lengths, times])

    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, (length,) * each, left // each)
                if left % each:
                    put(capacity - left % each * length, (length,) * (left % each), 1)
                left = 0
                continue
            room = rooms[i]
            lengths, times = group = by_room[room][-1]
            each = min(room // length, left)
            used = min(times, left // each)
            group[1] -= used
            if not group[1]:
                by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(i)
            put(room - each * length, lengths + (length,) * each, used)
            left -= used * each
    return [(tuple(x), n) for groups in by_room.values() for x, n in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs: items of a length whose rank is in [first, first+n) go to sequences base, base+1, ... at one offset."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    packed = reduce_dominated(count, capacity) + best_fit(count, capacity)
    used: Counter = Counter()
    runs, base = [], 0
    for lengths, times in packed:
        offset = 0
        for length in lengths:
            runs.append((length, used[length], times, base, offset))
            used[length] += times
            offset += length
        base += times
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "n", "base", "offset"), columns, strict=True)) | {"sequences": np.int64(base)}


def pack(docs: DataFrame, capacity: int = CAPACITY, file: str = TOKENIZER, ranks: str | None = RANKS, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for) of every piece."""
    spark = docs.sparkSession
    pieces = common.settle(pieces_of(docs, capacity, file, ranks, keep_ids), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = common.settle(counts, "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # first has a row for each task and length, which grows with the input: never broadcast
    ranked = pieces.join(first.hint("merge"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"), *["ids"] * keep_ids)

    def place(batches):
        p = runs.value
        starts = np.searchsorted(p["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                a, b = starts[x], starts[x + 1]
                mine = length == x
                at = a + np.searchsorted(p["first"][a:b], rank[mine], "right") - 1
                sequence[mine] = p["base"][at] + rank[mine] - p["first"][at]
                offset[mine] = p["offset"][at]
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset), *batch.columns[6:]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset", *batch.schema.names[6:]])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<long>" * keep_ids
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pack(..., keep_ids=True). A group is one sequence: at most `capacity` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op1_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
