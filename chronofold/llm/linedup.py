"""Line dedup by a suffix array over line-ID sequences, with DataFrame functions only.

The corpus is the sequence of its documents' lines (by doc_id; blank lines are
passed over, and no run crosses documents). Prefix doubling gives every suffix its
rank by its first 1, 2, 4, ... lines, until no ranks are shared: suffixes of one
rank are an interval of the suffix array whose longest common prefix is at least
that many lines. Only suffixes that share their rank go on, so each round is
smaller than the last.

Between the doubled lengths the intervals are split by bisection: at depth m the
members of an interval are told apart by the rank of what follows m lines on. Of
each part that shares more, the earliest member stands for the part in the
shallower interval, and the others go on inside the part. This finds, for every
suffix, the deepest interval in which an earlier suffix lies: its longest common
prefix with anything earlier, hence the longest run of lines from there on that is
a later copy. Runs that do not lie inside the run of the line before are the
maximal repeated runs; the lines of those of MIN_WORDS words or more are deleted.

Lines are equal if they are once spaces, tabs and carriage returns around them are
taken away. Ranks count rows in two levels, and a rank's ranges are summed in one
row, so a line that a third of all documents have is no single task's work; joins
on ranks are plain equi-joins, which the skew join splits.

Defined results: a null or empty text has no lines and stays as it is; a null
doc_id comes first; rows that repeat doc_id and text are one document, and each is
edited alike; documents of one doc_id and other texts are ordered by a hash of
the text; an empty table gives no rows; a very long text is many lines of one
document; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.llm import common

MIN_WORDS = 25
WORD = r"[^\\x20\\x09-\\x0D]+"
#: Ranks are counted within so many ranges first: of all lines, and of one rank's suffixes.
LINE_RANGES, RANGES = 1 << 14, 1024

_AT = ["d", "th"]


def lines_of(docs: DataFrame) -> DataFrame:
    """d, th (document), i (place among its lines that are not blank), ln (place among all), h1, h2 (line ID), w (words)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("th"), F.split("text", "\n").alias("lines"))
    full = F.expr(f"filter(transform(lines, (x, k) -> named_struct('ln', k, 'line', btrim(x, ' \\t\\r'))), s -> s.line rlike '{WORD}')")
    one = rows.select(*_AT, F.posexplode(full).alias("i", "s"))
    ids = [F.xxhash64("s.line").alias("h1"), F.xxhash64(F.lit(7), F.col("s.line")).alias("h2")]
    return one.select(*_AT, "i", F.col("s.ln").alias("ln"), *ids, F.expr(f"regexp_count(s.line, '{WORD}')").alias("w"))


def _line_ranks(classes: DataFrame) -> DataFrame:
    """``classes`` (h1, h2, n, first) with ``rank``: the lines before each in the order of line IDs. Sums over ranges, then inside them."""
    ranged = classes.withColumn("range", F.shiftright("h1", 64 - LINE_RANGES.bit_length() + 1))
    sums = ranged.groupBy("range").agg(F.sum("n").alias("in_range"))  # LINE_RANGES rows at most
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_range").over(earlier), F.lit(0))).drop("in_range")
    inside = Window.partitionBy("range").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return inner.join(sums, "range").select("h1", "h2", "first", (F.col("before") + F.col("inside")).alias("rank"))


def _refined(children: DataFrame, width: int) -> DataFrame:
    """``children`` (rank, next, n, first) with ``refined``: the rank plus the suffixes of that rank with a smaller next.

    ``next`` falls into RANGES ranges of ``width``; a rank's sums over its ranges are
    one row, so no window holds all children of a hot rank.
    """
    ranged = children.withColumn("range", F.expr(f"next div {width}"))
    sums = ranged.groupBy("rank", "range").agg(F.sum("n").alias("in_range"))
    sums = sums.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("range", "in_range"))).alias("parts"))  # RANGES entries at most
    before = "inline(transform(parts, (p, j) -> named_struct('range', p.range, 'before', aggregate(slice(parts, 1, j), 0L, (a, x) -> a + x.in_range))))"
    inside = Window.partitionBy("rank", "range").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return inner.join(sums.select("rank", F.expr(before)), ["rank", "range"]).select("rank", "next", "first", (F.col("rank") + F.col("before") + F.col("inside")).alias("refined"))


def _place() -> Column:
    return F.struct(*_AT, "i")


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: d, th, i, rank, first of the suffixes that share their first 2^k lines with another.

    ``first`` is the earliest place of the suffixes of that rank. Level 0 also has ln and w.
    """
    classes = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).filter("n > 1")
    ranked = _line_ranks(common.settle(classes, "classes"))
    levels = [common.settle(lines.join(ranked, ["h1", "h2"]).select(*_AT, "i", "ln", "w", "rank", "first"), "ranks")]
    width = max(1, -(-levels[0].count() // RANGES))
    while True:
        now = levels[-1].select(*_AT, "i", "rank")
        after = now.select(*_AT, (F.col("i") - (1 << len(levels) - 1)).alias("i"), F.col("rank").alias("next"))
        pairs = common.settle(now.join(after, [*_AT, "i"]), "pairs")
        shared = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).filter("n > 1")
        shared = common.settle(shared, "children")
        if shared.isEmpty():
            return levels
        found = pairs.join(_refined(shared, width), ["rank", "next"]).select(*_AT, "i", F.col("refined").alias("rank"), "first")
        levels.append(common.settle(found, "ranks"))
        common.unsettle(pairs)
        common.unsettle(shared)


def later_runs(levels: list[DataFrame]) -> DataFrame:
    """d, th, i, length of every suffix with a longest common prefix of ``length`` lines with an earlier one."""
    is_later = _place() > F.col("first")

    def of_level(k: int) -> DataFrame:
        """The members of the intervals of depth 2^k that are the earliest of theirs, or alone, at twice that depth."""
        own = levels[k]
        if k + 1 < len(levels):
            own = own.join(levels[k + 1].filter(is_later).select(*_AT, "i"), [*_AT, "i"], "left_anti")
        return own.select(*_AT, "i", F.lit(1 << k).alias("m"), F.col("first").alias("node"), is_later.alias("seeks"))

    done = [of_level(0).filter("seeks")]
    held: DataFrame | None = None
    for j in range(len(levels) - 2, -1, -1):  # the bit of the depth that is settled in this round
        members = of_level(j + 1) if held is None else held.unionByName(of_level(j + 1))
        follows = levels[j].select(*_AT, F.col("i").alias("__i"), F.col("rank").alias("next"))
        told = members.withColumn("__i", F.col("i") + F.col("m")).join(follows, [*_AT, "__i"], "left").drop("__i")
        told = common.settle(told, "members")
        parts = told.filter("next is not null").groupBy("m", "node", "next").agg(F.min(_place()).alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
        told = told.filter("next is null").withColumn("lead", F.lit(None).cast(parts.schema["lead"].dataType)).unionByName(told.filter("next is not null").join(parts, ["m", "node", "next"], "left"), True)
        here = F.struct("m", "node", "seeks")
        inside = F.struct((F.col("m") + (1 << j)).alias("m"), F.col("lead").alias("node"), (_place() > F.col("lead")).alias("seeks"))
        go_on = F.when(F.col("lead").isNull(), F.array(here)).when(_place() > F.col("lead"), F.array(inside)).otherwise(F.array(here, inside))
        old, held = held, common.settle(told.select(*_AT, "i", F.explode(go_on).alias("e")).select(*_AT, "i", "e.*"), "intervals")
        if old is not None:
            common.unsettle(old)
    if held is not None:
        done.append(held.filter("seeks"))
    out = done[0] if len(done) == 1 else done[0].unionByName(done[1])
    return out.select(*_AT, "i", F.col("m").alias("length"))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, th, ln of the lines to delete."""
    lines = common.settle(lines_of(docs).distinct(), "lines")  # rows that repeat a document are one
    levels = suffix_ranks(lines)
    in_doc = Window.partitionBy(*_AT).orderBy("i")
    shared = levels[0].select(*_AT, "i", "ln", "w").withColumn("upto", F.sum("w").over(in_doc))  # a run's lines are all shared
    runs = later_runs(levels).withColumn("end", F.col("i") + F.col("length"))
    maximal = runs.withColumn("prev", F.lag("end").over(in_doc)).filter("prev is null or end > prev")
    starts = maximal.join(shared.select(*_AT, "i", (F.col("upto") - F.col("w")).alias("until")), [*_AT, "i"]).select(*_AT, "i", "end", "until")
    ends = shared.select(*_AT, (F.col("i") + 1).alias("end"), "upto")
    long = common.settle(starts.join(ends, [*_AT, "end"]).filter(F.col("upto") - F.col("until") >= min_words).select(*_AT, "i", "end"), "runs")
    reach = F.max("end").over(in_doc.rowsBetween(Window.unboundedPreceding, 0))
    few = levels[0].select(*_AT, "i", "ln").join(long.select(*_AT).distinct(), _AT, "left_semi")
    return few.join(long, [*_AT, "i"], "left").withColumn("reach", reach).filter("reach > i").select(*_AT, "ln")


def _with_marks(docs: DataFrame, min_words: int, into: str = "__keep") -> DataFrame:
    """``docs`` with ``into``: for each line up to the last deleted one, whether it stays (null: all stay)."""
    gone = later_copies(docs, min_words).groupBy(*_AT).agg(F.array_sort(F.collect_list("ln")).alias("gone"))  # within one document
    gone = gone.withColumn("prev", F.expr("concat(array(-1), slice(gone, 1, size(gone) - 1))"))
    keep = F.expr("flatten(transform(arrays_zip(gone, prev), z -> concat(array_repeat(true, z.gone - z.prev - 1), array(false))))")
    own_d, own_th = common.free_name(docs, "__d"), common.free_name(docs, "__th")
    marks = common.settle(gone.select(F.col("d").alias(own_d), F.col("th").alias(own_th), keep.alias(into)), "marks")
    d = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    # the same plan at every size: marks grow with the documents, so they are never broadcast
    return docs.join(marks.hint("merge"), (d == F.col(own_d)) & (F.xxhash64(docs["text"]) == F.col(own_th)), "left").drop(own_d, own_th)


def left_over(keep: str = "__keep") -> Column:
    """The text without the lines that ``keep`` marks."""
    lines = F.filter(F.split("text", "\n"), lambda x, k: F.coalesce(F.get(F.col(keep), k), F.lit(True)))
    return F.when(F.col(keep).isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of repeated runs. Documents that lose all their words go; n_chars, if there, follows the text."""
    keep = common.free_name(docs, "__keep")
    out = _with_marks(docs, min_words, keep).withColumn("text", left_over(keep))
    out = out.filter(F.col(keep).isNull() | F.col("text").rlike(WORD.replace("\\\\", "\\")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(keep).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.drop(keep)


def op4_suffix_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines, deleted (lines) and the text that is left, of every document."""
    marked = _with_marks(common.table(spark, sf_dir, "documents").select("doc_id", "text"), MIN_WORDS)
    deleted = F.coalesce(F.size(F.filter("__keep", lambda x: ~x)), F.lit(0))
    return marked.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.when(F.col("__keep").isNull(), 0).otherwise(deleted).cast("long").alias("deleted"), left_over().alias("text"))


OP4_SQL = f"""
WITH cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS raw FROM documents
), line AS (
  SELECT doc_id, ln, trim(raw[ln + 1], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, raw, unnest(range(len(raw))) AS ln FROM cut)
), full_line AS (
  SELECT doc_id, ln, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS i
  FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), pairs AS (
  SELECT b.doc_id AS doc_id, a.doc_id AS other, b.i AS i, a.i AS j, b.w AS w,
         b.i - row_number() OVER (PARTITION BY b.doc_id, a.doc_id, b.i - a.i ORDER BY b.i) AS island
  FROM full_line a JOIN full_line b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.i < b.i))
), late AS (
  SELECT doc_id, min(i) AS s, max(i) AS e FROM pairs GROUP BY doc_id, other, i - j, island HAVING sum(w) >= {MIN_WORDS}
), gone AS (
  SELECT DISTINCT f.doc_id, f.ln FROM full_line f JOIN late l ON f.doc_id = l.doc_id AND f.i BETWEEN l.s AND l.e
), left_over AS (
  SELECT c.doc_id, string_agg(c.raw[l.ln + 1], chr(10) ORDER BY l.ln) AS text
  FROM cut c JOIN line l USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.ln = l.ln) GROUP BY c.doc_id
)
SELECT c.doc_id, CAST(len(c.raw) AS BIGINT) AS lines, coalesce((SELECT count(*) FROM gone g WHERE g.doc_id = c.doc_id), 0) AS deleted,
       coalesce(o.text, CASE WHEN c.text IS NULL THEN NULL ELSE '' END) AS text
FROM cut c LEFT JOIN left_over o USING (doc_id)
"""
