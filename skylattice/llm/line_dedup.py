"""Line deduplication within one edit by a deletion-neighbourhood join, with DataFrame functions only.

A line with a word goes if an earlier one is equal to it or one edit away: a character put in, taken out or changed. Rows are ordered by doc_id, then by a digest of their texts, so that rows that
share a doc_id, or have none, are told apart. Equal lines meet first, by hashes that are aggregated before the shuffle, so that what follows sees
each distinct line once, at its earliest place.

Deletion variants of every line would be as many as the corpus has characters, so lines that cannot have a partner are
put aside first. A line of length M is cut into S parts; of two lines within one edit, all but one part agree (for a
line one longer, with parts cut as for M and those after the edit moved by one). A key of (M, part, hash of the rest) for
each part, as it stands and as the longer line, is therefore shared by every pair: with S = 2 for all distinct lines, by
hashes alone, then with S = 16 for those that have company. Of lines left, the deletion variants of the one part not in
the key are emitted as hashed keys and equal ones meet:

* a line's part that equals a variant of a longer line's part: one character put in or taken out;
* equal variants with the same place deleted: one character changed.

As the lines are distinct, a variant has at most (alphabet x length) lines, and each takes the earliest one only, so no
pairs are formed. The edit distance to that one is verified on the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written

FEW = 2  # parts in the first round
MANY = 16  # parts in the second


def key(line: Column, role: int, s: Column, parts: int) -> tuple[Column, Column, Column]:
    """The hash of all but part s, and from (1-based) and size of that part; role 1: as the longer line of a pair."""
    m = F.length(line) - role
    lo, hi = (m * s / parts).cast("int"), (m * (s + 1) / parts).cast("int")
    rest = F.xxhash64(m, s, F.substring(line, F.lit(1), lo), F.lit(0), F.substring(line, hi + 1 + role, F.length(line)))
    return rest, lo + 1, hi - lo + role


def keys(line: Column, parts: int) -> Column:
    """Array of (role, part, key, from, size) for both roles and every part."""
    def of(role: int):
        def one(s: Column) -> Column:
            rest, start, size = key(line, role, s, parts)
            return F.struct(F.lit(role).alias("role"), s.cast("int").alias("part"), rest.alias("key"), start.alias("from"), size.alias("size"))
        return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), one)
    return F.concat(of(0), of(1))


def few_keys(line: Column) -> Column:
    """The keys alone of the first round; written out, so that they are compiled with the rest of the stage."""
    return F.array(*[key(line, role, F.lit(s), FEW)[0] for role in (0, 1) for s in range(FEW)])


def has_word(line: Column) -> Column:
    """Whether a line may go."""
    return line.rlike(r"[^\x20\x09-\x0D]")


def digest(text: Column) -> Column:
    """60 bits of the text's MD5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n (line number from 0) and line of the lines that may go."""
    return docs.select("doc_id", "digest", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).filter(has_word(F.col("line")))


def place() -> Column:
    """Where a line is; places compare as the lines' order: rows without doc_id last, then doc_id, digest, line number."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("digest").alias("digest"), F.col("n").alias("n"))


def with_company(rows: DataFrame) -> DataFrame:
    """Rows (key, ...) whose key occurs more than once. Keys are counted before the shuffle; hot ones can be split in the join."""
    busy = rows.groupBy("key").count().filter("count > 1").select("key")
    return rows.join(busy, "key", "left_semi")


def texts_at(docs: DataFrame, places: DataFrame, max_rows: int) -> DataFrame:
    """at and line of the given places (at). They are sent to the documents only if they are counted to be few."""
    wanted = places.select("at").distinct().groupBy(F.col("at.doc_id").alias("w_id"), F.col("at.digest").alias("w_digest")).agg(F.collect_list("at.n").alias("w_n"))
    if places.limit(max_rows + 1).count() <= max_rows:
        wanted = F.broadcast(wanted)
    one = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("digest") == F.col("w_digest")))
    one = one.select("doc_id", "digest", F.split("text", "\n", -1).alias("w_lines"), F.explode("w_n").alias("n"))
    return one.select(place().alias("at"), F.element_at("w_lines", F.col("n") + 1).alias("line")).distinct()


def near_earlier(docs: DataFrame, distinct: DataFrame, max_rows: int) -> DataFrame:
    """at: places (of distinct: at, keys) of lines that have an earlier line one edit away."""
    spark = docs.sparkSession
    exploded = distinct.select("at", F.explode("keys").alias("key"))
    some = written(spark, with_company(exploded).select("at").distinct(), "some")
    found = written(spark, texts_at(docs, some, max_rows), "lines")
    finer = found.select("at", "line", F.explode(keys(F.col("line"), MANY)).alias("k")).select("at", "k.*", F.expr("substring(line, k.from, k.size)").alias("open"))
    left = written(spark, with_company(finer), "left")
    cut = F.transform(
        F.sequence(F.lit(1), F.length("open")),
        lambda i: F.struct(
            (F.when(F.col("role") == 1, -1).otherwise(i)).cast("int").alias("cut"),
            F.xxhash64("key", F.concat(F.substring(F.col("open"), F.lit(1), i - 1), F.substring(F.col("open"), i + 1, F.length("open")))).alias("v"),
        ),
    )
    whole = F.struct(F.lit(0).alias("cut"), F.xxhash64("key", "open").alias("v"))
    variants = F.concat(F.when(F.col("role") == 0, F.array(whole)).otherwise(F.array().cast("array<struct<cut:int,v:bigint>>")), F.when(F.length("open") > 0, cut).otherwise(F.array().cast("array<struct<cut:int,v:bigint>>")))
    rows = left.select("at", F.explode(variants).alias("e")).select("at", "e.cut", "e.v")
    # cut: 0 the part itself, -1 a longer line's variant, else the place deleted for a change of one character
    same, key = Window.partitionBy("v", "cut"), Window.partitionBy("v")
    met = rows.withColumn("changed", F.min("at").over(same)).withColumn("self", F.min(F.when(F.col("cut") == 0, F.col("at"))).over(key)).withColumn("longer", F.min(F.when(F.col("cut") == -1, F.col("at"))).over(key))
    partner = F.when(F.col("cut") == 0, F.col("longer")).when(F.col("cut") == -1, F.col("self")).otherwise(F.col("changed"))
    pairs = met.select("at", partner.alias("other")).filter("other < at").distinct()
    a, b = found.select("at", F.col("line").alias("a")), found.select(F.col("at").alias("other"), F.col("line").alias("b"))
    return pairs.join(a, "at").join(b, "other").filter(F.levenshtein("a", "b", 1).between(0, 1)).select("at").distinct()


def kept_lines(docs: DataFrame, exact_chars: int, max_rows: int) -> DataFrame:
    """k_id, k_digest and kept (sorted numbers of the lines that stay of those that may go), one row a distinct document."""
    spark = docs.sparkSession
    # without keys a line meets only its equals
    few = F.when(F.length("line") > exact_chars, few_keys(F.col("line"))).otherwise(F.array().cast("array<bigint>"))
    each = lines(docs).select(place().alias("at"), F.xxhash64("line").alias("h"), F.hash("line").alias("g"), F.length("line").alias("c"), few.alias("keys"))
    # equal lines have equal keys, so any of them will do
    distinct = written(spark, each.groupBy("h", "g", "c").agg(F.min("at").alias("at"), F.first("keys").alias("keys")).select("at", "keys"), "distinct")
    gone = written(spark, near_earlier(docs, distinct, max_rows), "gone")
    stay = distinct.select("at").join(gone, "at", "left_anti")
    return stay.groupBy(F.col("at.doc_id").alias("k_id"), F.col("at.digest").alias("k_digest")).agg(F.sort_array(F.collect_list("at.n")).alias("kept"))


def dedup_lines(docs: DataFrame, exact_chars: int = 0, max_rows: int = 1_000_000) -> DataFrame:
    """docs with text (lines that stay, in order) and, added, __lines and __dropped (counts of lines).

    Lines are what "\\n" separates. One without a word always stays; one that equals an earlier line goes, as does one
    that is one edit away from an earlier one; the edit bound is zero for lines of up to exact_chars characters, by default for none. A null text stays null and has no
    lines; an empty one has one, empty. Rows are ordered by doc_id, null last, then by a digest of the text; rows that
    repeat both lie at the same place, so neither is earlier and both keep the same lines. An empty table gives an
    empty table. Of docs, only doc_id and text need to be there; other columns go through, but columns named __lines
    or __dropped are replaced. max_rows: how many places of lines with possible partners may be broadcast; beyond it
    texts are shuffled to them.
    """
    own = [c for c in docs.columns if c not in ("__lines", "__dropped")]
    stay = kept_lines(docs.select("doc_id", "text", digest(F.col("text")).alias("digest")), exact_chars, max_rows)
    # docs' own columns lie in a struct, so that their names can't clash
    rows = docs.select(F.struct(*own).alias("row"), digest(F.col("text")).alias("digest"))
    joined = rows.join(stay.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("k_id")) & (F.col("digest") == F.col("k_digest")), "left")
    # places that stay and lines, sorted together: a line stays if its place lies just before it
    text, split = F.col("row.text"), F.split("row.text", "\n", -1)
    there = F.transform(F.coalesce("kept", F.array().cast("array<int>")), lambda i: F.struct(i.alias("i"), F.lit(0).alias("t"), F.lit("").alias("l")))
    both = F.sort_array(F.concat(there, F.transform(split, lambda line, i: F.struct(i.alias("i"), F.lit(1).alias("t"), line.alias("l")))))
    step = joined.select("row", both.alias("z"), F.size(split).cast("long").alias("n"))
    before = lambda k: F.get(F.col("z"), k - 1)
    keep = F.filter("z", lambda e, k: (e["t"] == 1) & (~has_word(e["l"]) | F.coalesce((before(k)["t"] == 0) & (before(k)["i"] == e["i"]), F.lit(False))))
    step = step.select("row", F.transform(keep, lambda e: e["l"]).alias("left"), "n")
    new, gone = F.when(text.isNotNull(), F.array_join("left", "\n")), F.when(text.isNotNull(), F.col("n") - F.size("left")).otherwise(0)
    columns = [new.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in own]
    return step.select(*columns, F.when(text.isNotNull(), F.col("n")).otherwise(0).alias("__lines"), gone.cast("long").alias("__dropped"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, n_lines, n_dropped, digest of the lines that stay; see dedup_lines for the cases."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def dedup_sql(table: str, prefix: str = "") -> str:
    """DuckDB: common table expressions ending in {prefix}out (r, lines, dropped, kept text) by all deletion variants.

    Rows are ranked by their order first, so that a place is (rank, line number); only repeated rows share a rank.
    """
    return rf"""
{prefix}src as (
  select row_number() over () r, doc_id, text, dense_rank() over (order by doc_id is null, doc_id, cast('0x' || left(md5(text), 15) as bigint), text) row from {table}),
{prefix}line as (select r, row, unnest(range(len(ls))) n, unnest(ls) line from (select r, row, string_split(text, chr(10)) ls from {prefix}src where text is not null)),
{prefix}dist as (select line, min({{'row': row, 'n': n}}) spot from {prefix}line where regexp_matches(line, '[^\x20\x09-\x0D]') group by line),
{prefix}var as (select spot, i, left(line, i - 1) || substring(line, i + 1) v from (select spot, line, unnest(range(1, length(line) + 1)) i from {prefix}dist)),
{prefix}near as (
  select spot from (select spot, min(spot) over (partition by v, i) first from {prefix}var) where first < spot
  union select case when x.spot < y.spot then y.spot else x.spot end from {prefix}var x join {prefix}dist y on x.v = y.line),
{prefix}stay as (select spot from {prefix}dist where spot not in (select spot from {prefix}near)),
{prefix}out as (
  select r, count(*) n_lines, count(*) filter (not k) n_dropped, coalesce(string_agg(line, chr(10) order by n) filter (k), '') kept
  from (select r, n, line, not regexp_matches(line, '[^\x20\x09-\x0D]') or {{'row': row, 'n': n}} in (select spot from {prefix}stay) k from {prefix}line) group by r)"""


OP9_SQL = f"""
with {dedup_sql("documents")}
select doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_dropped, 0) n_dropped, sha256(coalesce(kept, '')) text_sha256
from src left join out using (r)
"""
