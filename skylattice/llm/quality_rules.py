"""Quality rules with thresholds from mergeable quantile sketches per language and source.

Every text is measured with DataFrame functions only. The sketch of a metric is its counts by bucket, a bucket holding
values that agree in their seven leading bits (relative error below 1/64); two sketches merge by adding counts, so they
are summed before the shuffle, and a language's or the corpus's sketch is the sum of its parts. A limit is the group's
median plus or minus six times the distance to the quartile on that side, and known to a bucket; up to a quarter of a
group's rows can be spoilt without moving it. No distance or limit is given beforehand: a group whose quartile is zero,
as for symbols in prose, takes no share above zero. What is within chance in a short text does not count: one or two symbols
or repeated lines, and a mean word length whose distance from the median shrinks to the limit when multiplied by the
root of the text's words over the group's median of them. Groups too small for a sketch of their own take that of their
language, or else of the corpus. Documents are then joined with the limits of their group. Repeated windows have no
limit here: the base rule bounds them for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written

WINDOW = 5
#: metric: its count; shares in thousandths, mean word length in tenths.
SHARES = {"symbols": "n_symbols", "dup_lines": "n_dup_lines"}
METRICS = (*SHARES, "word_length", "n_words")
SPREADS, LEAST = 6, 3
QUARTILES = ("q25", "q50", "q75")
LIMITS = (*(f"{m}_hi" for m in SHARES), "mid", "up", "down", "typical")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one more column `__q`, a struct of counts and metrics; a null text has no words."""
    own = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(
        *own,
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("__w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("__c"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("__s"),
    )
    words = F.col("__w")
    hashes = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    # lines and words are not needed beyond their counts
    step = step.select(*own, hashes.alias("__h"), F.size(words).cast("long").alias("__n"), F.size("__l").cast("long").alias("__nl"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("__d"), "__c", "__s")
    # windows found more than once are looked for only where there are any: sorted by hash they lie side by side
    placed = F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.select(*own, "__n", "__nl", "__d", "__c", "__s", placed.alias("__p"))
    same = lambda e, k: (k > 0) & (F.get(F.col("__p"), k - 1)["h"] == e["h"])
    twice = F.filter("__p", lambda e, k: same(e, k) | F.coalesce(F.get(F.col("__p"), k + 1)["h"] == e["h"], F.lit(False)))
    step = step.select(*own, "__n", "__nl", "__d", "__c", "__s", F.sort_array(F.transform(twice, lambda e: e["i"])).alias("__t"))
    steps = F.transform("__t", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__t"), k + 1) - i, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    step = step.select(*own, "__n", "__nl", "__d", "__c", "__s", covered.alias("__r"))
    n = F.greatest(F.col("__n"), F.lit(1))
    q = F.struct(
        F.col("__n").alias("n_words"), F.col("__c").alias("word_chars"), F.col("__s").alias("n_symbols"),
        F.col("__d").alias("n_dup_lines"), F.col("__r").alias("n_repeat_words"),
        ((F.col("__n") < 10) | (100 * F.col("__r") > 20 * F.col("__n"))).alias("base_failed"),
        F.floor(1000 * F.col("__s") / n).alias("symbols"),
        F.floor(1000 * F.col("__d") / F.greatest(F.col("__nl"), F.lit(1))).alias("dup_lines"),
        F.floor(10 * F.col("__c") / n).alias("word_length"),
    )
    return step.select(*own, q.alias("__q"))


def bucket(value: Column) -> Column:
    """The lower end of the bucket of a non-negative long."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def bucket_end(value: Column) -> Column:
    """The largest value of the bucket that starts at value."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return value + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n over rows (lang, source, __q) that pass the base rules."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(f"__q.{m}")).alias("bucket")) for m in METRICS])
    return rows.select("lang", "source", F.explode(F.when(~F.col("__q.base_failed"), each)).alias("e")).groupBy("lang", "source", "e.metric", "e.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """by, metric, total, q25, q50, q75 of the sketch merged to these groups."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    cum = merged.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bucket")))
    at = lambda quarters: F.min(F.when(4 * F.col("upto") >= quarters * F.col("total"), F.col("bucket")))
    return cum.groupBy(*by, "metric").agg(F.max("total").alias("total"), *[at(i).alias(q) for i, q in enumerate(QUARTILES, 1)])


def thresholds(sketch: DataFrame, min_rows: int = 100) -> DataFrame:
    """lang, source and LIMITS of each group that has a sketch: highest shares; median and greatest distances up and down
    of the word length; median number of words."""
    own, by_lang, by_all = quantiles(sketch, "lang", "source"), quantiles(sketch, "lang"), quantiles(sketch)
    named = lambda df, tag: df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns])
    a, b, c = named(own, "a"), named(by_lang, "b"), named(by_all, "c")
    j = a.join(b, (F.col("a_metric") == F.col("b_metric")) & F.col("a_lang").eqNullSafe(F.col("b_lang"))).join(c, F.col("a_metric") == F.col("c_metric"))
    pick = lambda q: F.when(F.col("a_total") >= min_rows, F.col(f"a_{q}")).when(F.col("b_total") >= min_rows, F.col(f"b_{q}")).otherwise(F.col(f"c_{q}"))
    rows = j.select(F.col("a_lang").alias("lang"), F.col("a_source").alias("source"), F.col("a_metric").alias("metric"), *[pick(q).alias(q) for q in QUARTILES])
    of = lambda m, limit: F.max(F.when(F.col("metric") == m, limit))
    far = lambda a, b: SPREADS * F.greatest(F.lit(1), F.col(a) - F.col(b))  # noqa: E731  (one is what a word length is known to)
    shares = [of(m, bucket_end(F.col("q50") + SPREADS * (F.col("q75") - F.col("q50")))).alias(f"{m}_hi") for m in SHARES]
    length = [of("word_length", x).alias(c) for c, x in (("mid", F.col("q50")), ("up", far("q75", "q50")), ("down", far("q50", "q25")))]
    return rows.groupBy("lang", "source").agg(*shares, *length, of("n_words", F.col("q50")).alias("typical"))


def judged(rows: DataFrame, limits: DataFrame, max_groups: int = 100_000) -> DataFrame:
    """rows (with lang, source, __q) and a column `__kept`: no base rule failed and every metric within its limits.

    Limits are broadcast only if they are counted to be few; else Spark joins by group and splits hot ones.
    """
    small = limits.limit(max_groups + 1).count() <= max_groups
    own = rows.columns
    right = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[F.col(c).alias(f"__{c}") for c in LIMITS])
    right = F.broadcast(right) if small else right
    on = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    within = F.lit(True)
    for m, count in SHARES.items():
        within &= (F.col(f"__q.{m}") <= F.col(f"__{m}_hi")) | (F.col(f"__q.{count}") < LEAST)
    off, n, typical = F.col("__q.word_length") - F.col("__mid"), F.col("__q.n_words"), F.col("__typical")
    most = F.when(off > 0, F.col("__up")).otherwise(F.col("__down"))
    within &= (F.abs(off) <= most) | ((n < typical) & (off * off * n <= most * most * typical))
    return rows.join(right, on, "left").select(*own, (~F.col("__q.base_failed") & F.coalesce(within, F.lit(False))).alias("__kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts, metrics, base_failed, kept.

    Null and empty texts have no words and fail the base rule; null lang and source are groups like any other;
    repeated rows stay repeated and count as often; an empty table gives an empty table; columns other than doc_id,
    text, lang and source are not read. Equal windows are found by 64-bit hashes within one text.
    """
    rows = written(docs.sparkSession, measured(docs.select("doc_id", "lang", "source", "text")).drop("text"), "measured")
    limits = written(docs.sparkSession, thresholds(sketches(rows)), "limits")
    return judged(rows, limits).select("doc_id", "__q.*", F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, that the rules keep. Rows are written with their measures, which are taken once."""
    rows = measured(docs.select(F.struct(*docs.columns).alias("row")), "row.text").select("row", "row.lang", "row.source", "__q")
    rows = written(docs.sparkSession, rows, "measured")
    limits = written(docs.sparkSession, thresholds(sketches(rows)), "limits")
    return judged(rows, limits).filter("__kept").select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; see quality_rules for the cases."""
    out = quality_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def measured_sql(table: str, prefix: str = "") -> str:
    """DuckDB: common table expressions ending in {prefix}m, one row per row of `table` with counts and metrics."""
    return rf"""
{prefix}d as (select row_number() over () r, * from {table}),
{prefix}w as (select r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from {prefix}d),
{prefix}win as (select r, i, ws[i : i + 4] win from (select r, ws, unnest(range(1, len(ws) - 3)) i from {prefix}w)),
{prefix}rep as (select r, i from (select *, count(*) over (partition by r, win) c from {prefix}win) where c > 1),
{prefix}cov as (select r, count(distinct i + k) n from {prefix}rep, (select unnest(range(0, 5)) k) group by r),
{prefix}ln as (select r, count(*) nl, count(*) - count(distinct line) dup from (select r, unnest(string_split(coalesce(text, ''), chr(10))) line from {prefix}d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
{prefix}c as (
  select {prefix}d.*, cast(len(ws) as bigint) n_words,
    cast(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as bigint) word_chars,
    cast(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) as bigint) n_symbols,
    coalesce(dup, 0) n_dup_lines, coalesce(nl, 0) n_lines, coalesce(n, 0) n_repeat_words
  from {prefix}d join {prefix}w using (r) left join {prefix}ln using (r) left join {prefix}cov using (r)),
{prefix}m as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
    1000 * n_symbols // greatest(n_words, 1) symbols, 1000 * n_dup_lines // greatest(n_lines, 1) dup_lines,
    10 * word_chars // greatest(n_words, 1) word_length
  from {prefix}c)"""


def kept_sql(prefix: str = "") -> str:
    """DuckDB: common table expressions from {prefix}m to {prefix}k, which adds the column kept."""
    def q(tag: str, by: str) -> str:
        over = f"partition by {by}metric"
        return f"""
{prefix}{tag} as (select {by}metric, max(total) total, min(case when 4 * upto >= total then bucket end) q25, min(case when 4 * upto >= 2 * total then bucket end) q50, min(case when 4 * upto >= 3 * total then bucket end) q75
  from (select *, sum(n) over ({over}) total, sum(n) over ({over} order by bucket) upto from (select {by}metric, bucket, sum(n) n from {prefix}sk group by all)) group by all)"""

    union = " union all ".join(f"select lang, source, '{m}' metric, {m} x from {prefix}m where not base_failed" for m in METRICS)
    within = " and ".join(f"(m.{m} <= {m}_hi or {count} < {LEAST})" for m, count in SHARES.items())
    highs = ", ".join(f"max(case when metric = '{m}' then hi + (1 << greatest(length(bin(hi)) - 7, 0)) - 1 end) {m}_hi" for m in SHARES)
    picked = ", ".join(f"case when a.total >= 100 then a.{q} when b.total >= 100 then b.{q} else c.{q} end {q}" for q in QUARTILES)
    return f"""
{prefix}sk as (select lang, source, metric, (x >> s) << s bucket, count(*) n from (select *, greatest(length(bin(x)) - 7, 0) s from ({union})) group by all),{q("qa", "lang, source, ")},{q("qb", "lang, ")},{q("qc", "")},
{prefix}lim as (
  select *, q50 + {SPREADS} * (q75 - q50) hi, {SPREADS} * greatest(1, q75 - q50) far_up, {SPREADS} * greatest(1, q50 - q25) far_down
  from (select a.lang, a.source, a.metric,
      {picked}
    from {prefix}qa a join {prefix}qb b on a.metric = b.metric and a.lang is not distinct from b.lang join {prefix}qc c on a.metric = c.metric)),
{prefix}sides as (
  select lang, source, {highs}, max(case when metric = 'word_length' then q50 end) mid, max(case when metric = 'word_length' then far_up end) up,
    max(case when metric = 'word_length' then far_down end) down, max(case when metric = 'n_words' then q50 end) typical
  from {prefix}lim group by all),
{prefix}k as (
  select m.* exclude (r), not base_failed and coalesce({within} and (abs(word_length - mid) <= most or n_words < typical and (word_length - mid) * (word_length - mid) * n_words <= most * most * typical), false) kept
  from (select m.*, l.* exclude (lang, source), case when word_length > mid then up else down end most
    from {prefix}m m left join {prefix}sides l on m.lang is not distinct from l.lang and m.source is not distinct from l.source) m)"""


OP2_SQL = f"""
with {measured_sql("documents")},{kept_sql()}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from k
"""
