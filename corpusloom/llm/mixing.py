"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Rates r_d of the documents minimise the relative entropy to the unmixed corpus, sum(w_d * (r_d ln r_d - r_d + 1)),
under one token constraint a source, sum(size_d * r_d over the source) = target, and 0 <= r_d <= 3. With weights
w_d = size_d / x_d and x_d = 1 + ln(size_d) the optimum tilts exponentially, r_d = min(3, exp(lambda * x_d)): every document has a
rate of its own, and long ones, which move a source's tokens with the fewest documents, give way or multiply first.
(With w_d = size_d all documents of a source would have the rate target / size.)

lambda minimises the convex dual of its source. Each Newton step is one distributed aggregation of the
gradient sum(size * r) - target and its slope sum(size * x * r) over all documents, for all sources side by side; documents of one
source and size enter as one row with their number, which changes no sum. Bounds that close in on the root catch steps that
leave them, so Newton always ends: the gradient grows with lambda.

Rates become whole copies: floor(rate) each, and of the rest one more for some documents, by sequential Poisson
sampling: documents are taken in order of u / (rate - floor(rate)), where u is a uniform number from MD5 of the key,
while they fit what the source lacks, until no document fits. So a source misses its target by less than its smallest document
that got none. Ranges of that order are summed before documents are, so that a source that holds a third of all rows is many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import materialize, release

WORD = r"[^\x20\x09-\x0D]+"
MAX_COPIES = 3
#: Newton stops when every source's gradient is this small beside its target, or cannot get nearer.
TOLERANCE = 1e-11
STEPS, STEPS_A_JOB = 60, 4
#: Rates are read in millionths, so that the last bits of exp decide nothing.
GRAIN = 1_000_000
#: Rows of a range of the sampling order, on average.
RANGE_ROWS = 65536
#: What a source may lack, in tokens, when the last documents are chosen one by one.
FOLDED = 20_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, cap: int = MAX_COPIES) -> DataFrame:
    """One row a source: source_size, target.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the total; targets
    stop at `cap` times the source's size and the excess is reshared by weight, which is the level t
    with sum(min(cap * size, weight * t)) = total. The sources are few: this is one row for each.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = totals.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("long"))
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    through = by_cap.rowsBetween(Window.unboundedPreceding, 0)
    full = ranked.withColumn("full", F.sum("source_size").over(through) * cap).withColumn("gone", F.sum("weight").over(through))
    before = full.withColumn("full_before", F.col("full") - F.col("source_size") * cap).withColumn("gone_before", F.col("gone") - F.col("weight"))
    # the level if this and all later sources are below their caps; the first that holds sets it for all
    level = (F.col("total") - F.col("full_before")).cast("double") / (F.col("weights") - F.col("gone_before"))
    holds = before.withColumn("level", F.when(level * F.col("weight") <= F.col("source_size") * cap, level))
    holds = holds.withColumn("t", F.first("level", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    limit = (F.col("source_size") * cap).cast("double")
    return holds.select("source", "source_size", F.when(F.col("t").isNull(), limit).otherwise(F.least(limit, F.col("weight") * F.col("t"))).alias("target"))


def _tilt(size: Column) -> Column:
    return F.lit(1.0) + F.ln(size.cast("double"))


def rate_of(at: Column, size: Column, cap: int = MAX_COPIES) -> Column:
    """The rate of a document in millionths (a long), for its source's lambda."""
    rate = F.least(F.lit(float(cap)), F.exp(at * _tilt(size)))
    return F.when((size > 0) & at.isNotNull(), F.round(rate * GRAIN).cast("long")).otherwise(F.lit(0).cast("long"))


def balanced(counted: DataFrame, targets: DataFrame, cap: int = MAX_COPIES) -> DataFrame:
    """source and lambda (`at`) at the root of its dual's gradient, for rows (source, size, n) of sizes above 0, by Newton.

    A source that has `cap` times its size for a target needs no step: all its rates are `cap`.
    """
    top = math.log(cap)
    ratio = F.col("target") / F.col("source_size")
    full = F.col("target") >= F.col("source_size") * F.lit(float(cap))
    # all x are 1 or more, so at ln(ratio) <= 0 the rates are too low and at ln(cap) too high
    low, high = F.when(ratio < 1, F.ln(ratio)).otherwise(0.0), F.when(ratio < 1, 0.0).otherwise(top)
    start = targets.where("target > 0").select("source", "target", low.alias("low"), high.alias("high"), F.when(full, top).otherwise((low + high) / 2).alias("at"), full.alias("done"))
    state = materialize(start, "newton")
    for _ in range(STEPS):
        if state.where("not done").isEmpty():
            return state.select("source", "at")
        old, ahead = state, state
        for _ in range(STEPS_A_JOB):
            ahead = _newton_step(counted, ahead, cap)
        state = materialize(ahead, "newton")
        release(old)
    raise RuntimeError(f"no root in {STEPS * STEPS_A_JOB} steps")


def _newton_step(counted: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """`state` (source, target, low, high, at, done) after one more step."""
    x, top = _tilt(F.col("size")), math.log(cap)
    tokens = F.col("size") * F.col("n") * F.least(F.lit(float(cap)), F.exp(F.col("at") * x))
    slope = F.when(F.col("at") * x < top, tokens * x).otherwise(0.0)
    rows = counted.join(state, counted["source"].eqNullSafe(state["source"])).select(state["*"], "size", "n")
    sums = rows.groupBy("source", "target", "low", "high", "at", "done").agg((F.sum(tokens) - F.col("target")).alias("g"), F.sum(slope).alias("slope"))
    low, high = F.when(F.col("g") < 0, F.col("at")).otherwise(F.col("low")), F.when(F.col("g") > 0, F.col("at")).otherwise(F.col("high"))
    step = F.when(F.col("slope") > 0, F.col("at") - F.col("g") / F.col("slope"))
    near = (F.abs(F.col("g")) <= TOLERANCE * F.col("target")) | (F.col("high") - F.col("low") <= TOLERANCE)
    sums = sums.withColumn("done", F.col("done") | near).withColumn("low", low).withColumn("high", high).withColumn("step", step)
    inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
    at = F.when(F.col("done"), F.col("at")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
    return sums.select("source", "target", "low", "high", at.alias("at"), "done")


def uniform(key: Column) -> Column:
    """A whole number from 1 to 2 ** 48 from MD5 of the key; the same in any engine."""
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") + 1


def mix(docs: DataFrame, key: str = "doc_id", row: str | None = None) -> DataFrame:
    """key, source, size, source_size, target, rate, copies, taken for each row of `docs` (key, text, source); `row`: a unique long column to return too.

    Documents without words (null texts too) have rate 0 and no copies. Repeated rows count each on their own; a
    null source is a source; keys may be null or repeat. Other columns are ignored. An empty table gives an empty result.
    Each source's taken words miss its target by less than its smallest document with words that could still be taken.
    """
    own = F.monotonically_increasing_id() if row is None else F.col(row)
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    sized = materialize(docs.select(own.alias("row"), F.col(f"`{key}`").alias("key"), "source", word_count().alias("size"), uniform(name).alias("u")), "sized")
    targets = materialize(source_targets(sized), "targets")
    counted = materialize(sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counted")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    found = balanced(counted, targets)
    found = materialize(targets.join(found, same(targets, found), "left").select(targets["*"], "at"), "found")
    rate = rate_of(F.col("at"), F.col("size"))
    # whole copies; what a source still lacks goes out as single further copies
    whole = counted.join(found, same(counted, found)).select(found["source"], "target", (F.floor(rate / GRAIN) * F.col("size") * F.col("n")).alias("b"))
    lacks = materialize(whole.groupBy("source", "target").agg(F.sum("b").alias("b")).select("source", F.floor(F.col("target") - F.col("b") + 1e-6).cast("long").alias("lack")), "lacks")
    rated = sized.join(found, same(sized, found)).select(sized["*"], "source_size", "target", rate.alias("r"))
    part = F.col("r") % GRAIN
    asked = rated.where(part > 0).select("row", "source", "size", "key", (F.col("u") * F.lit(float(GRAIN)) / part).alias("turn"))
    got = materialize(_sampled(asked, lacks, max(1, sized.count() // RANGE_ROWS)), "copies")
    out = rated.join(got.withColumnRenamed("row", "taker"), F.col("row") == F.col("taker"), "left")
    copies = (F.floor(F.col("r") / GRAIN) + F.when(F.col("taker").isNotNull(), 1).otherwise(0)).cast("int")
    columns = [F.col("key").alias(key), "source", "size", "source_size", "target", (F.col("r") / GRAIN).alias("rate"), copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")]
    return out.select(*columns, *([] if row is None else [F.col("row").alias(row)]))


def _sampled(asked: DataFrame, lacks: DataFrame, ranges: int) -> DataFrame:
    """The `row`s of `asked` (row, source, size, key, turn) that get one more copy, for sources that lack so many tokens.

    In order of turn, each document that fits what is left is taken. A pass takes all up to the first that does not fit,
    from sums over ranges of the order. What is then left is less than a document, and of each size only as many documents as
    fit it together can still matter. Where it is at most FOLDED tokens, those few are folded over one by one, a source at a time; else passes go on.
    """
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    order = [F.col("turn"), F.col("key").asc_nulls_first(), F.col("size"), F.col("row")]
    place = F.struct("turn", F.col("key").isNotNull().alias("known"), "key", "size", "row")  # in the same order
    taken, left = [], lacks.where("lack > 0")
    while True:
        fits = asked.join(left, same(asked, left)).where("size <= lack").select(asked["*"], "lack")
        # documents that are taken have turns up to about 2 ** 48; those far beyond share a range
        spread = fits.withColumn("range", F.least(F.lit(2 * ranges), F.floor(F.col("turn") / F.lit(float(1 << 48)) * ranges)).cast("long"))
        sums = spread.groupBy("source", "range").agg(F.sum("size").alias("n"))
        earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        joined = spread.join(sums, same(spread, sums) & (spread["range"] == sums["range"])).select(spread["*"], "before").where("before <= lack")
        inside = Window.partitionBy("source", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        chosen = joined.withColumn("through", F.sum("size").over(inside) + F.col("before")).where("through <= lack")
        chosen = materialize(chosen.select("source", "row", "size", place.alias("place")), "chosen")
        taken.append(chosen.select("row"))
        now = chosen.groupBy("source").agg(F.sum("size").alias("now"), F.max("place").alias("last"))
        left = left.join(now, same(left, now)).select(left["source"], (F.col("lack") - F.col("now")).alias("lack"), "last").where("lack > 0")
        left = materialize(left, "lacks")
        # what comes later and still fits; of each size no more than fit together
        later = fits.drop("lack").join(left, fits["source"].eqNullSafe(left["source"])).where((place > F.col("last")) & (F.col("size") <= F.col("lack"))).select(fits["row"], fits["source"], "size", "key", "turn", "lack")
        of_size = Window.partitionBy("source", "size").orderBy(*order)
        later = later.withColumn("i", F.row_number().over(of_size)).where(F.col("i") <= F.floor(F.col("lack") / F.col("size"))).drop("i")
        asked = materialize(later, "asked")
        if asked.where(F.col("lack") > FOLDED).isEmpty():
            break
        asked, left = asked.drop("lack"), left.select("source", "lack")
    seed = lambda lack: F.struct(lack.alias("lack"), F.array().cast("array<long>").alias("rows"))
    fold = lambda s, p: F.when(p["size"] <= s["lack"], F.struct((s["lack"] - p["size"]).alias("lack"), F.array_append(s["rows"], p["row"]).alias("rows"))).otherwise(s)
    rest = asked.groupBy("source", "lack").agg(F.array_sort(F.collect_list(place)).alias("places"))
    rest = rest.select(F.explode(F.aggregate("places", seed(F.col("lack")), fold)["rows"]).alias("row"))
    for rows in taken:
        rest = rest.unionByName(rows)
    return rest


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; documents without words are not taken.

    Rows are told apart by a number of their own, so that rows that share a doc_id have copies of their own.
    Columns stay as they are, whatever their names.
    """
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    plan = mix(numbered, row="__row").where("copies > 0").select(F.col("__row").alias("__taken"), F.col("copies").alias("__copies"))
    joined = numbered.join(plan, F.col("__row") == F.col("__taken"))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The same mix as SQL: Newton by recursion, the sampling by so many passes of the prefix rule, which needs no ranges there.
_SQL_STEPS, _SQL_TURNS = 60, 16
ORACLE_MIXING = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 1 AS u
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM totals),
capped AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights,
         CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * 3 AS full_before,
         CAST(coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gone_before
  FROM ranked),
levels AS (
  SELECT *, CAST(total - full_before AS DOUBLE) / (weights - gone_before) AS level FROM capped),
level AS (
  SELECT level AS t FROM levels WHERE level * weight <= source_size * 3 ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN t IS NULL THEN CAST(source_size * 3 AS DOUBLE) ELSE least(CAST(source_size * 3 AS DOUBLE), weight * t) END AS target
  FROM ranked LEFT JOIN level ON true),
counted AS (SELECT source, size, count(*) AS n, 1.0::DOUBLE + ln(size::DOUBLE) AS x FROM sized WHERE size > 0 GROUP BY ALL),
newton(step, source, target, low, high, lambda_, done) AS (
  SELECT 0, source, target, CASE WHEN target < source_size THEN ln(target / source_size) ELSE 0.0::DOUBLE END, CASE WHEN target < source_size THEN 0.0::DOUBLE ELSE ln(3.0::DOUBLE) END,
         CASE WHEN target >= source_size * 3 THEN ln(3.0::DOUBLE) WHEN target < source_size THEN ln(target / source_size) / 2 ELSE ln(3.0::DOUBLE) / 2 END, target >= source_size * 3
  FROM targets WHERE target > 0
  UNION ALL
  SELECT step + 1, source, target, low, high, CASE WHEN done THEN lambda_ WHEN jump > low AND jump < high THEN jump ELSE (low + high) / 2 END, done
  FROM (
    SELECT step, source, target, lambda_, CASE WHEN g < 0 THEN lambda_ ELSE low END AS low, CASE WHEN g > 0 THEN lambda_ ELSE high END AS high,
           CASE WHEN slope > 0 THEN lambda_ - g / slope END AS jump, done OR abs(g) <= 1e-11 * target OR high - low <= 1e-11 AS done
    FROM (
      SELECT step, n.source, target, low, high, lambda_, done, sum(size * n * least(3.0, exp(lambda_ * x))) - target AS g,
             sum(CASE WHEN lambda_ * x < ln(3.0::DOUBLE) THEN size * n * least(3.0, exp(lambda_ * x)) * x ELSE 0.0 END) AS slope
      FROM newton n JOIN counted c ON n.source IS NOT DISTINCT FROM c.source WHERE step < {steps} GROUP BY step, n.source, target, low, high, lambda_, done))),
rates AS (
  SELECT c.source, c.size, c.n, CAST(round(least(3.0, exp(lambda_ * x)) * 1000000) AS BIGINT) AS rate
  FROM newton n JOIN counted c ON n.source IS NOT DISTINCT FROM c.source WHERE step = {steps}),
lacks AS (
  SELECT t.source, any_value(source_size) AS source_size, any_value(target) AS target, CAST(floor(any_value(target) - coalesce(sum(rate // 1000000 * size * n), 0) + 1e-6) AS BIGINT) AS lack
  FROM targets t LEFT JOIN rates r ON t.source IS NOT DISTINCT FROM r.source GROUP BY t.source),
t0 AS (
  SELECT d.doc_id, d.source, d.size, l.source_size, l.target, coalesce(rate, 0) // 1000000 AS base, coalesce(rate, 0) % 1000000 AS part,
         CASE WHEN rate % 1000000 > 0 THEN CAST(u AS DOUBLE) * 1000000.0 / (rate % 1000000) END AS turn, 0 AS extra, l.lack
  FROM sized d JOIN lacks l ON d.source IS NOT DISTINCT FROM l.source LEFT JOIN rates r ON d.source IS NOT DISTINCT FROM r.source AND d.size = r.size),
{turns}
SELECT doc_id, size, source_size, target, CAST((base + extra) * size AS BIGINT) AS taken FROM t{last}
"""
_TURN = """
a{i} AS (SELECT *, CASE WHEN extra = 0 AND size <= lack AND part > 0 THEN size ELSE 0 END AS asked FROM t{p}),
b{i} AS (SELECT *, sum(asked) OVER (PARTITION BY source ORDER BY turn, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM a{i}),
c{i} AS (SELECT * REPLACE (CASE WHEN asked > 0 AND through <= lack THEN 1 ELSE extra END AS extra),
         CASE WHEN asked > 0 AND through <= lack THEN asked ELSE 0 END AS got FROM b{i}),
t{i} AS (SELECT doc_id, source, size, source_size, target, base, part, turn, extra,
         CAST(lack - sum(got) OVER (PARTITION BY source) AS BIGINT) AS lack FROM c{i})"""
ORACLE_MIXING = ORACLE_MIXING.format(steps=_SQL_STEPS, turns=",".join(_TURN.format(i=i, p=i - 1) for i in range(1, _SQL_TURNS + 1)), last=_SQL_TURNS)
