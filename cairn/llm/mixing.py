"""Mixing sources to target weights that vary over training time.

A schedule gives weights per source at knots of training time from 0 to 1; between knots they are interpolated, and at
each time they are taken in proportion to their sum over the sources. The integral of a source's weight up to a time is its
cumulative demand (times the token budget). A source's documents stand in the order of a hash of their id; the demand,
inverted at the middle of a document's span of the source's tokens, is its training position. Documents are range-sorted
by position.

There are two budgets. The common one (the query with SQL) is the largest that no source falls short of; documents beyond their
source's demand are left out, so a scarce source removes most of the others. ``whole`` (``mix`` and the pipeline) gives each
source a budget of its own, its tokens by its share: every document of a source with weight stands in the result once, what a
scarce source can't supply is left to the others at every time, and each source's course over time is still its schedule's.

A source without tokens gets no weight. Null sources are a source of their own (""). Nulls and empty texts count one
token. Equal hashes (repeated rows, equal ids) are ordered by id, then length: such rows are interchangeable. A null id
hashes as the empty text. Very long texts count all their characters. An empty frame gives an empty one. The running sums go by ranges
of the hash, so a hot source never stands in one task. Columns may have any names: only key, text and source are read, and ``mix``
carries the others inside a structure.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import common

#: The default curriculum: knot -> exponent of the sources' natural shares (1 keeps them, less makes them more equal).
KNOTS = ((0.0, 0.9), (0.5, 0.7), (1.0, 0.5))
CHARS_PER_TOKEN = 4
#: Hash ranges per source: the first hexadecimal digits of the hash.
DIGITS = 3


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.length(text), F.lit(0)) / CHARS_PER_TOKEN)).cast("long")


def shares_schedule(supply: dict[str, int], knots=KNOTS) -> dict[str, list[tuple[float, float]]]:
    """Weights by source at the knots: powers of the sources' shares of all tokens, in sorted order of the sources."""
    total = sum(supply.values())
    out: dict[str, list[tuple[float, float]]] = {s: [] for s in sorted(supply)}
    for at, power in knots:
        raw = {s: (supply[s] / total) ** power for s in out}
        norm = sum(raw[s] for s in out)
        for s in out:
            out[s].append((at, raw[s] / norm))
    return out


def pieces(schedule: dict[str, list[tuple[float, float]]]) -> list[tuple[str, float, float, float, float, float]]:
    """(source, start, length, weight at start, slope, demand before) of each piece, demand as a share of the budget."""
    rows = []
    for s, knots in sorted(schedule.items()):
        before = 0.0
        for (a, x), (b, y) in zip(knots, knots[1:]):
            rows.append((s, a, b - a, x, (y - x) / (b - a), before))
            before += (x + y) / 2 * (b - a)
    return rows


def assign(docs: DataFrame, schedule: dict[str, list[tuple[float, float]]] | None = None, key: str = "doc_id", text: str = "text", source: str = "source", whole: bool = False) -> DataFrame:
    """(k, s, n, position) of the chosen rows of ``docs``, of all rows of the schedule's sources if ``whole``: not sorted yet."""
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("k"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), tokens(F.col(text).cast("string")).alias("n"))
    slim = slim.withColumn("h", F.md5(F.coalesce(F.col("k").cast("string"), F.lit(""))))
    bucket = F.substring("h", 1, DIGITS)
    sums = slim.groupBy("s", bucket.alias("g")).agg(F.sum("n").alias("n"))
    sums = common.stored(sums.withColumn("before", F.expr("sum(n) over (partition by s order by g) - n")), "sums")
    supply = {r.s: int(r.n) for r in sums.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # one row a source
    schedule = schedule or shares_schedule(supply)
    known = {s: k for s, k in schedule.items() if supply.get(s, 0) > 0}
    rows = pieces(known)
    share = {s: 0.0 for s in known}
    for s, _, length, x, slope, before in rows:
        share[s] = before + x * length + slope * length * length / 2
    budget = min((supply[s] / share[s] for s in known if share[s] > 0), default=0.0)
    upto = [base + x * length + slope * length * length / 2 for _, _, length, x, slope, base in rows]
    own = {s: budget if budget > 0 else 1.0 for s in known}
    if whole:  # no demand is between two pieces or behind the last
        some = [r for r, end in zip(rows, upto) if end > r[5]]
        upto = [nxt[5] if nxt and nxt[0] == r[0] else math.inf for r, nxt in zip(some, [*some[1:], None])]
        rows, own = some, {s: supply[s] / share[s] for s in known if share[s] > 0}
    pieces_of = [(*r, end, own[r[0]]) for r, end in zip(rows, upto)]
    table = spark.createDataFrame(pieces_of or [("", 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 1.0)], "s string, a double, length double, x double, slope double, base double, upto double, budget double")
    # each document's place among its source's tokens; the hash range's sum comes by a join, the rest by a window in it
    n, h = tokens(F.col(text).cast("string")), F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    placed = slim.withColumn("g", bucket).withColumn("inside", F.expr("sum(n) over (partition by s, g order by h, k, n rows unbounded preceding)"))
    placed = placed.join(sums.select("s", "g", "before"), ["s", "g"]).withColumn("mid", F.col("before") + F.col("inside") - F.col("n") / 2.0)
    # the piece whose demand holds q
    fits = placed.join(F.broadcast(table), "s").withColumn("q", F.col("mid") / F.col("budget")).where((F.col("q") >= F.col("base")) & (F.col("q") < F.col("upto")))
    rest = F.col("q") - F.col("base")
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("x") * F.col("x") + 2 * F.col("slope") * rest))
    position = F.col("a") + 2 * rest / (F.col("x") + root)
    return fits.select("k", "s", "n", F.round(position, 9).alias("position"))


def positions(docs: DataFrame, schedule: dict[str, list[tuple[float, float]]] | None = None, whole: bool = False) -> DataFrame:
    """(doc_id, source, tokens, position) of the chosen documents, range-sorted by position."""
    p = assign(docs, schedule, whole=whole)
    return p.select(F.col("k").alias("doc_id"), F.col("s").alias("source"), F.col("n").alias("tokens"), "position").orderBy("position", "doc_id")


def mix(docs: DataFrame, schedule: dict[str, list[tuple[float, float]]] | None = None, key: str = "doc_id") -> DataFrame:
    """All rows of the schedule's sources with all their columns, range-sorted by position. Rows that share an id go together, at the first's place."""
    p = common.stored(assign(docs, schedule, key, whole=True).groupBy("k").agg(F.min("position").alias("position")), "positions")
    few = p.count() <= common.BROADCAST_IDS
    # the frame's columns go under one name, so what they are called doesn't matter
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("id"))
    joined = rows.join(F.broadcast(p) if few else p, F.col("id").eqNullSafe(F.col("k")))
    return joined.orderBy("position", "id").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(common.documents(spark, sf_dir))


def whole_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(common.documents(spark, sf_dir), whole=True)


SQL = f"""
WITH d AS (SELECT doc_id AS k, coalesce(source, '') AS s, greatest(1, CAST(ceil(coalesce(length(text), 0) / {CHARS_PER_TOKEN}.0) AS BIGINT)) AS n,
             md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
supply AS (SELECT s, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY s),
share AS (SELECT s, n, CAST(n AS DOUBLE) / (SELECT CAST(sum(n) AS DOUBLE) FROM supply) AS p FROM supply),
raw AS (SELECT s, n, {', '.join(f'pow(p, {power}) AS r{i}' for i, (_, power) in enumerate(KNOTS))} FROM share),
w AS (SELECT s, n, {', '.join(f'r{i} / (SELECT sum(r{i}) FROM raw) AS w{i}' for i in range(len(KNOTS)))} FROM raw),
pieces AS ({' UNION ALL '.join(f"SELECT s, {KNOTS[i][0]}::DOUBLE AS a, {KNOTS[i + 1][0] - KNOTS[i][0]}::DOUBLE AS len, w{i} AS x, (w{i + 1} - w{i}) / {KNOTS[i + 1][0] - KNOTS[i][0]}::DOUBLE AS slope, {' + '.join(['0.0::DOUBLE'] + [f'(w{j} + w{j + 1}) / 2 * {KNOTS[j + 1][0] - KNOTS[j][0]}::DOUBLE' for j in range(i)])} AS base FROM w" for i in range(len(KNOTS) - 1))}),
budget AS (SELECT min(n / ({' + '.join(f'(w{j} + w{j + 1}) / 2 * {KNOTS[j + 1][0] - KNOTS[j][0]}::DOUBLE' for j in range(len(KNOTS) - 1))})) AS b FROM w),
placed AS (SELECT k, s, n, (sum(n) OVER (PARTITION BY s ORDER BY h, k, n ROWS UNBOUNDED PRECEDING) - n / 2.0::DOUBLE) / (SELECT b FROM budget) AS q FROM d)
SELECT k AS doc_id, placed.s AS source, n AS tokens,
       round(a + 2 * (q - base) / (x + sqrt(greatest(0.0, x * x + 2 * slope * (q - base)))), 9) AS position
FROM placed JOIN pieces ON placed.s = pieces.s WHERE q >= base AND q < base + x * len + slope * len * len / 2
"""
