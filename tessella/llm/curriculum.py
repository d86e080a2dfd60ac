"""Mixing sources to target weights by a time-varying curriculum.

Each source has a schedule: its weight as a function of training progress, which runs from 0 to 1. The integral of the schedule is the
source's share of the words; shares that ask for more repeats of a source than allowed are cut, and what they lose is dealt to the
other sources by weight. A source's documents stand in an order by hash, pass after pass, so each copy begins at some number of words
of its source. The schedule's running integral says how many words of the source are due by each moment; its inverse turns that number
into the copy's training position, and one range sort by position mixes all sources.

Sums of words before a document are taken in three steps (within a block of hashes, over blocks, over groups of blocks), so that no source, however
large, is summed in one task. Sources are numbered by a range sort, and shares are cut by rounds of two sums each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
_SPACES = "".join(map(chr, (0x20, *range(0x09, 0x0E))))


def word_count(text: Column) -> Column:
    """The number of words, by shortening each to one character: no list of them is made, however long the text."""
    return F.length(F.translate(F.regexp_replace(text, WORD, "x"), _SPACES, "")).cast("long")


@dataclass(frozen=True)
class Schedule:
    """A weight that is linear between knots (progress, weight); the first knot is at 0 and the last at 1."""

    knots: tuple[tuple[float, float], ...]

    def __post_init__(self):
        times = [t for t, _ in self.knots]
        if len(times) < 2 or times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:])):
            raise ValueError("knots must rise from progress 0 to progress 1")
        if any(w < 0 or not math.isfinite(w) for _, w in self.knots) or not self.total:
            raise ValueError("weights must be finite, not negative and not all zero")

    @property
    def pieces(self) -> list[tuple[float, float, float, float, float]]:
        """(begin, end, weight there, weight at the end, integral before) between knots."""
        out, before = [], 0.0
        for (a, u), (b, v) in zip(self.knots, self.knots[1:]):
            out.append((a, b, u, v, before))
            before += (b - a) * (u + v) / 2
        return out

    @property
    def total(self) -> float:
        a, b, u, v, before = self.pieces[-1]
        return before + (b - a) * (u + v) / 2

    def moment(self, share: Column) -> Column:
        """When this share (0 to 1) of the integral is reached."""
        due, out = share * F.lit(self.total), None
        for a, b, u, v, before in reversed(self.pieces):
            if u + v == 0:
                continue
            rest = F.greatest(due - F.lit(before), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(u * u) + F.lit(2 * (v - u) / (b - a)) * rest, F.lit(0.0)))
            at = F.when(rest <= 0, F.lit(float(a))).otherwise(F.least(F.lit(float(b)), F.lit(float(a)) + F.lit(2.0) * rest / (F.lit(float(u)) + root)))
            out = at if out is None else F.when(due >= F.lit(before + (b - a) * (u + v) / 2), out).otherwise(at)
        return out


@dataclass(frozen=True)
class MixParams:
    """The schedules are dealt to the sources in turn, by code point of their names, null last; their integrals weigh 3, 1 and 2."""

    schedules: tuple[Schedule, ...] = (Schedule(((0, 4), (1, 2))), Schedule(((0, 1), (1, 1))), Schedule(((0, 1), (0.5, 1), (1, 5))))
    #: Words of the mix as a share of all words.
    share: float = 1.5
    #: How often the mix may take a source.
    most_repeats: float = 2.0
    block_rows: int = 1024


def _sources(sized: DataFrame) -> DataFrame:
    """(name, null, number, source_size): number is the place by code point, null last. Places come from a range sort and the sizes of its parts."""
    by_name = sized.groupBy("name", "null").agg(F.sum("size").alias("source_size")).orderBy("null", "name")
    placed = by_name.withColumn("place", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftrightunsigned("place", 33)
    before, offsets = 0, []
    for row in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # one row for each part of the sort
        offsets.append((row.part, before))
        before += row.n
    parts = sized.sparkSession.createDataFrame(offsets, "part long, before long")
    own = F.col("place") - F.shiftleft(part, 33)
    return placed.join(F.broadcast(parts), part == F.col("part")).select("name", "null", (F.col("before") + own).alias("number"), "source_size")


def targets(sources: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """``sources`` (number, source_size, ...) with ``weight`` and ``target``: shares of all words by weight, cut at ``most_repeats`` times a source's size,
    the rest dealt again by weight until none is above."""
    kind = F.pmod("number", F.lit(len(p.schedules)))
    weight = F.element_at(F.array(*(F.lit(float(s.total)) for s in p.schedules)), (kind + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("most", F.lit(p.most_repeats) * F.col("source_size"))
    level, free_before = None, None
    while True:
        free = F.lit(True) if level is None else F.col("weight") * F.lit(level) <= F.col("most")
        row = weighed.agg(F.sum(F.when(free, F.col("weight"))).alias("weight"), F.sum(F.when(free, 0.0).otherwise(F.col("most"))).alias("fixed"), F.sum("source_size").alias("size"), F.count_if(free).alias("free")).first()
        if not row.free or row.free == free_before:
            break
        free_before, level = row.free, (p.share * row.size - row.fixed) / row.weight
    target = F.col("most") if level is None or not row.free else F.least(F.col("most"), F.col("weight") * F.lit(level))
    return weighed.withColumn("target", target).drop("most")


def mix(docs: DataFrame, p: MixParams = MixParams(), keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row, sorted by first position: doc_id, size (words), source_size, target, taken (words, repeats counted), places and doc.

    ``places`` has (pass, words, position) of each time the mix takes the document, position from 0 to 1; ``doc`` holds the columns ``keep``, so that no name
    clashes. Of a source's order the mix takes the first floor(target) words: all documents as often as whole passes fit, then those before
    the border, and the document at the border in part. The order within a source goes by MD5 of id and text, then id and size, and is the
    same in every run. Null text has size 0, a null source is one of its own, rows without words are never taken, and repeated rows are
    each a document of its own (which of them lies before the border makes no difference). An empty table gives no rows. Rows that
    repeat both id and text are summed in one task, which holds one row at a time and spills.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "), text))
    sized = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("name"),
        F.col(source_col).isNull().alias("null"),
        word_count(text).alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("hash"),
        (F.struct(*keep) if keep else F.lit(None)).alias("doc"),
    ).checkpoint()
    sources = targets(_sources(sized), p)
    bits = max(0, math.ceil(math.log2(max(1, sized.count()) / p.block_rows)))
    sized = sized.withColumn("block", F.shiftright("hash", 60 - bits))
    source = ["name", "null"]
    cells = sized.groupBy(*source, "block").agg(F.sum("size").alias("words")).withColumn("area", F.shiftright("block", bits // 2))
    areas = cells.groupBy(*source, "area").agg(F.sum("words").alias("words"))
    earlier = lambda value, keys, by: F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    areas = areas.withColumn("before_area", earlier("words", source, ["area"])).drop("words").join(sources, source)
    cells = cells.withColumn("before_block", earlier("words", [*source, "area"], ["block"])).drop("words").join(areas, [*source, "area"])
    rows = sized.withColumn("before", earlier("size", [*source, "block"], ["hash", "id", "size"])).join(cells, [*source, "block"])
    rows = rows.withColumn("at", F.col("before_area") + F.col("before_block") + F.col("before"))
    kind = F.pmod("number", F.lit(len(p.schedules)))

    def place(again: int) -> Column:
        begin = F.col("at") + F.lit(again) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - begin)).cast("long")
        due, moment = F.try_divide(begin, "target"), None
        for k, s in enumerate(p.schedules):
            moment = s.moment(due) if moment is None else F.when(kind == k, s.moment(due)).otherwise(moment)
        return F.struct(F.lit(again).alias("pass"), words.alias("words"), F.when(words > 0, moment).alias("position"))

    places = F.filter(F.array(*(place(k) for k in range(math.ceil(p.most_repeats)))), lambda x: x["words"] > 0)
    taken = F.aggregate("places", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    out = rows.withColumn("places", places).withColumn("taken", taken)
    return out.orderBy(F.get("places", F.lit(0))["position"].asc_nulls_last(), "hash").select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "places", "doc")


def training_order(docs: DataFrame, p: MixParams = MixParams(), keep: tuple[str, ...] = ("text",), **columns: str) -> DataFrame:
    """The mix itself: (doc_id, pass, words, position, doc) for each time it takes a document, range-sorted by position."""
    mixed = mix(docs, p, keep, **columns)
    return mixed.select(mixed.columns[0], F.explode("places").alias("place"), "doc").select(mixed.columns[0], "place.*", "doc").orderBy("position", mixed.columns[0], "pass")


#: DuckDB SQL for the rows of the query: sizes, shares cut and dealt again, and running sums by source; the last schedule has a knot at 0.5.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][number % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s),
o AS (  -- sources in the order in which a rising level reaches their limits
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS fixed,
         sum(weight) OVER (ORDER BY most / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS free,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS words FROM w),
l AS (SELECT max((words - fixed) / free) FILTER (WHERE weight * ((words - fixed) / free) <= most) AS level FROM o),
t AS (SELECT source, number, source_size, least(most, weight * coalesce(level, 'Infinity'::DOUBLE)) AS target FROM w, l),
a AS (
  SELECT d.*, number, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY hash, d.doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - before)) AS one, greatest(0, least(size, floor(target)::BIGINT - before - source_size)) AS two,
         before / target AS f FROM a)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
       CASE WHEN one > 0 THEN round(CASE number % 3
         WHEN 0 THEN 2 * (3 * f) / (4 + sqrt(16 - 4 * (3 * f)))
         WHEN 1 THEN f
         ELSE CASE WHEN 2 * f < 0.5 THEN 2 * f ELSE 0.5 + 2 * (2 * f - 0.5) / (1 + sqrt(1 + 16 * (2 * f - 0.5))) END END, 6) END AS position
FROM b
"""
