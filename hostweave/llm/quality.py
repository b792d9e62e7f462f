"""Quality rules: statistics of texts, and robust multivariate outliers per language and source.

Statistics are transformed to a vector of four numbers. For each group the minimum covariance
determinant is sought by concentration steps: the half of the rows that lies nearest under the
current centre and covariance gives the next ones. A step is one aggregation by group and
distance bin over all rows, so a group of any size is spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.llm import texts as tx
from hostweave.llm.tables import only, schema_with, set_aside, written

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
REPEAT = 8
#: Least words; most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30

#: Words of an average text that each statistic is pulled towards, so that short texts vary less.
PRIOR_WORDS = 20
#: Spread of the transformed statistics that no group goes below: word length, symbols, lines, repeats.
#: Of each the extreme that the base rules let pass lies beyond the cut by itself where a group has none of it.
FLOORS = (0.08, 0.5, 0.75, 0.05)
DIMS = range(len(FLOORS))
#: Rows that a group needs for an estimate of its own.
LEAST_ROWS = 40
#: Quantiles of the chi-square law: rows that count in the final estimate; rows beyond are rejected.
COUNTED, KEPT = 0.975, 0.99999
#: Bins for each doubling of the squared distance.
BINS = 32
#: Groups up to which their estimates are broadcast.
BROADCAST_GROUPS = 10_000


def statistics(texts: pa.StringArray) -> dict[str, np.ndarray]:
    """The five statistics of each text, whole."""
    raw, offsets = tx.buffer_of(texts)

    def per_text(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))[offsets])

    words, bounds = tx.words(texts)
    return {
        "n_words": np.diff(bounds),
        "word_chars": per_text(~tx.WHITE[raw] & ((raw & 0xC0) != 0x80)),
        "n_symbols": per_text(SYMBOLS[raw]),
        "n_dup_lines": _repeated_lines(texts),
        "n_repeat_words": _repeated_words(tx.codes(words)[0], bounds),
    }


def _repeated_lines(texts: pa.StringArray) -> np.ndarray:
    split = pc.split_pattern(texts, "\n")
    text = pc.list_parent_indices(split).to_numpy()
    lines = pc.list_flatten(split)
    own = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    code, distinct = tx.codes(lines.filter(pa.array(own)))
    first = np.unique(text[own] * max(1, len(distinct)) + code) // max(1, len(distinct))
    return np.bincount(text[own], minlength=len(texts)) - np.bincount(first, minlength=len(texts))


def _repeated_words(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words in windows of eight that occur twice or more in their text; equal windows get equal
    numbers by numbering pairs of words, of pairs and of fours."""
    n = len(code)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if n < REPEAT:
        return np.zeros(len(bounds) - 1, np.int64)
    rank, span = code, 1
    while span < REPEAT:
        pair = rank[: n - 2 * span + 1] * (rank.max() + 1) + rank[span : n - span + 1]
        rank, span = np.unique(pair, return_inverse=True)[1], 2 * span
    begin = np.flatnonzero(text[: n - REPEAT + 1] == text[REPEAT - 1 :])
    _, at, many = np.unique(text[begin] * (rank.max() + 1) + rank[begin], return_inverse=True, return_counts=True)
    begin = begin[many[at] > 1]
    edge = np.zeros(n + 1, np.int64)
    edge[begin] += 1
    edge[begin + REPEAT] -= 1
    return np.bincount(text[np.cumsum(edge[:-1]) > 0], minlength=len(bounds) - 1)


def with_statistics(documents: DataFrame) -> DataFrame:
    """The documents' columns and the five statistics; null text has none of anything."""
    fields = documents.schema.fields

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.sliced(batches, "text"):
            found = statistics(tx.strings(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in fields] + [pa.array(found[s], pa.int64()) for s in STATS],
                [f.name for f in fields] + list(STATS),
            )

    return documents.mapInArrow(measure, schema_with(fields, ", ".join(f"{s} long" for s in STATS)))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics: log of the mean word length, log of symbols and of repeated lines a
    hundred words, share of repeated words, each with ``PRIOR_WORDS`` average words added."""
    n = F.col("n_words") + PRIOR_WORDS
    return [
        F.log((F.col("word_chars") + 5 * PRIOR_WORDS) / n),
        F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(100 * F.col("n_dup_lines") / n),
        F.col("n_repeat_words") / n,
    ]


def _named(group: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null"))


def chi_square(p: int, share: float) -> float:
    """Quantile of the chi-square law of an even number of degrees of freedom."""
    low, high = 0.0, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(p, middle) < share else (low, middle)
    return high


def chi_square_share(p: int, x: float) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def _distance(centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance of _v0.._v3, given the inverse covariance row by row."""
    d = [F.col(f"_v{i}") - centre[i] for i in DIMS]
    terms = [inverse[len(DIMS) * i + j] * d[i] * d[j] for i in DIMS for j in DIMS]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


MOMENTS = [f"_s{i}" for i in DIMS] + [f"_p{i}{j}" for i in DIMS for j in DIMS if i <= j]


def _moments() -> list[Column]:
    first = [F.sum(f"_v{i}").alias(f"_s{i}") for i in DIMS]
    return first + [F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")).alias(f"_p{i}{j}") for i in DIMS for j in DIMS if i <= j]


ESTIMATE = "_group string, _start int, _rows long, _centre array<double>, _inverse array<double>, _logdet double"


def _estimates(sums: DataFrame, scale: float) -> DataFrame:
    """Centre and regularised covariance of each _group and _start from counts and moments."""
    floors = np.square(FLOORS)

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(floors)
        for batch in batches:
            n = np.maximum(batch.column("_n").to_numpy(), 1)
            get = {m: batch.column(m).to_numpy(zero_copy_only=False) for m in MOMENTS}
            centre = np.stack([get[f"_s{i}"] / n for i in range(p)], axis=1)
            cov = np.empty((len(n), p, p))
            for i in range(p):
                for j in range(i, p):
                    cov[:, i, j] = cov[:, j, i] = scale * (get[f"_p{i}{j}"] / n - centre[:, i] * centre[:, j])
            cov += np.diag(floors)
            inverse, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_group"), batch.column("_start"), batch.column("_rows"), pa.array(centre.tolist(), pa.list_(pa.float64())),
                 pa.array(inverse.reshape(len(n), p * p).tolist(), pa.list_(pa.float64())), pa.array(logdet)],
                ["_group", "_start", "_rows", "_centre", "_inverse", "_logdet"],
            )

    return sums.select("_group", "_start", "_rows", "_n", *MOMENTS).mapInArrow(solve, ESTIMATE)


def _beside(rows: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    return rows.join(F.broadcast(estimates) if groups <= BROADCAST_GROUPS else estimates, "_group")


def _nearest_half(rows: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """Moments of each group's rows in the distance bins that hold its nearer half."""
    tiny = 2.0**-20
    bin_ = F.floor(BINS * F.log2(_distance(F.col("_centre"), F.col("_inverse")) + tiny)).cast("int")
    binned = (
        _beside(rows, estimates, groups)
        .groupBy("_group", "_start", "_rows", bin_.alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_n"), *_moments())
    )
    nearer = Window.partitionBy("_group", "_start").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    needed = F.expr(f"(_rows + {len(DIMS) + 1}) div 2")
    return (
        binned.withColumn("_before", F.coalesce(F.sum("_n").over(nearer), F.lit(0)))
        .where(F.col("_before") < needed)
        .groupBy("_group", "_start", "_rows")
        .agg(F.sum("_n").alias("_n"), *[F.sum(m).alias(m) for m in MOMENTS])
    )


def grouped(measured: DataFrame) -> DataFrame:
    """Measured documents with base_failed, their vector _v0.. and the names of their groups."""
    named = measured.withColumn("base_failed", base_failed())
    named = named.withColumn("_own", F.concat_ws("\x01", _named("lang"), _named("source"))).withColumn("_lang", _named("lang"))
    return named.select("*", *[v.alias(f"_v{i}") for i, v in enumerate(vector())])


def fit(measured: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Estimates from all measured documents that pass the base rules.

    Groups are language and source; those of fewer than ``LEAST_ROWS`` rows are put together by
    language, and what is still smaller, all together. Returns which _group each _own name belongs
    to, the _centre and _inverse of each _group, and the number of names.

    Starts are medians with spreads from the median deviation, and means with covariances; each
    takes concentration steps until no determinant falls, and the lower determinant wins. The half's
    covariance is scaled to agree with normal data. Rows within the ``COUNTED`` quantile then give
    the final estimate. ``FLOORS`` are added to every covariance, so a group whose half is all
    alike has one, too. Nearness is told in bins of 2% of the squared distance, ties included.
    """
    good = grouped(measured).where(~F.col("base_failed")).select("_own", "_lang", *[f"_v{i}" for i in DIMS])
    sizes = good.groupBy("_own", "_lang").agg(F.count(F.lit(1)).alias("_n"))
    small = F.col("_n") < LEAST_ROWS
    in_lang = F.sum(F.when(small, F.col("_n"))).over(Window.partitionBy("_lang"))
    group = F.when(~small, F.col("_own")).when(in_lang >= LEAST_ROWS, F.col("_lang")).otherwise(F.lit("all"))
    names = written(sizes.select("_own", group.alias("_group")), "quality-groups")
    count = names.count()
    rows = written(good.join(F.broadcast(names) if count <= BROADCAST_GROUPS else names, "_own").drop("_own", "_lang"), "quality-rows")

    medians = [F.percentile_approx(f"_v{i}", 0.5, 1000).alias(f"_m{i}") for i in DIMS]
    middle = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"), *medians, *_moments())
    middle = written(middle, "quality-medians")
    spread = [F.percentile_approx(F.abs(F.col(f"_v{i}") - F.col(f"_m{i}")), 0.5, 1000).alias(f"_d{i}") for i in DIMS]
    spreads = _beside(rows, middle.select("_group", *[f"_m{i}" for i in DIMS]), count).groupBy("_group").agg(*spread)
    robust = middle.join(spreads, "_group")
    for i in DIMS:  # the moments that make these medians and spreads centre and covariance
        for j in DIMS[i:]:
            extra = F.pow(1.4826 * F.col(f"_d{i}"), F.lit(2.0)) if i == j else F.lit(0.0)
            robust = robust.withColumn(f"_p{i}{j}", (F.col(f"_m{i}") * F.col(f"_m{j}") + extra) * F.col("_rows"))
    for i in DIMS:
        robust = robust.withColumn(f"_s{i}", F.col(f"_m{i}") * F.col("_rows"))
    columns = ["_group", F.col("_rows").alias("_n"), "_rows", *MOMENTS]
    starts = robust.select(*columns, F.lit(0).alias("_start")).unionByName(middle.select(*columns, F.lit(1).alias("_start")))
    current = written(_estimates(starts, 1.0), "quality-start")

    half = chi_square(len(DIMS), 0.5)
    to_normal = 0.5 / chi_square_share(len(DIMS) + 2, half)
    while True:
        # A step does not raise the determinant but by the bins; where it falls no more, it has converged.
        following = _estimates(_nearest_half(rows, current, count), to_normal)
        was = current.select("_group", "_start", F.struct(*[c for c in current.columns if c[1:] not in ("group", "start")]).alias("_was"))
        paired = written(following.join(was, ["_group", "_start"]).withColumn("_falls", F.col("_logdet") < F.col("_was._logdet") - 1e-9), "quality-step")
        kept = [F.when(F.col("_falls"), F.col(c)).otherwise(F.col(f"_was.{c}")).alias(c) for c in ("_rows", "_centre", "_inverse", "_logdet")]
        current = paired.select("_group", "_start", *kept)
        if paired.where("_falls").isEmpty():
            break
    best = F.min_by(F.struct("_rows", "_centre", "_inverse"), F.struct("_logdet", "_start")).alias("_best")
    best = current.groupBy("_group").agg(best).select("_group", F.lit(0).alias("_start"), "_best.*")
    counted = _beside(rows, best, count).where(_distance(F.col("_centre"), F.col("_inverse")) <= chi_square(len(DIMS), COUNTED))
    final = counted.groupBy("_group", "_start", "_rows").agg(F.count(F.lit(1)).alias("_n"), *_moments())
    return names, written(_estimates(final, 1.0).select("_group", "_centre", "_inverse"), "quality-estimates"), count


def judge(measured: DataFrame, fitted: tuple[DataFrame, DataFrame, int]) -> DataFrame:
    """Measured documents with base_failed, distance (squared Mahalanobis) and kept.

    A document that fails the base rules is not kept; any other is, unless its distance is beyond
    the ``KEPT`` quantile. One without an estimate (no group of its name was fitted) is kept.
    """
    names, estimates, count = fitted
    by_name = names.join(estimates, "_group").select("_own", "_centre", "_inverse")
    rows = grouped(measured).join(F.broadcast(by_name) if count <= BROADCAST_GROUPS else by_name, "_own", "left")
    distance = _distance(F.col("_centre"), F.col("_inverse"))
    inside = F.coalesce(distance <= chi_square(len(DIMS), KEPT), F.lit(True))
    judged = rows.withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & inside)
    return judged.drop("_own", "_lang", "_centre", "_inverse", *[f"_v{i}" for i in DIMS])


def quality_verdicts(documents: DataFrame) -> DataFrame:
    """Every document's doc_id, lang, source, its statistics, base_failed, distance and kept.

    Null text has no words and fails the base rules. Null languages and sources are groups of
    their own. Repeated rows are judged alike. Texts of any length are measured whole. Other columns
    are not read. An empty table gives no row.
    """
    measured = written(with_statistics(only(documents, "doc_id", "lang", "source", "text")).drop("text"), "quality-statistics")
    return judge(measured, fit(measured))


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns only.

    Their statistics are taken twice, for the estimates and for the verdict, so that no text is
    stored or shuffled.
    """
    documents, names = set_aside(documents, "lang", "source", "text")
    fitted = fit(written(with_statistics(documents.select("lang", "source", "text")).drop("text"), "quality-statistics"))
    return judge(with_statistics(documents), fitted).where("kept").select(*documents.columns).toDF(*names)
