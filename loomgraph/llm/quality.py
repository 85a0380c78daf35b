"""Quality rules: robust multivariate outliers by minimum covariance determinants per language and source.

Every text gets base counts. Texts that pass the base rules are turned into vectors of five transformed statistics; a
vector far from the robust centre of its language and source, by Mahalanobis distance, is rejected.

The estimate is fitted on all rows, by concentration steps that are Spark aggregations: each step bins the squared
distances of every row to its group's current model, and the least bins that hold the share `CORE` of the group give
the next mean and covariance. A step moves one row per group, start and bin. Two starts (medians with median absolute
deviations, and plain means with covariances) run side by side; the smaller determinant wins. FLOOR, added to each
standard deviation in quadrature, keeps statistics that are constant in clean text, such as a symbol count of zero, from
making every other value an outlier. Groups of fewer than LEAST rows use their language's model, then that of all rows.
That one is fitted from FEWEST rows on; fewer rows than twice the dimensions have no model, which keeps what passes the
base rules.

Null and empty texts have no words and fail the base rules. A null language or source is a value like any other. Rows
that repeat are counted and judged one by one, and each counts in the estimates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, blocks_for, column, encoded, folding, from_row, prepare, whole_row, windows, word_hashes

#: Share of a group's rows in the core, concentration steps, rows of a group with a model of its own.
CORE, STEPS, LEAST = 0.75, 8, 50
#: A clean vector lies beyond the cutoff with this probability, were vectors normal.
TAIL = 1e-7
#: Added to the standard deviation of each statistic: words, word length, symbols, repeated lines, repeated words.
FLOOR = (0.35, 0.08, 0.45, 0.6, 0.6)
P = len(FLOOR)
#: Rows for a model of all rows.
FEWEST = 2 * P
#: Vectors to a file.
VECTORS = 50_000
_SYMBOLS, _SPACES = b"#*$%&|<>", b"\x20\x09\x0a\x0b\x0c\x0d"


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(texts: Sequence[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(words, characters in words, symbols, repeated lines, words in repeated windows) of whole texts."""
    raw = encoded(texts)
    hashes, at = word_hashes(raw, *folding(lower=False))
    out = []
    for k, data in enumerate(raw):
        if not data:
            out.append((0, 0, 0, 0, 0))
            continue
        own = hashes[at[k] : at[k + 1]]
        spaces, symbols = (len(data) - len(data.translate(None, x)) for x in (_SPACES, _SYMBOLS))
        lines = [x for x in data.split(b"\n") if x and not x.isspace()]
        three = windows(own, 3)
        repeated = 0
        if len(three) > 1:
            order = np.sort(three)
            if (again := order[1:][order[1:] == order[:-1]]).size:
                several = np.isin(three, again)
                covered = np.zeros(len(own), bool)
                for j in range(3):
                    covered[j : j + len(three)] |= several
                repeated = int(covered.sum())
        out.append((len(own), len(texts[k]) - spaces, symbols, len(lines) - len(set(lines)), repeated))
    return out


def _counter():
    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(base_counts([t if isinstance(t, str) else None for t in texts]), columns=COUNTS, dtype="int64")

    return counts


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def vector(s: Column) -> list[Column]:
    """Words, word length, and symbols, repeated lines and repeated words per 100 words, on logarithmic scales."""
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return [F.log(n), F.log(F.greatest(s["word_chars"], F.lit(1)) / n), F.log1p(100 * s["n_symbols"] / n), F.log1p(100 * s["n_dup_lines"] / n), F.log1p(100 * s["n_repeat_words"] / n)]


def chi_square(x: float, k: int) -> float:
    """Distribution function for odd k."""
    total, term = 0.0, math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for j in range(1, k, 2):
        total += term
        term *= x / (j + 2)
    return math.erf(math.sqrt(x / 2)) - total


def chi_square_at(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, k) < q else (low, mid)
    return low


def _model(mean: np.ndarray, cov: np.ndarray) -> tuple:
    cov = cov + np.diag(np.square(FLOOR))
    return mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


_KEYS = ["level", "g_lang", "g_source"]
_MODEL = "level int, g_lang string, g_source string, start int, rows long, mean array<double>, precision array<double>, logdet double"
_UPPER = [(i, j) for i in range(P) for j in range(i, P)]


def squared_distance(x: list[Column], mean: Column, precision: Column) -> Column:
    d = [x[i] - mean[i] for i in range(P)]
    return sum(precision[i * P + j] * d[i] * d[j] * (1 if i == j else 2) for i, j in _UPPER)


def _concentrate(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
    """The next model of a group and start from its bins (at most 1,025 of them)."""
    bins = bins.sort_values("bin")
    rows = int(bins["n"].sum())
    upto = int(np.searchsorted(np.cumsum(bins["n"].to_numpy()), math.ceil(CORE * rows))) + 1
    core = bins.iloc[:upto]
    n = core["n"].sum()
    mean = np.array([core[f"s{i}"].sum() for i in range(P)]) / n
    second = np.zeros((P, P))
    for i, j in _UPPER:
        second[i, j] = second[j, i] = core[f"s{i}_{j}"].sum() / n
    cov = second - np.outer(mean, mean)
    share = n / rows
    scale = share / chi_square(chi_square_at(share, P), P + 2) if share < 1 else 1.0
    mean, precision, logdet = _model(mean, cov * scale)
    return pd.DataFrame([(*key[:4], rows, mean, precision, logdet)], columns=[*_KEYS, "start", "rows", "mean", "precision", "logdet"])


def fit(statistics: DataFrame, scratch: Scratch) -> DataFrame:
    """Models [level, g_lang, g_source, rows, mean, precision] from (lang, source, x array) rows; level 0 is one language and source, 1 a language, 2 all rows."""
    null = F.lit(None).cast("string")
    group = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("g_lang"), source.alias("g_source"))
    levels = F.array(group(0, F.col("lang"), F.col("source")), group(1, F.col("lang"), null), group(2, null, null))
    rows = statistics.select("x", F.explode(levels).alias("g")).select("x", "g.*")
    x = [F.col("x")[i] for i in range(P)]
    middle = rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("rows"), *[F.percentile_approx(x[i], 0.5, 1000).alias(f"m{i}") for i in range(P)], *[F.avg(x[i]).alias(f"a{i}") for i in range(P)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in _UPPER]).where(F.col("rows") >= F.when(F.col("level") == 2, FEWEST).otherwise(LEAST))
    middle = scratch.save(middle, "middle")
    files = blocks_for(middle.count())

    def joined(b: DataFrame) -> DataFrame:
        return rows.join(b, (rows.level == b.b_level) & rows.g_lang.eqNullSafe(b.b_lang) & rows.g_source.eqNullSafe(b.b_source))

    def renamed(b: DataFrame) -> DataFrame:
        return b.withColumnsRenamed({"level": "b_level", "g_lang": "b_lang", "g_source": "b_source"})

    spread_ = joined(renamed(middle)).groupBy(*_KEYS).agg(F.first("rows").alias("rows"), *[F.percentile_approx(F.abs(x[i] - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i in range(P)])
    both = spread_.select(*_KEYS, *[f"d{i}" for i in range(P)]).join(renamed(middle), (F.col("level") == F.col("b_level")) & F.col("g_lang").eqNullSafe(F.col("b_lang")) & F.col("g_source").eqNullSafe(F.col("b_source")))

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                key = (r["level"], r["g_lang"], r["g_source"])
                robust = _model(np.array([r[f"m{i}"] for i in range(P)]), np.diag([(1.4826 * r[f"d{i}"]) ** 2 for i in range(P)]))
                cov = np.zeros((P, P))
                for i, j in _UPPER:
                    cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
                plain = _model(np.array([r[f"a{i}"] for i in range(P)]), cov)
                out += [(*key, 0, r["rows"], *robust), (*key, 1, r["rows"], *plain)]
            yield pd.DataFrame(out, columns=[*_KEYS, "start", "rows", "mean", "precision", "logdet"])

    models = scratch.save(both.mapInPandas(starts, _MODEL), "models-0", files)
    for k in range(1, STEPS + 1):
        m = renamed(models.drop("rows", "logdet"))
        d = squared_distance(x, F.col("mean"), F.col("precision"))
        binned = joined(m).select(*_KEYS, "start", "x", F.least(F.lit(1024), F.floor(32 * F.log2(1 + 64 * F.greatest(d, F.lit(0.0))))).cast("int").alias("bin"))
        bins = binned.groupBy(*_KEYS, "start", "bin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)], *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in _UPPER])
        models = scratch.save(bins.groupBy(*_KEYS, "start").applyInPandas(_concentrate, _MODEL), f"models-{k}", files)
        scratch.drop(f"models-{k - 1}")
    best = models.groupBy(*_KEYS).agg(F.min_by(F.struct("rows", "mean", "precision"), F.struct("logdet", "start")).alias("m")).select(*_KEYS, "m.*")
    return scratch.save(best, "fitted", files)


def judged(rows: DataFrame, models: DataFrame, s: Column) -> DataFrame:
    """`rows` (with lang and source) and __failed, __distance, __kept from the nearest model that there is."""
    out = rows
    for level in (0, 1, 2):
        m = models.where(F.col("level") == level).select(F.col("g_lang").alias(f"__l{level}"), F.col("g_source").alias(f"__s{level}"), F.struct("mean", "precision").alias(f"__m{level}"))
        on = F.lit(True)
        if level < 2:
            on = F.col("lang").eqNullSafe(F.col(f"__l{level}"))
        if level < 1:
            on &= F.col("source").eqNullSafe(F.col(f"__s{level}"))
        # The model of all rows is one row at most.
        out = out.join(F.broadcast(m) if level == 2 else m, on, "left")
    model = F.coalesce("__m0", "__m1", "__m2")
    failed = F.coalesce(base_failed(s), F.lit(True))
    distance = squared_distance(vector(s), model["mean"], model["precision"])
    cutoff = chi_square_at(1 - TAIL, P)
    out = out.withColumn("__failed", failed).withColumn("__distance", distance)
    out = out.withColumn("__kept", ~F.col("__failed") & F.coalesce(F.col("__distance") <= cutoff, F.lit(True)))
    return out.drop(*[f"__{c}{level}" for level in (0, 1, 2) for c in "lsm"])


def _fitted(table: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """Models of a table with lang, source and s. The steps read the vectors alone, in as few files as these need."""
    vectors = table.where(~base_failed(F.col("s"))).select("lang", "source", F.array(*vector(F.col("s"))).alias("x"))
    return fit(scratch.save(vectors, "vectors", blocks_for(rows, VECTORS)), scratch)


def _counted(docs: DataFrame, scratch: Scratch, text_col: str, lang_col: str, source_col: str, **more: Column) -> tuple[DataFrame, int]:
    """[*more, lang, source, s], written, as texts are counted once; and the number of rows."""
    kinds = [column(c).cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    return scratch.counted(docs.select(*[c.alias(n) for n, c in more.items()], *kinds, _counter()(column(text_col).cast("string")).alias("s")), "counted")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """[id_col, five counts, base_failed, kept, distance]: one row per row of docs."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    table, rows = _counted(docs, scratch, text_col, lang_col, source_col, __id=column(id_col))
    out = judged(table, _fitted(table, rows, scratch), F.col("s"))
    return out.select(F.col("__id").alias(id_col), *[F.col("s")[c].alias(c) for c in COUNTS], F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__distance").alias("distance"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that are kept, with their columns; texts are not shuffled."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    table, rows = _counted(docs, scratch, text_col, lang_col, source_col, __row=whole_row(docs))
    return judged(table, _fitted(table, rows, scratch), F.col("s")).where("__kept").select(*from_row("__row", docs.columns))
