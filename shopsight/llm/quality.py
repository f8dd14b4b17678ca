"""Quality rules: base counts, and robust multivariate outliers per language and source.

Counts of every text (words, symbols, repeated lines and words) give a base
rule and a statistic vector. Per (language, source) group a
minimum-covariance-determinant estimate is found by concentration steps: the
half of the group's distinct texts nearest to the current centre gives the next
centre and covariance, from each of the ``STARTS`` until the determinant stops
falling; the least determinant of all wins. Texts that tie at the edge of the
half share the places left in it, so a block of equal vectors enters in part
only. A document is rejected when its Mahalanobis distance from its group's
estimate is beyond ``CUTOFF``. Junk of less than half of a group's distinct
texts, and any number of copies of one text, cannot fill the half.

Each statistic is a ratio, centred at the group's median and shrunk for short
texts (``sqrt(n / (n + SHRINK))``), whose ratios scatter more. ``FLOOR`` bounds
each spread from below: most texts have no symbol or repeat at all, and without
it a single one would be infinitely far out.

Groups of fewer than ``MIN_GROUP`` distinct texts are pooled by language, languages
that are still small are pooled together; a pool that stays small rejects
nothing beyond the base rule.

Defined cases: null and empty texts have zero counts and fail the base rule; a
null language or source is a value of its own; repeated rows get equal results;
an empty table gives an empty result. Everything is built-in column expressions;
estimates are small stored tables joined back, so no group is gathered anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.llm.common import WORD_PATTERN, WORD_SPACES, whole_text, words_of
from shopsight.session import materialize

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
MARKS = "!?.,;:"

#: Statistics of the vector: numerator, denominator, least spread.
STATISTICS = {
    "length": ("word_chars", "n_words", 0.15),
    "symbols": ("n_symbols", "n_words", 0.04),
    "marks": ("n_marks", "n_words", 0.04),
    "dup_lines": ("n_dup_lines", "n_lines", 0.10),
    "repeats": ("n_repeat_words", "n_words", 0.05),
    "echoes": ("n_echoes", "n_words", 0.03),
}
SHRINK = 200
#: The half nearest to a centre scatters less than all; its covariance times this is consistent for normal
#: vectors: 0.5 / P(chi-square of 8 <= median of chi-square of 6).
CONSISTENCY = 1.785
#: Concentration goes on while a start's log determinant falls by more than this.
FALL = 1e-6
#: First covariances, all around the median: the floors alone, which repeats and symbols cannot inflate, the
#: median absolute deviations, and the correlations of the vectors' directions and of their bounded values.
STARTS = ("floors", "deviations", "directions", "bounded")
MIN_GROUP = 60
#: Squared Mahalanobis distance beyond which a document is rejected: the
#: chi-square quantile of 6 statistics that one vector in 100,000 exceeds.
CUTOFF = 33.1


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of the text column: n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines,
    n_echoes (words equal to the word before) and n_repeat_words; and text_hash, which tells texts apart."""
    t = whole_text(text)
    df = (
        df.withColumn("__words", F.transform(words_of(t), lambda w: F.xxhash64(w)))
        .withColumn("__lines", F.filter(F.split(t, "\n", -1), lambda line: line.rlike(WORD_PATTERN)))
        .withColumn("text_hash", F.xxhash64(t))
        .withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(t, WORD_SPACES, "")).cast("long"))
        .withColumn("n_symbols", _count_of(t, SYMBOLS))
        .withColumn("n_marks", _count_of(t, MARKS))
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_echoes", F.size(F.filter("__words", lambda w, i: w == F.get("__words", i - 1))).cast("long"))
        .withColumn("n_dup_lines", F.size("__lines").cast("long") - F.size(F.array_distinct("__lines")))
        .drop("__lines")
    )
    # hashes of all word windows; most texts repeat none, and only the others look for the places
    starts = F.slice("__words", 1, F.greatest(F.size("__words") - (WINDOW - 1), F.lit(0)))
    window = lambda w, i: F.xxhash64(w, *[F.get("__words", i + k) for k in range(1, WINDOW)])
    df = df.withColumn("__windows", F.transform(starts, window)).drop("__words")
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), placed)).drop("__windows")
    same = lambda s, k: (s["h"] == F.get("__sorted", k)["h"])
    twice = F.filter("__sorted", lambda s, k: F.coalesce(same(s, k - 1), F.lit(False)) | F.coalesce(same(s, k + 1), F.lit(False)))
    df = df.withColumn("__starts", F.sort_array(F.transform(twice, lambda s: s["i"]))).drop("__sorted")
    covered = F.transform("__starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", k + 1) - p, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.coalesce(_sum(covered), F.lit(0)).cast("long")).drop("__starts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _key(*names: str) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(n)), F.lit("~")) for n in names])


def _grouped(stats: DataFrame) -> DataFrame:
    """Add ``__g``, the pool that a document is judged in (null: too small for a judgement)."""
    texts = stats.where(~F.col("base_failed")).select("lang", "source", "text_hash").distinct()
    counts = texts.groupBy("lang", "source").agg(F.count("*").alias("n"))
    # a row for each language and source
    by_source = counts.select(_key("lang", "source").alias("__k"), _key("lang").alias("__lang"), "n", (F.col("n") >= MIN_GROUP).alias("own"))
    by_lang = by_source.where(~F.col("own")).groupBy("__lang").agg(F.sum("n").alias("lang_n"))
    rest = by_lang.where(F.col("lang_n") < MIN_GROUP).agg(F.coalesce(F.sum("lang_n"), F.lit(0)).alias("n"))
    pools = by_source.join(by_lang, "__lang", "left").select(
        "__k",
        F.when(F.col("own"), F.concat(F.lit("s"), "__k"))
        .when(F.col("lang_n") >= MIN_GROUP, F.concat(F.lit("l"), "__lang"))
        .when(rest.scalar() >= MIN_GROUP, F.lit("r"))
        .alias("__g"),
    )
    return stats.withColumn("__k", _key("lang", "source")).join(materialize(pools), "__k", "left").drop("__k")


def _shrunk(name: str, centre: Column) -> Column:
    num, den, _ = STATISTICS[name]
    ratio = F.coalesce(F.try_divide(F.col(num), F.col(den)), F.lit(0.0))
    return (ratio - centre) * F.sqrt(F.col("n_words") / (F.col("n_words") + SHRINK))


def _pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]


def _factor(model: DataFrame, names: list[str]) -> DataFrame:
    """Replace covariances ``c_a_b`` by the lower Cholesky factor ``l_a_b`` (spreads bounded from below)."""
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            done = reduce(lambda s, k: s - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}"), names[:j], F.coalesce(f"c_{a}_{b}", F.lit(0.0)))
            least = STATISTICS[a][2] ** 2
            model = model.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(done + least, F.lit(least))) if i == j else done / F.col(f"l_{b}_{b}"))
    return model.drop(*[c for c in model.columns if c.startswith("c_")])


def _with_distance(df: DataFrame, names: list[str], out: str) -> DataFrame:
    """Add the squared Mahalanobis distance, by forward substitution."""
    for i, a in enumerate(names):
        rest = reduce(lambda s, k: s - F.col(f"l_{a}_{k}") * F.col(f"__y_{k}"), names[:i], F.col(f"z_{a}") - F.col(f"m_{a}"))
        df = df.withColumn(f"__y_{a}", rest / F.col(f"l_{a}_{a}"))
    square = reduce(lambda s, n: s + F.col(f"__y_{n}") * F.col(f"__y_{n}"), names, F.lit(0.0))
    return df.withColumn(out, square).drop(*[f"__y_{n}" for n in names])


def _starts(vectors: DataFrame, names: list[str]) -> DataFrame:
    """A model per pool and start: ``__g``, ``__start``, ``__h`` (texts in the half), ``__last`` (log determinant), ``m_*`` and ``l_*_*``."""
    sizes = [F.ceil(F.count("*") / 2).alias("__h")] + [F.percentile_approx(F.abs(f"z_{n}"), 0.5, 10000).alias(f"d_{n}") for n in names]
    spreads = vectors.groupBy("__g").agg(*sizes)
    spreads = materialize(spreads.select("__g", "__h", *[F.sqrt((1.4826 * F.col(f"d_{n}")) ** 2 + STATISTICS[n][2] ** 2).alias(f"s_{n}") for n in names]))
    scaled = vectors.join(spreads, "__g").select("__g", "__h", *[f"s_{n}" for n in names], *[(F.col(f"z_{n}") / F.col(f"s_{n}")).alias(f"u_{n}") for n in names])
    scaled = scaled.withColumn("__r", reduce(lambda r, n: r + F.col(f"u_{n}") ** 2, names, F.lit(0.0)))
    along = lambda a, b: len(names) * F.coalesce(F.avg(F.try_divide(F.col(f"u_{a}") * F.col(f"u_{b}"), F.col("__r"))), F.lit(0.0))
    bounded = lambda a, b: F.avg(F.tanh(f"u_{a}") * F.tanh(f"u_{b}"))
    pairs = _pairs(names)
    both = scaled.groupBy("__g", "__h", *[f"s_{n}" for n in names]).agg(
        *[along(a, b).alias(f"directions_{a}_{b}") for a, b in pairs], *[bounded(a, b).alias(f"bounded_{a}_{b}") for a, b in pairs]
    )
    one = lambda a, b: F.lit(1.0 if a == b else 0.0)
    scale = lambda a, b: F.col(f"s_{a}") * F.col(f"s_{b}")
    of = {
        "floors": lambda a, b: F.lit(0.0),
        "deviations": lambda a, b: one(a, b) * scale(a, b),
        "directions": lambda a, b: F.col(f"directions_{a}_{b}") * scale(a, b),
        "bounded": lambda a, b: F.col(f"bounded_{a}_{b}") * scale(a, b),
    }
    kinds = [F.struct(F.lit(k).alias("__start"), *[of[k](a, b).alias(f"c_{a}_{b}") for a, b in pairs]) for k in STARTS]
    each = both.select("__g", "__h", F.lit(float("inf")).alias("__last"), *[F.lit(0.0).alias(f"m_{n}") for n in names], F.explode(F.array(*kinds)).alias("__k"))
    return materialize(_factor(materialize(each.select(*each.columns[:-1], "__k.*")), names))


def _concentrated(vectors: DataFrame, models: DataFrame, names: list[str]) -> DataFrame:
    """Every model's next: centre and covariance of the ``__h`` texts nearest to it.

    Texts nearer than the edge count whole; those at the edge share the places left.
    """
    keys = ["__g", "__start", "__h", "__last"]
    pairs = _pairs(names)
    near = _with_distance(vectors.join(models, "__g"), names, "__d").select(*keys, "__d", *[f"z_{n}" for n in names])
    near = materialize(near)  # read twice; a filter pushed into the distance would write its terms out many times over
    edge = materialize(near.groupBy("__g", "__start").agg(F.percentile_approx("__d", 0.5, 10000).alias("__edge")))
    core = near.join(edge, ["__g", "__start"]).where(F.col("__d") <= F.col("__edge")).withColumn("__at", F.col("__d") == F.col("__edge"))
    sums = [F.count("*").cast("double").alias("n")] + [F.sum(f"z_{n}").alias(f"t_{n}") for n in names]
    sums += [F.sum(F.col(f"z_{a}") * F.col(f"z_{b}")).alias(f"t_{a}_{b}") for a, b in pairs]
    parts = core.groupBy(*keys, "__at").agg(*sums)
    totals = [c for c in parts.columns if c not in (*keys, "__at")]
    part = lambda c, at: F.coalesce(F.max(F.when(F.col("__at") == at, F.col(c))), F.lit(0.0))
    parts = parts.groupBy(*keys).agg(*[part(c, False).alias(f"in_{c}") for c in totals], *[part(c, True).alias(f"at_{c}") for c in totals])
    share = F.least(F.greatest(F.coalesce(F.try_divide(F.col("__h") - F.col("in_n"), F.col("at_n")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    parts = parts.withColumn("__share", share)
    # stored between the layers: as one projection, each would write the one below out many times over
    parts = materialize(parts.select(*keys, *[(F.col(f"in_{c}") + F.col("__share") * F.col(f"at_{c}")).alias(c) for c in totals]))
    mean = lambda c: F.col(f"t_{c}") / F.col("n")
    moments = [mean(n).alias(f"m_{n}") for n in names]
    moments += [(CONSISTENCY * (mean(f"{a}_{b}") - mean(a) * mean(b))).alias(f"c_{a}_{b}") for a, b in pairs]
    return _factor(parts.select(*keys, *moments), names).withColumn("__now", reduce(lambda s, n: s + 2 * F.log(f"l_{n}_{n}"), names, F.lit(0.0)))


def estimates(stats: DataFrame) -> DataFrame:
    """One row per pool ``__g``: medians ``c0_*``, centre ``m_*`` and Cholesky factor ``l_*_*`` of its core."""
    names = list(STATISTICS)
    base = stats.where(~F.col("base_failed") & F.col("__g").isNotNull())
    texts = materialize(base.select("__g", "text_hash", *{c: None for n in names for c in STATISTICS[n][:2]}).distinct())
    ratio = lambda n: F.coalesce(F.try_divide(F.col(STATISTICS[n][0]), F.col(STATISTICS[n][1])), F.lit(0.0))
    medians = materialize(texts.groupBy("__g").agg(*[F.percentile_approx(ratio(n), 0.5, 10000).alias(f"c0_{n}") for n in names]))
    vectors = materialize(texts.join(medians, "__g").select("__g", *[_shrunk(n, F.col(f"c0_{n}")).alias(f"z_{n}") for n in names]))
    going, found = _starts(vectors, names), None
    while True:
        # stored first: a filter pushed into the factor would write its terms out many times over
        fell = materialize(_concentrated(vectors, going, names)).where(F.col("__now") < F.col("__last") - FALL)
        found = fell if found is None else found.unionByName(fell)
        if fell.isEmpty():
            break
        going = fell.withColumn("__last", F.col("__now")).drop("__now")
    model = [*[f"m_{n}" for n in names], *[f"l_{a}_{b}" for a, b in _pairs(names)]]
    least = materialize(found.groupBy("__g").agg(F.min(F.struct("__now", "__start", *model)).alias("__best")))
    return medians.join(least.select("__g", *[f"__best.{c}" for c in model]), "__g")


def judged(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and all counts, ``base_failed``, ``distance`` (squared; null without an estimate) and ``kept``."""
    names = list(STATISTICS)
    counts = ["n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_echoes", "n_repeat_words"]
    narrow = documents.select(*{c: None for c in [*keep, "lang", "source", "text"]})
    stats = materialize(with_counts(narrow).withColumn("base_failed", base_failed()).select(*{c: None for c in [*keep, "lang", "source"]}, "text_hash", *counts, "base_failed"))
    stats = _grouped(stats)
    model = materialize(estimates(stats))
    placed = stats.join(model, "__g", "left").withColumns({f"z_{n}": _shrunk(n, F.col(f"c0_{n}")) for n in names})
    placed = _with_distance(placed, names, "distance")
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return placed.withColumn("kept", kept).select(*keep, *counts, "base_failed", "distance", "kept")


def report(documents: DataFrame) -> DataFrame:
    """The counts and the verdict of every document."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    return judged(documents, ["doc_id"]).select(*columns)


def kept_documents(documents: DataFrame) -> DataFrame:
    """The documents that the verdict keeps, with all their columns.

    The rejected, the smaller side, are joined out by id and text hash: rows that
    agree in both agree in all that the verdict depends on.
    """
    hashed = documents.withColumn("__hash", F.xxhash64(whole_text(), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))))
    # stored first: a filter pushed into the distance would write its terms out many times over
    verdicts = materialize(judged(hashed, ["doc_id", "__hash"]).select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__gone"), "kept"))
    rejected = verdicts.where(~F.col("kept")).drop("kept").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__gone"))
    return hashed.join(rejected, same, "left_anti").drop("__hash")
