"""Fits that failed, saved by other optimizers that agree: which ones agree, how far their coefficients differ, and the likelihood-ratio test from the best of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import stats

#: Fields of an optimizer's record: its place in the list, whether it failed, log likelihood, messages other than that of a singular fit, parameters, coefficients and their errors.
RECORD = ("place", "error", "loglik", "messages", "npar", "fixef", "se")


def eligible(require_silent: bool) -> Column:
    """Records of optimizers that ended without an error and with a likelihood; those with messages too unless silence is asked for."""
    ended = ~F.coalesce(F.col("error"), F.lit(False)) & F.col("loglik").isNotNull()
    return ended & (F.col("messages") == 0) if require_silent else ended


def aligned_optimizers(records: DataFrame, keys: Sequence[str], tolerance: float, require_silent: bool = False) -> DataFrame:
    """Eligible records whose likelihood is less than the tolerance below the best eligible one of their key."""
    some = records.where(eligible(require_silent))
    best = some.groupBy(*keys).agg(F.max("loglik").alias("__best"))
    return some.join(best, list(keys)).where(F.col("__best") - F.col("loglik") < tolerance).drop("__best")


def _spread(found: Column, se: Column) -> Column:
    """The largest difference of a coefficient between records, in its standard error; 0 for fewer than two records."""
    of = lambda i: F.transform(found, lambda r: F.get(r.fixef, i))
    each = F.transform(se, lambda s, i: (F.array_max(of(i)) - F.array_min(of(i))) / s)
    return F.when(F.size(found) < 2, F.lit(0.0)).otherwise(F.array_max(each))


def rescue_models(
    records: DataFrame, keys: Sequence[str], tolerance: float, min_aligned: int, require_silent: bool = False, fixef_tolerance: float | None = None
) -> DataFrame:
    """One row for each key: n_aligned, n_with_messages among them, loglik and npar of the best (of equals the one that comes first), fixef_spread, satisfied.

    satisfied: at least min_aligned agree, and, where fixef_tolerance is given, their coefficients differ by less than that many standard errors of the best one. A key whose
    optimizers all failed has n_aligned 0 and is not satisfied. A key's records are those of a fit's optimizers, a handful, and are gathered.
    """
    record = F.struct(*RECORD)
    found = F.collect_list(F.when(eligible(require_silent), record))
    best = F.max_by(record, F.when(eligible(require_silent), F.struct(F.col("loglik"), -F.col("place"))))
    rows = records.groupBy(*keys).agg(found.alias("__all"), best.alias("__best"))
    near = F.filter("__all", lambda r: F.col("__best.loglik") - r.loglik < tolerance)
    rows = rows.withColumn("__found", near).withColumn("n_aligned", F.size("__found").cast("long"))
    any_found = F.col("n_aligned") > 0
    rows = rows.select(
        *keys, "n_aligned", F.size(F.filter("__found", lambda r: r.messages > 0)).cast("long").alias("n_with_messages"), F.when(any_found, F.col("__best.loglik")).alias("loglik"),
        F.when(any_found, F.col("__best.npar")).alias("npar"), F.when(any_found & F.lit(fixef_tolerance is not None), _spread(F.col("__found"), F.col("__best.se"))).alias("fixef_spread"),
    )
    enough = any_found & (F.col("n_aligned") >= min_aligned)
    return rows.withColumn("satisfied", enough if fixef_tolerance is None else enough & (F.col("fixef_spread") < fixef_tolerance))


def likelihood_ratio_p(full: Column, reduced: Column, df: Column) -> Column:
    """The chi-square tail of twice the difference, or of 0 where that is negative. Fewer than one degree of freedom is an error."""
    return stats.chi_square_tail(2 * (full - reduced), df)


def optimizer_rescue(records: DataFrame, keys: Sequence[str], model: str = "model", full: str = "full", reduced: str = "add", **how) -> DataFrame:
    """One row for each key: satisfied, p, and n_aligned, loglik and fixef_spread of both models. Both have to be satisfied; p is null where one is not, or has no records at all."""
    models = rescue_models(records, [*keys, model], **how)
    side = lambda which, end: models.where(F.col(model) == which).select(*keys, *(F.col(c).alias(f"{c}_{end}") for c in ("n_aligned", "loglik", "npar", "fixef_spread", "satisfied")))
    both = side(full, "full").join(side(reduced, "reduced"), list(keys), "full_outer")
    ok = F.coalesce(F.col("satisfied_full") & F.col("satisfied_reduced"), F.lit(False))
    p = F.when(F.col("satisfied"), likelihood_ratio_p(F.col("loglik_full"), F.col("loglik_reduced"), F.col("npar_full") - F.col("npar_reduced")))
    return both.withColumn("satisfied", ok).select(*keys, "satisfied", p.alias("p"), *(f"{c}_{e}" for e in ("full", "reduced") for c in ("n_aligned", "loglik", "fixef_spread")))

