"""Exposure, event rates and relative risk on measured supports."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.planar import Support, bad


@dataclass(frozen=True)
class MeasuredSupport:
    """What makes two supports the same: kind, ids with their measures, coordinate system, units and time domain."""

    kind: str
    df: DataFrame  # support_id, measure
    crs: str | None = None
    unit: str | None = None
    domain: object = None

    def require_same(self, other: MeasuredSupport) -> None:
        for name in ("kind", "crs", "unit", "domain"):
            if getattr(self, name) != getattr(other, name):
                raise ValueError(f"the supports differ: {name} is {getattr(self, name)} and {getattr(other, name)}")
        require_same_cells(self.df, other.df)


def describe_support(support: Support | DataFrame) -> MeasuredSupport:
    """The contract of a measured support: a grid or measured points, in space or in space and time, lixels, or arixels. Points
    without a measure, measures that are not positive, and ids that repeat or are missing are errors."""
    if isinstance(support, Support):
        if not support.measured:
            raise ValueError("a support of risk fields needs a measure")
        timed = "time" in support.df.columns
        kind = ("spatiotemporal_grid" if support.shape else "spatiotemporal_points") if timed else "spatial_grid"
        out = MeasuredSupport(kind, support.df.select("support_id", "measure"), support.crs, support.unit, support.domain)
    elif "arixel_id" in support.columns:
        out = MeasuredSupport("network_time_arixel", support.select(F.col("arixel_id").alias("support_id"), F.col("arixel_measure").alias("measure")))
    elif "lixel_id" in support.columns:
        out = MeasuredSupport("network_lixel", support.select(F.col("lixel_id").alias("support_id"), F.col("length").alias("measure")))
    else:
        raise TypeError("a measured support is a Support with a measure, lixels or arixels")
    row = out.df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("support_id").alias("ids"), F.count_if(bad(F.col("measure")) | (F.col("measure") <= 0)).alias("bad")
    ).first()
    if row["bad"] or row["ids"] < row["n"]:
        raise ValueError(f"{row['bad']} measures are not positive, {row['n'] - row['ids']} ids repeat or are missing")
    return out


def require_same_cells(a: DataFrame, b: DataFrame) -> None:
    """Stop unless both sides (support_id, measure) have the same ids with the same measures."""
    left, right = a.select("support_id", F.col("measure").alias("m")), b.select("support_id", F.col("measure").alias("n"))
    off = left.join(right, "support_id", "full").where(F.col("m").isNull() | F.col("n").isNull() | (F.col("m") != F.col("n"))).limit(1).count()
    if off:
        raise ValueError("the fields must have the same cells with the same measures")


@dataclass(frozen=True)
class FieldView:
    """A field with the estimator it came from, which risk needs to know: target, family of supports, fixed bandwidths and the rest
    of the estimator's settings. df has support_id, measure and density or intensity."""

    df: DataFrame
    target: str
    family: str
    bandwidths: tuple[float, ...]
    contract: tuple[tuple[str, str], ...]

    @classmethod
    def of(cls, df: DataFrame, estimator: object) -> FieldView:
        """The view of what an estimator's evaluate returned; its bandwidths must be plain numbers."""
        kind = next((k for k in ("arixel_id", "time_index", "lixel_id") if k in df.columns), "support_id")
        family = {"arixel_id": "network_time", "time_index": "network_time", "lixel_id": "network"}.get(kind, "spatiotemporal" if "time" in df.columns else "spatial")
        found: dict[str, object] = {}

        def walk(name: str, value: object) -> None:
            for k, v in vars(value).items():
                walk(f"{name}{k}.", v) if hasattr(v, "__dataclass_fields__") and "bandwidth" not in k and "network_kde" in k else found.update({f"{name}{k}": v})

        walk("", estimator)
        widths = {k: v for k, v in found.items() if "bandwidth" in k or k == "diffusion_time"}
        if wrong := [k for k, v in widths.items() if isinstance(v, bool) or not isinstance(v, (int, float))]:
            raise ValueError(f"risk fields need fixed scalar bandwidths; {wrong[0]} is none")
        target = str(found["target"]).strip().lower()
        if family == "network_time" and "support_id" not in df.columns:
            df = df.withColumn("support_id", F.struct("time_index", "lixel_id") if kind == "time_index" else F.col(kind))
        elif family == "network":
            df = df.withColumn("support_id", F.col("lixel_id")).withColumn("measure", F.col("length"))
        rest = tuple(sorted((k, getattr(v, "name", None) or str(v)) for k, v in found.items() if k not in widths))
        return cls(df, target, family, tuple(float(widths[k]) for k in sorted(widths)), rest)

    def require_compatible(self, other: FieldView) -> None:
        """Stop unless both fields share family, bandwidths and all other settings of their estimators."""
        for name in ("target", "family", "bandwidths", "contract"):
            if getattr(self, name) != getattr(other, name):
                raise ValueError(f"the fields differ in {name}: {getattr(self, name)} and {getattr(other, name)}")


def _rows(field: DataFrame | FieldView, target: str) -> DataFrame:
    if isinstance(field, FieldView):
        if field.target != target:
            raise ValueError(f"a {target} is needed, not {field.target}")
        return field.df
    if target not in field.columns:
        raise ValueError(f"a {target} is needed")
    return field


def _finite(df: DataFrame, name: str) -> None:
    """Stop where a division overflowed."""
    if df.where(F.abs(name) == float("inf")).limit(1).count():
        raise ValueError(f"{name} overflows; use a larger minimum denominator or look at the scale of the fields")


@dataclass(frozen=True)
class DenominatorPolicy:
    """What to do with small denominators. raise: any at or below the threshold is an error; nan: those become NaN; minimum:
    the denominator is at least the floor, and takes no threshold."""

    how: str = "raise"
    threshold: float = 0.0
    floor: float | None = None

    def __post_init__(self):
        if self.how not in ("raise", "nan", "minimum"):
            raise ValueError("policy is raise, nan or minimum")
        if self.how == "minimum" and (self.floor is None or self.floor <= 0 or self.threshold):
            raise ValueError("minimum needs a positive floor and no threshold")

    def apply(self, d: Column) -> tuple[Column, Column, Column]:
        """(effective denominator, invalid, adjusted)."""
        if self.how == "minimum":
            return F.greatest(d, F.lit(float(self.floor))), d <= 0, d < self.floor
        invalid = d <= self.threshold
        return F.when(invalid, F.lit(math.nan)).otherwise(d), invalid, F.lit(False)

    def guard(self, df: DataFrame, denominator: str) -> None:
        if self.how == "raise" and df.where(F.col(denominator) <= self.threshold).limit(1).count():
            raise ValueError(f"{denominator} is not above {self.threshold} everywhere")


def _given(support: DataFrame, given: DataFrame, value: str) -> DataFrame:
    """support with __given; one value of at least 0 for each cell, and none for other ids."""
    rows = given.select("support_id", F.col(value).cast("double").alias("__given"), F.lit(1).alias("__there"))
    ids = support.select("support_id", F.lit(1).alias("__cell"))
    both = ids.join(rows, "support_id", "full")
    row = both.agg(
        F.count_if(F.col("__there").isNull()).alias("missing"), F.count_if(F.col("__cell").isNull()).alias("strange"),
        (F.count("__there") - F.count_distinct(F.when(F.col("__there").isNotNull(), F.col("support_id")))).alias("repeated"),
        F.count_if(F.col("__there").isNotNull() & (bad(F.col("__given")) | (F.col("__given") < 0))).alias("bad"),
    ).first()
    if any(row):
        raise ValueError(f"{row['missing']} cells have no {value}, {row['strange']} ids are no cells, {row['repeated']} ids repeat, {row['bad']} values are negative or not finite")
    return support.join(rows.drop("__there"), "support_id")


def exposure_from_amounts(support: DataFrame, amounts: DataFrame, amount: str) -> DataFrame:
    """support with exposure_density = amount / measure; every cell needs one amount of at least 0."""
    return _given(support, amounts, amount).withColumn("exposure_density", F.col("__given") / F.col("measure")).drop("__given")


def exposure_from_density(support: DataFrame, densities: DataFrame, density: str) -> DataFrame:
    """support with exposure_density taken as it is; every cell needs one of at least 0."""
    return _given(support, densities, density).withColumnRenamed("__given", "exposure_density")


def event_rate(intensity: DataFrame | FieldView, exposure: DataFrame, policy: DenominatorPolicy | None = None) -> DataFrame:
    """Intensity over exposure density on one measured support, with masks of invalid and adjusted denominators. Both sides need
    the same cells with the same measures; a rate that overflows is an error."""
    policy, intensity = policy or DenominatorPolicy(), _rows(intensity, "intensity")
    require_same_cells(intensity, exposure)
    policy.guard(exposure, "exposure_density")
    rows = intensity.withColumnRenamed("intensity", "event_intensity").join(exposure.select("support_id", "exposure_density"), "support_id")
    d, invalid, adjusted = policy.apply(F.col("exposure_density"))
    rows = rows.withColumn("effective_exposure_density", d).withColumn("invalid_denominator", invalid).withColumn("adjusted_denominator", adjusted)
    rate = F.when(F.isnan("effective_exposure_density"), F.lit(math.nan)).otherwise(F.try_divide("event_intensity", "effective_exposure_density"))
    rows = rows.withColumn("event_rate", rate)
    _finite(rows, "event_rate")
    return rows


def rate_summary(field: DataFrame) -> DataFrame:
    """One row: event mass, exposure, and the exposure-weighted mean rate by original and by effective exposure."""
    m, e, f = F.col("measure"), F.col("exposure_density"), F.col("effective_exposure_density")
    ok = ~F.isnan("event_rate")
    return field.agg(
        F.sum(F.col("event_intensity") * m).alias("event_mass"),
        F.sum(e * m).alias("exposure"),
        F.try_divide(F.sum(F.when(ok, F.col("event_rate") * e * m)), F.sum(F.when(ok, e * m))).alias("mean_rate"),
        F.try_divide(F.sum(F.when(ok, F.col("event_rate") * f * m)), F.sum(F.when(ok, f * m))).alias("effective_mean_rate"),
    )


def relative_risk(
    case: DataFrame | FieldView, control: DataFrame | FieldView, policy: DenominatorPolicy | None = None, *, mass_tolerance: float | None = 1e-6
) -> DataFrame:
    """Case density over control density with its logarithm, on one measured support.

    Both densities need the same cells and must integrate to 1 within mass_tolerance (None: not checked); views must also share their
    bandwidths and estimator. The log is -inf where the case density is 0, and NaN where the ratio is. A ratio that overflows is an error.
    """
    policy = policy or DenominatorPolicy()
    if isinstance(case, FieldView) and isinstance(control, FieldView):
        case.require_compatible(control)
    case, control = _rows(case, "density"), _rows(control, "density")
    require_same_cells(case, control)
    if mass_tolerance is not None:
        for name, df in (("case", case), ("control", control)):
            mass = df.agg(F.sum(F.col("density") * F.col("measure")).alias("m")).first()["m"] or 0.0
            if not math.isclose(mass, 1.0, abs_tol=mass_tolerance):
                raise ValueError(f"the {name} density integrates to {mass}, not 1")
    rows = case.withColumnRenamed("density", "case_density").join(control.select("support_id", F.col("density").alias("control_density")), "support_id")
    policy.guard(rows, "control_density")
    d, invalid, adjusted = policy.apply(F.col("control_density"))
    rows = rows.withColumn("effective_control_density", d).withColumn("invalid_control_density", invalid).withColumn("adjusted_control_density", adjusted)
    c, e = F.col("case_density"), F.col("effective_control_density")
    ratio = F.when(F.isnan(e), F.lit(math.nan)).otherwise(F.try_divide(c, e))
    log = F.when(F.isnan(e), F.lit(math.nan)).when(c <= 0, F.lit(-math.inf)).otherwise(F.log(c) - F.log(F.when(e > 0, e)))
    rows = rows.withColumn("relative_risk", ratio)
    _finite(rows, "relative_risk")
    return rows.withColumn("log_relative_risk", log)


def risk_summary(field: DataFrame) -> DataFrame:
    """One row: integrals of the case, control and effective control densities, the mean risk weighted by each control, and counts of
    invalid and adjusted denominators."""
    m, control, effective, risk = (F.col(c) for c in ("measure", "control_density", "effective_control_density", "relative_risk"))
    used, ok = ~F.isnan(effective), ~F.isnan(risk)
    mean = lambda w: F.coalesce(F.try_divide(F.sum(F.when(ok, risk * w * m)), F.sum(F.when(ok, w * m))), F.lit(math.nan))
    return field.agg(
        F.sum(F.col("case_density") * m).alias("case_integral"),
        F.sum(control * m).alias("control_integral"),
        F.coalesce(F.sum(F.when(used, effective * m)), F.lit(0.0)).alias("effective_control_integral"),
        mean(control).alias("control_weighted_mean"),
        mean(F.when(used, effective)).alias("effective_control_weighted_mean"),
        F.count_if("invalid_control_density").alias("invalid"),
        F.count_if("adjusted_control_density").alias("adjusted"),
    )
