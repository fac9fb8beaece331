"""Instrument noise model: mixture distribution, heteroscedastic error, detection."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import exact_quantiles, lambert_w_minus

OUTLIER_PROB = 1e-4


def log_add_exp(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return top + F.log1p(F.exp(F.least(a, b) - top))


def log1p_exp(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


@dataclass(frozen=True)
class GaussCauchyMix:
    """M1: normal distribution with a Cauchy share of outliers, both of one centre and scale."""

    center: float = 0.0
    scale: float = 1.0
    outlier_prob: float = OUTLIER_PROB

    def __post_init__(self) -> None:
        if not 0 < self.outlier_prob < 1:
            raise ValueError(f"outlier probability must be in (0, 1), not {self.outlier_prob}")

    @property
    def threshold(self) -> float:
        """Distance, in scales, at which the weighted densities meet."""
        p = self.outlier_prob
        return math.sqrt(-1 - 2 * lambert_w_minus(p / (p - 1) / math.sqrt(2 * math.pi * math.e)))

    def pdf(self, x: Column) -> Column:
        z, p = (x - self.center) / self.scale, self.outlier_prob
        return ((1 - p) * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) + p / (math.pi * (1 + z * z))) / self.scale

    def logpdf(self, x: Column) -> Column:
        z, p = (x - self.center) / self.scale, self.outlier_prob
        signal = F.lit(math.log1p(-p) - math.log(2 * math.pi) / 2) - z * z / 2
        outlier = F.lit(math.log(p) - math.log(math.pi)) - F.log1p(z * z)
        return log_add_exp(signal, outlier) - math.log(self.scale)


@dataclass(frozen=True)
class NoiseModel:
    """M2: parameters of one calibrated instrument."""

    zScale: float
    zShift: float
    zDetectionFactor: float
    zDetectionIntercept: float
    detectionMax: float
    sigmaScaleHi: float
    sigmaScaleLo: float
    sigmaOffset: float
    sigmaBend: float
    sigmaSmooth: float
    logintensityBase: float = math.e
    outlierProb: float = OUTLIER_PROB
    distr: GaussCauchyMix = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        for met, name, rule in (
            (self.logintensityBase > 1, "logintensityBase", "> 1"), (self.zScale > 0, "zScale", "> 0"), (0 < self.outlierProb < 1, "outlierProb", "in (0, 1)"),
            (self.zDetectionFactor > 0, "zDetectionFactor", "> 0"), (self.sigmaScaleHi > 0, "sigmaScaleHi", "> 0"), (self.sigmaScaleLo > 0, "sigmaScaleLo", "> 0"),
            (self.sigmaSmooth >= 0, "sigmaSmooth", ">= 0"), (0 < self.detectionMax <= 1, "detectionMax", "in (0, 1]"),
        ):
            if not met:
                raise ValueError(f"{name} must be {rule}, not {getattr(self, name)}")
        object.__setattr__(self, "distr", GaussCauchyMix(outlier_prob=self.outlierProb))

    @classmethod
    def from_dict(cls, d: Mapping) -> NoiseModel:
        """S15."""
        return cls(**{k: d[k] for k in cls.__dataclass_fields__ if k in d and k != "distr"})

    def to_dict(self) -> dict:
        """K2: with every field that ``from_dict`` reads."""
        return {k: v for k, v in asdict(self).items() if k != "distr"}

    # M6: derived
    @property
    def detection_factor(self) -> float:
        return self.zScale * self.zDetectionFactor

    @property
    def detection_intercept(self) -> float:
        return self.zDetectionIntercept - self.zShift * self.zScale * self.zDetectionFactor

    @property
    def log_detection_max(self) -> float:
        return math.log(self.detectionMax)

    @property
    def log1m_detection_max(self) -> float:
        return math.log1p(-self.detectionMax) if self.detectionMax < 1 else float("-inf")

    # M3
    def log(self, x: Column) -> Column:
        return F.ln(x) if self.logintensityBase == math.e else F.ln(x) / math.log(self.logintensityBase)

    def exp(self, x: Column) -> Column:
        return F.exp(x * math.log(self.logintensityBase))

    @property
    def log_label(self) -> str:
        b = self.logintensityBase
        return {math.e: "Log", 2: "Log₂", 10: "Log₁₀"}.get(b, f"Log[{b:.0f}]" if float(b).is_integer() else f"Log[{b:.3f}]")

    @property
    def exp_label(self) -> str:
        b = self.logintensityBase
        return "Exp" if b == math.e else f"{b:.0f}^" if float(b).is_integer() else f"{b:.3f}^"

    def __str__(self) -> str:
        """M4."""
        return (
            f"Z=({self.log_label}(signal){-self.zShift:+.3f})*{self.zScale:.3f}\n"
            f"P(detect|Z)={self.detectionMax:.4f} Logit⁻¹({self.zDetectionFactor:.4f} Z{self.zDetectionIntercept:+.4f})\n"
            f"std(signal)={self.exp_label}(½({self.sigmaScaleHi:.4f}{self.sigmaScaleLo:+.4f})(Z{-self.sigmaBend:+.4f})"
            f"+½({self.sigmaScaleHi:.4f}{-self.sigmaScaleLo:+.4f})√((Z{-self.sigmaBend:+.4f})²{self.sigmaSmooth:+.4f}){self.sigmaOffset:+.4f}) P(outlier)={self.outlierProb:.4g}\n"
        )

    def with_base(self, base: float) -> NoiseModel:
        """M5: the same model for another base of logarithms."""
        if base == self.logintensityBase:
            return self
        k = math.log(self.logintensityBase) / math.log(base)
        d = self.to_dict()
        for name in ("zShift", "sigmaScaleHi", "sigmaScaleLo", "sigmaOffset"):
            d[name] *= k
        d["zScale"] /= k
        d["sigmaSmooth"] *= k * k
        d["logintensityBase"] = base
        return NoiseModel(**d)

    # M7-M9
    def zscore(self, signal: Column) -> Column:
        fine = signal.isNotNull() & ~F.isnan(signal) & (F.abs(signal) < float("inf"))
        return F.when(fine, (self.log(signal) - self.zShift) * self.zScale).otherwise(F.lit(float("nan")))

    def zscore_logstd(self, z: Column) -> Column:
        d, hi, lo = z - self.sigmaBend, self.sigmaScaleHi, self.sigmaScaleLo
        return 0.5 * (hi + lo) * d + 0.5 * (hi - lo) * F.sqrt(d * d + self.sigmaSmooth) + self.sigmaOffset

    def zscore_std(self, z: Column) -> Column:
        return self.exp(self.zscore_logstd(z))

    def zscore_precision(self, z: Column) -> Column:
        return self.exp(-self.zscore_logstd(z))

    def signal_logstd(self, signal: Column) -> Column:
        return self.zscore_logstd(self.zscore(signal))

    def signal_std(self, signal: Column) -> Column:
        return self.zscore_std(self.zscore(signal))

    def _finite(self, value: Column, signal: Column, what: str) -> Column:
        bad = (F.abs(signal) < float("inf")) & (F.isnan(value) | (F.abs(value) == float("inf")))
        return F.when(bad, F.raise_error(F.concat(F.lit(f"{what} is not finite for "), signal.cast("string"))).cast("double")).otherwise(value)

    def signal_precision(self, signal: Column) -> Column:
        """M8."""
        return self._finite(self.zscore_precision(self.zscore(signal)), signal, "precision")

    def signal_snr(self, signal: Column) -> Column:
        return self._finite(self.exp(self.log(signal) - self.signal_logstd(signal)), signal, "signal to noise")

    # M10, M11
    def error_loglik(self, delta: Column, z: Column) -> Column:
        logstd = self.zscore_logstd(z)
        return self.distr.logpdf(delta * self.exp(-logstd)) - (logstd - self.zShift) * math.log(self.logintensityBase)

    def is_inlier(self, delta: Column, z: Column) -> Column:
        return F.abs(delta * self.zscore_precision(z)) <= self.distr.threshold

    def signal_loglik(self, signal: Column, expected: Column) -> Column:
        return self.error_loglik(signal - expected, self.zscore(signal))

    def detection_loglik(self, detected: Column, expected_log: Column) -> Column:
        z = expected_log * self.detection_factor + self.detection_intercept
        return -log1p_exp(F.when(detected, -z).otherwise(z))

    # Simulation by hashes of row keys, the same after any split
    def missing_table(self, spark: SparkSession, cuts: Sequence[float], std_scale: float = 3.0, det_factor_scale: float = 10.0, points: int = 201) -> DataFrame:
        """(bin, at, xs, upto): for each bin of signals, by its upper end, a grid and the running sum of the posterior of an undetected log intensity."""
        centre = np.array(cuts, float)[:, None]
        width = 8 / (self.zScale * std_scale)
        xs = centre + width * (np.arange(points) / (points - 1) - 0.5) * 2
        z, missed = (xs - centre) * self.zScale * std_scale, xs * self.detection_factor * det_factor_scale + self.detection_intercept
        upto = np.cumsum(np.exp(-z * z / 2 - np.logaddexp(0.0, missed)), axis=1)
        rows = [(k, float(cuts[k]), xs[k].tolist(), upto[k].tolist()) for k in range(len(cuts))]
        return spark.createDataFrame(rows, "bin int, at double, xs array<double>, upto array<double>")

    def simulate_missing(self, df: DataFrame, signal: str, name: str = "missed_log", bins: int = 10, std_scale: float = 3.0, det_factor_scale: float = 10.0, points: int = 201, seed: int = 1, keys: Sequence[str] | None = None) -> DataFrame:
        """Log intensities that would go undetected, drawn per bin of signals from the posterior on a grid.

        The inverse of a gridded distribution function is drawn from, in place of a slice sampler.  Bins end at quantiles of the logarithms; their
        tables are made once and broadcast (``bins`` rows), and a row's place is found by halving.  What is drawn hangs on the row's ``keys`` (all columns by
        default) and the seed alone.  A signal without a logarithm draws null.
        """
        keys = list(df.columns if keys is None else keys)
        logs = df.withColumn("_log", self.log(F.col(signal)))
        cuts = exact_quantiles(logs, "_log", [k / bins for k in range(1, bins + 1)])
        if not cuts:
            return df.withColumn(name, F.lit(None).cast("double"))
        place = F.least(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda q: q <= F.col("_log"))), F.lit(bins - 1))
        table = self.missing_table(df.sparkSession, cuts, std_scale, det_factor_scale, points).select(F.col("bin").alias("_bin"), F.col("xs").alias("_xs"), F.col("upto").alias("_upto"))
        drawn = logs.withColumn("_bin", F.when(F.col("_log").isNotNull() & ~F.isnan("_log"), place)).join(F.broadcast(table), "_bin", "left").withColumn("_u", uniform(keys, seed) * F.element_at("_upto", -1))
        halves = F.array(*[F.lit(1 << k) for k in reversed(range(points.bit_length()))])
        at = F.aggregate(halves, F.lit(0), lambda a, h: F.when((a + h <= points - 1) & (F.get("_upto", a + h - 1) < F.col("_u")), a + h).otherwise(a))
        return drawn.withColumn(name, F.get("_xs", at)).drop("_log", "_bin", "_xs", "_upto", "_u")

    def simulate(self, df: DataFrame, intensity: str, signal: str, name: str = "simulated", seed: int = 1, keys: Sequence[str] | None = None) -> DataFrame:
        """Detected intensities with normal noise, missing ones from M12."""
        keys = list(df.columns if keys is None else keys)
        missed = self.simulate_missing(df, signal, "_missed", seed=seed, keys=keys)
        x = F.col(intensity)
        there = x.isNotNull() & ~F.isnan(x)
        normal = F.sqrt(-2 * F.ln(1 - uniform(keys, seed + 1))) * F.cos(2 * math.pi * uniform(keys, seed + 2))
        return missed.withColumn(name, F.when(there, x + normal * self.signal_std(x)).otherwise(self.exp(F.col("_missed")))).drop("_missed")


def model_texts(base: float = math.e) -> Column:
    """M4 for a table of models, whose columns are called like the model's fields: the text that ``str`` gives for one of that base.

    Exact halves of the last digit are rounded up here, to even there.
    """
    shown = NoiseModel(1.0, 0.0, 1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, logintensityBase=base)
    c = F.col
    text = (
        f"Z=({shown.log_label}(signal)%+.3f)*%.3f\nP(detect|Z)=%.4f Logit⁻¹(%.4f Z%+.4f)\n"
        f"std(signal)={shown.exp_label}(½(%.4f%+.4f)(Z%+.4f)+½(%.4f%+.4f)√((Z%+.4f)²%+.4f)%+.4f) P(outlier)=%s\n"
    )
    hi, lo, bend = c("sigmaScaleHi"), c("sigmaScaleLo"), c("sigmaBend")
    return F.format_string(text, -c("zShift"), c("zScale"), c("detectionMax"), c("zDetectionFactor"), c("zDetectionIntercept"), hi, lo, -bend, hi, -lo, -bend, c("sigmaSmooth"), c("sigmaOffset"), c("outlierProb").cast("string"))


def uniform(keys: Sequence[str], seed: int) -> Column:
    """A number from 0 to below 1 by a digest of the seed and the keys as strings."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def quantile_rank(value: str, keys: list[str]) -> tuple[Column, Column]:
    """Ordinal rank within the keys, and that over the count."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return rank, rank / F.count("*").over(Window.partitionBy(*keys))
