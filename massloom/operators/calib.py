"""Calibration pipeline: channels, run shifts, predictions, balanced sample, likelihood, search (Q1-Q15, K1, K4)."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import grid_bin, quantile_grid, ranked, weighted_median
from ..session import materialize, ship_package
from .noise import NoiseModel
from .reshape import pivot_longer


def normal_logpdf(x: float, sd: float) -> float:
    return -0.5 * (x / sd) ** 2 - math.log(sd) - 0.5 * math.log(2 * math.pi)


def cauchy_logpdf(x: float) -> float:
    return -math.log(math.pi) - math.log1p(x * x)


def beta_logpdf(x: float, a: float, b: float) -> float:
    if not 0 <= x <= 1 or (x == 1 and b > 1) or (x == 0 and a > 1):
        return float("-inf")
    norm = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    return (a - 1) * math.log(max(x, 1e-300)) + (b - 1) * math.log(max(1 - x, 1e-16)) - norm


def _logstd(model: NoiseModel, z: np.ndarray) -> np.ndarray:
    d, hi, lo = z - model.sigmaBend, model.sigmaScaleHi, model.sigmaScaleLo
    return 0.5 * (hi + lo) * d + 0.5 * (hi - lo) * np.sqrt(d * d + model.sigmaSmooth) + model.sigmaOffset


def log_prior(model: NoiseModel, grid: Sequence[float], sigma_prior_sd: float = 0.1, n: int | None = None) -> float:
    """Q1."""
    x = np.array(grid, float)
    b = math.log(model.logintensityBase)
    ratio = np.exp(_logstd(model, (np.log(x) / b - model.zShift) * model.zScale) * b) / x
    total = sum(normal_logpdf(r, sigma_prior_sd) for r in ratio) * ((len(x) if n is None else n) / len(x))
    return cauchy_logpdf(model.zDetectionIntercept) + cauchy_logpdf(model.zDetectionFactor) + total + beta_logpdf(model.detectionMax, 10.0, 1.1)


def log_priors(grid: Sequence[float], n: int, base: float = math.e, sigma_prior_sd: float = 0.1) -> Column:
    """Q1 for a table of models, whose columns are called like the model's fields."""
    c, b = F.col, math.log(base)
    half_sum, half_difference = 0.5 * (c("sigmaScaleHi") + c("sigmaScaleLo")), 0.5 * (c("sigmaScaleHi") - c("sigmaScaleLo"))

    def term(x: Column) -> Column:
        d = (F.ln(x) / b - c("zShift")) * c("zScale") - c("sigmaBend")
        ratio = F.exp((half_sum * d + half_difference * F.sqrt(d * d + c("sigmaSmooth")) + c("sigmaOffset")) * b) / x
        return -0.5 * F.pow(ratio / sigma_prior_sd, F.lit(2.0)) - math.log(sigma_prior_sd) - 0.5 * math.log(2 * math.pi)

    total = F.aggregate(F.transform(F.array(*[F.lit(float(g)) for g in grid]), term), F.lit(0.0), lambda a, t: a + t) * (n / len(grid))
    cauchy = lambda x: -math.log(math.pi) - F.log1p(x * x)
    beta = 9.0 * F.ln("detectionMax") + (1.1 - 1) * F.log1p(-c("detectionMax")) - (math.lgamma(10.0) + math.lgamma(1.1) - math.lgamma(11.1))
    return cauchy(c("zDetectionIntercept")) + cauchy(c("zDetectionFactor")) + total + beta


@dataclass
class CalibrationData:
    """Q3: what the likelihood reads; ``used`` has intensity, logintensity_predicted, intensity_zscore_predicted,
    intensity_prediction_error."""

    base: float
    zScale: float
    zShift: float
    grid: list[float]
    used: DataFrame
    shifts: DataFrame


def protgroup_data(wide: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Q4: wide intensity columns (Intensity.<run>) to rows."""
    return pivot_longer(wide, id_cols, r"^(?P<value>[Ii]ntensity)\.(?P<var>.+)$", "msrun", {"Intensity": "intensity"})


def pepmodstate_data(observations: DataFrame, pepmodstates: DataFrame, peptides: DataFrame | None = None, intensity: str = "intensity", allowed: Sequence[str] | None = None) -> DataFrame:
    """Q5: objects that are no contaminants or decoys, with use_for_calib: all their observations are of an allowed
    identification type, or have no intensity."""
    if "is_contaminant" not in pepmodstates.columns:
        pepmodstates = pepmodstates.join(peptides.select("peptide_id", "is_contaminant", "is_reverse"), "peptide_id")
    fine = F.lit(True) if allowed is None else F.coalesce(F.col("ident_type").isin(list(allowed)), F.lit(False))
    usable = observations.groupBy("pepmodstate_id").agg(F.bool_and(fine | F.col(intensity).isNull()).alias("use_for_calib"))
    return pepmodstates.where(~F.coalesce("is_contaminant", F.lit(False)) & ~F.coalesce("is_reverse", F.lit(False))).join(usable, "pepmodstate_id")


def used_channels(channels: DataFrame, msrun: str = "msrun", experiment: str = "experiment", mstag: str | None = None) -> DataFrame:
    """Q6: channels of experiments with more than one run; the channel column is experiment or experiment#tag."""
    chan = F.col(experiment) if mstag is None else F.concat(F.coalesce(F.col(experiment).cast("string"), F.lit("")), F.lit("#"), F.coalesce(F.col(mstag).cast("string"), F.lit("")))
    rows = channels.select(msrun, *([mstag] if mstag else []), chan.alias("expchannel"))
    several = rows.groupBy("expchannel").agg(F.countDistinct(msrun).alias("n")).where("n > 1").select("expchannel")
    return rows.join(several, "expchannel", "left_semi")


def used_intensities(intensities: DataFrame, objects: DataFrame, channels: DataFrame, obj: str, msrun: str = "msrun", mstag: str | None = None, intensity: str = "intensity", base: float = 2.0) -> DataFrame:
    """Q6: positive finite intensities of usable objects in used channels, with their logarithms."""
    x = F.col(intensity)
    ids = [msrun, *([mstag] if mstag else [])]
    fine = intensities.where((x > 0) & ~F.isnan(x) & (x < float("inf"))).select(obj, *ids, x.cast("double").alias("intensity"))
    fine = fine.join(objects.where("use_for_calib").select(obj), obj, "left_semi").join(channels, ids)
    return fine.withColumn("logintensity", F.ln("intensity") / math.log(base))


def run_shifts(used: DataFrame, obj: str, msrun: str = "msrun", base: float = 2.0) -> DataFrame:
    """Q7: per channel and run the weighted median of log shifts to the channel's first run, its sd, pairs and multiplier."""
    by_rank = ranked(used, ["expchannel", msrun], ["logintensity", obj], "_rank", "qtl").drop("_rank")
    first = used.groupBy("expchannel").agg(F.min(msrun).alias("_first"))
    one = by_rank.join(first, "expchannel").where(F.col(msrun) == F.col("_first")).select("expchannel", obj, F.col("logintensity").alias("log1"), F.col("qtl").alias("qtl1"))
    pairs = materialize(by_rank.join(one, ["expchannel", obj]).select("expchannel", msrun, (F.col("logintensity") - F.col("log1")).alias("shift"), (0.5 * F.sqrt(F.col("qtl") + F.col("qtl1"))).alias("w")), "shifts")
    keys = ["expchannel", msrun]
    median = weighted_median(pairs, keys, "shift", "w", "logshift")
    # the deviation is of shifts from their median, around their own weighted mean
    mean = F.sum(F.col("shift") * F.col("w")) / F.sum("w")
    spread = pairs.groupBy(*keys).agg(F.sqrt(F.greatest(F.sum(F.col("shift") ** 2 * F.col("w")) / F.sum("w") - mean * mean, F.lit(0.0))).alias("logshift_sd"), F.count("*").alias("npairs"))
    return median.join(spread, keys).withColumn("mult", F.pow(F.lit(float(base)), "logshift"))


def expanded(used: DataFrame, shifts: DataFrame, obj: str, msrun: str = "msrun") -> DataFrame:
    """Q8: every object of a channel in every run of it, with nulls where nothing was seen, and the normalised intensity."""
    cells = used.select(obj, "expchannel").distinct().join(shifts.select("expchannel", msrun, "mult"), "expchannel")
    seen = used.select("expchannel", msrun, obj, "intensity", "logintensity")
    return cells.join(seen, ["expchannel", msrun, obj], "left").withColumn("intensity_norm", F.col("intensity") / F.col("mult"))


def predicted(cells: DataFrame, obj: str, missed_factor: float = 1.0) -> DataFrame:
    """Q9: per channel and object the median of the normalised intensities, corrected for missing ones."""
    by = cells.groupBy("expchannel", obj).agg(F.median("intensity_norm").alias("intensity_norm_predicted"), F.count_if(F.col("intensity").isNull()).alias("n_missing"))
    return by.where("intensity_norm_predicted is not null").withColumn("intensity_norm_predicted_corr", F.col("intensity_norm_predicted") * F.pow(F.lit(float(missed_factor)), "n_missing"))


def balanced_sample(binned: DataFrame, keys: Sequence[str], bin_col: str = "intensity_bin", oversize: float = 2.0, most: int | None = None, seed: int = 1) -> DataFrame:
    """Q10: the same number of rows from each bin: oversize times the 10 % quantile of the bins' counts, rounded up.

    Rows of least hash are taken, without replacement, so a rerun takes the same.  Bins are few; the rows' order within one is
    cut by a hash bound first where a bin is far larger than what is taken.
    """
    counts = {r[bin_col]: r["n"] for r in binned.groupBy(bin_col).agg(F.count("*").alias("n")).collect()}  # one row per bin of the grid
    if not counts:
        return binned
    n = math.ceil(oversize * float(np.quantile(list(counts.values()), 0.1)))
    if most is not None and n * len(counts) > most:
        n = (most - 1) % len(counts) + 1
    h = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30))
    # four times the rows that are wanted, and 200 more, pass the bound; the window then holds no more than these
    bound = F.create_map(*[x for b, c in counts.items() for x in (F.lit(b), F.lit(min(1.0, (4 * n + 200) / c)))])
    few = binned.withColumn("_h", h).where(F.col("_h") <= F.element_at(bound, F.col(bin_col)) * (1 << 30))
    return few.where(F.col(bin_col).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(bin_col).orderBy("_h", *keys))).where(F.col("_k") <= n).drop("_h", "_k")


def calibration_data(
    intensities: DataFrame, objects: DataFrame, channels: DataFrame, obj: str = "protgroup_id", msrun: str = "msrun", experiment: str = "experiment", mstag: str | None = None, intensity: str = "intensity",
    base: float = 2.0, bins: int = 20, oversize: float = 2.0, quantile_range: float = 0.99, most: int | None = None, error_scale: float | None = None, missed_factor: float = 1.0,
) -> CalibrationData:
    """Q6-Q11 in order."""
    chan = used_channels(channels, msrun, experiment, mstag)
    used = materialize(used_intensities(intensities, objects, chan, obj, msrun, mstag, intensity, base), "intensities")
    shifts = materialize(run_shifts(used, obj, msrun, base), "run-shifts")
    cells = materialize(expanded(used, shifts, obj, msrun), "cells")
    by_obj = materialize(predicted(cells, obj, missed_factor), "predicted")
    grid = quantile_grid(by_obj, "intensity_norm_predicted_corr", base, quantile_range, bins)
    binned = by_obj.withColumn("intensity_bin", grid_bin(F.col("intensity_norm_predicted_corr"), grid))
    taken = materialize(balanced_sample(binned, ["expchannel", obj], oversize=oversize, most=most), "sample")
    rows = cells.join(taken, ["expchannel", obj]).withColumn("intensity_predicted", F.col("intensity_norm_predicted_corr") * F.col("mult"))
    rows = rows.withColumn("logintensity_predicted", F.ln("intensity_predicted") / math.log(base)).withColumn("intensity_prediction_error", (F.col("intensity_predicted") - F.col("intensity")) * (error_scale or 1.0))
    rows = materialize(rows, "used")
    shift, scale = z_parameters(rows)
    rows = rows.withColumn("intensity_zscore", (F.col("logintensity") - shift) * scale).withColumn("intensity_zscore_predicted", (F.col("logintensity_predicted") - shift) * scale)
    return CalibrationData(base, scale, shift, grid, rows, shifts)


def z_parameters(rows: DataFrame, log_col: str = "logintensity") -> tuple[float, float]:
    """Q11: mean, and 1 over the sample deviation."""
    r = rows.agg(F.avg(log_col).alias("m"), F.stddev_samp(log_col).alias("s")).first()
    return r["m"], 1.0 / r["s"]


def calibration_data_of(kind: str, data: Mapping[str, DataFrame], channels: DataFrame, **options) -> CalibrationData:
    """Q3: by kind of object: "protgroup" (wide: columns Intensity.<run>) or "pepmodstate" (observations, pepmodstates[, peptides])."""
    if kind == "protgroup":
        wide = data["wide"]
        rows = protgroup_data(wide, ["protgroup_id"])
        return calibration_data(rows, wide.select("protgroup_id", F.lit(True).alias("use_for_calib")), channels, "protgroup_id", **options)
    if kind == "pepmodstate":
        allowed = options.pop("allowed", None)
        objects = pepmodstate_data(data["observations"], data["pepmodstates"], data.get("peptides"), allowed=allowed)
        return calibration_data(data["observations"], objects, channels, "pepmodstate_id", **options)
    raise ValueError(f"unknown kind of object: {kind}")


MIN_DETECT = math.log(1e-3)


def loglik_terms(model: NoiseModel, error: Column, z_predicted: Column, log_predicted: Column) -> tuple[Column, Column]:
    """Q12: (log-likelihood of a row, whether its error is an inlier or null where it does not count)."""
    there = error.isNotNull() & ~F.isnan(error)
    counts = there & (error != 0)
    detected = F.greatest(F.lit(MIN_DETECT), model.detection_loglik(there, log_predicted))
    return F.when(counts, model.error_loglik(error, z_predicted)).otherwise(0.0) + detected, F.when(counts, model.is_inlier(error, z_predicted))


def log_likelihood(model: NoiseModel, data: CalibrationData) -> float:
    """Q12: one aggregation."""
    llh, inlier = loglik_terms(model, F.col("intensity_prediction_error"), F.col("intensity_zscore_predicted"), F.col("logintensity_predicted"))
    r = data.used.agg(F.sum(llh).alias("llh"), F.count_if(inlier).alias("n_in"), F.count_if(~inlier).alias("n_out")).first()
    return r["llh"] + beta_logpdf(model.outlierProb, r["n_out"] + 1, r["n_in"] + 1)


@dataclass(frozen=True)
class ModelFactory:
    """Q13: box bounds of the eight free parameters."""

    zScale: float
    zShift: float
    base: float = 2.0
    outlierProb: float = 1e-4
    bounds: Mapping[str, tuple[float, float]] = None  # type: ignore[assignment]

    def __post_init__(self) -> None:
        if self.bounds is None:
            object.__setattr__(self, "bounds", {"zDetectionFactor": (1e-3, 50.0), "zDetectionIntercept": (-20.0, 20.0), "detectionMax": (0.5, 1.0), "sigmaScaleHi": (1e-3, 5.0), "sigmaScaleLo": (1e-3, 5.0), "sigmaOffset": (-20.0, 30.0), "sigmaBend": (-5.0, 5.0), "sigmaSmooth": (0.0, 5.0)})

    def model(self, params: Sequence[float]) -> NoiseModel:
        if len(params) != len(self.bounds):
            raise ValueError(f"{len(self.bounds)} parameters are needed, not {len(params)}")
        return NoiseModel(self.zScale, self.zShift, logintensityBase=self.base, outlierProb=self.outlierProb, **dict(zip(self.bounds, map(float, params), strict=True)))


def bayesian_score(prior: float, llh: float, prior_weight: float = 1.0) -> float:
    """Q14: two objectives as one."""
    return prior_weight * prior + llh


def pareto_front(scores: Sequence[Sequence[float]]) -> list[int]:
    """Q14: places of the scores (all to be large) that no other is at least as good as in each objective and better in one; ties stay."""
    x = np.array(scores, float).reshape(len(scores), -1)
    beaten = [bool(((x >= row).all(1) & (x > row).any(1)).any()) for row in x]
    return [k for k, b in enumerate(beaten) if not b]


def partial_llh(model: NoiseModel, x: Mapping[str, np.ndarray]) -> tuple[float, int, int]:
    """Q12 in numpy over some rows: (sum of terms, errors, inliers among them); sums of parts are those of the whole."""
    error, z, logp = x["error"], x["z"], x["log"]
    there = np.isfinite(error)
    b = math.log(model.logintensityBase)
    t = logp * model.detection_factor + model.detection_intercept
    total = np.maximum(MIN_DETECT, -np.logaddexp(0, np.where(there, -t, t))).sum()
    e, zz = error[there & (error != 0)], z[there & (error != 0)]
    logstd = _logstd(model, zz)
    d = e * np.exp(-logstd * b)
    p = model.outlierProb
    pdf = np.logaddexp(math.log1p(-p) - d * d / 2 - math.log(2 * math.pi) / 2, math.log(p) - np.log1p(d * d) - math.log(math.pi))
    return float(total + (pdf - (logstd - model.zShift) * b).sum()), len(d), int((np.abs(d) <= model.distr.threshold).sum())


def whole_llh(model: NoiseModel, total: float, errors: int, inliers: int) -> float:
    """Q12: the terms' sum, and how likely so many outliers are."""
    return float(total + beta_logpdf(model.outlierProb, errors - inliers + 1, inliers + 1))


def population_llh(rows: DataFrame, models: Sequence[NoiseModel]) -> list[float]:
    """Q15: the log-likelihood of each model over all ``rows`` (error, z, log), in one pass: each task sends three numbers a model."""
    ship_package(rows.sparkSession)
    models = list(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(models), 3))
        for b in batches:
            x = {c: b[c].cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in ("error", "z", "log")}
            sums += [partial_llh(m, x) for m in models]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1].astype(int)), pa.array(sums[:, 2].astype(int))], names=["k", "total", "errors", "inliers"])

    made = rows.select("error", "z", "log").mapInArrow(run, "k int, total double, errors long, inliers long")
    by = {r["k"]: r for r in made.groupBy("k").agg(F.sum("total").alias("total"), F.sum("errors").alias("errors"), F.sum("inliers").alias("inliers")).collect()}  # a row for each model
    return [whole_llh(m, by[k]["total"], by[k]["errors"], by[k]["inliers"]) if k in by else whole_llh(m, 0.0, 0, 0) for k, m in enumerate(models)]


def generations(bounds: Sequence[tuple[float, float]], fitness: Callable[[np.ndarray], np.ndarray], rounds: int, population: int, seed: int, progress: Callable[[int, float], None] | None = None) -> tuple[np.ndarray, float]:
    """Differential evolution inside of a box: ``fitness`` weighs a whole generation (rows of parameters) at a time."""
    rng = np.random.default_rng(seed)
    lo, hi = np.array(bounds, float).T
    pool = lo + rng.random((population, len(lo))) * (hi - lo)
    scores = fitness(pool)
    for r in range(rounds):
        a, b, c = (pool[x] for x in np.array([rng.choice(population, 3, replace=False) for _ in range(population)]).T)
        trials = np.clip(np.where(rng.random(pool.shape) < 0.9, a + 0.7 * (b - c), pool), lo, hi)
        made = fitness(trials)
        better = made >= scores
        pool[better], scores[better] = trials[better], made[better]
        if progress:
            progress(r, float(scores.max()))
    best = int(scores.argmax())
    return pool[best], float(scores[best])


def calibrate(data: CalibrationData, factory: ModelFactory | None = None, rounds: int = 200, population: int = 40, seed: int = 1, prior_weight: float = 1.0, progress: Callable[[int, float], None] | None = None, front: list | None = None) -> tuple[NoiseModel, float]:
    """Q15: differential evolution over the factory's box; a generation is one aggregation of the sample, which stays on executors.

    Candidates are ranked by the score of both objectives; ``front`` is given those of all candidates that none beats in
    both, as (prior, log-likelihood, parameters).
    """
    factory = factory or ModelFactory(data.zScale, data.zShift, data.base)
    rows = materialize(data.used.select(F.col("intensity_prediction_error").alias("error"), F.col("intensity_zscore_predicted").alias("z"), F.col("logintensity_predicted").alias("log")), "sample")
    n = rows.count()
    best_of_both: list[tuple[float, float, list[float]]] = []

    def fitness(pool: np.ndarray) -> np.ndarray:
        models = [factory.model(p) for p in pool]
        out = []
        for p, model, llh in zip(pool, models, population_llh(rows, models), strict=True):
            prior = log_prior(model, data.grid, n=n)
            value = bayesian_score(prior, llh, prior_weight)
            if front is not None and math.isfinite(value) and not any(a >= prior and b >= llh for a, b, _ in best_of_both):
                best_of_both[:] = [c for c in best_of_both if not (prior >= c[0] and llh >= c[1])] + [(float(prior), float(llh), p.tolist())]
            out.append(value if math.isfinite(value) else -1e300)
        return np.array(out)

    best, score = generations(list(factory.bounds.values()), fitness, rounds, population, seed, progress)
    if front is not None:
        front.extend(sorted(best_of_both, key=lambda c: -c[0]))
    return factory.model(best), score


def calibration_file_prefix(info: Mapping[str, str]) -> str:
    """K4."""
    return "mscalib_" + "_".join(str(info[k]) for k in ("msinstrument", "quanttype", "quantobj", "id", "calib_ver"))


def file_prefixes(*parts: Column) -> Column:
    """K4 for a table: instrument, type, object, id and version of its rows."""
    return F.concat_ws("_", F.lit("mscalib"), *[p.cast("string") for p in parts])


def save_result(path: str, model: NoiseModel, fitness: float, params: Sequence[float], info: Mapping | None = None) -> None:
    """K1: JSON on the driver; data frames are saved as Parquet by their own writer."""
    if not path.endswith(".json"):
        raise ValueError(f"only .json can be written: {path}")
    with open(path, "w") as f:
        json.dump({"info": dict(info or {}), "mscalib": model.to_dict(), "fitness": fitness, "raw_params": list(params)}, f, indent=1)


def save_data(data: CalibrationData, folder: str) -> None:
    """K1: the frames and numbers of the calibration, as tables under ``folder``."""
    numbers = data.used.sparkSession.createDataFrame([(data.base, data.zScale, data.zShift, [float(g) for g in data.grid])], "base double, zScale double, zShift double, grid array<double>")
    for name, df in (("numbers", numbers), ("used", data.used), ("shifts", data.shifts)):
        df.write.parquet(f"{folder}/{name}")


def load_data(spark, folder: str) -> CalibrationData:
    """K1: what ``save_data`` has written."""
    r = spark.read.parquet(f"{folder}/numbers").first()
    return CalibrationData(r["base"], r["zScale"], r["zShift"], list(r["grid"]), spark.read.parquet(f"{folder}/used"), spark.read.parquet(f"{folder}/shifts"))


def load_model(path: str) -> NoiseModel:
    with open(path) as f:
        return NoiseModel.from_dict(json.load(f)["mscalib"])
