"""Trace operators: numpy functions applied per trace in Arrow batches, and native digital operators.

``samples`` has the key columns, an order column and a value. A trace is one group of the keys: it
must fit one task. Statistics that split (spectra averaged over segments) are cut into segments first,
so that no task holds a whole trace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions import signal as S
from tidewire.operators.stats import met

Keys = Sequence[str]


def per_trace(df: DataFrame, keys: Keys, order: Keys, value: str, f: Callable[[np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` of each trace's values, in order; ``schema`` is that of its frame (the keys come first)."""
    keys, order = list(keys), list(order)
    types = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(np.float64)
        out = f(x)
        for i, (k, v) in enumerate(zip(keys, key, strict=True)):
            out.insert(i, k, v)
        return out

    return df.select(*dict.fromkeys([*keys, *order, value])).groupBy(*keys).applyInPandas(run, f"{types}, {schema}")


def waveform_measurements(df: DataFrame, keys: Keys, order: Keys, value: str, fs: float) -> DataFrame:
    """One row per trace and measurement; ``applicable`` is false and ``value`` null where it cannot be had."""

    def f(x: np.ndarray) -> pd.DataFrame:
        m = S.measure(x, fs)
        return pd.DataFrame({"name": list(m), "value": [v if np.isfinite(v) else None for v in m.values()], "applicable": [bool(np.isfinite(v)) for v in m.values()]})

    return per_trace(df, keys, order, value, f, "name string, value double, applicable boolean")


def fft(df: DataFrame, keys: Keys, order: Keys, value: str, fs: float, window: str = "hann") -> DataFrame:
    """Amplitude spectrum per trace: bin, frequency, magnitude, decibels (floor 1e-20)."""

    def f(x: np.ndarray) -> pd.DataFrame:
        freq, mag = S.spectrum(x, fs, window)
        return pd.DataFrame({"bin": np.arange(len(freq)), "frequency": freq, "magnitude": mag, "db": 20 * np.log10(np.maximum(mag, 1e-20))})

    return per_trace(df, keys, order, value, f, "bin long, frequency double, magnitude double, db double")


def psd(df: DataFrame, keys: Keys, index: str, value: str, fs: float, nperseg: int = 256, window: str = "hann") -> DataFrame:
    """Welch power density, half-overlapping segments. ``index`` numbers samples from 0: segments are groups
    of their own and their spectra are averaged natively, so a trace of any length spreads over tasks."""
    step = nperseg // 2
    k = F.floor(F.col(index) / step)
    segs = df.select(*keys, F.col(index).alias("_i"), F.col(value).cast("double").alias("_v"), F.explode(F.array(k - 1, k)).alias("_seg")).filter("_seg >= 0")
    whole = segs.groupBy(*keys, "_seg").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_s")).filter(F.size("_s") == nperseg)
    kept = [f"_k{i}" for i in range(len(keys))]
    arrays = whole.select(*[F.col(c).alias(a) for c, a in zip(keys, kept, strict=True)], F.col("_s._v").alias("_x"))
    w = S.window(window, nperseg, periodic=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, nperseg)
            p = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * w, axis=1)) ** 2 / (fs * (w**2).sum())
            p[:, 1 : None if nperseg % 2 else -1] *= 2
            ends = pa.array(np.arange(len(x) + 1) * p.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], names=[*kept, "p"])

    types = "".join(f"`{c}` {t}, " for c, t in arrays.dtypes if c != "_x")
    each = arrays.mapInArrow(run, f"{types}p array<double>").toDF(*keys, "p").select(*keys, F.posexplode("p").alias("_bin", "_p"))
    p = each.groupBy(*keys, F.col("_bin").cast("long").alias("bin")).agg(F.avg("_p").alias("density"), F.count("*").alias("segments"))
    return p.withColumn("frequency", F.col("bin") * (fs / nperseg)).withColumn("db", 10 * F.log10(F.greatest("density", F.lit(1e-20))))


def spectrogram(df: DataFrame, keys: Keys, order: Keys, value: str, fs: float, nperseg: int = 256) -> DataFrame:
    def f(x: np.ndarray) -> pd.DataFrame:
        freq, t, p = S.spectrogram(x, fs, nperseg)
        return pd.DataFrame({"time": np.repeat(t, len(freq)), "frequency": np.tile(freq, len(t)), "power": p.ravel()})

    return per_trace(df, keys, order, value, f, "time double, frequency double, power double")


def spectral_quality(df: DataFrame, keys: Keys, order: Keys, value: str, fs: float) -> DataFrame:
    """Fundamental, THD, SNR, SINAD, ENOB and SFDR per trace."""
    names = ("fundamental", "thd", "snr", "sinad", "enob", "sfdr")
    return per_trace(df, keys, order, value, lambda x: pd.DataFrame([S.harmonics(x, fs)])[list(names)], ", ".join(f"{n} double" for n in names))


def filtered(df: DataFrame, keys: Keys, order: Keys, value: str, fs: float, kind: str, cutoff: float | tuple[float, float], order_n: int = 4) -> DataFrame:
    """Zero-phase Butterworth filtering per trace: kind low, high, band or stop; notch takes (frequency, Q)."""
    sections = S.notch(*cutoff, fs) if kind == "notch" else S.butterworth(order_n, cutoff, fs, kind)

    def f(x: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"idx": np.arange(len(x)), "value": S.zero_phase(sections, x)})

    return per_trace(df, keys, order, value, f, "idx long, value double")


def transformed(df: DataFrame, keys: Keys, order: Keys, value: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Any array-to-array function of a trace (Savitzky-Golay, Gaussian, median, matched, equalizers, resampling)."""
    return per_trace(df, keys, order, value, lambda x: pd.DataFrame({"idx": np.arange(len(y := np.asarray(f(x), float))), "value": y}), "idx long, value double")


def change_points(df: DataFrame, keys: Keys, order: Keys, value: str, penalty: float | None = None) -> DataFrame:
    return per_trace(df, keys, order, value, lambda x: pd.DataFrame({"at": np.array(S.change_points(x, penalty), np.int64)}), "at long")


def eye_metrics(df: DataFrame, keys: Keys, order: Keys, value: str, fs: float, ui: float) -> DataFrame:
    return per_trace(df, keys, order, value, lambda x: pd.DataFrame([S.eye(x, fs, ui)])[["height", "q", "width"]], "height double, q double, width double")


def jitter_parts(df: DataFrame, keys: Keys, order: Keys, value: str, ber: float = 1e-12) -> DataFrame:
    return per_trace(df, keys, order, value, lambda x: pd.DataFrame([S.decompose_jitter(x, ber)]), "rj double, dj double, tj double")


# ---- native digital operators ----------------------------------------------------------------


def edges(df: DataFrame, keys: Keys, order: Keys, value: str, at: str, level: float) -> DataFrame:
    """Rising and falling passages of a level with linearly interpolated time."""
    by = W.partitionBy(*keys).orderBy(*order)
    a, ta, b = F.lag(value).over(by), F.lag(at).over(by), F.col(value)
    kind = F.when((a < level) & (b >= level), "rising").when((a >= level) & (b < level), "falling")
    part = F.greatest(F.least((F.lit(level) - a) / (b - a), F.lit(1.0)), F.lit(0.0))
    out = df.withColumns({"edge": kind, "edge_time": ta + part * (F.col(at) - ta)})
    return out.filter("edge is not null")


def pulses(df: DataFrame, keys: Keys, order: Keys, value: str, at: str, level: float) -> DataFrame:
    """Each rising edge with the next falling one: width."""
    by = W.partitionBy(*keys).orderBy("edge_time")
    e = edges(df, keys, order, value, at, level).select(*keys, "edge", "edge_time")
    nxt = e.withColumns({"_n": F.lead("edge").over(by), "stop": F.lead("edge_time").over(by)})
    return nxt.filter((F.col("edge") == "rising") & (F.col("_n") == "falling")).select(*keys, F.col("edge_time").alias("start"), "stop", (F.col("stop") - F.col("edge_time")).alias("width"))


def glitches(df: DataFrame, keys: Keys, order: Keys, value: str, at: str, level: float, least: float) -> DataFrame:
    return pulses(df, keys, order, value, at, level).filter(F.col("width") < least)


def edge_timing(df: DataFrame, keys: Keys, order: Keys, value: str, at: str, level: float) -> DataFrame:
    """Mean period, frequency, jitter and duty from rising edges and pulse widths."""
    p = pulses(df, keys, order, value, at, level)
    by = W.partitionBy(*keys).orderBy("start")
    p = p.withColumn("period", F.lead("start").over(by) - F.col("start"))
    g = p.groupBy(*keys).agg(F.count("*").alias("pulses"), F.avg("period").alias("period"), F.stddev_pop("period").alias("period_jitter"), F.avg("width").alias("width"))
    return g.withColumns({"frequency": 1 / F.col("period"), "duty": F.col("width") / F.col("period")})


def window_crossings(df: DataFrame, keys: Keys, order: Keys, value: str, low: float, high: float) -> DataFrame:
    """Entries to and exits from the inclusive window [low, high], at the first sample after the change."""
    by = W.partitionBy(*keys).orderBy(*order)
    inside = F.col(value).between(low, high)
    was = F.lag(inside).over(by)
    kind = F.when(inside & ~was, "entry").when(~inside & was, F.when(F.col(value) > high, "exit_high").otherwise("exit_low"))
    return df.withColumn("crossing", kind).filter("crossing is not null")


def bit_pattern(df: DataFrame, keys: Keys, order: Keys, bit: Column, pattern: str) -> DataFrame:
    """Rows at which a pattern of 0, 1 and X begins."""
    by = W.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_bit", bit.cast("int"))
    hit = F.lit(True)
    for i, c in enumerate(pattern.upper()):
        if c != "X":
            hit = hit & (F.lead("_bit", i).over(by) == int(c))
    n = F.lead("_bit", len(pattern) - 1).over(by).isNotNull() if len(pattern) > 1 else F.lit(True)
    return marked.withColumn("_hit", hit & n).filter("_hit").drop("_bit", "_hit")


def pack_bits(columns: Sequence[Column]) -> Column:
    """Bit columns, least significant first, as a word."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        out = out.bitwiseOR(F.shiftleft(c.cast("long"), i))
    return out


def setup_hold(clock: DataFrame, data: DataFrame, keys: Keys, at: str, setup: float, hold: float) -> DataFrame:
    """Per clock edge: time since the last and until the next data edge, and violations of both limits."""
    from tidewire.operators.joins import asof_merge

    before = asof_merge(clock, data, keys, at, at, []).withColumnRenamed("asof_t", "_before")
    both = asof_merge(before, data, keys, at, at, [], forward=True).withColumnRenamed("asof_t", "_after")
    s, h = F.col(at) - F.col("_before"), F.col("_after") - F.col(at)
    return both.select(*clock.columns, s.alias("setup_time"), h.alias("hold_time"), (s < setup).alias("setup_violation"), (h < hold).alias("hold_violation"))


def power_statistics(df: DataFrame, keys: Keys, order: Keys, v: str, i: str, dt: float) -> DataFrame:
    """Average, RMS, peak, energy (trapezoid), apparent and reactive power and power factor of v * i."""
    by = W.partitionBy(*keys).orderBy(*order)
    p = df.withColumn("_p", F.col(v) * F.col(i)).withColumn("_e", F.coalesce((F.col("_p") + F.lag("_p").over(by)) * (dt / 2), F.lit(0.0)))
    g = p.groupBy(*keys).agg(
        F.avg("_p").alias("average"), F.sqrt(F.avg(F.col("_p") ** 2)).alias("rms"), F.max(F.abs("_p")).alias("peak"), F.sum("_e").alias("energy"),
        F.stddev_pop("_p").alias("std"), (F.sqrt(F.avg(F.col(v) ** 2)) * F.sqrt(F.avg(F.col(i) ** 2))).alias("apparent"),
    )
    s, q = F.col("apparent"), F.sqrt(F.greatest(F.col("apparent") ** 2 - F.col("average") ** 2, F.lit(0.0)))
    return g.withColumns({"reactive": q, "power_factor": F.when(s > 0, F.col("average") / s).otherwise(0.0)})


def ripple(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """DC level, peak-to-peak and RMS of what is left, their percentages and the crest factor."""
    x = met(df, df.groupBy(*keys).agg(F.avg(value).alias("_dc")), keys).withColumn("_ac", F.col(value) - F.col("_dc"))
    g = x.groupBy(*keys).agg(F.first("_dc").alias("dc"), (F.max("_ac") - F.min("_ac")).alias("pp"), F.sqrt(F.avg(F.col("_ac") ** 2)).alias("rms"), F.max(F.abs("_ac")).alias("_pk"))
    pct = lambda c: F.when(F.col("dc") != 0, F.abs(F.col(c) / F.col("dc")) * 100)
    return g.select(*keys, "dc", "pp", "rms", pct("pp").alias("pp_percent"), pct("rms").alias("rms_percent"), F.when(F.col("rms") > 0, F.col("_pk") / F.col("rms")).alias("crest"))


def efficiency(p_out: Column, p_in: Column) -> Column:
    return F.when(p_in > 0, p_out / p_in).otherwise(0.0)


def compare_to_golden(df: DataFrame, golden: DataFrame, keys: Keys, value: str, tolerance: float) -> DataFrame:
    """Samples, mismatches, largest and RMS deviation and correlation of a trace with a reference trace."""
    g = golden.select(*keys, F.col(value).alias("_g"))
    d = df.join(g, list(keys)).withColumn("_d", F.col(value) - F.col("_g"))
    return d.agg(
        F.count("*").alias("n"), F.count_if(F.abs("_d") > tolerance).alias("violations"), F.max(F.abs("_d")).alias("max_deviation"),
        F.sqrt(F.avg(F.col("_d") ** 2)).alias("rms_deviation"), F.corr(value, "_g").alias("correlation"),
    )


def correlation_attack(traces: DataFrame, samples: str, byte: str, model: Sequence[int]) -> DataFrame:
    """Pearson r of each sample with the Hamming weight of model[byte xor guess], for 256 guesses.

    Sums by data byte first (256 rows a sample), then guesses over those: the traces are read once.
    """
    x = traces.select(byte, F.posexplode(samples).alias("sample", "v"))
    s = x.groupBy("sample", F.col(byte).alias("b")).agg(F.count("*").alias("n"), F.sum("v").alias("sv"), F.sum(F.col("v") ** 2).alias("svv"))
    guesses = traces.sparkSession.range(256).select(F.col("id").cast("int").alias("guess"))
    table = F.array(*[F.lit(int(v).bit_count()) for v in model])
    h = s.crossJoin(F.broadcast(guesses)).withColumn("h", F.element_at(table, F.col("b").cast("int").bitwiseXOR(F.col("guess")) + 1).cast("double"))  # 256 guesses
    g = h.groupBy("guess", "sample").agg(
        F.sum("n").alias("N"), F.sum(F.col("n") * F.col("h")).alias("sh"), F.sum(F.col("n") * F.col("h") ** 2).alias("shh"), F.sum(F.col("h") * F.col("sv")).alias("shv"), F.sum("sv").alias("sv"), F.sum("svv").alias("svv"),
    )
    cov = F.col("N") * F.col("shv") - F.col("sh") * F.col("sv")
    var = (F.col("N") * F.col("shh") - F.col("sh") ** 2) * (F.col("N") * F.col("svv") - F.col("sv") ** 2)
    return g.select("guess", "sample", F.when(var > 0, cov / F.sqrt(var)).otherwise(0.0).alias("r"))


# ---- analyses of traces held as arrays -------------------------------------------------------
# A row is one trace, its samples an array column (``protocols.sampled`` makes such rows of samples that
# are rows), so that an analysis needs no shuffle and its memory is that of a few rows.


def _rows_of(**columns: np.ndarray) -> list[dict]:
    names = list(columns)
    return [dict(zip(names, r, strict=True)) for r in zip(*(np.asarray(c).tolist() for c in columns.values()), strict=True)]


def _envelope(x: np.ndarray, fs: float = 1.0) -> list[dict]:
    z = S.analytic(x)
    phase = np.unwrap(np.angle(z))
    return _rows_of(idx=np.arange(len(x)), value=z.real, envelope=np.abs(z), phase=phase, frequency=np.gradient(phase) * fs / (2 * np.pi) if len(x) > 1 else np.zeros(len(x)))


def _bins(pair: tuple[np.ndarray, np.ndarray], name: str) -> list[dict]:
    return _rows_of(bin=np.arange(len(pair[0])), frequency=pair[0], **{name: pair[1]})


def _wavelet(x: np.ndarray, levels: int = 3) -> list[dict]:
    return [{"level": k, "coefficients": c.tolist()} for k, c in enumerate(S.haar(x, levels))]


def _scales(x: np.ndarray, scales: tuple[float, ...] = (2.0, 4.0, 8.0)) -> list[dict]:
    return [{"scale": s, "power": np.abs(r).tolist()} for s, r in zip(scales, S.morlet(x, np.array(scales)), strict=True)]


#: Analysis of arrays by name: a function of the array columns that gives rows, and their columns.
ANALYSES = {
    "hilbert": (_envelope, "idx long, value double, envelope double, phase double, frequency double"),
    "dwt": (_wavelet, "level int, coefficients array<double>"),
    "cwt": (_scales, "scale double, power array<double>"),
    "mfcc": (lambda x, fs=16000.0, **o: [{"frame": i, "coefficients": r.tolist()} for i, r in enumerate(S.mel_cepstrum(x, fs, **o))], "frame int, coefficients array<double>"),
    "spectrum": (lambda x, fs=1.0, **o: _bins(S.spectrum(x, fs, **o), "magnitude"), "bin long, frequency double, magnitude double"),
    "periodogram": (lambda x, fs=1.0, **o: _bins(S.periodogram(x, fs, **o), "density"), "bin long, frequency double, density double"),
    "bartlett": (lambda x, fs=1.0, **o: _bins(S.bartlett(x, fs, **o), "density"), "bin long, frequency double, density double"),
    "welch": (lambda x, fs=1.0, **o: _bins(S.welch(x, fs, **o), "density"), "bin long, frequency double, density double"),
    "peaks": (lambda x, fs=1.0, **o: S.spectral_peaks(x, fs, **o), "frequency double, magnitude double, db double"),
    "harmonics": (lambda x, fs=1.0, **o: [S.harmonics(x, fs, **o)], "fundamental double, thd double, snr double, sinad double, enob double, sfdr double"),
    "coherence": (lambda x, y, fs=1.0, **o: _bins(S.coherence(x, y, fs, **o), "coherence"), "bin long, frequency double, coherence double"),
    "phase_locking": (lambda x, y: [{"plv": S.phase_locking(x, y)}], "plv double"),
    "runts": (lambda x, low, high: [dict(zip(("start", "stop", "extreme", "polarity"), r, strict=True)) for r in S.runts(x, low, high)], "start int, stop int, extreme double, polarity int"),
    "seasonal": (lambda x, period: _rows_of(idx=np.arange(len(x)), **dict(zip(("trend", "season", "rest"), S.seasonal(x, period), strict=True))), "idx long, trend double, season double, rest double"),
    "change_points": (lambda x, **o: [{"at": k} for k in S.change_points(x, **o)], "at long"),
    "dfe": (lambda x, taps, **o: _rows_of(idx=np.arange(len(x)), **dict(zip(("value", "bit"), S.dfe(x, list(taps), **o), strict=True))), "idx long, value double, bit double"),
    "bathtub": (lambda x, ui, **o: _rows_of(**dict(zip(("time", "ber"), S.bathtub(*[S.decompose_jitter(x)[k] for k in ("rj", "dj")], ui, **o), strict=True))), "time double, ber double"),
    "measure": (lambda x, fs=1.0: [{"name": n, "value": v if np.isfinite(v) else None} for n, v in {**S.measure(x, fs), "preshoot": S.preshoot(x)}.items()], "name string, value double"),
    "clock": (lambda x, fs, nominal, **o: [{"frequency": (r := S.recovered_clock(x, fs, nominal, **o))[0], "edges": len(r[1]), "rms_error": float(np.sqrt((r[1] ** 2).mean())) if len(r[1]) else None}], "frequency double, edges int, rms_error double"),
    "quality": (lambda x: [S.quality(x)], "clipped double, flat double, noise double, snr double"),
    "character": (lambda x: [S.character(x)], "kind string, two_level double, periodicity double, confidence double"),
    "anomalies": (lambda x, **o: S.glitches_and_dropouts(x, **o), "kind string, start int, stop int, size double"),
}


def analyze(df: DataFrame, keys: Keys, kind: str, columns: Sequence[str], **options) -> DataFrame:
    """Rows of an analysis (a name in ``ANALYSES``) of each row's array columns; a null array gives none."""
    from tidewire.operators.messages import records

    f, schema = ANALYSES[kind]
    return records(df, keys, columns, lambda *x: f(*(np.asarray(v, float) for v in x), **options), schema)


def inverse_dwt(df: DataFrame, keys: Keys) -> DataFrame:
    """Samples of wavelet rows (``level, coefficients``)."""
    from tidewire.operators.messages import records

    parts = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", "coefficients"))).alias("_p"))
    flat = parts.select(*keys, F.flatten(F.transform("_p", lambda p: p.coefficients)).alias("_c"), F.transform("_p", lambda p: F.size(p.coefficients)).alias("_n"))

    def f(c: np.ndarray, n: np.ndarray) -> list[dict]:
        return _rows_of(idx=np.arange(len(y := S.inverse_haar(np.split(np.asarray(c, float), np.cumsum(n)[:-1])))), value=y)

    return records(flat, keys, ["_c", "_n"], f, "idx long, value double")


def row_outliers(df: DataFrame, keys: Keys, order: Keys, features: str, method: str = "lof", **options) -> DataFrame:
    """Local outlier factor or isolation score of each row (array of features) among its group's rows."""
    from tidewire.operators.messages import grouped

    score = {"lof": S.local_outlier_factor, "isolation": S.isolation_scores}[method]
    return grouped(df, keys, order, [features], lambda x: [{"row": i, "score": float(s)} for i, s in enumerate(score(np.array(x, float), **options))], "row int, score double")


def compare_traces(df: DataFrame, keys: Keys, a: str, b: str, tolerance: float) -> DataFrame:
    """Samples, differences beyond the tolerance, largest and RMS difference and the verdict per group."""
    d = F.abs(F.col(a) - F.col(b))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(d > tolerance).alias("violations"), F.max(d).alias("max_deviation"), F.sqrt(F.avg(d * d)).alias("rms_deviation"), (F.count_if(d > tolerance) == 0).alias("passed")
    )
