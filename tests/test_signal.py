import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.functions import signal as S
from tidewire.operators import traces

FS = 1000.0
T = np.arange(2000) / FS


def test_spectrum_amplitude_and_parseval():
    f, mag = S.spectrum(3 * np.sin(2 * np.pi * 50 * T), FS)
    assert f[mag.argmax()] == 50 and abs(mag.max() - 3) < 0.01
    x = np.random.default_rng(0).normal(size=8192)
    f, p = S.welch(x, FS, 256)
    assert abs(p.sum() * (f[1] - f[0]) - x.var()) < 0.05


def test_harmonics():
    x = np.sin(2 * np.pi * 50 * T) + 0.1 * np.sin(2 * np.pi * 100 * T) + 0.02 * np.sin(2 * np.pi * 310 * T)
    h = S.harmonics(x, FS)
    assert h["fundamental"] == 50 and abs(h["thd"] - 10) < 0.2 and abs(h["sfdr"] - 20) < 0.3
    assert abs(h["snr"] - 10 * math.log10(1 / 0.0004)) < 1


def test_analytic_wavelets_and_cepstrum():
    x = np.cos(2 * np.pi * 40 * T) * 2
    assert np.allclose(np.abs(S.analytic(x)), 2, atol=1e-9)
    y = np.random.default_rng(1).normal(size=64)
    assert np.allclose(S.inverse_haar(S.haar(y, 4)), y)
    power = np.abs(S.morlet(np.sin(2 * np.pi * 50 * T), np.arange(5, 60))) ** 2
    assert abs(np.arange(5, 60)[power[:, 1000].argmax()] - 6 / (2 * np.pi * 50 / FS)) < 2
    assert S.mel_cepstrum(x, FS).shape[1] == 13


@pytest.mark.parametrize("kind,cutoff,gone,kept", [("low", 80, 300, 10), ("high", 80, 10, 300), ("band", (40, 90), 300, 60), ("stop", (40, 90), 60, 300)])
def test_butterworth(kind, cutoff, gone, kept):
    sos = S.butterworth(4, cutoff, FS, kind)
    gain = lambda f: abs(np.prod([np.polyval(b, z := np.exp(2j * np.pi * f / FS)) / np.polyval(a, z) for b, a in sos]))
    for c in [cutoff] if np.isscalar(cutoff) else cutoff:
        assert abs(gain(c) - 1 / math.sqrt(2)) < 1e-6
    assert gain(gone) < 0.15 and gain(kept) > 0.9
    mixed = np.sin(2 * np.pi * gone * T) + np.sin(2 * np.pi * kept * T)
    left = S.zero_phase(sos, mixed)[500:1500]
    assert np.abs(left - np.sin(2 * np.pi * kept * T)[500:1500]).max() < 0.25


def test_small_filters():
    line = 2.0 * np.arange(50) + 1
    assert np.allclose(S.savgol(line**2, 7, 2), line**2)
    assert np.allclose(S.gaussian(np.ones(40), 2), 1)
    assert S.median_filter(np.array([1.0, 9, 1, 1, 1]), 3).tolist() == [1, 1, 1, 1, 1]
    assert abs(S.zero_phase(S.notch(50, 5, FS), np.sin(2 * np.pi * 50 * T))[900:1100]).max() < 0.02
    assert np.allclose(S.resample(np.sin(2 * np.pi * 5 * T), 4000, "fft")[::2], np.sin(2 * np.pi * 5 * T), atol=1e-6)


def test_measurements_of_a_square():
    x = np.where((T * 10) % 1 < 0.3, 3.3, 0.0)
    m = S.measure(x, FS)
    assert abs(m["frequency"] - 10) < 1e-6 and abs(m["duty_cycle"] - 0.3) < 0.01 and abs(m["amplitude"] - 3.3) < 0.1
    ramp = np.concatenate((np.zeros(50), np.linspace(0, 1, 101), np.ones(50)))
    assert abs(S.transition_time(ramp, 1.0) - 80) < 2.5


@settings(deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=2, max_size=60))
def test_schmitt_equals_the_state_machine(values):
    state, want = False, []
    for v in values:
        state = True if v >= 1 else False if v < -1 else state
        want.append(state)
    assert S.schmitt(np.array(values), -1, 1).tolist() == want


def test_runts_and_jitter():
    x = np.array([0, 0, 0.5, 0.5, 0, 1, 1, 0.5, 1, 0], float)
    assert [(a, b, p) for a, b, _, p in S.runts(x, 0.2, 0.8)] == [(2, 3, 1), (7, 7, -1)]
    assert abs(S.q_factor(1e-12) - 7.034) < 1e-2 and math.isnan(S.q_factor(0.6))
    rng = np.random.default_rng(2)
    tie = rng.normal(0, 1, 20000) + rng.choice([-5, 5], 20000)
    j = S.decompose_jitter(tie)
    assert abs(j["rj"] - 1) < 0.2 and abs(j["dj"] - 10) < 1.5  # a tail of one of two peaks holds half the edges, so the fit is biased
    _, ber = S.bathtub(0.02, 0.1, 1.0)
    assert ber[0] > 0.2 and ber[50] < 1e-12


def test_eye_and_equalizers():
    bits = np.random.default_rng(3).integers(0, 2, 400)
    x = np.repeat(bits, 10) + np.random.default_rng(4).normal(0, 0.02, 4000)
    e = S.eye(x, 10.0, 1.0)
    assert 0.8 < e["height"] < 1 and e["q"] > 15 and e["width"] > 0.7
    sent = np.random.default_rng(5).choice([-1.0, 1.0], 200)
    heard = sent + 0.4 * np.append(0, sent[:-1])
    assert (S.dfe(heard, [0.4])[1][1:] == sent[1:]).all()


def test_change_points_and_outliers():
    x = np.concatenate((np.zeros(50), np.full(50, 5.0), np.full(50, 1.0))) + np.random.default_rng(6).normal(0, 0.2, 150)
    assert S.change_points(x) == [50, 100]
    trend, season, rest = S.seasonal(np.arange(120) * 0.1 + np.tile([1, -1, 0, 0], 30), 4)
    assert np.abs(rest[10:-10]).max() < 1e-9 and np.allclose(season[:4], [1, -1, 0, 0])
    assert np.allclose(trend + season + rest, np.arange(120) * 0.1 + np.tile([1, -1, 0, 0], 30))
    m = np.vstack((np.random.default_rng(7).normal(size=(200, 2)), [[9.0, 9.0]]))
    assert S.isolation_scores(m).argmax() == 200 == S.local_outlier_factor(m).argmax()


def samples(spark):
    rows = [("a", i, float(v)) for i, v in enumerate(np.sin(2 * np.pi * 50 * T))] + [("b", i, float(v)) for i, v in enumerate(np.where((T * 10) % 1 < 0.3, 3.3, 0))]
    return spark.createDataFrame(rows, "trace string, idx long, v double").repartition(3)


def test_traces_on_spark_equal_numpy(spark):
    df = samples(spark)
    f = traces.fft(df, ["trace"], ["idx"], "v", FS).filter("trace = 'a'").orderBy("bin").toPandas()
    assert np.allclose(f.magnitude, S.spectrum(np.sin(2 * np.pi * 50 * T), FS)[1])
    p = traces.psd(df, ["trace"], "idx", "v", FS, 256).filter("trace = 'a'").orderBy("bin").toPandas()
    assert np.allclose(p.density, S.welch(np.sin(2 * np.pi * 50 * T), FS, 256)[1])
    low = traces.filtered(df, ["trace"], ["idx"], "v", FS, "low", 100.0).filter("trace = 'a'").orderBy("idx").toPandas()
    assert np.allclose(low.value, S.zero_phase(S.butterworth(4, 100.0, FS), np.sin(2 * np.pi * 50 * T)))
    m = {r["name"]: r.value for r in traces.waveform_measurements(df, ["trace"], ["idx"], "v", FS).filter("trace = 'b'").collect()}
    assert abs(m["frequency"] - 10) < 1e-6
    q = traces.spectral_quality(df, ["trace"], ["idx"], "v", FS).filter("trace = 'a'").first()
    assert q.fundamental == 50
    t = traces.edge_timing(df.withColumn("t", df.idx / FS), ["trace"], ["idx"], "v", "t", 1.65).filter("trace = 'b'").first()
    assert abs(t.period - 0.1) < 1e-9 and abs(t.duty - 0.3) < 0.01
    assert traces.glitches(df.withColumn("t", df.idx / FS), ["trace"], ["idx"], "v", "t", 1.65, 0.01).filter("trace = 'b'").count() == 0


def test_attack_finds_the_key(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    table, key = rng.permutation(256), 0x5A
    p = rng.integers(0, 256, 400)
    rows = [(int(b), [float(rng.normal()), int(table[b ^ key]).bit_count() + float(rng.normal(0, 0.5))]) for b in p]
    r = traces.correlation_attack(spark.createDataFrame(rows, "b int, s array<double>"), "s", "b", table.tolist())
    best = r.orderBy(F.desc(F.abs("r"))).first()
    assert (best.guess, best["sample"]) == (key, 1)


def test_setup_and_hold(spark):
    clock = spark.createDataFrame([("k", 10.0), ("k", 20.0)], "k string, t double")
    data = spark.createDataFrame([("k", 9.5), ("k", 15.0), ("k", 21.0)], "k string, t double")
    got = [(r.setup_time, r.hold_time, r.setup_violation, r.hold_violation) for r in traces.setup_hold(clock, data, ["k"], "t", 1.0, 2.0).orderBy("t").collect()]
    assert got == [(0.5, 5.0, True, False), (5.0, 1.0, False, True)]


def test_golden(spark):
    df = samples(spark).filter("trace = 'a'")
    g = df.withColumn("v", df.v + 0.01)
    r = traces.compare_to_golden(df, g, ["trace", "idx"], "v", 0.02).first()
    assert r.n == 2000 and r.violations == 0 and abs(r.max_deviation - 0.01) < 1e-9


assert pd


def test_coherence_phase_locking_peaks_and_clock():
    rng = np.random.default_rng(4)
    t = np.arange(4096) / 1000
    x = np.sin(2 * np.pi * 50 * t) + 0.1 * rng.normal(size=len(t))
    y = 2 * np.sin(2 * np.pi * 50 * t + 0.7) + rng.normal(size=len(t))
    f, c = S.coherence(x, y, 1000.0, 256)
    assert c[np.abs(f - 50).argmin()] > 0.9 and np.median(c[f > 100]) < 0.3 and (c <= 1 + 1e-9).all()
    assert S.phase_locking(x, x) > 0.999 and S.phase_locking(x, rng.normal(size=len(t))) < 0.2
    peaks = S.spectral_peaks(np.sin(2 * np.pi * 50 * t) + 0.5 * np.sin(2 * np.pi * 120 * t), 1000.0, -40, 20, 2)
    assert [round(p["frequency"]) for p in peaks] == [50, 120]
    clock, errors = S.recovered_clock(np.sign(np.sin(2 * np.pi * 51 * t)), 1000.0, 100.0)
    assert abs(clock - 102) < 1.5 and abs(errors[-1]) < 2e-3


def test_character_quality_and_anomalies():
    rng = np.random.default_rng(5)
    t = np.arange(1000) / 1000
    assert S.character(np.sign(np.sin(2 * np.pi * 5 * t)))["kind"] == "digital"
    assert S.character(np.sin(2 * np.pi * 5 * t))["kind"] == "periodic"
    assert S.character(rng.normal(size=1000))["kind"] == "noise" and S.character(np.ones(50))["kind"] == "constant"
    x = np.sin(2 * np.pi * 5 * t)
    assert S.quality(np.clip(x, -0.5, 0.5))["clipped"] > 0.5 > S.quality(x)["clipped"]
    y = x + 0.001 * rng.normal(size=1000)
    y[300] += 5
    y[600:640] = y[600]
    kinds = {(a["kind"], a["start"]) for a in S.glitches_and_dropouts(y)}
    assert ("glitch", 299) in kinds and ("dropout", 600) in kinds
    z = np.r_[np.zeros(50), -0.2 * np.ones(5), np.ones(50)]
    assert 15 < S.preshoot(z) < 25


def test_local_outlier_factor_of_many_rows():
    """Equal to the definition, in memory that does not grow with rows x rows x features."""
    import tracemalloc

    def plain(x, k):
        d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        dist = np.take_along_axis(d, near, 1)
        density = 1 / np.maximum(np.maximum(dist, dist.max(1)[near]).mean(1), 1e-12)
        return density[near].mean(1) / density

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)) * rng.choice([0.1, 1, 30], (300, 1)) + 1e4
    x[50:60] = x[3]
    x[60:70] = x[4] + rng.normal(size=(10, 16)) * 1e-9
    np.testing.assert_allclose(S.local_outlier_factor(x, 5), plain(x, 5), rtol=1e-12)
    gap = x.copy()
    gap[7, 2] = np.nan
    got = S.local_outlier_factor(gap, 5)
    assert np.isnan(got[7])
    np.testing.assert_allclose(np.delete(got, 7), plain(np.delete(x, 7, 0), 5), rtol=1e-12)
    assert S.local_outlier_factor(x[:1], 5).tolist() == [1.0]
    many = rng.normal(size=(1500, 64))
    tracemalloc.start()
    S.local_outlier_factor(many, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
