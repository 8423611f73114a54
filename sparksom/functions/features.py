"""Features of signal windows: statistical, complexity and spectral.

A window is an ``array<double>``. Windows of a batch that are equally long are one NumPy
matrix, and the power spectrum of a window is worked out once for all its spectral
features. A null, empty or not entirely finite window has null features. Population
moments throughout; every ratio with a zero denominator has the value named below.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

STATISTICAL = ("mean", "std", "var", "skewness", "kurtosis", "rms", "peak_to_peak", "zero_crossing_rate", "line_length")
COMPLEXITY = ("hjorth_activity", "hjorth_mobility", "hjorth_complexity", "sample_entropy")
SPECTRAL = ("spectral_power", "dominant_frequency", "spectral_entropy", "spectral_centroid", "spectral_rolloff")
#: The frequency bands in Hz, both ends included.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 100.0)}
BAND_POWERS = tuple(f"{b}_power" for b in BANDS)
AVAILABLE = (*STATISTICAL, *COMPLEXITY, *SPECTRAL, *BAND_POWERS, "mfcc")


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, and 0 where b is not positive."""
    return np.where(b > 0, a / np.where(b > 0, b, 1.0), 0.0)


def sample_entropies(x: np.ndarray, m: int = 2, r: float | None = None) -> np.ndarray:
    """-ln(A / B) of each row: of the pairs of starts whose templates of m (B) and m + 1 (A)
    samples stay closer than r (0.2 standard deviations), each counted over the first
    n - length starts. No B pair gives 0, no A pair infinity. All pairs of one distance
    in time are compared at once, over all rows."""
    rows, n = x.shape
    tolerance = (0.2 * np.where(np.ptp(x, axis=1) > 0, x.std(1), 0.0) if r is None else np.full(rows, float(r)))[:, None]
    counts = {m: np.zeros(rows, np.int64), m + 1: np.zeros(rows, np.int64)}
    for lag in range(1, n - m):
        apart = np.abs(x[:, lag:] - x[:, :-lag])
        for length in counts:
            pairs = n - length - lag  # starts whose partner is a start as well
            if pairs > 0:
                furthest = apart[:, :pairs].copy()
                for k in range(1, length):
                    np.maximum(furthest, apart[:, k:k + pairs], out=furthest)
                counts[length] += (furthest < tolerance).sum(1)
    a, b = counts[m + 1], counts[m]
    found = -np.log(np.where(a > 0, a, 1) / np.where(b > 0, b, 1))
    return np.where(b == 0, 0.0, np.where(a == 0, np.inf, found))


def sample_entropy(x: np.ndarray, m: int = 2, r: float | None = None) -> float:
    """:func:`sample_entropies` of one signal."""
    return float(sample_entropies(np.asarray(x, float)[None], m, r)[0])


def periodogram(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Squared spectrum over n, one-sided without doubling; rows are windows."""
    n = x.shape[-1]
    return np.fft.rfftfreq(n, 1.0 / fs), np.abs(np.fft.rfft(x)) ** 2 / n


def welch(x: np.ndarray, fs: float, nperseg: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Welch's estimate: half-overlapping Hann segments, mean removed, one-sided density."""
    n = min(nperseg, x.shape[-1])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
    step = max(1, n - n // 2)
    segments = [x[..., i:i + n] for i in range(0, x.shape[-1] - n + 1, step)]
    constant = [np.ptp(s, axis=-1, keepdims=True) == 0 for s in segments]  # no rest of rounding
    power = np.mean([np.abs(np.fft.rfft(np.where(c, 0.0, s - s.mean(-1, keepdims=True)) * window)) ** 2 for s, c in zip(segments, constant)], axis=0)
    power = power / (fs * (window ** 2).sum())
    power[..., 1:(-1 if n % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(n, 1.0 / fs), power


class FeatureExtractor:
    """Names and parameters of features; ``extract`` adds a column per feature.

    Without names the features are the sorted statistical and complexity ones. ``psd`` is
    "periodogram" or "welch". ``bands`` replaces the frequency bands (a band power whose
    band it lacks is a KeyError). Unknown names are a ValueError. ``mfcc`` needs librosa
    and gives ``n_mfcc`` columns; without librosa it is an ImportError.
    """

    def __init__(self, features: list[str] | None = None, fs: float = 1.0, n_mfcc: int = 13, mfcc_hop_length: int = 512,
                 sample_entropy_m: int = 2, sample_entropy_r: float | None = None, spectral_rolloff_pct: float = 0.85,
                 bands: dict[str, tuple[float, float]] | None = None, psd: str = "periodogram"):
        self.features = list(features) if features is not None else sorted((*STATISTICAL, *COMPLEXITY))
        unknown = [f for f in self.features if f not in AVAILABLE]
        if unknown:
            raise ValueError(f"unknown features: {', '.join(unknown)}")
        self.bands = BANDS if bands is None else bands
        for f in self.features:
            if f in BAND_POWERS:
                self.bands[f.removesuffix("_power")]
        if "mfcc" in self.features:
            import librosa  # noqa: F401  (an ImportError here rather than in the tasks)
        self.fs, self.n_mfcc, self.hop = float(fs), n_mfcc, mfcc_hop_length
        self.m, self.r, self.rolloff = sample_entropy_m, sample_entropy_r, spectral_rolloff_pct
        self.estimate = {"periodogram": periodogram, "welch": welch}[psd]

    @property
    def names(self) -> list[str]:
        """Names of the columns, in their order."""
        return [n for f in self.features for n in ([f"mfcc_{i}" for i in range(self.n_mfcc)] if f == "mfcc" else [f])]

    def matrix(self, x: np.ndarray) -> np.ndarray:
        """Features (columns) of equally long windows (rows)."""
        known: dict[str, np.ndarray] = {}
        with np.errstate(all="ignore"):
            for f in self.features:
                if f not in known:
                    known |= self._group(f, x)
        return np.column_stack([known[n] for n in self.names])

    def _group(self, f: str, x: np.ndarray) -> dict[str, np.ndarray]:
        if f in STATISTICAL:
            return self._statistical(x)
        if f == "sample_entropy":
            return {f: sample_entropies(x, self.m, self.r)}
        if f in COMPLEXITY:
            return self._hjorth(x)
        if f == "mfcc":
            return self._mfcc(x)
        return self._spectral(x)

    @staticmethod
    def _statistical(x: np.ndarray) -> dict[str, np.ndarray]:
        n = x.shape[1]
        mean, std = x.mean(1), x.std(1)
        centred = x - mean[:, None]
        constant = np.ptp(x, axis=1) == 0
        std = np.where(constant, 0.0, std)
        signs = np.abs(np.diff(np.sign(x), axis=1)).sum(1)
        return {
            "mean": mean, "std": std, "var": std ** 2, "rms": np.sqrt((x ** 2).mean(1)), "peak_to_peak": np.ptp(x, axis=1),
            "skewness": _ratio((centred ** 3).mean(1), std ** 3),
            "kurtosis": np.where(std > 0, _ratio((centred ** 4).mean(1), std ** 4) - 3.0, 0.0),
            "zero_crossing_rate": signs / (2.0 * (n - 1)) if n > 1 else np.zeros(len(x)),
            "line_length": np.abs(np.diff(x, axis=1)).sum(1)}

    @staticmethod
    def _hjorth(x: np.ndarray) -> dict[str, np.ndarray]:
        def variance(m: np.ndarray) -> np.ndarray:
            return np.where(np.ptp(m, axis=1) == 0, 0.0, m.var(1)) if m.shape[1] else np.zeros(len(m))

        v0, v1, v2 = variance(x), variance(np.diff(x, axis=1)), variance(np.diff(x, n=2, axis=1))
        mobility = np.sqrt(_ratio(v1, v0))
        return {"hjorth_activity": v0, "hjorth_mobility": mobility, "hjorth_complexity": _ratio(np.sqrt(_ratio(v2, v1)), mobility)}

    def _spectral(self, x: np.ndarray) -> dict[str, np.ndarray]:
        freqs, psd = self.estimate(x, self.fs)
        total = psd.sum(1)
        share = _ratio(psd, total[:, None])
        rising = np.cumsum(psd, axis=1)
        reached = np.argmax(rising >= self.rolloff * rising[:, -1:], axis=1)
        out = {
            "spectral_power": np.trapezoid(psd, freqs, axis=1), "dominant_frequency": freqs[np.argmax(psd, axis=1)],
            "spectral_entropy": np.where(total == 0, 0.0, -(share * np.log(share + 1e-12)).sum(1)),
            "spectral_centroid": _ratio((freqs * psd).sum(1), total), "spectral_rolloff": freqs[reached]}
        for band, (low, high) in self.bands.items():
            inside = (freqs >= low) & (freqs <= high)
            out[f"{band}_power"] = np.trapezoid(psd[:, inside], freqs[inside], axis=1) if inside.any() else np.zeros(len(x))
        return out

    def _mfcc(self, x: np.ndarray) -> dict[str, np.ndarray]:
        import librosa

        means = np.array([librosa.feature.mfcc(y=row, sr=int(self.fs), n_mfcc=self.n_mfcc, hop_length=self.hop).mean(1) for row in x])
        return {f"mfcc_{i}": means[:, i] for i in range(self.n_mfcc)}

    def extract(self, df: DataFrame, signal: str) -> DataFrame:
        """``df`` (without ``signal``) with one double column per feature; one Arrow pass."""
        keep = [c for c in df.columns if c != signal]
        clash = set(keep) & set(self.names)
        if clash:
            raise ValueError(f"columns exist already: {', '.join(sorted(clash))}")
        schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{n}` double" for n in self.names])
        names = self.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(signal)
                size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
                start = np.cumsum(size) - size
                out, null = np.full((len(size), len(names)), np.nan), np.ones(len(size), bool)
                for length in np.unique(size[size > 0]):
                    rows = np.flatnonzero(size == length)
                    x = flat[start[rows][:, None] + np.arange(length)]
                    finite = np.isfinite(x).all(1)
                    if finite.any():
                        out[rows[finite]] = self.matrix(x[finite])
                        null[rows[finite]] = False
                columns = [pa.array(np.ascontiguousarray(out[:, j]), mask=null) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *names])

        return df.select(*keep, signal).mapInArrow(run, schema)


def to_matrix(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    """Feature columns as one array, ready for an estimator."""
    from ..operators.normalize import assemble

    return assemble(df, names, out)
