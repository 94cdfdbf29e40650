"""Short-time spectra in Arrow batches: there is no Fourier transform among the built-ins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def hann(length: int) -> np.ndarray:
    """Symmetric window; ones for a length of 1 or less."""
    return np.ones(max(length, 1)) if length <= 1 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / (length - 1))


def scale(n_fft: int = 256, win: int | None = None, hop: int | None = None) -> tuple[int, int, int]:
    """n_fft, window and hop of one scale: the window is n_fft long at most and by default, the hop a quarter of it."""
    n_fft = max(1, n_fft)
    win = min(max(1, win or n_fft), n_fft)
    return n_fft, win, max(1, hop or win // 4)


def _logmag(x: np.ndarray, n_fft: int, win: int, hop: int) -> np.ndarray:
    """The log spectra of the rows of ``x``, signals of one length, as rows of frames times bins."""
    x = np.pad(x, ((0, 0), (0, max(0, win - x.shape[1]))))
    frames = np.lib.stride_tricks.sliding_window_view(x, win, axis=1)[:, ::hop]
    return np.log1p(np.abs(np.fft.rfft(frames * hann(win), n_fft))).reshape(len(x), -1)


def _by_length(arrays: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the batch by the length of their signal: their places and their signals as one matrix."""
    lengths, starts = arrays.value_lengths().to_numpy(zero_copy_only=False), arrays.offsets.to_numpy()[:-1]
    values = arrays.values.to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, values[starts[at][:, None] + np.arange(n)]


def ms_stft_l1(rows: DataFrame, y: str, z: str, scales: list[tuple[int, int, int]], name: str = "l1") -> DataFrame:
    """``rows`` without the signals ``y`` and ``z``, of one length each row, but with the loss between them as ``name``.

    The loss is the mean over ``scales`` (as `scale` gives them) of the mean absolute difference of the log spectra. It is a
    step of its own on whole Arrow batches: a Python function over columns would be merged with the array lambdas that made
    them, which can't be evaluated.
    """
    if not scales:
        raise ValueError("no scale is given")
    keys = [f for f in rows.schema if f.name not in (y, z)]

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, other = np.zeros(batch.num_rows), batch.column(z)
            for (at, first), (_, second) in zip(_by_length(batch.column(y)), _by_length(other), strict=True):
                out[at] = sum(np.abs(_logmag(first, *s) - _logmag(second, *s)).mean(1) for s in scales) / len(scales)
            columns = [batch.column(f.name) for f in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out)], names=[*(f.name for f in keys), name])

    return rows.mapInArrow(losses, StructType([*keys, StructField(name, DoubleType())]))


def stft_l1(rows: DataFrame, y: str, z: str, n_fft: int, win: int, hop: int, name: str = "l1") -> DataFrame:
    """The same at one scale."""
    return ms_stft_l1(rows, y, z, [(n_fft, win, hop)], name)


def stft_logmag(n_fft: int, hop: int, win: int):
    """A Pandas UDF from a signal, a column that no array lambda made, to log(1 + |spectrum|), frame after frame."""

    @F.pandas_udf("array<double>")
    def logmag(signals: pd.Series) -> pd.Series:
        return signals.map(lambda x: _logmag(np.asarray(x, float)[None], n_fft, win, hop)[0])

    return logmag
