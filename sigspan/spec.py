"""Segment specification: every constant that defines the semantics of a stage.

A ``SegmentSpec`` is passed to every operator instead of literals spread over the
code, so the same functions serve the documented full-size defaults and the small
presets used by tests and oracle checks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class BinSpec:
    """Overlapped bins over a coefficient array: bin i = sum(|c[i*hop : i*hop+width]|) / divisor."""

    n_bins: int
    hop: int
    width: int
    divisor: float

    @property
    def span(self) -> int:
        """Number of coefficients the bins cover."""
        return (self.n_bins - 1) * self.hop + self.width


@dataclass(frozen=True)
class SegmentSpec:
    length: int  # samples per segment (L)
    slice_len: int  # samples per slice step (s); slices = length / slice_len
    dct_keep: int  # coefficients kept after the segment DCT
    bins: BinSpec
    win_dct_keep: int | None = None  # coefficients kept after each window DCT
    win_bins: BinSpec | None = None
    bucket: int = 1000  # stat bucket width B, bucket = int(no / B)
    band_start: int = 50  # first bin of the kept band
    band_size: int = 26  # bins in the kept band
    stride: int = 2  # training stride over the band
    win_slices: int = 3  # consecutive slices per sliding window
    boundary: str = "inclusive"  # "inclusive": no BETWEEN i*s AND (i+1)*s ; "strict": (i*s, (i+1)*s]

    def __post_init__(self):
        if self.length % self.slice_len:
            raise ValueError("segment length must be a multiple of the slice length")
        if self.boundary not in ("inclusive", "strict"):
            raise ValueError("boundary must be 'inclusive' or 'strict'")
        if self.bins.span > self.dct_keep:
            raise ValueError("segment bins reach past the kept coefficients")
        if self.win_bins is not None and self.win_dct_keep is not None and self.win_bins.span > self.win_dct_keep:
            raise ValueError("window bins reach past the kept window coefficients")
        if self.band_start + self.band_size > self.bins.n_bins:
            raise ValueError("band reaches past the last bin")

    @property
    def n_slices(self) -> int:
        return self.length // self.slice_len

    @property
    def n_windows(self) -> int:
        return self.n_slices - self.win_slices + 1

    @property
    def vector_len(self) -> int:
        """Length of a complete segment vector (inclusive slices repeat inner boundaries)."""
        extra = self.n_slices - 1 if self.boundary == "inclusive" else 0
        return self.length + extra

    @property
    def window_label_positions(self) -> list[int]:
        """Position ``no`` of the last sample of every sliding window."""
        return [(j + self.win_slices) * self.slice_len for j in range(self.n_windows)]

    @property
    def n_features(self) -> int:
        return len(range(0, self.band_size, self.stride))

    def with_(self, **kw) -> "SegmentSpec":
        return replace(self, **kw)


# The documented full-size defaults of the reference pipeline
# (segment 150000 samples, 10 slices of 15000, DCT kept 40000, bins 99/400/800/800,
# window DCT kept 12000, window bins 99/120/240/120, stat bucket 1000, band 50..75, stride 2).
REFERENCE = SegmentSpec(
    length=150_000,
    slice_len=15_000,
    dct_keep=40_000,
    bins=BinSpec(99, 400, 800, 800.0),
    win_dct_keep=12_000,
    win_bins=BinSpec(99, 120, 240, 120.0),
    bucket=1000,
)

# Small presets that keep the shapes 99 -> 26 -> 13 and 8 x 26 = 208.
TEST = SegmentSpec(
    length=1000,
    slice_len=100,
    dct_keep=200,
    bins=BinSpec(99, 2, 4, 4.0),
    win_dct_keep=100,
    win_bins=BinSpec(99, 1, 2, 1.0),
    bucket=50,
)
SMOKE = SegmentSpec(
    length=100,
    slice_len=10,
    dct_keep=100,
    bins=BinSpec(99, 1, 2, 2.0),
    bucket=10,
)
TAIL = SegmentSpec(
    length=900,
    slice_len=90,
    dct_keep=200,
    bins=BinSpec(99, 2, 4, 4.0),
    win_dct_keep=100,
    win_bins=BinSpec(99, 1, 2, 1.0),
    bucket=50,
)

# Wide rows on small tables: segments of 50 000 samples (bench only; same shapes scaled down by 3).
LONG = SegmentSpec(
    length=50_000,
    slice_len=5_000,
    dct_keep=20_000,
    bins=BinSpec(99, 200, 400, 400.0),
    win_dct_keep=6_000,
    win_bins=BinSpec(99, 60, 120, 60.0),
    bucket=1000,
)

PRESETS = {"REFERENCE": REFERENCE, "TEST": TEST, "SMOKE": SMOKE, "TAIL": TAIL, "LONG": LONG}
