"""Job options and their range checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import schemas


def _positive(**values: float) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name}={value}: a value above 0 is needed")


def _open_unit(**values: float) -> None:
    for name, value in values.items():
        if not 0.0 < value < 1.0:
            raise ValueError(f"{name}={value}: a share above 0 and below 1 is needed")


def _one_of(allowed: tuple[str, ...], **values: str) -> None:
    for name, value in values.items():
        if value not in allowed:
            raise ValueError(f"{name}={value!r}: {' or '.join(allowed)}")


@dataclass
class FeatureOptions:
    """Options of the feature job."""

    enabled: bool = True
    site_id: str = ""  # empty: all sites
    rolling_window_days: int = 7
    lookback_days: int = 30
    tou_peak_hours: tuple[int, int] = (16, 21)
    tou_shoulder_hours: list[tuple[int, int]] = field(
        default_factory=lambda: [(7, 16), (21, 22)]
    )
    # Columns that tell one series from another; [] mixes all devices.
    partition_cols: list[str] = field(default_factory=lambda: list(schemas.SERIES))
    # Column giving the arrival order of duplicate readings, if there is one.
    order_col: str | None = None
    # "exact": windows by each series' median interval; "classes": by the usual interval next to it.
    intervals: str = "exact"

    def validate(self) -> None:
        _one_of(("exact", "classes"), intervals=self.intervals)
        _positive(
            rolling_window_days=self.rolling_window_days,
            lookback_days=self.lookback_days,
        )


@dataclass
class ForecastOptions:
    """Options of the tabular forecast."""

    enabled: bool = True
    site_id: str = ""
    test_size: float = 0.2
    seed: int = 42
    horizon_hours: int = 24
    target_mae_percent: float = 10.0
    n_estimators: int = 100
    max_depth: int = 6
    learning_rate: float = 0.1
    min_samples_leaf: int = 5
    min_rows: int = 100
    rolling_window_days: int = 7
    partition_cols: list[str] = field(default_factory=lambda: list(schemas.SERIES))
    # The horizon in rows, by each series' median interval or by the usual one next to it.
    intervals: str = "exact"

    def validate(self) -> None:
        _one_of(("exact", "classes"), intervals=self.intervals)
        _open_unit(test_size=self.test_size)
        _positive(
            horizon_hours=self.horizon_hours,
            target_mae_percent=self.target_mae_percent,
            n_estimators=self.n_estimators,
            max_depth=self.max_depth,
            learning_rate=self.learning_rate,
        )


@dataclass
class SequenceOptions(ForecastOptions):
    """Options of the sequence forecast."""

    target_mae_percent: float = 5.0
    sequence_length: int = 288
    validation_split: float = 0.15
    # Boosting rounds without a lower validation loss, after which training stops.
    patience: int = 10
    scale_features: bool = True
    # "train": means and deviations of the training rows; "all": of every row.
    fit_scaler_on: str = "train"
    # Rows from one training run to the next; none: every run is used.
    stride: int | None = None
    regressor: str = "gbt"  # or "linear"
    reg_param: float = 0.01  # of the linear one

    @property
    def rows_between_runs(self) -> int:
        return 1 if self.stride is None else self.stride

    def validate(self) -> None:
        super().validate()
        _positive(
            sequence_length=self.sequence_length,
            stride=self.rows_between_runs,
            patience=self.patience,
        )
        _open_unit(validation_split=self.validation_split)
        _one_of(("train", "all"), fit_scaler_on=self.fit_scaler_on)
        _one_of(("gbt", "linear"), regressor=self.regressor)


@dataclass
class SyncOptions:
    """Options of the snapshot-to-readings sync."""

    enabled: bool = True
    site_id: str = "edge-gateway-site"
    sync_interval_seconds: int = 60
    batch_size: int = 100  # rows per series in a batch-mode scan
    lookback_hours: int = 24  # reach of the first batch-mode scan
    max_files_per_trigger: int = 1000

    def validate(self) -> None:
        _positive(
            sync_interval_seconds=self.sync_interval_seconds,
            batch_size=self.batch_size,
            lookback_hours=self.lookback_hours,
            max_files_per_trigger=self.max_files_per_trigger,
        )
