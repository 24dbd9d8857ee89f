"""Default settings of the panel operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PanelConfig:
    # Windows, horizons, folds, portfolio sizes and penalty grids.
    feature_windows: tuple[int, ...] = (3, 5, 10, 20)
    feature_preset: str = "alpha_v1"
    future_buy_offset: int = 1
    future_sell_offset: int = 5
    validation_ratio: float = 0.1
    min_train_groups: int = 252
    inner_min_train_groups: int = 126
    outer_folds: int = 4
    inner_folds: int = 3
    purge_groups: int = 5
    rebalance_stride: int = 5
    label_buckets: int = 10
    label_clip_quantile: float = 0.0
    head_quantile: float = 0.0
    head_weight: float = 1.0
    noise_std: float = 0.01
    noise_fraction: float = 0.3
    target_clip_quantile: float = 0.02
    seed: int = 42
    overlay_feature: str = "volume_ratio_20"
    overlay_weight: float = 0.7
    top_k: int = 5
    candidate_pool: int = 15
    covariance_window: int = 60
    position_weight: float = 0.2
    max_positions: int = 5
    weight_upper_bound: float = 1.0
    weight_shrinkage: float = 0.5
    weight_cap: float = 0.5
    variance_penalties: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0)
    correlation_penalties: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5)
    cvar_penalties: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0)
    # Largest group (one date, one fold ...) that a single window task may hold.
    max_group_rows: int = 2_000_000

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= self.max_positions:
            raise ValueError(f"top_k must lie between 1 and {self.max_positions}: {self.top_k}")


DEFAULTS = PanelConfig()
