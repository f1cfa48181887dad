"""Parameters as frozen dataclasses; an operator takes the part it needs."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

# Default parameters that results depend on.
BLOCKED_PUBLISHERS = (
    "Electronic Arts", "Ubisoft", "Activision", "Activision Blizzard", "Take-Two Interactive", "Rockstar Games", "2K",
    "Bethesda Softworks", "ZeniMax", "Square Enix", "Capcom", "Sega", "Bandai Namco", "Konami",
    "Sony Interactive Entertainment", "Microsoft Studios", "Xbox Game Studios", "Warner Bros", "Epic Games",
    "Devolver Digital", "CD PROJEKT", "Larian Studios", "Game Science", "PlayStation Publishing", "Sony", "Microsoft",
    "Blizzard", "Amazon Game Studios", "Deep Silver", "Focus Entertainment", "Paradox Interactive", "Techland",
    "Remedy Entertainment", "IO Interactive", "NetEase", "NEXON", "KRAFTON", "Cygames", "Perfect World",
    "Quantic Dream", "Prime Matter", "Valve", "Tencent", "Koei Tecmo", "Embracer", "THQ Nordic", "Riot Games", "Gearbox",
)
SALES_PER_REVIEW = {"niche": (20.0, 27.0, 35.0), "mainstream": (30.0, 37.0, 45.0), "broad_audience": (40.0, 50.0, 65.0)}
GENRE_BUCKETS = {
    "Strategy": "niche", "Simulation": "niche", "Puzzle": "mainstream", "RPG": "mainstream", "Horror": "mainstream",
    "Adventure": "mainstream", "Action": "broad_audience", "Arcade": "broad_audience", "FPS": "broad_audience",
    "Multiplayer": "broad_audience",
}
COMPLEXITY_WEIGHTS = {
    "size_bytes": 0.20, "ram_bytes": 0.10, "early_access_days": 0.05, "maker_titles": 0.15, "simple_label_score": 0.10,
    "complex_label_score": 0.10, "achievement_count": 0.10, "addon_count": 0.10, "platform_count": 0.05, "language_count": 0.05,
}
LOG_BOUNDS = {
    "size_bytes": (8.660244515301235, 10.965681882084198),
    "ram_bytes": (9.301029995881128, 10.204119982683068),
    "maker_titles": (0.0, 0.6020599913279624),
    "achievement_count": (1.1348633964982475, 2.211565253290689),
    "addon_count": (0.0, 1.3424226808222062),
    "language_count": (0.3010299956639812, 1.4313637641589874),
}
SIMPLE_LABELS = ("Pixel Graphics", "2D", "Casual", "Short", "Singleplayer")
COMPLEX_LABELS = ("Open World", "Multiplayer", "Physics", "Procedural Generation")
SOFTWARE_GENRES = (
    "Utilities", "Animation & Modeling", "Design & Illustration", "Audio Production", "Video Production", "Photo Editing",
    "Web Publishing", "Software Training", "Game Development",
)
PLAY_MODES = {"singleplayer_share": "Singleplayer", "multiplayer_share": "Multiplayer", "coop_share": "Co-op"}
MONTH_DAYS = 30.44
STAGES = ("acquisition", "enrichment", "analysis")


@dataclass(frozen=True)
class FilterParams:
    min_reviews: int = 25
    max_reviews: int | None = None
    include_free: bool = True
    max_price: float | None = None
    blocked_publishers: tuple[str, ...] = BLOCKED_PUBLISHERS
    released_from: str | None = "2020-01-01"
    released_to: str | None = None


@dataclass(frozen=True)
class FeatureParams:
    sales_per_review: dict = field(default_factory=lambda: dict(SALES_PER_REVIEW))
    genre_buckets: dict = field(default_factory=lambda: dict(GENRE_BUCKETS))
    default_bucket: str = "mainstream"
    storefront_cut: float = 0.30
    discount: float = 0.0
    refunds: float = 0.0
    weights: dict = field(default_factory=lambda: dict(COMPLEXITY_WEIGHTS))
    bounds: dict = field(default_factory=lambda: dict(LOG_BOUNDS))
    simple_labels: tuple[str, ...] = SIMPLE_LABELS
    complex_labels: tuple[str, ...] = COMPLEX_LABELS
    software_genres: tuple[str, ...] = SOFTWARE_GENRES
    epsilon: float = 0.05
    most_missing: float = 0.4
    max_labels: int = 20
    min_votes: int = 0
    handheld_key_ending: str = "deck_compat"

    def __post_init__(self):
        if abs(sum(self.weights.values()) - 1) > 1e-9 or min(self.weights.values()) < 0:
            raise ValueError("complexity weights are at least 0 and sum to 1")
        if any(not lo <= mid <= hi for lo, mid, hi in self.sales_per_review.values()):
            raise ValueError("sales bands are low, mid, high in order")
        if not 0 <= self.storefront_cut < 1:
            raise ValueError("storefront_cut is in [0, 1)")

    def with_weights(self, **changes: float) -> "FeatureParams":
        """Some weights replaced, all rescaled to sum 1."""
        merged = self.weights | changes
        return dataclasses.replace(self, weights={k: v / sum(merged.values()) for k, v in merged.items()})


@dataclass(frozen=True)
class AnalysisParams:
    simple_quantile: float = 0.40
    distance_threshold: float | None = 0.9366572311889352
    linkage: str = "average"
    window_months: int = 48
    min_cluster_size: int = 5
    min_votes: int = 0
    max_labels: int = 20
    generic_share: float = 0.15
    max_cluster_share: float = 0.15
    demand: float = 0.40
    competition: float = 0.30
    simplicity: float = 0.30

    def __post_init__(self):
        if self.linkage not in ("single", "complete", "average", "weighted"):
            raise ValueError("linkage is single, complete, average or weighted")
        if abs(self.demand + self.competition + self.simplicity - 1) > 1e-9:
            raise ValueError("opportunity weights sum to 1")
        if not 0 < self.simple_quantile <= 1:
            raise ValueError("simple_quantile is in (0, 1]")


def canonical(params) -> str:
    """The parameters as JSON with sorted keys: what their version is a hash of."""
    return json.dumps(dataclasses.asdict(params), sort_keys=True, separators=(",", ":"))
