"""Scoring parameters of one run."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Defaults of a run.
DEFAULT_WEIGHTS = {
    "technical": 20,
    "visual": 25,
    "audio": 35,
    "transcript": 20,
    "objects": 10,
    "ocr": 8,
    "face_person": 6,
    "motorsports": 12,
    "topics": 10,
    "ai": 10,
}
DEFAULT_OBJECT_CLASSES = (
    "person", "car", "truck", "motorcycle", "bicycle", "bus", "traffic light", "stop sign",
)
DEFAULT_KEYWORDS = (
    "wow", "amazing", "pass", "passed", "overtake", "incident", "crash", "spin", "fast",
    "lap", "start", "finish", "checkered", "problem", "issue", "win", "podium",
)


# The limits of a short report.
SHORT_REPORT = {"max_candidates": 50, "label_classes": 4, "shown_names": 6}


@dataclass(frozen=True)
class ScoringConfig:
    """Takes everything by default.

    ``max_candidates`` keeps the best windows, ``label_classes`` the first object classes as labels of a window, ``shown_names``
    the first names in each reason.
    """

    audio_spike_percentile: float = 85.0
    audio_spike_floor_db: float = -35.0
    silence_threshold_db: float = -30.0
    min_silence_duration: float = 1.0
    scene_threshold: float = 0.35
    window_pre_roll: float = 3.0
    window_post_roll: float = 9.0
    object_window_pre_roll: float = 1.0
    object_window_post_roll: float = 2.0
    merge_gap: float = 4.0
    max_candidates: int | None = None
    label_classes: int | None = None
    shown_names: int | None = None
    min_select_score: int = 85
    min_review_score: int = 70
    min_broll_score: int = 55
    transcript_mode: str = "auto"
    object_interest_classes: tuple[str, ...] = DEFAULT_OBJECT_CLASSES
    keywords: tuple[str, ...] = DEFAULT_KEYWORDS
    weights: dict[str, int] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))

    def __post_init__(self):
        # The island form of the merge equals the sequential merge only for gaps >= 0.
        if self.merge_gap < 0:
            raise ValueError("merge_gap must be >= 0")

    def weight(self, name: str) -> float:
        return float(self.weights.get(name, DEFAULT_WEIGHTS[name]))

    def with_(self, **changes) -> "ScoringConfig":
        return replace(self, **changes)
