"""The rating flow."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clipsieve.config import ScoringConfig
from clipsieve.operators import rating as R


def rate(
    signals: R.Signals,
    cfg: ScoringConfig,
    model: DataFrame | None = None,
    judgments: DataFrame | None = None,
) -> DataFrame:
    """Signals to ranked candidates; an optional learned model re-scores, judgments attach by id."""
    if cfg.transcript_mode == "off":
        signals = R.Signals(**{**signals.__dict__, "transcript_hits": None})
    ranked = R.ranked_candidates(signals, cfg)
    if model is not None:
        from clipsieve.operators.learning import apply_learned

        ranked = apply_learned(ranked, model, cfg)
    if judgments is not None:
        ranked = ranked.join(judgments, "id", "left")
    return ranked
