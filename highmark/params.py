"""Constants of the ranking. They are the defaults of the operators' parameters."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # Fixed values that results depend on.
    weights: dict[str, float] = field(default_factory=lambda: {"llm": 0.45, "replay": 0.25, "audio": 0.20, "chapter": 0.10})
    pad: float = 0.3
    peak_lead: float = 5.0
    peak_lead_most: float = 20.0
    peak_tail: float = 5.0
    longest_clip: float = 180.0
    text_similarity: float = 0.6
    words_per_cue: int = 3
    chunk_seconds: float = 1200.0
    chunk_overlap: float = 60.0
    long_video: float = 1800.0
    peak_threshold: float = 0.6
    merge_gap: float = 1e-6
    snap_tolerance: float = 0.05
    least_gap: float = 1.0
    topic_block: float = 30.0
    overlap_share: float = 0.5
    crop_bins: int = 12
    shortest_crop: float = 1.0
    clips: int = 3


DEFAULTS = Params()
