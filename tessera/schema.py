"""Thresholds that are part of the semantics, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Fixed values; results depend on each of them."""

    distinctive_size: int = 4
    contested_margin: float = 0.15
    probable_votes: int = 2
    full_votes: int = 3
    least_confidence: float = 0.5
    rounds: int = 100
    bridge: int = 512
    code_sections: tuple[str, ...] = (".text", ".init")
    literal_least: int = 6
    literal_most: int = 128
    size_ratio: float = 2.5
    exact_percent: float = 99.0
    body_percent: float = 70.0
    body_margin: float = 15.0
    confident_percent: float = 80.0
    confident_margin: float = 30.0
    suspect_ratio: float = 2.0
    shingle: int = 4
    shingle_least: int = 8
    length_low: float = 0.6
    length_high: float = 1.6
    similarity: float = 0.6
    lead: float = 0.1
    same_name: float = 0.9
    stunted: float = 0.5
    padding: int = 31
    sequence_functions: int = 4
    sequence_match: float = 0.75
    sequence_order: float = 0.9
    sequence_bytes: int = 512
    sequence_cover: float = 0.4
    sequence_strong: int = 2
    sequence_anchors: int = 2
    sequence_anchor: int = 16
    sequence_margin: float = 0.1
    layout_functions: int = 4
    layout_bytes: int = 1024
    layout_changed: int = 16
    layout_size: float = 0.02
    layout_count: int = 1
    shift_functions: int = 2
    shift_bytes: int = 128
    shift_changed: int = 4
    joint_units: int = 6
    joint_functions: int = 40
    joint_reach: int = 3


THRESHOLDS = Thresholds()
