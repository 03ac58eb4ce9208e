"""Route-suggestion settings: times in milliseconds, distances in metres."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    max_detour_minutes: float = 15.0
    start_cluster_radius: int = 4000
    start_walking_distance: int = 400
    end_cluster_radius: int = 4000
    end_walking_distance: int = 400
    time_allowance: int = 1_800_000
    similarity_limit: float = 0.3
    dwell: int = 60_000
    suboptimal_allowance: int = 60_000
    include_anonymous: bool = True
    match_days: bool = True
    created_since: int = 0
    min_requests: int = 15
    top_ods: int = 5
    replicas: int = 10

    @property
    def budget(self) -> float:
        return self.max_detour_minutes * 60_000


SCHEDULING_OPTIMISM = 180_000
RETRIGGER_MS = 20_000
NEW_ROUTE_REGRET = 300_000
MAX_INSERTION_DETOUR = 120_000
#: Extra milliseconds by kind of turn.
TURN_COSTS = {"left": 5_000, "sharp_left": 5_000, "right": 30_000, "sharp_right": 20_000}
HEADING_PENALTY = 600_000
