"""Query parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    player: str = "You"
    timeout_s: float = 12.0
    prefight_s: float = 20.0
    prefight_rows: int = 20
    death_dedup_s: float = 30.0
    rate_window_s: int = 3600
    cohort: int = 3


#: The event table that every operator takes and gives: order is arrival, ``seq`` within ``stream_id``.
EVENT_SCHEMA = (
    "stream_id string, seq long, ts double, kind string, text string, actor string, target string, amount long, skill string, "
    "dtype string, outcome string, raw_actor string, absorbed long, blocked long, weapon string, is_pet boolean, "
    "estimated boolean, estimated_ts boolean, item string, copper long, split_copper long"
)

# Kinds by role.
DAMAGE = ("melee_hit", "ability_hit")
ACTIVITY = ("melee_hit", "ability_hit", "melee_miss")
PREFIGHT = ("cast", "debuff", "damage_effect", "cc", "interrupt", "status", "aggro")
MISS = ("melee_miss", "ability_miss", "resist", "fizzle")
EDGE = ("melee_hit", "melee_miss", "ability_hit")
