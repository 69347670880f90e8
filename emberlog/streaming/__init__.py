"""Structured Streaming forms of the operators: sources, windowed totals, encounters, cooldowns, joins."""

from emberlog.streaming.jobs import closed_encounters, cooldown, first_fragments, level_ups, message_stream, parsed, rolling_totals, seen_messages

__all__ = ["closed_encounters", "cooldown", "first_fragments", "level_ups", "message_stream", "parsed", "rolling_totals", "seen_messages"]
