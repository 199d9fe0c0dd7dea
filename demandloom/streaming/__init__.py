"""Structured Streaming jobs. They reuse the batch operators on every micro-batch."""

from demandloom.streaming.jobs import (
    event_projection,
    stream_champion_scoring,
    stream_dead_letter,
    stream_materialize,
)

__all__ = [
    "event_projection",
    "stream_champion_scoring",
    "stream_dead_letter",
    "stream_materialize",
]
