"""Streaming forms of the stages."""

from .streams import absorb, first_seen, learn, prune_and_weigh, windowed_edges

__all__ = ["absorb", "first_seen", "learn", "prune_and_weigh", "windowed_edges"]
