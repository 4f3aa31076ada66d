"""Digests of streams."""

from millstone.streaming.state import running_digests, windowed_points

__all__ = ["running_digests", "windowed_points"]
