"""One trustworthy row per person from several reporting channels, on Spark."""

from monofila.rules import Rules

__all__ = ["Rules"]
