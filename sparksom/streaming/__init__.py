"""Scoring of streams with a trained map."""
from .scorer import running_transitions, score_stream

__all__ = ["score_stream", "running_transitions"]
