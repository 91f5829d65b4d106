"""The one error type raised when an analysis would not mean what it says."""

from __future__ import annotations


class AnalysisRefused(ValueError):
    """Raised instead of returning a number that would be misread.

    ``reason`` is a stable short name that tests and callers can match on;
    ``counts`` carries the measured quantities behind the refusal.
    """

    def __init__(self, reason: str, message: str, **counts: object) -> None:
        detail = ", ".join(f"{k}={v}" for k, v in sorted(counts.items()))
        super().__init__(f"{reason}: {message}" + (f" [{detail}]" if detail else ""))
        self.reason = reason
        self.counts = counts


def refuse_if(condition: bool, reason: str, message: str, **counts: object) -> None:
    if condition:
        raise AnalysisRefused(reason, message, **counts)
