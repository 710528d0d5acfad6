"""States of a verification job."""

from __future__ import annotations

from enum import StrEnum


class State(StrEnum):
    # The names that job documents hold.
    CREATED = "CREATED"
    VALIDATING_CONFIG = "VALIDATING_CONFIG"
    CONNECTING_SOURCE = "CONNECTING_SOURCE"
    CONNECTING_TARGET = "CONNECTING_TARGET"
    SAMPLING_QUERIES = "SAMPLING_QUERIES"
    COLLECTING_SOURCE_RESULTS = "COLLECTING_SOURCE_RESULTS"
    COLLECTING_TARGET_RESULTS = "COLLECTING_TARGET_RESULTS"
    RUNNING_FINGERPRINT_ENGINE = "RUNNING_FINGERPRINT_ENGINE"
    GENERATING_REPORT = "GENERATING_REPORT"
    SUCCEEDED = "SUCCEEDED"
    FAILED = "FAILED"
    CANCELED = "CANCELED"

    @property
    def terminal(self) -> bool:
        return self in (State.SUCCEEDED, State.FAILED, State.CANCELED)


def parse(name: str) -> State:
    """ValueError for names that are no state."""
    return State(name)
