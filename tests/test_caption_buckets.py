"""Stems of a bucket share a call, a state and a timer of the caption stream."""

import pandas as pd

from tagweave.streaming import incremental

COLUMNS = ["kind", "stem", "image_path", "context_tags", "attempt", "at"]


class State:
    """Keyed state in memory, with what a call asked for."""

    def __init__(self, now=0):
        self.now, self.value, self.timer, self.hasTimedOut = now, None, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.value = value

    def setTimeoutDuration(self, wait):
        assert wait > 0
        self.timer = self.now + wait


def call(state, now, rows=None, wait=100, most=3):
    """One call with new rows, or for the timer; returns (stem, path, attempt, problem) of what comes out."""
    state.now, state.timer, state.hasTimedOut = now, None, rows is None
    frames = iter([pd.DataFrame(rows or [], columns=COLUMNS)])
    out = [row for frame in incremental._due(wait, most)((5,), frames, state) for row in frame.itertuples(index=False)]
    return sorted((r.stem or "", r.image_path, r.attempt, r.problem) for r in out)


def asked(stem, path="p", tags=("t",)):
    return ("request", stem, path, list(tags), None, None)


def failed(stem, attempt, at):
    return ("failure", stem, None, None, attempt, at)


def test_stems_of_a_bucket_are_told_apart():
    state = State()
    tick = ("tick", None, None, None, None, None)
    rows = [tick, asked("a"), asked("b", "q"), asked("a"), asked(None), asked("d"), asked("d", "other")]
    differ = "repeated stem with different requests"
    assert call(state, 0, rows) == [("", "p", 0, "no stem"), ("a", "p", 1, None), ("b", "q", 1, None), ("d", "other", 0, differ), ("d", "p", 0, differ)]
    assert call(state, 1, [asked("a"), tick]) == [] and state.timer is None


def test_one_timer_serves_every_stem():
    state = State()
    call(state, 0, [asked("a", "p"), asked("b", "q"), asked("c", "r")])
    assert call(state, 10, [failed("a", 1, 10), failed("b", 1, 60)]) == [] and state.timer == 110
    # a call for other stems sets the timer again
    assert call(state, 50, [asked("e", "s")]) == [("e", "s", 1, None)] and state.timer == 110
    assert call(state, 120) == [("a", "p", 2, None)] and state.timer == 160
    # a failure of an earlier attempt changes nothing; the second wait is twice as long
    assert call(state, 130, [failed("a", 1, 125), failed("a", 2, 130)]) == [] and state.timer == 160
    # what is due comes out in any call; a request that comes again is tried at once
    assert call(state, 200, [asked("a", "new", [])]) == [("a", "new", 3, None), ("b", "q", 2, None)] and state.timer is None
    # the last attempt
    assert call(state, 300, [failed("a", 3, 300)]) == [] and state.timer is None


def test_what_is_due_at_once_is_asked_in_the_same_call():
    state = State()
    call(state, 0, [asked("a"), asked("b")], wait=0)
    assert call(state, 5, [failed("a", 1, 5), asked("a")], wait=0) == [("a", "p", 2, None)] and state.timer is None
