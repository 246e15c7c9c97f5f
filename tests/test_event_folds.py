"""The folds alone, against a row-at-a-time check."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from monofila.operators.events import accept, lock_exit, lock_out, lock_steps
from monofila.streaming.guards import accept_late


def slow_accept(times, limit, window):
    taken, out = [], []
    for t in times:
        live = [a for a in taken if t - a < window]
        out.append(int(len(live) < limit))
        if out[-1]:
            taken.append(t)
    return out


def slow_lock(times, fails, failures, duration):
    streak, until, out = 0, 0, []
    for t, f in zip(times, fails):
        if until > t:
            out.append("refused")
        elif not f:
            streak = 0
            out.append("ok")
        elif streak + 1 >= failures:
            streak, until = 0, t + duration
            out.append("lock")
        else:
            streak += 1
            out.append("fail")
    return out


def in_pieces(fold, times, marks, cuts):
    out, state = [], []
    edges = sorted({0, len(times), *[c % (len(times) + 1) for c in cuts]})
    for a, b in zip(edges, edges[1:]):
        part, state = fold(times[a:b], marks[a:b], state)
        out += part.tolist()
    return out


gaps = st.lists(st.integers(0, 12), min_size=1, max_size=60)


@settings(max_examples=400, deadline=None)
@given(gaps, st.lists(st.integers(0, 100), max_size=4), st.integers(1, 4), st.integers(1, 30))
def test_accept(steps, cuts, limit, window):
    times = np.cumsum(steps) + 1
    marks = np.zeros(len(times), dtype=bool)
    got = in_pieces(lambda t, m, s: accept(t, m, s, limit, window), times, marks, cuts)
    assert got == slow_accept(times.tolist(), limit, window)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.integers(0, 80), min_size=1, max_size=15), min_size=1, max_size=5), st.integers(1, 4), st.integers(1, 30))
def test_accept_late_judges_rows_older_than_the_ones_before(pieces, limit, window):
    got, state = [], []
    for piece in pieces:
        times = np.array(sorted(piece))
        taken, state = accept_late(times, np.zeros(len(times), dtype=bool), state, limit, window)
        got += taken.tolist()
    assert got == slow_accept([t for piece in pieces for t in sorted(piece)], limit, window)


@settings(max_examples=600, deadline=None)
@given(gaps, st.data(), st.lists(st.integers(0, 100), max_size=4), st.integers(1, 5), st.integers(1, 30))
def test_lock_out(steps, data, cuts, failures, duration):
    times = np.cumsum(steps) + 1
    fails = np.array(data.draw(st.lists(st.sampled_from([True, True, True, False]), min_size=len(times), max_size=len(times))))
    got = in_pieces(lambda t, m, s: lock_out(t, m, s, failures, duration), times, fails, cuts)
    assert got == slow_lock(times.tolist(), fails.tolist(), failures, duration)


def test_fifth_failure_locks_and_the_lock_ends_on_time():
    times = np.array([0, 1, 2, 3, 4, 5, 903, 904]) * 1_000_000 + 1
    fails = np.array([True] * 5 + [False, False, False])
    out, state = lock_out(times, fails, [], 5, 900_000_000)
    assert out.tolist() == ["fail"] * 4 + ["lock", "refused", "refused", "ok"]
    assert state == []


def test_fourth_event_in_the_window_is_refused_and_does_not_extend_it():
    minute = 60_000_000
    times = np.array([0, 1, 2, 3, 14, 15]) * minute
    out, _ = accept(times, np.zeros(6, dtype=bool), [], 3, 15 * minute)
    assert out.tolist() == [1, 1, 1, 0, 0, 1]


@settings(max_examples=600, deadline=None)
@given(gaps, st.data(), st.integers(1, 5), st.integers(1, 30))
def test_a_course_tells_the_exit_of_every_entry(steps, data, failures, duration):
    times = np.cumsum(steps) + 100
    fails = np.array(data.draw(st.lists(st.sampled_from([True, True, True, False]), min_size=len(times), max_size=len(times))))
    course = lock_steps(times, fails, failures, duration)
    # A lock from before the chunk ends no later than ``duration`` after its first attempt.
    ends = range(int(times[0]) - 1, int(times[0]) + duration + 1)
    for entry in [[], *([n, 0] for n in range(1, failures)), *([0, t] for t in ends)]:
        assert lock_exit(course, entry) == lock_out(times, fails, entry, failures, duration)[1]
