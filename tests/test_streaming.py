"""State functions of ST1 and ST2: rows over several files, out-of-order, duplicate and missing steps."""

import pandas as pd
import pytest

from kestrel.streaming.jobs import hold_batch_fn, kl_state_fn, stream_step_metrics


class FakeState:
    def __init__(self):
        self.value, self.now, self.timeout, self.hasTimedOut = None, 1000, None, False

    def getCurrentWatermarkMs(self):
        return self.now

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms

    def fire(self, fn):
        """Let the timer pass."""
        self.now, self.timeout, self.hasTimedOut = self.timeout, None, True
        out = list(fn((0,), iter([]), self))
        self.hasTimedOut = False
        return out

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value = v


def batch_coefs(steps, init, target, horizon):
    v, out = init, {}
    for s, kl, n in sorted(steps):
        out[s] = v
        v *= 1 + min(max(kl / target - 1, -0.2), 0.2) * n / horizon
    return out


def test_out_of_order_steps():
    steps = [(s, 0.01 * (s % 4 + 1), 16) for s in range(9)]
    arrivals = [[steps[4], steps[2]], [steps[0], steps[8]], [steps[1], steps[3], steps[2]], [steps[5], steps[6], steps[7]]]
    fn, st, got = kl_state_fn(0.2, 0.02, 50.0), FakeState(), {}
    for chunk in arrivals:
        pdf = pd.DataFrame(chunk, columns=["step", "current_kl", "n_rows"]).assign(_arrived=pd.Timestamp(1, unit="s"))
        for out in fn((0,), iter([pdf]), st):
            for r in out.itertuples(index=False):
                assert r.step not in got          # each step emitted once
                got[r.step] = r.kl_coef
    exp = batch_coefs(steps, 0.2, 0.02, 50.0)
    assert got == pytest.approx(exp)
    assert st.get[0] == 9 and st.get[2] == "[]"   # nothing left buffered


def feed(fn, state, steps):
    pdf = pd.DataFrame(steps, columns=["step", "current_kl", "n_rows"]).assign(_arrived=pd.Timestamp(state.now, unit="ms"))
    return [tuple(r) for out in fn((0,), iter([pdf]), state) for r in out.itertuples(index=False)]


def test_missing_step_is_released_by_the_timer():
    steps = [(s, 0.03, 10) for s in range(8) if s != 2]
    fn, st = kl_state_fn(0.2, 0.02, 50.0, wait_ms=500), FakeState()
    assert [r[1] for r in feed(fn, st, steps[:4])] == [0, 1]
    first = st.timeout
    assert first == 1500
    st.now = 1400
    assert feed(fn, st, steps[4:]) == [] and st.timeout == first  # a gap's time runs from where it opened
    got = [tuple(r) for out in st.fire(fn) for r in out.itertuples(index=False)]
    assert [(r[1], r[3]) for r in got] == [(2, "gap")] + [(s, "step") for s in range(3, 8)]
    assert feed(fn, st, [(2, 0.5, 10), (3, 0.5, 10)]) == [] and st.get[2] == "[]"  # too late
    exp = batch_coefs([s if s[0] < 2 else (s[0] - 1, *s[1:]) for s in steps], 0.2, 0.02, 50.0)  # as if there were no step 2
    assert [r[2] for r in got[1:]] == pytest.approx([exp[s] for s in range(2, 7)])


def test_waiting_steps_are_bounded():
    fn, st = kl_state_fn(0.2, 0.02, 50.0, max_pending=3), FakeState()
    got = [r for s in range(5, 40, 2) for r in feed(fn, st, [(s, 0.01, 5), (None, 0.1, 1)])]
    assert st.get[2].count("[") - 1 <= 3
    assert [r[1] for r in got if r[3] == "step"] == list(range(5, 35, 2))


def test_many_steps_wait_for_earlier_ones():
    steps = [(s, 0.01 * (s % 4 + 1), 16) for s in range(30_000)]
    fn, st = kl_state_fn(0.2, 0.02, 1e6), FakeState()
    got = [r for first in (2, 1, 0) for r in feed(fn, st, steps[first::3])]  # 20,000 wait for step 0
    assert [r[1] for r in got] == list(range(30_000)) and {r[3] for r in got} == {"step"}
    exp = batch_coefs(steps, 0.2, 0.02, 1e6)
    assert [r[2] for r in got] == pytest.approx([exp[s] for s in range(30_000)])
    assert st.get[2] == "[]"


def test_batch_is_held_until_complete_or_late():
    names = ["batch_id", "score", "n_expected"]
    fn, st = hold_batch_fn(names, "n_expected", 100), FakeState()
    put = lambda *scores: [o for o in fn((7,), iter([pd.DataFrame([(7, s, 5) for s in scores], columns=names).assign(_arrived=pd.Timestamp(st.now, unit="ms"))]), st)]
    assert put(1.0, 2.0) == [] and put(None) == []
    (out,) = put(0.1, 5.0)
    assert out.status.tolist() == ["complete"] * 5 and out.score.dropna().tolist() == [1.0, 2.0, 0.1, 5.0]
    assert put(9.0)[0].status.tolist() == ["late"]
    fn, st = hold_batch_fn(names, "n_expected", 100), FakeState()
    put(1.0)
    assert st.fire(fn)[0].status.tolist() == ["partial"]


def test_batch_in_three_files_gives_one_row(spark, tmp_path):
    schema = "batch_id int, uid long, data_source string, score double, n_expected long"
    rows = [(b, u, "s", float(b + u % 3), 9) for b in range(2) for u in range(9)]
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] % 3 == k], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(5, 0, "s", 1.0, 4)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # never complete
    stream_step_metrics(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.batch_id, r.n_rows, r.status) for r in got) == [(0, 9, "complete"), (1, 9, "complete")]
