"""Session ends: what reaches Spark's state."""

from pyspark.sql import Row

from csilake.streaming import timed


class State:
    """Counts the calls that reach Spark."""

    def __init__(self, value=None):
        self.value, self.calls = value, []

    def __getattr__(self, name):
        return lambda *a: self.calls.append(name)

    def get(self):
        self.calls.append("get")
        return self.value


def test_a_device_without_change_calls_the_state_once():
    processor = timed.SessionEnds()
    row = lambda at, number=None, n=None: Row(at=at, is_packet=number is None, session_id=number, n=n)
    for before, rows, ended, calls in (
        (None, [row(5), row(9)], [], ["get"]),
        (None, [row(3_000_000), row(1_000_000, 4, 1), row(1_500_000)], [(4, 1)], ["get"]),
        ((4, 0, 9_000_000, 2), [row(9_000_001)], [(4, 2)], ["get", "deleteTimer", "clear"]),
        ((4, 0, 9_000_000, 2), [row(8)], [], ["get", "update"]),
        (None, [row(8), row(9, 5, 1), row(None, 6, 1), row(None)], [], ["get", "registerTimer", "update"]),
    ):
        processor.running = processor.handle = State(before)
        assert [(r.session_id, r.packets) for r in processor.handleInputRows((1,), iter(rows), None)] == ended
        assert processor.running.calls == calls
