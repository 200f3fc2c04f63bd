"""A session's state is read and written once a call, however many events come."""

from pyspark.sql import Row

from inkfathom.streaming import sessions


class Told:
    def __init__(self, calls):
        self.calls = calls

    def __getattr__(self, name):
        return lambda *_: self.calls.append(name)


def test_few_round_trips():
    calls = []
    s = sessions.Sessions(1000)
    s.handle, s.meta, s.asked, s.answers = (Told(calls) for _ in range(4))
    event = Row("ms", "kind", "user_id", "text", "sections")
    rows = [event(i, "query" if i % 2 == 0 else "answer", "u", f"t{i}", ["x"]) for i in range(100)] + [event(2000, "query", "u", "late", None)]
    got = list(s.handleInputRows(("a",), iter(rows), None))
    assert [r.event for r in got] == ["query", "answer"] * 50 + ["expired", "query"]
    assert got[99].asked == "t98" and got[99].citations == "1:x" and got[99].turn == 50 and got[101].turn == 1
    assert sorted(calls) == ["appendList", "get", "registerTimer", "update"]
