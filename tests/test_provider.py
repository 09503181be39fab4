"""Client calls that fail, hang or are slow, and requests that are cancelled."""

import threading
import time
import types

import pytest

from lexmill.operators import strategies
from lexmill.operators.provider import retried_embedding, with_retries
from lexmill.plans import lifecycle


def made():
    """A client as a local function, which is sent to the workers by value."""

    def client(text):
        import time

        if text == "hang":
            time.sleep(60)
        if text == "fail":
            raise ValueError("no")
        time.sleep(0.2)
        return text.upper()

    return client


def test_hanging_and_failing_calls_are_error_records(spark):
    rows = [("ok",), ("hang",), ("fail",), (None,), ("",)]
    began = time.time()
    got = {r.t: r.a for r in with_retries(made(), attempts=2, wait=0.01, timeout=1.0)(spark.createDataFrame(rows, "t string").coalesce(1), "t", "a").collect()}
    assert time.time() - began < 30
    assert (got["ok"].out, got["ok"].error, got["ok"].attempts) == ("OK", "", 1) and got[""].out == ""
    assert (got["hang"].out, got["hang"].error, got["hang"].attempts) == (None, "[ERROR] no answer within 1 s", 2)
    assert (got["fail"].out, got["fail"].error, got["fail"].attempts) == (None, "[ERROR] no", 2)
    assert (got[None].out, got[None].error, got[None].attempts) == (None, "", 0)


def test_calls_of_a_task_run_together(spark):
    frame = spark.range(40).selectExpr("concat('t', id) as t").coalesce(1)
    call = with_retries(made(), concurrency=20)
    call(frame.limit(1), "t", "a").collect()  # workers are there now
    began = time.time()
    assert call(frame, "t", "a").filter("a.out is not null").count() == 40
    assert time.time() - began < 6  # one by one they take eight seconds
    vectors = retried_embedding(lambda t: [1.0, float(len(t))], attempts=1)(frame, "t", "v").first().v
    assert vectors.out == [1.0, 2.0] and vectors.attempts == 1


def test_cancelled_requests_end(spark):
    raised = []

    def request():
        try:
            with lifecycle.cancellable(spark, "r1"):
                spark.range(8).repartition(4).selectExpr("java_method('java.lang.Thread', 'sleep', 60000L) as x").collect()
        except Exception as e:
            raised.append(str(e))

    other = threading.Thread(target=request)
    other.start()
    for _ in range(100):
        if spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.1)
    lifecycle.cancel(spark, "another")
    lifecycle.cancel(spark, "r1")
    other.join(40)
    assert not other.is_alive() and raised


def test_plugins(monkeypatch):
    import sys

    module = types.ModuleType("own_plugin")
    monkeypatch.setitem(sys.modules, "own_plugin", module)
    module.Own = type("Own", (strategies.Bm25,), {"name": "own", "__module__": "own_plugin"})
    module.Bm25 = strategies.Bm25  # imported, not its own
    assert strategies.strategy("own_plugin:").name == "own" and strategies.strategy("own_plugin:Bm25").name == "bm25"
    module.Two = type("Two", (strategies.Bm25,), {"__module__": "own_plugin"})
    with pytest.raises(TypeError):
        strategies.strategy("own_plugin:")
