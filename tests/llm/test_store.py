import os
import threading

from firmatlas.llm.store import scratch, written


def test_threads_remove_only_their_own_tables(spark):
    inside, done = threading.Event(), threading.Event()
    found = {}

    def other():
        inside.wait(60)
        with scratch(spark):
            found["table"] = written(spark.range(7), "other")
            done.set()
            leave.wait(60)
            found["count"] = found["table"].count()

    leave = threading.Event()
    thread = threading.Thread(target=other)
    thread.start()
    with scratch(spark):
        mine = written(spark.range(3), "mine")
        inside.set()
        done.wait(60)
        paths = [f.removeprefix("file://") for f in mine.inputFiles()]
    assert not any(map(os.path.exists, paths))
    leave.set()
    thread.join()
    assert found["count"] == 7


def test_inner_scratch_and_kept_tables(spark):
    with scratch(spark):
        outer = written(spark.range(2), "outer")
        with scratch(spark):
            inner, kept = written(spark.range(3), "inner"), written(spark.range(4), "kept", keep=True)
            gone = inner.inputFiles()[0].removeprefix("file://")
        assert not os.path.exists(gone) and kept.count() == 4 and outer.count() == 2
