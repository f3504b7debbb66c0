"""Paid calls: once, few at a time, at a rate, and never again after a process died."""

import os
import threading
import time
from collections import Counter
from pathlib import Path

import pytest

from quillspark.operators import extract, paid
from quillspark.plans import features


def teller(*args, **kwargs):
    """A local class, which travels to the workers by value."""

    class Teller:
        """Notes each call, and how many run at once, in a folder; may fail, or end its process once, at some prompt."""

        def __init__(self, folder, fatal=None, bad=(), pause=0.0):
            self.folder, self.fatal, self.bad, self.pause = str(folder), fatal, bad, pause

        def __getstate__(self):
            return {k: v for k, v in self.__dict__.items() if k != "now"}

        def __call__(self, prompt):
            self.__dict__.setdefault("now", []).append(1)
            name = f"{self.folder}/{time.time_ns()}-{threading.get_ident()}-{len(self.now)}"
            Path(name).write_text(prompt)
            if prompt == self.fatal and not os.path.exists(f"{self.folder}/died"):
                time.sleep(0.3)
                Path(f"{self.folder}/died").write_text("")
                os._exit(1)
            time.sleep(self.pause)
            self.now.pop()
            if prompt in self.bad:
                raise OSError("busy")
            return f"re: {prompt}"

        def calls(self):
            return Counter(p.read_text() for p in Path(self.folder).iterdir() if "-" in p.name)

        def most(self):
            return max(int(p.name.rpartition("-")[2]) for p in Path(self.folder).iterdir() if "-" in p.name)

    return Teller(*args, **kwargs)


def prompts(spark, n):
    return spark.createDataFrame([(i, f"p{i % (n - 3)}" if i else None, "x") for i in range(n)], "id int, q string, key string")


def test_each_prompt_is_asked_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    call = teller(tmp_path / "calls", bad=("p7",))
    for _ in range(2):
        got = paid.replies(prompts(spark, 40), "q", call, str(tmp_path / "log"), tries=2, wait=0.0).collect()
        assert len(got) == 40
        for r in got:
            want = (None, None) if r.q is None else (None, "OSError: busy") if r.q == "p7" else (f"re: {r.q}", None)
            assert (r.reply, r.error) == want and r.key == "x"
    assert call.calls() == Counter({f"p{i}": 4 if i == 7 else 1 for i in range(37)})
    assert paid.replies(prompts(spark, 40).limit(0), "q", call, str(tmp_path / "log")).count() == 0


def test_a_dead_process_repeats_no_logged_call(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    call = teller(tmp_path / "calls", fatal="p20")
    with pytest.raises(Exception, match="Python worker|SparkException|exited"):
        paid.replies(prompts(spark, 60), "q", call, str(tmp_path / "log"), in_flight=2, buckets=2)
    logged = {k for b in range(2) for k in paid.ReplyLog(str(tmp_path / "log"), b).read().values()}
    assert logged
    got = paid.replies(prompts(spark, 60), "q", call, str(tmp_path / "log"), in_flight=2, buckets=2).collect()
    assert all(r.reply == f"re: {r.q}" for r in got if r.q)
    calls = call.calls()
    assert all(calls[reply.removeprefix("re: ")] == 1 for reply in logged)
    assert sum(n - 1 for n in calls.values()) <= 4  # what was in flight


def test_calls_in_flight_and_their_rate(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    call = teller(tmp_path / "calls", pause=0.05)
    paid.replies(prompts(spark, 30), "q", call, str(tmp_path / "log"), in_flight=3, buckets=1)
    assert call.most() <= 3
    tokens, began = paid.TokenBucket(50.0), time.monotonic()
    for _ in range(30):
        tokens.take()
    assert 29 / 50 - 0.05 <= time.monotonic() - began < 2


def test_a_torn_line_is_passed_over(tmp_path):
    log = paid.ReplyLog(str(tmp_path), 0)
    log.add("a", "1")
    log.close()
    (tmp_path / "bucket=0" / "torn").write_bytes(b'["b", "2"]\n["c", "3')
    assert paid.ReplyLog(str(tmp_path), 0).read() == {"a": "1", "b": "2"}


def test_logged_extraction_equals_the_plain_one(spark, tmp_path):
    notes = spark.createDataFrame([(0, "has 12 and license"), (1, None), (2, "none")], "row_idx long, text string")
    backend, names = extract.RuleBackend(features._BACKEND), list(features._BACKEND)
    plain = extract.extract(notes, names, backend).collect()
    assert sorted(map(tuple, extract.extract_logged(notes, names, backend, str(tmp_path / "log")).collect()), key=str) == sorted(map(tuple, plain), key=str)
    got = extract.extract_logged(notes, ["other"], backend, str(tmp_path / "log"), wait=0.0).collect()
    assert len(got) == 3 and all(r.value is None and "instead of" in r.error for r in got)
