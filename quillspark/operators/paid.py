"""Calls that are paid for: each prompt is asked once, few at a time, at a bounded rate, and its reply is logged before it is used.

Prompts are known by a digest and dealt to buckets by it. A task keeps a bounded
number of calls in flight, takes a token for each from its share of the rate, and
writes every accepted reply to its bucket's log as it comes. Whoever works on the
bucket next, after a lost executor or in another run, reads the log first and asks
only what isn't in it; what was in flight when a process died is asked again.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import held

#: File systems whose open files keep what was flushed to them; elsewhere a reply is a file.
FLUSHED = ("local", "hdfs")
#: Tasks at most, each of which works on its buckets one after another, and rows of a batch that become Python objects at once.
TASKS, ROWS = 16, 64


class ReplyLog:
    """The replies of a bucket, as lines of JSON in files that are only added."""

    def __init__(self, folder: str, bucket: int):
        self.fs, root = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        self.at, self.lock, self.file = f"{root.rstrip('/')}/bucket={bucket}", threading.Lock(), None
        self.fs.create_dir(self.at, recursive=True)

    def read(self) -> dict[str, str]:
        found = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.at)):
            with self.fs.open_input_stream(info.path) as f:
                for line in f.read().split(b"\n"):
                    try:
                        key, reply = json.loads(line)
                    except ValueError:  # the last line of a process that died
                        continue
                    found[key] = reply
        return found

    def add(self, key: str, reply: str) -> None:
        line = json.dumps([key, reply]).encode() + b"\n"
        with self.lock:
            if self.fs.type_name not in FLUSHED:
                with self.fs.open_output_stream(f"{self.at}/{key}") as f:
                    f.write(line)
                return
            self.file = self.file or self.fs.open_output_stream(f"{self.at}/{uuid.uuid4().hex}", buffer_size=0)
            self.file.write(line)
            self.file.flush()

    def close(self) -> None:
        if self.file:
            self.file.close()


class TokenBucket:
    """Grants ``rate`` tokens a second, and as many at once as gather in a second, one at least."""

    def __init__(self, rate: float | None):
        self.rate, self.next, self.lock = rate, time.monotonic(), threading.Lock()

    def take(self) -> None:
        if not self.rate:
            return
        with self.lock:
            now = time.monotonic()
            at = self.next = max(self.next, now - max(1.0 - 1 / self.rate, 0.0)) + 1 / self.rate
        time.sleep(max(at - 1 / self.rate - now, 0.0))


def asked(call: Callable[[str], str], accept: Callable[[str], object] | None, prompt: str, tokens: TokenBucket, tries: int, wait: float) -> tuple[str | None, str | None]:
    """The first reply that is accepted, or the last error after ``tries`` calls."""
    error = None
    for k in range(tries):
        try:
            tokens.take()
            reply = call(prompt)
            if accept:
                accept(reply)
            return reply, None
        except Exception as e:  # a prompt without an accepted reply keeps its error
            error = f"{type(e).__name__}: {e}"
            if k + 1 < tries:
                time.sleep(wait * 2**k)
    return None, error


def replies(df: DataFrame, prompt: str, call: Callable[[str], str], folder: str, accept: Callable[[str], object] | None = None, in_flight: int = 8, rate: float | None = None, tries: int = 3, wait: float = 1.0, buckets: int = 512) -> DataFrame:
    """``df`` with columns reply and error for its column ``prompt``; a null prompt gets null for both.

    ``folder`` is one that the driver and all executors share. ``accept`` raises if a
    reply won't do. At most ``in_flight`` calls a task run at once, and all tasks
    together make about ``rate`` calls a second. Equal prompts are asked once. A task
    holds the log of one bucket at a time; a folder is always used with the same ``buckets``.
    """
    tasks = min(buckets, TASKS)
    key = F.sha2(F.col(prompt), 256)
    each = df.filter(F.col(prompt).isNotNull()).select(key.alias("key"), F.col(prompt).alias("prompt")).dropDuplicates(["key"])
    dealt = each.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).repartition(tasks, "bucket").sortWithinPartitions("bucket", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, log, known, bucket = TokenBucket(rate / tasks if rate else None), None, {}, None
        waiting: deque[tuple[str, Future]] = deque()

        def one(k: str, text: str, own: ReplyLog) -> tuple[str | None, str | None]:
            reply, error = asked(call, accept, text, tokens, tries, wait)
            if error is None:
                own.add(k, reply)
            return reply, error

        def taken(least: int) -> Iterator[pa.RecordBatch]:
            while len(waiting) > least:
                k, future = waiting.popleft()
                reply, error = future.result()
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([reply], pa.string()), pa.array([error], pa.string())], ["key", "reply", "error"])

        with ThreadPoolExecutor(in_flight) as pool:
            for b in (b.slice(start, ROWS) for b in batches for start in range(0, b.num_rows, ROWS)):
                for k, text, at in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if at != bucket:
                        yield from taken(0)
                        if log:
                            log.close()
                        bucket, log = at, ReplyLog(folder, at)
                        known = log.read()
                    if k in known:
                        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([known[k]], pa.string()), pa.array([None], pa.string())], ["key", "reply", "error"])
                        continue
                    yield from taken(in_flight - 1)
                    waiting.append((k, pool.submit(one, k, text, log)))
            yield from taken(0)
        if log:
            log.close()

    # Held, so that what reads the result twice doesn't run the tasks twice.
    found = held(dealt.mapInArrow(run, "key string, reply string, error string"), "replies")
    return df.withColumn("quill_key", key).join(found.withColumnRenamed("key", "quill_key"), "quill_key", "left").drop("quill_key")
