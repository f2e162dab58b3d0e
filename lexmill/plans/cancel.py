"""Cancelling what runs: a flag that is asked between jobs, and a tag by which running jobs are stopped."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import SparkSession


class Cancellation:
    """Give it as ``cancelled`` to a search or a build, inside ``with``; ``cancel`` works from any thread.

    Jobs that this thread starts inside ``with`` bear the tag. A cancel ends the
    running ones, which raises in the thread that waits for them, and the flag
    stops what would follow.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._context, self._stopped, self.tag = spark.sparkContext, threading.Event(), f"lexmill-{uuid.uuid4().hex}"

    def __call__(self) -> bool:
        return self._stopped.is_set()

    def cancel(self) -> None:
        self._stopped.set()
        self._context.cancelJobsWithTag(self.tag)

    def __enter__(self) -> Cancellation:
        self._context.addJobTag(self.tag)
        return self

    def __exit__(self, *_: object) -> None:
        self._context.removeJobTag(self.tag)
