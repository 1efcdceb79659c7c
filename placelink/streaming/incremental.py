"""Documents as a stream: each micro-batch is added and run through the modules."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from placelink.modules import Recognizer, Resolver
from placelink.project import Project


def follow(stream: DataFrame, project: Project, checkpoint: str, recognizer: Recognizer | None = None, resolver: Resolver | None = None, tag: str = "latest", once: bool = True) -> StreamingQuery:
    """Process ``stream(text)``.  Documents of a batch are added under the checkpoint's and the
    batch's name and modules skip what they have seen, so a batch that runs again after a
    failure adds nothing twice."""
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(rows: DataFrame, number: int) -> None:
        project.create_documents(rows, key=f"stream-{own}-{number}")
        if recognizer:
            project.run_recognizer(recognizer, tag)
        if resolver:
            project.run_resolver(resolver, tag)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
