"""The pipe language over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sluice.plans.pipe import Resolver, apply_pipe


def run_pipe(stream: DataFrame, text: str, name: str, resolve: Resolver | None = None, mode: str = "complete", watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Start the stages of ``text`` on a stream, into an in-memory table ``name``. ``watermark``: a time column and how late rows may be."""
    if watermark:
        stream = stream.withWatermark(*watermark)
    return apply_pipe(stream, text, resolve).writeStream.format("memory").queryName(name).outputMode(mode).start()
