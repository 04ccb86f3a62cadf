"""Chains of transforms, as the commands of an observer set them up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from traceloom.operators.filters import http_filter, ssl_filter
from traceloom.operators.http import parse_http, remove_auth
from traceloom.operators.security import analyze
from traceloom.operators.spans import aggregate_calls
from traceloom.operators.sse import merge_sse
from traceloom.operators.tooluse import correlate
from traceloom.sources.logs import merge

Transform = Callable[[DataFrame], DataFrame]


def chain(*steps: Transform | None) -> Transform:
    return lambda df: reduce(lambda d, f: d.transform(f), [s for s in steps if s], df)


@dataclass
class Pipeline:
    """Sources, transforms and sinks; sinks get the result as a DataFrame."""

    sources: list[DataFrame]
    transforms: list[Transform] = field(default_factory=list)
    sinks: list[Callable[[DataFrame], None]] = field(default_factory=list)

    def with_transforms(self, *steps: Transform) -> Pipeline:
        return Pipeline(self.sources, [*self.transforms, *steps], self.sinks)

    def with_sinks(self, *sinks: Callable[[DataFrame], None]) -> Pipeline:
        return Pipeline(self.sources, self.transforms, [*self.sinks, *sinks])

    def process(self) -> DataFrame:
        return chain(*self.transforms)(merge(*self.sources))

    def run(self) -> DataFrame:
        out = self.process()
        for sink in self.sinks:
            sink(out)
        return out

    def run_stream(self, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """The same over streaming sources: each micro-batch is transformed and goes to all sinks. Transforms that gather
        over time see a micro-batch alone here; streaming.stateful has those that don't."""
        steps, sinks = chain(*self.transforms), self.sinks

        def each(df: DataFrame, _: int) -> None:
            out = steps(df)
            for sink in sinks:
                sink(out)

        return merge(*self.sources).writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).foreachBatch(each).start()


def ssl_chain(ssl_filters: list[str] | None = None, sse: bool = True, http: bool = True, http_filters: list[str] | None = None, redact: bool = True, raw: bool = False) -> Transform:
    """Filters first, before anything is parsed; server-sent events leave before HTTP is parsed."""
    return chain(
        (lambda d: ssl_filter(d, ssl_filters)) if ssl_filters else None, merge_sse if sse else None, (lambda d: parse_http(d, raw)) if http else None,
        (lambda d: http_filter(d, http_filters)) if http_filters else None, remove_auth if redact else None,
    )


def trace_chain(ssl: bool = True, security: bool = True, **options) -> Transform:
    """Alerts come before tool calls, so those are not examined; with ssl, tool uses, else spans."""
    return chain(ssl_chain(**options) if ssl else None, analyze if security else None, correlate if ssl else aggregate_calls)


#: The filters of a recording. The old ones drop every parsed response, as any body contains an empty text.
OLD_RECORD = {"ssl_filters": ["data=0|data.type=binary"], "http_filters": ["request.path_prefix=/v1/rgstr | response.status_code=202 | request.method=HEAD | response.body="]}
RECORD = {"ssl_filters": [r"data=0\r\n\r\n|data.type=binary"], "http_filters": ["request.path_prefix=/v1/rgstr | response.status_code=202 | request.method=HEAD"]}
