"""Envelopes for tests."""

import json

from traceloom.schema import ENVELOPE


def frame(spark, rows, session=False):
    """rows: (source, pid, comm, timestamp_ns, payload or text); sequence in order."""
    made = [(i + 1, ns, ns // 1_000_000 or None, source, pid, comm, data if isinstance(data, str) or data is None else json.dumps(data), *(["s1"] if session else [])) for i, (source, pid, comm, ns, data) in enumerate(rows)]
    return spark.createDataFrame(made, ENVELOPE + ", session_id string" * session)


def payloads(df, source=None):
    rows = df.where(df.source == source) if source else df
    return [json.loads(r["data"]) for r in rows.orderBy("timestamp_ns", "stream_seq").collect()]
