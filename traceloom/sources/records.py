"""Events from the fixed binary records of a capture: little-endian fields at fixed places, decoded by expressions.

A file of records is cut by Spark at the borders of records, so its size is no bound; a stream reads whole files as they
come. What is no event (an unknown type, a file operation that is neither open nor delete) gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.scalar import hextets, ipv4_text, ipv6_text, sanitize
from traceloom.schema import ENVELOPE

#: Bytes of a record of each kind as it is kept in files, padded to whole 8 bytes.
SIZES = {"process": 568, "ssl": 524_352, "stdio": 8_256}
#: Names of the functions of an ssl record.
FUNCTIONS = ["READ/RECV", "WRITE/SEND", "HANDSHAKE"]
#: The fields of a credential and their places; the capabilities have 8 bytes, the others 4.
CREDENTIAL = {"uid": 0, "gid": 4, "suid": 8, "sgid": 12, "euid": 16, "egid": 20, "fsuid": 24, "fsgid": 28, "cap_inheritable": 32, "cap_permitted": 40, "cap_effective": 48, "cap_bset": 56, "cap_ambient": 64}


def unsigned(raw: Column, at: int, size: int) -> Column:
    """A number of up to 8 bytes; of 8 bytes as decimal, as it may be over a long."""
    low_first = F.hex(F.substring(raw, at + 1, size))
    high_first = F.concat(*(F.substring(low_first, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.conv(high_first, 16, 10).cast("decimal(20,0)" if size == 8 else "bigint")


def signed32(raw: Column, at: int) -> Column:
    n = unsigned(raw, at, 4)
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)


def long(raw: Column, at: int) -> Column:
    return unsigned(raw, at, 8).try_cast("bigint")


def c_string(raw: Column, at: int, size: int) -> Column:
    """Text up to the first zero byte; bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(F.substring_index(F.substring(raw, at + 1, size).cast("string"), "\0", 1))


def _envelope(rows: DataFrame, source: str, at: Column, pid: Column, comm: Column, data: Column, boot_ms: int) -> DataFrame:
    ms = F.floor(at / 1_000_000).cast("bigint") + boot_ms
    made = {"stream_seq": F.lit(None).cast("bigint"), "timestamp_ns": at, "timestamp_unix_ms": ms, "source": F.lit(source), "pid": pid, "comm": comm, "data": data}
    names = [x.strip().split(" ")[0] for x in ENVELOPE.split(",")]
    return rows.select(*(made[n].alias(n) for n in names))


def decode_process(rows: DataFrame, column: str = "value", boot_ms: int = 0) -> DataFrame:
    """Envelopes of process records: starts and ends, file operations, credentials, connections, renames, folders, shell lines."""
    raw = F.col(column)
    rows = rows.where(F.octet_length(raw) >= 561)
    kind, pid, ppid, at = unsigned(raw, 0, 4), signed32(raw, 4), signed32(raw, 8), long(raw, 24)
    duration, comm, union = unsigned(raw, 16, 8), c_string(raw, 32, 16), 304
    ended, op, family = unsigned(raw, 560, 1) != 0, unsigned(raw, union + 136, 4), unsigned(raw, union, 2)
    event = F.when(kind == 0, F.when(ended, "EXIT").otherwise("EXEC")).when(kind == 1, "BASH_READLINE").when((kind == 2) & (op == 0), "FILE_OPEN").when((kind == 2) & (op == 2), "FILE_DELETE")
    event = event.when(kind == 3, "CRED_CHANGE").when(kind == 4, "NET_CONNECT").when(kind == 5, "FILE_RENAME").when(kind == 6, "DIR_CREATE")
    is_ = lambda *names: event.isin(*names)
    words = F.array(*(F.conv(F.hex(F.substring(raw, union + 5 + 2 * i, 2)), 16, 10).cast("int") for i in range(8)))
    ip = F.when(family == 2, ipv4_text(unsigned(raw, union + 4, 4))).when(family == 10, ipv6_text(words))
    credential = lambda begin: F.struct(*(unsigned(raw, begin + place, 8 if name.startswith("cap") else 4).alias(name) for name, place in CREDENTIAL.items()))
    path = c_string(raw, union, 127)
    fields = {
        "timestamp": at, "event": event, "comm": comm, "pid": pid, "ppid": F.when(is_("EXEC", "EXIT", "CRED_CHANGE"), ppid), "exit_code": F.when(is_("EXIT"), unsigned(raw, 12, 4)),
        "duration_ms": F.when(is_("EXIT") & (duration > 0), F.floor(duration / 1_000_000).cast("bigint")), "filename": F.when(is_("EXEC"), path), "full_command": F.when(is_("EXEC"), c_string(raw, 48, 256)),
        "command": F.when(is_("BASH_READLINE"), c_string(raw, union, 256)), "filepath": F.when(is_("FILE_OPEN", "FILE_DELETE"), path), "flags": F.when(is_("FILE_OPEN", "FILE_DELETE"), signed32(raw, union + 132)),
        "count": F.when(is_("FILE_OPEN"), F.lit(1)), "old": F.when(is_("CRED_CHANGE"), credential(union)), "new": F.when(is_("CRED_CHANGE"), credential(union + 72)), "family": F.when(is_("NET_CONNECT"), family),
        "port": F.when(is_("NET_CONNECT"), unsigned(raw, union + 2, 2)), "ip": F.when(is_("NET_CONNECT"), ip), "oldpath": F.when(is_("FILE_RENAME"), path), "newpath": F.when(is_("FILE_RENAME"), c_string(raw, union + 127, 127)),
        "path": F.when(is_("DIR_CREATE"), path), "mode": F.when(is_("DIR_CREATE"), signed32(raw, union + 128)),
    }
    data = F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
    return _envelope(rows.where(event.isNotNull()), "process", at, pid.cast("bigint"), comm, data, boot_ms)


def decode_ssl(rows: DataFrame, column: str = "value", boot_ms: int = 0, handshakes: bool = False) -> DataFrame:
    """Envelopes of the records of TLS reads and writes, with their text; handshakes only if asked for."""
    raw, most, begin = F.col(column), 512 * 1024, 60
    rows = rows.where(F.octet_length(raw) >= begin)
    at, delta, held, size, rw = long(raw, 0), unsigned(raw, 8, 8), F.least(unsigned(raw, 32, 4), F.lit(most)), unsigned(raw, 28, 4), signed32(raw, 40)
    handshake = (F.octet_length(raw) > begin + most + 4) & F.coalesce(unsigned(raw, begin + most, 4) != 0, F.lit(False))
    filled = (signed32(raw, 36) == 1) & (unsigned(raw, 32, 4) > 0) & (begin + held <= F.octet_length(raw))
    text = F.when(filled, sanitize(F.substring(raw, F.lit(begin + 1), held.cast("int"))))
    lost = size - unsigned(raw, 32, 4)
    comm, pid = c_string(raw, 44, 16), unsigned(raw, 16, 4)
    fields = {
        "function": F.coalesce(F.get(F.array(*map(F.lit, FUNCTIONS)), F.when(rw >= 0, rw).cast("int")), F.lit("UNKNOWN")), "timestamp_ns": at, "comm": comm, "pid": pid, "len": size, "buf_size": unsigned(raw, 32, 4), "uid": unsigned(raw, 24, 4), "tid": unsigned(raw, 20, 4),
        "is_handshake": handshake, "latency_ms": (delta / 1_000_000).cast("double"), "data": text, "truncated": filled & (lost > 0), "bytes_lost": F.when(filled & (lost > 0), lost),
    }
    kept = rows if handshakes else rows.where(~handshake)
    return _envelope(kept, "ssl", at, pid, comm, F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))), boot_ms)


def decode_stdio(rows: DataFrame, column: str = "value", boot_ms: int = 0) -> DataFrame:
    """Envelopes of the records of reads and writes of open files."""
    raw, begin = F.col(column), 57
    rows = rows.where(F.octet_length(raw) >= begin)
    at, delta, size = long(raw, 0), unsigned(raw, 8, 8), unsigned(raw, 36, 4)
    held = F.least(size, F.lit(8192))
    filled = (size > 0) & (begin + held <= F.octet_length(raw))
    comm, pid = c_string(raw, 41, 16), unsigned(raw, 16, 4)
    fields = {
        "timestamp_ns": at, "comm": comm, "pid": pid, "tid": unsigned(raw, 20, 4), "uid": unsigned(raw, 24, 4), "fd": signed32(raw, 28), "len": unsigned(raw, 32, 4), "direction": F.when(unsigned(raw, 40, 1) != 0, "read").otherwise("write"),
        "latency_ms": F.when(delta > 0, (delta / 1_000_000).cast("double")), "data": F.when(filled, sanitize(F.substring(raw, F.lit(begin + 1), held.cast("int")))), "buf_size": F.when(filled, size),
    }
    return _envelope(rows, "stdio", at, pid, comm, F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))), boot_ms)


DECODERS = {"process": decode_process, "ssl": decode_ssl, "stdio": decode_stdio}


def read_records(spark: SparkSession, path: str, kind: str, size: int | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Envelopes of files of records of one kind. Splits begin at borders of records, wherever the files lie; a last record that is cut
    off is left out."""
    n = size or SIZES[kind]
    whole = spark.read.format("binaryFile").load(path).select((F.col("length") % n).alias("rest"), "path")
    if whole.where("rest > 0").isEmpty():  # lengths alone are read
        raw = spark.sparkContext.binaryRecords(path, n).map(lambda b: (bytearray(b),))
        return DECODERS[kind](spark.createDataFrame(raw, "value binary"), **options)
    return DECODERS[kind](_cut(spark.read.format("binaryFile").load(path), n), **options)


def _cut(files: DataFrame, n: int) -> DataFrame:
    """The whole records of each file; the content is cut first, so that no row carries all of it."""
    records = F.floor(F.octet_length("content") / n).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), records - 1), lambda i: F.substring("content", i * n + 1, F.lit(n)))
    return files.select(F.explode(F.when(records > 0, pieces)).alias("value"))


def stream_records(spark: SparkSession, path: str, kind: str, size: int | None = None, per_trigger: int = 100, **options) -> DataFrame:  # noqa: ANN003
    """The same as a stream over files as they come; a file is one row before it is cut, so files are to be rotated by size."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)
    return DECODERS[kind](_cut(files, size or SIZES[kind]), **options)
