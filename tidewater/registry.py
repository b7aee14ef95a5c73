"""Extension surface (EXT-01..03): named input transforms, the input
description catalog, and column formatters.

An *input* is a ``DataFrame -> DataFrame`` transform from a record-shaped
table to the message schema (``df.transform(fn)``); custom sources plug in
through Spark's Python Data Source API (``spark.dataSource.register``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as TX
from .sources import adapters as A

InputFactory = Callable[..., Callable[[DataFrame], DataFrame]]

_INPUTS: dict[str, InputFactory] = {}


def register_input(name: str, factory: InputFactory) -> None:
    """EXT-01: register an input by name; a duplicate name is an error."""
    if name in _INPUTS:
        raise ValueError(f"input {name!r} already registered")
    _INPUTS[name] = factory


def create_input(name: str, **config) -> Callable[[DataFrame], DataFrame]:
    """EXT-01: build the transform of a registered input from its config."""
    if name not in _INPUTS:
        raise KeyError(f"unknown input {name!r}")
    return _INPUTS[name](**config)


def list_inputs() -> list[str]:
    return sorted(_INPUTS)


def _builtin(fn):
    def factory(tenant_id: str, dataset_id: str, data_hint: str = "raw", **kw):
        return lambda df: fn(df, tenant_id, dataset_id, data_hint, **kw)
    return factory


for _name, _fn in (("kafka", A.kafka_to_messages), ("nats", A.nats_to_messages), ("sqs", A.sqs_to_messages),
                   ("kinesis", A.kinesis_to_messages), ("http", A.http_to_messages)):
    register_input(_name, _builtin(_fn))


# Input descriptions: name, display name, category, transport, default port.
INPUT_CATALOG = [
    ("udp", "UDP datagrams", "Datagram", "UDP", None),
    ("tcp", "TCP lines", "Stream", "TCP", None),
    ("syslog", "Syslog", "Logs", "UDP", 514),
    ("http", "HTTP requests", "Request", "TCP", 8080),
    ("kafka", "Kafka topics", "Queue", "TCP", None),
    ("nats", "NATS subjects", "Queue", "TCP", 4222),
    ("sqs", "SQS queue", "Queue", "API", None),
    ("kinesis", "Kinesis stream", "Queue", "API", None),
    ("netflow", "NetFlow", "Flow records", "UDP", 2055),
    ("sflow", "sFlow", "Flow records", "UDP", 6343),
    ("ipfix", "IPFIX", "Flow records", "UDP", 4739),
    ("ebpf", "eBPF", "Telemetry", "UDP", 2056),
]
# Fields of an input: name, type, required, default, valid range, group,
# description, placeholder, options.
_HOST = ("host", "string", False, "0.0.0.0", None, "Network", "address to listen on", "0.0.0.0", [])
_PORT = ("port", "int", True, None, "1-65535", "Network", "port to listen on", "5000", [])
_BUFFER = ("read_buffer_size", "int", False, "8388608", "1024-1073741824", "Performance", "socket buffer in bytes", None, [])
_REGION = ("region", "string", True, None, None, "Connection", "cloud region", "us-east-1", [])


def _seconds(name: str, default: int, text: str, group: str = "Performance") -> tuple:
    return (name, "int", False, str(default), "min:1", group, f"{text}, in seconds", None, [])


INPUT_FIELDS: dict[str, list[tuple]] = {
    **{n: [_HOST, _PORT, _BUFFER] for n in ("udp", "syslog", "netflow", "sflow", "ipfix", "ebpf")},
    "tcp": [_HOST, _PORT,
            ("max_connections", "int", False, "1000", "min:1", "Limits", "connections at a time", None, []),
            _seconds("read_timeout", 300, "idle time before a connection closes", "Limits"),
            ("max_line_size", "int", False, "1048576", "min:1", "Limits", "longest record in bytes", None, []),
            ("delimiter", "string", False, "\n", None, "Parsing", "ends a record", "\n", [])],
    "http": [_HOST, _PORT,
             ("path", "string", False, "/webhook", None, "Network", "path that takes requests", "/webhook", []),
             ("max_payload_size", "int", False, "1048576", "min:1", "Limits", "largest body in bytes", None, []),
             ("max_lines_per_request", "int", False, "1000", "min:1", "Limits", "most lines in a body", None, []),
             _seconds("read_timeout", 30, "time to read a request"),
             _seconds("write_timeout", 30, "time to answer a request"),
             ("enable_authentication", "bool", False, "false", None, "Security", "ask for a bearer token", None, ["true", "false"])],
    "kafka": [("brokers", "[]string", True, None, None, "Connection", "broker addresses", "broker:9092", []),
              ("topics", "[]string", True, None, None, "Connection", "topics to read", "events", []),
              ("group_id", "string", True, None, None, "Connection", "consumer group", "readers", []),
              ("auto_offset_reset", "string", False, "latest", None, "Consumer", "where a new group starts", None,
               ["earliest", "latest"]),
              _seconds("session_timeout", 30, "time without a sign of life before a member is dropped", "Consumer"),
              _seconds("heartbeat_interval", 10, "time between signs of life", "Consumer")],
    "nats": [("servers", "[]string", False, "nats://localhost:4222", None, "Connection", "server addresses",
              "nats://localhost:4222", []),
             ("subjects", "[]string", True, None, None, "Connection", "subjects to read", "events.>", []),
             ("queue_group", "string", False, None, None, "Connection", "members share the messages", None, []),
             ("max_reconnect", "int", False, "-1", None, "Connection", "tries to reconnect, -1 for no end", None, []),
             _seconds("reconnect_wait", 2, "time between tries", "Connection"),
             _seconds("timeout", 10, "time to connect", "Connection"),
             ("user_creds", "string", False, None, None, "Security", "credentials file", None, []),
             ("token", "string", False, None, None, "Security", "access token", None, [])],
    "sqs": [("queue_name", "string", True, None, None, "Connection", "queue to read", "events", []),
            ("queue_url", "string", False, None, None, "Connection", "address of the queue", None, []), _REGION,
            _seconds("poll_interval_seconds", 5, "time between polls"),
            ("max_messages", "int", False, "10", "1-10", "Performance", "messages a poll", None, []),
            _seconds("visibility_timeout_seconds", 30, "time a message is hidden from others"),
            _seconds("wait_time_seconds", 20, "time a poll waits for messages"),
            ("delete_after_process", "bool", False, "true", None, "Processing", "delete what was landed", None, ["true", "false"]),
            ("worker_count", "int", False, "3", "min:1", "Performance", "polls at a time", None, [])],
    "kinesis": [("stream_name", "string", True, None, None, "Connection", "stream to read", "events", []), _REGION,
                ("shard_iterator_type", "string", False, "LATEST", None, "Consumer", "where reading starts", None,
                 ["LATEST", "TRIM_HORIZON"]),
                _seconds("poll_interval_seconds", 5, "time between polls"),
                ("max_records", "int", False, "100", "1-10000", "Performance", "records a poll", None, [])],
}
_FIELD_TYPE = ("array<struct<name:string,type:string,required:boolean,default:string,validation:string,group:string,"
               "description:string,placeholder:string,options:array<string>>>")


def input_catalog(spark: SparkSession) -> DataFrame:
    """EXT-02: the input description table (explode ``fields`` to list them)."""
    rows = [(name, display, f"{display} input ({transport})", category, transport, port, INPUT_FIELDS[name])
            for name, display, category, transport, port in INPUT_CATALOG]
    return spark.createDataFrame(rows, "name string, display_name string, description string, category string, "
                                       f"transport string, default_port int, fields {_FIELD_TYPE}")


def config_field_errors(configs: DataFrame) -> DataFrame:
    """EXT-02 applied: (pos, type, name, error) for each required field that a
    config (type, name, pos, config) lacks and each option it misses. The
    catalog is a fixed small table, so it is the broadcast side."""
    spark = configs.sparkSession
    cat = input_catalog(spark).select(F.col("name").alias("_type"), F.explode("fields").alias("f"))
    j = configs.join(F.broadcast(cat), F.col("type") == F.col("_type"))
    value = F.element_at("config", F.col("f.name"))
    error = F.when(F.col("f.required") & (F.coalesce(value, F.lit("")) == ""), F.concat(F.col("f.name"), F.lit(": needed"))) \
        .when((F.size("f.options") > 0) & value.isNotNull() & ~F.array_contains("f.options", value),
              F.concat(F.col("f.name"), F.lit(": no such option")))
    return j.select("pos", "type", "name", error.alias("error")).where(F.col("error").isNotNull())


# EXT-03: formatters are Column -> Column functions keyed by hint.
_FORMATTERS: dict[str, Callable[[Column], Column]] = {
    "ndjson": TX.ndjson_normalise,
    "raw": lambda c: c,
    "generic": TX.collapse_one_line,
}


def register_formatter(name: str, fn: Callable[[Column], Column]) -> None:
    """EXT-03: add a formatter (a Python UDF only if the user supplies one)."""
    if name in _FORMATTERS:
        raise ValueError(f"formatter {name!r} already registered")
    _FORMATTERS[name] = fn


def formatter(hint: str) -> Callable[[Column], Column]:
    """The formatter for a hint: ndjson, raw / empty, else generic."""
    if hint in ("", None):
        return _FORMATTERS["raw"]
    return _FORMATTERS.get(hint, _FORMATTERS["generic"])
