"""The event envelope and the typed tables."""

from __future__ import annotations

ENVELOPE = "stream_seq bigint, timestamp_ns bigint, timestamp_unix_ms bigint, source string, pid bigint, comm string, data string"

PREFIX = "id bigint, session_id string, timestamp_ns bigint, timestamp_unix_ms bigint, event_time timestamp_ntz, pid bigint, comm string"

TABLES = {
    "events_process": f"{PREFIX}, event_type string, ppid bigint, exit_code int, duration_ms bigint, filename string, full_command string, filepath string, filepath2 string, file_flags int, net_ip string, net_port int, net_family int, dir_mode int, bash_command string, data_json string",
    "events_tool_call": f"{PREFIX}, tool_event_type string, tool_name string, tool_status string, tool_reason string, tool_bytes bigint, tool_key_field string, tool_args_hash string, tool_tid bigint, duration_ms bigint, data_json string",
    "events_system": f"{PREFIX}, sys_type string, cpu_percent double, cpu_cores int, mem_rss_kb bigint, mem_vsz_kb bigint, thread_count int, children_count int, sys_alert boolean, data_json string",
    "events_ssl": f"{PREFIX}, ssl_function string, ssl_len bigint, ssl_is_handshake boolean, ssl_latency_ms double, ssl_tid bigint, data_json string",
    "events_http": f"{PREFIX}, http_message_type string, http_method string, http_path string, http_status_code int, http_total_size bigint, http_tid bigint, data_json string",
    "events_sse": f"{PREFIX}, sse_connection_id string, sse_duration_ns bigint, sse_event_count int, sse_total_size bigint, data_json string",
    "events_security": f"{PREFIX}, alert_type string, risk_level string, description string, source_table string, source_event_id bigint, evidence_json string, data_json string",
    "process_tree": "session_id string, pid bigint, ppid bigint, comm string, filename string, start_time timestamp_ntz, end_time timestamp_ntz, depth int",
    "event_links": "session_id string, source_table string, source_id bigint, target_table string, target_id bigint, link_type string",
    "sessions": "session_id string, start_time timestamp_ntz, end_time timestamp_ntz, comm_filter string, binary_path string, hostname string, kernel_version string, labels string",
}

#: Envelope source -> table; other sources (stdio) have none.
ROUTES = {
    "process": "events_process",
    "tool_call": "events_tool_call",
    "system": "events_system",
    "ssl": "events_ssl",
    "http_parser": "events_http",
    "sse_processor": "events_sse",
    "security": "events_security",
}
