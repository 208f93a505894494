"""Small tables that users enter by hand, as the test queries need them: invented rows, used by Spark and SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PRICE_SCHEMA = (
    "model_id string, effective_from string, input_rate double, output_rate double, write_5m_rate double, write_1h_rate double, read_rate double, "
    "fast_input_rate double, fast_output_rate double, fast_write_5m_rate double, fast_write_1h_rate double, fast_read_rate double, "
    "standard_max_input bigint, verified_on string"
)
#: US dollars for a million tokens. One model has no row, one only a late one, one a second rate, one a context limit.
PRICES = [
    ("lorrin-large-3", "0000-01-01", 15.0, 75.0, 18.75, 30.0, 1.5, 90.0, 450.0, 112.5, 180.0, 9.0, None, "2024-01-20"),
    ("lorrin-large-3", "2024-01-12", 12.0, 60.0, 15.0, 24.0, 1.2, None, None, None, None, None, None, "2024-01-20"),
    ("lorrin-large-2", "0000-01-01", 10.0, 50.0, 12.5, 20.0, 1.0, None, None, None, None, None, 60_000, "2024-01-05"),
    ("lorrin-mid-3", "0000-01-01", 3.0, 15.0, 3.75, 6.0, 0.3, 18.0, 90.0, 22.5, 36.0, 1.8, 200_000, "2024-01-20"),
    ("lorrin-small-2", "2024-01-08", 1.0, 5.0, 1.25, 2.0, 0.1, None, None, None, None, None, None, "2024-01-20"),
]
PLAN_SCHEMA = "effective_month string, usd_per_month double, plan_name string"
PLANS = [("2024-01", 20.0, "starter"), ("2024-02", 100.0, "larger")]
ALIAS_SCHEMA = "from_repository string, to_repository string"
ALIASES = [
    ("/home/tamsk/code/tovvas-core", "/home/ovandrel/code/tovvas-core"), ("/srv/code/holpo-core", "/Users/brilo/code/holpo-core"),
    ("/opt/shared/code/holpo-core", "/moved/away"),
]
MACHINE_SCHEMA = "machine_id string, label string, exported_at string, root string"
#: Machines whose files are read beside our own, by the root their files stand under.
MACHINES = [
    ("m-laptop-k", "Laptop K", "2024-01-25T08:00:00.000Z", "/mnt/sync/laptop-k/.assistant"), ("m-shared", None, "2024-01-26T08:00:00.000Z", "/opt/shared/.assistant"),
]
THIS_MACHINE = ("m-desk", "Desk")
#: Local months are those of a zone five hours behind UTC.
ZONE, ZONE_HOURS = "-05:00", -5
#: Attachments a walk to a hit's cause passes by themselves; a queued command only as a task notification. Fixed values.
PASSED_ATTACHMENTS = (
    "total_tokens_reminder", "batching_reminder_sent", "silent_turn_reminder", "todo_reminder", "task_reminder", "plan_mode", "environment", "date", "date_change", "model",
    "session_context", "instructions", "nested_memory", "credential_org", "auto_mode", "command_permissions", "remote_session_change", "prompt_snapshot", "deferred_tools_record",
    "deferred_tools_delta", "mcp_instructions_delta", "skill_listing", "agent_listing_delta", "invoked_skills", "hook_success", "hook_system_message", "hook_additional_context",
    "bash_output_audience_note", "read_truncation_notice", "structured_output", "edited_text_file", "compact_file_reference", "thinking_drop", "thinking_stripped", "file", "plan_mode_exit",
)
#: Origin of lines that a client writes when it goes on by itself after a reset.
CONTINUATION = "task-notification"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str, alias: str) -> str:
    """The rows as an SQL relation."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({names})"


def names_of(schema: str) -> str:
    return ", ".join(c.split()[0] for c in schema.split(", "))
