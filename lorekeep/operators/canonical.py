"""Payloads to envelopes: names, types, ids, order and places, as column expressions over one JSON string.

Every rule is a table of paths or names, so a new tool or field is a new row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pointers import at, bare_at, kind_at, long_at, parsed, text_at, true_at
from ..schema import CANONICAL_TYPES, SCHEMA_VERSION, SUMMARY_KINDS, sanitize_session_id

# Which event names mean what, for any tool and for one tool.
HOOK_TYPES = {
    "*": {
        "SessionStart": "session.started", "SessionEnd": "session.ended", "Stop": "session.ended", "UserPromptSubmit": "user.message",
        "PreToolUse": "tool.call", "PostToolUse": "tool.result", "PostToolUseFailure": "tool.result", "PostToolBatch": "tool.result",
        "PreCompact": "compaction.before", "PostCompact": "compaction.after",
    },
    "codex": {
        "session_meta": "session.started", "turn_context": "session.resumed",
        "thread.started": "session.started", "thread/started": "session.started", "turn.started": "session.started", "turn/started": "session.started",
        "turn.completed": "session.ended", "turn/completed": "session.ended", "item/agentMessage/delta": "assistant.delta",
        "SubagentStart": "tool.call", "item.started": "tool.call", "item/started": "tool.call",
        "SubagentStop": "tool.result", "item.failed": "tool.result", "item/failed": "tool.result",
    },
    "opencode": {
        "session.created": "session.started", "session.idle": "session.ended", "session.updated": "session.resumed", "session.error": "error",
        "session.compacted": "compaction.after", "message.part.updated": "assistant.delta", "message.part.removed": "assistant.delta",
        "message.updated": "assistant.message", "message.removed": "assistant.message", "tool.execute.before": "tool.call",
        "tool.execute.after": "tool.result", "command.executed": "tool.result", "file.edited": "file.changed",
    },
}
RESPONSE_ITEMS = {"function_call": "tool.call", "custom_tool_call": "tool.call", "function_call_output": "tool.result", "custom_tool_call_output": "tool.result", "reasoning": "assistant.delta"}
EVENT_MESSAGES = {
    "user_message": "user.message", "agent_message": "assistant.message", "agent_reasoning": "assistant.delta", "exec_command_begin": "tool.call",
    "tool_call": "tool.call", "exec_command_end": "tool.result", "tool_output": "tool.result",
}
ITEM_TYPES = {
    "message": "assistant.message", "agent_message": "assistant.message", "agentMessage": "assistant.message", "user_message": "user.message", "userMessage": "user.message",
    "function_call": "tool.call", "custom_tool_call": "tool.call", "tool_call": "tool.call", "tool": "tool.call", "exec_command_begin": "tool.call",
    "function_call_output": "tool.result", "custom_tool_call_output": "tool.result", "tool_result": "tool.result", "tool-output": "tool.result", "exec_command_end": "tool.result",
    "reasoning": "assistant.delta", "agent_reasoning": "assistant.delta", "error": "error",
}
ROLES = {"user": "user.message", "assistant": "assistant.message"}
NATIVE_NAMES = {
    "tool.execute.before": "tool.call", "tool.execute.after": "tool.result", "session.created": "session.started", "session.updated": "session.started",
    "reasoning": "assistant.delta", "step-start": "assistant.delta", "step-finish": "assistant.delta", "patch": "file.changed",
}
NATIVE_PARTS = {
    "reasoning": "assistant.delta", "step-start": "assistant.delta", "step-finish": "assistant.delta", "patch": "file.changed", "text": "assistant.message",
    "tool": "tool.call", "tool-call": "tool.call", "tool-result": "tool.result", "tool_result": "tool.result", "file": "file.changed",
}
ATTACHMENTS = {"PreToolUse": "tool.call", "PostToolUse": "tool.result", "PostToolUseFailure": "tool.result", "PostToolBatch": "tool.result"}
SIMPLE_NATIVE = {"summary": "compaction.after", "queue-operation": "session.resumed", "system": "session.started"}

# Where payloads keep what; the first path that holds something counts.
ITEM_ROOTS = ("item", "payload.item", "params.item", "payload", "params")
PART_EVENTS = ("message.part.updated", "message.part.removed")
EVENT_ID_PATHS = (
    "event_id", "message_id", "turn_id", "id", "payload.event_id", "payload.message_id", "payload.turn_id", "payload.call_id", "payload.id",
    "payload.item.id", "payload.item.message_id", "payload.item.messageId", "params.event_id", "params.message_id", "params.turn_id",
    "params.call_id", "params.id", "params.item.id", "params.item.message_id", "params.item.messageId", "item.id", "item.message_id",
    "item.messageId", "message.id", "messageID", "uuid", "attachment.toolUseID", "toolUseID",
)
# the first of the paths above and below lie at the top, and text there is taken as it is
TOP_IDS = ("event_id", "message_id", "turn_id", "id")
PART_TOP_IDS = ("event_id", "id", "part_id")
PART_ID_PATHS = (
    "event_id", "id", "part_id", "payload.event_id", "payload.id", "payload.part_id", "part.id", "payload.part.id",
)
SEQUENCE_PATHS = (
    "sequence", "index", "ordinal", "order", "payload.sequence", "payload.index", "payload.ordinal", "payload.order", "params.sequence",
    "params.index", "params.ordinal", "params.order",
)
CODEX_SEQUENCE_PATHS = (
    "item_index", "item_ordinal", "turn_index", "turn_ordinal", "response_index", "output_index", "payload.item_index", "payload.item_ordinal",
    "payload.turn_index", "payload.turn_ordinal", "payload.response_index", "payload.output_index", "payload.item.index", "payload.item.ordinal",
    "payload.turn.index", "payload.turn.ordinal", "params.item_index", "params.item_ordinal", "params.turn_index", "params.turn_ordinal",
    "params.response_index", "params.output_index", "params.item.index", "params.item.ordinal", "params.turn.index", "params.turn.ordinal",
    "item.index", "item.ordinal", "turn.index", "turn.ordinal",
)
PART_SEQUENCE_PATHS = (
    "part_index", "part_sequence", "payload.part_index", "payload.part_sequence", "part.index", "part.sequence", "payload.part.index",
    "payload.part.sequence", "params.part_index", "params.part_sequence", "params.part.index", "params.part.sequence",
)
MESSAGE_ID_PATHS = (
    "message_id", "messageId", "message.id", "messageID", "payload.message_id", "payload.messageId", "payload.message.id", "payload.item.message_id",
    "payload.item.messageId", "payload.item.id", "params.message_id", "params.messageId", "params.message.id", "params.item.message_id",
    "params.item.messageId", "params.item.id", "item.message_id", "item.messageId", "item.id", "uuid", "id",
)
TURN_ID_PATHS = (
    "turn_id", "turnId", "turn.id", "payload.turn_id", "payload.turnId", "payload.turn.id", "params.turn_id", "params.turnId", "params.turn.id",
    "params.item.turn_id", "item.turn_id", "parentUuid", "parentID",
)
VERSION_PATHS = (
    "tool_version", "version", "payload.tool_version", "payload.cli_version", "payload.version", "params.tool_version", "params.cli_version",
    "params.version",
)
WORKTREE_PATHS = ["worktree", "payload.worktree", "params.worktree", "project.worktree", "session.worktree"]
ROOT_PATHS = (
    "project_root", "payload.project_root", "params.project_root", "path.root", "params.path.root", "worktree", "payload.worktree", "params.worktree",
    "project.worktree", "session.worktree",
)
CWD_PATHS = (
    "cwd", "payload.cwd", "params.cwd", "path.cwd", "params.path.cwd", "worktree", "payload.worktree", "params.worktree", "project.worktree",
    "session.worktree",
)
TIME_PATHS = (
    "captured_at", "timestamp", "payload.timestamp", "params.timestamp", "created_at", "payload.created_at", "params.created_at",
)
MILLIS_PATHS = ["time.created", "params.time.created"]
SESSION_PATHS = ["session_id", "payload.session_id", "sessionId", "sessionID"]
STORAGE_SESSION_PATHS = ["session_id", "sessionID", "sessionId", "message.sessionID", "payload.session_id", "payload.sessionID", "payload.sessionId", "session.id"]
HOOK_SESSION_PATHS = ["sessionID", "session_id", "sessionId", "info.sessionID", "part.sessionID", "properties.info.sessionID", "properties.part.sessionID", "payload.sessionID", "payload.session_id"]
SESSION_OBJECT_PATHS = ["id", "info.id", "properties.info.id"]
STREAM_SESSION_PATHS = (
    "session_id", "thread_id", "threadId", "thread.id", "payload.session_id", "payload.thread_id", "payload.thread.id", "params.session_id",
    "params.sessionId", "params.thread_id", "params.threadId", "params.thread.id",
)
STREAM_NAME_PATHS = ["type", "method", "params.type", "payload.type"]
PART_TYPE_PATHS = ["part.type", "payload.part.type", "type", "payload.type"]


def lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*pairs), key)


def event_name(payload: Column) -> Column:
    """The first of three keys that is there; if it holds no text, or empty text, there is none, without a look at the others."""
    out = F.lit(None).cast("string")
    for k in ("type", "event", "hook_event_name"):
        there = kind_at(payload, k)
        out = F.when(there == "STRING", F.nullif(at(payload, k), F.lit(""))).when(there.isNull(), out)
    return out


def _item_type(payload: Column) -> Column:
    """Type of a completed item: its role, else its type; the item lies in the first place that holds an object."""
    out_role, out_type = at(payload, "role"), at(payload, "type")
    for root in reversed(ITEM_ROOTS):
        there = at(payload, root).isNotNull()
        out_role = F.when(there, at(payload, f"{root}.role")).otherwise(out_role)
        out_type = F.when(there, at(payload, f"{root}.type")).otherwise(out_type)
    return F.coalesce(lookup(out_role, ROLES), lookup(out_type, ITEM_TYPES))


def hook_type(tool: Column, name: Column, payload: Column) -> Column:
    """Canonical type of a live event; what no rule knows is an error."""
    kind = at(payload, "payload.type")
    final = true_at(payload, "final")
    codex = (
        F.when(name == "response_item", F.coalesce(F.when(kind == "message", lookup(at(payload, "payload.role"), ROLES)), lookup(kind, RESPONSE_ITEMS), F.lit("error")))
        .when(name == "event_msg", F.coalesce(lookup(kind, EVENT_MESSAGES), F.lit("error")))
        .when(name.isin("item.completed", "item/completed"), F.coalesce(_item_type(payload), F.lit("assistant.message")))
    )
    by_tool = F.lit(None).cast("string")
    for one in ("codex", "opencode"):
        by_tool = F.when(tool == one, lookup(name, HOOK_TYPES[one])).otherwise(by_tool)
    return F.when(name == "MessageDisplay", F.when(final, "assistant.message").otherwise("assistant.delta")).otherwise(
        F.coalesce(F.when(tool == "codex", codex), by_tool, lookup(name, HOOK_TYPES["*"]), F.lit("error"))
    )


def claude_native_type(payload: Column) -> Column:
    content = F.from_json(at(payload, "message.content"), "array<struct<type: string, text: string>>")
    has = lambda kind: F.coalesce(F.exists(content, lambda x: x["type"] == kind), F.lit(False))
    has_text = F.coalesce(F.exists(content, lambda x: (x["type"] == "text") & (F.trim(F.coalesce(x["text"], F.lit(""))) != "")), F.lit(False))
    kind = at(payload, "type")
    return (
        F.when(kind == "user", F.when(has("tool_result"), "tool.result").otherwise("user.message"))
        .when(kind == "assistant", F.when(has("tool_use") & ~has_text, "tool.call").otherwise("assistant.message"))
        .when(kind == "attachment", F.coalesce(lookup(at(payload, "attachment.hookEvent"), ATTACHMENTS), F.lit("error")))
        .otherwise(F.coalesce(lookup(kind, SIMPLE_NATIVE), F.lit("error")))
    )


def opencode_native_type(name: Column, payload: Column) -> Column:
    return F.coalesce(lookup(name, NATIVE_NAMES), lookup(text_at(payload, *PART_TYPE_PATHS), NATIVE_PARTS), lookup(at(payload, "role"), ROLES), F.lit("error"))


def backfill_type(tool: Column, name: Column, payload: Column) -> Column:
    """Canonical type of an imported record; one that the record names wins, what could not be parsed is an error."""
    named = at(payload, "canonical_type")
    native = F.when(tool == "claude", claude_native_type(payload)).when(tool == "codex", hook_type(tool, name, payload)).otherwise(opencode_native_type(name, payload))
    return (
        F.when(named.isin(*CANONICAL_TYPES), named)
        .when(at(payload, "parse_error").isNotNull() | at(payload, "raw_line").isNotNull(), "error")
        .when(at(payload, "hook_event_name").isNotNull() | at(payload, "event").isNotNull(), hook_type(tool, name, payload))
        .otherwise(native)
    )


def sequence(tool: Column, name: Column, payload: Column, fallback: Column | None = None) -> Column:
    own = [long_at(payload, *SEQUENCE_PATHS), F.when(tool == "codex", long_at(payload, *CODEX_SEQUENCE_PATHS)), F.when((tool == "opencode") & name.isin(*PART_EVENTS), long_at(payload, *PART_SEQUENCE_PATHS))]
    return F.coalesce(*own, *([fallback.cast("long")] if fallback is not None else []))


def source_event_id(tool: Column, name: Column, payload: Column, seq: Column) -> Column:
    """Id that the source itself gives the event; parts of a message add their place in it, where it is a number."""
    message = F.when(kind_at(payload, "message_id") == "STRING", at(payload, "message_id"))
    index = F.when(kind_at(payload, "index") == "BIGINT", at(payload, "index"))
    shown = F.concat_ws(":", message, F.coalesce(index, F.lit("unknown")), true_at(payload, "final").cast("string"))
    own = lambda top, paths: F.coalesce(bare_at(payload, *top), text_at(payload, *paths[len(top) :]))
    delta = text_at(payload, *MESSAGE_ID_PATHS)
    return (
        F.when((name == "MessageDisplay") & message.isNotNull(), shown)
        .when((name == "item/agentMessage/delta") & delta.isNotNull(), F.concat_ws(":", delta, F.coalesce(seq.cast("string"), F.lit("unknown")), F.lit("delta")))
        .when((tool == "opencode") & name.isin(*PART_EVENTS), own(PART_TOP_IDS, PART_ID_PATHS))
        .otherwise(own(TOP_IDS, EVENT_ID_PATHS))
    )


def captured_at(payload: Column) -> Column:
    from ..functions.times import millis_to_rfc3339

    return F.coalesce(text_at(payload, *TIME_PATHS), millis_to_rfc3339(long_at(payload, *MILLIS_PATHS)))


def hook_session_id(tool: Column, name: Column, payload: Column) -> Column:
    wide = F.coalesce(text_at(payload, *HOOK_SESSION_PATHS), F.when(name.startswith("session."), text_at(payload, *SESSION_OBJECT_PATHS)))
    return F.when(tool == "opencode", wide).otherwise(text_at(payload, "session_id"))


def summary_kind(kind: Column) -> Column:
    return lookup(kind, SUMMARY_KINDS)


def role(kind: Column) -> Column:
    return lookup(kind, {"user.message": "user", "assistant.delta": "assistant", "assistant.message": "assistant", "tool.result": "tool"})


def tool_status(kind: Column) -> Column:
    return lookup(kind, {"tool.call": "started", "tool.result": "completed"})


def compaction_state(kind: Column) -> Column:
    return F.coalesce(lookup(kind, {"compaction.before": "pre_compaction", "compaction.after": "post_compaction"}), F.lit("none"))


#: The payload, parsed once.
PARSED = "__payload"


def _shared(rows: DataFrame) -> DataFrame:
    p = F.col(PARSED)
    return (
        rows.withColumn("schema_version", F.lit(SCHEMA_VERSION))
        .withColumn("captured_at", F.coalesce(captured_at(p), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")))
        .withColumn("filename_session_id", sanitize_session_id(F.col("session_id")))
        .withColumn("tool_version", text_at(p, *VERSION_PATHS))
        .withColumn("turn_id", text_at(p, *TURN_ID_PATHS))
        .withColumn("message_id", text_at(p, *MESSAGE_ID_PATHS))
        .withColumn("project_root", text_at(p, *ROOT_PATHS))
        .withColumn("cwd", text_at(p, *CWD_PATHS))
        .drop(PARSED)
    )


def from_hooks(rows: DataFrame) -> DataFrame:
    """Envelopes of live payloads (tool, payload). A payload that is no JSON object is kept as an error of session hook-parse-error."""
    good = F.try_parse_json("payload").isNotNull() & F.trim("payload").startswith("{")
    wrapped = F.to_json(F.struct(F.lit("parse_error").alias("type"), F.lit("hook-parse-error").alias("session_id"), F.lit("malformed JSON").alias("parse_error"), F.col("payload").alias("raw_line")))
    rows = rows.withColumn("payload", F.when(F.coalesce(good, F.lit(False)), F.col("payload")).otherwise(wrapped))
    p, tool = F.col(PARSED), F.col("tool")
    rows = rows.withColumn(PARSED, parsed(F.col("payload"))).withColumn("source_event_type", event_name(p)).withColumn("session_id", F.coalesce(hook_session_id(tool, F.col("source_event_type"), p), text_at(p, "session_id")))
    rows = rows.withColumn("canonical_type", hook_type(tool, F.col("source_event_type"), p)).withColumn("sequence", sequence(tool, F.col("source_event_type"), p))
    rows = rows.withColumn("source_event_id", source_event_id(tool, F.col("source_event_type"), p, F.col("sequence"))).withColumn("source", F.lit("hook"))
    return _shared(rows)


def from_records(rows: DataFrame, source: str = "backfill") -> DataFrame:
    """Envelopes of imported records (tool, payload, session_id, source_event_type, byte_offset)."""
    p, tool, name = F.col(PARSED), F.col("tool"), F.col("source_event_type")
    rows = rows.withColumn(PARSED, parsed(F.col("payload"))).withColumn("canonical_type", backfill_type(tool, name, p)).withColumn("sequence", sequence(tool, name, p, F.col("byte_offset")))
    rows = rows.withColumn("source_event_id", source_event_id(tool, name, p, F.col("sequence"))).withColumn("source", F.lit(source))
    return _shared(rows)
