"""Schemas of the tables that the operators pass on."""

from __future__ import annotations

TOOL_USE = "struct<tool_use_id: string, tool: string, input: string, text: string, is_error: boolean>"
TOOL_RESULT = "struct<tool_use_id: string, text: string, is_error: boolean>"

#: A transcript: one row per message; input is the JSON text of a tool's input.
MESSAGES = f"session_id string, message_index int, role string, text string, tool_uses array<{TOOL_USE}>, tool_results array<{TOOL_RESULT}>"

#: Columns of the archive; session_id is its partition column.
ARCHIVE = "id string, session_id string, seq long, role string, kind string, content string, content_hash string, token_estimate long, tool_name string, tool_use_id string, is_error boolean, archived_at string, compaction_id string, action string, reasons array<struct<code: string, detail: string>>, related array<struct<relation: string, id: string>>, metadata string"
