"""Schemas of the stored entities; files are read with them, never by inference."""

from __future__ import annotations

BLOCK = "struct<block_type:string,text:string,tool_name:string,tool_input:string,tool_use_id:string,result_text:string,is_error:boolean>"

SCHEMAS = {
    "sessions": "session_id string, project string, cwd string, started_at timestamp, ended_at timestamp, status string, observation_count int, model_name string, tags array<string>, first_prompt string, summary string, commit_shas array<string>, agent_id string",
    "raw_observations": "obs_id string, session_id string, ts timestamp, hook_type string, tool_name string, tool_input string, tool_output string, user_prompt string, assistant_response string, raw string, modality string, origin_detail string, origin_channel string, agent_id string, batch_id bigint, received_at timestamp",
    "observations": "obs_id string, session_id string, ts timestamp, type string, title string, subtitle string, narrative string, files array<string>, importance int, confidence double, agent_id string",
    "timeline_events": "event_id string, session_id string, ts timestamp, offset_ms bigint, duration_ms bigint, kind string, label string, body string, tool_name string",
    "transcript_rows": f"row_type string, uuid string, session_id string, ts string, cwd string, message_role string, message_content array<{BLOCK}>, batch_id bigint, received_at timestamp",
    "memories": "memory_id string, created_at timestamp, updated_at timestamp, memory_type string, title string, content string, concepts array<string>, files array<string>, session_ids array<string>, source_observation_ids array<string>, strength double, version_no int, parent_id string, is_latest boolean, forget_after timestamp, agent_id string, project string",
    "file_history": "file_path string, obs_id string, session_id string, ts timestamp, obs_type string, title string, narrative string, importance int",
    "image_vectors": "image_ref string, vector array<float>, model_name string, dimensions int, updated_at timestamp, session_id string, observation_id string",
    "session_vectors": "session_id string, embedding array<float>",
    "edges": "source string, target string, type string, weight double, committed_at timestamp, valid_from timestamp, valid_until timestamp",
}
