"""The names of types, roles, actions and states, in the order that gives them their integer ids."""

from __future__ import annotations

SCHEMA_VERSION = "v3-contract-1"

ENTITY_TYPES = ("user", "host", "process", "file", "ip", "domain", "port", "service", "session", "registry", "container", "cloud_resource", "unknown")
NODE_TYPES = ("event", *ENTITY_TYPES)
RECORD_KINDS = ("authentication", "process", "file", "network", "alert", "state", "unknown")
RELATIONS = ("actor_of", "source_host_of", "process_of", "object_of", "destination_of", "parent_process_of", "session_of", "unknown")
ACTIONS = ("unknown", "read", "write", "execute", "authenticate", "connect", "create", "delete")
OUTCOMES = ("unknown", "success", "failure")

REGISTRY_FIELDS = ("display_name", "role", "tier", "official_url", "status", "allowed_label_usage", "prohibited_usage")
REGISTRY_STATUSES = ("unavailable", "metadata_only", "downloaded", "verified", "normalized", "ready", "not_accessed")

PROTOCOL_STATES = ("DEVELOPMENT", "SOURCE_FROZEN", "RELEASE_LOCKED", "TARGET_INFERENCE_STARTED", "PREDICTIONS_SEALED", "LABEL_SCORING_ALLOWED")
#: Each state may only go to the next.
PROTOCOL_STEPS = tuple(zip(PROTOCOL_STATES, PROTOCOL_STATES[1:], strict=False))

#: Columns of headerless event streams, by the file's name without suffixes.
STREAM_COLUMNS = {
    "auth": ("time", "source_user", "destination_user", "source_computer", "destination_computer", "authentication_type", "logon_type", "authentication_orientation", "status"),
    "proc": ("time", "user", "computer", "process", "action"),
    "flows": ("time", "duration", "source_computer", "source_port", "destination_computer", "destination_port", "protocol", "packet_count", "byte_count"),
    "dns": ("time", "source_computer", "resolved_computer"),
    "redteam": ("time", "user", "source_computer", "destination_computer"),
}

#: Names that must not be columns of anything a model reads.
FORBIDDEN_COLUMNS = ("label", "ground_truth", "attack_stage", "evaluation_result", "scenario")
#: Columns of a feature row that say where it comes from, and aren't features.
METADATA_COLUMNS = ("dataset_id", "record_id", "timestamp", "source_record_ref", "producer_artifact_hashes", "schema_version", "feature_version")
#: Sources whose labels only score and never fit. Matched as part of a lower-cased name.
BLOCKED_SOURCES = ("ait", "ait_lds", "ait_ads")
