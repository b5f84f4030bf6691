"""Schemas of tables, event payloads and facts. Nothing is inferred when data are read."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _s(text: str) -> T.StructType:
    """A flat schema from 'name type, name type'; needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split() for part in text.split(","))])


TABLES = {
    "users": _s("id string, username string, email string, role string, google_id string, avatar string, auth_provider string, created_at timestamp, updated_at timestamp"),
    "nodes": _s("id string, hostname string, status string, ip_address string, total_capacity_bytes long, available_capacity_bytes long, last_heartbeat_at timestamp"),
    "transfers": _s("id string, name string, info_hash string, magnet_uri string, size_bytes long, status string, priority int, lease_expires_at timestamp, progress double, source_path string, torrent_file_path string, s3_key string, created_from_upload boolean, uploaded_by string, owner_node_id string, created_at timestamp, updated_at timestamp"),
    "chunks": _s("id string, chunk_index int, chunk_hash string, status string, verified_at timestamp, transfer_id string, node_id string"),
    "transfer_leechers": _s("user_id string, transfer_id string"),
    "artifact_activities": _s("id long, user_id string, info_hash string, action string, file_name string, ip_address string, created_at timestamp"),
}

ENVELOPE = _s("type string, infoHash string, timestamp long, userId string, sessionId string, data string")
DIRECTIVE = _s("type string, payload string, meta string, timestamp long")

#: Payload of each event type; the names are the wire's.
PAYLOADS = {
    "torrent:added": _s("name string, size long, fileCount int, state string, addedAt long, downloadPath string"),
    "torrent:started": _s("name string, size long, state string, startedAt long"),
    "torrent:progress": _s("progress double, downloadSpeed double, uploadSpeed double, peers int, downloaded long, uploaded long, eta long, totalPieces int, completedPieces int, activePieces int, pendingRequests int"),
    "torrent:completed": _s("name string, size long, downloadTime long, averageSpeed double, totalPieces int, completedAt long"),
    "torrent:error": _s("error string, torrentName string, state string, timestamp long"),
    "torrent:paused": _s("name string, state string, progress double, downloaded long, pausedAt long"),
    "torrent:resumed": _s("name string, state string, progress double, downloaded long, resumedAt long"),
    "torrent:removed": _s("name string, deletedFiles boolean, removedAt long"),
    "peer:connected": _s("ip string, port int, connectedAt long"),
    "peer:disconnected": _s("ip string, port int, disconnectedAt long"),
    "piece:completed": _s("pieceIndex int, totalPieces int, completedPieces int, progress double"),
    "metadata:received": _s("name string, size long"),
}

#: Directive types and topics of the wire (fixed values).
DIRECTIVE_TYPES = "JOB_ASSIGNED JOB_PAUSED JOB_RESUMED JOB_CANCELLED TRANSFER_STARTED TRANSFER_PROGRESS TRANSFER_COMPLETED TRANSFER_FAILED TRANSFER_PAUSED TRANSFER_RESUMED CHUNK_VERIFIED CHUNK_FAILED STATS_UPDATE WORKER_HEARTBEAT".split()
TOPICS = {"dispatch": "torrent.jobs.dispatch", "lifecycle": "torrent.events.lifecycle", "telemetry": "torrent.telemetry.stats", "events": "torrent-events"}

#: Facts of the analytics path; each has the event's time as ts.
FACTS = {
    "torrents": _s("info_hash string, user_id string, name string, size long, file_count int, state string, ts timestamp"),
    "torrent_completions": _s("info_hash string, user_id string, name string, size long, download_time long, average_speed double, total_pieces int, completed_at timestamp"),
    "torrent_progress_snapshots": _s("info_hash string, user_id string, progress double, download_speed double, upload_speed double, peers int, downloaded long, uploaded long, ts timestamp"),
    "peer_connections": _s("info_hash string, user_id string, ip string, port int, action string, ts timestamp"),
    "piece_completions": _s("info_hash string, user_id string, piece_index int, total_pieces int, completed_pieces int, ts timestamp"),
    "torrent_events": _s("type string, info_hash string, user_id string, data string, ts timestamp"),
}
