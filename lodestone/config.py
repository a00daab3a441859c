"""Settings of the engine, with the ranges they must lie in."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Default, least and greatest of each setting.
RANGES = {
    "max_upload_bytes": (52_428_800, 1_048_576, 104_857_600),
    "upload_part_bytes": (5_242_880, 1_048_576, 10_485_760),
    "upload_session_ttl_seconds": (86_400, 3_600, 604_800),
    "max_active_upload_sessions": (20, 1, 100),
    "max_documents": (10_000, 1, 1 << 62),
    "max_document_pages": (500, 1, 2_000),
    "chunk_target_characters": (800, 500, 8_000),
    "chunk_overlap_characters": (100, 0, 1_000),
    "max_document_chunks": (5_000, 100, 20_000),
    "embedding_dimension": (768, 1, 65_536),
    "embedding_batch_size": (8, 1, 20),
    "recent_history_messages": (8, 0, 20),
    "semantic_candidates": (20, 5, 100),
    "lexical_candidates": (20, 5, 100),
    "evidence_limit": (8, 1, 20),
    "max_chunks_per_document": (3, 1, 10),
    "rrf_k": (60, 1, 200),
    "min_semantic_similarity": (0.28, -1.0, 1.0),
    "min_lexical_score": (0.01, 0.0, 10.0),
    "login_attempt_limit": (5, 1, 20),
    "login_window_seconds": (300, 60, 3_600),
    "session_max_age_seconds": (28_800, 300, 604_800),
    "stale_turn_seconds": (900, 60, 86_400),
}


@dataclass(frozen=True)
class Settings:
    max_upload_bytes: int = RANGES["max_upload_bytes"][0]
    upload_part_bytes: int = RANGES["upload_part_bytes"][0]
    upload_session_ttl_seconds: int = RANGES["upload_session_ttl_seconds"][0]
    max_active_upload_sessions: int = RANGES["max_active_upload_sessions"][0]
    max_documents: int = RANGES["max_documents"][0]
    max_document_pages: int = RANGES["max_document_pages"][0]
    chunk_target_characters: int = RANGES["chunk_target_characters"][0]
    chunk_overlap_characters: int = RANGES["chunk_overlap_characters"][0]
    max_document_chunks: int = RANGES["max_document_chunks"][0]
    embedding_dimension: int = RANGES["embedding_dimension"][0]
    embedding_batch_size: int = RANGES["embedding_batch_size"][0]
    recent_history_messages: int = RANGES["recent_history_messages"][0]
    semantic_candidates: int = RANGES["semantic_candidates"][0]
    lexical_candidates: int = RANGES["lexical_candidates"][0]
    evidence_limit: int = RANGES["evidence_limit"][0]
    max_chunks_per_document: int = RANGES["max_chunks_per_document"][0]
    rrf_k: int = RANGES["rrf_k"][0]
    min_semantic_similarity: float = RANGES["min_semantic_similarity"][0]
    min_lexical_score: float = RANGES["min_lexical_score"][0]
    login_attempt_limit: int = RANGES["login_attempt_limit"][0]
    login_window_seconds: int = RANGES["login_window_seconds"][0]
    session_max_age_seconds: int = RANGES["session_max_age_seconds"][0]
    stale_turn_seconds: int = RANGES["stale_turn_seconds"][0]

    def __post_init__(self) -> None:
        for field in fields(self):
            _, least, most = RANGES[field.name]
            if not least <= getattr(self, field.name) <= most:
                raise ValueError(f"{field.name} must be from {least} to {most}")
        if self.chunk_overlap_characters >= self.chunk_target_characters:
            raise ValueError("chunk_overlap_characters must be below chunk_target_characters")


DEFAULTS = Settings()
