"""Stored relations as DDL strings, which Spark takes as schemas, and validated parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

CHUNK = (
    "doc_id string, chunk_id string, chunk_index int, parent_id string, parent_context string, hierarchy_level int,"
    "source struct<type:string,uri:string,retrieved_at:timestamp,content_hash:string>,"
    "content struct<text:string,text_hash:string,char_count:int,token_count_approx:int>,"
    "position struct<byte_start:bigint,byte_end:bigint,page:int,section:string,line_start:int,line_end:int>,"
    "metadata struct<content_type:string,language:string,title:string,tags:array<string>,custom:map<string,string>>"
)
SOURCE = (
    "source_id string, type string, uri string, source_name string, tags array<string>, added_at timestamp, processed_at timestamp,"
    "status string, error string, stats struct<files_fetched:int,chunks_created:int,vectors_created:int>"
)
PROJECT_CHUNK = ("chunk_id string, source_id string, text string, position struct<index:int,start_char:bigint,end_char:bigint>, metadata map<string,string>, created_at timestamp")
VECTOR = ("chunk_id string, embedding array<float>, model string, created_at timestamp")
RAW_ARTIFACT = ("uri string, sha256 string, fetched_at timestamp, size_bytes bigint, content_type string, local_path string")
RUN = ("run_id string, status string, created_at timestamp, completed_at timestamp, config_hash string, phases map<string,struct<status:string,started_at:timestamp,completed_at:timestamp,inputs:bigint,outputs:bigint,errors:bigint>>")
EVENT = ("timestamp timestamp, level string, phase string, tool string, message string, data string")


def _within(name: str, value, low, high) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")


STRATEGIES = ("fixed_chars", "recursive", "by_paragraph", "by_heading", "by_sentence", "by_page", "hierarchical")


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "recursive"
    max_chars: int = 1500
    min_chars: int = 100
    overlap_chars: int = 150
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")
    create_parent_chunks: bool = True
    parent_context_chars: int = 200
    compat: bool = False

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
        _within("max_chars", self.max_chars, 100, 10_000)
        _within("min_chars", self.min_chars, 50, 500)
        _within("overlap_chars", self.overlap_chars, 0, 500)
        _within("parent_context_chars", self.parent_context_chars, 0, 500)
        if self.overlap_chars >= self.max_chars:
            raise ValueError("overlap_chars must be less than max_chars")


@dataclass(frozen=True)
class RetrievalProfile:
    top_k: int = 10
    alpha: float = 0.7
    fusion: str = "rrf"
    modes: tuple[str, ...] = ("semantic", "keyword", "hybrid")
    filters: tuple[tuple[str, str, object], ...] = ()
    include_text: bool = True

    def __post_init__(self) -> None:
        _within("top_k", self.top_k, 1, 100)
        _within("alpha", self.alpha, 0, 1)
        if self.fusion not in ("rrf", "weighted_sum"):
            raise ValueError("fusion must be rrf or weighted_sum")


@dataclass(frozen=True)
class ExpandConfig:
    before: int = 1
    after: int = 1
    parent: bool = False
    max_total: int = 10

    def __post_init__(self) -> None:
        _within("before", self.before, 0, 5)
        _within("after", self.after, 0, 5)
        _within("max_total", self.max_total, 1, 20)


@dataclass(frozen=True)
class Thresholds:
    chunk: float = 0.50
    average: float = 0.65
    classification: float = 0.50

    def __post_init__(self) -> None:
        for name in ("chunk", "average", "classification"):
            _within(name, getattr(self, name), 0, 1)


@dataclass(frozen=True)
class BuildConfig:
    max_sources: int | None = 10  # None: all that are due
    force: bool = False
    dry_run: bool = False
    embed_batch: int = 50
    chunking: ChunkConfig = field(default_factory=lambda: ChunkConfig(strategy="fixed_chars"))

    def __post_init__(self) -> None:
        if self.max_sources is not None:
            _within("max_sources", self.max_sources, 1, 50)
        _within("embed_batch", self.embed_batch, 10, 100)
