"""Job options. Every field is a plain argument of a Spark job; nothing is read from the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from clauseloom.taxonomy import TASK_NAMES


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class IngestOptions:
    max_contracts: int | None = None
    min_text_length: int = 100
    max_text_length: int = 50_000
    chunk_size: int = 4_000
    remove_page_numbers: bool = True
    # True: contract_001, contract_002, … in listing order. False: a digest of the path, which needs no ordering.
    sequential_ids: bool = False
    supported_formats: tuple[str, ...] = ("pdf", "docx", "txt")
    # False: white space and symbols stay as extracted.
    normalize_text: bool = True

    def __post_init__(self) -> None:
        _require(self.max_contracts is None or self.max_contracts > 0, "max_contracts must be positive")
        _require(self.min_text_length < self.max_text_length, "min_text_length must be less than max_text_length")
        _require(self.chunk_size > 0, "chunk_size must be positive")
        _require(len(self.supported_formats) > 0, "supported_formats must not be empty")


@dataclass(frozen=True)
class ModelOptions:
    max_tokens_clause: int = 500
    max_tokens_summary: int = 200
    temperature_extraction: float = 0.1
    temperature_summary: float = 0.3
    max_attempts: int = 3
    # Task -> (system line, instruction) of the caller's own prompts; the others keep the standard ones.
    library: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _require(self.max_tokens_clause > 0, "max_tokens_clause must be positive")
        _require(self.max_tokens_summary > 0, "max_tokens_summary must be positive")
        _require(0 <= self.temperature_extraction <= 1, "temperature_extraction must be between 0 and 1")
        _require(0 <= self.temperature_summary <= 1, "temperature_summary must be between 0 and 1")
        _require(self.max_attempts > 0, "max_attempts must be positive")
        unknown = sorted(set(self.library) - set(TASK_NAMES))
        _require(not unknown, f"unknown tasks in the prompt library: {unknown}")


@dataclass(frozen=True)
class SearchOptions:
    enabled: bool = True
    similarity_threshold: float | None = None
    # A cap on hits per query; None leaves them to the caller's k.
    max_results: int | None = None
    # Vectors of texts already embedded are kept by digest and not computed again.
    cache_embeddings: bool = True

    def __post_init__(self) -> None:
        _require(self.max_results is None or self.max_results > 0, "max_results must be positive")


@dataclass(frozen=True)
class OutputOptions:
    csv_path: str | None = None
    json_path: str | None = None
    stage_path: str | None = None
    include_full_text: bool = True
    include_metadata: bool = True

    def __post_init__(self) -> None:
        _require(
            self.csv_path is None or self.csv_path != self.json_path, "csv_path and json_path must be different"
        )


@dataclass(frozen=True)
class Options:
    """All options of a run."""

    ingest: IngestOptions = field(default_factory=IngestOptions)
    model: ModelOptions = field(default_factory=ModelOptions)
    search: SearchOptions = field(default_factory=SearchOptions)
    output: OutputOptions = field(default_factory=OutputOptions)
    validate: bool = True
