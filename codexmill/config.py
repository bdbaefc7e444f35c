"""Settings as immutable values: chunking presets and text generation."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

SPLITS = ("word", "sentence", "char", "passage", "page", "token")


@dataclass(frozen=True)
class ChunkConfig:
    """How texts are cut: units, units to a chunk, units that neighbours share, and which files are taken."""

    split_by: str = "word"
    chunk_size: int = 800
    chunk_overlap: int = 200
    batch_size: int = 1000
    encoding: str = "utf-8"
    max_file_size_mb: float = 50.0
    include_extensions: tuple[str, ...] | None = None
    exclude_patterns: tuple[str, ...] | None = None
    long_text_mode: bool = False

    def __post_init__(self):
        if self.split_by not in SPLITS:
            raise ValueError(f"unknown unit {self.split_by!r}")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("the overlap must be at least 0 and smaller than the chunk")

    def floored(self) -> ChunkConfig:
        """For long texts, at least the sizes that suit them."""
        if not self.long_text_mode:
            return self
        if self.split_by == "passage":
            return replace(self, chunk_size=max(self.chunk_size, 5), chunk_overlap=max(self.chunk_overlap, 2), max_file_size_mb=max(self.max_file_size_mb, 100.0))
        if self.split_by == "word":
            return replace(self, chunk_size=max(self.chunk_size, 1500), chunk_overlap=max(self.chunk_overlap, 300))
        return self


# The presets, their file lists, and the names that project types have.
_LONG_TEXT_FILES = (".txt", ".md", ".rst", ".doc", ".docx", ".pdf", ".rtf", ".odt", ".epub", ".mobi", ".html", ".xml")
_CODE_EXCLUDES = (
    ".git", "__pycache__", ".pyc", ".log", ".tmp", ".cache", "node_modules", ".next", "dist", "build", ".vscode", ".idea", ".DS_Store", "coverage", ".nyc_output",
    ".bin", ".dll", ".so", ".dylib", ".exe", ".zip", ".tar", ".gz", ".rar", ".7z", ".jar", ".war", ".ear", ".deb", ".rpm", ".dmg", ".iso", ".img", ".vdi", ".vmdk", ".qcow2",
)
PRESETS: dict[str, ChunkConfig] = {
    "default": ChunkConfig("word", 800, 200, max_file_size_mb=10.0, exclude_patterns=(".git", "__pycache__", ".pyc", ".log", ".tmp", ".cache")),
    "code_project": ChunkConfig("word", 1000, 250, max_file_size_mb=20.0, exclude_patterns=_CODE_EXCLUDES),
    "long_text": ChunkConfig("passage", 8, 3, batch_size=500, max_file_size_mb=200.0, include_extensions=_LONG_TEXT_FILES, exclude_patterns=(".git", ".cache", ".tmp"), long_text_mode=True),
    "academic": ChunkConfig("passage", 6, 2, max_file_size_mb=100.0, include_extensions=(".txt", ".md", ".tex", ".pdf", ".doc", ".docx"), exclude_patterns=(".git", ".cache", ".tmp", ".aux", ".log", ".bbl"), long_text_mode=True),
    "tech_docs": ChunkConfig("passage", 5, 2, max_file_size_mb=50.0, include_extensions=(".md", ".rst", ".txt", ".html", ".xml"), exclude_patterns=(".git", ".cache", ".tmp"), long_text_mode=True),
    "precise": ChunkConfig("sentence", 3, 1, max_file_size_mb=10.0, exclude_patterns=(".git", "__pycache__", ".pyc", ".log", ".tmp")),
    "large_context": ChunkConfig("passage", 12, 4, max_file_size_mb=500.0, exclude_patterns=(".git", ".cache", ".tmp"), long_text_mode=True),
    "token_based": ChunkConfig("token", 512, 50, max_file_size_mb=100.0, exclude_patterns=(".git", "__pycache__", ".pyc", ".log", ".tmp")),
}
PROJECT_TYPES = {
    "code": "code_project", "project": "code_project", "docs": "tech_docs", "documentation": "tech_docs", "long_text": "long_text", "novel": "long_text", "book": "long_text",
    "academic": "academic", "paper": "academic", "research": "academic", "precise": "precise", "context": "large_context", "token": "token_based", "llm": "token_based",
}


def preset(name: str = "default") -> ChunkConfig:
    """A preset by name; an unknown name gives the default."""
    return PRESETS.get(name, PRESETS["default"])


def list_presets() -> list[tuple[str, ChunkConfig]]:
    """The presets' names and settings, in order."""
    return list(PRESETS.items())


def for_project_type(kind: str = "code") -> ChunkConfig:
    """The preset for a kind of project; an unknown kind counts as code."""
    return preset(PROJECT_TYPES.get(kind.lower(), "code_project"))


def custom(base: str = "default", **changes) -> ChunkConfig:
    """A preset with changes; names that aren't settings are left out, and the preset stays as it is."""
    known = {f.name for f in fields(ChunkConfig)}
    return replace(preset(base), **{k: v for k, v in changes.items() if k in known})


def long_passages(chunk_size: int = 8, chunk_overlap: int = 3, max_file_size_mb: float = 200.0, include_extensions: tuple[str, ...] | None = None) -> ChunkConfig:
    """Settings for long texts cut by passages."""
    return replace(PRESETS["long_text"], chunk_size=chunk_size, chunk_overlap=chunk_overlap, max_file_size_mb=max_file_size_mb, include_extensions=include_extensions or _LONG_TEXT_FILES, exclude_patterns=None).floored()


@dataclass(frozen=True)
class GenerationConfig:
    """How an answer is sampled."""

    temperature: float = 0.15
    max_output_tokens: int = 65500
    top_p: float = 0.95
    top_k: int = 40
    candidate_count: int = 1
    stop_sequences: tuple[str, ...] = field(default=())
