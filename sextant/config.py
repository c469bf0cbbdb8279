"""Engine settings with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    default_k: int = 10
    max_k: int = 50
    candidate_k: int = 50
    spec_max_ops: int = 200
    dim: int = 384
    analyzer: str = "standard"  # or simple
    model_dir: str | None = None
    rerank: bool = False
    budget_tokens: int = 6000
    chars_per_token: int = 4
    min_tokens_per_hit: int = 20
    rrf_constant: int = 60
    snippet_chars: int = 500
    max_section_chars: int = 4000
    max_body_chars: int = 8000
    expand_default: int = 50
    expand_cap: int = 200
    cross_domain_k: int = 5
    find_symbol_k: int = 10
    respect_gitignore: bool = True
    # The default globs of files that are taken and of those that are left out.
    include: tuple[str, ...] = field(default=("**/*.java", "**/*.md", "**/*.markdown", "**/*.yml", "**/*.yaml", "**/*.json", "**/*.pdf", "**/*.docx", "**/*.html", "**/*.txt"))
    exclude: tuple[str, ...] = field(default=("**/target/**", "target/**", "**/build/**", "build/**", "**/node_modules/**", "node_modules/**", "**/.git/**", ".git/**", "**/dist/**", "dist/**", "**/out/**"))
    chunk_key: tuple[str, ...] = ("id",)

    def __post_init__(self):
        if self.chars_per_token < 1:
            raise ValueError("chars_per_token must be at least 1")


DEFAULTS = EngineConfig()
