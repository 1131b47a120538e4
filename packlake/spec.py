"""Options of one packing run."""

from __future__ import annotations

from dataclasses import dataclass, field

from packlake import fixed

TOKEN_MODES = ("pretoken", "chars4", "bpe")
SORTS = ("path", "churn", "size")


@dataclass(frozen=True)
class PackSpec:
    """What to select, how to shape it, how to render it.

    One spec applies to every pack of the corpus; persona, recipe and task of
    single packs may come as columns of the ``packs`` table of ``pack()``.
    """

    scan_paths: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    includes: list[str] = field(default_factory=list)
    lite: bool = False
    own_output: str | None = None
    max_file_kb: int = fixed.DEFAULT_MAX_FILE_BYTES // 1024
    changed_only: bool = False
    compress: bool = False
    remove_comments: bool = False
    remove_blank_lines: bool = False
    redact: bool = True
    max_tokens: int | None = None
    token_mode: str = "pretoken"
    encoding: str = "o200k_base"
    sort: str = "path"
    collation: str = "UNICODE"
    churn_commits: int = fixed.DEFAULT_CHURN_COMMITS
    log_commits: int | None = None
    format: str = "markdown"
    line_numbers: bool = False
    persona: str | None = None
    recipe: str | None = None
    task: str | None = None

    def __post_init__(self) -> None:
        if self.sort not in SORTS:
            raise ValueError(f"invalid sort {self.sort!r}; known: {', '.join(SORTS)}")
        if self.format not in fixed.FORMAT_EXTENSION:
            raise ValueError(
                f"invalid format {self.format!r}; known: {', '.join(fixed.FORMAT_EXTENSION)}"
            )
        if self.token_mode not in TOKEN_MODES:
            raise ValueError(
                f"unknown token mode {self.token_mode!r}; known: {', '.join(TOKEN_MODES)}"
            )
        if self.persona is not None:
            resolve_persona(self.persona)
        if self.recipe is not None and self.recipe.lower() not in fixed.RECIPES:
            raise ValueError(
                f"unknown recipe {self.recipe!r}; known: {', '.join(fixed.RECIPES)}"
            )
        if self.max_tokens is not None and self.max_tokens <= 0:
            raise ValueError("max_tokens must be positive")

    @property
    def max_file_bytes(self) -> int:
        return self.max_file_kb * 1024

    @property
    def shapes(self) -> bool:
        return self.compress or self.remove_comments or self.remove_blank_lines

    def root_rules(self) -> list[str]:
        """Ignore rules added after those of the rule files."""
        rules = list(self.excludes)
        if self.own_output:
            rules.append(self.own_output)
        if self.lite:
            rules.extend(fixed.LITE_EXCLUDES)
        return rules


def resolve_persona(name: str) -> str:
    """Full persona name for a name or alias, case-insensitive."""
    key = name.lower()
    key = {slug: full for full, slug in fixed.PERSONA_SLUGS.items()}.get(key, key)
    if key not in fixed.PERSONA_HEADERS:
        raise ValueError(
            f"invalid persona {name!r}; known: {', '.join(fixed.PERSONA_HEADERS)}"
        )
    return key
