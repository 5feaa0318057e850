"""Options of a scan, all frozen; ``signature`` says when stored results go stale."""

from __future__ import annotations

from dataclasses import dataclass, field

DAY = 86_400


@dataclass(frozen=True)
class HistoryOptions:
    """Bounds of the change log and of what is derived from it."""

    max_commits: int | None = 50_000
    max_age_days: int | None = 730
    recent_days: int = 90
    half_life_days: int = 730
    cochange_max_files: int = 100
    find_renames: bool = True

    def signature(self) -> str:
        return "|".join(f"{k}={v if v is not None else 'unbounded'}" for k, v in sorted(vars(self).items()))


@dataclass(frozen=True)
class AnalysisOptions:
    """How files are read: window in bytes and the parsers in use."""

    content_window: int = 1 << 20
    parsers: tuple[str, ...] = ("go",)

    def signature(self) -> str:
        return f"window={self.content_window}|parsers={','.join(self.parsers)}"


@dataclass(frozen=True)
class ScoringOptions:
    """Formula names and how many hotspots are shown."""

    file_formula: str = "score.go.v1"
    package_formula: str = "package_risk.go.v1"
    project_formula: str = "project_risk.go.v1"
    top: int = 5
    facts_shown: int = 4


@dataclass(frozen=True)
class ScanOptions:
    history: HistoryOptions = field(default_factory=HistoryOptions)
    analysis: AnalysisOptions = field(default_factory=AnalysisOptions)
    scoring: ScoringOptions = field(default_factory=ScoringOptions)
