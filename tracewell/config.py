"""Options of the engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RuleOptions:
    """Which protections run, and on what."""

    unresolved_errors: bool = True
    referenced: bool = True
    current_files: bool = True
    current_window: int = 12
    # Tools whose output a second run doesn't give again; a trailing * stands for any ending.
    non_reproducible: tuple[str, ...] = ("WebFetch", "WebSearch", "AskUserQuestion")


@dataclass(frozen=True)
class RulesetOptions:
    """The scorer that needs no model."""

    stale_after: int = 20
    # Tools that are cheap to run again.
    rerunnable: tuple[str, ...] = ("Read", "Grep", "Glob", "LS")


@dataclass(frozen=True)
class PolicyOptions:
    """How scores become actions."""

    threshold: float = 0.4
    margin: float = 0.0
    boost: float = 0.2
    drop_redundant: bool = True
    rerunnable: tuple[str, ...] = ("Read", "Grep", "Glob", "LS")


@dataclass(frozen=True)
class GraphOptions:
    """Which references make an edge."""

    message_gap: int = 2
    symbol_length: int = 6
    max_results: int = 5000
    max_symbols: int = 200
    max_quotes: int = 100
    quote_length: int = 40
    results_per_symbol: int = 3


@dataclass(frozen=True)
class RehydrateOptions:
    """How much archived text a prompt brings back."""

    budget: int = 6000
    min_score: float = 0.34
    limit: int = 3
    min_prompt: int = 12


@dataclass(frozen=True)
class EngineConfig:
    """Everything a compaction needs."""

    preserve_recent: int = 6
    head_chars: int = 300
    min_reduction: float = 0.25
    mark_removed: bool = True
    redact: bool = True
    user_paths: bool = False
    extra_secrets: tuple[str, ...] = ()  # patterns of one's own kinds
    rules: RuleOptions = RuleOptions()
    ruleset: RulesetOptions = RulesetOptions()
    policy: PolicyOptions = PolicyOptions()
    graph: GraphOptions = GraphOptions()
    rehydrate: RehydrateOptions = RehydrateOptions()


def clamp(value: float) -> float:
    """A threshold outside 0 to 1 would keep or drop everything."""
    return min(1.0, max(0.0, value)) if value == value and abs(value) != float("inf") else 0.0
