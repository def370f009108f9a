"""Settings of the engine. Values are those of the published retrieval profile."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PassageConfig:
    verse_window: int = 8
    verse_overlap: int = 1
    diwan_min_tail: int = 2
    mathnawi_min_tail: int = 6
    prose_target: int = 180
    prose_soft_min: int = 80
    prose_hard_max: int = 300

    def __post_init__(self) -> None:
        if not 0 <= self.verse_overlap < self.verse_window:
            raise ValueError("verse_overlap must be less than verse_window")
        if not 0 < self.prose_soft_min <= self.prose_target <= self.prose_hard_max:
            raise ValueError("prose limits must rise")


@dataclass(frozen=True)
class LexicalConfig:
    k1: float = 1.2
    b: float = 0.75
    least_idf: float = 1e-6
    limit: int = 100
    shard_tokens: int = 2_000_000  # tokens of the documents that a task indexes at once
    query_block: int = 50_000  # queries evaluated in one pass over the documents ...
    token_block: int = 1_000_000  # ... and their tokens
    #: Fixed value: words that an any-term query ignores.
    stopwords: tuple[str, ...] = tuple("از است این آن او با بر برای به بود تا تو خود در را شد شود که ما من می و یا یک".split())


@dataclass(frozen=True)
class FusionConfig:
    lexical_weight: float = 2.0
    dense_weight: float = 1.0
    rrf_constant: int = 60
    candidate_limit: int = 100
    limit: int = 10


@dataclass(frozen=True)
class PolicyConfig:
    reject_known_out_of_corpus: bool = True
    reject_source_conflict: bool = True
    reject_paratext_top: bool = True
    reject_mixed_top: bool = True
    reject_weak_evidence: bool = True
    weak_dense_top_1: float = 0.863
    weak_max_overlap_at_10: int = 0
    depth: int = 10
    max_suggestions: int = 3


def profile_differences(actual: FusionConfig, locked: FusionConfig = FusionConfig()) -> list[str]:
    """Names of settings in which a retrieval profile departs from the locked one."""
    return [k for k, v in vars(locked).items() if abs(float(vars(actual)[k]) - float(v)) > 1e-12]
