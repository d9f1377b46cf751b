"""Parameters of every stage, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Graphs of so many edges or fewer may be solved by one pass in one task, as a round of distributed steps costs more than that.
LOCAL_EDGES = 200_000


@dataclass(frozen=True)
class Ingest:
    id_columns: tuple[str, ...] = ("unique_id", "ID", "id")
    question_columns: tuple[str, ...] = ("question", "problem", "Problem")
    delimiter: str = "##@@B"
    max_lines: int | None = None


@dataclass(frozen=True)
class Model:
    """batch: prompts held at once by a task. rounds: tries of a prompt whose reply can't be parsed. threads: concurrent requests of a task."""

    batch: int = 100
    rounds: int = 6
    threads: int = 8
    pause: float = 1.0
    max_tokens: int = 16384
    timeout: float = 300.0
    request_tries: int = 100
    request_pause: float = 3.0


@dataclass(frozen=True)
class Clustering:
    """threshold: pairs above it are similar. cuts: thresholds of the profile. block: most vectors of a block; every two blocks meet in a task."""

    threshold: float = 0.9
    cuts: tuple[float, ...] = (0.95, 0.9, 0.85, 0.8, 0.75)
    block: int = 16_384


@dataclass(frozen=True)
class Graph:
    supernode_factor: float = 2.0
    log_weights: bool = True
    least_weight: float = 1.0
    centrality_below: int = 5000
    pivots: int = 1000


@dataclass(frozen=True)
class Walk:
    hops: int = 4
    length: int = 15
    paths: int = 1
    least_nodes: int = 6
    degree_penalty: bool = True
    beta: float = 1.0
    epsilon: float = 1e-6
    disturb: bool = True
    level: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class Combine:
    size: int = 10
    starts: int = 3
    steps: int = 4
    samples: int = 10
    least_probability: float = 0.3
    bridge_below: float = 0.5
    perturb: float = 0.7
    scores: dict[int, float] = field(default_factory=lambda: {3: 0.3, 4: 0.6, 5: 0.85})
    bridges: bool = True
    perturbation: bool = True
    any_order: bool = True
    least_quality: float = 0.1
    sample: int = 1000
    seed: int = 42


@dataclass(frozen=True)
class Quality:
    """Weights of the overall score."""

    connectivity: float = 0.3
    probability: float = 0.25
    density: float = 0.25
    uniqueness: float = 0.1
    coverage: float = 0.1
