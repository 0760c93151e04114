"""Settings of an experiment: checked, loaded and saved as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass
class Variant:
    """One way of building a graph: a name, its thresholds from 0 to 1 and its other parameters."""

    name: str
    confidence_threshold: float = 0.6
    similarity_threshold: float = 0.85
    iterations: int = 1
    parameters: dict[str, object] = field(default_factory=dict)


@dataclass
class Experiment:
    name: str
    variants: list[Variant] = field(default_factory=list)
    runs: int = 1
    questions: list[str] = field(default_factory=list)

    def problems(self) -> list[str]:
        """What is wrong with the settings; an empty list if nothing is."""
        out = [] if self.name.strip() else ["no name"]
        out += [] if self.variants else ["no variants"]
        out += [] if self.runs >= 1 else ["runs below 1"]
        names = [v.name for v in self.variants]
        out += [f"variant {n} twice" for n in sorted({n for n in names if names.count(n) > 1})]
        for v in self.variants:
            out += [f"{v.name}: {k} outside 0..1" for k in ("confidence_threshold", "similarity_threshold") if not 0 <= getattr(v, k) <= 1]
            out += [f"{v.name}: iterations below 1"] if v.iterations < 1 else []
        return out

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2, ensure_ascii=False, sort_keys=True), encoding="utf-8")

    @staticmethod
    def load(path: str) -> Experiment:
        """Settings from a file; unknown fields and settings with problems are errors."""
        d = json.loads(Path(path).read_text(encoding="utf-8"))
        e = Experiment(**{**d, "variants": [Variant(**v) for v in d.get("variants", [])]})
        if e.problems():
            raise ValueError("; ".join(e.problems()))
        return e
