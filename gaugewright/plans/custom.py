"""Metrics that users write as a prompt: discrete, numeric or ranking; kept as JSON files."""

from __future__ import annotations

import hashlib
import json
import string
from dataclasses import asdict, dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import Metric, in_domain
from .judging import Judge
from .prompts import Prompt

#: The reply's fields of each kind.
OUTPUTS = {"discrete": "value string, reason string", "numeric": "value double, reason string", "ranking": "value array<string>, reason string"}


@dataclass(frozen=True)
class PromptMetric:
    """``template``: a text with {columns} of the row. ``allowed``: the values of a discrete metric, (low, high) of a numeric
    one, the length of a ranking. ``examples``: (columns, value) pairs that go into the prompt."""

    name: str
    template: str
    kind: str = "discrete"
    allowed: tuple = ("pass", "fail")
    examples: tuple[tuple[dict, object], ...] = ()

    def __post_init__(self):
        if self.kind not in OUTPUTS:
            raise ValueError(f"unknown kind {self.kind!r}; known: {', '.join(OUTPUTS)}")

    def columns(self) -> list[str]:
        return list(dict.fromkeys(n for _, n, _, _ in string.Formatter().parse(self.template) if n))

    def prompt(self) -> Prompt:
        rule = {"discrete": f"one of {', '.join(map(str, self.allowed))}", "numeric": f"a number from {self.allowed[0]} to {self.allowed[-1]}", "ranking": f"a list of {self.allowed[0]} names, the best first"}
        shown = tuple((given, {"value": value, "reason": ""}) for given, value in self.examples)
        return Prompt(self.name, f"{self.template}\nThe value is {rule[self.kind]}.", OUTPUTS[self.kind], shown)

    def fits(self, value: Column) -> Column:
        if self.kind == "ranking":
            return F.size(value) == self.allowed[0]
        return in_domain(value, tuple(self.allowed) if self.kind == "numeric" else list(self.allowed))

    def judged(self, df: DataFrame, judge: Judge, key: str) -> DataFrame:
        """(key, score, reason): a value outside the domain is null with the reason; so is a reply that is no answer."""
        out = judge.ask(df, self.prompt(), **{c: F.col(c) for c in self.columns()})
        value = F.col("out.value")
        good = F.coalesce(self.fits(value), F.lit(False))
        why = F.when(good, F.col("out.reason")).otherwise(F.coalesce("error", F.concat(F.lit("outside the domain: "), F.coalesce(F.to_json(F.struct(value)), F.lit("null")))))
        return out.select(key, F.when(good, value).alias("score"), why.alias("reason"))

    def metric(self) -> Metric:
        """For ``evaluate``; numeric metrics only, whose scores have means."""
        if self.kind != "numeric":
            raise ValueError("evaluate takes numeric metrics; use judged for the others")
        return Metric(self.name, self.columns(), judged=lambda df, judge, key: self.judged(df, judge, key).select(key, "score"), kinds=("single", "multi"))

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self) | {"format": 1, "digest": self.digest()}, ensure_ascii=False, indent=1), encoding="utf-8")

    @staticmethod
    def load(path: str | Path) -> PromptMetric:
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        if held.pop("format", None) != 1:
            raise ValueError(f"{path} is no saved metric")
        digest = held.pop("digest", None)
        metric = PromptMetric(**held | {"allowed": tuple(held["allowed"]), "examples": tuple((a, b) for a, b in held["examples"])})
        if digest != metric.digest():
            raise ValueError(f"{path} does not match its digest")
        return metric

    def with_examples(self, rows: DataFrame, gold: str, most: int = 5) -> PromptMetric:
        """With up to ``most`` labelled rows as examples, the first by the hash of their columns."""
        picked = rows.where(F.col(gold).isNotNull()).orderBy(F.xxhash64(*self.columns())).limit(most).collect()
        return replace(self, examples=tuple(({c: r[c] for c in self.columns()}, r[gold]) for r in picked))
