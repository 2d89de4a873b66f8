"""A judge: prompts over a table, each different request once, parsed replies as a column."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_span
from ..sources.shared import written
from .model import HashEmbedding, ModelClient
from .prompts import FINISHED, Prompt
from .replies import ReplyCache


@dataclass(frozen=True)
class Judge:
    """``factory`` makes the model's client in each task; a reply is a text, or (text, finish reason). ``retries`` for failed calls,
    ``repairs`` for replies that are no answer. ``embedder`` makes the client of embeddings. With a ``cache``, requests that it knows do not
    go to the model, and answers (not errors) are added to it; a request is known by the model's name, the prompt and the generation."""

    factory: Callable[[], ModelClient]
    model: str = ""
    retries: int = 2
    repairs: int = 3
    embedder: Callable[[], HashEmbedding] = HashEmbedding
    cache: ReplyCache | None = None
    #: Prompts to be used in place of those of the same name: how a metric's prompts are set, changed and translated.
    prompts: dict[str, Prompt] = field(default_factory=dict)

    def ask(self, df: DataFrame, prompt: Prompt, n: int = 1, into: str = "out", shown: Column | None = None, **inputs: Column) -> DataFrame:
        """``df`` with the parsed reply ``into`` (null with an ``error``) and, for several generations, ``sample_no``.

        ``shown`` gives each row examples of its own. Equal requests go to the model once. The replies are written, so that nothing later calls the model again."""
        prompt = self.prompts.get(prompt.name, prompt)
        rows = df.withColumn("_prompt", prompt.render(**inputs) if shown is None else prompt.render_each(shown, **inputs))
        rows = rows.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 1 else rows
        number = F.col("sample_no") if n > 1 else F.lit(0)
        digest = lambda n: F.sha2(F.to_json(F.struct(F.lit(self.model).alias("m"), n.alias("n"), F.col("_prompt").alias("p"))).cast("binary"), 256)
        keyed = rows.withColumn("_hash", digest(number))

        bare = replace(self, cache=None)  # what goes to the tasks

        def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = bare.factory()
            for pdf in frames:
                replies, errors = bare._replies(client, pdf["_prompt"].tolist(), prompt)
                yield pd.DataFrame({"_hash": pdf["_hash"], "reply": replies, "error": errors})

        # told apart by themselves: a key with its prompt beside it would be aggregated by sorting all prompts
        requests = rows.select("_prompt", number.alias("_number")).distinct().select(digest(F.col("_number")).alias("_hash"), "_prompt")
        known = None
        if self.cache is not None:
            requests = written(requests, "requests")
            known = written(self.cache.read().join(requests.select(F.col("_hash").alias("key")), "key", "left_semi").select(F.col("key").alias("_hash"), "reply"), "known")
            requests = requests.join(known, "_hash", "left_anti")
        answers = written(requests.mapInPandas(call, "_hash string, reply string, error string"), "replies")
        if known is not None:
            self.cache.put(answers.where("error IS NULL").select(F.col("_hash").alias("key"), "reply"))
            answers = answers.unionByName(known.withColumn("error", F.lit(None).cast("string")))
        parsed = answers.select("_hash", F.when(F.col("error").isNull(), prompt.parse(F.col("reply"))).alias(into), "error")
        kept = keyed.drop("_prompt", *(c for c in ("error", into) if c in df.columns))
        return kept.join(parsed, "_hash", "left").drop("_hash")

    def _replies(self, client: ModelClient, prompts: list[str], prompt: Prompt) -> tuple[list[str | None], list[str | None]]:
        replies, errors = self._complete(client, prompts)
        for _ in range(self.repairs):
            odd = [(i, p) for i, r in enumerate(replies) if errors[i] is None and (p := prompt.problem(r))]
            if not odd:
                break
            again, failed = self._complete(client, [prompt.repair(replies[i], p) for i, p in odd])
            for (i, _), r, e in zip(odd, again, failed, strict=True):
                replies[i], errors[i] = r, e
        for i, r in enumerate(replies):
            if errors[i] is None:
                errors[i] = prompt.problem(r)
            if errors[i] is None:
                replies[i] = json_span(r)
        return replies, errors

    def _complete(self, client: ModelClient, prompts: list[str]) -> tuple[list[str | None], list[str | None]]:
        error = None
        for _ in range(self.retries + 1):
            try:
                got = client.complete(prompts)
                break
            except Exception as e:  # noqa: BLE001 - any failure of the service is a row's error
                error = f"{type(e).__name__}: {e}"
        else:
            return [None] * len(prompts), [error] * len(prompts)
        if len(got) != len(prompts):
            return [None] * len(prompts), [f"{len(prompts)} requests, {len(got)} replies"] * len(prompts)
        texts = [g if isinstance(g, str) or g is None else g[0] for g in got]
        reasons = ["stop" if isinstance(g, str) or g is None else g[1] for g in got]
        return texts, [None if r in FINISHED else f"the reply did not finish: {r}" for r in reasons]


_REQUEST = re.compile(r"\nTask: (\w+)\nInput: (.*)\nOutput: \Z", re.DOTALL)


class RuleModel:
    """A deterministic stand-in for a judge: for each task a rule from the request's input to the reply's fields."""

    def __init__(self, rules: dict[str, Callable[[dict], dict]] | None = None):
        self.rules = RULES | (rules or {})

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            start = p.rfind("\nTask: ")
            m = _REQUEST.search(p, max(start, 0))
            task, given = (m[1], json.loads(m[2])) if m else ("", {})
            out.append(json.dumps(self.rules[task](given)) if task in self.rules else "")
        return out


def sentences(text: str | None) -> list[str]:
    """Split at a full stop and a space; a closing full stop belongs to no sentence."""
    return [s for s in (text or "").rstrip(".").split(". ") if s.strip()]


def _within(parts: list[str], text: str) -> list[dict]:
    return [{"statement": p, "verdict": int(p.lower() in text.lower())} for p in parts]


def _classes(given: dict) -> dict:
    a, r = given["answer"], given["reference"]
    return {"TP": [x for x in a if x in r], "FP": [x for x in a if x not in r], "FN": [x for x in r if x not in a]}


def _rating(top: int, left: str, right: str) -> int:
    return top if left == right else top // 2 if left in right or right in left else 0


#: What the stand-in does, by task: containment in place of judgement.
RULES: dict[str, Callable[[dict], dict]] = {
    "statements": lambda g: {"statements": sentences(g["text"])},
    "support": lambda g: {"verdicts": _within(g["statements"], g["context"])},
    "usefulness": lambda g: {"verdict": int(any(s.lower() in g["context"].lower() for s in sentences(g["answer"])))},
    "attribution": lambda g: {"verdicts": _within(sentences(g["answer"]), g["context"])},
    "entities": lambda g: {"entities": sorted(set(g["text"].replace(".", " ").split()))},
    "back_question": lambda g: {"question": (sentences(g["answer"]) or [""])[0], "noncommittal": int("know" in g["answer"])},
    "classes": _classes,
    "keyphrases": lambda g: {"keyphrases": sorted(set(g["text"].replace(".", " ").split()))},
    "quiz": lambda g: {"questions": [f"Is {k} there?" for k in g["keyphrases"]]},
    "quiz_answers": lambda g: {"answers": [str(int(q[3:-7] in g["summary"].replace(".", " ").split())) for q in g["questions"]]},
    "accuracy_rating": lambda g: {"rating": _rating(4, g["answer"], g["reference"])},
    "relevance_rating": lambda g: {"rating": 2 if set(g["question"].lower().split()) & set(g["context"].lower().split()) else 0},
    "relevance_second": lambda g: RULES["relevance_rating"](g),
    "groundedness_second": lambda g: RULES["groundedness_rating"]({"context": g["evidence"], "response": g["claim"]}),
    "groundedness_rating": lambda g: {"rating": 2 if all(w in g["context"] for w in g["response"].split()) else 1 if any(w in g["context"] for w in g["response"].split()) else 0},
    "topics": lambda g: {"topics": sorted({x[7:].split()[0].lower() for x in g["conversation"].split("\n") if x.startswith("Human: ") and x[7:].split()})},
    "topic_refused": lambda g: {"refused": any("cannot" in x for x in g["conversation"].split("\n") if x.startswith("AI: "))},
    "topic_match": lambda g: {"matches": [t in g["reference_topics"] for t in g["topics"]]},
    "goal": lambda g: {"goal": next((x[7:] for x in g["conversation"].split("\n") if x.startswith("Human: ")), ""), "end_state": ([x[4:] for x in g["conversation"].split("\n") if x.startswith("AI: ")] or [""])[-1]},
    "goal_reached": lambda g: {"verdict": int(g["goal"].lower() in g["end_state"].lower())},
    "aspect": lambda g: {"verdict": int(g["definition"].split()[-1].strip("?.") in str(g["response"]))},
    "criteria": lambda g: {"score": len(str(g["response"]).split())},
    "rubric": lambda g: {"score": min(5, 1 + len(str(g["response"]).split()))},
    "sql_equivalence": lambda g: {"equivalent": " ".join(g["response"].lower().split()) == " ".join(g["reference"].lower().split())},
    "image_faithful": lambda g: {"verdict": all(any(w in p["value"] for p in g["contexts"]) for w in g["response"].split())},
    "image_relevant": lambda g: {"verdict": any(w in p["value"] for p in g["contexts"] for w in g["response"].split())},
    "summary": lambda g: {"text": ". ".join(sentences(g["text"])[:2])},
    "title": lambda g: {"text": " ".join(g["text"].split()[:4])},
    "headlines": lambda g: {"headlines": [" ".join(s.split()[:3]) for s in sentences(g["text"])[1:6]]},
    "topic": lambda g: {"text": (sentences(g["text"]) or [""])[0]},
    "themes": lambda g: {"themes": sorted({w.strip(".,").lower() for w in g["text"].split() if len(w) > 9})[:10]},
    "persona": lambda g: {"name": "Reader of " + " ".join(g["summary"].split()[:2]), "role_description": g["summary"], "themes": g["summary"].lower().split()[:5]},
    "question_answer": lambda g: {"query": f"What of {g['term']}?", "answer": (sentences(g["contexts"][0]) or [""])[0]},
    "repair": lambda g: {},
}
