"""Prompts as values: rendered as columns, parsed as columns, kept as JSON files."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import json_span

#: The reasons of a reply that count as finished; a reply cut at its length limit counts, as its text may still parse.
FINISHED = {"stop", "STOP", "end_turn", "stop_sequence", "eos_token", "MAX_TOKENS", "max_tokens", "length", "END_TURN", "COMPLETE"}


@dataclass(frozen=True)
class Prompt:
    """``output``: the fields of the reply as Spark DDL; the reply is one JSON object of these. ``examples``: (input, output) pairs."""

    name: str
    instruction: str
    output: str
    examples: tuple[tuple[dict, dict], ...] = ()
    language: str = "english"

    def fields(self) -> list[str]:
        """The names of the reply's fields; tasks need them, where no DDL can be parsed."""
        flat, inner = self.output, None
        while flat != inner:
            flat, inner = re.sub(r"<[^<>]*>", "", flat), flat
        return [part.split()[0] for part in flat.split(",")]

    def head(self) -> str:
        """What comes before a row's input; the same for all rows, so a constant of the plan."""
        shown = "".join(f"\n\nExample {i}\nInput: {json.dumps(a, ensure_ascii=False)}\nOutput: {json.dumps(b, ensure_ascii=False)}" for i, (a, b) in enumerate(self.examples, 1))
        return f"{self.instruction}\nAnswer with one JSON object of these fields: {self.output}{shown}\n\nTask: {self.name}\nInput: "

    def render(self, **inputs: Column) -> Column:
        payload = F.to_json(F.struct(*[c.alias(n) for n, c in inputs.items()]), {"ignoreNullFields": "false"})
        return F.concat(F.lit(self.head()), payload, F.lit("\nOutput: "))

    def render_each(self, shown: Column, **inputs: Column) -> Column:
        """Like ``render``, with examples of each row's own after the prompt's: ``shown`` is an array of (input, output), both JSON texts, such as
        ``align`` finds by nearness. A null array is empty."""
        start = len(self.examples)
        line = lambda e, i: F.concat(F.lit("\n\nExample "), (i + start + 1).cast("string"), F.lit("\nInput: "), e["input"], F.lit("\nOutput: "), e["output"])
        more = F.coalesce(F.array_join(F.transform(shown, line), ""), F.lit(""))
        head, task = self.head().rsplit("\n\nTask: ", 1)
        payload = F.to_json(F.struct(*[c.alias(n) for n, c in inputs.items()]), {"ignoreNullFields": "false"})
        return F.concat(F.lit(head), more, F.lit(f"\n\nTask: {task}"), payload, F.lit("\nOutput: "))

    def parse(self, reply: Column) -> Column:
        """The reply's fields; null for a reply without the JSON object."""
        return F.from_json(reply, self.output)

    def problem(self, reply: str | None) -> str | None:
        """Why a reply is no answer, or None."""
        try:
            value = json.loads(json_span(reply) or "")
        except ValueError as e:
            return f"no JSON object: {e}"
        if not isinstance(value, dict):
            return "no JSON object"
        missing = [f for f in self.fields() if f not in value]
        return f"fields are missing: {', '.join(missing)}" if missing else None

    def repair(self, reply: str | None, problem: str) -> str:
        return f"{problem}. Write the text below as one JSON object of these fields: {self.output}\n\nTask: repair\nInput: {json.dumps({'text': reply})}\nOutput: "

    def digest(self) -> str:
        """Changes with anything that the model sees."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def with_examples(self, *examples: tuple[dict, dict]) -> Prompt:
        for _, out in examples:
            if missing := set(self.fields()) - set(out):
                raise ValueError(f"an example lacks {', '.join(sorted(missing))}")
        return replace(self, examples=(*self.examples, *examples))

    def save(self, path: str | Path) -> None:
        path = Path(path)
        if path.exists():
            raise FileExistsError(path)
        path.write_text(json.dumps(asdict(self) | {"digest": self.digest()}, ensure_ascii=False, indent=1), encoding="utf-8")

    @staticmethod
    def load(path: str | Path) -> Prompt:
        """Read a saved prompt; a file that was changed by hand, against its digest, is an error."""
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        digest = held.pop("digest", None)
        prompt = Prompt(**held | {"examples": tuple((a, b) for a, b in held["examples"])})
        if digest not in (None, prompt.digest()):
            raise ValueError(f"{path} does not match its digest")
        return prompt

    def translated(self, language: str, translate: Callable[[list[str]], list[str]], instruction: bool = False) -> Prompt:
        """All strings of the examples (and the instruction, if asked) through ``translate``, which must give as many back."""
        texts = strings(self.examples)
        new = translate(texts) if texts else []
        if len(new) != len(texts):
            raise ValueError(f"{len(texts)} strings went to the translation, {len(new)} came back")
        head = translate([self.instruction])[0] if instruction else self.instruction
        return replace(self, language=language, examples=tuple((a, b) for a, b in with_strings(self.examples, iter(new))), instruction=head)


def strings(value) -> list[str]:  # noqa: ANN001
    """All strings within nested lists, tuples and dictionaries' values, in order."""
    if isinstance(value, str):
        return [value]
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, (list, tuple)) else ()
    return [s for p in parts for s in strings(p)]


def with_strings(value, new):  # noqa: ANN001, ANN201
    """The same shape with the strings taken from the iterator ``new``."""
    if isinstance(value, str):
        return next(new)
    if isinstance(value, dict):
        return {k: with_strings(v, new) for k, v in value.items()}
    return [with_strings(v, new) for v in value] if isinstance(value, (list, tuple)) else value


def save_prompts(prompts: dict[str, Prompt], folder: str | Path) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, prompt in prompts.items():
        prompt.save(Path(folder) / f"{name}_{prompt.language}.json")


def load_prompts(names: list[str], folder: str | Path, language: str = "english") -> dict[str, Prompt]:
    return {n: Prompt.load(Path(folder) / f"{n}_{language}.json") for n in names}


def content_parts(context: Column, allowed_hosts: tuple[str, ...] = ()) -> Column:
    """struct(kind, value) of a context that may be an image: ``image`` for a base64 data URI or an https link to an allowed host that
    ends like an image, else ``text``. Local paths are never read: they are text."""
    data = F.regexp_extract(context, r"(?is)^\s*data:image/[a-z.+-]+;base64,([A-Za-z0-9+/=\s]+)$", 1)
    host = F.lower(F.regexp_extract(context, r"(?i)^\s*https://([^/?#:@\s]+)", 1))
    link = F.rlike(context, F.lit(r"(?i)^\s*https://[^\s@]+\.(png|jpe?g|gif|webp|bmp)(\?\S*)?\s*$")) & host.isin(*allowed_hosts or ("",))
    return F.struct(F.when((data != "") | (link & (host != "")), F.lit("image")).otherwise(F.lit("text")).alias("kind"), context.alias("value"))
