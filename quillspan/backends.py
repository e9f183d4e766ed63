"""Language-model backends: generate(system, user) -> reply.

A backend is made on the driver, pickled to the executors and called there; keys come from the configuration, never
from data. Prompts state the fields wanted and end in one line of JSON with the inputs, which the rule backend reads.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.jsonx import ENTITY_TYPES
from .session import cut


class Backend(Protocol):
    def generate(self, system: str, user: str) -> str: ...


class StageFailed(RuntimeError):
    """A stage that was to be strict has a row without an accepted reply."""


#: What each stage asks for.
ASKS: Mapping[str, str] = {
    "entities": "List the entities named in the text as a JSON object {\"entities\": [{\"type\", \"name\", \"mentions\": [{\"start\", \"end\", \"sent_id\"}]}]}. "
    f"Types are {', '.join(ENTITY_TYPES)}. Offsets count characters of the text from 0, the end is exclusive.",
    "same": "Say whether the two named entities are one and the same, as a JSON object {\"same\", \"confidence\", \"rationale\"}. If in doubt, they are not.",
    "relations": "List the relations and events among the entities given, by their ids, as a JSON object {\"relations\": [{\"type\", \"source_label\", \"head\", \"tail\", \"polarity\", \"modality\", \"supports\"}], "
    "\"events\": [{\"type\", \"source_label\", \"participants\": [{\"role\", \"entity_id\"}], \"status\", \"polarity\", \"supports\"}]}. Polarity is asserted, negated or hypothetical; modality factual, reported or conditional; "
    "status planned, ongoing, completed or cancelled. Each has one support {\"start\", \"end\", \"sent_id\", \"trigger\": {\"start\", \"end\"}} or more, the trigger inside it.",
    "traits": "Give the probability of each Big Five trait of the person as the text shows it, as a JSON object {\"person\", \"trait_probs\": {trait: probability}, \"evidence\": [{\"span\": [start, end], \"text\", \"hedges\", \"neg\"}], \"rationale\"}. "
    "Spans count characters of the text from 0. Without evidence give none.",
}


def prompt(stage: str, **inputs: object) -> tuple[str, str]:
    """(system, user) of a stage."""
    return f"You extract facts from text and answer with one JSON object only. Stage: {stage}.", f"{ASKS[stage]}\nInput: {json.dumps(inputs, ensure_ascii=False)}"


def prompt_inputs(user: str) -> dict:
    return json.loads(user[user.rindex("\nInput: ") + 8 :])


class ReplayBackend:
    """Canned replies by the digest of the prompt, or by a function of the stage and its inputs."""

    def __init__(self, replies: Mapping[str, str] | Callable[[str, dict], str], default: str = ""):
        self.replies, self.default = replies, default

    @staticmethod
    def key(system: str, user: str) -> str:
        return hashlib.sha256(f"{system}\n{user}".encode()).hexdigest()

    def generate(self, system: str, user: str) -> str:
        if callable(self.replies):
            return self.replies(system.rpartition("Stage: ")[2].rstrip("."), prompt_inputs(user))
        return self.replies.get(self.key(system, user), self.default)


#: What a chat request asks for unless told otherwise.
CHAT_SETTINGS = {"model": "gpt-4o-mini", "temperature": 0.0, "max_tokens": 1500, "response_format": {"type": "json_object"}}
KEY_NAMES = ("OPENAI_KEY", "OPENAI_API_KEY")


def named_key(env_file: str = ".env") -> str | None:
    """The key of the chat service from the environment, else from lines NAME=value of a file."""
    told = dict(os.environ)
    if os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as f:
            pairs = (line.removeprefix("export ").partition("=") for line in map(str.strip, f) if "=" in line and not line.startswith("#"))
            told = {k.strip(): v.strip().strip("\"'") for k, _, v in pairs} | told
    return next((told[k] for k in KEY_NAMES if told.get(k)), None)


class ChatBackend:
    """A chat-completions endpoint over HTTP. Keyword arguments change CHAT_SETTINGS; None leaves one out, as response_format=None does JSON mode."""

    def __init__(self, api_key: str | None = None, url: str = "https://api.openai.com/v1/chat/completions", timeout: int = 60, **settings: object):
        self.url, self.timeout, self.api_key = url, timeout, api_key or named_key()
        self.settings = {k: v for k, v in (CHAT_SETTINGS | settings).items() if v is not None}

    def generate(self, system: str, user: str) -> str:
        body = self.settings | {"messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        ask = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        with urllib.request.urlopen(ask, timeout=self.timeout) as reply:
            return json.loads(reply.read())["choices"][0]["message"]["content"] or ""


#: Words by which the rule backend tells types and traits.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sir")
ORG_WORDS = ("Inc", "Corp", "Company", "University", "Bank", "Agency")
PLACE_WORDS = ("Street", "City", "River", "Lake", "Restaurant", "House")
TRAIT_WORDS: Mapping[str, Sequence[str]] = {
    "Openness": ("curious", "imagine", "invent", "dream", "new"),
    "Conscientiousness": ("work", "careful", "plan", "always", "finish"),
    "Extraversion": ("laugh", "friend", "party", "shout", "together"),
    "Agreeableness": ("help", "kind", "share", "thank", "care"),
    "Neuroticism": ("afraid", "worry", "cry", "angry", "nervous"),
}


@dataclass
class RulesBackend:
    """Deterministic replies by word rules: names are runs of capitalised words, relations are what stands between two names."""

    name: re.Pattern = field(default_factory=lambda: re.compile(r"(?:(?:Mr|Mrs|Ms|Dr|Prof|Sir)\. )?[A-Z][\w’'-]+(?: [A-Z][\w’'-]+)*"))

    def generate(self, system: str, user: str) -> str:
        stage, given = system.rpartition("Stage: ")[2].rstrip("."), prompt_inputs(user)
        return json.dumps(getattr(self, f"_{stage}")(given), ensure_ascii=False)

    def _kind(self, name: str) -> str:
        words = name.replace(".", "").split()
        if words[0] in TITLES:
            return "Person"
        for kind, marks in (("Org", ORG_WORDS), ("Location", PLACE_WORDS)):
            if any(w in marks for w in words):
                return kind
        return "Person" if len(words) > 1 else "Concept"

    def _entities(self, given: dict) -> dict:
        text, starts = given["text"], given.get("sentence_starts") or [0]
        found: dict[str, list[dict]] = {}
        for m in self.name.finditer(text):
            sent = max((i for i, s in enumerate(starts) if s <= m.start()), default=0)
            if m.start() in starts and " " not in m[0]:
                continue  # a single word at the head of a sentence is no name
            found.setdefault(m[0], []).append({"start": m.start(), "end": m.end(), "sent_id": sent})
        return {"entities": [{"type": self._kind(n), "name": n, "mentions": v} for n, v in found.items()]}

    def _same(self, given: dict) -> dict:
        a, b = (set(given[k]["name"].lower().split()) for k in "ab")
        return {"same": a <= b or b <= a, "confidence": round(len(a & b) / max(1, len(a | b)), 2), "rationale": "shared words"}

    def _relations(self, given: dict) -> dict:
        text = given["text"]
        at = sorted((m["start"], m["end"], m["sent_id"], e["id"]) for e in given["entities"] for m in e["mentions"])
        out: dict[str, list] = {"relations": [], "events": []}
        for (a, b, s, x), (c, d, t, y) in zip(at, at[1:], strict=False):
            between = text[b:c].strip(" ,.")
            if s != t or x == y or not between or len(between) > 40:
                continue
            start = text.index(between, b)
            support = {"start": a, "end": d, "sent_id": s, "trigger": {"start": start, "end": start + len(between)}}
            out["relations"].append({"type": between, "source_label": between, "head": x, "tail": y, "supports": [support]})
            if between.endswith("ed"):
                out["events"].append({"type": between, "source_label": between, "participants": [{"role": "agent", "entity_id": x}, {"role": "patient", "entity_id": y}], "supports": [support]})
        return out

    def _traits(self, given: dict) -> dict:
        text = given["text"]
        probs, evidence = {}, []
        for trait, marks in TRAIT_WORDS.items():
            hits = [m for w in marks for m in re.finditer(rf"\b{w}\w*", text, re.IGNORECASE)]
            if hits:
                probs[trait] = min(1.0, 0.7 + 0.1 * len(hits))
                evidence += [{"span": [m.start(), m.end()], "text": m[0], "hedges": [], "neg": False} for m in hits]
        return {"person": given["person"], "trait_probs": probs, "evidence": sorted(evidence, key=lambda e: e["span"])}


def ask(
    rows: DataFrame, backend: Backend, build: Callable[[dict], tuple[str, str]], accept: Callable[[str, dict], str | None] | None = None, attempts: int = 1,
    concurrency: int | None = None
) -> DataFrame:
    """Adds `reply` and `failure` (why none was accepted) to each row.

    `accept` returns what is wrong with a reply, or None; a wrong one is asked for again, `attempts` times in all. Equal
    prompts of a batch are asked once. Computing the result anew would ask anew: settled() writes it down.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, failures = [], []
            told: dict[tuple[str, str], tuple[str | None, str | None]] = {}
            for row in batch.to_pylist():
                key = build(row)
                if key not in told:
                    reply, wrong = None, "no attempt"
                    for _ in range(attempts):
                        try:
                            reply = backend.generate(*key)
                            wrong = accept(reply, row) if accept else None
                        except Exception as e:  # a failed call is retried and then reported
                            wrong = f"{type(e).__name__}: {e}"
                        if wrong is None:
                            break
                    told[key] = (reply, wrong)
                replies.append(told[key][0])
                failures.append(told[key][1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(failures, pa.string())], [*names, "reply", "failure"])

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("reply", StringType()), StructField("failure", StringType())])
    return (rows.repartition(concurrency) if concurrency else rows).mapInArrow(run, schema)


def settled(asked: DataFrame, stage: str, key: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """What ask() gave, written to the shared folder, and its failures as (stage, key, reason, raw).

    Replies are asked for once, whatever is lost later, so that all tables of a run tell the same. `strict` raises StageFailed for a failure.
    """
    asked = cut(asked)
    errors = asked.where("failure is not null").select(F.lit(stage).alias("stage"), key.alias("key"), F.col("failure").alias("reason"), F.col("reply").alias("raw"))
    refuse(errors, strict)
    return asked, errors


def refuse(errors: DataFrame, strict: bool) -> None:
    """Raises StageFailed for the first of `errors` if the run is strict."""
    if strict and (bad := errors.limit(1).collect()):
        raise StageFailed(f"{bad[0]['stage']} of {bad[0]['key']}: {bad[0]['reason']}")
