"""Completion clients and their use on a column of prompts."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gapgraph.errors import CompletionError


#: What is said of an answer that came but can't be used.
UNUSABLE = "no usable JSON"


class CompletionClient(Protocol):
    """Answers one prompt; raises on failure. Clients are pickled to the workers."""

    model: str

    def complete(self, prompt: str, system: str, temperature: float, max_tokens: int) -> str: ...


def messages(prompt: str, system: str) -> list[dict[str, str]]:
    return ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]


def provider_info(client: CompletionClient, settings) -> dict[str, object]:
    return {"provider": settings.provider, "model": client.model, "temperature": settings.temperature, "max_retries": settings.max_retries}


def attempt(client: CompletionClient, prompt: str, system: str, temperature: float, max_tokens: int, max_retries: int, pause: float = 1.0) -> str:
    """The stripped answer; waits pause, 2 pause, 4 pause, ... between attempts and raises CompletionError after the last."""
    for k in range(max_retries):
        try:
            return client.complete(prompt, system, temperature, max_tokens).strip()
        except Exception as error:  # noqa: BLE001  whatever a provider's library raises
            if k + 1 == max_retries:
                raise CompletionError(client.model, str(error), max_retries) from error
            time.sleep(pause * 2**k)
    raise CompletionError(client.model, "no attempt allowed", 0)


def complete(prompts: DataFrame, client: CompletionClient, system: str, temperature: float, max_tokens: int = 4096, max_retries: int = 3, pause: float = 1.0) -> DataFrame:
    """``prompts`` with raw and status ("ok", or the error after the last attempt, then raw is null)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields) + ", raw string, status string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws, states = [], []
            for prompt in batch["prompt"]:
                try:
                    raws.append(attempt(client, prompt, system, temperature, max_tokens, max_retries, pause))
                    states.append("ok")
                except CompletionError as error:
                    raws.append(None)
                    states.append(error.reason)
            yield batch.assign(raw=raws, status=states)

    return prompts.mapInPandas(run, schema)


#: Where each provider answers, the form of its requests, and the usual variable of its key (fixed values).
ENDPOINTS = {
    "ollama": ("http://localhost:11434", "ollama", None),
    "openai": ("https://api.openai.com/v1", "chat", "OPENAI_API_KEY"),
    "anthropic": ("https://api.anthropic.com/v1", "messages", "ANTHROPIC_API_KEY"),
    "groq": ("https://api.groq.com/openai/v1", "chat", "GROQ_API_KEY"),
    "mistral": ("https://api.mistral.ai/v1", "chat", "MISTRAL_API_KEY"),
    "together_ai": ("https://api.together.xyz/v1", "chat", "TOGETHERAI_API_KEY"),
}
_ROUTES = {"ollama": "/api/chat", "chat": "/chat/completions", "messages": "/messages"}


class HttpClient:
    """A provider over HTTP, by the form of its requests: "chat", "messages" or "ollama"."""

    def __init__(self, model: str, base: str, form: str = "chat", key: str | None = None, timeout: float = 120.0):
        if form not in _ROUTES:
            raise ValueError(f"form must be one of {', '.join(_ROUTES)}")
        self.model, self.base, self.form, self.key, self.timeout = model, base.rstrip("/"), form, key, timeout

    def request(self, prompt: str, system: str, temperature: float, max_tokens: int) -> tuple[str, dict, dict[str, str]]:
        """(URL, body, headers) of one call."""
        headers = {"Content-Type": "application/json"}
        body: dict = {"model": self.model.removeprefix("ollama/"), "messages": messages(prompt, system)}
        if self.form == "ollama":
            body |= {"stream": False, "options": {"temperature": temperature, "num_predict": max_tokens}}
        else:
            body |= {"temperature": temperature, "max_tokens": max_tokens}
        if self.form == "messages":
            body["messages"] = messages(prompt, "")
            body |= {"system": system} if system else {}
            headers |= {"anthropic-version": "2023-06-01"} | ({"x-api-key": self.key} if self.key else {})
        elif self.key:
            headers["Authorization"] = f"Bearer {self.key}"
        return self.base + _ROUTES[self.form], body, headers

    def complete(self, prompt: str, system: str, temperature: float, max_tokens: int) -> str:
        url, body, headers = self.request(prompt, system, temperature, max_tokens)
        asked = urllib.request.Request(url, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
            got = json.loads(answer.read())
        if self.form == "ollama":
            return got["message"]["content"] or ""
        if self.form == "messages":
            return "".join(part.get("text", "") for part in got["content"])
        return got["choices"][0]["message"]["content"] or ""


def client_for(settings) -> CompletionClient:
    """The client of the provider that the settings name."""
    if settings.provider == "offline":
        return OfflineClient()
    base, form, variable = ENDPOINTS[settings.provider]
    return HttpClient(settings.model_id, settings.api_base or base, form, settings.api_key or (os.environ.get(variable) if variable else None))


def raise_lost(completions: DataFrame, client: CompletionClient, max_retries: int, column: str = "status") -> None:
    """CompletionError if a call of ``completions`` failed on every attempt (``column`` is neither "ok" nor about an answer's text)."""
    lost = completions.filter(~F.col(column).isin("ok", UNUSABLE)).select(column).first()
    if lost is not None:
        raise CompletionError(client.model, lost[0], max_retries)


class OfflineClient:
    """Deterministic answers without a network.

    A prompt that asks for claims gets one claim per sentence that holds a causal cue between two
    noun-like stretches; a prompt that asks for a hypothesis gets one built from the gap's fields.
    """

    model = "cue-rules"
    #: Cues and the confidence each is worth (fixed values).
    CUES = {"causes": 0.9, "leads to": 0.85, "results in": 0.85, "triggers": 0.8, "induces": 0.8, "increases": 0.75, "reduces": 0.75, "promotes": 0.7, "contributes to": 0.65, "may cause": 0.5, "is associated with": 0.4}

    def complete(self, prompt: str, system: str, temperature: float, max_tokens: int) -> str:
        return self._claims(prompt) if "<paragraph>" in prompt else self._hypothesis(prompt)

    def _claims(self, prompt: str) -> str:
        text = prompt.partition("<paragraph>")[2].partition("</paragraph>")[0]
        cue = re.compile("|".join(re.escape(c) for c in sorted(self.CUES, key=len, reverse=True)), re.I)
        claims = []
        for sentence in re.split(r"(?<=[.!?])\s+", text.strip()):
            found = cue.search(sentence)
            if not found:
                continue
            cause = re.split(r"[,;:]", sentence[: found.start()])[-1].strip()
            effect, _, how = sentence[found.end() :].partition(" through ")
            effect = re.split(r"[,;:.]", effect)[0].strip()
            if cause and effect:
                claims.append({"cause": cause, "effect": effect, "confidence": self.CUES[found[0].lower()], "mechanism": how.strip(" .") or "mechanism not specified", "evidence": sentence.strip()})
        return json.dumps({"claims": claims})

    def _hypothesis(self, prompt: str) -> str:
        def field(name: str) -> str:
            found = re.search(rf"^{name}: (.*)$", prompt, re.M)
            return found[1].strip() if found else ""

        variable, kind, near = field("Variable"), field("Kind of gap"), field("Neighbours").split(", ")[0]
        flip = kind == "MISSING_CAUSE"
        return json.dumps(
            {
                "hypothesis_text": f"{near} and {variable} are linked by a factor that no paper has studied.",
                "predicted_cause": near if flip else variable,
                "predicted_effect": variable if flip else near,
                "predicted_mechanism": "shared intermediate",
                "testability_score": round(0.5 + len(variable) % 5 / 10, 2),
                "novelty_score": round(0.4 + len(near) % 5 / 10, 2),
                "suggested_experiment": f"Measure {near} while {variable} is varied.",
                "supporting_context": field("Explanation"),
            }
        )
