"""Requests to an external model, through a callable that the caller brings. By default nothing is sent."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: Seconds before a busy model is asked again.
WAITS = (2.0, 6.0)


class Busy(Exception):
    """The model can't answer just now."""


@dataclass(frozen=True)
class Consent:
    mode: str = "local_only"
    given: bool = False
    key: str = ""

    def check(self) -> None:
        """Raises unless requests are switched on, agreed to, and there is a key."""
        if self.mode != "ai_assisted":
            raise PermissionError("requests are switched off")
        if not self.given:
            raise PermissionError("nobody agreed to sending text")
        if not self.key:
            raise PermissionError("there is no key")


def ask(model: Callable[[str], str], prompt: str, wait: Callable[[float], None] = time.sleep) -> tuple[str, list[str]]:
    """(answer, errors of the attempts before); a busy model is asked three times."""
    errors: list[str] = []
    for pause in (*WAITS, None):
        try:
            return model(prompt), errors
        except Busy as e:
            errors.append(str(e))
            if pause is None:
                raise
            wait(pause)
    raise AssertionError


def answers(requests: DataFrame, model: Callable[[str], str], consent: Consent) -> DataFrame:
    """(request, answer, error) of requests (request, prompt); an answer that is no JSON is an error of its own row."""
    consent.check()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r, prompt in zip(part["request"], part["prompt"]):
                try:
                    text = ask(model, prompt)[0]
                    json.loads(text)
                    rows.append((r, text, None))
                except (Busy, ValueError) as e:
                    rows.append((r, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["request", "answer", "error"])

    return requests.select("request", "prompt").mapInPandas(run, "request long, answer string, error string")
