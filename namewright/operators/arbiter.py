"""Arbitration of close pairs by a language model."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from namewright.plans.config import Arbitration

REPLY = "decision STRING, confidence STRING, reason STRING"


class Judge(Protocol):
    def query(self, prompt: str) -> str: ...


def eligible(config: Arbitration, a_core: Column, b_core: Column, a_numeric: Column, b_numeric: Column, score: Column, runner_up: Column) -> Column:
    """Whether a pair may be judged: no conflict of numbers, not both of one token, a close race.

    runner_up is the second of the candidates for each of them; the cap on calls is not looked at."""
    x, y = F.array_sort(F.array_distinct(a_numeric)), F.array_sort(F.array_distinct(b_numeric))
    numbers = (F.size(x) > 0) & (F.size(y) > 0) & (x != y)
    short = (F.size(a_core) < 2) & (F.size(b_core) < 2)
    close = runner_up.isNull() | (score - runner_up < config.min_confidence)
    single = F.lit(config.forbid_both_single_token) & (F.size(a_core) == 1) & (F.size(b_core) == 1)
    return F.lit(config.enabled) & ~numbers & ~short & close & ~single


def parse_reply(raw: Column) -> Column:
    """struct(decision, confidence, reason) of a JSON reply; what is missing has defaults, what is no
    JSON is UNSURE with reason parse_error, and what is no object or number has reason error."""
    got = F.from_json(raw, REPLY)
    valid = F.try_parse_json(raw).isNotNull()
    whole = valid & F.ltrim(raw).startswith("{")
    number = F.coalesce(got["confidence"], F.lit("0.0")).try_cast("double")
    ok = whole & number.isNotNull()
    reason = F.when(~valid, "parse_error").when(~ok, "error").otherwise(F.coalesce(got["reason"], F.lit("")))
    return F.struct(
        F.when(ok, F.coalesce(got["decision"], F.lit("UNSURE"))).otherwise("UNSURE").alias("decision"), F.when(ok, number).otherwise(0.0).alias("confidence"), reason.alias("reason")
    )


def verdict(decision: str, confidence: float, config: Arbitration) -> str:
    sure = confidence >= config.min_confidence
    return "MATCH" if decision == "SAME" and sure else "NO_MATCH" if decision == "DIFFERENT" and sure else "REVIEW"


def prompt(a_name: str, b_name: str, evidence: dict, ignored: Iterable[str] = ()) -> str:
    lines = ["Do these two names denote the same organization?", json.dumps({"a": a_name, "b": b_name, "evidence": evidence}, indent=2, ensure_ascii=False, sort_keys=True)]
    if ignored := sorted(ignored):
        lines.append("IGNORE differences in words of these kinds: " + ", ".join(ignored) + ".")
    lines.append('Answer with JSON alone: {"decision": "SAME" | "DIFFERENT" | "UNSURE", "confidence": 0 to 1, "reason": "..."}')
    return "\n".join(lines)


@dataclass
class Arbiter:
    """Sequential state: a cache and a budget of calls over the whole run."""

    config: Arbitration
    judge: Judge | None = None
    calls: int = 0
    cache: dict[str, tuple[str, float, str]] = field(default_factory=dict)

    def ask(self, key: str, text: str) -> tuple[str, float, str]:
        if key in self.cache:
            return self.cache[key]
        if self.judge is None:
            return "UNSURE", 0.0, "no_provider"
        try:
            raw = self.judge.query(text)
            try:
                got = json.loads(raw)
            except ValueError:
                answer = ("UNSURE", 0.0, "parse_error")
            else:
                answer = (str(got.get("decision", "UNSURE")), float(got.get("confidence", 0.0)), str(got.get("reason", "")))
            self.calls += 1
        except Exception:  # noqa: BLE001  a judge may fail in any way
            answer = ("UNSURE", 0.0, "error")
        self.cache[key] = answer
        return answer

    def settle(self, rows: Iterable) -> dict[int, tuple[str, int, float, list[str]]]:
        """rows (a_id, b_id, key, prompt, score, reasons) in order of a and rank -> for each a the
        first verdict that is not REVIEW: (decision, b_id, score, reasons).  Ends at the cap."""
        out: dict[int, tuple[str, int, float, list[str]]] = {}
        for r in rows:
            if self.calls >= self.config.global_call_cap:
                break
            if r["a_id"] in out:
                continue
            decision, confidence, _ = self.ask(r["key"], r["prompt"])
            if (said := verdict(decision, confidence, self.config)) != "REVIEW":
                out[r["a_id"]] = (said, r["b_id"], r["score"], [*r["reasons"], f"llm_{decision.lower()}"])
        return out
