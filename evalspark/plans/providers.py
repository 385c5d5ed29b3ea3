"""Deterministic providers for the registered queries and tests (no model)."""

from __future__ import annotations

from evalspark.operators.infer import ProviderBase


class RuleProvider(ProviderBase):
    """Deterministic provider for tests and oracles.

    Answers ``I see <n> images. Final answer: <len(question) mod 50> miles``;
    raises for any batch holding a question whose text length is a multiple
    of ``fail_every`` (to exercise failure isolation).
    """

    def __init__(self, name: str = "rule", fail_every: int = 0, **kw) -> None:
        super().__init__(name, **kw)
        self.fail_every = fail_every

    def respond(self, requests: list[dict]) -> list[str | None]:
        out = []
        for r in requests:
            q = r.get("question_text") or ""
            if self.fail_every and len(q) % self.fail_every == 0:
                raise RuntimeError("simulated model failure")
            imgs = r.get("image_lists")
            n = 0 if imgs is None else len(imgs)
            out.append(f"I see {n} images. Final answer: {len(q) % 50} miles")
        return out


class EchoProvider(ProviderBase):
    """Echoes the question (checks plumbing, like the echoed-prompt runs, D24)."""

    def __init__(self, name: str = "echo", **kw) -> None:
        super().__init__(name, **kw)

    def respond(self, requests: list[dict]) -> list[str | None]:
        return [r.get("question_text") for r in requests]
