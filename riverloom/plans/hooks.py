"""Lifecycle hooks: Python callables, or URLs that receive a JSON body."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from riverloom.functions.predicates import ConfigError

#: The events of a pipeline's life.
EVENTS = ("on_init", "on_pre_batch", "on_post_batch", "on_error", "on_checkpoint", "on_shutdown")


def post(url: str, body: dict, timeout: float = 5.0) -> None:
    from urllib.request import Request, urlopen

    urlopen(Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=timeout).close()


@dataclass
class Hooks:
    calls: dict[str, list[Callable[[dict], None]]] = field(default_factory=dict)

    @classmethod
    def of(cls, config: dict, functions: dict[str, Callable]) -> Hooks:
        calls: dict[str, list[Callable[[dict], None]]] = {}
        for event, entries in (config or {}).items():
            if event not in EVENTS:
                raise ConfigError(f"no hook {event!r}")
            for e in entries if isinstance(entries, list) else [entries]:
                if callable(e):
                    call = e
                elif isinstance(e, dict) and e.get("url"):
                    call = lambda body, url=e["url"]: post(url, body)
                elif isinstance(e, str) and e in functions:
                    call = functions[e]
                else:
                    raise ConfigError(f"hook {event}: {e!r} is neither a function nor a url")
                calls.setdefault(event, []).append(call)
        return cls(calls)

    def fire(self, event: str, subject: str) -> None:
        """Hooks never stop a pipeline."""
        for call in self.calls.get(event, []):
            try:
                call({"event": event, "subject": subject})
            except Exception as e:  # a hook's fault is its own
                print(f"hook {event} failed: {e}")
