"""Settings from JSON, plain or nested as {"value": ...}."""

from __future__ import annotations

import json
from typing import Any


def lookup(document: dict, key: str, default: Any = None) -> Any:
    """The value of a key, wherever it is; of a nested entry its ``value`` (unless its status says disabled)."""
    if key in document:
        found = document[key]
        if isinstance(found, dict) and "value" in found:
            return default if found.get("status") == "disabled" else found["value"]
        return found
    for inner in document.values():
        if isinstance(inner, dict):
            got = lookup(inner, key, None)
            if got is not None:
                return got
    return default


def load(text: str, **defaults: Any) -> dict[str, Any]:
    document = json.loads(text)
    return {k: lookup(document, k, v) for k, v in defaults.items()}
