"""Reports of runs as JSON and Markdown, and alerts."""

from __future__ import annotations

import json
import logging
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from typing import Any

log = logging.getLogger(__name__)


def to_json(report: Mapping[str, Any]) -> str:
    return json.dumps(report, sort_keys=True, default=str)


def to_markdown(rows: Sequence[Mapping[str, Any]], columns: Sequence[str] | None = None) -> str:
    """A table; floats in two places, a bar in a value escaped."""
    columns = list(columns or (rows[0] if rows else []))
    text = lambda v: "" if v is None else f"{v:,.2f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v).replace("|", "\\|")
    lines = [columns, ["-"] * len(columns), *[[text(r.get(c)) for c in columns] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def post(url: str, timeout: float = 10) -> Callable[[str], None]:
    """A sender to a chat's webhook."""

    def send(text: str) -> None:
        body = json.dumps({"text": text}).encode()
        urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout).close()

    return send


def alert(title: str, facts: Mapping[str, Any], send: Callable[[str], None] | None = None) -> bool:
    """Tell someone, or the log without `send`. An alert must not hide the
    fault it is about, so it never raises; false if it could not be sent."""
    text = "\n".join([title, *[f"{k}: {v}" for k, v in facts.items()]])
    try:
        if send is None:
            log.error(text)
        else:
            send(text)
    except Exception:
        log.exception("the alert could not be sent: %s", text)
        return False
    return True
