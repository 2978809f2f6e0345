"""HTTP requests of the search-index and time-series connectors."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.parse
import urllib.request
from typing import Any


def auth_headers(config: dict[str, Any]) -> dict[str, str]:
    """Headers for NONE, BASIC, API_KEY (id and key) and API_KEY_ENCODED."""
    kind = str(config.get("authType") or "NONE").upper()
    if kind == "BASIC":
        return {"Authorization": "Basic " + base64.b64encode(f"{config['username']}:{config['password']}".encode()).decode()}
    if kind == "API_KEY":
        pair = f"{config['apiKeyId']}:{config['apiKey']}" if config.get("apiKeyId") else str(config["apiKey"])
        return {"Authorization": "ApiKey " + base64.b64encode(pair.encode()).decode()}
    return {"Authorization": f"ApiKey {config.get('apiKeyEncoded') or config['apiKey']}"} if kind == "API_KEY_ENCODED" else {}


def polls_left(config: dict[str, Any], offset: dict) -> bool:
    """Whether a stream at ``offset`` may poll again under ``maxPolls`` (0: always)."""
    most = int(config.get("maxPolls") or 0)
    return not most or offset.get("polls", 0) < most


def next_offset(config: dict[str, Any], offset: dict, cursor: Any) -> dict:
    """The offset after a poll; polls are counted only where they are bounded, so that an idle stream stands still."""
    counted = {"polls": offset.get("polls", 0) + 1} if int(config.get("maxPolls") or 0) else {}
    return {"cursor": json.dumps(cursor), **counted}


def request(method: str, url: str, body: bytes | None = None, headers: dict[str, str] | None = None, timeout: float = 30) -> bytes:
    """The answer's body; ``OSError`` with the status and body where it is no success."""
    call = urllib.request.Request(url, data=body, method=method, headers=headers or {})
    try:
        with urllib.request.urlopen(call, timeout=timeout) as answer:
            return answer.read()
    except urllib.error.HTTPError as e:
        raise OSError(f"status {e.code}: {e.read().decode(errors='replace')[:500]}") from e


def request_json(method: str, url: str, body: Any = None, headers: dict[str, str] | None = None, timeout: float = 30) -> Any:
    data = json.dumps(body).encode() if body is not None else None
    return json.loads(request(method, url, data, {"Content-Type": "application/json", **(headers or {})}, timeout) or b"{}")


def base_url(host: str) -> str:
    host = host.strip().rstrip("/")
    return host if "://" in host else f"http://{host}"
