"""Where a local language model answers, which one is asked, and the secret that callers show."""

from __future__ import annotations

import hmac
import secrets
from urllib.parse import urlsplit

# The address that a local model server has by itself, and the model taken first.
LOCAL_HOST, LOCAL_PORT, FIRST_MODEL = "127.0.0.1", 11434, "llama3.2"
ANY_HOST = ("", "0.0.0.0", "::")


def base_url(host: str = "") -> str:
    """The address of a model server from a setting like host, host:port or a whole URL."""
    host = host.strip()
    plain = f"http://{LOCAL_HOST}:{LOCAL_PORT}"
    if not host:
        return plain
    try:
        parts = urlsplit(host if "://" in host else f"http://{host}")
        name, port = parts.hostname or "", parts.port or LOCAL_PORT
    except ValueError:
        return plain
    name = LOCAL_HOST if name in ANY_HOST else name
    place = f"[{name}]:{port}" if ":" in name else f"{name}:{port}"
    return f"{parts.scheme}://{place}{parts.path}".rstrip("/")


def chosen_model(installed: list[str], wanted: str = "") -> str:
    """The model asked for, or else the first of the usual family, or else the first there is."""
    if wanted:
        return wanted
    if not installed:
        raise LookupError("no model is installed")
    return next((m for m in installed if m.startswith(FIRST_MODEL)), installed[0])


def new_token() -> str:
    return secrets.token_hex(32)


def same_token(shown: str, token: str) -> bool:
    """Whether they agree, in a time that does not tell where they differ. An empty token lets nobody in."""
    return bool(token) and hmac.compare_digest(shown.encode(), token.encode())
