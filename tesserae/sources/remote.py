"""Images on the web: one bounded download with a second request that races a slow first one."""

from __future__ import annotations

import queue
import threading
import urllib.request

from ..model import MAX_BYTES

#: Seconds after which a second request is made, and after which one is given up; bytes read of one at a time.
HEDGE, TIMEOUT, BLOCK = 1.5, 60.0, 1 << 16


class NotAnImage(ValueError):
    """The link leads to something else than an image of at most the size asked for."""


def once(url: str, most: int = MAX_BYTES, timeout: float = TIMEOUT, stop: threading.Event | None = None) -> bytes:
    """The bytes of one image: http or https only, told by its content type, not above most bytes."""
    if not url.lower().startswith(("http://", "https://")):
        raise NotAnImage(url)
    request = urllib.request.Request(url, headers={"Accept": "image/*"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        kind = answer.headers.get_content_type()
        if not kind.startswith("image/"):
            raise NotAnImage(f"{kind}: {url}")
        if int(answer.headers.get("Content-Length") or 0) > most:
            raise NotAnImage(f"more than {most} bytes: {url}")
        out = bytearray()
        while part := answer.read(BLOCK):
            out += part
            if len(out) > most:
                raise NotAnImage(f"more than {most} bytes: {url}")
            if stop and stop.is_set():
                raise TimeoutError(url)
        return bytes(out)


def fetch(url: str, most: int = MAX_BYTES, hedge: float = HEDGE, timeout: float = TIMEOUT) -> bytes:
    """An image's bytes. A request that takes longer than hedge seconds gets a second one beside it, and the first answer counts;
    one that fails before that fails for good."""
    done: queue.Queue = queue.Queue()
    stop = threading.Event()

    def run() -> None:
        try:
            done.put((once(url, most, timeout, stop), None))
        except Exception as error:  # handed to the caller
            done.put((None, error))

    def start() -> None:
        threading.Thread(target=run, daemon=True).start()

    start()
    running = 1
    try:
        body, error = done.get(timeout=hedge)
    except queue.Empty:
        start()
        running = 2
        body, error = done.get()
    while error is not None and running > 1:
        running -= 1
        body, error = done.get()
    stop.set()
    if error is not None:
        raise error
    return body
