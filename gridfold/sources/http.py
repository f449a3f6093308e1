"""Downloads for the driver: a cache by content key, retries, a type check, and a line in a manifest per file."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import time
import urllib.request
from collections.abc import Callable
from pathlib import Path


def _open(url: str, timeout: float) -> tuple[bytes, str]:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read(), r.headers.get("Content-Type", "")


def fetch(url: str, folder: str, *, expect: str | None = None, tries: int = 3, wait: float = 1.0, timeout: float = 60, opener: Callable[[str, float], tuple[bytes, str]] = _open) -> Path:
    """The cached file of a URL. It appears by rename when it is whole; a wrong content type raises and leaves nothing."""
    target = Path(folder) / hashlib.sha256(url.encode()).hexdigest()
    if target.exists():
        return target
    for k in range(tries):
        try:
            body, kind = opener(url, timeout)
            break
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    if expect and expect not in kind:
        raise ValueError(f"{url}: {kind or 'no content type'}, not {expect}")
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(f".{os.getpid()}.part")
    part.write_bytes(body)
    part.replace(target)
    line = {"url": url, "file": target.name, "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest(), "fetched_at": datetime.datetime.now(datetime.UTC).isoformat()}
    with (target.parent / "manifest.jsonl").open("a") as f:
        f.write(json.dumps(line) + "\n")
    return target
