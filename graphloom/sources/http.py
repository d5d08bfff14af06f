"""Web APIs: one request on the driver, whose answer becomes rows."""

from __future__ import annotations

import os
import re

from ..model import Source

#: Fields that go into the request's head; others are query parameters.
HEAD = ("authorization", "accept", "keyid", "user-agent")


def fetch(source: Source, section: dict[str, str]) -> str:
    import requests

    head, query = {}, {}
    for name, value in source.http:
        value = re.sub(r"\$\{?(\w+)\}?", lambda m: os.environ.get(m[1], m[0]), value)
        (head if any(h in name.lower() for h in HEAD) else query)[name] = value
    r = requests.get(source.location, headers=head, params=query, timeout=60)
    r.raise_for_status()
    return r.text
