"""Names of columns and datasets."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterable, Sequence


def clean_columns(names: Sequence[str | None]) -> list[str]:
    """Usable, distinct names: letters, digits and underscores, no digit first, repeats numbered."""
    out: list[str] = []
    for i, raw in enumerate(names):
        name = re.sub(r"\W", "_", (raw or "").strip().strip("\"'").strip())
        name = name or f"column_{i}"
        if name[0].isdigit():
            name = "_" + name
        base, n = name, 0
        while name.lower() in {x.lower() for x in out}:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def new_id(taken: Iterable[str]) -> str:
    """A free id of six letters and digits."""
    used = set(taken)
    while True:
        name = "".join(random.choices(string.ascii_lowercase + string.digits, k=6))
        if name not in used:
            return name
