"""Staging of uploaded files, with a limit on their size."""

from __future__ import annotations

import uuid
from pathlib import Path
from typing import BinaryIO

from foliora.errors import FolioraError

BLOCK = 1 << 20
LIMIT = 50 * BLOCK


class UploadError(FolioraError):
    """An upload has no name or is too large."""


def stage(name: str, stream: BinaryIO, folder: str, limit: int = LIMIT) -> Path:
    """Store a stream under a name of its own in ``folder``; nothing is left of one larger than ``limit`` bytes."""
    if not (base := Path(name).name):
        raise UploadError("An upload needs a name.")
    target = Path(folder) / f"{uuid.uuid4().hex}_{base}"
    target.parent.mkdir(parents=True, exist_ok=True)
    left = limit
    with target.open("wb") as out:
        while left >= 0 and (part := stream.read(BLOCK)):
            left -= len(part)
            if left >= 0:
                out.write(part)
    if left < 0:
        target.unlink()
        raise UploadError(f"An upload may have {limit} bytes at most.")
    return target
