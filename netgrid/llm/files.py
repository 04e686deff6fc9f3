"""Files of tasks in the shared folder: temporary name first, then one rename."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def committed(uri: str):
    """A stream that appears under its name only when it is whole; a repeated task replaces it."""
    system, path = place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as out:
        yield out
    system.move(temporary, path)


def opened(uri: str):
    system, path = place(uri)
    return system.open_input_file(path)
