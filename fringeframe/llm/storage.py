"""Files that tasks write to and read from the shared folder, through whichever store its URI names."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("/"):
        uri = "file://" + uri
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


@contextmanager
def publish(folder: str, name: str):
    """(stream, final URI). The file gets its name when it is whole; an attempt that fails leaves no such name.

    Names carry a random part, so a task that runs again never touches what another attempt has published.
    """
    files, path = store(folder)
    files.create_dir(path, recursive=True)
    final = f"{name}-{uuid.uuid4().hex[:12]}"
    with files.open_output_stream(f"{path}/.{final}.part") as out:
        yield out, f"{folder}/{final}"
    files.move(f"{path}/.{final}.part", f"{path}/{final}")


@contextmanager
def opened(uri: str):
    """A file open for range reads."""
    files, path = store(uri)
    with files.open_input_file(path) as f:
        yield f
