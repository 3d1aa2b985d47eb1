"""Files that tasks write and read in the shared folder, by the path's own file system."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import BinaryIO

from pyarrow import fs


def write_whole(uri: str, fill: Callable[[BinaryIO], object]) -> object:
    """Fill a file under a name of this attempt, then move it to its own name.

    A task that is run again, or twice at once, writes the same bytes, so
    whichever attempt moves last changes nothing.
    """
    system, path = fs.FileSystem.from_uri(uri)
    folder, name = path.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft, compression=None) as out:
        result = fill(out)
    system.move(draft, path)
    return result


def open_file(uri: str):
    """A seekable reader."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
