"""Files of a shared file system, opened by workers (and the driver) through pyarrow."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyarrow import fs as pa_fs

from brepflow.session import qualified

__all__ = ["opened", "qualified"]


def opened(uri: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a qualified path, and the path in it."""
    if uri.startswith("file:") or uri.startswith("/"):
        return pa_fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return pa_fs.FileSystem.from_uri(quote(uri, safe=":/@?=&%"))
