"""Files read in pieces by tasks: where tokens stand, without a whole file in memory."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs

#: The encryption token, the header's beginning and what stands for a missing header.
TOKEN, HEADER, NO_HEADER = b"/Encrypt", b"%PDF-", "%PDF-1.7"


@contextlib.contextmanager
def _opened(path: str):
    """A file by its path as Spark lists it, which is no URI: signs in it are not escaped."""
    scheme, colon, rest = path.partition(":/")
    if not colon or scheme == "file":
        with open("/" + rest.lstrip("/") if colon else path, "rb") as file:
            yield file
        return
    host, _, below = rest.lstrip("/").partition("/") if rest.startswith("/") else ("", "", rest)
    system, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    with system.open_input_file(f"{root.rstrip('/')}/{below}") as file:
        yield file


def token_pieces(piece: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of each piece (path, length, n): whether it has a token that begins in it, and where a header first does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, length, n in zip(batch["path"], batch["length"], batch["n"]):
                with _opened(path) as file:
                    file.seek(int(n) * piece)
                    data = file.read(piece + len(TOKEN) - 1)
                at = data.find(HEADER, 0, piece + len(HEADER) - 1)
                rows.append((path, length, TOKEN in data, int(n) * piece + at if at >= 0 else None))
            found = pd.DataFrame(rows, columns=["path", "length", "encrypted", "header_at"])
            yield found.astype({"header_at": "Int64"})

    return run


def headers(step: int = 4096) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The header from its first place to the line's end; a file without one gets the usual version."""

    def line(path: str, at: int) -> str:
        parts = []
        with _opened(path) as file:
            file.seek(at)
            while data := file.read(step):
                ends = [i for i in (data.find(b"\r"), data.find(b"\n")) if i >= 0]
                parts.append(data[: min(ends)] if ends else data)
                if ends:
                    break
        return b"".join(parts).decode("latin-1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            versions = [NO_HEADER if pd.isna(at) else line(path, int(at)) for path, at in zip(batch["path"], batch["header_at"])]
            yield pd.DataFrame({"path": batch["path"], "length": batch["length"], "version": versions, "maybe_encrypted": batch["maybe_encrypted"]})

    return run
