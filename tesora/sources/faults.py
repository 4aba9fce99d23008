"""Archives that cannot be read: the reason of each, so that one file never stops the others."""

from __future__ import annotations

import io
import lzma
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

#: What reading a member may raise when its bytes are damaged.
DAMAGE = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, OSError)


@contextmanager
def opened(content: bytes | None) -> Iterator[tuple[zipfile.ZipFile | None, str | None]]:
    """The archive in ``content``, or the reason why there is none."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except NotImplementedError:
        yield None, "UNSUPPORTED_COMPRESSION"
        return
    except (*DAMAGE, ValueError):  # a damaged directory may also hold impossible names or offsets
        yield None, "BAD_ARCHIVE"
        return
    with archive:
        yield archive, None


#: Members of at most so many bytes are held whole.
SMALL = 1 << 20


def small_member(archive: zipfile.ZipFile, name: str) -> bytes | None:
    """A small sound member, read once with its checksum; of any other nothing, and its problem is found by reading it."""
    try:
        member = archive.getinfo(name)
        return None if member.flag_bits & 1 or member.file_size > SMALL else archive.read(member)
    except (NotImplementedError, KeyError, *DAMAGE):
        return None


def member_problem(archive: zipfile.ZipFile, name: str) -> str | None:
    """Why a member cannot be read, found by reading it once in pieces; its checksum is compared on the way."""
    try:
        if archive.getinfo(name).flag_bits & 1:
            return "ENCRYPTED"
        with archive.open(name) as stream:
            while stream.read(1 << 20):
                pass
    except NotImplementedError:
        return "UNSUPPORTED_COMPRESSION"
    except KeyError:
        return "MISSING_MEMBER"
    except DAMAGE:
        return "CORRUPT"
    return None
