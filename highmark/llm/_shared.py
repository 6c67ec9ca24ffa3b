"""What several operators need."""

from highmark.storage import Scratch, noted, numbered, release, remove, shared_dir, shared_root, stored

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "Scratch", "noted", "numbered", "release", "remove", "shared_dir", "shared_root", "stored"]
