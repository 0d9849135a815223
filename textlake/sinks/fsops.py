"""Commands on single files and folders, run on the driver under a path policy."""

from __future__ import annotations

import os
import shutil
import uuid

from textlake.functions.policy import PathPolicy

NEW_FOLDER = 0o755


def create_directory(policy: PathPolicy, path: str) -> str:
    path = policy.validate(path)
    os.makedirs(path, NEW_FOLDER, exist_ok=True)
    return path


def move_file(policy: PathPolicy, source: str, destination: str) -> str:
    """Files and folders; never over something that exists."""
    source, destination = policy.validate(source), policy.validate(destination)
    if not os.path.exists(source):
        raise FileNotFoundError(f"source does not exist: {source}")
    if os.path.lexists(destination):
        raise FileExistsError(f"destination exists: {destination}")
    os.rename(source, destination)
    return destination


def copy_file(policy: PathPolicy, source: str, destination: str) -> str:
    """A file, with its mode and modification time; never over something that exists."""
    source, destination = policy.validate(source), policy.validate(destination)
    if not os.path.exists(source):
        raise FileNotFoundError(f"source does not exist: {source}")
    if os.path.isdir(source):
        raise IsADirectoryError(f"source is a directory: {source}")
    if os.path.lexists(destination):
        raise FileExistsError(f"destination exists: {destination}")
    temporary = f"{destination}.{uuid.uuid4().hex}.tmp"
    try:
        shutil.copy2(source, temporary)
        os.rename(temporary, destination)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise
    return destination


def delete_file(policy: PathPolicy, path: str) -> str:
    path = policy.validate(path)
    if not os.path.lexists(path):
        raise FileNotFoundError(f"file does not exist: {path}")
    if os.path.isdir(path):
        raise IsADirectoryError(f"path is a directory: {path}")
    os.unlink(path)
    return path
