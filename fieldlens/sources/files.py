"""Files opened inside tasks, by their path or URI."""

import re

from pyarrow import fs


def opened(path):
    """The file system of a path and the path in it; a path without a scheme is on the machine's own disk."""
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def below(root, path):
    """A path as it is if it is absolute, else below `root`."""
    return path if root is None or path.startswith("/") or re.match(r"\w+:/", path) else f"{root.rstrip('/')}/{path}"


def tasks(spark):
    """The number of tasks that rows naming files are dealt to. By their own size, a few bytes, they would all be merged into one."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
