"""Which package files are code: path-only tests, so they can run before content is read."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsieve.rules import CODE_EXTENSIONS

_EXTENSIONS = "|".join(CODE_EXTENSIONS)

# hidden_pruned: the name must have something in front of the extension, and no
# folder on the way may be node_modules or start with a dot.
# git_pruned: the name only has to end with the extension, and no entry on the way
# (the file itself included) may be called node_modules or .git.
_WALKS = {
    "hidden_pruned": (rf"[^/]\.(?:{_EXTENSIONS})\z", r"(?:^|/)(?:node_modules|\.[^/]*)/"),
    "git_pruned": (rf"\.(?:{_EXTENSIONS})\z", r"(?:^|/)(?:node_modules|\.git)(?:/|\z)"),
}


def in_walk(path: Column, walk: str) -> Column:
    wanted, pruned = _WALKS[walk]
    return path.rlike(wanted) & ~path.rlike(pruned)


def source_files(files: DataFrame, walk: str = "hidden_pruned") -> DataFrame:
    """The code files of each package version under one of the two walking rules."""
    return files.where(in_walk(F.col("path"), walk))
