"""Classification of file paths: kind, test files, generated files, scope buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders of what is installed, built or cached, and never measured.
VENDORED = [
    ".git", "node_modules", "venv", ".venv", "env", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".eggs",
    "site-packages", "target", "build", "dist", "vendor",
]
TOOLING = ["setup.py", "noxfile.py", "conftest.py", "tasks.py", "manage.py"]
TEST_MARKERS = ["tests", "test"]
#: What each kind of measurement leaves out, by the name of a folder.
SCOPES = {"production": ["tests", "test"], "production-without-conformance": ["tests", "test", "conformance"], "whole-repo": []}
GENERATED = ["@generated", "Code generated by", "Generated by the protocol buffer compiler"]
FRAMEWORKS = [
    "import pytest", "import unittest", "from unittest", "@pytest", "org.junit", "org.testng", "using Xunit", "using NUnit",
    "Microsoft.VisualStudio.TestTools", "[TestMethod]", "[Fact]", "@Test", '"testing"', "#[test]", "#[cfg(test)]", "require 'rspec'",
    'require "rspec"', "minitest", "describe(", "from vitest", "require('mocha')",
]
_DOC = r"\.(md|rst|adoc|txt|feature)$"
_CODE = r"(\.(py|rs|go|js|jsx|ts|tsx|java|cs|rb|c|h|cc|cpp|hpp|sh|sql|yml|yaml|json|toml)|(^|/)dockerfile)$"
_STEM = r"(Tests?|Specs?)$"


def parts(path: Column) -> Column:
    return F.split(path, "/")


def name_of(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def stem_of(path: Column) -> Column:
    """The name without its last suffix; a name that only begins with a dot has none."""
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def folder_of(path: Column) -> Column:
    """The path of the folder, '' at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def file_kind(path: Column) -> Column:
    """doc, code or other, by the suffix in lower case; doc wins."""
    low = F.lower(path)
    return F.when(low.rlike(_DOC), "doc").when(low.rlike(_CODE), "code").otherwise("other")


def is_test_file(path: Column) -> Column:
    """By any part of the path, the name's start or end, or a capitalised ending of the stem."""
    marked = F.exists(parts(path), lambda p: F.lower(p).rlike(r"^(tests?|specs?|__tests__)$|\.(tests?|specs?)$"))
    return marked | F.lower(name_of(path)).rlike(r"^test_|(_test|\.test|\.spec)(\.[^.]*)?$") | stem_of(path).rlike(_STEM)


def is_test_name(path: Column) -> Column:
    """By the file's name alone, so that no folder can vouch for itself."""
    low = F.lower(name_of(path))
    return low.rlike(r"^test[_.-]") | F.lower(stem_of(path)).rlike(r"([_-]test|\.test|\.spec|[_-]spec)$") | stem_of(path).rlike(_STEM)


def is_vendored(path: Column) -> Column:
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, VENDORED)))


def matches(component: Column, marker: str) -> Column:
    """Whether a part of a path is what a marker names: a test marker also in any case and as a dotted ending."""
    if marker not in TEST_MARKERS:
        return component == marker
    return (F.lower(component) == marker) | F.lower(component).endswith("." + marker)


def is_generated(text: Column) -> Column:
    """By the sentinels that generators write into the first 2 KiB."""
    head = F.substring(text, 1, 2048)
    found = F.lit(False)
    for marker in GENERATED:
        found = found | head.contains(marker)
    return F.coalesce(found, F.lit(False))


def names_framework(text: Column) -> Column:
    """Whether the first 4 KiB name a test framework."""
    head = F.substring(text, 1, 4096)
    found = F.lit(False)
    for marker in FRAMEWORKS:
        found = found | head.contains(marker)
    return F.coalesce(found, F.lit(False))


def bucket(path: Column, has_packages: Column, scope_marker: Column | None = None, root_is_package: Column | None = None) -> Column:
    """Why a file is out of scope, the first reason of several; NULL for one in it.

    `scope_marker` is the folder's name that scopes it out, if any; without it every test folder does."""
    if scope_marker is None:
        scope_marker = F.when(F.exists(parts(folder_of(path)), lambda p: matches(p, "tests")), "tests").when(F.exists(parts(folder_of(path)), lambda p: matches(p, "test")), "test")
    root = (F.size(parts(path)) == 1) & F.lower(path).endswith(".py") & has_packages & ~(root_is_package if root_is_package is not None else F.lit(False))
    return (
        F.when(is_vendored(path), "vendored").when(scope_marker.isNotNull(), scope_marker).when(F.array_contains(parts(path), "docs"), "docs")
        .when(name_of(path).isin(*TOOLING), "tooling").when(root, "root-script")
    )
