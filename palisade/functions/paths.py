"""What kind of file a path names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import fixed


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, parts: list[str]) -> Column:
    return any_of([text.contains(p) for p in parts])


def ends_any(text: Column, ends: list[str]) -> Column:
    return any_of([text.endswith(e) for e in ends])


def starts_any(text: Column, starts: list[str]) -> Column:
    return any_of([text.startswith(s) for s in starts])


def is_build_tooling(path: Column) -> Column:
    p = F.lower(path)
    b = base_name(p)
    return b.isin(fixed.BUILD_NAMES) | ends_any(b, fixed.BUILD_NAME_ENDS) | contains_any(b, fixed.BUILD_NAME_PARTS) | contains_any(p, fixed.BUILD_PATH_PARTS) | starts_any(p, fixed.BUILD_PATH_STARTS)


def is_data_config(path: Column) -> Column:
    return ends_any(F.lower(path), fixed.DATA_ENDS)


def is_test_or_doc(path: Column) -> Column:
    """A test or document directory anywhere on the way, a path that is one, or a telling name."""
    p = F.lower(path)
    parts = F.split(p, "/")
    directories = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    known = F.array(*[F.lit(d) for d in fixed.TEST_DOC_DIRECTORIES])
    return p.isin(fixed.TEST_DOC_DIRECTORIES) | F.arrays_overlap(directories, known) | contains_any(p, fixed.TEST_DOC_PARTS) | ends_any(p, fixed.TEST_DOC_ENDS)


def is_vendored_bundle(path: Column) -> Column:
    p = F.lower(path)
    b = base_name(p)
    return ends_any(b, fixed.BUNDLE_NAME_ENDS) | contains_any(b, fixed.BUNDLE_NAME_PARTS) | contains_any(p, fixed.BUNDLE_PATH_PARTS) | starts_any(p, fixed.BUNDLE_PATH_STARTS)


def is_setup_file(path: Column) -> Column:
    return base_name(F.lower(path)).isin(fixed.SETUP_NAMES)


def is_package_metadata(path: Column) -> Column:
    p = F.lower(path)
    return base_name(p).isin(fixed.METADATA_NAMES) | contains_any(p, fixed.METADATA_PARTS)


def is_sbom(path: Column) -> Column:
    p = F.lower(path)
    return contains_any(p, fixed.SBOM_PARTS) | ends_any(p, fixed.SBOM_ENDS)


def is_package_churn(path: Column) -> Column:
    return contains_any(F.lower(path), fixed.CHURN_PARTS)


def is_home_scoped(path: Column) -> Column:
    return path.startswith("/root/") | path.startswith("/home/")
