"""The library's query catalogue."""

from tidemark.plans import artifacts, contents, leakage, series, vectors
from tidemark.plans.base import Catalogue


def catalogues() -> list[Catalogue]:
    return [contents.catalogue, vectors.catalogue, series.catalogue, leakage.catalogue, artifacts.catalogue]
