"""Named transformations (SQL of ``{x}``) and feature generators."""

from __future__ import annotations

from collections.abc import Callable

from .functions.expr import TRANSFORMS, finite, num
from .spec import FeatureOrigin, FeatureSpec


class Registry:
    def __init__(self) -> None:
        self._transforms = {k: v[1] for k, v in TRANSFORMS.items()}
        self._generators: dict[str, Callable] = {}

    def register_transformation(self, name: str, sql: str) -> None:
        if "{x}" not in sql:
            raise ValueError("a transformation is SQL text with {x}")
        self._transforms[name] = sql

    def get_transformation(self, name: str) -> str | None:
        return self._transforms.get(name)

    def list_transformations(self) -> list[str]:
        return sorted(self._transforms)

    def register_generator(self, name: str, fn: Callable) -> None:
        self._generators[name] = fn

    def get_generator(self, name: str) -> Callable | None:
        return self._generators.get(name)

    def list_generators(self) -> list[str]:
        return sorted(self._generators)

    def create_feature(self, name: str, transformation: str, column: str) -> FeatureSpec:
        if transformation not in self._transforms:
            raise ValueError(f"unknown transformation {transformation!r}")
        return FeatureSpec(name, finite(self._transforms[transformation].format(x=num(column))), FeatureOrigin.CUSTOM, source_columns=(column,), transformation=transformation)


registry = Registry()
