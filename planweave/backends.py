"""Plug-in reconstructions: DataFrames of views in, points out.

A backend is any object with ``name`` and ``reconstruct(views) -> points``. A learned model
brings its own through ``register``; the built-in one takes views that already have depth."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from .operators import align, fusion


class Backend(Protocol):
    name: str

    def reconstruct(self, views: DataFrame) -> DataFrame: ...


@dataclass
class DepthBackend:
    """Views with depth and poses: flat pictures dropped, then fused."""

    name: str = "rgbd"
    stride: int = 4
    voxel: float | None = 0.02
    far: float = 8.0

    def reconstruct(self, views: DataFrame) -> DataFrame:
        return fusion.fuse(align.drop_flat_views(views), self.stride, self.voxel, far=self.far)


@dataclass
class ChunkedBackend:
    """Chunks of a walk as a network returns them (``chunk_id`` and VIEWS): chained by their shared
    views, flat pictures dropped, fused."""

    name: str = "chunks"
    stride: int = 4
    voxel: float | None = 0.02

    def reconstruct(self, views: DataFrame) -> DataFrame:
        return fusion.fuse(align.drop_flat_views(align.chain_chunks(views).drop("chunk_id", "chunk_scale")), self.stride, self.voxel)


_MADE: dict[str, Callable[..., Backend]] = {"rgbd": DepthBackend, "chunks": ChunkedBackend}


def register(name: str, make: Callable[..., Backend]) -> None:
    _MADE[name] = make


def names() -> list[str]:
    return sorted(_MADE)


def get(name: str, **options) -> Backend:
    """A backend by name; KeyError for an unknown one."""
    if name not in _MADE:
        raise KeyError(f"unknown backend {name!r}; there are {names()}")
    return _MADE[name](**options)
