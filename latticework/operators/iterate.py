"""A cursor over the chunks of a dataset, for programs that take one at a time."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ChunkIterator:
    """Iterates (chunk coordinates, cells) of a cell table, in row-major order of the chunks.

    Each step is a selection whose chunk ranges prune partitions; nothing is
    fetched until a chunk's DataFrame is used. ``cancelled`` is asked before each
    step; ``on_progress(done, total)`` is told after it.
    """

    def __init__(self, cells: DataFrame, coords: Sequence[str], dims: Sequence[int], chunk: Sequence[int], cancelled: Callable[[], bool] | None = None):
        if len(chunk) != len(dims) or min(chunk, default=0) < 1:
            raise ValueError("chunks must have the array's rank and positive extents")
        self.cells, self.coords, self.dataset_dims, self.chunk_dims = cells, list(coords), tuple(dims), tuple(chunk)
        self.counts = tuple(-(-n // c) for n, c in zip(dims, chunk, strict=True))
        self.total, self.done = math.prod(self.counts), 0
        self.on_progress: Callable[[int, int], None] | None = None
        self._cancelled = cancelled or (lambda: False)

    @property
    def progress(self) -> float:
        return self.done / self.total if self.total else 1.0

    def reset(self) -> None:
        self.done = 0

    def coordinates(self, number: int) -> tuple[int, ...]:
        """A chunk's coordinates from its row-major number."""
        out = []
        for n in reversed(self.counts):
            number, k = divmod(number, n)
            out.append(k)
        return tuple(reversed(out))

    def extents(self, at: tuple[int, ...]) -> tuple[int, ...]:
        """A chunk's extents, clipped at the array's edge."""
        return tuple(min(c, n - k * c) for k, c, n in zip(at, self.chunk_dims, self.dataset_dims, strict=True))

    def chunk(self, at: tuple[int, ...]) -> DataFrame:
        out = self.cells
        for name, k, c, n in zip(self.coords, at, self.chunk_dims, self.dataset_dims, strict=True):
            if f"chunk_{name}" in self.cells.columns:
                out = out.where(F.col(f"chunk_{name}") == k)
            out = out.where(F.col(name).between(k * c, min((k + 1) * c, n) - 1))
        return out

    def __iter__(self) -> Iterator[tuple[tuple[int, ...], DataFrame]]:
        while self.done < self.total:
            if self._cancelled():
                raise InterruptedError("chunk iteration was cancelled")
            at = self.coordinates(self.done)
            yield at, self.chunk(at)
            self.done += 1
            if self.on_progress:
                self.on_progress(self.done, self.total)
