"""What a user works with: open a dataset, select from it, take it along as other forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators import access, layout
from .plans import service as sv
from .sources.store import Dataset, open_dataset

FORMATS = ("triplet", "csr", "csc", "scipy", "torch")


def row_indices(rows) -> list[int]:
    """Row numbers of a sequence or an array; not of text, nor negative ones."""
    if isinstance(rows, str | bytes):
        raise TypeError("rows are numbers")
    out = [int(r) for r in (rows.tolist() if hasattr(rows, "tolist") else rows)]
    if any(r < 0 for r in out):
        raise IndexError("rows are not negative")
    return out


class View:
    """A dataset as a client sees it; when what it knows has become stale, it is refreshed once."""

    def __init__(self, dataset: Dataset):
        self.dataset, self.ref = dataset, dataset.snapshot().ref()

    def _current(self) -> Dataset:
        now = self.dataset.refresh()
        try:
            now.snapshot().check(self.ref)
        except sv.Stale:
            self.dataset, self.ref = now, now.snapshot().ref()
        return self.dataset

    @property
    def shape(self) -> tuple[int, int]:
        return self._current().shape

    @property
    def nnz(self) -> int:
        return self._current().nnz

    @property
    def obs(self) -> DataFrame:
        return self._current().obs

    @property
    def var(self) -> DataFrame:
        return self._current().var

    def describe(self) -> dict:
        return self._current().describe()

    def head(self, n: int = 5) -> DataFrame:
        if n < 0:
            raise ValueError("n must not be negative")
        return self.rows(range(min(n, self.shape[0])))

    def rows(self, rows: Sequence[int]) -> DataFrame:
        return self._current().rows(row_indices(rows))

    def __getitem__(self, key) -> DataFrame:
        if isinstance(key, slice):
            return self.rows(range(*key.indices(self.shape[0])))
        return self.rows([key] if isinstance(key, int) else key)

    def partition(self, i: int) -> DataFrame:
        return self._current().partition(i)

    def shard(self, i: int) -> DataFrame:
        return self._current().shard(i)

    def matrix(self, form: str = "triplet", most: int = 100_000_000):
        """Lazy tables for triplet, csr and csc; objects on the driver, up to `most` entries, for scipy and torch."""
        ds = self._current()
        if form == "triplet":
            return ds.entries()
        if form == "csr":
            return ds.csr()
        if form == "csc":
            return layout.csc(ds.entries(), ds.var)
        if form not in FORMATS:
            raise ValueError(f"{form!r} is none of {', '.join(FORMATS)}")
        if ds.nnz > most:
            raise ValueError(f"{ds.nnz} entries are too many for the driver")
        t = ds.entries().toPandas()
        if form == "scipy":
            import scipy.sparse as sp

            return sp.csr_matrix((t.value, (t.row, t.col)), ds.shape)
        import torch

        return torch.sparse_coo_tensor(t[["row", "col"]].to_numpy().T, t.value.to_numpy(), ds.shape).coalesce().to_sparse_csr()


def open(path: str, spark: SparkSession | None = None, role: str = "owner") -> View:  # noqa: A001
    return View(open_dataset(spark or SparkSession.builder.getOrCreate(), path, role))


def at(view: View, row: int, col: int) -> float | None:
    """One value, or None where nothing is stored."""
    ds = view._current()
    found = access.point(ds.entries((row, row + 1)), row, col).first()
    return found.value if found else None
