"""A search over one table, put together step by step: vectors and text are fused by reciprocal ranks, filters hold for all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fulltext import bm25
from .retrieval import knn, ranked, rrf

if TYPE_CHECKING:
    from quillrake.sources.table import Table


@dataclass(frozen=True)
class Search:
    """Every step gives a new search, so a part of one can be used again."""

    source: DataFrame | Table
    id_col: str
    parts: tuple[tuple, ...] = ()
    wheres: tuple[Column | str, ...] = ()
    most: int = 10
    skip: int = 0
    candidates: int | None = None
    columns: tuple[str, ...] = ()
    rrf_k: float = 60

    def where(self, condition: Column | str) -> Search:
        return replace(self, wheres=(*self.wheres, condition))

    def vector(self, column: str, query: Sequence[float], metric: str = "l2") -> Search:
        return replace(self, parts=(*self.parts, ("vector", column, list(query), metric)))

    def text(self, column: str, query: str, analyzer: str = "standard") -> Search:
        return replace(self, parts=(*self.parts, ("text", column, query, analyzer)))

    def limit(self, k: int, offset: int = 0) -> Search:
        return replace(self, most=k, skip=offset)

    def select(self, *columns: str) -> Search:
        return replace(self, columns=columns)

    def options(self, **values: Mapping) -> Search:
        """``candidates`` of each part that are fused (twice the rows asked for unless given), ``rrf_k``."""
        return replace(self, **values)

    def _rows(self) -> DataFrame:
        rows = self.source if isinstance(self.source, DataFrame) else self.source.df()
        for w in self.wheres:
            rows = rows.where(w)
        return rows

    def df(self) -> DataFrame:
        """Rows with ``distance`` or ``score`` of a single part, or ``rrf_score`` of several, best first; without parts in order of id."""
        rows, n = self._rows(), self.candidates or 2 * (self.most + self.skip)
        if not self.parts:
            out, order = rows, [F.col(self.id_col)]
        elif len(self.parts) == 1:
            kind, column, query, how = self.parts[0]
            if kind == "vector":
                out, order = knn(rows, column, query, self.most + self.skip, self.id_col, how), [F.col("distance"), F.col(self.id_col)]
            else:
                out, order = rows.join(self._bm25(column, query, how), self.id_col), [F.col("score").desc(), F.col(self.id_col)]
        else:
            lists = []
            for kind, column, query, how in self.parts:
                if kind == "vector":
                    best = knn(rows, column, query, n, self.id_col, how).select(self.id_col, "distance")
                    lists.append(ranked(best, "distance", self.id_col))
                else:
                    found = self._bm25(column, query, how).join(rows.select(self.id_col), self.id_col, "left_semi")
                    lists.append(ranked(found.orderBy(F.col("score").desc(), self.id_col).limit(n), "score", self.id_col, descending=True))
            out, order = rows.join(rrf(lists, self.id_col, self.rrf_k), self.id_col), [F.col("rrf_score").desc(), F.col(self.id_col)]
        out = out.orderBy(*order)
        out = out.offset(self.skip).limit(self.most) if self.skip else out.limit(self.most)
        return out.select(*self.columns, *[c for c in ("distance", "score", "rrf_score") if c in out.columns and c not in self.columns]) if self.columns else out

    def _bm25(self, column: str, query: str, analyzer: str) -> DataFrame:
        """Statistics are those of the whole table; a fresh index of a table is used."""
        if isinstance(self.source, DataFrame):
            return bm25(self.source, self.id_col, column, query, analyzer)
        return self.source.bm25(column, query, id_col=self.id_col, analyzer=analyzer)
