"""User code as columns and tables: embedders and search providers.

The functions run inside tasks over Arrow batches; Spark partitions the rows and their number is not limited.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


@dataclass(frozen=True)
class Embedder:
    """A model: loaded once per task by ``load``, then called with lists of inputs."""

    load: Callable[[], Callable[[list], np.ndarray]]
    dim: int
    fingerprint: str


def with_embedding(df: DataFrame, column: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """Adds the vectors of a column; the fingerprint of the model belongs in the key of any index made of them."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder.load()
        for values in batches:
            vectors = np.asarray(model(values.tolist()), dtype=np.float32)
            if vectors.shape != (len(values), embedder.dim):
                raise ValueError(f"expected {len(values)} x {embedder.dim} values, got {vectors.shape}")
            yield pd.Series(list(vectors))

    return df.withColumn(out, embed(F.col(column)))


ANSWER = "search string, provider string, outcome string, failure string, body string, elapsed_ms long, hits long"


@dataclass(frozen=True)
class Provider:
    """A source of answers: ``fetch(query, limit)`` gives (outcome, body, hits) and may raise."""

    name: str
    fetch: Callable[[str, int], tuple[str, str | None, int]]
    max_results: int = 20
    priority: int = 0
    timeout_ms: int = 20_000
    ready: bool = True


class Providers:
    """The providers of one application. A broken one delivers FAILED rows, not a failed job."""

    def __init__(self) -> None:
        self._known: dict[str, Provider] = {}

    def register(self, provider: Provider) -> None:
        if provider.name in self._known:
            raise ValueError(f"provider {provider.name} is registered twice")
        self._known[provider.name] = provider

    def register_provider(self, name: str, fetch, max_results: int = 20) -> None:
        self.register(Provider(name, fetch, max_results))

    def register_reverse_provider(
        self, name: str, fetch, priority: int, timeout_ms: int = 20_000, ready: bool = True, max_results: int = 30
    ) -> None:
        self.register(Provider(name, fetch, max_results, priority, timeout_ms, ready))

    def answers(self, searches: DataFrame, limit: int = 5) -> DataFrame:
        """One row per search (search, query) and ready provider; timeouts are told by elapsed_ms and timeout_ms."""
        ready = sorted((p for p in self._known.values() if p.ready), key=lambda p: (p.priority, p.name))

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import time

            for pdf in batches:
                rows = []
                for search, query in zip(pdf["search"], pdf["query"]):
                    for p in ready:
                        started = time.monotonic()
                        try:
                            outcome, body, hits = p.fetch(query, max(1, min(limit, p.max_results)))
                            failure = None
                        except Exception as e:  # noqa: BLE001 - user code
                            outcome, body, hits, failure = "FAILED", None, 0, type(e).__name__
                        elapsed = int((time.monotonic() - started) * 1000)
                        rows.append((search, p.name, outcome, failure, body, elapsed, hits))
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in ANSWER.split(", ")])

        limits = F.create_map(*[F.lit(v) for p in ready for v in (p.name, p.timeout_ms)])
        asked = searches.select(F.col("search").cast("string").alias("search"), "query").mapInPandas(ask, ANSWER)
        return asked.withColumn("timeout_ms", limits[F.col("provider")])
