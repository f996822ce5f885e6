"""Hook for a model: patches of items through a vectorised function that is built once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_models: dict[str, Callable] = {}


def encode(items: DataFrame, make: Callable[[], Callable[[pd.DataFrame], np.ndarray]], name: str, special_tokens: int = 1) -> DataFrame:
    """(item_id, patch_id, embedding) of items (item_id, ...). make() builds, once per worker process and name, a function from
    a batch of items to an array [items, tokens, dim], whose first `special_tokens` tokens are left out. A result that is not
    finite or of another rank is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _models.get(name)
        if model is None:
            model = _models[name] = make()
        for batch in batches:
            out = np.asarray(model(batch), np.float32)
            if out.ndim != 3 or len(out) != len(batch) or not np.isfinite(out).all():
                raise ValueError("an encoder gives finite arrays [items, tokens, dim]")
            out = out[:, special_tokens:]
            n = out.shape[1]
            yield pd.DataFrame({"item_id": np.repeat(batch["item_id"].to_numpy(), n), "patch_id": np.tile(np.arange(n), len(batch)), "embedding": list(out.reshape(-1, out.shape[2]))})

    return items.mapInPandas(run, "item_id long, patch_id int, embedding array<float>")
