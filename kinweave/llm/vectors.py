"""Vectors as bytes, and groups of rows that arrive in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def usable(vector) -> bytes | None:
    """The vector as doubles in bytes; None if null, empty, zero, or with a null or non-finite part."""
    if vector is None or not len(vector):
        return None
    try:
        values = np.asarray(vector, dtype=np.float64) + 0.0  # no negative zero
    except (TypeError, ValueError):
        return None
    return values.tobytes() if np.isfinite(values).all() and values.any() else None


def matrix(parts) -> np.ndarray:
    """Rows of doubles from equally long byte strings."""
    joined = b"".join(parts)
    return np.frombuffer(joined, dtype=np.float64).reshape(len(parts), -1) if len(parts) else np.zeros((0, 0))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, where each group begins, and the end) of sorted batches, with groups kept whole.

    Only the group that a batch breaks off is carried over, so callers bound the size of a group.
    """
    carried = None
    for batch in batches:
        if carried is not None:
            batch = pd.concat((carried, batch), ignore_index=True)
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        if len(cuts):
            yield batch.iloc[:cuts[-1]], np.concatenate(([0], cuts))
            batch = batch.iloc[cuts[-1]:]
        carried = batch
    if carried is not None and len(carried):
        yield carried, np.array([0, len(carried)])
