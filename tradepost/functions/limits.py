"""Sizes that decide which of two exact ways a job takes. None of them changes a result."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Limits:
    # Keys of a batch that may be sent to every task: some 16 MB.
    broadcast_keys: int = 1_000_000
    # Rows of one key that one window may number or add up.
    window_rows: int = 1_000_000
    # Rows of one key that one task may fold in order, and rows of one fold task.
    fold_rows: int = 1_000_000
    # Values that the stock of a long queue may take for its chunks to be walked by tables.
    stock_values: int = 4096
    # Links per task and file of a round of grouping, once there are more such files than cores: 1 MB.
    stored_links: int = 65_536


LIMITS = Limits()
