"""Typed settings shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The default look-back windows of the rolling features.
DEFAULT_WINDOWS = ("1h", "24h", "7d", "30d")


@dataclass(frozen=True)
class TxnConfig:
    """Which column plays which role in a transaction table.

    A role whose column is absent from the input switches its feature family off.
    """

    id: str = "transaction_id"
    time: str = "transaction_date"
    user: str = "user_id"
    merchant: str = "merchant_id"
    amount: str = "amount"
    currency: str = "currency"
    status: str = "status"
    label: str = "fraud"
    windows: tuple = DEFAULT_WINDOWS
    on_bad_time: str = "fail"  # "fail" or "null"
    time_formats: tuple = ()  # tried after ISO text, e.g. ("dd.MM.yyyy HH:mm",)
    label_delay: str | None = None  # e.g. "7d": labels become visible that much later

    def with_(self, **changes) -> "TxnConfig":
        return replace(self, **changes)


@dataclass(frozen=True)
class ScalePolicy:
    """Row counts at which a plan changes shape.

    ``max_group_rows``
        A key with more rows than this is cut into consecutive chunks, so that no
        task has to sort or scan the whole key.
    ``max_chunks``
        Bound on the number of cut points kept on the driver and broadcast. When
        ``total / max_chunks`` exceeds ``max_group_rows`` it becomes the limit.
    ``exact_sort_rows``
        At most this many rows of a quantile's last brackets are counted per value; a smaller
        number makes brackets be refined further, the result is exact with any.
    """

    max_group_rows: int = 1_000_000
    max_chunks: int = 50_000
    exact_sort_rows: int = 2_000_000

    def chunk_limit(self, total: int) -> int:
        return max(self.max_group_rows, total // self.max_chunks, 1)


DEFAULT_POLICY = ScalePolicy()
