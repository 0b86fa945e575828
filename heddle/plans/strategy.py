"""Which form a matrix product takes: sparse, dense blocks or many smaller blocks."""

from __future__ import annotations

from dataclasses import dataclass

#: Keys of a domain this small may be worth a dense form; mean rows from which blocks are small.
DENSE_KEYS, BLOCKED_ROWS = 4096, 1 << 26
#: Cells that dense blocks may hold beside the entries there are.
MOST_CELLS = 1 << 24


@dataclass(frozen=True)
class Choice:
    strategy: str
    why: str


def choose(distinct_keys: int, mean_rows: float, product: bool, cells: int | None = None) -> Choice:
    """product: the query is a matrix product (SUM of a product, grouped by both outer indexes).

    cells: of the full matrices. Dense forms are refused where zeros would dominate.
    """
    if cells is not None and cells > MOST_CELLS and cells > 16 * mean_rows:
        return Choice("sparse", "the full matrices would hold mostly zeros")
    if product and mean_rows >= BLOCKED_ROWS:
        return Choice("blocked", f"a product of {mean_rows:.0f} rows a side")
    if product or (distinct_keys and 1.0 / distinct_keys > 1.0 / DENSE_KEYS):
        return Choice("dense", "a product" if product else f"{distinct_keys} distinct keys")
    return Choice("sparse", f"{distinct_keys} distinct keys")
