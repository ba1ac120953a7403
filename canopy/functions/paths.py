"""Hierarchy path helpers (H3-H8): Column -> Column over a root-first path array.

The path array is the ``__hier`` column built by ``operators.hierarchy.refresh_hierarchy``:
element 1 is the root, the last element is the node itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.functions._util import col_of, lit_of


def get_level(h, node_id=None) -> Column:
    """H3. Level of the node (path length); with ``node_id``, the level below that ancestor
    counted from its last occurrence, NULL if it is not on the path."""
    h = col_of(h)
    if node_id is None:
        return F.when(F.size(h) > 0, F.size(h))
    pos = F.array_position(F.reverse(h), lit_of(node_id))
    return F.when(h.isNotNull() & (pos > 0), pos.cast("int"))


def root_id(h, node_id=None) -> Column:
    """H4. First element, or ``node_id`` if it is on the path, else NULL."""
    h = col_of(h)
    if node_id is None:
        return F.get(h, 0)
    nid = lit_of(node_id)
    return F.when(F.array_contains(h, nid), nid)


def connect_by_path(h, delimiter: str = ",", node_id=None) -> Column:
    """H5. Path as text from the root, or from the first occurrence of ``node_id`` (NULL if absent)."""
    h = col_of(h)
    if node_id is None:
        return F.array_join(h, delimiter)
    nid = lit_of(node_id)
    start = F.array_position(h, nid)
    return F.when(start > 0, F.array_join(F.slice(h, start.cast("int"), F.size(h)), delimiter))


def get_parent(h, plevel: int, node_id=None) -> Column:
    """H6. The ancestor ``plevel`` steps up (0 = the node itself); with ``node_id`` not above that ancestor."""
    h = col_of(h)
    up = F.try_element_at(h, F.lit(-(plevel + 1)))
    if node_id is None:
        return F.when(F.size(h) >= plevel + 1, up)
    level = get_level(h, node_id)
    # the ancestor is found from the node end; it must be at least plevel steps up
    return F.when(level.isNotNull() & (level - 1 >= plevel), up)


def is_subtree(h, node_id) -> Column:
    """H7. The node is in the subtree of ``node_id`` (itself included)."""
    h = col_of(h)
    return F.when(h.isNotNull(), F.coalesce(F.array_contains(h, lit_of(node_id)), F.lit(False)))


def is_subtree_strict(h, node_id) -> Column:
    """H8. As H7 with the node itself excluded."""
    h = col_of(h)
    above = F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0)))
    return F.when(h.isNotNull(), F.coalesce(F.array_contains(above, lit_of(node_id)), F.lit(False)))
