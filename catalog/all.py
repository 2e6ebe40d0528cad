"""Importing this module registers every query."""

from catalog import (  # noqa: F401
    a_sources, bf_domains, g_asof, h_history, i_integrity, j_scans, k_repair, n_indexes, s_streaming,
)
