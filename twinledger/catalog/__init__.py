"""The registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations


def all_queries() -> dict:
    """Name -> (query, SQL or None), over all groups."""
    from twinledger.catalog import files, recon, rules

    groups = (recon.QUERIES, rules.QUERIES, files.QUERIES)
    out = {}
    for group in groups:
        repeated = out.keys() & group.keys()
        if repeated:
            raise ValueError(f"query names used twice: {sorted(repeated)}")
        out.update(group)
    return out
