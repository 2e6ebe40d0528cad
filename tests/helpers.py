"""What several test modules use."""

SMALL = "/root/testdata/sf0.001"


def rows(df, *cols):
    """Sorted tuples of a DataFrame, nulls included."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
