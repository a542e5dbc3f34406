"""What several test modules use."""


def rows(df, *cols):
    """Sorted tuples of the chosen columns."""
    got = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(got, key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, (list, dict)) else (False, "", str(v)) for v in r))
